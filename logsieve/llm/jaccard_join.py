"""Exact similarity join of documents in the metric space of the Jaccard distance.

A document is the set of its four-word shingles; equal sets are one point. Two points link when their
distance is at most E = 1 - 0.85. The join runs in three steps, all on points that may still
have a partner.

1. *Who may link.* All shingles have one order, those that a small sample finds frequent last (the
   sample only shapes the order; any order is right). Points that link share at least ``need``
   of their first shingles, those that are left when 85 % of a set is set aside, and 5 % more. Points
   without as many shared first shingles are dropped, again and again (``peeled``).
2. *Nearest pivots.* Each shared shingle elects one of its points as a pivot, and each point is measured
   against the pivot that most of its shingles elected: its Voronoi region. Points within E are
   linked to their pivot, which makes a group of copies a star. Shingles that lead to
   no other component are of no use any more, so most points are peeled now.
3. *Regions, exactly.* Every shingle that is left puts its points into the region of the pivot it elects, so
   any two points that could link meet in a region. Small regions are joined exhaustively.
   Large ones get several pivots: a point goes to its nearest pivot, at distance h, and as a boundary
   copy to every other pivot within h + 2 E (by the triangle inequality a partner can have no
   other home); points farther than 1 - E from all pivots make a region of their own, joined
   by those beyond 1 - 2 E. These regions are split again in the same way. A region that would
   grow more than ``COPIES`` times by its boundary copies, and what is still large after ``DEPTH``
   splits, is compared in blocks, each pair of blocks in one task.

Inside a region, the known components are never compared with themselves, and only links that connect
two components leave the task, so rows stay linear in the points. Distances are exact on
48-bit hashes of the shingles.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; a null
doc_id counts as larger than any other; rows that repeat a doc_id are documents of their own; an empty
table gives no rows; other columns are ignored. Whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import WordHasher, rolled
from .components import components

SHINGLE = 4
PERCENT = 85
SLACK = 5  # further first shingles, in percent of a set
EDGE = 1 - PERCENT / 100
ROUNDS = 2
DEPTH = 3
PIVOTS = 12
LEAF = 1000
COPIES = 2
LEAF_SHINGLES = 1_000_000
ORDER_BITS = 20
SEEN_BITS = 23
SAMPLE = 64
OFTEN = 8
LOW48 = np.uint64((1 << 48) - 1)
FAR = 0  # the region of the points that are far from all pivots

_hashers: list[WordHasher] = []


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 48-bit hashes of the shingles, ascending."""
    if not _hashers:
        _hashers.append(WordHasher())
    words = _hashers[0]((text or "").encode().lower().split())
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(SHINGLE, len(words))
    return np.unique((rolled(words, width) ^ np.uint64(width)) & LOW48)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def first_count(n: int) -> int:
    """How many first shingles a set of n keeps."""
    return n - (PERCENT * n + 99) // 100 + 1 + SLACK * n // 100


def need(n: Column) -> Column:
    """How many of them it shares at least with any point it links with."""
    return 1 + F.floor(F.lit(SLACK * PERCENT) * n / 10_000)


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """A fixed number of bits, set for the ``slot`` values; its bytes come to the driver."""
    at = F.col("slot").cast("long")
    made = slots.groupBy(F.floor(at / 32768).alias("bucket")).agg(F.bitmap_construct_agg(at % 32768).alias("bits"))
    out = np.zeros((max(1, (1 << bits) // 32768), 4096), np.uint8)
    for row in made.collect():
        out[row["bucket"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return np.unpackbits(out.ravel(), bitorder="little").astype(bool)


def often_seen(docs: DataFrame) -> np.ndarray:
    """Which slots of the shingle order hold shingles that a sample of the documents finds frequent."""
    schema = pa.schema([("t", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [shingle_set(text) for text in batch.column(0).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64))], schema=schema)

    chosen = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select("text")
    frequent = chosen.mapInArrow(run, "t long").groupBy("t").count().filter(F.col("count") >= OFTEN)
    return bitmap(frequent.select(F.col("t").bitwiseAND(F.lit((1 << ORDER_BITS) - 1)).alias("slot")), ORDER_BITS)


def signatures(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, key of the set and its first shingles, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("first", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(often))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(shared.value).astype(bool)
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = shingle_set(text)
                    if not len(found):
                        rows.append((doc_id, 0, None, None))
                        continue
                    last = late[(found & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)]
                    ordered = np.concatenate([found[~last], found[last]])
                    rows.append((doc_id, len(found), set_key(found), packed(ordered[: first_count(len(found))])))
                yield arrow_rows(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key long, first binary")


def first_shingles(sets: DataFrame) -> DataFrame:
    """t, key and n for the first shingles of every point (key, n, first)."""
    schema = pa.schema([("t", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [unpacked(raw) for raw in part.column(2).to_pylist()]
                if found:
                    sizes = [len(some) for some in found]
                    keys, n = (np.repeat(part.column(i).to_numpy(), sizes) for i in range(2))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(found).astype(np.int64)), pa.array(keys), pa.array(n, pa.int32())], schema=schema)

    return sets.select("key", F.col("n_shingles").cast("int").alias("n"), "first").mapInArrow(run, "t long, key long, n int")


def peeled(hits: DataFrame) -> DataFrame:
    """Hits (t, key, n, part) without shingles that lead to no other part, and points with too few shingles left."""
    mixed = hits.groupBy("t").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("t")
    left = hits.join(mixed, "t")
    strong = left.groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter(F.col("c") >= need(F.col("n"))).select("key")
    return written(left.join(strong, "key").select("t", "key", "n", "part"), "hits")


def elected(hits: DataFrame, seed: int) -> DataFrame:
    """key, part, cell (the pivot that a shingle of the point elects) and the number of such shingles."""
    rank = F.struct(F.xxhash64(F.lit(seed), "key"), "key", "part")
    pivot = hits.groupBy("t").agg(F.min(rank).alias("lead")).select("t", F.col("lead.key").alias("cell"), F.col("lead.part").alias("cell_part"))
    return hits.join(pivot, "t").groupBy("key", "part", "n", "cell", "cell_part").agg(F.count("*").alias("votes"))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and the whole set of the wanted points (key, doc_id), made from the texts again.

    A bitmap of fixed size tells which documents to read; the rest is settled by the key."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SEEN_BITS))
    seen = bitmap(wanted.select(slot.alias("slot")), SEEN_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(seen))
    schema = pa.schema([("key", pa.int64()), ("members", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in source:
            chosen = batch.column(1).filter(pa.array(bits[batch.column(0).to_numpy()]))
            for at in range(0, len(chosen), 500):
                sets = [found for found in map(shingle_set, chosen.slice(at, 500).to_pylist()) if len(found)]
                if sets:
                    yield arrow_rows([(set_key(found), packed(found)) for found in sets], schema)

    made = docs.select(slot.alias("slot"), "text").mapInArrow(run, "key long, members binary")
    return written(made.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("members").alias("members")), "full-sets")


def in_turn(source: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The sorted rows by their first ``width`` columns, one row in memory at a time."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                yield from zip(*[c.to_pylist() for c in batch.slice(at, 500).columns])

    for where, group in groupby(rows(), key=lambda row: row[:width]):
        yield where, (row[width:] for row in group)


def dealt(members: DataFrame, full: DataFrame) -> DataFrame:
    """cell, chunk and key of (cell, key), in chunks of about LEAF points of a cell."""
    sized = members.join(full.select("key", (F.length("members") / 6).alias("size")), "key")
    loads = sized.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    chunks = F.greatest(F.ceil(F.col("n") / LEAF), F.ceil(F.col("s") / LEAF_SHINGLES)).cast("int")
    loads = loads.select("cell", chunks.alias("chunks"))
    return members.join(loads, "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))


def measured(members: DataFrame, pivots: DataFrame, full: DataFrame) -> DataFrame:
    """cell, key, pivot, both (size of the intersection), size and pivot_size for the points (cell, key)
    and all pivots (cell, pivot) of their cells. A point is sent once, a pivot once for each chunk of its cell."""
    placed = dealt(members, full).select("cell", "chunk", "key")
    lead = placed.select("cell", "chunk").distinct().join(pivots, "cell").select("cell", "chunk", F.lit(0).alias("role"), F.col("pivot").alias("key"))
    both = placed.select("cell", "chunk", F.lit(1).alias("role"), "key").unionByName(lead).join(full, "key")
    schema = pa.schema([(name, pa.int64()) for name in ("cell", "key", "pivot", "both", "size", "pivot_size")])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (cell, _), rows in in_turn(source, 2):
            leads: list[tuple[int, np.ndarray]] = []
            for role, key, raw in rows:
                found = unpacked(raw)
                if role == 0:
                    leads.append((key, found))
                    continue
                for pivot, other in leads:
                    if pivot != key:
                        same = len(np.intersect1d(found, other, assume_unique=True))
                        out.append((cell, key, pivot, same, len(found), len(other)))
            if len(out) > 10_000:
                yield arrow_rows(out, schema)
                out = []
        if out:
            yield arrow_rows(out, schema)

    placed = both.select("cell", "chunk", "role", "key", "members").repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "role")
    return written(placed.mapInArrow(run, "cell long, key long, pivot long, both long, size long, pivot_size long"), "measured")


def linked(both: Column, size: Column, other: Column) -> Column:
    return 100 * both >= PERCENT * (size + other - both)


def star_links(found: DataFrame) -> DataFrame:
    near = found.filter(linked(F.col("both"), F.col("size"), F.col("pivot_size")))
    return near.select(F.col("key").alias("a"), F.col("pivot").alias("b"))


def joined(keys: list[int], parts: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the components (``parts``) of some sets: every pair of different components is compared
    until it is one."""
    order = {part: at for at, part in enumerate(dict.fromkeys(parts))}
    root = list(range(len(order)))

    def top(at: int) -> int:
        while root[at] != at:
            root[at] = root[root[at]]
            at = root[at]
        return at

    if len(order) < 2:
        return []
    mine = np.array([order[part] for part in parts])
    sizes = np.array([len(found) for found in sets])
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(shingle, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[by]
    start = np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    ends = np.cumsum(sizes)
    out = []
    for at in range(len(sets)):
        own = shingle[ends[at] - sizes[at] : ends[at]]
        count, first = start[own + 1] - start[own], start[own]
        # The holders of all its shingles, one after another.
        place = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        same = np.bincount(holder[place], minlength=len(sets))
        near = np.flatnonzero((100 * same >= PERCENT * (sizes[at] + sizes - same)) & (mine != mine[at]))
        for other in near:
            a, b = top(int(mine[at])), top(int(mine[other]))
            if a != b:
                root[a] = b
                out.append((keys[at], keys[int(other)]))
    return out


def leaf_links(leaves: DataFrame, full: DataFrame) -> DataFrame:
    """Links between the components of each leaf (cell, block, key, part)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in in_turn(source, 2):
            keys, parts, raw = zip(*rows)
            out = joined(list(keys), list(parts), [unpacked(one) for one in raw])
            if out:
                yield arrow_rows(out, schema)

    rows = leaves.join(full, "key").select("cell", "block", "key", "part", "members")
    return rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "key").mapInArrow(run, "a long, b long")


def worth_joining(cells: DataFrame) -> DataFrame:
    """Cells (cell, key, part, size) that hold several components, with ``large``."""
    totals = cells.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"), F.sum("size").alias("s"))
    large = (F.col("n") > LEAF) | (F.col("s") > LEAF_SHINGLES)
    return cells.join(totals.filter("low < high").select("cell", large.alias("large")), "cell")


def regions(found: DataFrame) -> DataFrame:
    """cell, key and pivot of the Voronoi regions of measured points, boundary copies included."""
    far = 1 - F.col("both") / (F.col("size") + F.col("pivot_size") - F.col("both"))
    home = F.min("far").alias("home")
    near = found.select("cell", "key", "pivot", far.alias("far"))
    near = near.join(near.groupBy("cell", "key").agg(home), ["cell", "key"])
    margin = 1e-9
    inside = near.filter((F.col("home") < 1 - EDGE - margin) & (F.col("far") <= F.col("home") + 2 * EDGE + margin))
    outside = near.filter(F.col("home") >= 1 - 2 * EDGE - margin).select("cell", "key", F.lit(FAR).cast("long").alias("pivot")).distinct()
    return inside.select("cell", "key", "pivot").unionByName(outside)


def region_links(cells: DataFrame, full: DataFrame) -> DataFrame:
    """Links between the components of all cells (cell, key, part)."""
    sizes = full.select("key", (F.length("members") / 6).cast("long").alias("size"))
    now = written(worth_joining(cells.join(sizes, "key")), "cells")
    links = []
    for depth in range(DEPTH + 1):
        small = now.filter(~F.col("large"))
        links.append(leaf_links(small.withColumn("block", F.lit(0)), full))
        if not now.filter("large").take(1):
            break
        large = now.filter("large").select("cell", "key", "part", "size")
        if depth == DEPTH:
            links.append(leaf_links(blocks(large, full), full))
            break
        rank = F.struct(F.xxhash64(F.lit(depth), "key"), "key")
        # A few points of each cell by a hash; the aggregate keeps no more than PIVOTS of them in each of its buffers.
        drawn = reduce(DataFrame.unionByName, [
            large.filter(F.pmod(F.xxhash64(F.lit(7 + depth), "key"), F.lit(PIVOTS)) == at).groupBy("cell").agg(F.min(rank)["key"].alias("pivot"))
            for at in range(PIVOTS)
        ])
        pivots = written(drawn, "pivots")
        found = measured(large.select("cell", "key"), pivots, full)
        links.append(star_links(found))
        # A pivot is a point of its own region at distance 0.
        own = pivots.select("cell", F.col("pivot").alias("key"), "pivot").distinct()
        split = written(regions(found).unionByName(own).distinct(), "split")
        # A cell in which most points lie within the windows of most pivots is not worth splitting.
        before = large.groupBy("cell").agg(F.count("*").alias("n"))
        dense = split.groupBy("cell").agg(F.count("*").alias("copies")).join(before, "cell").filter(F.col("copies") > COPIES * F.col("n")).select("cell")
        dense = written(dense, "dense")
        links.append(leaf_links(blocks(large.join(dense, "cell"), full), full))
        split = split.join(dense, "cell", "left_anti").join(large, ["cell", "key"])
        split = split.select(F.xxhash64(F.lit(depth), "cell", "pivot").alias("cell"), "key", "part", "size")
        now = written(worth_joining(split), "cells")
    return written(reduce(DataFrame.unionByName, links), "region-links")


def blocks(large: DataFrame, full: DataFrame) -> DataFrame:
    """Leaves (cell, block, key, part) in which any two points of a cell meet, two chunks at a time."""
    placed = dealt(large.select("cell", "key"), full).join(large.select("cell", "key", "part"), ["cell", "key"])
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    return placed.select("cell", "key", "part", "chunk", others).select(
        "cell", "key", "part", (F.xxhash64(low, high)).alias("block"))


def similar_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets) and component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(signatures(docs, often_seen(docs)), "jaccard-rows")
    member = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id")
    points = rows.filter("key is not null").groupBy("key", "n_shingles").agg(F.first("first").alias("first"))
    entries = first_shingles(points)
    shared = entries.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1").select("t")
    hits = written(entries.join(shared, "t").withColumn("part", F.col("key")), "hits")
    hits = peeled(peeled(hits))
    owners = rows.filter("key is not null").groupBy("key").agg(F.min(member)["doc_id"].alias("doc_id"))
    full = full_sets(docs, written(hits.select("key").distinct().join(owners, "key"), "wanted"))

    links = [docs.sparkSession.createDataFrame([], "a long, b long")]
    for turn in range(ROUNDS):
        if not hits.take(1):
            break
        votes = elected(hits, turn).filter("part <> cell_part")
        home = votes.groupBy("key").agg(F.max(F.struct("votes", "cell"))["cell"].alias("cell"))
        found = measured(home, home.select("cell").distinct().withColumn("pivot", F.col("cell")), full)
        links.append(star_links(found))
        parts = components(reduce(DataFrame.unionByName, links)).select(F.col("node").alias("key"), F.col("component").alias("part"))
        hits = hits.drop("part").join(parts, "key", "left").select("t", "key", "n", F.coalesce("part", "key").alias("part"))
        hits = peeled(peeled(hits))
    if hits.take(1):
        links.append(region_links(elected(hits, ROUNDS).select("cell", "key", "part"), full))
    groups = components(reduce(DataFrame.unionByName, links))
    named = owners.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min(member)["doc_id"].alias("component_id"))
    of_set = named.select("key", "component").join(least, "component").select("key", "component_id")
    out = rows.select("doc_id", "n_shingles", "key").join(of_set, "key", "left")
    return out.select(
        "doc_id", "n_shingles", F.col("key").alias("set_key"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM words WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * pairs.n >= 85 * (p.n + q.n - pairs.n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, s.b FROM reach r JOIN sides s ON s.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM words w LEFT JOIN sizes USING (doc_id) JOIN least ON least.doc_id = w.doc_id
"""
