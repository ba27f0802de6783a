"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its five-word shingles. Equal sets are one node of the graph. Every
tree starts by putting a node's set under one of its minwise tokens, so two sets of
similarity s share that place with probability s; ``TREES`` independent trees
leave a pair at the threshold unseen with probability 0.25 ** TREES. Places with few sets
are compared exhaustively by sketches. A place with many sets first lets go of
those that resemble its leader (they point to it and need no other partner of that kind), and
branches on further chosen tokens if any are left. Sets that were let go but turn out to be in
another component than their leader are compared with the whole place later.

Links come in two rounds. First every set points to the similar set of smallest rank, one
link for each set, so a group of copies becomes a star and not a clique. The links
are confirmed on full sets, and components are formed. Then the sets that resemble a set of another
component by sketch go to their leaves once more, as full sets, are compared there, and the links that
join components come out: fewer than there are sets.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; a null
doc_id counts as larger than any other; rows with equal doc_id are documents of their own;
an empty table gives no rows; other columns are ignored.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import WordHasher, batches, mix, rolled
from .components import components

SHINGLE = 5
PERCENT = 75
TREES = 10
TOKENS = 20
DEPTH = 3
BRANCHES = 2
SMALL = 8000
BINS = 128
NEAR = 0.58  # a sketch this close may belong to a pair at the threshold (4.5 standard deviations)
SURE = 0.82
CHUNK = 20_000
SMALL_TABLE = 2_000_000  # rows of two numbers that are broadcast at most

_hashers: list[WordHasher] = []
_SEEDS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not _hashers:
        _hashers.append(WordHasher())
    words = _hashers[0]((text or "").encode().lower().split())
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(rolled(words, min(SHINGLE, len(words))) ^ np.uint64(min(SHINGLE, len(words))))


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def tokens_of(found: np.ndarray) -> np.ndarray:
    """One minwise token for each of the independent hash functions."""
    with np.errstate(over="ignore"):
        return np.array([((found ^ seed) * (seed | np.uint64(1))).min() for seed in _SEEDS], np.uint64)


def sketch_of(found: np.ndarray) -> bytes:
    """The smallest hash in each of BINS bins, as a byte; 0 for an empty bin."""
    bins = (found & np.uint64(BINS - 1)).astype(np.int64)  # ``found`` is sorted by its high bits
    used, first = np.unique(bins, return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[used] = (mix(found[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def likeness(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of one sketch to each of many."""
    used = (one | many) > 0
    return ((one == many) & used).sum(1) / np.maximum(used.sum(1), 1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, id (key of the set), tokens and sketch of every row."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("id", pa.int64()), ("tokens", pa.list_(pa.int64())),
        ("sketch", pa.binary()),
    ])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for doc_id, text, key in zip(*[column.to_pylist() for column in batch.columns]):
                found = shingles(text)
                some = len(found) > 0
                rows.append((
                    doc_id, key, len(found), set_key(found) if some else None, tokens_of(found).view(np.int64) if some else None,
                    sketch_of(found) if some else None,
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, id long, tokens array<long>, sketch binary")


def text_key(column: str):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def rank_of(column: str):
    """A fixed random order of sets, the same everywhere."""
    return F.xxhash64(F.lit(77), column)


def alike(a: str, b: str):
    """The likeness of two sketch columns, in batches."""
    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        left, right = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), BINS) for s in (x, y))
        used = (left | right) > 0
        return pd.Series(((left == right) & used).sum(1) / np.maximum(used.sum(1), 1))

    return compare(a, b)


def sized(level: DataFrame) -> DataFrame:
    """place, n and n_open of the places in which anything is left to compare."""
    sizes = level.groupBy("place").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"))
    return written(sizes.filter("n > 1 and n_open > 0"), "places")


def small() -> Column:
    """Few enough pairs of an open set and any other to compare them all."""
    return (F.col("n") <= SMALL) | (F.col("n") * F.col("n_open") <= SMALL * SMALL)


def absorb(large: DataFrame, sets: DataFrame) -> DataFrame:
    """place, id, open, leader and score: sets that resemble the leader of their place are closed."""
    lead = large.groupBy("place").agg(F.min(F.struct(rank_of("id").alias("rank"), "id")).alias("lead"))
    lead = lead.select("place", F.col("lead.id").alias("leader")).join(
        sets.select(F.col("id").alias("leader"), F.col("sketch").alias("lead_sketch")), "leader")
    full = large.join(sets.select("id", "sketch"), "id").join(lead, "place")
    scored = full.select("place", "id", "open", "leader", alike("sketch", "lead_sketch").alias("score"))
    # The leader needs no partner of its own: whatever resembles it points to it.
    still = F.col("open") & (F.col("score") < SURE) & (F.col("id") != F.col("leader"))
    return written(scored.withColumn("still", still), "led")


def grow_trees(sets: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """leaves (place, chunk, id, open, whole, sketch) to compare, pointers (id, rank, other, score) made on the way,
    and the large places (place, id, open, leader, score) of each level.

    ``open`` tells the sets that still need partners from those that only serve as such."""
    first = F.explode(F.array(*[
        F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.get("tokens", F.lit(t))).alias("place")) for t in range(TREES)
    ])).alias("at")
    level = sets.select("id", first).select("id", "at.place", F.lit(True).alias("open"))
    leaves, pointers, large = [], [], []
    for depth in range(DEPTH):
        sizes = sized(level)
        # A place of the first level that is a leaf holds all its sets, open and in one chunk: it is whole.
        whole = F.lit(depth == 0) & (F.col("n") <= CHUNK)
        leaves.append(level.join(sizes.filter(small()), "place").select("place", "n", "id", "open", whole.alias("whole")))
        if not sizes.filter(~small()).take(1):
            break
        led = absorb(level.join(sizes.filter(~small()).select("place"), "place"), sets)
        large.append(led)
        caught = led.filter((F.col("score") >= SURE) & (F.col("id") != F.col("leader")))
        pointers.append(caught.select("id", rank_of("leader").alias("rank"), F.col("leader").alias("other"), "score"))
        level = led.select("place", "id", F.col("still").alias("open"))
        sizes = sized(level)
        last = depth == DEPTH - 1
        done = F.lit(True) if last else small()
        leaves.append(level.join(sizes.filter(done), "place").select("place", "n", "id", "open", F.lit(False).alias("whole")))
        if last or not sizes.filter(~small()).take(1):
            break
        branch = F.explode(F.array(*[F.lit(b) for b in range(BRANCHES)])).alias("branch")
        wide = level.join(sizes.filter(~small()).select("place"), "place").join(sets.select("id", "tokens"), "id")
        chosen = (TREES + F.pmod(F.xxhash64("place", "branch"), F.lit(TOKENS - TREES))).cast("int")
        level = written(wide.select("place", "id", "open", "tokens", branch).select(
            "id", F.xxhash64("place", "branch", F.get("tokens", chosen)).alias("place"), "open"), "branches")
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    made = sets.sparkSession.createDataFrame([], "id long, rank long, other long, score double")
    for some in pointers:
        made = made.unionByName(some)
    return chunked(found, sets), made, large


def chunked(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Leaves (place, chunk, id, open, whole, sketch) of the places (place, n, id, open, whole)."""
    # Large leaves are compared in chunks; the open sets go to each chunk.
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.array(F.pmod(F.xxhash64(F.lit(5), "id"), parts).cast("int"))
    chunk = F.explode(F.when(F.col("open"), F.sequence(F.lit(0), parts - 1)).otherwise(own))
    return found.withColumn("chunk", chunk).select("place", "chunk", "id", "open", "whole").join(sets.select("id", "sketch"), "id")


def reopened(large: list[DataFrame], parts: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Leaves of the large places that hold sets closed for a leader of another component (id, part); these are
    open, and nothing else is. None if there are no such sets."""
    if not large:
        return None
    led = reduce(DataFrame.unionByName, large)
    caught = led.filter(F.col("open") & (F.col("score") >= SURE) & (F.col("id") != F.col("leader"))).select("place", "id", "leader")
    of_leader = parts.select(F.col("id").alias("leader"), F.col("part").alias("lead_part"))
    caught = caught.join(parts, "id", "left").join(of_leader, "leader", "left")
    apart = F.coalesce("part", "id") != F.coalesce("lead_part", "leader")
    again = written(caught.filter(apart).select("place", "id", F.lit(True).alias("open")), "reopened")
    places = again.select("place").distinct()
    if not places.take(1):
        return None
    members = led.select("place", "id").join(places, "place")
    members = members.join(again, ["place", "id"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    sized_ = members.join(members.groupBy("place").agg(F.count("*").alias("n")), "place")
    return chunked(sized_.withColumn("place", F.xxhash64(F.lit(6), "place")).withColumn("whole", F.lit(False)), sets)


def _leaves(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, list]]:
    """(ids, sketches, open, extra) of each place and chunk in turn."""
    now, rows = None, []

    def packed() -> tuple:
        ids, opens, sketches, *extra = zip(*rows)
        extra = extra[0] if len(extra) == 1 else list(zip(*extra))
        return list(ids), np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BINS), np.array(opens), list(extra)

    for batch in source:
        for place, chunk, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if (place, chunk) != now:
                if len(rows) > 1:
                    yield packed()
                now, rows = (place, chunk), []
            rows.append(row)
    if len(rows) > 1:
        yield packed()


def point(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every open set's similar set of smallest rank; the most similar one if none is surely similar."""
    schema = pa.schema([("id", pa.int64()), ("rank", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])
    for ids, sketches, opens, ranks in _leaves(source):
        order = np.argsort(ranks, kind="stable")
        ids, sketches, opens, rank = np.array(ids)[order], sketches[order], opens[order], np.array(ranks)[order]
        best, score = np.full(len(ids), -1), np.zeros(len(ids))
        waiting = np.arange(len(ids))
        for at in range(len(ids)):  # each set in turn as the partner of those that have none yet
            waiting = waiting[(waiting > at) | ~(score[waiting] >= SURE)]
            mine = waiting if opens[at] else waiting[opens[waiting]]
            if not len(mine):
                if not opens.any() or not len(waiting):
                    break
                continue
            found = likeness(sketches[at], sketches[mine])
            better = (mine != at) & (found >= NEAR) & (found > score[mine])
            best[mine[better]], score[mine[better]] = at, found[better]
            waiting = waiting[score[waiting] < SURE]
        has = np.flatnonzero(best >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[has]), pa.array(rank[best[has]]), pa.array(ids[best[has]]), pa.array(score[has])], schema=schema)


def suspects(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of a leaf that resemble a set of another component there, one row for each, with the leaf.

    Two sets that share several whole places are looked at in the smallest of these only."""
    schema = pa.schema([("place", pa.int64()), ("chunk", pa.int32()), ("id", pa.int64()), ("part", pa.int64())])
    for ids, sketches, opens, extra in _leaves(source):
        parts = np.array([row[0] for row in extra])
        _, place, chunk, _ = extra[0]
        kinds, part = np.unique(parts, return_inverse=True)
        if len(kinds) < 2:
            continue
        # Sets outside the largest component are compared with all later ones.
        largest = np.bincount(part).argmax()
        order = np.argsort(part == largest, kind="stable")
        ids, sketches, opens, part = np.array(ids)[order], sketches[order], opens[order], part[order]
        marked = np.zeros(len(ids), bool)
        places = np.full((len(ids), TREES), place)
        for row, at in enumerate(order):
            held = extra[at][3] or []
            places[row, : len(held)] = held
        for at in range(int((part != largest).sum())):
            later = at + 1 + np.flatnonzero((part[at + 1 :] != part[at]) & (opens[at] | opens[at + 1 :]))
            if len(later):
                close = later[likeness(sketches[at], sketches[later]) >= NEAR]
                for other in np.unique(places[at][places[at] < place]):  # compared there
                    close = close[~(places[close] == other).any(1)]
                marked[close] = True
                marked[at] |= len(close) > 0
        n = int(marked.sum())
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, place)), pa.array(np.full(n, chunk), pa.int32()), pa.array(ids[marked]),
                pa.array(kinds[part[marked]])], schema=schema)


def joined(members: list[np.ndarray], parts: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions that are linked on full sets and join the components (``parts``) of these sets wherever
    a link does; pairs that are joined already are left out, so there are fewer pairs than sets."""
    order = np.argsort([len(one) for one in members], kind="stable")
    sizes = np.array([len(members[i]) for i in order])
    label = parts[order].copy()
    codes = np.unique(np.concatenate([members[i] for i in order]), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    seen = np.zeros(len(codes), bool)
    out = []
    for at in range(len(order) - 1):
        # Sets are in order of size, and a link allows no more than 100 / PERCENT times this one's.
        end = int(np.searchsorted(sizes, sizes[at] * 100 // PERCENT, "right"))
        if end <= at + 1 or (label[at + 1 : end] == label[at]).all():
            continue
        mine = codes[starts[at] : starts[at + 1]]
        seen[mine] = True
        hits = seen[codes[starts[at + 1] : starts[end]]]
        both = np.add.reduceat(hits, starts[at + 1 : end] - starts[at + 1], dtype=np.int64)
        seen[mine] = False
        for other in at + 1 + np.flatnonzero(100 * both >= PERCENT * (sizes[at] + sizes[at + 1 : end] - both)):
            if label[other] != label[at]:
                out.append((int(order[at]), int(order[other])))
                label[label == label[other]] = label[at]
    return out


def settle(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a and b of the links that join components of a leaf, from rows (place, chunk, id, part, members) in order of leaves."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.array([row[0] for row in rows])
        found = joined([_unpacked(row[2]) for row in rows], np.unique([row[1] for row in rows], return_inverse=True)[1])
        if found:
            a, b = ids[np.array(found)].T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    now, rows = None, []
    for batch in source:
        for place, chunk, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if (place, chunk) != now:
                if len(rows) > 1:
                    yield from links(rows)
                now, rows = (place, chunk), []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield from links(rows)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and linked: whether 100 * intersection >= PERCENT * union, on full sets."""
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for one, other in zip(x, y):
            a, b = (_unpacked(raw) for raw in (one, other))
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", linked("x", "y").alias("linked"))


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def linked_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component and component_id of every row.

    ``component`` is null for empty sets; ``component_id`` is the smallest doc_id of the component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(signatures(docs), "signatures")
    member = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id")
    sets = written(rows.filter("id is not null").groupBy("id").agg(
        F.min(member)["doc_id"].alias("doc_id"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "sets")
    leaves, made, large = grow_trees(sets)
    leaves = written(leaves, "leaves")
    grouped = leaves.select("place", "chunk", "id", "open", "sketch", rank_of("id").alias("rank"))
    pointed = grouped.repartition("place", "chunk").sortWithinPartitions("place", "chunk").mapInArrow(
        point, "id long, rank long, other long, score double")
    sure = F.col("score") >= SURE
    # The surely similar set of smallest rank, else the most similar one.
    choice = F.min(F.struct((~sure).alias("c0"), F.when(sure, F.col("rank")).alias("c1"), (-F.col("score")).alias("c2"), "other"))
    chosen = pointed.unionByName(made).groupBy("id").agg(choice["other"].alias("other"))
    first = written(chosen.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "pointers")
    # Whatever is similar to anything has a pointer by now, so no other set is needed below.
    found = first.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(sets.select("id", "doc_id"), "id")
    full = written(full_sets(docs, written(found, "found")), "full-sets")
    links = written(confirmed(first, full), "links")
    groups = components(links.filter("linked").select("a", "b"))
    parts = groups.select(F.col("node").alias("id"), F.col("component").alias("part"))
    again = reopened(large, parts, sets)
    if again is not None:
        leaves = leaves.unionByName(written(again, "leaves-again"))
    held = leaves.filter("whole").groupBy("id").agg(F.collect_list("place").alias("places"))
    labelled = leaves.join(parts, "id", "left").join(held, "id", "left").select(
        "place", "chunk", "id", "open", "sketch", F.coalesce("part", "id").alias("part"), F.col("place").alias("at"), F.col("chunk").alias("of"),
        "places")
    apart = written(labelled.repartition("place", "chunk").sortWithinPartitions("place", "chunk").mapInArrow(
        suspects, "place long, chunk int, id long, part long"), "suspects")
    whole_sets = apart.join(full, "id").select("place", "chunk", "id", "part", "members")
    more = written(whole_sets.repartition("place", "chunk").sortWithinPartitions("place", "chunk").mapInArrow(
        settle, "a long, b long"), "more-links")
    every = links.filter("linked").select("a", "b").unionByName(more)
    whole = components(every)
    named = sets.select("id", "doc_id").join(whole.withColumnRenamed("node", "id"), "id", "left")
    smallest = named.withColumn("component", F.coalesce("component", "id")).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = named.select("id", F.coalesce("component", "id").alias("component")).join(smallest, "component")
    out = rows.select("doc_id", "text_key", "n_shingles", "id").join(of_set.select("id", "component", "component_id"), "id", "left")
    return out.select(
        "doc_id", "text_key", "n_shingles", "component", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias(
            "component_id"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, and kept (doc_id = component_id) of every row."""
    return linked_rows(docs).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the row of smallest doc_id, then of smallest text key.

    Rows that agree in doc_id and text are one document and stay or go together."""
    rows = written(linked_rows(docs).filter("component is not null").select("component", "doc_id", "text_key").distinct(), "linked")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    first = rows.groupBy("component").agg(F.min(place).alias("first"))
    gone = rows.join(first, "component").filter(place != F.col("first")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    same = docs["doc_id"].cast("long").eqNullSafe(gone["d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["k"])
    return docs.join(gone, same, "left_anti")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and full set (six bytes of each hash) of the wanted (id, doc_id), from the texts of those documents."""
    schema = pa.schema([("id", pa.int64()), ("members", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(source):
            rows = []
            for one, text in zip(ids, texts):
                found = shingles(text)
                if len(found) and set_key(found) == one:  # another row may have the same doc_id
                    rows.append((one, np.unique(found >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # The texts stay where they are read as long as the wanted keys are few.
    if wanted.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:
        wanted = F.broadcast(wanted)
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"])
    return docs.join(wanted, same).select(wanted["id"], docs["text"]).mapInArrow(run, "id long, members binary").dropDuplicates(["id"])
