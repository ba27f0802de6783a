"""Ranked lexical search over bit-sliced Bloom signatures.

Documents are written once as blocks. A block holds documents of about equal vocabulary, their
lengths, their packed texts and one bitmap for each bit of their Bloom signatures, in which a
document is one column. A signature holds a document's terms, and for a term that
occurs 2, 4, 8, ... times one more key for each of these levels. The bitmaps of a
term's bits, combined by AND, show every document that has the term, and some that do not;
with the levels they also bound how often it occurs. Sums of the term weights over those bitmaps
give an upper bound of each document's score. Documents are scored exactly, from their whole
text, in order of their bounds, until no document is left whose bound reaches the tenth
best exact score known to the task; ties are not excluded.

Statistics (N, L and the document frequencies of the searched terms) are counted over all
documents while the blocks are written. The items are a stated query set: they are read in
groups of about ``TERMS_AT_ONCE`` terms, and each group runs against all documents.

Defined cases: a null or empty text has no terms; a null doc_id comes after all others among equal
scores; rows that repeat are documents of their own; rows of one item_id are one item with the
terms of all of them, and so are the rows without one; an item without terms, and any item over an
empty table, has no rows; other columns are ignored. A very long text fills a block alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import written

BEST = 10
PROBES = 3
BITS_PER_KEY = 12
BLOCK_DOCS = 1024
BLOCK_CHARS = 4_000_000
TERMS_AT_ONCE = 20_000
CHUNKS = 64  # how many rows a task's counts are dealt over

# Letters and digits of ASCII and all other characters make terms; A-Z is lower-cased.
_FOLD = bytes(
    code + 32 if 65 <= code <= 90 else code if code >= 128 or 48 <= code <= 57 or 97 <= code <= 122 else 32 for code in range(256)
)
BLOCKS = pa.schema([
    ("width", pa.int32()), ("n", pa.int32()), ("total", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("most", pa.list_(pa.int32())), ("slices", pa.binary()), ("texts", pa.list_(pa.binary())), ("part", pa.int32()), ("counts", pa.list_(pa.int64())),
])
BLOCKS_SQL = (
    "width int, n int, total long, ids array<long>, lengths array<long>, most array<int>, slices binary, texts array<binary>, part int, counts array<long>"
)


def terms_of(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode()
    return raw.translate(_FOLD).split()


def halves(term: bytes, level: int) -> tuple[int, int]:
    """Two hashes of a term that occurs at least 2 ** level times."""
    digest = xxhash.xxh3_128_intdigest(term, seed=level)
    return digest & 0xFFFFFFFFFFFFFFFF, (digest >> 64) | 1


def probes(keys: list[tuple[int, int]], width: int) -> np.ndarray:
    """The signature bits of each key: keys x PROBES."""
    pairs = np.array(keys, np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        places = [(pairs[:, 0] + np.uint64(i) * pairs[:, 1]) % np.uint64(width) for i in range(PROBES)]
    return np.stack(places, axis=1).astype(np.int64)


def level_of(times: int) -> int:
    return times.bit_length() - 1


class Block:
    """Documents of one width class that are to be written together."""

    def __init__(self, width: int) -> None:
        self.width, self.ids, self.lengths, self.most, self.texts, self.bits, self.chars = width, [], [], [], [], [], 0

    def add(self, doc_id: int | None, raw: bytes, counts: Counter, known: dict) -> None:
        bits = []
        for term, times in counts.items():
            for level in range(level_of(times) + 1):
                key = (term, level)
                found = known.get(key)
                if found is None:
                    found = known[key] = halves(term, level)
                bits.append(found)
        self.bits.append(np.unique(probes(bits, self.width)))
        self.ids.append(doc_id)
        self.lengths.append(sum(counts.values()))
        self.most.append(max(counts.values()))
        self.texts.append(zstandard.ZstdCompressor(level=3).compress(raw))
        self.chars += len(raw)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.chars >= BLOCK_CHARS

    def row(self) -> tuple:
        n = len(self.ids)
        table = np.zeros((self.width, n), bool)
        table[np.concatenate(self.bits), np.repeat(np.arange(n), [len(b) for b in self.bits])] = True
        slices = zstandard.ZstdCompressor(level=3).compress(np.packbits(table, axis=1).tobytes())
        return self.width, n, sum(self.lengths), self.ids, self.lengths, self.most, slices, self.texts, None, None


def write_blocks(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Blocks of all documents that have a term, and rows with the document frequencies of ``terms``, counted by task."""
    shared = docs.sparkSession.sparkContext.broadcast({term: at for at, term in enumerate(terms)})

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, open_blocks, known = shared.value, {}, {}
        frequency = np.zeros(len(place), np.int64)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOCKS)], schema=BLOCKS)

        for batch in source:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = text.encode().translate(_FOLD)
                    counts = Counter(raw.split())
                    if not counts:
                        continue
                    frequency[[place[term] for term in place.keys() & counts.keys()]] += 1
                    keys = sum(level_of(times) + 1 for times in counts.values())
                    width = max(64, 1 << (BITS_PER_KEY * keys - 1).bit_length())
                    block = open_blocks.setdefault(width, Block(width))
                    if len(known) > 500_000:
                        known.clear()
                    block.add(doc_id, raw, counts, known)
                    if block.full():
                        yield out([open_blocks.pop(width).row()])
        for block in open_blocks.values():
            yield out([block.row()])
        for number, some in enumerate(np.array_split(frequency, CHUNKS)):
            if some.any():
                yield out([(None, 0, 0, None, None, None, None, None, number, some.tolist())])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, BLOCKS_SQL), "blocks")


def statistics(blocks: DataFrame, terms: list[bytes]) -> tuple[int, int, list[int]]:
    """N, L and the document frequency of each term."""
    count, length = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    counted = blocks.filter("part is not null").select("part", F.posexplode("counts").alias("at", "n"))
    sizes = [len(some) for some in np.array_split(np.zeros(len(terms)), CHUNKS)]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    frequency = [0] * len(terms)
    for row in counted.groupBy("part", "at").agg(F.sum("n").alias("n")).collect():  # one row for each searched term
        frequency[int(starts[row["part"]]) + row["at"]] = row["n"]
    return count, length, frequency


def weight(count: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * count + 2) / (2 * frequency + 1)))


def gain(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


class Searcher:
    """Bounds and exact scores of the documents of a block, for all items at once."""

    def __init__(self, terms: list[bytes], weights: list[int], items: list[list[int]], count: int, length: int) -> None:
        self.terms, self.weights, self.items = terms, np.array(weights, np.int64), [np.array(item, np.int64) for item in items]
        self.place = {term: at for at, term in enumerate(terms)}
        self.count, self.length = count, length
        self._keys: dict[tuple[int, int], tuple[int, int]] = {}

    def keys(self, at: int, level: int) -> tuple[int, int]:
        found = self._keys.get((at, level))
        if found is None:
            found = self._keys[(at, level)] = halves(self.terms[at], level)
        return found

    def bounds(self, width: int, slices: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Items x documents: no document's score is higher than this."""
        n = len(m)
        out = np.zeros((len(self.items), n))
        weights, before = self.weights.astype(np.float64), np.zeros(n)
        alive = np.arange(len(self.terms))
        present = None
        for level in range(int(most.max()).bit_length()):
            rows = np.bitwise_and.reduce(slices[probes([self.keys(int(at), level) for at in alive], width)], axis=1)
            if present is not None:
                rows &= present
            some = rows.any(axis=1)
            alive, present = alive[some], rows[some]
            if not len(alive):
                break
            # A document in which a term reaches this level, and not the next, has it fewer than 2 ** (level + 1) times.
            top = gain(np.minimum(2 ** (level + 1) - 1, most.astype(np.int64)), m).astype(np.float64)
            table = np.unpackbits(present, axis=1, count=n).astype(np.float32)
            row_of = np.full(len(self.terms), -1)
            row_of[alive] = np.arange(len(alive))
            for number, item in enumerate(self.items):
                mine = item[row_of[item] >= 0]
                if len(mine):
                    out[number] += (weights[mine] @ table[row_of[mine]]) * (top - before)
            before = top
        return out

    def exact(self, raw: bytes, m: int) -> dict[int, int]:
        """Gain of each searched term of a text, times its weight."""
        counts = Counter(raw.split())
        found = {}
        for term in self.place.keys() & counts.keys() if len(counts) < len(self.place) else [t for t in self.terms if t in counts]:
            at, times = self.place[term], counts[term]
            found[at] = int(self.weights[at]) * ((1_000_000_000 * times) // (1000 * times + 8 * m))
        return found

    def search(self, source: Iterator[tuple]) -> Iterator[tuple[int, int | None, int]]:
        """item number, doc_id and score of the best documents of all blocks of a task."""
        best: list[list[tuple[int, float, int | None]]] = [[] for _ in self.items]  # (score, -doc_id, doc_id), best first
        codec = zstandard.ZstdDecompressor()
        for width, ids, lengths, most, packed, texts in source:
            n = len(ids)
            # Python's integers, as 90 * n * N may pass 64 bits.
            m = np.array([10 + 90 * size * self.count // self.length for size in lengths], np.int64)
            slices = np.frombuffer(codec.decompress(packed), np.uint8).reshape(width, -1)
            bound = self.bounds(width, slices, m, np.array(most, np.int64))
            known: dict[int, dict[int, int]] = {}
            for number, item in enumerate(self.items):
                mine, top = bound[number], best[number]
                # Sums of rounded floats may fall short by a little.
                mine = mine * (1 + 1e-9) + 1
                candidates = np.flatnonzero((mine > 1) & (mine >= (top[-1][0] if len(top) == BEST else 1)))
                for at in candidates[np.argsort(-mine[candidates], kind="stable")]:
                    if len(top) == BEST and mine[at] < top[-1][0]:
                        break
                    if at not in known:
                        known[at] = self.exact(codec.decompress(texts[at]), int(m[at]))
                    score = sum(known[at].get(int(term), 0) for term in item)
                    if score > 0:
                        top.append((score, -math.inf if ids[at] is None else -ids[at], ids[at]))
                        top.sort(key=lambda one: (-one[0], -one[1]))
                        del top[BEST:]
        for number, top in enumerate(best):
            for score, _, doc_id in top:
                yield number, doc_id, score


def search_group(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], blocks: DataFrame, terms: list[bytes]) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents for each of the items."""
    spark = docs.sparkSession
    count, length, frequency = statistics(blocks, terms)
    place = {term: at for at, term in enumerate(terms)}
    searcher = spark.sparkContext.broadcast(Searcher(
        terms, [weight(count, n) for n in frequency], [sorted(place[term] for term in found) for _, found in items], count, length))
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in source:
                for at in range(batch.num_rows):
                    yield tuple(batch.column(i)[at].as_py() for i in range(6))

        rows = list(searcher.value.search(each()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = blocks.filter("width is not null").select("width", "ids", "lengths", "most", "slices", "texts").mapInArrow(
        run, "item int, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)
    names = spark.createDataFrame([(at, item) for at, (item, _) in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def item_groups(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items, in groups of about TERMS_AT_ONCE terms."""
    sizes = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = 1 + sizes // (6 * TERMS_AT_ONCE)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    for number in range(groups):
        mine = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == number)
        found: dict[int | None, set[bytes]] = {}
        for row in mine.collect():  # a stated query set, read in groups of bounded size
            found.setdefault(row["item_id"], set()).update(terms_of(row["text"]))
        ordered = [(item, sorted(terms)) for item, terms in found.items() if terms]
        if ordered:
            yield ordered


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score: the best documents of every item."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in item_groups(items):
        terms = sorted({term for _, found in group for term in found})
        out = out.unionByName(search_group(docs, group, write_blocks(docs, terms), terms))
    return out


SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sums AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM terms WHERE len(terms) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counts AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM terms)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sums GROUP BY term),
scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), sums GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
