"""Candidate regions for exact matching of long substrings, by winnowed anchors.

A run of ``length`` symbols that occurs twice holds, in both places, the same
smallest short hash of its inside: its anchor. Anchors seen once are dropped. The
home of an anchor is the smallest document that has it, so all copies of a run
share a home, and the text around their anchors can be compared there and
nowhere else. A home with much text is spread over salts; its own text goes
to each of them, and what a salt cannot decide alone comes back as hashed
windows ("open" rows) that are settled by one aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import batches, text_rows

NULL_DOC = -(2**63)
SPANS = pa.schema([
    ("home", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("d", pa.int64()), ("key", pa.int64()),
    ("start", pa.int64()), ("symbols", pa.binary()),
])
SPANS_SQL = "home long, salt int, salts int, d long, key long, start long, symbols binary"
FOUND = pa.schema([
    ("d", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("high", pa.int64()), ("low", pa.int64()),
])
FOUND_SQL = "d long, key long, start long, stop long, high long, low long"


def row_key(text: bytes) -> int:
    """Tells texts under one doc_id apart."""
    return xxhash.xxh3_64_intdigest(text) - 2**63


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, in log(width) passes."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest hash of some ``width`` neighbours."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    least = sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == hashes)


def anchors(docs: DataFrame, hashes_of: Callable[[bytes], np.ndarray], width: int) -> DataFrame:
    """h, d, p: the anchors of every text."""
    schema = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("p", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(source):
            at, found, owner = [], [], []
            for doc_id, text in zip(ids, texts):
                hashes = hashes_of(text.encode())
                chosen = winnow(hashes, width)
                if len(chosen):
                    at.append(chosen)
                    found.append(hashes[chosen])
                    owner.append(np.full(len(chosen), doc_id, np.int64))
            if at:
                columns = [np.concatenate(found).view(np.int64), np.concatenate(owner), np.concatenate(at)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return docs.mapInArrow(run, "h long, d long, p long")


def live_anchors(found: DataFrame, per_task: int) -> DataFrame:
    """d and its anchors that occur at least twice: position, home and number of salts of the home.

    ``per_task``: live anchors of one home that one task handles."""
    # Stored, as it is read twice and made from all texts.
    twice = written(found.groupBy("h").agg(F.count("*").alias("n"), F.min("d").alias("home")).filter("n > 1"), "live-anchors")
    load = twice.groupBy("home").agg(F.ceil(F.sum("n") / per_task).cast("int").alias("salts"))
    homes = twice.join(load, "home").select("h", "home", "salts")
    hits = found.join(homes, "h").groupBy("d")
    return hits.agg(F.collect_list(F.struct("p", "home", "salts")).alias("hits"))


def keyed(docs: DataFrame) -> DataFrame:
    """d (never null) and text of every row."""
    return text_rows(docs).select(F.coalesce("doc_id", F.lit(NULL_DOC)).alias("d"), "text")


def packed(docs: DataFrame) -> DataFrame:
    """d and the compressed text: half of what the shuffle's own codec makes of short texts."""
    schema = pa.schema([("d", pa.int64()), ("packed", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=5)
        for ids, texts in batches(source):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([codec.compress(t.encode()) for t in texts], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "d long, packed binary")


def spans(
    docs: DataFrame, live: DataFrame, split: Callable[[bytes], tuple[int, Callable[[int, int], bytes]]], length: int, inner: int,
) -> DataFrame:
    """The text around live anchors, addressed to their homes. ``split`` gives a text's size and a slicer."""
    before = length - inner

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in source:
            for at in range(0, batch.num_rows, 200):
                rows = []
                part = batch.slice(at, 200)
                for d, text, hits in zip(*(part.column(i) for i in range(3))):
                    d, raw = d.as_py(), codec.decompress(text.as_py())
                    size, cut = split(raw)
                    key = row_key(raw)
                    items = hits.values
                    p, home, salts = (items.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    order = np.lexsort((p, home))
                    p, home, salts = p[order], home[order], salts[order]
                    low, high = np.maximum(p - before, 0), np.minimum(p + length, size)
                    # A new span begins where the home changes or a gap opens.
                    new = np.concatenate([[True], (home[1:] != home[:-1]) | (low[1:] > high[:-1])])
                    first = np.flatnonzero(new)
                    last = np.concatenate([first[1:], [len(p)]]) - 1
                    for a, b in zip(first, last):
                        start, stop = int(low[a]), int(high[b])
                        if stop - start < length:
                            continue
                        n, own = int(salts[a]), int(home[a]) == d
                        piece = cut(start, stop)
                        for salt in range(n) if own else [(key ^ d) % n]:
                            rows.append((int(home[a]), salt, n, d, key, start, piece))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SPANS)], schema=SPANS)

    return packed(docs).join(live, "d").select("d", "packed", "hits").mapInArrow(run, SPANS_SQL)


def by_home(addressed: DataFrame, handle: Callable[[Iterator[list[tuple]]], Iterator[tuple]]) -> DataFrame:
    """Runs ``handle`` over the spans of each home and salt, in order of place. It yields rows of FOUND."""
    sorted_spans = addressed.repartition("home", "salt").sortWithinPartitions("home", "salt", "d", "key", "start")

    def groups(source: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        now, group, seen = None, [], None
        for batch in source:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for row in zip(*columns):
                if row[:2] != now:
                    if group:
                        yield group
                    now, group, seen = row[:2], [], None
                if row[3:6] != seen:  # a repeated row is the same document again
                    group.append(row)
                    seen = row[3:6]
        if group:
            yield group

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in handle(groups(source)):
            rows.append(row)
            if len(rows) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)

    return sorted_spans.mapInArrow(run, FOUND_SQL)


def window_digest(window: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(window, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def settled(found: DataFrame, every: bool) -> DataFrame:
    """d, key and their repeated runs. Open windows repeat if another place has them
    (``every``: whichever comes first; else only the later places)."""
    place = F.struct("d", "key", "start") if every else F.struct("d", "start")
    opened = found.filter("high is not null")
    ends = opened.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    hit = opened.join(ends, ["high", "low"]).filter(F.lit(every) | (place > F.col("first")))
    runs = found.filter("high is null").select("d", "key", "start", "stop").unionByName(hit.select("d", "key", "start", "stop"))
    return runs.groupBy("d", "key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def cut_rows(docs: DataFrame, runs: DataFrame, cut: Callable[[bytes, list[tuple[int, int]]], tuple], schema: pa.Schema, kinds: str) -> DataFrame:
    """Every row of the documents, cut by its runs. Documents are read again rather than carried along."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for d, text, found in zip(*(part.column(i) for i in range(3))):
                    raw, d = codec.decompress(text.as_py()), d.as_py()
                    key, spans_found = row_key(raw), []
                    if found.is_valid:
                        for one in found.as_py():
                            if one["key"] == key:
                                spans_found = joined([(r["start"], r["stop"]) for r in one["runs"]])
                    rows.append((None if d == NULL_DOC else d, *cut(raw, spans_found)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    of_doc = runs.groupBy("d").agg(F.collect_list(F.struct("key", "runs")).alias("found"))
    return packed(docs).join(of_doc, "d", "left").select("d", "packed", "found").mapInArrow(run, kinds)


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs with those that touch or overlap made one."""
    out: list[list[int]] = []
    for start, stop in runs:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def repeated_runs(
    docs: DataFrame, hashes_of: Callable[[bytes], np.ndarray], split: Callable, length: int, inner: int,
    handle: Callable[[Iterator[list[tuple]]], Iterator[tuple]], every: bool, name: str, per_task: int,
) -> DataFrame:
    """All steps: anchors, homes, spans, ``handle`` at each home, open windows settled."""
    rows = keyed(docs)
    live = live_anchors(anchors(rows, hashes_of, length - inner + 1), per_task)
    return settled(written(by_home(spans(rows, live, split, length, inner), handle), name), every)

