"""What the corpus operators share: table access, word and hash helpers, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as a Java class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """Only the key and the text, so that other columns of any name cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def words_of(text: Column) -> Column:
    """The words of a text as an array, in order; built-in functions only."""
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda word: word != "")


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finisher)."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64, copy=True)
        v ^= v >> np.uint64(30)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(27)
        v *= np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(31)
    return v


class WordHasher:
    """64-bit hashes of words, remembered up to a bounded number of distinct words."""

    def __init__(self, limit: int = 300_000) -> None:
        import xxhash

        self._hash, self._limit, self._seen = xxhash.xxh3_64_intdigest, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self._seen
        if len(seen) > self._limit:
            seen.clear()
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            digest = self._hash
            for word in words:
                if word not in seen:
                    seen[word] = digest(word)
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive elements."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= ODD
            out += hashes[i : i + n]
    return mix(out)


def batches(source: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in small steps, so that long texts do not pile up."""
    for batch in source:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
