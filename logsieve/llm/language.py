"""Language of whole texts by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte runs of two to five
bytes inside words, and a linear softmax over that average gives the language. Both
parts are learned in numpy by stochastic gradient descent on a bounded sample of
labelled rows. The scores are calibrated by a temperature fitted on rows that the
descent has not seen, and texts whose score is below a threshold fitted there are
marked as rejected. Every language of the table is learned; the rows of the sample are
whole texts, turned into counts of their buckets where they lie, so that at most
``BUCKETS`` numbers a row come to the driver.

Defined cases: texts that are null or have no letter are ``und`` with score 0; rows
without a language are predicted but never learned from; if no row can be learned
from, every text is ``und``; repeated rows are predicted row by row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import batches, mix

# Learned from at most so many rows of each language, and from so many in all unless there are more languages.
SAMPLE_PER_LANGUAGE = 1000
SAMPLE_ROWS = 100_000
BUCKETS = 1 << 16
DIMENSIONS = 16
RUNS = (2, 3, 4, 5)
EPOCHS = 6
BATCH = 32
RATE = 0.5
REJECT_SHARE = 0.01  # of right answers among the calibration rows that may be rejected
CHUNK = 1 << 20

LETTER = re.compile(r"[^\W\d_]")
# Bytes that end a word: all of ASCII but letters.
BREAK = np.ones(256, bool)
BREAK[np.r_[65:91, 97:123, 128:256]] = False
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # for each bucket its embedding, or its share of the scores where languages are few
    head: np.ndarray | None  # softmax weights, unless the table holds scores
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(raw: bytes) -> np.ndarray:
    """Buckets of all byte runs that do not cross a word's end."""
    data = np.frombuffer(raw, np.uint8)
    stops = BREAK[data]
    symbols = LOWER[data]
    out, key, clean = [], symbols, ~stops
    for n in range(2, max(RUNS) + 1):
        if len(data) < n:
            break
        with np.errstate(over="ignore"):
            key = key[: len(data) - n + 1] * np.uint64(257) + symbols[n - 1 :]
        clean = clean[: len(data) - n + 1] & ~stops[n - 1 :]
        if n in RUNS:
            out.append(mix(key[clean] + np.uint64(n << 56)))
    found = np.concatenate(out) if out else np.empty(0, np.uint64)
    return (found & np.uint64(BUCKETS - 1)).astype(np.int64)


def softmax(scores: np.ndarray) -> np.ndarray:
    high = np.exp(scores - scores.max(-1, keepdims=True))
    return high / high.sum(-1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]


def bag(text: str) -> Bag:
    """The buckets of a whole text and how often each occurs; very long texts in steps that share their last bytes."""
    raw = text.encode()
    if len(raw) <= CHUNK:
        return np.unique(subwords(raw), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for part in steps(raw):
        total += np.bincount(part, minlength=BUCKETS)
    return np.flatnonzero(total), total[total > 0]


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model | None:
    return train_bags([bag(text) for text in texts], labels, seed)


def train_bags(bags: list[Bag], labels: list[str], seed: int = 7) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    rows = [i for i in range(len(bags)) if len(bags[i][0])]
    if not rows:
        return None
    number = {name: at for at, name in enumerate(languages)}
    target = np.array([number[label] for label in labels])
    order = rng.permutation(rows)
    held = order[: len(order) // 5]
    learn = order[len(held) :]
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)

    def average(i: int) -> np.ndarray:
        buckets, counts = bags[i]
        return counts @ embedding[buckets] / counts.sum()

    seen, total = 0, max(1, EPOCHS * len(learn))
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            part = learn[at : at + BATCH]
            rate = RATE * (1 - seen / total)
            seen += len(part)
            inner = np.stack([average(i) for i in part])
            error = softmax(inner @ weights + bias)
            error[np.arange(len(part)), target[part]] -= 1
            back = error @ weights.T
            weights -= rate * inner.T @ error / len(part) * 4
            bias -= rate * error.mean(0)
            for i, slope in zip(part, back):
                buckets, counts = bags[i]
                embedding[buckets] -= (rate * 10 * counts[:, None] / counts.sum()).astype(np.float32) * slope
    few = len(languages) <= DIMENSIONS
    table, head = ((embedding @ weights).astype(np.float32), None) if few else (embedding, weights)
    model = Model(languages, table, head, bias, 1.0, 0.0)
    if len(held):
        inner = np.stack([bags[i][1] @ table[bags[i][0]] / bags[i][1].sum() for i in held])
        logits = (inner if few else inner @ weights) + bias
        truth = target[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(20), 60))
        losses = [-np.mean(np.log(softmax(logits / t)[np.arange(len(held)), truth] + 1e-12)) for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
        sure = softmax(logits / model.temperature)
        right = sure.argmax(1) == truth
        if right.any():
            model.threshold = float(np.quantile(sure.max(1)[right], REJECT_SHARE))
    return model


def steps(raw: bytes) -> Iterator[np.ndarray]:
    """The buckets of a text, a bounded number of bytes at a time; every run of bytes is met once or, at a seam, twice."""
    for at in range(0, max(len(raw), 1), CHUNK):
        yield subwords(raw[at : at + CHUNK + max(RUNS) - 1])


def predict(model: Model | None, text: str | None) -> tuple[str, float, bool]:
    """Language, calibrated score, and whether the score is too low to be trusted."""
    if model is None or text is None or not LETTER.search(text):
        return "und", 0.0, True
    raw = text.encode()
    total, count = np.zeros(model.table.shape[1]), 0
    for found in steps(raw):
        for j in range(len(total)):
            total[j] += model.table[:, j][found].sum(dtype=np.float64)
        count += len(found)
    inner = total / max(count, 1)
    scores = softmax(((inner if model.head is None else inner @ model.head) + model.bias) / model.temperature)
    best = int(scores.argmax())
    return model.languages[best], float(scores[best]), bool(scores[best] < model.threshold)


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0)


def labelled_sample(docs: DataFrame) -> DataFrame:
    """lang, h and text of a bounded sample of rows of every language, chosen by a hash of the row: the same in every run."""
    rows = held_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")))
    rows = rows.filter("not held_out and lang is not null and text is not null")
    counts = written(rows.groupBy("lang").count(), "languages")
    wanted = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // max(1, counts.count())))
    # The share that gives the wanted number, and a little more, so that the last hash itself decides.
    share = counts.select("lang", F.least(F.lit(1.0), 1.3 * wanted / F.col("count") + 50 / F.col("count")).alias("share"))
    hashed = rows.withColumn("h", F.xxhash64(F.lit(11), "doc_id", "text"))
    near = hashed.join(share, "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    best = F.slice(F.array_sort(F.collect_set("h")), 1, wanted)
    last = near.groupBy("lang").agg(F.element_at(best, -1).alias("last"))
    # Rows with the same id and text are learned from once.
    chosen = near.join(last, "lang").filter("h <= last").select("lang", "h", "text")
    return chosen.dropDuplicates(["lang", "h"])


def sample_bags(sample: DataFrame) -> DataFrame:
    """lang, h, buckets and counts of the sampled rows, counted where the texts lie."""
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            langs, hashes, texts = (column.to_pylist() for column in batch.columns)
            for lang, h, text in zip(langs, hashes, texts):
                buckets, counts = bag(text)
                row = [[lang], [h], [buckets.astype(np.int32).tobytes()], [counts.astype(np.float32).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

    return sample.select("lang", "h", "text").mapInArrow(run, "lang string, h long, buckets binary, counts binary")


def fit(docs: DataFrame) -> Model | None:
    rows = sample_bags(labelled_sample(docs)).collect()  # bounded by SAMPLE_ROWS and the languages
    rows.sort(key=lambda row: (row["lang"], row["h"]))
    bags = [(np.frombuffer(row["buckets"], np.int32), np.frombuffer(row["counts"], np.float32)) for row in rows]
    return train_bags(bags, [row["lang"] for row in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of DIMENSIONS numbers at most, and DIMENSIONS for each language
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(source):
            rows = [predict(shared.value, text) for text in texts]
            columns = [ids, *zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return held_out(found).select("doc_id", "held_out", "lang_pred", "score", "rejected")
