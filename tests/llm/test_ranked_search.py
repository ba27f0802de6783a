"""Ranked search against brute force and SQL, with odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from logsieve.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item_id string, rank int, score string, n int, ids string"
ITEMS = "item_id long, text string, doc_id string, width int"


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(FOLD))


def brute(rows, items) -> dict:
    found = [(i, Counter(terms(t))) for i, t in rows]
    found = [(i, c) for i, c in found if c]
    n, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(term for _, c in found for term in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, at, None if unknown else i, -score) for at, (score, unknown, i) in enumerate(sorted(scored)[:10], 1)]
    return sorted(out, key=str)


def corpus() -> tuple[list, list]:
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["Étude", "ÉTUDE", "x1", "日本", "naïve", "THE", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, ", ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 90, 400])))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, " ..\x00!? "), (503, "w300 " * 5000 + "w7"), (504, "w5-w6/w399"), (505, " ".join(words * 3))]
    rows += [rows[5], rows[5], rows[6], (None, rows[7][1]), (None, rows[8][1]), (7, "w399 w398 other")]
    rows += [(600 + i, "twin words here w1") for i in range(30)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 30])))) for i in range(25)]
    items += [(100, None), (101, "nothing of this unseen"), (102, "twin twin HERE"), (None, "w3 w399"), (None, "w12"), (3, "w77 w78"), items[4], (103, "  ")]
    return rows, items


@pytest.mark.parametrize(("block", "at_once"), [(1024, 20_000), (7, 40)])
def test_search_equals_brute_force(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked_search, "TERMS_AT_ONCE", at_once)
    rows, items = corpus()
    docs = spark.createDataFrame([(*row, "a", 1, "b", 2, "c") for row in rows], DOCS).repartition(3)
    asked = spark.createDataFrame([(*item, "z", 5) for item in items], ITEMS)
    found = ranked_search.ranked_search(docs, asked).collect()
    assert sorted((tuple(row) for row in found), key=str) == brute(rows, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some, one = spark.createDataFrame([(1, "a b", "", 1, "", 1, "")], DOCS), spark.createDataFrame([(1, "a", "", 1)], ITEMS)
    assert ranked_search.ranked_search(docs, one).collect() == []
    assert ranked_search.ranked_search(some, items).collect() == []
    assert len(ranked_search.ranked_search(some, one).collect()) == 1


def test_bounds_are_never_below_the_score():
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)], k=rng.choice([2, 30, 300]))).encode() for _ in range(200)]
    counts = [Counter(text.split()) for text in texts]
    block = ranked_search.Block(2048)  # narrow, so that most shown terms are false
    known: dict = {}
    for number, (text, count) in enumerate(zip(texts, counts)):
        block.add(number, text, count, known)
    names = sorted({term for count in counts for term in count})
    searcher = ranked_search.Searcher(names, list(range(len(names))), [list(range(0, len(names), 2)), [3], [5, 9]], 200, 9000)
    width, n, _, ids, lengths, most, packed, *_ = block.row()
    m = np.array([10 + 90 * size * 200 // 9000 for size in lengths], np.int64)
    import zstandard

    slices = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(width, -1)
    bound = searcher.bounds(width, slices, m, np.array(most, np.int64))
    for number, item in enumerate(searcher.items):
        for at in range(n):
            score = sum(searcher.exact(texts[at], int(m[at])).get(int(term), 0) for term in item)
            assert score <= bound[number, at] * (1 + 1e-9) + 1


def test_search_equals_sql(spark, folder):
    from logsieve.llm.queries import ORACLES, QUERIES

    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    theirs = connection.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op13_ranked_search']})").fetchall()
    mine = QUERIES["op13_ranked_search"](spark, folder).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, mine)) == sorted(theirs)
