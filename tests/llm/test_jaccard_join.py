"""The similarity join against brute force and SQL, with odd rows, boundary pairs and large regions."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from logsieve.llm import jaccard_join

COLUMNS = "doc_id long, text string, key long, n int, part string, cell string, t string"


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(4, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows: list[tuple]) -> list[tuple]:
    found = [(i, shingles(t)) for i, t in rows]
    kinds = sorted({s for _, s in found if s}, key=lambda s: sorted(s))
    root = {s: s for s in kinds}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for at, a in enumerate(kinds):
        for b in kinds[at + 1 :]:
            if 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                if top(a) is not top(b):
                    root[top(a)] = top(b)
    order = lambda i: (i is None, i or 0)
    least: dict = {}
    for i, s in found:
        if s:
            at = top(s)
            least[at] = min(least.get(at, i), i, key=order) if at in least else i
    return sorted(((i, len(s), least[top(s)] if s else i) for i, s in found), key=str)


def variants(rng: random.Random, words: list[str], copies: int, most: int) -> list[str]:
    out = []
    for _ in range(copies):
        mine = list(words)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(mine))
            how = rng.random()
            mine[at : at + 1] = [] if how < 0.3 else [f"n{rng.randrange(10**6)}"] if how < 0.7 else [mine[at], f"n{rng.randrange(10**6)}"]
        out.append(" ".join(mine))
    return out


def corpus() -> list[tuple]:
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts: list[str | None] = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 9, 40, 120]))) for _ in range(120)]
    passage = rng.choices(words, k=60)
    texts += [" ".join([*passage, *rng.choices(words, k=rng.choice([4, 8, 20, 60]))]) for _ in range(60)]
    for size, copies, most in ((200, 60, 6), (90, 30, 4), (40, 30, 3), (25, 20, 2), (300, 5, 12), (8, 10, 1), (5, 10, 1)):
        texts += variants(rng, rng.choices(words, k=size), copies, most)
    chain = rng.choices(words, k=100)  # every text links with the next only
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = [*chain[8:], *rng.choices(words, k=8)]
    texts += [None, "", " \n\t", "Solo", "solo", "A b C", "a B c", texts[125], texts[125], " ".join(["again and"] * 400), "é ü\x00 x \x1c y z", "word " * 9000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, (None, texts[130]), (None, texts[200]), (5, "used number " + texts[210]), rows[3], rows[3], (None, "alone as can be it is")]


@pytest.mark.parametrize(("rounds", "leaf", "pivots", "often"), [(2, 1000, 12, 8), (0, 6, 3, 1), (1, 12, 12, 1)])
def test_join_equals_brute_force(spark, monkeypatch, rounds, leaf, pivots, often):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 4 if often == 1 else 64)
    if rounds == 0:
        monkeypatch.setattr(jaccard_join, "DEPTH", 1)
    if pivots == 3:  # split however much the region grows
        monkeypatch.setattr(jaccard_join, "COPIES", 100)
    rows = corpus()
    docs = spark.createDataFrame([(*row, 1, 2, "a", "b", "c") for row in rows], COLUMNS).repartition(3)
    found = jaccard_join.similar_rows(docs).drop("set_key").collect()
    assert sorted((tuple(row) for row in found), key=str) == brute(rows)


def test_empty_table(spark):
    assert jaccard_join.similar_rows(spark.createDataFrame([], COLUMNS)).collect() == []


def test_points_that_link_share_enough_first_shingles():
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(20):
            other = int(rng.integers(-(-85 * n // 100), n + 1))  # sizes of sets that can link
            least = -(-85 * (n + other) // 185)
            if least > other:
                continue
            same = int(rng.integers(least, other + 1))
            if 100 * same < 85 * (n + other - same):
                continue
            union = rng.permutation(n + other - same)
            a, b = np.sort(union[:n]), np.sort(np.concatenate([union[:same], union[n:]]))
            common = len(np.intersect1d(a[: jaccard_join.first_count(n)], b[: jaccard_join.first_count(other)]))
            assert common >= 1 + 425 * n // 10_000 and common >= 1 + 425 * other // 10_000


def test_join_equals_sql(spark, folder):
    from logsieve.llm.queries import ORACLES, QUERIES

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    theirs = connection.execute(f"SELECT doc_id, n_shingles, component_id FROM ({ORACLES['op11_jaccard_join']})").fetchall()
    mine = QUERIES["op11_jaccard_join"](spark, folder).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, mine)) == sorted(theirs)
