"""Centroid clustering against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from logsieve.llm import centroids

COLUMNS = "vec_id long, embedding array<float>, cluster string, v int, distance string"


def brute(rows: list[tuple], dims: int, k: int, rounds: int) -> list[tuple]:
    kept = [
        (i, [max(-2**27, min(2**27, math.floor(1024 * float(x)))) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centres = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), at) for at, c in enumerate(centres))

    for _ in range(rounds):
        who = [near(v)[1] for _, v in kept]
        for at in range(len(centres)):
            mine = [v for (_, v), w in zip(kept, who) if w == at]
            if mine:
                centres[at] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    whole = sum(d for _, d, _ in found)
    out = []
    for i, d, at in found:
        name = hashlib.sha256(",".join(map(str, centres[at])).encode()).hexdigest()
        out.append((i, at, d, sum(e for _, e, b in found if b == at), whole, name))
    return sorted(out, key=str)


def odd_vectors(dims: int) -> list[tuple]:
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(i % 5, 0.4))) for _ in range(dims)]) for i in range(150)]
    rows += [(i, [float(rng.randint(0, 1)) for _ in range(dims)]) for i in range(200, 260)]  # many ties
    rows += [rows[3], rows[3], (None, rows[7][1]), (900, None), (901, []), (902, [1.0]), (903, [None] * dims), (904, [float("nan")] * dims)]
    rows += [(905, [float("inf")] + [0.0] * (dims - 1)), (906, [1e30] * dims), (907, [0.0] * dims), (908, [-0.0] * dims)]
    return rows


@pytest.mark.parametrize(("dims", "k", "rounds"), [(4, 8, 10), (3, 30, 3), (4, 500, 2)])
def test_clusters_equal_brute_force(spark, dims, k, rounds):
    rows = odd_vectors(dims)
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], COLUMNS).repartition(3)
    found = centroids.cluster_vectors(table, dims=dims, k=k, rounds=rounds).drop("centroid").collect()
    assert sorted((tuple(row) for row in found), key=str) == brute(rows, dims, k, rounds)


def test_no_vectors(spark):
    for rows in ([], [(1, None, "", 1, "")]):
        assert centroids.cluster_vectors(spark.createDataFrame(rows, COLUMNS)).collect() == []


def test_tree_finds_the_nearest_of_many_centroids():
    rng = np.random.default_rng(4)
    centres = rng.integers(-40, 40, (300, 6)).astype(np.int64)
    centres[200:220] = centres[100:120]  # equal centroids: the smaller number wins
    rows = np.concatenate([rng.integers(-50, 50, (2000, 6)).astype(np.int64), centres, np.full((1, 6), 2**27), np.full((1, 6), -(2**27))])
    who, far = centroids.VantageTree(centres, leaf=4).nearest(rows)
    every = ((rows[:, None, :] - centres[None, :, :]) ** 2).sum(2)
    assert (far == every.min(1)).all()
    assert (who == every.argmin(1)).all()


def test_clusters_equal_sql(spark, folder):
    from logsieve.llm.queries import ORACLES, QUERIES

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    theirs = connection.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op12_centroid_clustering']})").fetchall()
    mine = QUERIES["op12_centroid_clustering"](spark, folder).select(*names).collect()
    assert sorted(map(tuple, mine)) == sorted(theirs)
