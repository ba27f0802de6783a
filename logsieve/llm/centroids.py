"""Centroid clustering: Lloyd rounds whose assignment searches a vantage-point tree over the centroids.

Each round builds the tree anew on the driver (k centroids, a bounded table) and broadcasts
it. Every vector walks the tree best first: the open node with the smallest lower bound is
visited next, and the search ends when that bound lies beyond the best distance; a bound
equal to it is still visited, so that ties go to the smaller centroid number. Distances to
centroids are exact 64-bit integers; the bounds are floats widened by a margin, so rounding
can only cause one more visit. A round sums its vectors per task before anything is
shuffled, and at most k rows reach the driver.

Defined cases: vectors of another length, null vectors and vectors with a null or non-finite component
are left out; components beyond 2**27 after scaling count as 2**27 (so distances fit 64 bits);
a null vec_id is hashed like an empty one; repeated rows are vectors of their own; with fewer
vectors than k there are as many centroids as vectors; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written

DIMS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
LARGEST = 2**27
LEAF = 2
ROWS = 2048
MAX_TREE_BYTES = 64_000_000


def scaled(vectors: DataFrame, key: str, column: str, dims: int) -> DataFrame:
    """vec_id and v (components as 32-bit integers, packed) of the vectors that are kept."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            good = np.isfinite(values).all(axis=1)
            whole = np.clip(np.floor(SCALE * values[good]), -LARGEST, LARGEST).astype("<i4")
            offsets = np.arange(len(whole) + 1, dtype=np.int32) * (4 * dims)
            packed = pa.Array.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer(offsets), pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), packed], schema=schema)

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    return rows.filter((F.size("x") == dims) & F.forall("x", lambda one: one.isNotNull())).mapInArrow(run, "vec_id long, v binary")


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """One row of 64-bit integers for each packed vector."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<i4").reshape(-1, dims).astype(np.int64)


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = rows - centre
    return np.einsum("ij,ij->i", apart, apart)


class VantageTree:
    """A vantage-point tree over centroids and an exact best-first search for many vectors at once."""

    def __init__(self, centres: np.ndarray, leaf: int = LEAF) -> None:
        self.centres = centres
        # Per node: the members of a leaf, or the vantage point and (child, least, most) distances from it.
        self.members: list[list[int]] = []
        self.point: list[int] = []
        self.children: list[list[tuple[int, float, float]]] = []
        self._grow(list(range(len(centres))), leaf)

    def _grow(self, members: list[int], leaf: int) -> int:
        node = len(self.members)
        self.members.append(members)
        self.point.append(-1)
        self.children.append([])
        if len(members) > leaf:
            point, rest = members[0], np.array(members[1:])
            far = np.sqrt(squared(self.centres[rest], self.centres[point]).astype(np.float64))
            order = np.argsort(far, kind="stable")
            self.members[node], self.point[node] = [], point
            for half in (order[: len(order) // 2], order[len(order) // 2 :]):
                if len(half):
                    child = self._grow([int(m) for m in rest[half]], leaf)
                    self.children[node].append((child, float(far[half].min()), float(far[half].max())))
        return node

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smallest) and the squared distance to it."""
        n = len(rows)
        best = np.full(n, np.iinfo(np.int64).max)
        who = np.full(n, len(self.centres))
        bound = np.full((n, len(self.members)), np.inf)
        bound[:, 0] = 0.0
        going = np.arange(n)
        while len(going):
            node = bound[going].argmin(axis=1)
            low = bound[going, node]
            more = low <= np.sqrt(best[going].astype(np.float64)) * (1 + 1e-12)
            going, node, low = going[more], node[more], low[more]
            bound[going, node] = np.inf
            for one in np.unique(node):
                here = node == one
                at = going[here]
                for centre in self.members[one] if self.point[one] < 0 else [self.point[one]]:
                    found = squared(rows[at], self.centres[centre])
                    better = (found < best[at]) | ((found == best[at]) & (centre < who[at]))
                    best[at[better]], who[at[better]] = found[better], centre
                if self.point[one] >= 0:  # the loop above left the distance to the vantage point
                    far = np.sqrt(found.astype(np.float64))
                    for child, least, most in self.children[one]:
                        inside = np.maximum(far - most, least - far) - 1e-9 * (far + most + 1.0)
                        bound[at, child] = np.maximum(np.maximum(inside, low[here]), 0.0)
        return who, best


def steps(source: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in source:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), unpacked(part.column(1), dims)


def cluster_sums(rows: DataFrame, centres: np.ndarray, dims: int) -> list[tuple[int, int, list[int]]]:
    """cluster, count and componentwise sums of every non-empty cluster: k rows at most."""
    tree = rows.sparkSession.sparkContext.broadcast(VantageTree(centres))
    k = len(centres)
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, values in steps(source, dims):
            who, _ = tree.value.nearest(values)
            n += np.bincount(who, minlength=k)
            for one in np.unique(who):
                sums[one] += values[who == one].sum(axis=0)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(n[used]), pa.array([list(s) for s in sums[used]], pa.list_(pa.int64()))], schema=schema)

    partial = rows.mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    found = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect()
    tree.unpersist()
    return [(row["cluster"], row["n"], [int(row[f"s{i}"]) for i in range(dims)]) for row in found]


def assigned(rows: DataFrame, centres: np.ndarray, dims: int) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    tree = rows.sparkSession.sparkContext.broadcast(VantageTree(centres))
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in steps(source, dims):
            who, far = tree.value.nearest(values)
            yield pa.RecordBatch.from_arrays([keys, pa.array(who, pa.int32()), pa.array(far)], schema=schema)

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centres(rows: DataFrame, k: int, salt: str, dims: int) -> np.ndarray:
    """The k vectors of smallest hash, in order of the hash."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = rows.select(F.sha2(name, 256).alias("hash"), "v").orderBy("hash", "v").limit(k).collect()
    return unpacked(pa.array([bytes(row["v"]) for row in chosen], pa.binary()), dims)


def cluster_vectors(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "3",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid (its components) of every kept vector."""
    if 16 * k * dims > MAX_TREE_BYTES:
        raise ValueError("k * dims is too large for a tree that goes to every task")
    spark = vectors.sparkSession
    rows = written(scaled(vectors, key, column, dims), "vectors")
    centres = first_centres(rows, k, salt, dims)
    for _ in range(rounds if len(centres) else 0):
        moved = centres.copy()
        for cluster, n, sums in cluster_sums(rows, centres, dims):
            moved[cluster] = [total // n for total in sums]
        if (moved == centres).all():
            break  # every later round would repeat this one
        centres = moved
    shape = "vec_id long, cluster int, distance long"
    last = written(assigned(rows, centres, dims) if len(centres) else spark.createDataFrame([], shape), "assigned")
    inertia = {row["cluster"]: int(row["d"]) for row in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    table = [
        (at, inertia[at], sum(inertia.values()), hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest(), centre.tolist())
        for at, centre in enumerate(centres) if at in inertia
    ]
    shown = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return last.join(F.broadcast(shown), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def cluster_sql(dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "3") -> str:
    """The rows of the query in plain SQL, one pair of steps for each round."""
    apart = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id::VARCHAR)) - 1 AS c, v FROM kept QUALIFY c < {k})"""]
    near = "SELECT k.r, k.vec_id, k.v, min(struct_pack(d := {apart}, c := c.c)) AS best FROM kept k CROSS JOIN c{at} c GROUP BY ALL"
    for at in range(rounds):
        parts.append(f"a{at} AS MATERIALIZED ({near.format(apart=apart, at=at)})")
        parts.append(f"""c{at + 1} AS MATERIALIZED (
  WITH sums AS (
    SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range(1, {dims + 1})) AS i FROM a{at}) GROUP BY ALL)
  SELECT c{at}.c, coalesce(list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) FILTER (i IS NOT NULL), any_value(c{at}.v)) AS v
  FROM c{at} LEFT JOIN sums USING (c) GROUP BY c{at}.c)""")
    return "WITH " + ",\n".join(parts) + f""",
done AS MATERIALIZED ({near.format(apart=apart, at=rounds)})
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM done JOIN c{rounds} ON c{rounds}.c = best.c"""
