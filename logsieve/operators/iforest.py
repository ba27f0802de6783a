"""Isolation forest: trees grown and rows scored inside Spark tasks.

Liu, Ting and Zhou (2008): each tree splits a sample of at most 256 rows at
random until rows stand alone; rows that are isolated early are anomalous.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..scratch import written
from .baseline import with_prediction
from .features import extract_features, feature_columns, feature_moments

MODEL_VERSION = "iforest"
NODE_SCHEMA = "tree int, node int, feature int, threshold double, size int, path_length double"
PRIME = 2**31 - 1
BLOCK = 10_000
_EULER = 0.5772156649015329


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def _digits(text: str, start: int, count: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[start : start + count], 16)


def draw_factors(trees: int, seed: int) -> list[list[int]]:
    """Six factors for each tree, below PRIME: the linear functions that rank the rows for the tree."""
    return [[_digits(f"{seed}:tree:{tree}:{part}", 0, 15) % PRIME for tree in range(trees)] for part in range(6)]


def with_row_ids(features: DataFrame) -> DataFrame:
    """Training features with ``_row``, which rows without an id get from their content and their number
    among equal rows.

    Equal rows are counted per file of the written features first, so that a content which most rows
    share never comes into one task; the counts of the files before give the first number in each
    file. The ids are the same however the rows are partitioned, as equal rows are interchangeable.
    """
    if "_row" in features.columns:
        return features
    own = features.groupBy("_content", "_file").agg(
        F.count("*").alias("_n"), *[F.first(name).alias(name) for name in fv.FEATURE_NAMES])
    before = Window.partitionBy("_content").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # In two steps, so that no array holds the numbers of a whole file.
    blocks = own.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / BLOCK))))
    stop = F.least(F.col("_n"), (F.col("_block") + 1) * BLOCK) - 1
    rows = blocks.withColumn("_at", F.explode(F.sequence(F.col("_block") * BLOCK, stop)))
    return rows.select(F.xxhash64("_content", F.col("_base") + F.col("_at")).alias("_row"), *fv.FEATURE_NAMES)


def tree_samples(features: DataFrame, n: int, trees: int, sample_size: int, seed: int) -> DataFrame:
    """(tree, draw, features): ``min(sample_size, n)`` rows per tree, without replacement.

    A row's numbers are digits of the md5 of its id; a tree ranks the rows by linear functions of them modulo
    a prime, so draws are plain arithmetic in any engine. Only about 1.5 times the rows each tree
    needs are ever exploded: one number of the row tells whether any tree may draw it at all,
    and only then are the draws of the trees made, each as likely as if it had been made
    alone. The same rule holds for every number of rows.
    """
    size = min(sample_size, n)
    alone = min(1.0, (1.5 * size + 64.0) / n)
    some = 1.0 - (1.0 - alone) ** trees
    digest = F.md5(F.concat(F.lit(f"{seed}:row:"), F.col("_row").cast("string")))

    def digits(start: int, count: int) -> Column:
        return F.conv(F.substring("_digest", start, count), 16, 10).cast("long")

    rows = with_row_ids(features).withColumn("_digest", digest)
    rows = rows.filter(digits(17, 12) / float(1 << 48) < some)
    rows = rows.withColumns({"_x": digits(1, 8) % PRIME, "_y": digits(9, 8) % PRIME}).drop("_digest")
    factors = [F.lit(part) for part in draw_factors(trees, seed)]

    def rank(tree: Column, at: int) -> Column:
        a, b, c = (F.get(part, tree) for part in factors[at : at + 3])
        return (a * F.col("_x") + b * F.col("_y") + c) % PRIME

    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda tree: F.struct(tree.alias("tree"), (rank(tree, 0) * PRIME + rank(tree, 3)).alias("draw")),
    )
    below = alone / some * float(PRIME) * float(PRIME)
    chosen = rows.withColumn("_draw", F.explode(F.filter(draws, lambda item: item["draw"].cast("double") < below)))
    flat = chosen.select(
        F.col("_draw.tree").alias("tree"), F.col("_draw.draw").alias("draw"), "_row", *fv.FEATURE_NAMES
    )
    order = F.row_number().over(Window.partitionBy("tree").orderBy("draw", "_row"))
    return flat.withColumn("_order", order).filter(F.col("_order") <= size).drop("_order", "_row")


def split_numbers(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two repeatable numbers in [0, 1): which feature a node splits, and where."""
    name = f"{seed}:node:{tree}:{node}"
    return _digits(name, 0, 12) / float(1 << 48), _digits(name, 12, 12) / float(1 << 48)


def _grow(x: np.ndarray, seed: int, tree: int, depth_limit: int) -> list[tuple]:
    """Nodes of one tree in heap numbering: children of i are 2i+1 and 2i+2."""
    nodes = []
    pending = [(0, 0, np.arange(len(x)))]
    while pending:
        node, depth, rows = pending.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth >= depth_limit or not len(splittable):
            nodes.append((node, -1, math.inf, len(rows), depth + average_path(len(rows))))
            continue
        which, where = split_numbers(seed, tree, node)
        feature = int(splittable[int(which * len(splittable))])
        threshold = float(low[feature] + where * (high[feature] - low[feature]))
        if threshold >= high[feature]:
            threshold = float(low[feature])
        left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, len(rows), 0.0))
        pending.append((2 * node + 1, depth + 1, rows[left]))
        pending.append((2 * node + 2, depth + 1, rows[~left]))
    return nodes


def grow_trees(samples: DataFrame, sample_size: int, seed: int) -> DataFrame:
    """Node table; one task group per tree, each with at most ``sample_size`` rows."""
    depth_limit = math.ceil(math.log2(max(sample_size, 2)))
    names = list(fv.FEATURE_NAMES)

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        nodes = _grow(rows[names].to_numpy(dtype=float), seed, tree, depth_limit)
        grown = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "size", "path_length"])
        grown.insert(0, "tree", tree)
        return grown

    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def training_features(events: DataFrame, id_column: str | None = None) -> DataFrame:
    """Written feature rows with a row id ``_row``, or with ``_content`` and ``_file`` from which it is made.

    Training reads the features three times (moments, samples, scores); the raw
    events are parsed and featurized once.
    """
    if id_column is not None:
        return written(extract_features(events.withColumn("_row", F.col(id_column)), "_row"), "features")
    plain = [F.col(f"`{name}`") for name, kind in events.dtypes if kind != "variant"]
    variants = [F.to_json(f"`{name}`") for name, kind in events.dtypes if kind == "variant"]
    keyed = events.withColumn("_content", F.xxhash64(*plain, *variants))
    return written(extract_features(keyed, "_content"), "features").withColumn("_file", F.col("_metadata.file_name"))


class _Forest:
    """Node table as arrays of full binary trees, sent once to each executor."""

    def __init__(self, nodes: pd.DataFrame, depth: int) -> None:
        trees = int(nodes["tree"].max()) + 1
        inner, leaves = 2**depth - 1, 2**depth
        self.depth = depth
        self.feature = np.zeros((trees, inner), dtype=np.int64)
        self.threshold = np.full((trees, inner), np.inf)
        self.leaf = np.zeros((trees, leaves))
        tree, node = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        split = nodes["feature"].to_numpy() >= 0
        self.feature[tree[split], node[split]] = nodes["feature"].to_numpy()[split]
        self.threshold[tree[split], node[split]] = nodes["threshold"].to_numpy()[split]
        # A leaf above the last level is reached by going left all the way down.
        for at, home, length in zip(tree[~split], node[~split], nodes["path_length"][~split]):
            while home < inner:
                home = 2 * home + 1
            self.leaf[at, home - inner] = length

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        flat, base = x.ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                right = flat[base + feature[at]] > threshold[at]
                at = 2 * at + 1 + right
            total += leaf[at - len(feature)]
        return total / len(self.leaf)


class ForestDetector:
    """Isolation forest over the 26 features, scores scaled to 0..1 by the training range."""

    model_type = "isolation_forest"
    model_version = MODEL_VERSION

    def __init__(
        self,
        nodes: DataFrame,
        moments: DataFrame,
        sample_size: int,
        contamination: float = fv.FOREST_CONTAMINATION,
        score_min: float | None = None,
        score_max: float | None = None,
    ) -> None:
        self.nodes = nodes
        self.moments = moments
        self.sample_size = sample_size
        self.contamination = contamination
        self.score_min = score_min
        self.score_max = score_max
        self._udf = None

    @classmethod
    def fit(
        cls,
        features: DataFrame,
        trees: int = fv.FOREST_TREES,
        contamination: float = fv.FOREST_CONTAMINATION,
        seed: int = fv.FOREST_SEED,
        sample_size: int = fv.FOREST_SAMPLE_SIZE,
    ) -> ForestDetector:
        """Trees and scaler from ``training_features``; ``calibrate`` sets the score range.

        The drawn samples and the grown nodes are written, so that a lost executor
        cannot change a tree half-way. Both are bounded by the forest's size.
        """
        moments = written(feature_moments(features), "moments")
        n = moments.first()["n"]
        if not n:
            raise ValueError("no events to train on")
        size = min(sample_size, n)
        samples = written(tree_samples(features, n, trees, sample_size, seed), "samples")
        nodes = written(grow_trees(samples, size, seed), "nodes")
        return cls(nodes, moments, size, contamination)

    @classmethod
    def train(cls, events: DataFrame, id_column: str | None = None, **options: object) -> ForestDetector:
        """Fit, then set the score range from the training rows."""
        features = training_features(events, id_column)
        model = cls.fit(features, **options)
        model.calibrate(model.training_score_counts(features))
        return model

    def calibrate(self, raw_counts: DataFrame) -> None:
        """Take the score range from (anomaly_score, n) of raw training scores."""
        row = raw_counts.agg(
            F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high")
        ).first()
        self.score_min, self.score_max = row["low"], row["high"]

    def _raw_udf(self, spark: SparkSession):
        """Vectorized scorer; at most trees x 511 nodes (a few MB) are broadcast."""
        if self._udf is None:
            depth = math.ceil(math.log2(max(self.sample_size, 2)))
            forest = spark.sparkContext.broadcast(_Forest(self.nodes.toPandas(), depth))
            usual = average_path(self.sample_size) or 1.0

            @F.pandas_udf("double")
            def raw(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
                for columns in batches:
                    x = np.column_stack([column.to_numpy(dtype=float) for column in columns])
                    yield pd.Series(np.exp2(-forest.value.mean_path(x) / usual))

            self._udf = raw
        return self._udf

    def raw_score(self, events: DataFrame) -> DataFrame:
        """Adds ``raw_score``: 2 ** (-mean path / usual path)."""
        columns = feature_columns()
        # Projected first, so that the features are computed in the JVM stage.
        featured = events.withColumns({f"_f_{name}": col for name, col in columns.items()})
        names = [f"_f_{name}" for name in columns]
        udf = self._raw_udf(events.sparkSession)
        return featured.withColumn("raw_score", udf(*names)).drop(*names)

    def training_score_counts(self, features: DataFrame) -> DataFrame:
        """(anomaly_score, n) of the raw scores of training features."""
        raw = self._raw_udf(features.sparkSession)(*fv.FEATURE_NAMES)
        return features.select(raw.alias("anomaly_score")).groupBy("anomaly_score").agg(
            F.count("*").alias("n")
        )

    def normalized(self, raw: Column) -> Column:
        """Score within the training range, clipped; raw before calibration."""
        if self.score_min is None or self.score_max is None:
            return raw
        if self.score_max == self.score_min:
            return F.lit(0.0)
        share = (raw - self.score_min) / (self.score_max - self.score_min)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))

    def score(self, events: DataFrame) -> DataFrame:
        """Adds ``anomaly_score``."""
        score = self.normalized(F.col("raw_score"))
        return self.raw_score(events).withColumn("anomaly_score", score).drop("raw_score")

    def predict(self, events: DataFrame, threshold: float) -> DataFrame:
        return with_prediction(self.score(events), threshold, self.model_version)

    def score_counts(self, events: DataFrame, *by: str) -> DataFrame:
        return self.score(events).groupBy("anomaly_score", *by).agg(F.count("*").alias("n"))

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.moments.write.mode("overwrite").parquet(f"{path}/scaler")
        row = (self.sample_size, self.contamination, self.score_min, self.score_max, self.model_version)
        schema = (
            "sample_size int, contamination double, score_min double, score_max double, "
            "model_version string"
        )
        stats = self.nodes.sparkSession.createDataFrame([row], schema)
        stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestDetector:
        row = spark.read.parquet(f"{path}/stats").first()
        model = cls(
            spark.read.parquet(f"{path}/nodes"),
            spark.read.parquet(f"{path}/scaler"),
            row["sample_size"],
            row["contamination"],
            row["score_min"],
            row["score_max"],
        )
        model.model_version = row["model_version"]
        return model
