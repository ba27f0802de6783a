"""Quality reports of scores against labels.

Scores are collapsed once to (score, pos, neg); every report reads that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import grid_index, quantile, running_totals

GRID_STEP = 0.01
GRID_LAST = 100


def is_attack(label: Column) -> Column:
    return label != "clean"


def attack_category(label: Column) -> Column:
    """Text after ``attack:``; null for other labels."""
    return F.when(label.startswith("attack:"), F.substring(label, 8, 2147483647))


def class_counts(score_counts: DataFrame) -> DataFrame:
    """(anomaly_score, pos, neg) from (anomaly_score, label, n)."""
    attack = is_attack(F.col("label"))
    return score_counts.groupBy("anomaly_score").agg(
        F.sum(F.when(attack, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(attack, 0).otherwise(F.col("n"))).alias("neg"),
    )


def ordered_classes(counts: DataFrame) -> DataFrame:
    """``class_counts`` with running and total counts, ready for the ordered reports."""
    return running_totals(counts, "anomaly_score", ["pos", "neg"])


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def with_ratios(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and FPR (0 on a zero denominator) and accuracy."""
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    shares = confusion.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "fpr": _ratio(fp, fp + tn),
            "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        }
    )
    both = F.col("precision") + F.col("recall")
    return shares.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))


def confusion_at(counts: DataFrame, threshold: float | Column) -> DataFrame:
    """One row: TP, FP, FN, TN and ratios at a threshold."""
    flagged = F.col("anomaly_score") >= threshold

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(name))), F.lit(0))

    return with_ratios(
        counts.agg(
            total(flagged, "pos").alias("tp"),
            total(flagged, "neg").alias("fp"),
            total(~flagged, "pos").alias("fn"),
            total(~flagged, "neg").alias("tn"),
        )
    )


def label_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n_total"),
        F.sum("neg").alias("n_clean"),
        F.sum("pos").alias("n_attack"),
    )


def score_distribution(ordered: DataFrame) -> DataFrame:
    """Mean, deviation, min, p50, p95, p99 and max of clean and attack scores."""
    score = F.col("anomaly_score")
    rows = []
    aggregates = []
    for name, weight in (("clean", "neg"), ("attack", "pos")):
        w = F.col(weight)
        mean = F.sum(score * w) / F.sum(w)
        square = F.sum(score * score * w) / F.sum(w)
        columns = {
            "n": F.sum(w),
            "mean": mean,
            "std": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))),
            "min": F.min(F.when(w > 0, score)),
            "p50": quantile("anomaly_score", weight, 0.50),
            "p95": quantile("anomaly_score", weight, 0.95),
            "p99": quantile("anomaly_score", weight, 0.99),
            "max": F.max(F.when(w > 0, score)),
        }
        aggregates += [column.alias(f"{name}_{key}") for key, column in columns.items()]
        fields = [F.col(f"{name}_{key}").alias(key) for key in columns]
        rows.append(F.struct(F.lit(name).alias("class"), *fields))
    return ordered.agg(*aggregates).select(F.inline(F.array(*rows)))


def roc_auc(ordered: DataFrame) -> DataFrame:
    """Rank-sum area under the ROC curve, ties counted half; null if a class is empty."""
    pos, below = F.col("pos").cast("double"), F.col("neg_before")
    wins = F.sum(pos * (below + F.col("neg") / 2.0))
    pairs = F.max(F.col("pos_total").cast("double") * F.col("neg_total"))
    return ordered.agg(F.try_divide(wins, pairs).alias("auc"))


def roc_curve(ordered: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, with (inf, 0, 0) in front."""
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    points = ordered.select(
        F.col("anomaly_score").alias("threshold"),
        F.try_divide(fp, F.col("neg_total")).alias("fpr"),
        F.try_divide(tp, F.col("pos_total")).alias("tpr"),
    )
    start = ordered.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def youden_point(curve: DataFrame) -> DataFrame:
    """The curve point with the highest TPR - FPR; the highest threshold wins a tie."""
    j = (F.col("tpr") - F.col("fpr")).alias("j")
    return curve.select("threshold", "fpr", "tpr", j).orderBy(F.desc("j"), F.desc("threshold")).limit(1)


def threshold_sweep(counts: DataFrame) -> DataFrame:
    """Confusion counts and ratios at 0.00, 0.01 .. 1.00.

    Scores are first summed per grid step, so the running sums see 102 rows.
    """
    steps = counts.groupBy(
        grid_index(F.col("anomaly_score"), GRID_STEP, GRID_LAST).alias("k")
    ).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = counts.sparkSession.range(-1, GRID_LAST + 1).select(F.col("id").cast("int").alias("k"))
    filled = grid.join(F.broadcast(steps), "k", "left").na.fill(0, ["pos", "neg"])
    from_top = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    overall = Window.partitionBy()
    sums = filled.select(
        "k",
        F.sum("pos").over(from_top).alias("tp"),
        F.sum("neg").over(from_top).alias("fp"),
        F.sum("pos").over(overall).alias("p"),
        F.sum("neg").over(overall).alias("q"),
    ).filter("k >= 0")
    swept = sums.select(
        (F.col("k") * GRID_STEP).alias("threshold"),
        "tp",
        "fp",
        (F.col("p") - F.col("tp")).alias("fn"),
        (F.col("q") - F.col("fp")).alias("tn"),
    )
    return with_ratios(swept)


def best_f1(sweep: DataFrame, train_threshold: float) -> DataFrame:
    """Lowest threshold of the highest F1; the training threshold if every F1 is 0."""
    top = sweep.orderBy(F.desc("f1"), "threshold").limit(1)
    fallback = F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(train_threshold))
    return top.select(fallback.alias("threshold"), "f1")


def sweep_report(sweep: DataFrame, best: float, train: float) -> DataFrame:
    """Sweep rows near multiples of 0.05 and near the two thresholds, marked."""
    near_best = F.abs(F.col("threshold") - best) < 0.005
    near_train = F.abs(F.col("threshold") - train) < 0.005
    marker = F.when(near_best, "BEST F1").when(near_train, "TRAIN").otherwise("")
    shown = (F.col("threshold") % 0.05 < 0.005) | near_best | near_train
    return sweep.filter(shown).withColumn("marker", marker)


def category_counts(score_counts: DataFrame) -> DataFrame:
    """Attacks per category, most common first."""
    counts = score_counts.groupBy(attack_category(F.col("label")).alias("category")).agg(
        F.sum("n").alias("total")
    )
    return counts.filter(F.col("category").isNotNull()).orderBy(F.desc("total"), "category")


def category_recall(score_counts: DataFrame, best: float, youden: float) -> DataFrame:
    """Total, detections and recall percent per category at two thresholds."""

    def found(threshold: float) -> Column:
        hit = F.when(F.col("anomaly_score") >= threshold, F.col("n")).otherwise(0)
        return F.sum(hit)

    grouped = (
        score_counts.withColumn("category", attack_category(F.col("label")))
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            F.sum("n").alias("total"),
            found(best).alias("detected_best"),
            found(youden).alias("detected_youden"),
        )
    )
    return grouped.withColumns(
        {
            "recall_best": F.col("detected_best") * 100.0 / F.col("total"),
            "recall_youden": F.col("detected_youden") * 100.0 / F.col("total"),
        }
    )


def anomaly_share(counts: DataFrame, threshold: float, weights: Sequence[str] = ("n",)) -> DataFrame:
    """Rows at or above the threshold and their percentage."""
    n = sum((F.col(weight) for weight in weights[1:]), F.col(weights[0]))
    hits = F.coalesce(F.sum(F.when(F.col("anomaly_score") >= threshold, n)), F.lit(0))
    return counts.agg(hits.alias("anomalies"), F.try_divide(hits * 100.0, F.sum(n)).alias("percent"))
