"""The full validation report of a model on labelled events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators.parse import parse_access_logs
from ..scratch import written
from ..sources.lines import labelled_lines
from .registry import Detector


def labelled_events(lines: DataFrame, **parsing: object) -> tuple[DataFrame, DataFrame]:
    """Parsed labelled JSON lines, and the number of skipped lines per label."""
    parsed = parse_access_logs(labelled_lines(lines), "jsonl", mode="keep", **parsing)
    rejected = parsed["reject_reason"].isNotNull()
    skipped = parsed.filter(rejected).groupBy("label").count().withColumnRenamed("count", "skipped")
    return parsed.filter(~rejected).drop("reject_reason", "value"), skipped


def evaluate(labelled: DataFrame, detector: Detector, train_threshold: float) -> dict[str, DataFrame]:
    """All report tables by name.

    Events are scored once and collapsed to (score, label, n), which is written;
    every report is an aggregate of that table. Only the two chosen thresholds,
    one row each, come to the driver.
    """
    scores = written(detector.score_counts(labelled, "label"), "label-scores")
    counts = ev.class_counts(scores)
    ordered = ev.ordered_classes(counts)
    sweep = ev.threshold_sweep(counts)
    best_point = ev.best_f1(sweep, train_threshold)
    youden = ev.youden_point(ev.roc_curve(ordered))
    best, cut = best_point.first(), youden.first()
    return {
        "totals": ev.label_totals(counts),
        "categories": ev.category_counts(scores),
        "distribution": ev.score_distribution(ordered),
        "at_train_threshold": ev.confusion_at(counts, train_threshold),
        "auc": ev.roc_auc(ordered),
        "sweep": ev.sweep_report(sweep, best["threshold"], train_threshold),
        "roc": ev.roc_curve(ordered),
        "best_f1": best_point,
        "youden": youden,
        "at_best_f1": ev.confusion_at(counts, best["threshold"]),
        "at_youden": ev.confusion_at(counts, cut["threshold"]),
        "category_recall": ev.category_recall(scores, best["threshold"], cut["threshold"]),
    }


# Tables of the long report and the SQL that names a row in them; the ROC curve stays a table of its own.
LONG_KEYS = {
    "totals": "''",
    "categories": "category",
    "distribution": "class",
    "at_train_threshold": "''",
    "auc": "''",
    "sweep": "concat_ws(' ', format_string('%.2f', threshold), nullif(marker, ''))",
    "best_f1": "''",
    "youden": "''",
    "at_best_f1": "''",
    "at_youden": "''",
    "category_recall": "category",
}


def long_report(labelled: DataFrame, detector: Detector, train_threshold: float) -> DataFrame:
    """The whole report as one table: section, item within it, measure and value.

    Events are scored once; every section reads the same written score counts.
    """
    tables = evaluate(labelled, detector, train_threshold)
    parts = []
    for section, key in LONG_KEYS.items():
        table = tables[section]
        names = [name for name, kind in table.dtypes if kind != "string"]
        rows = table.select(F.expr(key).alias("item"), *[F.col(name).cast("double").alias(name) for name in names])
        tall = rows.unpivot("item", names, "measure", "value")
        parts.append(tall.select(F.lit(section).alias("section"), "item", "measure", "value"))
    return reduce(DataFrame.unionByName, parts)
