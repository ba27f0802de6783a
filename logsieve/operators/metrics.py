"""Metric series of scored results.

Every series comes from one small cube: results grouped once by status class,
score bucket, anomaly flag and technique list (and, if wanted, time or batch).
The results themselves are read in one pass with map-side aggregation, however
many series are built from the cube.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv

_INF = float("inf")


def status_class(status: Column) -> Column:
    """1xx (below 200) .. 5xx, ``unknown`` without a status."""
    return (
        F.when(status.isNull(), "unknown")
        .when(status < 200, "1xx")
        .when(status < 300, "2xx")
        .when(status < 400, "3xx")
        .when(status < 500, "4xx")
        .otherwise("5xx")
    )


def first_bound(value: Column, bounds: Sequence[float]) -> Column:
    """Smallest upper bound that holds the value, else infinity."""
    chain = F
    for bound in bounds:
        chain = chain.when(value <= bound, F.lit(bound))
    return chain.otherwise(F.lit(_INF))


def time_bucket(ts: Column, seconds: int = fv.RATE_STEP_SECONDS) -> Column:
    """Start of the bucket in epoch seconds."""
    return F.floor(F.unix_seconds(ts) / seconds) * seconds


def metric_cube(results: DataFrame, *by: Column | str, environment: str = "dev") -> DataFrame:
    """Event counts and score sums per combination of everything a series needs."""
    has_techniques = "mitre_techniques" in results.columns
    techniques = (
        F.transform(
            F.coalesce("mitre_techniques", F.array().cast(results.schema["mitre_techniques"].dataType)),
            lambda item: F.struct(item["technique_id"].alias("technique_id"), item["tactic"].alias("tactic")),
        )
        if has_techniques
        else F.array().cast("array<struct<technique_id:string,tactic:string>>")
    )
    return results.groupBy(
        *by,
        F.lit(environment).alias("environment"),
        status_class(F.col("status")).alias("status_class"),
        first_bound(F.col("anomaly_score"), fv.SCORE_BOUNDS).alias("score_le"),
        F.col("is_anomaly"),
        techniques.alias("techniques"),
    ).agg(F.count("*").alias("n"), F.sum("anomaly_score").alias("score_sum"))


def event_counters(cube: DataFrame, *by: str) -> DataFrame:
    """Events, anomalies and anomaly rate (0 without events)."""
    totals = (cube.groupBy(*by) if by else cube).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.coalesce(F.sum(F.when(F.col("is_anomaly"), F.col("n"))), F.lit(0)).alias("anomalies"),
    )
    rate = F.when(F.col("events") > 0, F.col("anomalies") / F.col("events")).otherwise(0.0)
    return totals.withColumn("anomaly_rate", rate)


def running_summary(batches: DataFrame) -> DataFrame:
    """One row from the batch table: total events, anomalies, rate and the time of the last ingest that held an event."""
    totals = batches.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies"),
        F.max(_ingest_time()).alias("last_ingest"),
    )
    rate = F.when(F.col("total_events") > 0, F.col("anomalies") / F.col("total_events")).otherwise(0.0)
    return totals.withColumn("anomaly_rate", rate)


def ingest_summary(results: DataFrame, model_version: str) -> DataFrame:
    """One row: received, anomalies, model version."""
    return results.agg(
        F.count("*").alias("received"), F.count_if(F.col("is_anomaly")).alias("anomalies")
    ).withColumn("model_version", F.lit(model_version))


def _ingest_time() -> Column:
    """A batch of rejected lines alone is no ingest."""
    return F.when(F.col("events") > 0, F.col("ingest_ts"))


def last_ingest_time(batches: DataFrame) -> DataFrame:
    """Unix time of the last ingest of an event; null while nothing was ingested."""
    return batches.agg(F.unix_seconds(F.max(_ingest_time())).alias("last_ingest_unix"))


def latest_batch_rate(batches: DataFrame) -> DataFrame:
    """Anomaly rate of the newest batch of (batch_id, anomaly_rate)."""
    return batches.agg(
        F.max("batch_id").alias("batch_id"),
        F.max_by("anomaly_rate", "batch_id").alias("anomaly_rate"),
    )


def status_counts(cube: DataFrame, *by: str) -> DataFrame:
    return cube.groupBy(*by, "status_class").agg(F.sum("n").alias("cnt"))


def technique_counts(cube: DataFrame, *by: str) -> DataFrame:
    """Detections per technique and tactic, anomalous events only."""
    # The outer form keeps the optimizer from testing the lists below the cube,
    # where every rule would run a second time.
    flat = cube.filter("is_anomaly").select(*by, "n", F.inline_outer("techniques"))
    flat = flat.filter(F.col("technique_id").isNotNull())
    return flat.groupBy(*by, "technique_id", "tactic").agg(F.sum("n").alias("cnt"))


def top_techniques(cube: DataFrame, n: int = fv.TOP_TECHNIQUES) -> DataFrame:
    return technique_counts(cube).orderBy(F.desc("cnt"), "technique_id").limit(n)


def technique_total(cube: DataFrame) -> DataFrame:
    return technique_counts(cube).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("detections"))


def tactic_share(cube: DataFrame) -> DataFrame:
    """Detections per tactic and their percentage (one row per tactic)."""
    tactics = technique_counts(cube).groupBy("tactic").agg(F.sum("cnt").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy())
    return tactics.withColumn("percent", F.col("cnt") * 100.0 / total)


def cumulative_buckets(
    counts: DataFrame, bucket: str, weight: str, bounds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Counts at or below each bound, with an infinite last bound.

    The conditional sums are one aggregate per bound over the small counts
    table; every bound appears, also an empty one.
    """
    sums = [
        F.coalesce(F.sum(F.when(F.col(bucket) <= bound, F.col(weight))), F.lit(0)).alias(f"_b{at}")
        for at, bound in enumerate([*bounds, _INF])
    ]
    grouped = (counts.groupBy(*by) if by else counts).agg(*sums)
    rows = [
        F.struct(F.lit(bound).alias("le"), F.col(f"_b{at}").alias("cumulative"))
        for at, bound in enumerate([*bounds, _INF])
    ]
    return grouped.select(*by, F.inline(F.array(*rows)))


def score_histogram(cube: DataFrame, *by: str) -> DataFrame:
    """Cumulative score buckets (le, cumulative)."""
    return cumulative_buckets(cube, "score_le", "n", fv.SCORE_BOUNDS, by)


def score_sum_count(cube: DataFrame) -> DataFrame:
    return cube.agg(F.sum("score_sum").alias("score_sum"), F.sum("n").alias("score_count"))


def duration_histogram(batches: DataFrame, seconds: str = "duration_seconds") -> DataFrame:
    """Cumulative buckets of batch durations (le, cumulative)."""
    counted = batches.groupBy(first_bound(F.col(seconds), fv.DURATION_BOUNDS).alias("le_found")).agg(
        F.count("*").alias("n")
    )
    return cumulative_buckets(counted, "le_found", "n", fv.DURATION_BOUNDS)


def histogram_quantiles(
    buckets: DataFrame, quantiles: Sequence[float] = tuple(fv.DASHBOARD_QUANTILES), by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles by linear interpolation inside cumulative ``le`` buckets.

    A quantile that falls into the infinite bucket is the last finite bound; the
    first bucket begins at 0. Each window group holds one histogram.
    """
    series = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    shaped = buckets.withColumns(
        {
            "_below": F.coalesce(F.lag("cumulative").over(series), F.lit(0)),
            "_from": F.coalesce(F.lag("le").over(series), F.lit(0.0)),
            "_total": F.max("cumulative").over(whole),
        }
    )
    asked = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    ranked = shaped.withColumn("quantile", asked).withColumn(
        "_rank", F.col("quantile") * F.col("_total")
    )
    inside = (F.col("cumulative") >= F.col("_rank")) & (F.col("_total") > 0)
    share = F.when(
        F.col("cumulative") > F.col("_below"),
        (F.col("_rank") - F.col("_below")) / (F.col("cumulative") - F.col("_below")),
    ).otherwise(0.0)
    value = F.when(F.col("le") == _INF, F.col("_from")).otherwise(
        F.col("_from") + (F.col("le") - F.col("_from")) * share
    )
    return ranked.groupBy(*by, "quantile").agg(
        F.min_by(F.when(inside, value), F.when(inside, F.col("le"))).alias("value")
    )


def sliding_rates(
    counts: DataFrame, weights: Sequence[str], by: Sequence[str] = (), bucket: str = "bucket"
) -> DataFrame:
    """Per-second rates over 5 minutes, every 15 seconds, from 15-second sums.

    A row belongs to 20 windows; only the bucket sums are repeated, never the
    events. ``window_start`` is in epoch seconds.
    """
    steps = fv.RATE_WINDOW_SECONDS // fv.RATE_STEP_SECONDS
    offsets = F.explode(F.array(*[F.lit(step * fv.RATE_STEP_SECONDS) for step in range(steps)]))
    spread = counts.withColumn("_offset", offsets)
    start = (F.col(bucket) - F.col("_offset")).alias("window_start")
    return spread.groupBy(start, *by).agg(
        *[(F.sum(w) / float(fv.RATE_WINDOW_SECONDS)).alias(f"{w}_rate") for w in weights]
    )


def duration_quantiles(batches: DataFrame, seconds: str = "duration_seconds") -> DataFrame:
    """Quantiles of the batch durations over 5 minutes, every 15 seconds: window_start, quantile, value.

    The batches are counted per step and bucket first; only these counts are repeated for the windows.
    """
    found = first_bound(F.col(seconds), fv.DURATION_BOUNDS).alias("le_found")
    counts = batches.groupBy(time_bucket(F.col("ingest_ts")).alias("bucket"), found).agg(F.count("*").alias("n"))
    rates = sliding_rates(counts, ["n"], ["le_found"])
    whole = rates.withColumn("n", F.round(F.col("n_rate") * fv.RATE_WINDOW_SECONDS).cast("long"))
    buckets = cumulative_buckets(whole, "le_found", "n", fv.DURATION_BOUNDS, ["window_start"])
    return histogram_quantiles(buckets, by=["window_start"])


def event_rates(cube: DataFrame) -> DataFrame:
    """Rate of all, normal and anomalous events per sliding window."""
    flag = F.col("is_anomaly")
    counts = cube.groupBy("bucket").agg(
        F.sum("n").alias("events"),
        F.sum(F.when(flag, 0).otherwise(F.col("n"))).alias("normal"),
        F.sum(F.when(flag, F.col("n")).otherwise(0)).alias("anomalies"),
    )
    return sliding_rates(counts, ["events", "normal", "anomalies"])


def severity(metric: str, value: Column) -> Column:
    """Colour of the highest step reached."""
    base, steps = fv.SEVERITY_STEPS[metric]
    chain = F
    for name, bound in steps:
        chain = chain.when(value >= bound, name)
    return chain.otherwise(base)


def metric_severity(cube: DataFrame, batches: DataFrame) -> DataFrame:
    """Levels of the headline numbers and of each technique count; the rate is that of the newest batch."""
    newest = latest_batch_rate(batches).select("anomaly_rate")
    head = event_counters(cube).drop("anomaly_rate").join(F.broadcast(newest))
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit("").alias("label"),
            F.col(column).cast("double").alias("value"),
            severity(metric, F.col(column)).alias("severity"),
        )
        for metric, column in (
            ("events_total", "events"),
            ("anomalies_total", "anomalies"),
            ("anomaly_rate", "anomaly_rate"),
        )
    ]
    headline = head.select(F.inline(F.array(*rows)))
    techniques = technique_counts(cube).select(
        F.lit("technique_count").alias("metric"),
        F.col("technique_id").alias("label"),
        F.col("cnt").cast("double").alias("value"),
        severity("technique_count", F.col("cnt")).alias("severity"),
    )
    quantiles = histogram_quantiles(score_histogram(cube)).select(
        F.lit("score_quantile").alias("metric"),
        F.format_string("%.2f", "quantile").alias("label"),
        "value",
        severity("score_quantile", F.col("value")).alias("severity"),
    )
    return headline.unionByName(techniques).unionByName(quantiles)


def duration_totals(batches: DataFrame, seconds: str = "duration_seconds") -> DataFrame:
    """Sum and number of the batch durations."""
    return batches.agg(F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"), F.count(seconds).alias("n"))


def metric_table(cube: DataFrame, batches: DataFrame, environment: str = "dev") -> DataFrame:
    """All series in one long table: metric, labels, le, value.

    ``batches`` has batch_id, events, anomaly_rate, ingest_ts and duration_seconds of every ingested
    batch: the rate gauge is that of the newest one, the time that of the newest one with an event.
    """
    named = F.lit(environment).alias("environment")
    newest = batches.agg(
        F.max_by("anomaly_rate", "batch_id").alias("anomaly_rate"),
        F.unix_seconds(F.max(_ingest_time())).alias("last_ingest"),
    ).withColumn("environment", named)
    durations = duration_histogram(batches).withColumn("environment", named)
    spent = duration_totals(batches).withColumn("environment", named)
    scores = cube.groupBy("environment").agg(F.sum("score_sum").alias("score_sum"), F.sum("n").alias("score_count"))

    def series(df: DataFrame, metric: str, value: str, labels: Sequence[str] = (), le: str | None = None) -> DataFrame:
        pairs = [item for name in ("environment", *labels) for item in (F.lit(name), F.col(name))]
        return df.select(
            F.lit(metric).alias("metric"),
            F.create_map(*pairs).alias("labels"),
            (F.col(le) if le else F.lit(None)).cast("double").alias("le"),
            F.col(value).cast("double").alias("value"),
        )

    counters = event_counters(cube, "environment")
    parts = [
        series(counters, "log_events_total", "events"),
        series(counters, "log_anomalies_total", "anomalies"),
        series(newest, "log_anomaly_rate", "anomaly_rate"),
        series(newest, "log_last_ingest_timestamp", "last_ingest"),
        series(status_counts(cube, "environment"), "log_http_status_total", "cnt", ["status_class"]),
        series(
            technique_counts(cube, "environment"),
            "log_mitre_technique_total",
            "cnt",
            ["technique_id", "tactic"],
        ),
        series(score_histogram(cube, "environment"), "log_anomaly_score_bucket", "cumulative", le="le"),
        series(scores, "log_anomaly_score_sum", "score_sum"),
        series(scores, "log_anomaly_score_count", "score_count"),
        series(durations, "log_ingest_duration_seconds_bucket", "cumulative", le="le"),
        series(spent, "log_ingest_duration_seconds_sum", "seconds"),
        series(spent, "log_ingest_duration_seconds_count", "n"),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
