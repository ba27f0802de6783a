"""Labelled evaluation sets: clean rows plus injected attacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv

BROADCAST_TEMPLATES = 100_000
Picker = Callable[[Column, int, Column | int], Column]


def hash_pick(key: Column, salt: int, n: Column | int) -> Column:
    """Repeatable choice in 0..n-1 from the hash of a key."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), n if isinstance(n, Column) else F.lit(n)).cast("int")


def payload_table(spark: SparkSession) -> DataFrame:
    """(category_no, category, url_no, url, urls): the fixed attack payloads."""
    rows = [
        (at, category, number, url, len(urls))
        for at, (category, urls) in enumerate(fv.ATTACK_PAYLOADS.items())
        for number, url in enumerate(urls)
    ]
    schema = "category_no int, category string, url_no int, url string, urls int"
    return spark.createDataFrame(rows, schema)


def sample_templates(
    rows: DataFrame,
    order_by: str,
    n: int = fv.TEMPLATE_SAMPLE,
    head: int | None = None,
    pick: Picker = hash_pick,
) -> DataFrame:
    """``n`` rows in shuffled order, numbered from 0 (``template_no``); with ``head`` of the first so many rows only."""
    first = rows if head is None else rows.orderBy(order_by).limit(head)
    mixed = first.withColumn("_mix", pick(F.col(order_by), 11, 1_000_003))
    chosen = mixed.orderBy("_mix", order_by).limit(n)
    # At most n rows are numbered.
    number = F.row_number().over(Window.orderBy("_mix", order_by)) - 1
    return chosen.withColumn("template_no", number).drop("_mix")


def overlay(rows: DataFrame, url: Column, status: Column, agent: Column) -> DataFrame:
    """Replace path and status, and the user agent where one is given."""
    return rows.withColumns(
        {
            "path": url,
            "status": status,
            "user_agent": F.when(agent != "", agent).otherwise(F.col("user_agent")),
        }
    )


def inject_attacks(
    slots: DataFrame, key: str, templates: DataFrame, pick: Picker = hash_pick
) -> DataFrame:
    """One attack row per row of ``slots``: a template row with a payload put over it.

    Category, template, payload, agent and status are chosen by the slot's key, so
    a rerun or a retried task makes the same row. The payloads (49) are a fixed-size
    broadcast side; templates are one up to a checked number.
    """
    spark = slots.sparkSession
    payloads = payload_table(spark)
    categories = list(fv.ATTACK_PAYLOADS)
    sizes = F.array(*[F.lit(len(fv.ATTACK_PAYLOADS[name])) for name in categories])
    slot = F.col(key)
    numbered = slots.select(key).withColumn("category_no", pick(slot, 1, len(categories)))
    count = templates.agg(F.count("*").cast("int").alias("_templates"))
    chosen = numbered.join(F.broadcast(count)).withColumns(
        {
            "url_no": pick(slot, 2, F.get(sizes, F.col("category_no"))),
            "template_no": pick(slot, 3, F.col("_templates")),
        }
    )
    # Key columns of the template rows give way to the slot's own key.
    base = templates.drop(key)
    if templates.count() <= BROADCAST_TEMPLATES:
        base = F.broadcast(base)
    rows = chosen.join(F.broadcast(payloads), ["category_no", "url_no"]).join(base, "template_no")
    choices = [fv.ATTACK_CHOICES[name] for name in categories]
    percents = F.array(*[F.lit(percent) for percent, _ in choices])
    statuses = F.array(*[F.array(*[F.lit(code) for code in codes]) for _, codes in choices])
    agents = F.array(*[F.lit(agent) for agent in fv.SCANNER_AGENTS])
    own = F.get(statuses, F.col("category_no"))
    status = F.get(own, pick(slot, 4, F.size(own)))
    scanner = F.get(agents, pick(slot, 5, len(fv.SCANNER_AGENTS)))
    agent = F.when(pick(slot, 6, 100) < F.get(percents, F.col("category_no")), scanner).otherwise("")
    laid = overlay(rows, F.col("url"), status, agent)
    return laid.withColumn("label", F.concat(F.lit("attack:"), "category")).drop(
        "category_no", "url_no", "template_no", "_templates", "category", "url", "urls"
    )


def labelled_mix(
    clean: DataFrame,
    attacks: DataFrame,
    key: str,
    clean_limit: int | None = None,
    pick: Picker = hash_pick,
) -> DataFrame:
    """Clean rows (all, or the first ``clean_limit`` by key if the caller says so) and attacks, shuffled.

    ``mix_order`` is the shuffled position key; sort by it when order matters.
    """
    head = clean if clean_limit is None else clean.orderBy(key).limit(clean_limit)
    labelled = head.withColumn("label", F.lit("clean"))
    both = labelled.unionByName(attacks, allowMissingColumns=True)
    salt = F.when(F.col("label") == "clean", pick(F.col(key), 7, 1_000_003)).otherwise(
        pick(F.col(key), 8, 1_000_003)
    )
    return both.withColumn("mix_order", salt)
