"""Threat rules: requests to ranked technique lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import searches
from ..schema import TECHNIQUES


def rule_list() -> list[tuple[str, str, float, Column]]:
    """(rule, technique, confidence, condition), in evaluation order.

    Paths are searched as logged, never URL-decoded.
    """
    path = F.coalesce(F.col("path"), F.lit(""))
    agent = F.coalesce(F.col("user_agent"), F.lit(""))
    method = F.upper(F.coalesce(F.col("method"), F.lit("")))
    status = F.coalesce(F.col("status"), F.lit(0))
    scanner = searches(agent, fv.SCANNER_AGENT)

    def in_either(pattern: str) -> Column:
        return searches(path, pattern) | searches(agent, pattern)

    return [
        ("path_traversal", "T1190", 0.90, searches(path, fv.PATH_TRAVERSAL)),
        ("sql_injection", "T1190", 0.95, searches(path, fv.SQL_INJECTION)),
        ("xss", "T1203", 0.80, in_either(fv.XSS)),
        ("command_injection", "T1059.004", 0.90, searches(path, fv.COMMAND_INJECTION)),
        ("webshell", "T1505.003", 0.85, searches(path, fv.WEBSHELL)),
        ("ssrf", "T1190", 0.85, searches(path, fv.SSRF)),
        ("log4shell", "T1190", 0.95, in_either(fv.LOG4SHELL)),
        ("sensitive_path", "T1592", 0.70, searches(path, fv.SENSITIVE_PATH)),
        ("scanner_path", "T1595.002", 0.75, searches(path, fv.SCANNER_PATH)),
        ("scanner_agent", "T1595.002", 0.80, scanner),
        ("bot_agent", "T1595", 0.50, searches(agent, fv.GENERIC_BOT_AGENT) & ~scanner),
        ("write_method_error", "T1190", 0.60, method.isin(fv.WRITE_METHODS) & (status >= 400)),
        ("auth_failure", "T1110", 0.40, status.isin(401, 403)),
        ("server_error", "T1499", 0.30, status >= 500),
    ]


def rule_flags(events: DataFrame, only: Column | None = None) -> DataFrame:
    """Adds ``_hits``: one boolean per rule, false on rows outside ``only``."""
    guard = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    return events.withColumn("_hits", F.array(*[guard & hit for _, _, _, hit in rule_list()]))


def classify_techniques(events: DataFrame, only: Column | None = None) -> DataFrame:
    """Adds ``mitre_techniques``: each technique once with its highest confidence.

    The list is ordered by confidence, then by the first rule that matched. As
    the rules are fixed, each technique's confidence and first rule are plain
    expressions over the flags; nothing is exploded or grouped.
    """
    rules = [(rule, technique, confidence) for rule, technique, confidence, _ in rule_list()]
    catalog = {technique: (name, tactic) for technique, name, tactic in fv.TECHNIQUE_CATALOG}
    ranked = []
    for technique in dict.fromkeys(technique for _, technique, _ in rules):
        own = [(at, conf) for at, (_, tech, conf) in enumerate(rules) if tech == technique]
        strength = [F.when(F.col("_hits")[at], conf) for at, conf in own]
        order = [F.when(F.col("_hits")[at], at) for at, _ in own]
        best = strength[0] if len(own) == 1 else F.greatest(*strength)
        first = order[0] if len(own) == 1 else F.least(*order)
        name, tactic = catalog[technique]
        entry = F.struct(
            (-best).alias("rank"),
            first.alias("first"),
            F.lit(technique).alias("technique_id"),
            F.lit(name).alias("name"),
            F.lit(tactic).alias("tactic"),
            best.alias("confidence"),
        )
        ranked.append(F.when(first.isNotNull(), entry))
    ordered = F.array_sort(F.array_compact(F.array(*ranked)))
    techniques = F.transform(
        ordered,
        lambda item: F.struct(
            item["technique_id"].alias("technique_id"),
            item["name"].alias("name"),
            item["tactic"].alias("tactic"),
            item["confidence"].alias("confidence"),
        ),
    )
    any_hit = F.array_contains("_hits", True)
    listed = F.when(any_hit, techniques).otherwise(F.array().cast(TECHNIQUES))
    return rule_flags(events, only).withColumn("mitre_techniques", listed).drop("_hits")


def technique_hits(events: DataFrame, *kept: str) -> DataFrame:
    """One row per event and matching rule, before the techniques are merged."""
    rules = [
        F.struct(
            F.lit(at + 1).alias("rule_no"),
            F.lit(rule).alias("rule"),
            F.lit(technique).alias("technique_id"),
            F.lit(confidence).alias("confidence"),
        )
        for at, (rule, technique, confidence, _) in enumerate(rule_list())
    ]
    matched = F.transform(
        F.arrays_zip("_hits", F.array(*rules).alias("rules")),
        lambda item: F.when(item["_hits"], item["rules"]),
    )
    return rule_flags(events).select(*kept, F.inline(F.array_compact(matched)))


def technique_catalog(spark: SparkSession) -> DataFrame:
    """The 16 known techniques as a dimension table."""
    return spark.createDataFrame(
        fv.TECHNIQUE_CATALOG, "technique_id string, name string, tactic string"
    )


def with_catalog(rows: DataFrame) -> DataFrame:
    """Adds name and tactic by ``technique_id``; the catalog has a fixed 16 rows."""
    catalog = technique_catalog(rows.sparkSession)
    return rows.join(F.broadcast(catalog), "technique_id", "left")
