"""Quality rules with thresholds that follow the corpus.

Each text is measured by built-in functions. The measures of every language
and source are summarised in quantile sketches: counts over bins whose width
grows with the value, so that sketches of parts of the corpus add up to the
sketch of the whole, and the same rows give the same sketch in any order. A
document is rejected when a measure lies beyond a fence of its own group,
third quartile + ``SPREAD`` * interquartile range (or the mirrored lower fence), and
also beyond the least step from the median that counts as unusual. Groups with few
documents borrow the merged sketch of their language, and small languages that
of the whole corpus.

Defined cases: a null text has no words and fails the base rules; null
language or source is a group of its own; repeated rows are judged row by
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .common import SPACES, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_GROUP = 50
SPREAD = 3
SCALE = 1000

# Measure: (numerator, denominator, lower side too, least distance from the median). In thousandths.
MEASURES = {
    "symbols": ("n_symbols", "n_words", False, 100),
    "duplicate_lines": ("n_dup_lines", "n_lines", False, 150),
    "repeats": ("n_repeat_words", "n_words", False, 100),
    "word_length": ("word_chars", "n_words", True, 4000),
}


def windows_of(words: Column) -> Column:
    """A hash of every run of five consecutive words."""
    return F.transform(
        F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )


def text_measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, source and the counts that the rules use; with ``carry`` the whole document as ``row`` too."""
    own = [F.struct("*").alias("row")] if carry else []
    keep = ["doc_id", "lang", "source", *(["row"] if carry else [])]
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), text.alias("body"), *own,
    )
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = base.select(
        *keep,
        F.length(F.translate("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        words_of(F.col("body")).alias("words"), lines.alias("lines"),
    )
    step = step.withColumns({"n_words": F.size("words").cast("long"), "n_lines": F.size("lines").cast("long")})
    step = step.withColumns({
        "n_dup_lines": F.col("n_lines") - F.size(F.array_distinct("lines")), "hashes": windows_of(F.col("words")),
    }).drop("words", "lines")
    # Only texts with a repeated window go through the sort.
    step = step.withColumn("ordered", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )).drop("hashes")
    near = F.filter("ordered", lambda x, i: (
        ((i > 0) & (F.get("ordered", i - 1)["h"] == x["h"])) | F.coalesce(F.get("ordered", i + 1)["h"] == x["h"], F.lit(False))
    ))
    step = step.withColumn("starts", F.sort_array(F.transform(near, lambda x: x["i"]))).drop("ordered")
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(s - a["last"], F.lit(WINDOW))).alias("n"), s.alias("last")),
        lambda a: a["n"],
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")


# Bins of growing width: exact below 16, then eight for each doubling. Whole numbers only.
BIN_SQL = "case when v < 16 then v else (length(bin(v)) - 4) * 8 + shiftright(v, cast(length(bin(v)) - 4 as int)) end"
# The smallest value of a bin.
LOW_SQL = "case when b < 16 then b else shiftleft(b - 8 * (b div 8 - 1), cast(b div 8 - 1 as int)) end"
BROADCAST_ROWS = 200_000


def _key(column: str) -> Column:
    """A group's name as a key in which null is a value of its own."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(column)))


def sketches(measures: DataFrame) -> DataFrame:
    """lang_key, source_key, measure, b, n: one mergeable sketch for each group and measure."""
    values = F.array(*[
        F.struct(F.lit(name).alias("measure"), F.expr(f"({SCALE} * {top}) div nullif({below}, 0)").alias("v"))
        for name, (top, below, _, _) in MEASURES.items()
    ])
    rows = measures.select(_key("lang").alias("lang_key"), _key("source").alias("source_key"), F.explode(values).alias("m"))
    rows = rows.select("lang_key", "source_key", "m.measure", "m.v").filter(F.col("v").isNotNull())
    return rows.groupBy("lang_key", "source_key", "measure", F.expr(BIN_SQL).alias("b")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Lower and upper fence of each group and measure, read from merged sketches."""
    keys = [*by, "measure"]
    merged = sketch.groupBy(*keys, "b").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("b")
    merged = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    quarter = [F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.expr(LOW_SQL))).alias(f"q{k}") for k in (1, 2, 3)]
    found = merged.groupBy(*keys).agg(F.max("all").alias("size"), *quarter)
    wide = SPREAD * (F.col("q3") - F.col("q1"))
    least = reduce(
        lambda rest, item: F.when(F.col("measure") == item[0], F.lit(item[1][3])).otherwise(rest), MEASURES.items(), F.lit(0)
    )
    return found.select(
        *keys, "size",
        F.greatest(F.col("q3") + wide, F.col("q2") + least).alias("high"), F.least(F.col("q1") - wide, F.col("q2") - least).alias("low"),
    )


def thresholds(measures: DataFrame) -> DataFrame:
    """One row for each language and source with the fences that apply to it."""
    sketch = sketches(measures)
    own = fences(sketch, ["lang_key", "source_key"])
    language = fences(sketch, ["lang_key"]).select(
        "lang_key", "measure", F.col("size").alias("size1"), F.col("high").alias("high1"), F.col("low").alias("low1")
    )
    whole = fences(sketch, []).select("measure", F.col("high").alias("high2"), F.col("low").alias("low2"))
    joined = own.join(language, ["lang_key", "measure"]).join(whole, "measure")

    def chosen(name: str) -> Column:
        return F.when(F.col("size") >= MIN_GROUP, F.col(name)).when(F.col("size1") >= MIN_GROUP, F.col(f"{name}1")).otherwise(F.col(f"{name}2"))

    sides = [
        F.max(F.when(F.col("measure") == name, chosen(side))).alias(f"{side}_{name}")
        for name, (_, _, both, _) in MEASURES.items() for side in (("high", "low") if both else ("high",))
    ]
    return joined.groupBy("lang_key", "source_key").agg(*sides)


def judged(measures: DataFrame) -> DataFrame:
    """Measures with base_failed and kept. ``measures`` must be a stored table (it is read twice)."""
    limits = written(thresholds(measures), "quality-limits")
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    rows = measures.withColumns({"lang_key": _key("lang"), "source_key": _key("source")})
    rows = rows.join(limits, ["lang_key", "source_key"], "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    unusual = F.lit(False)
    for name, (top, below, both, _) in MEASURES.items():
        value = F.expr(f"({SCALE} * {top}) div nullif({below}, 0)")
        unusual = unusual | F.coalesce(value > F.col(f"high_{name}"), F.lit(False))
        if both:
            unusual = unusual | F.coalesce(value < F.col(f"low_{name}"), F.lit(False))
    return rows.withColumns({"base_failed": base, "kept": ~base & ~unusual})


REPORT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and the verdict."""
    return judged(written(text_measures(docs), "quality")).select(*REPORT)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(written(text_measures(docs, carry=True), "quality")).filter("kept").select("row.*")


SQL = f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('v' || lang, 'n') AS lang_key, coalesce('v' || source, 'n') AS source_key,
         coalesce(text, '') AS body FROM documents),
split AS (
  SELECT *, list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
runs AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS run
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM split)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, run) AS c FROM runs) WHERE c > 1),
covered AS (
  SELECT rid, sum(least(5, i - before)) AS n
  FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 5) AS before FROM twice) GROUP BY rid),
counted AS (
  SELECT rid, doc_id, lang_key, source_key, len(words)::BIGINT AS n_words, len(lines)::BIGINT AS n_lines,
         length(translate(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(body) - length(translate(body, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (rid)),
valued AS (
  {" UNION ALL ".join(
    f"SELECT rid, lang_key, source_key, '{name}' AS measure, {both} AS both_sides, {least} AS least_step, "
    f"({SCALE} * {top}) // {below} AS v FROM counted WHERE {below} > 0" for name, (top, below, both, least) in MEASURES.items())}),
binned AS (
  SELECT *, CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 4) * 8 + (v >> (length(bin(v)) - 4)) END AS b FROM valued),
groups AS (
  {" UNION ALL ".join(
    f"SELECT {level} AS level, {lang} AS lang_key, {source} AS source_key, measure, least_step, b, count(*) AS n FROM binned GROUP BY ALL"
    for level, lang, source in ((0, "lang_key", "source_key"), (1, "lang_key", "''"), (2, "''", "''")))}),
summed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang_key, source_key, measure ORDER BY b) AS upto,
         sum(n) OVER (PARTITION BY level, lang_key, source_key, measure) AS total,
         CASE WHEN b < 16 THEN b ELSE (b - 8 * (b // 8 - 1)) << (b // 8 - 1) END AS low FROM groups),
quarters AS (
  SELECT level, lang_key, source_key, measure, least_step, max(total) AS total, min(low) FILTER (4 * upto >= total) AS q1,
         min(low) FILTER (4 * upto >= 2 * total) AS q2, min(low) FILTER (4 * upto >= 3 * total) AS q3 FROM summed GROUP BY ALL),
fenced AS (
  SELECT *, greatest(q3 + {SPREAD} * (q3 - q1), q2 + least_step) AS high_fence, least(q1 - {SPREAD} * (q3 - q1), q2 - least_step) AS low_fence
  FROM quarters),
odd AS (
  SELECT DISTINCT rid FROM binned b
  JOIN fenced f0 ON f0.level = 0 AND f0.lang_key = b.lang_key AND f0.source_key = b.source_key AND f0.measure = b.measure
  JOIN fenced f1 ON f1.level = 1 AND f1.lang_key = b.lang_key AND f1.measure = b.measure
  JOIN fenced f2 ON f2.level = 2 AND f2.measure = b.measure
  WHERE v > CASE WHEN f0.total >= {MIN_GROUP} THEN f0.high_fence WHEN f1.total >= {MIN_GROUP} THEN f1.high_fence ELSE f2.high_fence END
     OR (both_sides AND v < CASE WHEN f0.total >= {MIN_GROUP} THEN f0.low_fence WHEN f1.total >= {MIN_GROUP} THEN f1.low_fence ELSE f2.low_fence END))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND odd.rid IS NULL AS kept
FROM counted LEFT JOIN odd USING (rid)
"""
