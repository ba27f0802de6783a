"""The checked queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import automata, centroids, decontaminate, fuzzy_lines, html_text, jaccard_join, language, minhash, quality, ranked_search, sharding, suffix_array
from .common import table
from .packing import pack_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents"))


ORACLES["op7_quality_rules"] = quality.SQL


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return automata.remove_repeated_words(table(spark, folder, "documents")).drop("text")


ORACLES["op5_substring_dedup"] = """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
runs AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS run
         FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM words)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM words),
kept AS (
  SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.i) AS text, count(*) AS n
  FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.i = each.i WHERE gone.i IS NULL GROUP BY each.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@query
def op10_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_array.remove_repeated_bytes(table(spark, folder, "documents")).drop("text")


ORACLES["op10_suffix_array_dedup"] = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
runs AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS run FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM bytes)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY run) AS c FROM runs) WHERE c > 1),
edges AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM twice),
grouped AS (SELECT doc_id, i, sum(CASE WHEN prev IS NULL OR i > prev + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edges),
spans AS (SELECT doc_id, g, min(i) AS low, max(i) + 200 AS high FROM grouped GROUP BY doc_id, g),
parts AS (
  SELECT doc_id, low AS stop, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS start FROM spans
  UNION ALL SELECT b.doc_id, b.n, coalesce(max(s.high), 0) FROM bytes b LEFT JOIN spans s USING (doc_id) GROUP BY b.doc_id, b.n),
kept AS (
  SELECT p.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS h, count(*) - 1 AS n_spans
  FROM parts p JOIN bytes USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, (n - length(kept.h) // 2)::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM bytes JOIN kept USING (doc_id)
"""


@query
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_pages(table(spark, folder, "pages"))


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


@query
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy_lines.line_report(table(spark, folder, "documents"))


@query
def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


ORACLES["op4_minhash_near_dedup"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM words WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * pairs.n >= 75 * (p.n + q.n - pairs.n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, s.b FROM reach r JOIN sides s ON s.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) JOIN least ON least.doc_id = w.doc_id
"""


@query
def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_rows(table(spark, folder, "documents")).drop("set_key")


ORACLES["op11_jaccard_join"] = jaccard_join.SQL


@query
def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, folder, "embeddings")).drop("centroid")


ORACLES["op12_centroid_clustering"] = centroids.cluster_sql()


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op13_ranked_search"] = ranked_search.SQL
