"""Registered queries of this package, with SQL beside those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dinestat.llm import (
    decontaminate,
    filter_audit,
    katz,
    language,
    licenses,
    neardup,
    packing,
    pii,
    quality_rules,
    sitequality,
    toxicity,
    urls,
    whitening,
)
from dinestat.llm.common import held_out

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_quality(spark, folder):
    """Documents by the host and path of their page, else of their source."""
    docs = table(spark, folder, "documents")
    of_page = sitequality.page_sites(table(spark, folder, "pages"))
    return sitequality.site_quality(docs, table(spark, folder, "labels"), of_page, source_col="source")


@query
def op2_pii(spark, folder):
    return pii.personal_data(table(spark, folder, "documents"))


@query
def op3_licenses(spark, folder):
    return licenses.license_scan(table(spark, folder, "documents"))


@query
def op4_near_duplicates(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op5_packing(spark, folder):
    return packing.packed(table(spark, folder, "documents"), near=True)


@query
def op6_toxicity(spark, folder):
    scored = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages"
    )


@query
def op7_language(spark, folder):
    found = language.identify_language(table(spark, folder, "documents"))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


@query
def op9_url_filters(spark, folder):
    return urls.url_filter(table(spark, folder, "pages"))


@query
def op10_quality_rules(spark, folder):
    return quality_rules.quality_rules(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


@query
def op8_decontamination(spark, folder):
    spans = decontaminate.contaminated_spans(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return decontaminate.digest(spans)


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
)

ORACLE["op8_decontamination"] = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM windows),
texts AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM texts, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
),
found AS (SELECT doc_id, item_id, n, i FROM grams JOIN windows USING (n, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM found, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id
),
ids AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query
def op13_filter_audit(spark, folder):
    return filter_audit.filter_audit(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


ORACLE["op13_filter_audit"] = """
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
worded AS (
  SELECT doc_id, part, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, length(t) AS chars,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper,
    regexp_matches(t, '[#$%&*|]') AS symbols, coalesce(doc_id > first, FALSE) AS copied
  FROM texts JOIN firsts USING (t)
),
marks AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * upper > 5 * chars)::INT + 8 * symbols::INT + 16 * copied::INT AS mask
  FROM worded
),
sides AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic
  FROM labels GROUP BY doc_id
),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM marks LEFT JOIN sides USING (doc_id) GROUP BY part, mask
),
letters(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT concat(p.f, q.f, r.f, s.f, t.f) AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE (p.b | q.b | r.b | s.b | t.b) = 31
),
steps AS (
  SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS bit,
    CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS before
  FROM orders, unnest(range(1, 6)) AS u(i)
),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept,
    sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost,
    sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM counted
"""


@query
def op11_embedding_whitening(spark, folder):
    return whitening.whitened(table(spark, folder, "embeddings"))


@query
def op12_lm_scoring(spark, folder):
    docs = table(spark, folder, "documents")
    scored = katz.language_model_scores(docs)
    return scored.select(
        "doc_id", (~katz.learnable(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score",
    )
