"""Usage, cost, cache and stage timing on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage
from ..operators import usage as u
from . import bindings as b


def _records(s: SparkSession, d: str) -> DataFrame:
    e, status = b.table(s, d, "events"), F.element_at(F.array(*map(F.lit, ("local_hit", "miss", "skipped", "refresh"))), (F.col("event_id") % 4 + 1).cast("int"))
    tokens = F.floor(F.col("value") * 100).cast("bigint")
    return e.select(
        (F.col("user_id") % 100).alias("deck_id"), F.col("event_type").alias("stage"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), status.alias("cache_status"),
        (F.col("event_id") % 4 == 1).alias("llm_call"), F.lit(False).alias("api_call"), tokens.alias("input_tokens"), F.floor(tokens / 4).cast("bigint").alias("cached_input_tokens"), F.floor(tokens / 2).cast("bigint").alias("output_tokens"), (F.col("event_id") % 50).alias("text_chars"),
    )


def _prices(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("p0/m0", 1.0, 0.1, 2.0), ("m1", 3.0, None, 4.0), ("p2", 0.5, 0.25, 1.5)], "model_key string, input_per_1m double, cached_input_per_1m double, output_per_1m double")


def _costs(s: SparkSession, d: str) -> DataFrame:
    return u.llm_cost(u.with_prices(u.usage_summary(_records(s, d)), _prices(s)))


def _requests(s: SparkSession, d: str) -> DataFrame:
    return b.table(s, d, "events").select("event_id", F.sha2((F.col("user_id") % 500).cast("string"), 256).alias("cache_key"), (F.col("event_id") % 17 == 0).alias("refresh"), (F.col("event_id") % 13 == 0).alias("skipped"))


def _responses(s: SparkSession, d: str) -> DataFrame:
    return b.table(s, d, "customer").select(F.sha2((F.col("c_custkey") % 400).cast("string"), 256).alias("cache_key"), (F.col("c_custkey") % 3).cast("int").alias("schema_version"), F.col("c_name").alias("output_text"), F.col("c_custkey").alias("created_at"))


def _stages(s: SparkSession, d: str) -> DataFrame:
    return b.table(s, d, "events").groupBy((F.col("user_id") % 200).alias("run_id"), F.col("event_type").alias("stage")).agg(F.min("event_id").alias("pos"), F.round(F.sum("value"), 4).alias("elapsed"))


def _raw_usage(s: SparkSession, d: str) -> DataFrame:
    """Usage in the layouts of three providers."""
    e = b.table(s, d, "events").withColumn("k", F.col("event_id") % 3).withColumn("t", F.floor(F.col("value") * 100).cast("bigint"))
    one = F.to_json(F.struct(F.col("t").alias("prompt_tokens"), (F.col("t") + 1).alias("completion_tokens"), (F.col("t") * 3).alias("total_tokens")))
    two = F.to_json(F.struct(F.col("t").alias("promptTokenCount"), (F.col("t") + 2).alias("candidatesTokenCount"), F.lit(5).alias("cachedContentTokenCount")))
    three = F.to_json(F.struct(F.col("t").alias("input_tokens"), (F.col("t") + 3).alias("output_tokens"), F.lit(7).alias("cache_read_input_tokens")))
    return e.select("event_id", F.lit("p").alias("provider"), F.try_parse_json(F.when(F.col("k") == 0, one).when(F.col("k") == 1, two).otherwise(three)).alias("usage"))


def _reports(s: SparkSession, d: str) -> DataFrame:
    """A summary for one of two stages of each deck."""
    per = u.usage_summary(_records(s, d)).groupBy("deck_id", "stage").agg(F.sum("calls").alias("llm_calls"), F.sum("input_tokens").alias("input_tokens"))
    own = F.to_json(F.struct((F.col("llm_calls") + 1).alias("llm_calls"), "input_tokens"))
    return per.select("deck_id", "stage", F.try_parse_json(F.when(F.col("deck_id") % 2 == 0, own).otherwise("{}")).alias("summary"))


def _metrics(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).select("deck_id", "stage", "llm_call", "api_call", "cache_status", "input_tokens", F.col("cached_input_tokens").alias("provider_cached_input_tokens"), "output_tokens", F.lit(0).alias("total_tokens"), "text_chars")
    return u.usage_metrics(_reports(s, d), r)


def _rates(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("USD", 1.0), ("CNY", 7.0)], "currency string, rate double")


def _run(s: SparkSession, d: str) -> DataFrame:
    items = coverage.coverage_items(b.elements(s, d), b.notes(s, d))
    p = b.pages(s, d)
    decks = p.select("deck_id").distinct()
    used = decks.select("deck_id", F.lit(2).alias("calls"), F.lit(10).alias("input_tokens"), F.lit(5).alias("output_tokens"))
    pics = p.where("doc_id % 4 = 0").select("deck_id", F.when(F.col("doc_id") % 8 == 0, "figure_crop").otherwise("content").alias("role"))
    return u.run_summary(p.select("deck_id", (F.col("doc_id") % 3 == 0).alias("has_screenshot")), b.elements(s, d), pics, coverage.coverage_totals(items), used, b.note_blocks(s, d))


QUERIES = {
    "u3_normalize_usage": lambda s, d: u.normalize_usage(_raw_usage(s, d)).groupBy("provider").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")]),
    "u5_usage_metrics": lambda s, d: _metrics(s, d).select("deck_id", "stage", "calls", "input_tokens", "skipped"),
    "u8_currency": lambda s, d: u.with_currency(u.cost_report(_costs(s, d)), _rates(s), "cny").select("deck_id", "stage", "currency", F.round("estimated_cost", 3).alias("estimated_cost")),
    "u10_progress": lambda s, d: u.progress(b.table(s, d, "events").select((F.col("user_id") % 50).alias("run_id"), F.when(F.col("event_id") % 400 == 0, "done").otherwise("running").alias("status"), (F.col("event_id") % 10).alias("current"), F.lit(10).alias("total"))).select("run_id", "done", "percent"),
    "u11_run_summary": lambda s, d: _run(s, d).select("deck_id", "pages", "page_screenshots", "text_blocks", "images", "figure_crops", "note_blocks", "total", "covered", "missing", "calls"),
    "u1_cache_lookup": lambda s, d: u.cache_lookup(_requests(s, d), _responses(s, d)).select("event_id", "status", "output_text"),
    "u2_cache_upsert": lambda s, d: u.cache_upsert(_responses(s, d), _responses(s, d).withColumn("created_at", F.col("created_at") + 1)).select("cache_key", "output_text", "created_at", "prefix"),
    "u4_usage_summary": lambda s, d: u.usage_summary(_records(s, d)),
    "u7_llm_cost": lambda s, d: _costs(s, d).select("deck_id", "stage", "provider", "model", F.round("cost_usd", 8).alias("cost_usd")),
    "u8_cost_report": lambda s, d: u.cost_report(_costs(s, d), 7.0).withColumn("cost", F.round("cost", 3)),
    "u9_slowest_stages": lambda s, d: u.slowest_stages(_stages(s, d)),
}

_REC = r"""WITH rec AS (
  SELECT user_id % 100 AS deck_id, event_type AS stage, 'p' || (user_id % 3) AS provider, 'm' || (user_id % 5) AS model, event_id % 4 AS st, CAST(floor(value * 100) AS BIGINT) AS tok, event_id % 50 AS chars FROM events),
summary AS (
  SELECT deck_id, stage, provider, model, count(*) AS records, count_if(st = 1)::BIGINT AS calls, count_if(st = 0)::BIGINT AS local_cache_hits, count_if(st = 1)::BIGINT AS local_cache_misses, count_if(st = 2)::BIGINT AS skipped,
         sum(tok)::BIGINT AS input_tokens, sum(tok // 4)::BIGINT AS cached_input_tokens, sum(tok // 2)::BIGINT AS output_tokens, sum(chars)::BIGINT AS text_chars FROM rec GROUP BY ALL),
rates AS (
  SELECT *, CASE WHEN provider = 'p0' AND model = 'm0' THEN [1.0, 0.1, 2.0] WHEN model = 'm1' THEN [3.0, 3.0, 4.0] WHEN provider = 'p2' THEN [0.5, 0.25, 1.5] ELSE [0.0, 0.0, 0.0] END::DOUBLE[] AS r FROM summary),
costs AS (SELECT *, greatest(input_tokens - cached_input_tokens, 0) / 1e6 * r[1] + cached_input_tokens / 1e6 * r[2] + output_tokens / 1e6 * r[3] AS cost_usd FROM rates)"""
SQL = {
    "u3_normalize_usage": "WITH e AS (SELECT event_id % 3 AS k, CAST(floor(value * 100) AS BIGINT) AS t FROM events) SELECT 'p' AS provider, sum(t)::BIGINT AS input_tokens, sum(CASE k WHEN 1 THEN 5 WHEN 2 THEN 7 END)::BIGINT AS cached_input_tokens, sum(t + k + 1)::BIGINT AS output_tokens, sum(CASE k WHEN 0 THEN 3 * t ELSE 2 * t + k + 1 END)::BIGINT AS total_tokens FROM e",
    "u5_usage_metrics": _REC + " SELECT deck_id, stage, CASE WHEN deck_id % 2 = 0 THEN sum(calls) + 1 ELSE sum(calls) END::BIGINT AS calls, sum(input_tokens)::BIGINT AS input_tokens, CASE WHEN deck_id % 2 = 0 THEN 0 ELSE sum(skipped) END::BIGINT AS skipped FROM summary GROUP BY deck_id, stage",
    "u8_currency": _REC + " SELECT deck_id, stage, 'CNY' AS currency, round(round(sum(cost_usd), 8) * 7.0, 3) AS estimated_cost FROM costs GROUP BY ROLLUP (deck_id, stage)",
    "u10_progress": "SELECT user_id % 50 AS run_id, count_if(event_id % 400 = 0)::BIGINT AS done, round(greatest(0.02, least(0.98, (count_if(event_id % 400 = 0) + least(0.95, coalesce(max(event_id % 10) FILTER (event_id % 400 <> 0), 0) / 10)) / 13)), 6)::DOUBLE AS percent FROM events GROUP BY 1",
    "u11_run_summary": "WITH " + b.ITEMS_SQL + """, p AS (SELECT deck_id, count(*) AS pages, count_if(doc_id % 3 = 0)::BIGINT AS page_screenshots, count_if(doc_id % 4 = 0)::BIGINT AS images, count_if(doc_id % 8 = 0)::BIGINT AS figure_crops FROM pages GROUP BY deck_id),
        i AS (SELECT deck_id, count(*) AS total, count_if(trace_covered)::BIGINT AS covered FROM items GROUP BY deck_id), n AS (SELECT deck_id, count(*) AS n FROM note_blocks GROUP BY deck_id)
        SELECT deck_id, pages, page_screenshots, coalesce(total, 0) AS text_blocks, images, figure_crops, coalesce(n, 0) AS note_blocks, coalesce(total, 0) AS total, coalesce(covered, 0) AS covered, coalesce(total - covered, 0) AS missing, 2::BIGINT AS calls FROM p LEFT JOIN i USING (deck_id) LEFT JOIN n USING (deck_id)""",
    "u1_cache_lookup": r"""WITH good AS (SELECT sha256(CAST(c_custkey % 400 AS VARCHAR)) AS k, arg_max(c_name, c_custkey) AS t FROM customer WHERE c_custkey % 3 = 1 GROUP BY 1)
        SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'skipped' WHEN event_id % 17 = 0 THEN 'refresh' WHEN t IS NOT NULL THEN 'local_hit' ELSE 'miss' END AS status, CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN t END AS output_text
        FROM events LEFT JOIN good ON k = sha256(CAST(user_id % 500 AS VARCHAR))""",
    "u2_cache_upsert": r"SELECT sha256(CAST(c_custkey % 400 AS VARCHAR)) AS cache_key, arg_max(c_name, c_custkey) AS output_text, max(c_custkey) + 1 AS created_at, sha256(CAST(c_custkey % 400 AS VARCHAR))[1:2] AS prefix FROM customer GROUP BY c_custkey % 400",
    "u4_usage_summary": _REC + " SELECT * FROM summary",
    "u7_llm_cost": _REC + " SELECT deck_id, stage, provider, model, round(cost_usd, 8) AS cost_usd FROM costs",
    "u8_cost_report": _REC + " SELECT deck_id, stage, sum(calls)::BIGINT AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd) * 7.0, 3) AS cost FROM costs GROUP BY ROLLUP (deck_id, stage)",
    "u9_slowest_stages": r"""WITH st AS (SELECT user_id % 200 AS run_id, event_type AS stage, min(event_id) AS pos, round(sum(value), 4) AS elapsed FROM events GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY elapsed DESC, pos) AS INTEGER) AS rank FROM st QUALIFY rank <= 3""",
}
