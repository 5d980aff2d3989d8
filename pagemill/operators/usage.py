"""Response cache, usage, prices, cost and stage timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a table of prices or rates is sent to every task.
SMALL = 100_000


def _small(df: DataFrame) -> DataFrame:
    """A dimension table, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def cache_lookup(requests: DataFrame, responses: DataFrame, mode: str = "on", schema_version: int = 1) -> DataFrame:
    """requests (cache_key, slide_id, refresh, skipped) + output_text, status: local_hit, miss, refresh, disabled or skipped.

    A stored row counts only with the schema version and a text. Of rows with one key the last written counts.
    """
    good = responses.where((F.col("schema_version") == schema_version) & F.col("output_text").isNotNull())
    last = good.groupBy("cache_key").agg(F.max_by("output_text", "created_at").alias("output_text"))
    joined = requests.join(last, "cache_key", "left")
    status = (
        F.when(F.col("skipped"), "skipped").when(F.lit(mode == "off"), "disabled").when(F.lit(mode == "refresh") | F.col("refresh"), "refresh")
        .when(F.col("output_text").isNotNull(), "local_hit").otherwise("miss")
    )
    return joined.withColumn("status", status).withColumn("output_text", F.when(F.col("status") == "local_hit", F.col("output_text")))


def cache_upsert(responses: DataFrame, new: DataFrame) -> DataFrame:
    """Of each key the row written last, with the prefix by which the table is partitioned."""
    both = responses.unionByName(new)
    cols = [c for c in both.columns if c not in ("cache_key", "prefix")]
    last = both.groupBy("cache_key").agg(F.max_by(F.struct(*cols), "created_at").alias("r"))
    return last.select("cache_key", *[F.col(f"r.{c}").alias(c) for c in cols], F.substring("cache_key", 1, 2).alias("prefix"))


def usage_summary(records: DataFrame) -> DataFrame:
    """Per deck and stage: calls, cache results and token sums; what is no integer counts as 0."""
    def total(name: str):
        return F.sum(F.coalesce(F.col(name).try_cast("bigint"), F.lit(0).cast("bigint"))).alias(name)

    return records.groupBy("deck_id", "stage", "provider", "model").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.coalesce("llm_call", F.lit(False)) | F.coalesce("api_call", F.lit(False))).alias("calls"),
        *[F.count_if(F.col("cache_status") == s).alias(n) for s, n in (("local_hit", "local_cache_hits"), ("miss", "local_cache_misses"), ("skipped", "skipped"))],
        *([total("api_retries")] if "api_retries" in records.columns else []), total("input_tokens"), total("cached_input_tokens"), total("output_tokens"), total("text_chars"),
    )


def with_prices(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """usage + rates: the price of provider/model, else of the model, else of the provider, as a whole; else 0."""
    rate = F.struct("input_per_1m", F.coalesce("cached_input_per_1m", "input_per_1m").alias("cached_input_per_1m"), "output_per_1m")
    prices = _small(pricing.select("model_key", rate.alias("rate")))
    out = usage
    for i, key in enumerate((F.concat("provider", F.lit("/"), "model"), F.col("model"), F.col("provider"))):
        out = out.withColumn(f"_k{i}", key).join(prices.select(F.col("model_key").alias(f"_k{i}"), F.col("rate").alias(f"_r{i}")), f"_k{i}", "left")
    found = F.coalesce("_r0", "_r1", "_r2")
    zero = F.lit(0.0)
    return out.select(*usage.columns, *[F.coalesce(found[c], zero).alias(c) for c in ("input_per_1m", "cached_input_per_1m", "output_per_1m")])


def llm_cost(priced: DataFrame) -> DataFrame:
    fresh = F.greatest(F.col("input_tokens") - F.col("cached_input_tokens"), F.lit(0))
    cost = fresh / 1e6 * F.col("input_per_1m") + F.col("cached_input_tokens") / 1e6 * F.col("cached_input_per_1m") + F.col("output_tokens") / 1e6 * F.col("output_per_1m")
    return priced.withColumn("cost_usd", cost)


def ocr_cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    joined = usage.join(_small(pricing), "provider", "left")
    cost = F.col("calls") / 1e3 * F.coalesce("per_1k_calls", F.lit(0.0)) + F.col("text_chars") / 1e3 * F.coalesce("per_1k_chars", F.lit(0.0))
    return joined.withColumn("cost_usd", cost).drop("per_1k_calls", "per_1k_chars")


def usage_metrics(reports: DataFrame, records: DataFrame) -> DataFrame:
    """Numbers of each (deck_id, stage): those of the report's summary where it has one, else sums over its records.

    reports: deck_id, stage, summary VARIANT (null or empty: none). records: deck_id, stage, llm_call, api_call,
    cache_status, input_tokens, provider_cached_input_tokens, output_tokens, total_tokens, text_chars.
    """
    numbers = {"local_cache_hits": "local_cache_hits", "local_cache_misses": "local_cache_misses", "skipped": "skipped", "input_tokens": "input_tokens", "cached_input_tokens": "provider_cached_input_tokens", "output_tokens": "output_tokens", "total_tokens": "total_tokens", "text_chars": "text_chars"}
    zero = F.lit(0).cast("bigint")
    get = lambda n: F.coalesce(F.try_variant_get("summary", f"$.{n}", "bigint"), zero)
    filled = F.coalesce(F.to_json("summary").isNotNull() & (F.to_json("summary") != "{}"), F.lit(False))
    given = reports.withColumn("_has", filled)
    calls = F.when(get("llm_calls") != 0, get("llm_calls")).otherwise(get("api_calls"))
    a = given.where("_has").select("deck_id", "stage", calls.alias("calls"), *[get(v).alias(k) for k, v in numbers.items()])
    add = lambda c: F.sum(F.coalesce(F.col(c).try_cast("bigint"), zero))
    hit = lambda s: F.count_if(F.col("cache_status") == s)
    sums = {"local_cache_hits": hit("local_hit"), "local_cache_misses": hit("miss"), "skipped": hit("skipped")}
    r = records.groupBy("deck_id", "stage").agg(F.count_if(F.coalesce("llm_call", F.lit(False)) | F.coalesce("api_call", F.lit(False))).alias("calls"), *[(sums[k] if k in sums else add(v)).alias(k) for k, v in numbers.items()])
    b = given.where("not _has").select("deck_id", "stage").join(r, ["deck_id", "stage"], "left").na.fill(0)
    return a.unionByName(b)


def cost_report(costs: DataFrame, rate: float = 1.0) -> DataFrame:
    """Cost per deck and stage, per deck (stage null) and in all (both null), converted and rounded to eight digits."""
    return costs.rollup("deck_id", "stage").agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd") * rate, 8).alias("cost"))


def with_currency(report: DataFrame, rates: DataFrame, currency: str) -> DataFrame:
    """cost_report + currency and estimated_cost by the table of rates (currency, rate from USD); an unknown currency has rate 1."""
    rate = _small(rates.where(F.upper("currency") == currency.upper()).groupBy().agg(F.coalesce(F.max("rate"), F.lit(1.0)).alias("_rate")))
    return report.crossJoin(rate).withColumn("currency", F.lit(currency.upper())).withColumn("estimated_cost", F.round(F.col("cost") * F.col("_rate"), 8)).drop("_rate")


def slowest_stages(stages: DataFrame, most: int = 3) -> DataFrame:
    """(run_id, stage, pos, elapsed) → the slowest of each run, the earlier of equals first."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("elapsed").desc(), "pos"))
    return stages.withColumn("rank", rank).where(F.col("rank") <= most)


def progress(stages: DataFrame, expected: int = 13) -> DataFrame:
    """Per run: stages done, percent, and the seconds left at the pace so far.

    percent: done stages and the part of the current one (at most 0.95) over the expected number, 0.02 to 0.98.
    elapsed is optional; without it, or before anything is done, the time left is null.
    """
    done, part = F.count_if(F.col("status") == "done"), F.coalesce(F.max(F.when(F.col("status") == "running", F.try_divide(F.col("current"), F.col("total")))), F.lit(0.0))
    share = (done + F.least(part, F.lit(0.95))) / expected
    spent = F.sum("elapsed") if "elapsed" in stages.columns else F.lit(None).cast("double")
    per = stages.groupBy("run_id").agg(done.alias("done"), F.round(F.greatest(F.lit(0.02), F.least(F.lit(0.98), share)), 6).alias("percent"), spent.alias("_spent"))
    left = F.when(F.col("done") > 0, F.round(F.col("_spent") * (1 - F.col("percent")) / F.col("percent"), 3))
    return per.withColumn("eta", left).drop("_spent")


def run_summary(pages: DataFrame, elements: DataFrame, images: DataFrame, coverage: DataFrame, usage: DataFrame, note_blocks: DataFrame) -> DataFrame:
    """One row per deck: pages, elements of each kind, crops and composites, coverage totals, calls and tokens, note blocks.

    pages: has_screenshot. coverage: the columns of coverage_totals. Each table is aggregated by deck before it joins.
    """
    p = pages.groupBy("deck_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("has_screenshot").alias("page_screenshots"))
    e = elements.groupBy("deck_id").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("text", "text_blocks"), ("table", "tables"))])
    i = images.groupBy("deck_id").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("role") == "figure_crop").alias("figure_crops"), F.count_if(F.col("role") == "composite_figure").alias("composite_figures"))
    c = coverage.select("deck_id", "total", "covered", (F.col("total") - F.col("covered")).alias("missing"), "ratio", "visible_ratio", "required_ratio")
    u = usage.groupBy("deck_id").agg(*[F.sum(x).alias(x) for x in ("calls", "input_tokens", "output_tokens")])
    n = note_blocks.groupBy("deck_id").agg(F.count(F.lit(1)).alias("note_blocks"))
    out = p
    for child in (e, i, c, u, n):
        out = out.join(child, "deck_id", "left")
    counts = ["text_blocks", "tables", "images", "figure_crops", "composite_figures", "calls", "input_tokens", "output_tokens", "note_blocks", "total", "covered", "missing"]
    return out.na.fill(0, counts).na.fill(1.0, ["ratio", "visible_ratio", "required_ratio"])


def normalize_usage(raw: DataFrame) -> DataFrame:
    """(provider, usage VARIANT) → input, cached, output and total tokens of three providers' layouts; total adds up where it isn't given."""
    def first(*paths: str):
        return F.coalesce(*[F.try_variant_get("usage", p, "bigint") for p in paths])

    i = first("$.input_tokens", "$.prompt_tokens", "$.promptTokenCount")
    o = first("$.output_tokens", "$.completion_tokens", "$.candidatesTokenCount")
    c = first("$.input_tokens_details.cached_tokens", "$.cachedContentTokenCount", "$.cache_read_input_tokens")
    return raw.select("provider", i.alias("input_tokens"), c.alias("cached_input_tokens"), o.alias("output_tokens"), F.coalesce(first("$.total_tokens", "$.totalTokenCount"), i + o).alias("total_tokens"))
