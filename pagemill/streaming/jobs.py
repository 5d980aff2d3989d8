"""Streaming jobs: live stage counters, first requests, and pages that are new or changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_progress(events: DataFrame) -> DataFrame:
    """(run_id, stage, event_type) stream → per run and stage: done, cache hits, calls, skipped. For update or complete mode."""
    def n(kind: str):
        return F.count_if(F.col("event_type") == kind)

    return events.groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("current"), n("cache_hit").alias("cache_hits"), n("api_call").alias("api_calls"), n("skipped").alias("skipped"))


def stream_misses(requests: DataFrame, responses: DataFrame, time: str = "ts", within: str = "1 hour") -> DataFrame:
    """Requests without a stored answer, the first of each key only while the key is in state.

    The watermark bounds that state; it is this library's choice: a key that comes again later passes again.
    """
    known = responses.select("cache_key").distinct()
    return requests.withWatermark(time, within).join(known, "cache_key", "left_anti").dropDuplicatesWithinWatermark(["cache_key"])


def page_digest(*columns: str):
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def changed_pages(pages: DataFrame, stored: DataFrame, *columns: str) -> DataFrame:
    """pages + digest, those whose (deck_id, slide_id, digest) isn't stored."""
    return pages.withColumn("digest", page_digest(*columns)).join(stored.select("deck_id", "slide_id", "digest"), ["deck_id", "slide_id", "digest"], "left_anti")


def upsert_pages(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the rows of new in place of those with the same page."""
    return stored.join(new.select("deck_id", "slide_id").distinct(), ["deck_id", "slide_id"], "left_anti").unionByName(new)


def start_pages(pages: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give each micro-batch of pages to ``step``, which compares digests, runs page operators and upserts."""
    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
