"""Detection, throttling and sessions over streams.

A stream of crawl documents gives the same findings per page as a batch of them; only grouping over pages
waits for the whole crawl. Sessions and windows over events are an extension of the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewarden.operators import screens
from pagewarden.operators.evidence import Settings
from pagewarden.operators.screens import BACKOFF_LEAST, BACKOFF_MOST, FORBIDDEN_RUN, STOP_AFTER
from pagewarden.plans import detect, shared
from pagewarden.sources import crawl


def crawl_stream(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """Crawl documents as they arrive in a folder."""
    found = spark.readStream.schema(crawl.CRAWL).option("multiLine", True).option("maxFilesPerTrigger", per_trigger).json(path)
    return found.select(F.col("_metadata.file_path").alias("crawl_id"), "*")


def detect_stream(crawls: DataFrame, out: str, checkpoint: str, settings: Settings | None = None, **trigger) -> StreamingQuery:
    """Write the page findings of each batch to a folder of its own number, so that a batch that runs again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        before = len(shared.WRITTEN[batch.sparkSession.sparkContext.applicationId])
        detect.page_findings(batch, settings).write.mode("overwrite").parquet(f"{out}/batch={number}")
        shared.forget(batch.sparkSession, before)

    return crawls.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


THROTTLE_OUT = "site string, seq long, reason string, delay_sec double, wait_sec double, stops boolean"
THROTTLE_STATE = "delay double, streak int, forbidden int, last long"


def throttle_stream(visits: DataFrame, delay: float = 1.0) -> DataFrame:
    """Throttlings of a stream of visits (site, seq, status, retry_after, limited), with the delays that follow.

    State per site: delay, throttlings and 403s in a row, last visit. Visits of a batch are taken in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, streak, forbidden, last = state.get if state.exists else (delay, 0, 0, -1)
        out = []
        for v in pd.concat(list(batches)).sort_values("seq").itertuples():
            forbidden = forbidden + 1 if v.status == 403 else 0
            asked = str(v.retry_after or "").strip()
            reason = (
                "HTTP 429" if v.status == 429 else "HTTP 503" if v.status == 503 and asked else "HTTP 403" if forbidden >= FORBIDDEN_RUN else "limited" if v.limited else ""
            )
            streak, last = streak + 1 if reason else 0, int(v.seq)
            if reason:
                now = min(BACKOFF_MOST, max(2 * now, BACKOFF_LEAST))
                wait = min(2 * BACKOFF_MOST, max(now, float(asked))) if asked.isdigit() else now
                out.append((key[0], int(v.seq), reason, now, wait, streak >= STOP_AFTER))
        state.update((now, streak, forbidden, last))
        yield pd.DataFrame(out, columns=["site", "seq", "reason", "delay_sec", "wait_sec", "stops"])

    return visits.groupBy("site").applyInPandasWithState(step, THROTTLE_OUT, THROTTLE_STATE, "append", "NoTimeout")


def new_addresses(found: DataFrame, time_col: str = "at", late: str = "1 day") -> DataFrame:
    """A stream of addresses (url, at) without those seen within the watermark."""
    return found.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["url"])


def screen_counts(pages: DataFrame, time_col: str = "at", late: str = "1 day") -> DataFrame:
    """(site, screen, title, count, first_url): how many addresses of a stream of pages (site, url, title, text, at) have shown a screen so far.

    Addresses count once within the watermark. Written in update mode; a screen is a duplicate from two on.
    """
    screen = F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.substring(screens.spaceless(F.col("text")), 1, screens.SCREEN_TEXT)), 256)
    seen = pages.where(F.length(screens.spaceless(F.col("text"))) >= screens.LEAST_SCREEN).withColumn("screen", screen)
    once = seen.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["site", "screen", "url"]) if pages.isStreaming else seen.dropDuplicates(["site", "screen", "url"])
    return once.groupBy("site", "screen").agg(F.first("title").alias("title"), F.count("*").alias("count"), F.min("url").alias("first_url"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: (user_id, start, stop, n_events, total). Works on streams and on tables alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    groups = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return groups.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n_events", "total")


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by type in tumbling or sliding windows."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    groups = timed.groupBy(F.window("ts", size, slide or size).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return groups.select(F.col("w.start").alias("start"), "event_type", "n_events", "total")
