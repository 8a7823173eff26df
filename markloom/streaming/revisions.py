"""Streams of page revisions. These are additions of this engine: the same operators, on readStream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.config import DEFAULT, SiteConfig
from markloom.plans.parse import parse


def nodes(revisions: DataFrame, config: SiteConfig = DEFAULT, **kw) -> DataFrame:
    """Node rows of each revision as it arrives."""
    return parse(revisions, config, **kw)


def newest(revisions: DataFrame) -> DataFrame:
    """The latest revision of each page of a batch."""
    last = F.max_by(F.struct("rev_id", "ts", "text"), F.struct("ts", "rev_id")).alias("r")
    return revisions.groupBy("page_id").agg(last).select("page_id", "r.rev_id", "r.ts", "r.text")


def newest_stream(revisions: DataFrame, delay: str = "1 hour", idle_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """Revisions that are the latest of their page when they arrive: page_id, rev_id, ts, text.

    The state of a page is a time and a number, never a text, and goes when the page has been
    idle for so long in event time; a sink that keeps the last row of each page then holds
    the newest revisions.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        seen = tuple(state.get) if state.exists else (-1, -1)
        best = None
        for frame in batches:
            when = frame["ts"].astype("datetime64[us]").astype("int64")
            row = frame.assign(_t=when).sort_values(["_t", "rev_id"]).iloc[-1]
            if (int(row["_t"]), int(row["rev_id"])) > seen:
                seen, best = (int(row["_t"]), int(row["rev_id"])), row
        state.update(seen)
        state.setTimeoutTimestamp(max(seen[0] // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        if best is not None:
            yield pd.DataFrame({"page_id": [key[0]], "rev_id": [best["rev_id"]], "ts": [best["ts"]], "text": [best["text"]]})

    rows = revisions.select("page_id", "rev_id", "ts", "text").withWatermark("ts", delay)
    schema = "page_id long, rev_id long, ts timestamp, text string"
    return rows.groupBy("page_id").applyInPandasWithState(step, schema, "t long, rev long", "update", GroupStateTimeout.EventTimeTimeout)


def distinct_revisions(revisions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Repeated deliveries dropped within the watermark."""
    return revisions.withWatermark("ts", delay).withColumn("rev_hash", F.xxhash64("text")).dropDuplicatesWithinWatermark(["page_id", "rev_hash"])


def rule_counts(reports: DataFrame, width: str = "10 minutes", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """reports(ts, rule) -> counts per time window and rule; late rows beyond the watermark are dropped."""
    stream = reports.withWatermark("ts", delay) if reports.isStreaming else reports
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.groupBy(w.alias("w"), "rule").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "rule", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Edit sessions per page."""
    stream = events.withWatermark("ts", delay) if events.isStreaming else events
    return stream.groupBy(F.session_window("ts", gap).alias("s"), "page_id").agg(F.count(F.lit(1)).alias("n")).select("page_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
