"""Job progress events to job state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.streaming.ordered import fold_in_order, timed


def job_state(events: DataFrame) -> DataFrame:
    """Later non-null fields overwrite earlier ones; the percent moves only when a total is known.

    One mergeable aggregate per field, so it serves a batch and a stream (update mode) alike.
    """
    pct = F.when(F.col("total") > 0, F.floor(F.col("done") * 100 / F.col("total")).cast("int"))

    def last(c):
        return F.max_by(c, F.when(c.isNotNull(), F.col("seq")))

    return events.groupBy("job").agg(
        F.max_by("stage", "seq").alias("stage"),
        F.max_by(F.coalesce("message", F.lit("")), "seq").alias("message"),
        F.coalesce(last(pct), F.lit(0)).alias("percent"),
        last(F.col("book_id")).alias("book_id"), last(F.col("chapters_ready")).alias("chapters_ready"),
        last(F.col("chapters_total")).alias("chapters_total"))


def newly_ready(versions: DataFrame) -> DataFrame:
    """Manifest versions at which the ready count or the status changed, with the gain.

    ``versions(book, version, chapters_ready, status)``.  Versions of one book are few and
    small; the scan is still blocked.
    """
    from bookflow.operators import scan
    d = scan.prev_value(versions, ["book"], ["version"], F.floor(F.col("version") / 4096),
                        _r=F.col("chapters_ready"), _s=F.col("status"))
    changed = ~F.col("chapters_ready").eqNullSafe(F.col("_r")) | ~F.col("status").eqNullSafe(F.col("_s"))
    return d.filter(changed).select("book", "version", "chapters_ready", "status", (
        F.col("chapters_ready") - F.coalesce("_r", F.lit(0))).alias("gained"))


def _changes(columns):
    ready, status, gained = (columns.index(c) for c in ("chapters_ready", "status", "gained"))

    def step(state, row):
        now = (row[ready], row[status])
        passed = (*row[:gained], now[0] - ((state and state[0]) or 0), *row[gained + 1:]) if now != state else None
        return now, passed
    return step


def newly_ready_stream(versions: DataFrame, bucket: int = 4096, late: str = "1 seconds") -> DataFrame:
    """Streaming ``newly_ready``; a version's number is its time, as versions only grow."""
    d = versions.withColumn("gained", F.lit(0).cast("long"))
    return fold_in_order(timed(d, "version", late), ["book"], "version", ["version"], _changes, bucket)
