"""Reading progress: debounced writes, newest positions, following another device.

Each rule comes as a batch form over a table (blocked scans, so a hot device or user is
split) and as a Structured Streaming form with bounded state per key.  The watermark only
bounds state; lateness is decided by the stamp alone.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bookflow.operators import scan
from bookflow.streaming.ordered import fold_in_order, timed

WEB_DEBOUNCE_MS, PHONE_DEBOUNCE_MS = 1500, 1000
FOLLOW_MS = 12_000
TICK_MS = 200
HOUR_MS = 3_600_000


def _hour(ts: str = "updated") -> Column:
    return F.floor(F.col(ts) / HOUR_MS)


# ---- batch forms -----------------------------------------------------------------------------

def debounce(progress: DataFrame, gap_ms: int = WEB_DEBOUNCE_MS) -> DataFrame:
    """Writes after ``gap_ms`` of silence per device; the newest position per book survives.

    ``progress(device, book, updated, seq, …)``; adds ``burst`` and ``flushed`` (epoch ms).
    """
    d = scan.sessions(progress, ["device"], "updated", gap_ms, _hour(), "burst", "seq")
    end = d.groupBy("device", "burst").agg((F.max("updated") + gap_ms).alias("flushed"))
    rest = [c for c in progress.columns if c not in ("device", "book")]
    last = d.groupBy("device", "burst", "book").agg(
        F.max_by(F.struct(*rest), F.struct("updated", "seq")).alias("r"))
    return last.join(end, ["device", "burst"]).select("device", "book", "burst", "flushed", "r.*")


def latest_positions(progress: DataFrame) -> DataFrame:
    """Newest position per (user, book); combined before the shuffle.  Works on streams too."""
    rest = [c for c in progress.columns if c not in ("user", "book")]
    by = F.struct(*[c for c in ("updated", "seq") if c in rest])
    return progress.groupBy("user", "book").agg(F.max_by(F.struct(*rest), by).alias("r")).select(
        "user", "book", "r.*")


def usable(progress: DataFrame, playable: DataFrame | None = None, viewer: Column | None = None) -> DataFrame:
    """Stateless half of the accept rule: only playable chapters can be mirrored; a position without a chapter, and what the viewer wrote, stay."""
    if playable is None:
        return progress
    ready = playable.select("book", F.col("ch").cast("int").alias("ci"), F.lit(True).alias("_ok")).distinct()
    own = F.col("device") == viewer if viewer is not None else F.lit(False)
    return progress.join(ready, ["book", "ci"], "left").filter(F.col("_ok") | F.col("ci").isNull() | own).select(*progress.columns)


def accepted(progress: DataFrame, viewer: Column, paused: Column | None = None) -> DataFrame:
    """Remote updates a viewer adopts: not its own, strictly newer than all it adopted or wrote.

    ``paused`` is true where the viewer's own playback stood still; while it plays, remote
    updates are ignored and do not count as adopted.
    """
    own = F.col("device") == viewer
    d = progress.filter(own | (paused if paused is not None else F.lit(True)))
    d = scan.prefix_max(d, ["user", "book"], ["seq"], F.floor(F.col("seq") / 4096), _last=F.col("updated"))
    return d.filter(~own & (F.col("updated") > F.coalesce("_last", F.lit(0)))).drop("_last")


def follow_sessions(adopted: DataFrame, window_ms: int = FOLLOW_MS) -> DataFrame:
    """Spans during which a viewer follows another device; silence of ``window_ms`` ends one."""
    d = scan.sessions(adopted, ["user", "book"], "updated", window_ms, _hour(), "follow", "seq")
    return d.groupBy("user", "book", "follow").agg(
        F.min("updated").alias("started"), (F.max("updated") + window_ms).alias("ended"),
        F.count("*").alias("n_updates"))


def throttle(ticks: DataFrame, every_ms: int = TICK_MS) -> DataFrame:
    """Ticks that notify: the sentence changed, or ``every_ms`` passed since the last notice.

    State of the fold: milliseconds since the last notice, capped at ``every_ms``.
    """
    blk = _hour("ms")
    d = scan.prev_value(ticks, ["session"], ["ms", "seq"], blk, _pm=F.col("ms"), _psi=F.col("si"))
    d = d.withColumns({
        "_d": F.least(F.lit(every_ms), F.coalesce(F.col("ms") - F.col("_pm"), F.lit(every_ms))).cast("int"),
        "_c": (F.col("_pm").isNull() | ~F.col("si").eqNullSafe(F.col("_psi"))).cast("int")})

    d = scan.finite_state(d, ["session"], ["ms", "seq"], blk, ["_d", "_c"], every_ms + 1,
                          scan.ResetSum(every_ms, every_ms + 1),
                          start=every_ms, name="_s")
    return d.filter((F.col("_s") + F.col("_d") >= every_ms) | (F.col("_c") == 1)).drop(
        "_pm", "_psi", "_d", "_c", "_s")


# ---- streaming forms -------------------------------------------------------------------------

POSITION = "device string, book string, ci int, t double, si int, frac double, updated long, seq long"


class _Debounce(StatefulProcessor):
    """Open bursts of one device, and in each the newest position per book.

    A burst is a span of time that rows extend or join to others, so rows may come in any order; its timer flushes it
    when the watermark has passed its silence. A burst is one entry of the state under its last stamp: read once for each
    micro-batch, written only if it has changed.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bursts = handle.getMapState("bursts", "last long", "start long, books string")

    def _due(self, last: int) -> int:
        return last + self.gap + 1                    # a row at last + gap still belongs to the burst

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = {int(k[0]): (int(v[0]), v[1]) for k, v in self.bursts.iterator()}
        spans = sorted((start, last) for last, (start, _) in stored.items())
        held: dict[tuple[int, int], dict] = {}        # spans that this micro-batch has touched
        for chunk in rows:
            chunk = chunk.sort_values(["updated", "seq"])
            stamps = chunk["updated"].to_numpy()
            cuts = np.flatnonzero(np.diff(stamps) > self.gap) + 1
            own = list(zip(chunk["book"].tolist(), chunk["ci"].tolist(), chunk["t"].tolist(), chunk["si"].tolist(), chunk["frac"].tolist(),
                           chunk["updated"].tolist(), chunk["seq"].tolist(), strict=True))
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
                self._add(spans, held, stored, own[lo:hi])
        left = {last for _, last in spans}
        for last in stored:
            if last not in left:
                self.bursts.removeKey((last,))
                self.handle.deleteTimer(self._due(last))
        for (start, last), books in held.items():
            self.bursts.updateValue((last,), (start, json.dumps(list(books.values()))))
            if last not in stored:
                self.handle.registerTimer(self._due(last))
        yield pd.DataFrame(columns=FLUSHED)

    def _add(self, spans: list, held: dict, stored: dict, own: list[tuple]) -> None:
        first, last = own[0][5], own[-1][5]
        lo = bisect_left(spans, (first, first))
        while lo > 0 and spans[lo - 1][1] + self.gap >= first:
            lo -= 1
        hi = lo
        while hi < len(spans) and spans[hi][0] - self.gap <= last:
            hi += 1
        books: dict[str, tuple] = {}
        for span in spans[lo:hi]:
            known = held.pop(span, None)
            for v in known.values() if known is not None else json.loads(stored[span[1]][1]):
                books[v[0]] = max(books.get(v[0], tuple(v)), tuple(v), key=lambda x: x[5:7])
        for v in own:
            books[v[0]] = max(books.get(v[0], v), v, key=lambda x: x[5:7])
        whole = (min([first, *(s for s, _ in spans[lo:hi])]), max([last, *(e for _, e in spans[lo:hi])]))
        spans[lo:hi] = [whole]
        held[whole] = books

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = expiredTimerInfo.getExpiryTimeInMs() - self.gap - 1
        books = json.loads(self.bursts.getValue((last,))[1]) if self.bursts.containsKey((last,)) else []
        self.bursts.removeKey((last,))
        yield pd.DataFrame([(key[0], v[0], last + self.gap, *v[1:]) for v in books], columns=FLUSHED)

    def close(self) -> None:
        pass


FLUSHED = ["device", "book", "flushed", "ci", "t", "si", "frac", "updated", "seq"]
FLUSHED_SCHEMA = ("device string, book string, flushed long, ci int, t double, si int, frac double, "
                  "updated long, seq long")


def debounce_stream(progress: DataFrame, gap_ms: int = WEB_DEBOUNCE_MS, late: str = "10 seconds") -> DataFrame:
    """Streaming ``debounce``; event-time timers, so replays give the same writes.

    Needs the RocksDB state store. State per device: its open bursts, one position per book of each.
    """
    d = progress.withColumn("event_time", F.timestamp_millis("updated")).withWatermark("event_time", late)
    return d.groupBy("device").transformWithStateInPandas(
        _Debounce(gap_ms), outputStructType=FLUSHED_SCHEMA, outputMode="Append", timeMode="EventTime")


def _adopt(viewer: str):
    def fold(columns):
        device, updated = columns.index("device"), columns.index("updated")

        def step(state, row):
            last = state[0] if state else 0
            return (max(last, row[updated]),), row if row[device] != viewer and row[updated] > last else None
        return step
    return fold


def accept_stream(progress: DataFrame, viewer: str, paused: Column | None = None, playable: DataFrame | None = None, arrived: str = "arrived",
                  bucket_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """Streaming ``accepted`` over ``usable`` updates; ``arrived`` (epoch ms) and ``seq`` give the order of arrival."""
    own = F.col("device") == viewer
    d = timed(progress, arrived, late)
    d = usable(d.filter(own | (paused if paused is not None else F.lit(True))), playable, F.lit(viewer))
    return fold_in_order(d, ["user", "book"], arrived, [arrived, "seq"], _adopt(viewer), bucket_ms)


def _notify(every_ms: int):
    def fold(columns):
        ms, si = columns.index("ms"), columns.index("si")

        def step(state, row):
            emit = state is None or row[si] != state[1] or row[ms] - state[0] >= every_ms
            return (row[ms] if emit else state[0], row[si]), row if emit else None
        return step
    return fold


def throttle_stream(ticks: DataFrame, every_ms: int = TICK_MS, bucket_ms: int = 10_000, late: str = "1 seconds") -> DataFrame:
    """Streaming ``throttle``."""
    return fold_in_order(timed(ticks, "ms", late), ["session"], "ms", ["ms", "seq"], _notify(every_ms), bucket_ms)


def follow_stream(adopted: DataFrame, window: str = "12 seconds", late: str = "10 seconds") -> DataFrame:
    """Streaming ``follow_sessions`` on the built-in session window."""
    d = adopted.withColumn("event_time", F.timestamp_millis("updated")).withWatermark("event_time", late)
    return d.groupBy("user", "book", F.session_window("event_time", window).alias("w")).agg(
        F.count("*").alias("n_updates")).select(
        "user", "book", F.unix_millis("w.start").alias("started"), F.unix_millis("w.end").alias("ended"),
        "n_updates")


def upsert_positions(path: str, partitions: int = 64):
    """``foreachBatch`` writer: newest positions of the batch merged into a table."""
    from bookflow.streaming.tables import merge_batches

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return latest_positions(batch if old is None else old.unionByName(batch.select(*old.columns)))
    return merge_batches(path, ["user", "book"], merge, partitions)
