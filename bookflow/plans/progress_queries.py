"""Registered queries: reading progress and job events, batch and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.plans import inputs as I
from bookflow.settings import new_folder
from bookflow.streaming import jobs as J
from bookflow.streaming import progress as P

QUERIES, SQL = {}, {}
GAP = 6 * 3_600_000            # the events of one user are hours apart


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


def _bursts(gap: int, by: str) -> str:
    return f"""{I.PROGRESS}, g AS (SELECT *, lag(updated) OVER (PARTITION BY {by} ORDER BY updated, seq) AS pu FROM pr),
  b AS (SELECT *, sum(CASE WHEN pu IS NULL OR updated - pu > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY updated, seq
    ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS burst FROM g)"""


def _deb(gap: int) -> str:
    return f"""WITH {_bursts(gap, 'device')}, f AS (SELECT device, burst, max(updated) + {gap} AS flushed FROM b GROUP BY 1, 2),
  l AS (SELECT device, burst, book, arg_max(t, (updated, seq)) AS t, arg_max(seq, (updated, seq)) AS seq, max(updated) AS updated FROM b GROUP BY 1, 2, 3)
  SELECT device, book, burst, flushed, updated, t, seq FROM l JOIN f USING (device, burst)"""


@query(_deb(1500))
def debounced_progress(spark, sf):
    return P.debounce(I.progress(spark, sf)).select("device", "book", "burst", "flushed", "updated", "t", "seq")


@query(_deb(420_000))
def debounced_progress_wide(spark, sf):
    """Seven minutes of silence, so that bursts hold several positions."""
    return P.debounce(I.progress(spark, sf), 420_000).select("device", "book", "burst", "flushed", "updated", "t", "seq")


LATEST = f"""WITH {I.PROGRESS} SELECT "user", book, arg_max(t, (updated, seq)) AS t, max(updated) AS updated, arg_max(seq, (updated, seq)) AS seq FROM pr GROUP BY 1, 2"""


@query(LATEST)
def latest_positions(spark, sf):
    return P.latest_positions(I.progress(spark, sf)).select("user", "book", "t", "updated", "seq")


# ---- the same rules as streams over several micro-batches ----------------------------------------

SLICES = 4
END = "~"                       # a key of rows far in the future, which let the watermark pass all others


def _sliced(df, order: str, closing):
    """``df`` as a stream: slices by ``order``, one file after the other, then two files of one ``closing`` row each."""
    spark = df.sparkSession
    path = new_folder(spark, "stream")
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    at = F.col(order) * SLICES - lo * SLICES
    for k in range(SLICES):
        df.where((at >= k * (hi - lo + 1)) & (at < (k + 1) * (hi - lo + 1))).coalesce(1).write.mode("append").parquet(path)
    for k in (1, 2):
        closing(df.limit(1), k).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, *columns):
    """All micro-batches that are there, and what they wrote."""
    spark = stream.sparkSession
    path = new_folder(spark, "sink")
    (stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*columns)


def _later(time: str, key: str, days: int = 3650):
    """A closing row: one far later time, under a key of its own."""
    return lambda d, k: d.withColumns({time: F.col(time) + F.lit(k * days * 86_400_000), key: F.lit(END)})


def _deb_stream(gap: int) -> str:
    return f"SELECT device, book, flushed, updated, t, seq FROM ({_deb(gap)})"


@query(_deb_stream(420_000))
def debounced_progress_stream(spark, sf):
    d = I.progress(spark, sf)
    return _run(P.debounce_stream(_sliced(d, "seq", _later("updated", "device")), 420_000), "device", "book", "flushed", "updated", "t", "seq").where(
        F.col("device") != END)


# Device 0 views; it plays at every fifth update; a third of the chapters can't be played; updates arrive up to three days late.
_MIRROR = f"""WITH {I.PROGRESS}, l AS (SELECT * REPLACE ((seq % 3)::VARCHAR AS device, updated - (seq % 4) * 86400000 AS updated) FROM pr),
  u AS (SELECT * FROM l WHERE device = '0' OR (seq % 5 > 0 AND (ci + length(book)) % 3 > 0)),
  x AS (SELECT *, max(updated) OVER (PARTITION BY "user", book ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM u)
  SELECT "user", book, seq, updated FROM x WHERE device <> '0' AND updated > coalesce(m, 0)"""
PAUSED = "seq % 5 > 0"


def _playable(spark, sf):
    books = I.table(spark, sf, "events").select(F.col("event_type").alias("book")).distinct()
    return books.withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(6)))).where((F.col("ch") + F.length("book")) % 3 > 0)


@query(_MIRROR)
def mirrored_updates(spark, sf):
    p = P.usable(_late(I.progress(spark, sf)), _playable(spark, sf), F.lit("0"))
    return P.accepted(p, F.lit("0"), F.expr(PAUSED)).select("user", "book", "seq", "updated")


@query(_MIRROR)
def mirrored_updates_stream(spark, sf):
    d = _late(I.progress(spark, sf).withColumn("arrived", F.col("updated")))
    got = P.accept_stream(_sliced(d, "seq", _later("arrived", "user")), "0", F.expr(PAUSED), _playable(spark, sf), bucket_ms=86_400_000)
    return _run(got, "user", "book", "seq", "updated").where(F.col("user") != END)


@query(f"""WITH {_bursts(GAP, '"user", book')} SELECT "user", book, min(updated) AS started, max(updated) + {GAP} AS ended, count(*) AS n_updates FROM b GROUP BY "user", book, burst""")
def follow_sessions_stream(spark, sf):
    d = I.progress(spark, sf)
    return _run(P.follow_stream(_sliced(d, "seq", _later("updated", "user")), f"{GAP} milliseconds"), "user", "book", "started", "ended", "n_updates").where(
        F.col("user") != END)


@query(LATEST)
def latest_positions_stream(spark, sf):
    """foreachBatch merges each micro-batch into a table."""
    from bookflow.streaming.tables import read_table
    path = new_folder(spark, "positions")
    d = _sliced(I.progress(spark, sf), "seq", _later("updated", "user"))
    (d.writeStream.foreachBatch(P.upsert_positions(f"{path}/table", 16)).option("checkpointLocation", f"{path}/cp")
     .trigger(availableNow=True).start().awaitTermination())
    return read_table(spark, f"{path}/table").select("user", "book", "t", "updated", "seq").where(F.col("user") != END)


@query("""WITH a AS (SELECT 'b' || (event_id % 700 % 5) AS book, 'n' || (event_id % 700) AS id, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:00:00Z') AS u,
    event_type = 'error' AS deleted, event_type AS note FROM events)
  SELECT book, id, max(u) AS updated, arg_max(deleted, (u, seq)) AS deleted, CASE WHEN NOT arg_max(deleted, (u, seq)) THEN arg_max(note, (u, seq)) END AS note FROM a GROUP BY 1, 2""")
def merged_notes_stream(spark, sf):
    """Note changes merged into a table batch by batch; graves stay."""
    from bookflow.streaming.tables import merge_notes_batches, read_table
    k = F.col("event_id") % 700
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:00:00'Z'")
    d = I.table(spark, sf, "events").select(
        F.concat(F.lit("b"), (k % 5).cast("string")).alias("book"), F.concat(F.lit("n"), k.cast("string")).alias("id"), F.col("event_id").alias("seq"),
        stamp.alias("created"), F.when(F.col("event_id") % 3 > 0, stamp).otherwise("").alias("updated"), (F.col("event_type") == "error").alias("deleted"),
        F.col("event_type").alias("note"))
    path = new_folder(spark, "notes")
    s = _sliced(d, "seq", lambda one, k: one.withColumn("book", F.lit(END)))
    (s.writeStream.foreachBatch(merge_notes_batches(f"{path}/table", 16)).option("checkpointLocation", f"{path}/cp")
     .trigger(availableNow=True).start().awaitTermination())
    return read_table(spark, f"{path}/table").where(F.col("book") != END).select(
        "book", "id", F.coalesce(F.nullif("updated", F.lit("")), "created").alias("updated"), "deleted", F.when(~F.col("deleted"), F.col("note")).alias("note"))


@query(f"""WITH {I.PROGRESS}, x AS (SELECT *, max(updated) OVER (PARTITION BY "user", book ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
    FROM (SELECT * REPLACE ((seq % 3)::VARCHAR AS device, updated - (seq % 4) * 86400000 AS updated) FROM pr))
  SELECT "user", book, seq, updated FROM x WHERE device <> '0' AND updated > coalesce(m, 0)""")
def accepted_updates(spark, sf):
    """Device 0 views; three quarters of the updates arrive up to three days late."""
    return P.accepted(_late(I.progress(spark, sf)), F.lit("0")).select("user", "book", "seq", "updated")


def _late(p):
    return p.withColumns({"device": (F.col("seq") % 3).cast("string"),
                          "updated": F.col("updated") - (F.col("seq") % 4) * 86_400_000})


@query(f"""WITH {_bursts(GAP, '"user", book')} SELECT "user", book, burst AS follow, min(updated) AS started, max(updated) + {GAP} AS ended, count(*) AS n_updates FROM b GROUP BY 1, 2, 3""")
def follow_sessions(spark, sf):
    return P.follow_sessions(I.progress(spark, sf), GAP)


@query(f"""WITH RECURSIVE tk AS (SELECT user_id::VARCHAR AS session, epoch_us(ts) // 1000000000 AS ms, (event_id % 2)::INTEGER AS si, event_id AS seq FROM events),
  o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ms, seq) AS r FROM tk),
  f AS (SELECT session, ms, si, seq, r, ms AS last, TRUE AS emit FROM o WHERE r = 1 UNION ALL
    SELECT o.session, o.ms, o.si, o.seq, o.r, CASE WHEN o.si <> f.si OR o.ms - f.last >= 200 THEN o.ms ELSE f.last END, o.si <> f.si OR o.ms - f.last >= 200
    FROM f JOIN o ON o.session = f.session AND o.r = f.r + 1)
  SELECT session, ms, si, seq FROM f WHERE emit""")
def throttled_ticks(spark, sf):
    """Time runs a million times faster here, so that ticks are closer than 200 ms."""
    return P.throttle(_ticks(spark, sf))


def _ticks(spark, sf):
    return I.progress(spark, sf).select(F.col("user").alias("session"), F.floor(F.col("updated") / 1_000_000).alias("ms"),
                                        (F.col("seq") % 2).cast("int").alias("si"), "seq")


@query(SQL["throttled_ticks"])
def throttled_ticks_stream(spark, sf):
    d = _sliced(_ticks(spark, sf), "seq", _later("ms", "session"))
    return _run(P.throttle_stream(d, bucket_ms=250), "session", "ms", "si", "seq").where(F.col("session") != END)


def _job_events(e):
    k = F.col("event_id")
    return e.select((k % 37).cast("string").alias("job"), k.alias("seq"), F.col("event_type").alias("stage"), (k % 90).alias("done"),
                    F.when(k % 4 == 0, 0).otherwise(120).alias("total"), F.when(k % 3 == 0, F.col("props")).alias("message"),
                    F.when(k % 5 == 0, F.concat(F.lit("b"), k.cast("string"))).alias("book_id"),
                    F.when(k % 7 == 0, k % 11).alias("chapters_ready"), F.when(k % 8 == 0, F.lit(11)).alias("chapters_total"))


@query("""WITH j AS (SELECT (event_id % 37)::VARCHAR AS job, event_id AS k, * FROM events)
  SELECT job, arg_max(event_type, k) AS stage, arg_max(CASE WHEN k % 3 = 0 THEN props ELSE '' END, k) AS message,
    coalesce(max_by((k % 90) * 100 // 120, k) FILTER (k % 4 <> 0), 0)::INTEGER AS percent, arg_max('b' || k, k) FILTER (k % 5 = 0) AS book_id,
    arg_max(k % 11, k) FILTER (k % 7 = 0) AS chapters_ready, CASE WHEN count(*) FILTER (k % 8 = 0) > 0 THEN 11 END AS chapters_total FROM j GROUP BY job""")
def job_state(spark, sf):
    return J.job_state(_job_events(I.table(spark, sf, "events")))


@query("""WITH v AS (SELECT user_id::VARCHAR AS book, event_id AS version, (event_id // 50) AS r, CASE WHEN event_id % 5 = 0 THEN 'ready' ELSE 'generating' END AS status FROM events),
  x AS (SELECT *, lag(r) OVER w AS pr, lag(status) OVER w AS ps FROM v WINDOW w AS (PARTITION BY book ORDER BY version))
  SELECT book, version, r AS chapters_ready, status, r - coalesce(pr, 0) AS gained FROM x WHERE pr IS DISTINCT FROM r OR ps IS DISTINCT FROM status""")
def newly_ready(spark, sf):
    return J.newly_ready(_versions(spark, sf))


@query(SQL["newly_ready"])
def newly_ready_stream(spark, sf):
    d = _sliced(_versions(spark, sf), "version", _later("version", "book"))
    return _run(J.newly_ready_stream(d, 500), "book", "version", "chapters_ready", "status", "gained").where(F.col("book") != END)


def _versions(spark, sf):
    return I.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("book"), F.col("event_id").alias("version"),
        F.floor(F.col("event_id") / 50).alias("chapters_ready"), F.when(F.col("event_id") % 5 == 0, "ready").otherwise("generating").alias("status"))
