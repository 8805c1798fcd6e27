"""Streams give what the batch forms give, whatever the batch boundaries."""

import random

import pytest
from pyspark.sql import functions as F

from bookflow.operators import notes
from bookflow.streaming import jobs, progress, tables

COLS = "user string, book string, device string, ci int, t double, si int, frac double, updated long, seq long"


def _events(n=120, seed=2):
    r, out, now = random.Random(seed), [], 1_700_000_000_000
    for i in range(n):
        now += r.choice([200, 700, 1400, 1500, 1501, 4000, 13_000])
        out.append((f"u{r.randrange(2)}", f"b{r.randrange(3)}", f"d{r.randrange(2)}", i % 5, float(i), i, 0.5, now, i))
    return out


def _stream(spark, tmp_path, rows, schema, batches=3, tail=()):
    """Rows split over several files; one file is one micro batch."""
    size = -(-len(rows) // batches)
    parts = [rows[i:i + size] for i in range(0, len(rows), size)] + [[t] for t in tail]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _close(now):
    """A last event per device far in the future: the watermark passes all bursts before it."""
    return [("u0", "b0", d, 0, 0.0, 0, 0.0, now + 10_000_000 * k, 10_000 + k) for k, d in ((1, "d0"), (1, "d1"), (2, "d0"))]


def test_debounce_stream(spark, tmp_path):
    rows = _events()
    tail = _close(rows[-1][7])
    schema = spark.createDataFrame(rows[:1], COLS).schema
    s = _stream(spark, tmp_path, rows, schema, tail=tail)
    got = _run(progress.debounce_stream(s.drop("user"), late="60 seconds"), tmp_path).filter("seq < 10000")
    want = progress.debounce(spark.createDataFrame(rows, COLS))
    key = lambda d: {(r.device, r.book, r.flushed, r.seq) for r in d.collect()}
    assert key(got) == key(want)


def test_accept_and_throttle_streams(spark, tmp_path):
    rows = [(u, b, d, ci, t, si, f, up - (q % 4) * 5000, q) for u, b, d, ci, t, si, f, up, q in _events()]
    schema = spark.createDataFrame(rows[:1], COLS).schema
    (tmp_path / "a").mkdir(), (tmp_path / "t").mkdir()
    # They arrive in this order, the rows of a file shuffled; two far later rows let the watermark pass.
    rows = [(*r, 1_700_000_000_000 + 1000 * r[8]) for r in rows]
    cols = f"{COLS}, arrived long"
    tail = [("~", "b", "d9", 0, 0.0, 0, 0.0, 1, 10_000 + k, rows[-1][9] + k * 10_000_000) for k in (1, 2)]
    parts = [x for k in range(0, len(rows), 40) for x in random.Random(k).sample(rows[k:k + 40], len(rows[k:k + 40]))]
    s = _stream(spark, tmp_path / "a", parts, spark.createDataFrame(rows[:1], cols).schema, tail=tail)
    playable = spark.createDataFrame([(b, c) for b in ("b0", "b1", "b2") for c in range(5) if c != 2], "book string, ch int")
    paused = "seq % 7 > 0"
    got = {r.seq for r in _run(progress.accept_stream(s, "d0", F.expr(paused), playable, bucket_ms=5000), tmp_path / "a").collect()}
    batch = progress.usable(spark.createDataFrame(rows, cols), playable, F.lit("d0"))
    want = {r.seq for r in progress.accepted(batch, F.lit("d0"), F.expr(paused)).collect()}
    assert got - {10_001, 10_002} == want and want
    ticks = [("s", i * 37 + (i % 7), (i // 9) % 2, i) for i in range(200)]
    ts = "session string, ms long, si int, seq long"
    tail = [("~", 10_000_000 * k, 0, 10_000 + k) for k in (1, 2)]
    s = _stream(spark, tmp_path / "t", ticks, spark.createDataFrame(ticks[:1], ts).schema, tail=tail)
    got = {r.seq for r in _run(progress.throttle_stream(s, bucket_ms=500), tmp_path / "t").collect() if r.session == "s"}
    want = {r.seq for r in progress.throttle(spark.createDataFrame(ticks, ts)).collect()}
    last = si = None
    brute = set()
    for _, ms, x, q in ticks:
        if last is None or x != si or ms - last >= 200:
            last = ms
            brute.add(q)
        si = x
    assert got == want == brute


def test_follow_stream(spark, tmp_path):
    rows = _events()
    now = rows[-1][7]
    tail = [("u9", "b9", "d0", 0, 0.0, 0, 0.0, now + 10_000_000 * k, 10_000 + k) for k in (1, 2)]
    schema = spark.createDataFrame(rows[:1], COLS).schema
    got = _run(progress.follow_stream(_stream(spark, tmp_path, rows, schema, tail=tail), late="60 seconds"), tmp_path)
    want = progress.follow_sessions(spark.createDataFrame(rows, COLS))
    key = lambda d: {(r.user, r.book, r.started, r.ended, r.n_updates) for r in d.collect() if r.user != "u9"}
    assert key(got) == key(want)


def test_latest_positions_table(spark, tmp_path):
    rows = _events()
    s = _stream(spark, tmp_path, rows, spark.createDataFrame(rows[:1], COLS).schema)
    path = str(tmp_path / "table")
    (s.writeStream.foreachBatch(progress.upsert_positions(path)).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    got = {(r.user, r.book, r.seq) for r in tables.read_table(spark, path).collect()}
    want = {(r.user, r.book, r.seq) for r in progress.latest_positions(spark.createDataFrame(rows, COLS)).collect()}
    assert got == want


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path):
    rows, path = _events(), str(tmp_path / "table")
    write = progress.upsert_positions(path, 4)
    for k in (0, 40, 40, 80, 40):
        write(spark.createDataFrame(rows[k:k + 40], COLS), k)
    got = {(r.user, r.book, r.seq) for r in tables.read_table(spark, path).collect()}
    assert got == {(r.user, r.book, r.seq) for r in progress.latest_positions(spark.createDataFrame(rows, COLS)).collect()}


def test_a_grave_with_an_empty_stamp(spark, tmp_path):
    """An empty stamp is none: the grave counts from its creation."""
    cols, path = "book string, id string, seq long, created string, updated string, deleted boolean, note string", str(tmp_path / "table")
    write = tables.merge_notes_batches(path, 2)
    for k, r in enumerate([("b", "1", 0, "2024-01-01", "2024-01-02", False, "x"), ("b", "1", 1, "2024-01-05", "", True, None), ("b", "1", 2, "2024-01-01", "2024-01-03", False, "old")]):
        write(spark.createDataFrame([r], cols), k)
    assert [(r.deleted, r.updated) for r in tables.read_table(spark, path).collect()] == [(True, "2024-01-05")]


def test_notes_stream_keeps_graves(spark, tmp_path):
    cols = "book string, id string, seq long, created string, updated string, deleted boolean, note string"
    rows = [("b", "1", 0, "a", "2024-01-01", False, "x"), ("b", "2", 1, "a", "2024-01-01", False, "y"),
            ("b", "1", 2, "a", "2024-01-03", True, None), ("b", "2", 3, "a", "2024-01-01", False, "y"),
            ("b", "1", 4, "a", "2024-01-02", False, "revived?"), ("b", "3", 5, "a", "2024-01-02", False, "z")]
    s = _stream(spark, tmp_path, rows, spark.createDataFrame(rows[:1], cols).schema)
    path = str(tmp_path / "table")
    (s.writeStream.foreachBatch(tables.merge_notes_batches(path)).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    live = tables.read_table(spark, path).filter("NOT deleted")
    assert {(r.id, r.note) for r in live.collect()} == {("2", "y"), ("3", "z")}


def test_newly_ready_stream(spark, tmp_path):
    rows = [("b", v, v // 3, "generating" if v < 8 else "ready") for v in range(10)] + [("c", 3, 1, "ready")]
    cols = "book string, version long, chapters_ready long, status string"
    tail = [("~", 10_000_000 * k, 0, "x") for k in (1, 2)]
    s = _stream(spark, tmp_path, rows, spark.createDataFrame(rows[:1], cols).schema, tail=tail)
    got = {tuple(r) for r in _run(jobs.newly_ready_stream(s), tmp_path).collect() if r.book != "~"}
    assert got == {tuple(r) for r in jobs.newly_ready(spark.createDataFrame(rows, cols)).collect()}


def test_job_state_stream(spark, tmp_path):
    cols = ("job string, seq long, stage string, done long, total long, message string, book_id string, "
            "chapters_ready long, chapters_total long")
    rows = [("j", 0, "extract", 0, 0, "m", None, None, None), ("j", 1, "prepared", 0, 9, None, "b", 0, 3),
            ("j", 2, "synthesize", 5, 9, "c", "b", None, 3), ("j", 3, "model", 0, 0, None, None, 1, None)]
    s = _stream(spark, tmp_path, rows, spark.createDataFrame(rows[:1], cols).schema)
    q = jobs.job_state(s).writeStream.outputMode("complete").format("memory").queryName("jobs").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("jobs").first()
    assert (r.stage, r.message, r.percent, r.book_id, r.chapters_ready, r.chapters_total) == ("model", "", 55, "b", 1, 3)


def test_a_late_row_does_not_replace_a_newer_position(spark, tmp_path):
    base = 1_700_000_000_000
    row = lambda at, seq: ("u0", "b0", "d0", 0, 0.0, 0, 0.0, base + at, seq)
    rows = [row(1000, 1), row(500, 2), *_close(base + 1000)]
    schema = spark.createDataFrame(rows[:1], COLS).schema
    s = _stream(spark, tmp_path, rows, schema, batches=5)
    got = _run(progress.debounce_stream(s.drop("user"), late="60 seconds"), tmp_path).filter("seq < 10000")
    assert [(r.seq, r.flushed - base) for r in got.collect()] == [(1, 2500)]
