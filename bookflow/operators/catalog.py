"""Library summaries, progress, resume points and generation state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bookflow.functions.times import card_percent, percent
from bookflow.sources.manifests import is_ready


def _ready(c):
    return F.coalesce(c["status"], F.lit("ready")) == "ready"


def library_summary(manifests: DataFrame) -> DataFrame:
    """One light row per book; declared counts win over counted ones.  Newest first."""
    chapters = F.coalesce("chapters", F.array().cast(manifests.schema["chapters"].dataType))
    return manifests.select(
        F.col("id"), "title", F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("voice", F.lit("")).alias("voice"), F.coalesce("engine", F.lit("")).alias("engine"),
        F.coalesce("chapters_total", F.size(chapters)).cast("long").alias("n_chapters"),
        F.coalesce("chapters_ready", F.size(F.filter(chapters, _ready))).cast("long").alias("chapters_ready"),
        F.coalesce("status", F.lit("ready")).alias("status"),
        F.coalesce("total_duration", F.lit(0.0)).alias("duration"),
        F.coalesce("created", F.lit("")).alias("created"), "dir").orderBy(F.desc("created"), "dir")


def library_order(books: DataFrame, by: str = "created") -> DataFrame:
    """``created``: newest first; ``title``: alphabetical, ignoring case."""
    return books.orderBy(F.desc("created"), "dir") if by == "created" else books.orderBy(
        F.lower("title"), "dir")


def book_status(chapters: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Roll chapters up to the book: totals over ready chapters, and the resulting status."""
    ok = is_ready("status")
    g = chapters.groupBy("book").agg(
        F.count("*").alias("chapters_total"), F.count_if(ok).alias("chapters_ready"),
        F.round(F.sum(F.when(ok, F.col("duration")).otherwise(0.0)), 3).alias("total_duration"),
        F.when(F.bool_and(ok), "ready").otherwise("partial").alias("status"))
    if cancelled is not None:
        g = g.join(cancelled.select("book", F.lit("cancelled").alias("_c")), "book", "left").withColumn(
            "status", F.coalesce("_c", "status")).drop("_c")
    return g


def chapter_info(manifests: DataFrame) -> DataFrame:
    """Sentence and topic counts per chapter, from the nested manifest."""
    c = manifests.select(F.col("id").alias("book"), F.posexplode("chapters").alias("ch", "c"))
    n = lambda a: F.when(a.isNull(), 0).otherwise(F.size(a)).cast("long")
    return c.select("book", "ch", "c.title", F.coalesce("c.status", F.lit("ready")).alias("status"),
                    n(F.col("c.sentences")).alias("n_sentences"), n(F.col("c.topics")).alias("n_topics"))


def chapter_counts(sentences: DataFrame, topics: DataFrame) -> DataFrame:
    """The same counts from flat tables."""
    s = sentences.groupBy("book", "ch").agg(F.count("*").alias("n_sentences"))
    t = topics.groupBy("book", "ch").agg(F.count("*").alias("n_topics"))
    return s.join(t, ["book", "ch"], "full").na.fill(0, ["n_sentences", "n_topics"])


def library_counts(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("books"),
                       F.count_if(F.col("status") == "generating").alias("generating"))


def total_sentences(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy("book").agg(F.count("*").alias("n_sentences"))


def cards(summary: DataFrame, progress: DataFrame) -> DataFrame:
    """Library cards: each user's position on each book they opened, with the shown percent."""
    d = summary.join(progress, summary.id == progress.book, "left").drop("book")
    return d.withColumns({
        "listened": card_percent("frac", "status"),
        "generated": F.when(F.col("status") != "ready", F.least(F.lit(100), F.when(
            F.col("n_chapters") > 0,
            F.floor(F.col("chapters_ready") / F.col("n_chapters") * 100 + 0.5)).otherwise(0)).cast("int"))})


def continue_listening(summary: DataFrame, progress: DataFrame, check_status: bool = True) -> DataFrame:
    """Per user the most recently played unfinished book; of equal times the first in the list.

    The phone ignores the book's status when it asks whether the book is finished.
    """
    d = progress.join(summary.select(F.col("id").alias("book"), "status", "title", "created", "dir"), "book")
    done = F.coalesce(F.col("frac") >= 0.999, F.lit(False))
    if check_status:
        done = done & (F.col("status") == "ready")
    d = d.filter(F.col("updated").isNotNull() & F.col("ci").isNotNull() & ~done)
    # Group-limited window: every task keeps one row per user before the shuffle.
    first = W.partitionBy("user").orderBy(F.desc("updated"), F.desc("created"), "dir")
    return d.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(
        "user", "book", "title", "ci", "t", "updated", percent("frac").alias("pct"))


def opening_target(books: DataFrame, chapters: DataFrame, progress: DataFrame) -> DataFrame:
    """Chapter and time at which a (user, book) opens.

    The saved chapter if it is ready and the book not finished, else the first ready chapter
    from its start, else none (-1).
    """
    ready = chapters.filter(is_ready("status")).select("book", "ch")
    first = ready.groupBy("book").agg(F.min("ch").alias("_first"))
    d = progress.join(books.select("book", F.col("status").alias("_status")), "book")
    d = d.join(ready.select("book", F.col("ch").alias("ci"), F.lit(True).alias("_ok")), ["book", "ci"], "left")
    d = d.join(first, "book", "left")
    finished = (F.coalesce("_status", F.lit("ready")) == "ready") & F.coalesce(
        F.col("frac") >= 0.999, F.lit(False))
    saved = F.coalesce("_ok", F.lit(False)) & ~finished
    target = F.when(saved, F.col("ci")).otherwise(F.coalesce("_first", F.lit(-1)))
    resuming = (target == F.col("ci")) & ~finished
    return d.select("user", "book", target.cast("int").alias("target"),
                    F.when(F.coalesce(resuming, F.lit(False)), F.coalesce("t", F.lit(0.0))).otherwise(
                        0.0).alias("start_at"))


def resume_plan(chapters: DataFrame, files: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Chapters that still have to be rendered: not ready, or their audio file is gone.

    ``expected(book, n)``: a book whose chapter count changed starts over with every chapter.
    """
    have = chapters.filter(is_ready("status") & F.col("audio").isNotNull()).join(
        files.select("book", F.col("name").alias("audio")), ["book", "audio"], "left_semi")
    if expected is not None:
        n = chapters.groupBy("book").agg(F.count("*").alias("_n")).join(expected, "book")
        have = have.join(n.filter("_n = n").select("book"), "book", "left_semi")
    return chapters.join(have.select("book", "ch"), ["book", "ch"], "left_anti")


def resume_totals(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """Finished chapters and their audio length at the start of a resumed run."""
    todo = resume_plan(chapters, files).select("book", "ch", F.lit(True).alias("_todo"))
    d = chapters.join(todo, ["book", "ch"], "left")
    return d.groupBy("book").agg(
        F.count_if(F.col("_todo").isNull()).alias("chapters_ready"),
        F.round(F.sum(F.when(F.col("_todo").isNull(), F.col("duration")).otherwise(0.0)), 3
                ).alias("total_duration"))


def with_source(books: DataFrame, inbox: DataFrame) -> DataFrame:
    """Flag books whose source file is still in the inbox."""
    names = inbox.select(F.col("name").alias("source_pdf")).distinct().withColumn("_in", F.lit(True))
    return books.join(names, "source_pdf", "left").withColumn(
        "has_source", (F.coalesce("source_pdf", F.lit("")) != "") & F.col("_in").isNotNull()).drop("_in")


def not_installed(remote: DataFrame, local: DataFrame) -> DataFrame:
    return remote.join(local.select("id"), "id", "left_anti")


def delete_books(tables: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove every row of deleted books from a table keyed by ``book``."""
    return tables.join(gone.select("book"), "book", "left_anti")


def outline(chapters: DataFrame, topics: DataFrame, timed_only: bool = False) -> DataFrame:
    """Chapters each followed by their topics: ``(book, ch, kind, pos, title, enabled, time)``.

    ``timed_only`` is the phone's form: topics without a time are left out.
    """
    c = chapters.select("book", "ch", F.lit(0).alias("kind"), F.lit(0).alias("pos"), "title",
                        is_ready("status").alias("enabled"),
                        F.when(is_ready("status"), F.col("duration")).alias("time"), F.lit(1).alias("level"))
    t = topics.join(chapters.select("book", "ch", is_ready("status").alias("_ok")), ["book", "ch"])
    if timed_only:
        t = t.filter("time IS NOT NULL")
        on = F.col("_ok")
    else:
        on = F.col("_ok") & F.col("time").isNotNull()
    t = t.select("book", "ch", F.lit(1).alias("kind"), "pos", "title", on.alias("enabled"), "time", "level")
    return c.unionByName(t)


def generation_state(summary: DataFrame, jobs: DataFrame, inbox: DataFrame) -> DataFrame:
    """Polling view per book: counts, and what the job working on it is doing.

    ``jobs(job, book, status, message)``: only running, paused and cancelling jobs count.
    """
    live = jobs.filter(F.col("status").isin("running", "paused", "cancelling")).select(
        F.col("book").alias("id"), "job", F.col("status").alias("_js"), "message")
    d = with_source(summary, inbox).join(live, "id", "left")
    return d.select("id", F.col("status").alias("manifest_status"), "chapters_ready",
                    F.col("n_chapters").alias("chapters_total"), F.col("job").isNotNull().alias("active"),
                    F.coalesce(F.col("_js") == "paused", F.lit(False)).alias("paused"),
                    F.coalesce(F.col("_js") == "cancelling", F.lit(False)).alias("cancelling"),
                    F.coalesce("message", F.lit("")).alias("message"), "has_source")
