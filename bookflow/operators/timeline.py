"""Sentence times, boundaries, topics and cues."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bookflow.functions.text import squash
from bookflow.functions.times import est_samples_all
from bookflow.operators import scan
from bookflow.operators.lookup import asof_cells, asof_scan
from bookflow.operators.structure import OFFSET_CELL
from bookflow.settings import (BLOCK, PARAGRAPH_GAP_MS, SAMPLE_RATE, SENTENCE_GAP_MS,
                               SENTENCE_LEAD_MS, TIMING_VERSION)

PAGES = 64                     # pages per block of a sentence scan


def _ms(samples: Column) -> Column:
    """Samples to seconds with three decimals; integer arithmetic, halves round up."""
    return F.floor((samples * 1000 + SAMPLE_RATE // 2) / SAMPLE_RATE) / 1000.0


def _gap(par_end: Column) -> Column:
    return F.when(par_end, SAMPLE_RATE * PARAGRAPH_GAP_MS // 1000).otherwise(
        SAMPLE_RATE * SENTENCE_GAP_MS // 1000).cast("long")


def _settled(s_ms: Column, prev_end_ms: Column) -> Column:
    pause = F.least(F.greatest(s_ms - prev_end_ms, F.lit(0)), F.lit(2 * SENTENCE_LEAD_MS))
    return F.floor((2 * s_ms - pause + 1) / 2) / 1000.0


def spoken(sents: DataFrame, samples: Callable[[str], Column] = est_samples_all) -> DataFrame:
    """Add ``dur``, the spoken length. A timeline reads it twice: write it once with the sentences, whose text is then no longer needed."""
    return sents.withColumn("dur", samples("t"))


def timeline(sents: DataFrame, samples: Callable[[str], Column] = est_samples_all) -> DataFrame:
    """Add index ``i`` and times ``s``, ``e`` within the chapter, and ``settled``, the final start.

    ``samples`` is the pluggable duration: spoken text to a number of audio samples.  Sums are
    over integers, so the result does not depend on how the rows were partitioned.  Sentences that
    are ``spoken`` keep their length.  The pause before a sentence follows from ``first`` alone, so settling needs no second scan here.
    """
    d = (sents if "dur" in sents.columns else spoken(sents, samples)).withColumn("gap", _gap(F.col("p")))
    d = scan.prefix_sum(d, ["book", "ch"], ["page", "k"], F.floor(F.col("page") / PAGES),
                        i=F.lit(1).cast("long"), _t=F.col("dur") + F.col("gap"))
    prev = F.when(F.col("_t") == 0, F.lit(0.0)).otherwise(_ms(F.col("_t") - _gap(F.col("first"))))
    ms = lambda c: F.rint(c * 1000).cast("long")
    return d.withColumns({
        "s": _ms(F.col("_t")), "e": _ms(F.col("_t") + F.col("dur")),
        "settled": _settled(ms(_ms(F.col("_t"))), ms(prev))}).drop("_t")


def chapter_durations(sents: DataFrame, samples: Callable[[str], Column] = est_samples_all) -> DataFrame:
    """Audio length per chapter, the trailing gap included."""
    return sents.groupBy("book", "ch").agg(
        _ms(F.sum(samples("t") + _gap(F.col("p")))).alias("duration"))


def settle(tl: DataFrame, order: str = "i") -> DataFrame:
    """Pull each start back by half the preceding pause, at most 250 ms.  Ends stay.

    Run it once only: raw starts go in.  Times are whole milliseconds; exact halves round up.
    """
    d = scan.prev_value(tl, ["book", "ch"], [order], F.floor(F.col(order) / BLOCK), _pe=F.col("e"))
    s, pe = F.rint(F.col("s") * 1000).cast("long"), F.rint(F.coalesce("_pe", F.lit(0.0)) * 1000).cast("long")
    return d.withColumn("s", _settled(s, pe)).drop("_pe")


def upgrade_timings(books: DataFrame, tl: DataFrame, topics: DataFrame
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settle the timelines of books below the current timing version, once; topics follow."""
    old = F.coalesce("timing_version", F.lit(1)) < TIMING_VERSION
    legacy = books.filter(old).select("book")
    todo, done = tl.join(legacy, "book", "left_semi"), tl.join(legacy, "book", "left_anti")
    new = settle(todo.withColumn("_old", F.col("s")))
    # Equal old starts: the last sentence decides.
    moved = new.groupBy("book", "ch", F.col("_old").alias("time")).agg(F.max_by("s", "i").alias("_new"))
    t2 = topics.join(moved, ["book", "ch", "time"], "left").withColumn(
        "time", F.coalesce("_new", "time")).drop("_new")
    b2 = books.withColumn("timing_version", F.greatest(
        F.coalesce("timing_version", F.lit(1)), F.lit(TIMING_VERSION)))
    return b2, done.unionByName(new.drop("_old")), t2


def topics_of_chapters(markers: DataFrame, chapters: DataFrame) -> DataFrame:
    """Level-2+ markers strictly inside a chapter, with their offset from its start.

    Chapters do not overlap: the one with the greatest start not above the marker is the only
    candidate, so an as-of lookup replaces a range join.
    """
    subs = markers.filter("level >= 2").select("book", "seq", "level", "title", "off")
    hit = asof_scan(subs, chapters.select("book", "ch", F.col("start").cast("long"),
                                          F.col("end").cast("long")),
                    ["book"], "off", "start", ["ch", "start", "end"], OFFSET_CELL)
    return hit.filter((F.col("start") < F.col("off")) & (F.col("off") < F.col("end"))).select(
        "book", "ch", "seq", "level", "title", (F.col("off") - F.col("start")).alias("rel"))


def time_at_char(probes: DataFrame, tl: DataFrame, rel: str = "rel", name: str = "time") -> DataFrame:
    """Start of the last sentence at or before a chapter offset; else the first; else 0."""
    hit = asof_cells(probes, tl.select("book", "ch", "cs", F.col("s").alias("_at")), ["book", "ch"], rel, "cs", ["_at"], 4096)
    first = tl.groupBy("book", "ch").agg(F.min_by("s", "i").alias("_first"))
    return hit.join(first, ["book", "ch"], "left").withColumn(
        name, F.coalesce("_at", "_first", F.lit(0.0))).drop("_at", "_first")


def chapter_starts(chapters: DataFrame) -> DataFrame:
    """Seconds of audio before each chapter, in chapter order (stored starts are not trusted)."""
    return scan.prefix_sum(chapters, ["book"], ["ch"], F.floor(F.col("ch") / BLOCK),
                           start_global=F.coalesce(F.col("duration"), F.lit(0.0)))


def paragraph_ids(tl: DataFrame) -> DataFrame:
    """0-based paragraph of each sentence within its chapter: closed paragraphs before it."""
    return scan.prefix_sum(tl, ["book", "ch"], ["i"], F.floor(F.col("i") / BLOCK),
                           para=F.coalesce(F.col("p").cast("long"), F.lit(0)).cast("long"))


def neighbours(tl: DataFrame) -> DataFrame:
    """Index of the previous and next sentence (null at the chapter's ends)."""
    blk = F.floor(F.col("i") / BLOCK)
    d = scan.prev_value(tl, ["book", "ch"], ["i"], blk, prev_i=F.col("i"))
    return scan.next_value(d, ["book", "ch"], ["i"], blk, next_i=F.col("i"))


def align_spans(words: DataFrame, sents: DataFrame, by: Sequence[str] = ("book", "ch")) -> DataFrame:
    """Sentence spans from word spans; a sentence without words gets zero width where the one
    before it ended."""
    w = words.groupBy(*by, "si").agg(F.min_by("start", "w").alias("s"), F.max_by("end", "w").alias("_e"))
    d = sents.join(w, [*by, "si"], "left").withColumn("_e", F.greatest("_e", "s"))
    d = scan.last_value(d, by, ["si"], F.floor(F.col("si") / BLOCK), _prev=F.col("_e"))
    end = F.coalesce("_e", "_prev", F.lit(0.0))
    return d.withColumns({"s": F.coalesce("s", end), "e": end}).drop("_e", "_prev")


def chunked_timeline(sents: DataFrame, words: DataFrame, audio: DataFrame, samples: Callable[[str], Column] = est_samples_all) -> DataFrame:
    """Times ``s``, ``e`` of sentences that were spoken in chunks: ``sents(book, ch, chunk, i, t, p)``.

    ``audio(book, ch, chunk, samples)`` is the length of a chunk that was spoken in one go, ``words(book, ch, chunk, si, w, start, end)`` are its word
    spans in seconds from the chunk's start. A chunk without audio or without any word falls back to sentences one after the other,
    each with its pause. Chunks follow each other with a sentence's or paragraph's pause.

    Two levels: inside chunks, which the chunk budget bounds, and over one row for each chunk.
    """
    by = ["book", "ch", "chunk"]
    heard = audio.join(words.select(*by).distinct(), by, "left_semi").select(*by, F.col("samples").cast("long").alias("_audio"))
    d = sents.join(heard, by, "left").withColumns({"_dur": samples("t"), "_gap": F.lit(SAMPLE_RATE * SENTENCE_GAP_MS // 1000).cast("long")})
    inside = W.partitionBy(*by).orderBy("i")
    d = d.withColumn("_t", F.sum(F.col("_dur") + F.col("_gap")).over(inside) - F.col("_dur") - F.col("_gap"))
    chunks = d.groupBy(*by).agg(
        (F.coalesce(F.max("_audio"), F.sum(F.col("_dur") + F.col("_gap"))) + _gap(F.max_by("p", "i"))).alias("_total"))
    starts = scan.prefix_sum(chunks, ["book", "ch"], ["chunk"], F.floor(F.col("chunk") / BLOCK), _start=F.col("_total")).drop("_total")
    spans = align_spans(words, d.where("_audio IS NOT NULL").select(*by, F.col("i").alias("si")), by).select(
        *by, F.col("si").alias("i"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    d = d.join(starts, by).join(spans, [*by, "i"], "left")

    def at(measured: str, own: Column) -> Column:
        """Whole milliseconds, halves up."""
        exact = F.col("_start") / (SAMPLE_RATE // 1000) + F.col(measured) * 1000
        return F.when(F.col("_audio").isNotNull(), F.floor(exact + 0.5) / 1000.0).otherwise(_ms(F.col("_start") + own))
    return d.withColumns({"s": at("_s", F.col("_t")), "e": at("_e", F.col("_t") + F.col("_dur"))}).drop(
        "_audio", "_dur", "_gap", "_t", "_start", "_s", "_e")


def cues(chapters: DataFrame, sents: DataFrame, whole_book: bool = True) -> DataFrame:
    """Subtitle cues ``(book, ch, i, n, st, en, txt)``.

    ``chapters(book, ch, status, duration)``, ``sents(book, ch, i, t, s, e)``.  For the whole
    book each ready chapter is shifted by the ready ones before it.  ``n`` counts cues from 1:
    cues of earlier chapters plus the position in the own one.
    """
    ready = chapters.filter(F.coalesce("status", F.lit("ready")) == "ready")
    if whole_book:
        ready = scan.prefix_sum(ready, ["book"], ["ch"], F.floor(F.col("ch") / BLOCK),
                                _shift=F.coalesce(F.col("duration"), F.lit(0.0)))
    else:
        ready = ready.withColumn("_shift", F.lit(0.0))
    d = sents.join(ready.select("book", "ch", "_shift"), ["book", "ch"])
    st = F.coalesce("s", F.lit(0.0)) + F.col("_shift")
    en = F.coalesce("e", "s", F.lit(0.0)) + F.col("_shift")
    d = d.select("book", "ch", "i", st.alias("st"), F.when(en <= st, st + 0.5).otherwise(en).alias("en"),
                 squash("t").alias("txt")).filter("txt <> ''")
    d = scan.row_index(d, ["book", "ch"], ["i"], F.floor(F.col("i") / BLOCK), "n")
    if not whole_book:
        return d.withColumn("n", F.col("n") + 1)
    per_ch = d.groupBy("book", "ch").agg(F.count("*").alias("_c"))
    before = scan.prefix_sum(per_ch, ["book"], ["ch"], F.floor(F.col("ch") / BLOCK),
                             _b=F.col("_c"))
    return d.join(before.select("book", "ch", "_b"), ["book", "ch"]).withColumn(
        "n", F.col("n") + F.col("_b") + 1).drop("_b")
