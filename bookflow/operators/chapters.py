"""From located headings to narrated chapters: bounds, skipped sections, cut labels, sentences, timeline."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.text import apply_rules, compiles
from bookflow.functions.times import est_samples_all
from bookflow.operators import segment, structure, timeline
from bookflow.settings import stage


def chapter_pipeline(pages: DataFrame, markers: DataFrame, profiles: DataFrame | None = None, patterns: Sequence[str] = (),
                     rules: Sequence[tuple[str, str]] = (), samples: Callable[[str], Column] = est_samples_all
                     ) -> tuple[DataFrame, DataFrame]:
    """``(chapters, timeline)`` of books: chapters are bounded by the markers, those that a profile skips go, heading labels at
    the start of a chapter are cut and its start moves past them, chapters without words go, the rest is
    numbered anew; sentences keep their text, while durations come from the spoken form (compiled pronunciation ``rules``).

    ``pages(book, page, page_off, text)`` are cleaned; ``markers(book, seq, level, title, page, off)``. A label that runs over the
    end of a page is cut up to there. Patterns that don't compile are passed over.
    """
    patterns = [p for p in patterns if compiles(p)]
    bounds = structure.number_chapters(structure.chapter_bounds(markers, structure.book_lengths(pages)))
    if profiles is not None:
        bounds = structure.number_chapters(structure.skip_sections(bounds.drop("ch"), profiles))
    bounds = stage(bounds, "chapter-bounds")
    slices = stage(structure.page_slices(bounds, pages), "chapter-slices")
    heads = slices.filter("base = 0").join(bounds.select("book", "ch", "title"), ["book", "ch"])
    # Read twice each, and costly: cuts and sentences, with the length of their spoken form, are written once.
    cuts = stage(heads.select("book", "ch", structure.heading_cut("text", "title", F.array(*map(F.lit, patterns)).cast("array<string>"))
                              .cast("long").alias("_cut")), "chapter-cuts")
    cut = F.coalesce("_cut", F.lit(0))
    slices = slices.join(cuts, ["book", "ch"], "left").select(
        "book", F.col("ch").alias("old_ch"), "page", F.greatest(F.lit(0), F.col("base") - cut).alias("base"),
        F.when(F.col("base") == 0, F.substring(F.col("text"), (cut + 1).cast("int"), F.length("text"))).otherwise(F.col("text")).alias("text"))
    moved = bounds.join(cuts, ["book", "ch"], "left").withColumn("start", F.col("start") + cut).drop("_cut")
    chapters = stage(structure.drop_empty(moved, slices.withColumnRenamed("old_ch", "ch")), "chapters")
    kept = slices.filter("text <> ''").join(chapters.select("book", "ch", "old_ch"), ["book", "old_ch"]).drop("old_ch")
    said = segment.sentences(kept).withColumn("_said", apply_rules("t", rules))
    sents = stage(said.withColumn("_samples", samples("_said")).drop("_said"), "chapter-sentences")
    return chapters.drop("old_ch"), timeline.timeline(sents, lambda _: F.col("_samples")).drop("_samples")
