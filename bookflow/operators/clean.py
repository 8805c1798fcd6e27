"""Page cleaning: raw page text to paragraphs, with or without a per-book profile."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.functions.arrays import let
from bookflow.functions.text import (LINE_BREAK, _c, dehyphenate, fix_letter_spacing, is_decorative,
                                     is_page_number, match_key, normalize_unicode, squeeze_blanks, strip)
from bookflow.operators import scan
from bookflow.settings import BLOCK

_NONE = "array<string>"


def number_pages(df: DataFrame, book: str, order: str, text: str) -> DataFrame:
    """``pages(book, page, raw)`` from any table: page = position within the book.

    ``order`` must be an integer column that is unique within a book.
    """
    src = df.select(F.col(book).cast("string").alias("book"), F.col(order).alias("_ord"),
                    F.col(text).alias("raw"))
    return scan.row_index(src, ["book"], ["_ord"], F.floor(F.col("_ord") / BLOCK), "page").select(
        "book", "page", "raw")


def split_lines(col) -> Column:
    return F.transform(F.split(_c(col), LINE_BREAK), strip)


def join_paragraphs(lines: Column) -> Column:
    """Trimmed lines to text: an empty line closes a paragraph, other lines are joined by a blank."""
    marked = F.transform(lines, lambda s: F.when(s == "", "\n").otherwise(s))
    text = F.regexp_replace(F.array_join(marked, " "), " ?\n[ \n]*", "\n\n")
    # Costly passes over a whole text run only where there is something to do: as lines are trimmed, it can begin and end in line feeds only.
    tidy = let(text, lambda t: F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), squeeze_blanks(t)).otherwise(t))
    return let(tidy, lambda t: F.when(F.startswith(t, F.lit("\n")) | F.endswith(t, F.lit("\n")), strip(t)).otherwise(t))


_NUMBER, _BLANKS = re.compile(r"(?:[ivxlcdmIVXLCDM]+|\d+)\Z"), re.compile(r"[ \t]{2,}|\t")


@F.arrow_udf(T.StringType())
def _paragraphs(texts: pa.Array, running: pa.Array) -> pa.Array:
    """``join_paragraphs`` of the lines that stay, for a batch of texts; expressions for each line of them cost several times as much."""
    out = []
    for text, drop in zip(texts.to_pylist(), running.to_pylist(), strict=True):
        if text is None:
            out.append(None)
            continue
        paras, own = [], []
        for line in text.splitlines():                # its line ends are LINE_BREAK's
            if not (line := line.strip()):
                paras.append(" ".join(own))
                own = []
            elif not _NUMBER.match(line) and not (drop and line in drop):
                own.append(line)
        paras.append(" ".join(own))
        whole = "\n\n".join(filter(None, paras))
        out.append(_BLANKS.sub(" ", whole) if "  " in whole or "\t" in whole else whole)
    return pa.array(out, pa.string())


def clean_text(raw, running: Column | None = None) -> Column:
    """Clean one page.  ``running`` is the book's array of header and footer lines.

    A dropped line leaves no blank line behind, so a paragraph continues across it.
    """
    drop = F.coalesce(running, F.array().cast(_NONE)) if running is not None else F.lit(None).cast(_NONE)
    return _paragraphs(dehyphenate(normalize_unicode(raw)), drop)


def edge_lines(pages: DataFrame, normalize_first: bool = False) -> DataFrame:
    raw = normalize_unicode("raw") if normalize_first else F.col("raw")
    lines = pages.select("book", F.filter(split_lines(raw), lambda s: s != "").alias("ls"))
    both = lines.filter(F.size("ls") > 0).select(
        "book", F.explode(F.array(F.element_at("ls", 1), F.element_at("ls", -1))).alias("line"))
    return both.filter((F.length("line") <= 80) & ~is_page_number("line"))


def running_lines(pages: DataFrame, threshold: float = 0.4, min_count: int = 3,
                  normalize_first: bool = False) -> DataFrame:
    """Header and footer lines: first or last line on many pages of the book.

    Counts are combined before the shuffle, so a book with most of the pages costs no more
    than its distinct edge lines.  A book has at most ``2 / threshold`` running lines.
    """
    n = pages.groupBy("book").agg(F.count("*").alias("n_pages"))
    hits = (edge_lines(pages, normalize_first).groupBy("book", "line").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= min_count))
    return hits.join(n, "book").filter(F.col("n") / F.col("n_pages") >= threshold).select(
        "book", "line", "n")


def clean_pages(pages: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """``(book, page, text)`` with running lines and page numbers removed."""
    if running is None:
        return pages.select("book", "page", clean_text("raw").alias("text"))
    per_book = running.groupBy("book").agg(F.collect_set("line").alias("_run"))
    return pages.join(per_book, "book", "left").select(
        "book", "page", clean_text("raw", F.col("_run")).alias("text"))


# ---- cleaning under a profile ----------------------------------------------------------------

REMEMBERED = 1024              # pattern lists that a task keeps compiled


@lru_cache(maxsize=REMEMBERED)
def _patterns(patterns: tuple[str, ...]) -> tuple[re.Pattern, ...]:
    out = []
    for p in patterns:
        try:
            out.append(re.compile(p))
        except re.error:               # a bad pattern is ignored, it must not fail the job
            pass
    return tuple(out)


def any_matches(lines: pd.Series, patterns: pd.Series) -> pd.Series:
    """Per line: does any of the row's own patterns match?  Null patterns give null.

    Patterns differ from book to book; the JVM would compile them again for every line.
    """
    out = np.empty(len(lines), dtype=object)
    lists = patterns.map(lambda p: tuple(p) if p is not None else None)
    for own, at in lists.groupby(lists, sort=False).indices.items():       # each list once for all its rows
        rx = _patterns(own)
        texts = [lines.iloc[k] for k in at]
        flat = pd.Series([x for t in texts if t is not None for x in t], dtype=object)
        known = {x: any(r.search(x) for r in rx) for x in flat.unique()}   # lines repeat from page to page
        for k, t in zip(at, texts, strict=True):
            out[k] = None if t is None else [known[x] for x in t]
    return pd.Series(out, dtype=object)


match_any = F.pandas_udf(any_matches, T.ArrayType(T.BooleanType()))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def zone_keys(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """Keys of the lines in a page's header or footer band: ``(book, page, zone)``."""
    band = profiles.select("book", F.col("cleaning.header_zone_max_y").alias("_top"),
                           F.col("cleaning.footer_zone_min_y").alias("_bottom"))
    hit = lines.join(band, "book").filter(
        (F.col("y") <= F.col("_top")) | (F.col("y") >= F.col("_bottom")))
    keys = hit.select("book", "page", match_key("text").alias("k")).filter("k <> ''")
    return keys.groupBy("book", "page").agg(F.collect_set("k").alias("zone"))


def clean_pages_profile(pages: DataFrame, profiles: DataFrame,
                        lines: DataFrame | None = None) -> DataFrame:
    """Cleaning driven by each book's profile; heading labels count as line patterns."""
    cl = F.col("cleaning")
    prof = profiles.select(
        "book", _list(cl.drop_substrings).alias("_subs"),
        F.concat(_list(cl.drop_line_patterns), _list(F.col("heading_labels.patterns"))).alias("_pats"),
        F.coalesce(cl.drop_decorative, F.lit(False)).alias("_deco"),
        F.coalesce(cl.strip_page_numbers, F.lit(True)).alias("_nums"),
        F.coalesce(cl.fix_letter_spacing, F.lit(False)).alias("_space"))
    d = pages.join(prof, "book", "left")
    if lines is not None:
        d = d.join(zone_keys(lines, profiles), ["book", "page"], "left")
    else:
        d = d.withColumn("zone", F.lit(None).cast(_NONE))
    zone, subs = _list(F.col("zone")), _list(F.col("_subs"))

    def without(s):
        cut = F.aggregate(subs, s, lambda acc, x: F.when(x == "", acc).otherwise(
            F.replace(acc, x, F.lit(" "))))
        cut = strip(squeeze_blanks(cut))
        # A blank line is kept as a paragraph mark; a line emptied by the cut is dropped (null).
        return F.when(s == "", "").otherwise(F.nullif(cut, F.lit("")))

    d = d.withColumn("_ls", F.filter(
        F.transform(split_lines(dehyphenate(normalize_unicode("raw"))), without),
        lambda s: s.isNotNull()))
    d = d.withColumn("_hit", match_any("_ls", F.when(F.size("_pats") > 0, F.col("_pats"))))
    deco, nums = F.coalesce("_deco", F.lit(False)), F.coalesce("_nums", F.lit(True))

    def keep(s, i):
        bad = ((deco & is_decorative(s)) | (nums & is_page_number(s))
               | F.coalesce(F.get("_hit", i), F.lit(False))
               | ((F.size(zone) > 0) & F.array_contains(zone, match_key(s, nfkc=False))))
        return (s == "") | ~bad

    kept = F.filter(F.col("_ls"), keep)
    spaced = F.transform(kept, lambda s: F.when(F.coalesce("_space", F.lit(False)),
                                                fix_letter_spacing(s)).otherwise(s))
    return d.select("book", "page", join_paragraphs(spaced).alias("text"))


def valid_rules(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Keep the rules whose pattern compiles."""
    @F.pandas_udf(T.BooleanType())
    def ok(s: pd.Series) -> pd.Series:
        return s.map(lambda p: p is not None and len(_patterns((p,))) > 0)
    return rules.filter(ok(F.col(pattern)))


def line_geometry(pages: DataFrame, text: str = "raw") -> DataFrame:
    """Non-empty lines of a page with number and vertical position 0..1000 by line count."""
    d = pages.select("book", "page", split_lines(text).alias("_ls"))
    d = d.select("book", "page", F.size("_ls").alias("_n"), F.posexplode("_ls").alias("line", "text"))
    y = F.least(F.lit(1000), F.greatest(F.lit(0), F.floor(F.col("line") * 1000 / F.col("_n"))))
    return d.filter("text <> ''").select("book", "page", "line", y.cast("int").alias("y"), "text")


def merge_spans(spans: DataFrame) -> DataFrame:
    """Text spans of a line to one line: joined text, largest size, bold if any span is bold."""
    g = spans.groupBy("book", "page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))),
                                 lambda x: x["text"]), "").alias("text"),
        F.round(F.max("size"), 1).alias("size"),
        F.bool_or(F.lower("font").contains("bold")).alias("bold"),
        F.min("y0").alias("_y0"), F.max("height").alias("_h"))
    y = F.least(F.lit(1000), F.greatest(F.lit(0), (F.col("_y0") / F.col("_h") * 1000).cast("int")))
    return g.withColumn("text", strip("text")).filter("text <> ''").select(
        "book", "page", "line", y.alias("y"), "size", "bold", "text")
