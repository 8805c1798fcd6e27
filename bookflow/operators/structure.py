"""Linear text, headings, markers and chapters."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from bookflow.functions.arrays import let
from bookflow.functions.text import WS_CHARS, _c, key_head, match_key, match_key_all, normalize_all, normalize_unicode, strip, title_matches, word_count
from bookflow.operators import scan
from bookflow.operators.clean import any_matches, match_any
from bookflow.operators.lookup import asof_cells, asof_scan, substring_join
from bookflow.settings import BLOCK, FRONT_MATTER_CHARS, SAMPLE_BUDGET, SECTION_WORDS, stage

OFFSET_CELL = 1 << 20          # characters per block of an offset scan


# ---- coordinates -----------------------------------------------------------------------------

def page_offsets(pages: DataFrame) -> DataFrame:
    """Add ``page_off``: start of each page in the book's text, pages joined by two line feeds."""
    return scan.prefix_sum(pages, ["book"], ["page"], F.floor(F.col("page") / BLOCK),
                           page_off=(F.length("text") + 2).cast("long"))


def book_lengths(pages: DataFrame) -> DataFrame:
    """Characters and pages of a book; with ``page_off`` also ``text_end``, where its last page that isn't blank ends."""
    end = F.max(F.when(strip("text") != "", F.col("page_off") + F.length(F.rtrim("text")))).cast("long")
    return pages.groupBy("book").agg((F.sum(F.length("text") + 2) - 2).cast("long").alias("book_len"),
                                     F.count("*").alias("n_pages"), *([end.alias("text_end")] if "page_off" in pages.columns else []))


def page_of_offset(probes: DataFrame, offsets: DataFrame) -> DataFrame:
    """Page that holds a character offset (0 before the first page)."""
    hit = asof_cells(probes, offsets, ["book"], "off", "page_off", ["page"], 4096)
    return hit.withColumn("page", F.coalesce("page", F.lit(0)))


# ---- headings --------------------------------------------------------------------------------

def _ratio_position(title: Column, norm: Column, length: Column) -> Column:
    """Position of the title's key in the page's key, scaled back to the page text; null if absent."""
    want = key_head(title, 40)
    pos = F.when(want != "", F.position(want, norm) - 1)
    return F.when(pos >= 0, F.floor(pos / F.greatest(F.lit(1), F.length(norm)) * length))


def locate_headings(toc: DataFrame, pages: DataFrame, strategy: str = "ratio") -> DataFrame:
    """Character offset of each (title, page) entry.

    ``pages`` carries ``page_off``.  ``ratio`` searches the key only, ``direct`` first looks for
    the title as written, ignoring case; both fall back to the page start. A page's key is made once, however many entries it has.
    """
    n = pages.groupBy("book").agg(F.max("page").alias("_max"))
    t = toc.join(n, "book").withColumn(
        "_pg", F.greatest(F.lit(0), F.least(F.col("page").cast("long"), F.col("_max"))))
    p = pages.select("book", F.col("page").cast("long").alias("_pg"), "page_off", "text").join(t.select("book", "_pg").distinct(), ["book", "_pg"], "left_semi")
    low = [F.lower("text").alias("_low")] if strategy == "direct" else []
    p = stage(p.select("book", "_pg", "page_off", F.length("text").alias("_len"), match_key_all("text").alias("_key"), *low), "page_keys")
    d = t.join(p, ["book", "_pg"])
    rel = _ratio_position(F.col("title"), F.col("_key"), F.col("_len"))
    if strategy == "direct":
        found = F.position(F.lower(strip("title")), F.col("_low")) - 1
        rel = F.coalesce(F.when((strip("title") != "") & (found >= 0), found), rel)
    return d.withColumn("off", (F.col("page_off") + F.coalesce(rel, F.lit(0))).cast("long")).drop(
        "_max", "_pg", "page_off", "_len", "_key", *(["_low"] if low else []))


def first_page_with(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """First page whose key holds the first 40 characters of the title's key, else 0. Keys of pages are written once, the search reads them several times."""
    want = titles.withColumn("_want", key_head("title", 40))
    keys = stage(pages.select("book", F.col("page").alias("_p"), match_key_all("text").alias("_text")), "page_keys")
    need = want.select("book", "_want").distinct()
    hit = substring_join(keys, need, "_text", "_want", ["_p"], ["book"]).groupBy("book", "_want").agg(
        F.min("_p").alias("_first"))
    return want.join(hit, ["book", "_want"], "left").withColumn(
        "page", F.coalesce("_first", F.lit(0)).cast("long")).drop("_want", "_first")


def page_find(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """All pages whose key holds the query's key, with a 200-character snippet of the first five."""
    from bookflow.functions.text import squash
    q = queries.withColumn("needle", match_key("q")).filter("needle <> ''")
    keys = pages.select("book", "page", match_key_all("raw").alias("_text"))
    hits = substring_join(keys, q, "_text", "needle", ["book", "page"]).select("q", "book", "page")
    top = (hits.withColumn("rank", F.row_number().over(W.partitionBy("q", "book").orderBy("page")))
           .filter("rank <= 5"))
    shown = top.join(pages, ["book", "page"]).select(
        "q", "book", "page", F.substring(squash("raw"), 1, 200).alias("snippet"))
    return hits.join(shown, ["q", "book", "page"], "left")


def scan_headings(pages: DataFrame, pattern: str | None = None,
                  profiles: DataFrame | None = None) -> DataFrame:
    """Paragraphs of 2 to 90 characters that match a pattern (one for all, or one per book)."""
    paras = pages.select("book", "page", F.posexplode(F.split("text", "\n")).alias("seq", "_p"))
    d = paras.select("book", "page", "seq", strip("_p").alias("title")).filter(
        F.length("title").between(2, 90))
    if pattern is not None:
        d = d.filter(F.col("title").rlike(pattern))
    else:
        p = profiles.select("book", F.col("structure.heading_pattern").alias("_rx")).filter("_rx <> ''")
        d = d.join(p, "book").filter(
            F.element_at(match_any(F.array("title"), F.array("_rx")), 1)).drop("_rx")
    return d.select("book", "page", "seq", F.lit(1).alias("level"), "title")


def upper_median(df: DataFrame, key: str, col: str, name: str = "median") -> DataFrame:
    """``sorted(values)[n // 2]`` per key, null values left out.

    Counts per distinct value are dealt by ranges of (key, value). One number for each (range, key) tells in which range the
    median lies; only there values are counted one by one. A key of any number of values is spread over tasks.
    """
    c = df.where(F.col(col).isNotNull()).groupBy(key, F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    c = stage(c.repartitionByRange(key, "_v").withColumn("_part", F.spark_partition_id()), "value_counts")
    parts = c.groupBy(key, "_part").agg(F.sum("_n").alias("_m"))
    run = W.partitionBy(key).orderBy("_part")
    parts = parts.withColumns({"_before": F.sum("_m").over(run) - F.col("_m"), "_half": F.floor(F.sum("_m").over(W.partitionBy(key)) / 2)})
    own = parts.where((F.col("_before") <= F.col("_half")) & (F.col("_half") < F.col("_before") + F.col("_m")))
    d = c.join(own.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), "_before", "_half"),
               F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    upto = F.sum("_n").over(W.partitionBy(key, "_part").orderBy("_v")) + F.col("_before")
    return d.withColumn("_upto", upto).where("_upto > _half").groupBy(key).agg(F.min("_v").alias(name))


def font_headings(lines: DataFrame) -> DataFrame:
    """Lines set clearly larger than body text, or bold and a little larger."""
    d = lines.join(upper_median(lines, "book", "size", "_body"), "book")
    big = (F.col("size") >= F.col("_body") * 1.25) | (
        F.col("bold") & (F.col("size") >= F.col("_body") * 1.1))
    return d.filter(big & F.length("text").between(2, 90)
                    & ~F.substring(F.col("text"), -1, 1).isin(".", ",", ";", ":")).drop("_body")


def thin_markers(markers: DataFrame, gap: int) -> DataFrame:
    """Drop markers closer than ``gap`` characters to the last kept one of the book.

    State of the fold: distance to the last kept marker, capped at ``gap`` (= keep the next).
    """
    d = scan.prev_value(markers, ["book"], ["off", "seq"], F.floor(F.col("off") / OFFSET_CELL),
                        _prev=F.col("off"))
    d = d.withColumn("_d", F.least(F.lit(gap), F.coalesce(F.col("off") - F.col("_prev"), F.lit(gap))
                                   ).cast("int")).drop("_prev")

    d = scan.finite_state(d, ["book"], ["off", "seq"], F.floor(F.col("off") / OFFSET_CELL), ["_d"],
                          gap + 1, scan.ResetSum(gap, gap + 1), start=gap, name="_s")
    return d.filter(F.col("_s") + F.col("_d") >= gap).drop("_s", "_d")


def noise_guard(markers: DataFrame, n_pages: DataFrame) -> DataFrame:
    """Drop a book's font markers when there are too many to be headings."""
    n = markers.groupBy("book").agg(F.count("*").alias("_n")).join(n_pages, "book")
    noisy = n.filter((F.col("_n") > F.greatest(F.lit(4), F.floor(F.col("n_pages") / 2) + 5))
                     & (F.col("_n") > 80)).select("book")
    return markers.join(noisy, "book", "left_anti")


def spine_markers(pages: DataFrame) -> DataFrame:
    """One chapter per page that has words; titled by a short first paragraph."""
    first = strip(F.substring_index("text", "\n\n", 1))
    title = F.when(F.length(first).between(1, 80), first).otherwise(
        F.concat(F.lit("Section "), (F.col("page") + 1).cast("string")))
    return pages.filter(word_count("text") > 0).select(
        "book", F.col("page").alias("seq"), F.lit(1).alias("level"), title.alias("title"), "page",
        F.col("page_off").alias("off"))


def prefer_source(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Markers of the first source (in the given order) that has any, per book."""
    u = None
    for rank, (name, df) in enumerate(sources):
        d = df.select("book", "seq", "level", "title", "page", "off",
                      F.lit(rank).alias("_rank"), F.lit(name).alias("toc_source"))
        u = d if u is None else u.unionByName(d)
    best = u.groupBy("book").agg(F.min("_rank").alias("_rank"))
    return u.join(best, ["book", "_rank"]).drop("_rank")


def profile_markers(profiles: DataFrame, pages: DataFrame, strategy: str = "ratio") -> DataFrame:
    """Markers from profiles: listed ones (``correct``) or headings found by pattern (``derive``)."""
    mode = F.coalesce(F.col("structure.toc"), F.lit("trust"))
    listed = (profiles.filter(mode == "correct")
              .select("book", F.posexplode("structure.markers").alias("seq", "m"))
              .select("book", "seq", F.greatest(F.lit(1), F.coalesce("m.level", F.lit(1))).alias("level"),
                      strip("m.title").alias("title"), F.col("m.page").cast("long").alias("page"))
              .filter("title <> ''"))
    derived = scan_headings(pages, profiles=profiles.filter(mode == "derive"))
    n = pages.groupBy("book").agg(F.max("page").alias("_max"))
    chk = listed.join(n, "book")
    ok = F.col("page").isNotNull() & F.col("page").between(0, F.col("_max"))
    # A search, whose rows are read twice below.
    fixed = stage(first_page_with(chk.filter(~F.coalesce(ok, F.lit(False))).drop("page", "_max"), pages), "found_pages")
    listed = chk.filter(ok).drop("_max").unionByName(fixed)
    a = locate_headings(listed, pages, strategy)
    b = locate_headings(derived.withColumn("seq", F.col("page") * 1_000_000 + F.col("seq")),
                        pages, strategy)
    b = thin_markers(b.withColumn("seq", F.col("seq").cast("long")), 200)
    cols = ["book", "seq", "level", "title", "page", "off"]
    return a.select(*cols).unionByName(b.select(*cols))


# ---- chapters --------------------------------------------------------------------------------

def chapter_bounds(markers: DataFrame, lengths: DataFrame,
                   front_matter: int = FRONT_MATTER_CHARS) -> DataFrame:
    """``(book, start, end, title, page)`` between level-1 markers, with front matter if long."""
    top = markers.filter("level = 1").select("book", "seq", "title", "page", F.col("off").alias("start"))
    nxt = scan.next_value(top, ["book"], ["start", "seq"], F.floor(F.col("start") / OFFSET_CELL),
                          end=F.col("start"))
    d = nxt.join(lengths.select("book", "book_len"), "book").withColumn(
        "end", F.coalesce("end", "book_len")).drop("book_len")
    front = (top.groupBy("book").agg(F.min("start").alias("end")).filter(F.col("end") >= front_matter)
             .select("book", F.lit(-1).alias("seq"), F.lit("Front Matter").alias("title"),
                     F.lit(0).alias("page"), F.lit(0).alias("start"), "end"))
    return d.unionByName(front).withColumn("level", F.lit(1))


def number_chapters(chapters: DataFrame) -> DataFrame:
    """Add the 0-based chapter index ``ch`` in text order."""
    return scan.row_index(chapters, ["book"], ["start", "seq"],
                          F.floor(F.col("start") / OFFSET_CELL), "ch")


def skip_sections(chapters: DataFrame, profiles: DataFrame) -> DataFrame:
    """Drop chapters named in the profile or lying in one of its page ranges."""
    p = profiles.select("book", F.col("skip_sections.titles").alias("_titles"),
                        F.col("skip_sections.page_ranges").alias("_ranges"))
    none = F.array().cast("array<string>")
    named = title_matches("title", F.coalesce("_titles", none))
    inside = F.exists(F.coalesce("_ranges", F.array().cast("array<array<int>>")),
                      lambda r: F.coalesce((F.get(r, F.lit(0)) <= F.col("page"))
                                           & (F.get(r, F.lit(1)) >= F.col("page")), F.lit(False)))
    return chapters.join(p, "book", "left").filter(~(named | inside)).drop("_titles", "_ranges")


def page_slices(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Cut pages at chapter bounds: ``(book, ch, page, base, text)``.

    ``base`` is the slice's start within the chapter.  Chapters do not overlap, so a page
    meets the chapter active at its start and the ones starting inside it.  Both come from a
    single carry-forward over the merged starts; no page is paired with other chapters.
    """
    ch = chapters.select("book", "ch", F.col("start").cast("long").alias("start"),
                         F.col("end").cast("long").alias("end"))
    pts = (ch.select("book", F.col("start").alias("_pos"), F.lit(1).alias("_k"), "ch",
                     F.struct("ch", "start", "end").alias("_c"),
                     F.lit(None).cast("long").alias("_page"))
           .unionByName(pages.select(
               "book", F.col("page_off").alias("_pos"), F.lit(0).alias("_k"), F.lit(-1).alias("ch"),
               F.lit(None).cast("struct<ch:bigint,start:bigint,end:bigint>").alias("_c"),
               F.col("page").cast("long").alias("_page"))))
    run = scan.last_value(pts, ["book"], ["_pos", "_k", "ch"], F.floor(F.col("_pos") / OFFSET_CELL),
                          _cc=F.col("_c"), _pp=F.col("_page"))
    cut = run.filter("_cc IS NOT NULL AND _pp IS NOT NULL").select(
        "book", F.col("_pp").alias("page"), F.col("_cc.ch").alias("ch"),
        F.col("_cc.start").alias("_s"), F.col("_cc.end").alias("_e")).distinct()
    d = pages.select("book", F.col("page").cast("long").alias("page"), "page_off", "text").join(
        cut, ["book", "page"])
    frm = F.greatest(F.col("_s") - F.col("page_off"), F.lit(0))
    to = F.least(F.col("_e") - F.col("page_off"), F.length("text"))
    return d.select("book", "ch", "page",
                    (F.col("page_off") + frm - F.col("_s")).alias("base"),
                    F.substring(F.col("text"), (frm + 1).cast("int"), F.greatest(
                        to - frm, F.lit(0)).cast("int")).alias("text")).filter("text <> ''")


def drop_empty(chapters: DataFrame, slices: DataFrame) -> DataFrame:
    """Drop chapters without words and renumber the rest (``old_ch`` keeps the old index)."""
    words = slices.groupBy("book", "ch").agg(F.sum(word_count("text")).alias("_w")).filter("_w > 0")
    kept = chapters.join(words.drop("_w"), ["book", "ch"], "left_semi").withColumnRenamed("ch", "old_ch")
    return number_chapters(kept)


def fixed_sections(sentences: DataFrame, words: int = SECTION_WORDS) -> DataFrame:
    """Number the sections of a book without chapters; a section closes at ``words`` words.

    ``sentences(book, page, k, w)``; adds the 0-based ``section`` of each sentence.  The word
    counter restarts at zero after each close, so this is a fold, run block-wise.
    """
    blk = F.floor(F.col("page") / 512)

    d = scan.finite_state(sentences, ["book"], ["page", "k"], blk, ["w"], words, scan.ResetSum(words, words), name="_s")
    d = stage(d.withColumn("closes", F.col("_s") + F.col("w") >= words), "section_ends")
    return scan.prefix_sum(d, ["book"], ["page", "k"], blk,
                           section=F.col("closes").cast("long")).drop("_s")


def section_bounds(sectioned: DataFrame, lengths: DataFrame) -> DataFrame:
    """Chapters from ``fixed_sections``: text between the ends of closing sentences.

    ``sectioned`` carries absolute ``start``/``end`` offsets.  The tail after the last close is
    a section of its own, also if it is text without a sentence (where ``lengths`` has ``text_end``); a book without
    sentences becomes one "Full Text" chapter.
    """
    g = sectioned.groupBy("book", "section").agg(
        F.min("start").alias("_first"), F.max("end").alias("_last"), F.bool_or("closes").alias("_closed"))
    # A section starts where the one before it ended; only the first starts at its sentence.
    near = scan.prev_value(g, ["book"], ["section"], F.floor(F.col("section") / BLOCK),
                           _prev=F.col("_last"))
    d = near.join(lengths.select("book", "book_len"), "book").select(
        "book", F.col("section").alias("seq"),
        F.concat(F.lit("Section "), (F.col("section") + 1).cast("string")).alias("title"),
        F.coalesce("_prev", "_first").alias("start"),
        F.when(F.col("_closed"), F.col("_last")).otherwise(F.col("book_len")).alias("end"))
    if "text_end" in lengths.columns:
        last = g.groupBy("book").agg(F.max_by(F.struct("section", "_last", "_closed"), "section").alias("z")).join(lengths, "book")
        d = d.unionByName(last.filter(F.col("z._closed") & (F.col("z._last") < F.col("text_end"))).select(
            "book", (F.col("z.section") + 1).alias("seq"), F.concat(F.lit("Section "), (F.col("z.section") + 2).cast("string")).alias("title"),
            F.col("z._last").alias("start"), F.col("book_len").alias("end")))
    full = lengths.join(g.select("book").distinct(), "book", "left_anti").select(
        "book", F.lit(0).alias("seq"), F.lit("Full Text").alias("title"), F.lit(0).alias("start"),
        F.col("book_len").alias("end"))
    return d.unionByName(full).withColumn("level", F.lit(1)).withColumn("page", F.lit(0))


# ---- heading labels at the start of a chapter --------------------------------------------------

LABELS = 3                                    # paragraphs that may be labels
# White space as \s of a Unicode pattern knows it, and what may stand behind a label.
_BLANK = "".join(c for c in WS_CHARS if c not in "\x1c\x1d\x1e\x1f")
_BEHIND_TITLE, _BEHIND_CAPS = " \n\t.,:;-", " \n\t"
_CAPS = (r"^((?:(?:[^A-Za-z \n]+ )*(?=[^ \n]*[A-Z][^ \na-zA-Z]*[A-Z])[^ \n\p{Ll}]+ ){2,})(?=[a-z]\s)")


def _skip(text: Column, at: Column, chars: str) -> Column:
    """Number of characters of a set that follow a position."""
    return let(F.substring(text, at + 1, F.length(text)), lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(chars))))


def _paras(text: Column) -> tuple[list[Column], list[Column]]:
    """The first lines that aren't blank, trimmed (empty: over 90 characters), and where each ends with the white space behind it (up to its last line feed).

    No lambdas, as a Python function takes the lines; what follows a line is a suffix of the text, so places come from lengths alone.
    """
    heads, ends, rest = [], [], F.ltrim(text, F.lit(_BLANK))
    for _ in range(LABELS):
        line = F.substring_index(rest, "\n", 1)
        own = F.ltrim(line, F.lit(WS_CHARS))
        # Trimming from the right reads a whole line, so that a long one is told by what follows its first characters.
        over = F.ltrim(F.substr(own, F.lit(91)), F.lit(WS_CHARS))
        heads.append(F.when(over == "", F.rtrim(F.substring(own, 1, 90), F.lit(WS_CHARS))).otherwise(F.lit("")))
        rest = F.ltrim(F.substr(rest, F.length(line) + 1), F.lit(_BLANK))
        upto = F.substring(text, F.lit(1), F.length(text) - F.length(rest))
        ends.append(F.length(upto) - F.when(rest == "", 0).otherwise(F.length(F.substring_index(upto, "\n", -1))))
    return heads, ends


@F.pandas_udf(StructType([StructField("heads", ArrayType(StringType())), StructField("ends", ArrayType(IntegerType())), StructField("hits", ArrayType(BooleanType()))]))
def _label_lines(heads: pd.Series, ends: pd.Series, patterns: pd.Series) -> pd.DataFrame:
    """Which lines match. Lines and places come back too: what goes on from here is a column, not the expressions over the text again."""
    return pd.DataFrame({"heads": heads, "ends": ends, "hits": any_matches(heads, patterns)})


def heading_cut(text, title, patterns) -> Column:
    """Number of leading characters of a chapter that are heading labels, not prose.

    Three steps, each bound to a variable: up to three short paragraphs that match a label
    pattern or repeat the title; the title glued to the first sentence; a run of capitals
    before a lone drop-cap letter ("FERRIES , AND HARBOURS n the"). Patterns that don't compile match nothing.
    """
    t = _c(text)
    key = match_key(F.coalesce(_c(title), F.lit("")))
    plain = normalize_unicode(strip(F.coalesce(_c(title), F.lit(""))))
    # The paragraphs that may be labels, normalised and matched before the steps, which run inside lambdas.
    heads, ends = _paras(t)
    lines = _label_lines(F.array(*heads), F.array(*ends), patterns)
    heads = lines["heads"]
    paras = F.zip_with(lines["ends"], F.zip_with(heads, F.zip_with(
        normalize_all(heads), F.coalesce(lines["hits"], F.array(*[F.lit(False)] * LABELS)),
        lambda k, hit: F.struct(match_key(k, nfkc=False).alias("key"), hit.alias("hit"))),
        lambda h, x: F.struct((h != "").alias("some"), x["key"].alias("key"), x["hit"].alias("hit"))),
        lambda end, x: F.struct(end.alias("end"), x["some"].alias("some"), x["key"].alias("key"), x["hit"].alias("hit")))

    def label(st, v, k):
        def judge(p):
            titled = (v["key"] != "") & ((p["key"] == v["key"]) | ((F.length(v["key"]) >= 4) & F.contains(v["key"], p["key"])))
            return F.struct(F.when(st["on"] & p["some"] & (p["hit"] | titled), p["end"]).otherwise(st["cut"]).alias("cut"),
                            (st["on"] & p["some"] & (p["hit"] | titled)).alias("on"))
        return let(F.get(v["paras"], F.lit(k)), judge)

    def glued(cut, v):
        at = cut + _skip(v["t"], cut, _BLANK)
        return let(at, lambda a: let(a + F.length(v["plain"]), lambda end: F.when(
            (F.length(v["plain"]) >= 4)
            & (F.lower(F.substring(v["t"], a + 1, F.length(v["plain"]))) == F.lower(v["plain"]))
            & F.substring(v["t"], end + 1, F.lit(1)).rlike(r"[ \n\t.,:;\-]"),
            end + _skip(v["t"], end, _BEHIND_TITLE)).otherwise(cut)))

    def capitals(cut, v):
        at = cut + _skip(v["t"], cut, _BLANK)
        return let(at, lambda a: let(F.regexp_extract(F.substring(v["t"], a + 1, F.length(v["t"])), _CAPS, 1),
                   lambda caps: F.when((v["key"] != "") & (caps != ""), a + F.length(caps) + _skip(
                       v["t"], a + F.length(caps), _BEHIND_CAPS)).otherwise(cut)))

    def run(v):
        start = F.struct(F.lit(0).alias("cut"), F.lit(True).alias("on"))
        usable = (F.size(v["pats"]) > 0) | (v["key"] != "")
        cut = let(start, lambda a: let(label(a, v, 0), lambda b: let(label(b, v, 1), lambda c: let(
            label(c, v, 2), lambda d: let(d["cut"], lambda e: let(glued(e, v), lambda f: capitals(f, v)))))))
        return F.when(usable, cut).otherwise(0).cast("int")

    return let(F.struct(t.alias("t"), key.alias("key"), plain.alias("plain"), patterns.alias("pats"), paras.alias("paras")), run)


# ---- page sample -----------------------------------------------------------------------------

def sample_pages(pages: DataFrame, toc: DataFrame, meta: DataFrame | None = None,
                 budget: int = SAMPLE_BUDGET) -> DataFrame:
    """Pages shown to a profiler: front matter, chapter starts, middle, end, within a budget.

    At most 20 pages per book are candidates, so the fold over them is bounded.
    """
    n = pages.groupBy("book").agg((F.max("page") + 1).alias("n"))
    mid = F.floor(F.col("n") / 2)
    fixed = n.select("book", F.explode(F.array_distinct(F.concat(
        F.sequence(F.lit(0), F.least(F.lit(5), F.col("n") - 1)),
        F.filter(F.array(mid - 1, mid, mid + 1), lambda p: (p >= 0) & (p < F.col("n"))),
        F.sequence(F.greatest(F.lit(0), F.col("n") - 3), F.col("n") - 1)))).alias("page"))
    level1 = (toc.filter("level = 1").groupBy("book", F.col("page").cast("long").alias("page"))
              .agg(F.min("seq").alias("seq")).join(n, "book")
              .filter((F.col("page") >= 0) & (F.col("page") < F.col("n"))))
    starts = (level1.filter("page >= 6")
              .withColumn("_r", F.row_number().over(W.partitionBy("book").orderBy("seq")))
              .filter("_r <= 8").select("book", "page"))
    cand = fixed.unionByName(starts).distinct().join(
        level1.select("book", "page", F.lit(True).alias("_l1")), ["book", "page"], "left")
    cand = cand.withColumn("priority", (F.col("page") < 6) | F.coalesce("_l1", F.lit(False))).drop("_l1")

    body = strip("raw")
    cap = F.when(F.col("priority"), 1800).otherwise(1000)
    view = F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\nTEXT:\n"),
                    F.when(F.length(body) > cap, F.concat(F.substring(body, F.lit(1), cap),
                                                          F.lit(" …[truncated]"))).otherwise(body))
    d = pages.join(cand, ["book", "page"]).select("book", "page", "priority", view.alias("view"))

    entries = toc.groupBy("book").agg(F.sum(
        F.length("title") + 6 + F.length(F.col("page").cast("string"))
        + 2 * F.greatest(F.lit(0), F.col("level") - 1)).alias("_toc"))
    caption = len("EMBEDDED TABLE OF CONTENTS (as extracted — may be wrong or empty):")
    head = F.lit(0)
    d = d.join(entries, "book", "left")
    if meta is not None:
        d = d.join(meta, "book", "left")
        head = F.length(F.concat(
            F.lit("BOOK: "), F.coalesce("meta_title", F.lit("?")), F.lit(" by "),
            F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("unknown")), F.lit("  ("),
            F.coalesce("ext", F.lit("?")), F.lit(", "), F.col("n_pages").cast("string"), F.lit(" pages)")))
    used0 = head + caption + F.coalesce("_toc", F.lit(len("  (none)")))
    item = F.struct((~F.col("priority")).alias("late"), "page", "priority", "view")
    g = d.withColumn("_u", used0).groupBy("book").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.max("_u").cast("int").alias("_u"))
    zero = F.struct(F.col("_u").alias("used"), F.array().cast("array<bigint>").alias("keep"))

    def take(acc, x):
        fits = (acc["used"] + F.length(x["view"]) <= budget) | (F.size(acc["keep"]) == 0)
        return F.when(fits, F.struct((acc["used"] + F.length(x["view"])).alias("used"),
                                     F.concat(acc["keep"], F.array(x["page"])).alias("keep"))
                      ).otherwise(acc)

    kept = F.aggregate("items", zero, take)["keep"]
    return g.withColumn("_keep", kept).select("book", "_keep", F.explode("items").alias("x")).filter(
        F.array_contains("_keep", F.col("x.page"))).select("book", "x.page", "x.priority", "x.view")
