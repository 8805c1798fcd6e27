"""Exports.

A document (manifest, subtitles, transcript, notes) of one book may be arbitrarily long, so no
operator builds it in one row.  Each returns *parts*, ``(book, <order>, text)``: bounded pieces
that give the document when concatenated in order (``write_parts`` does).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions.text import (block_id, blockquote, chapter_id, escape_markup, inline_tags, squash,
                                     strip, yaml_scalar)
from bookflow.functions.times import fmt_clock, fmt_dur, fmt_ts, pub_date
from bookflow.operators import scan
from bookflow.operators.catalog import book_status
from bookflow.settings import BLOCK, TIMING_VERSION
from bookflow.sources import listing
from bookflow.sources.documents import unquoted, write_documents
from bookflow.sources.manifests import is_ready

PART = 1024                    # lines, sentences or cues per part
LINES = "lines.txt"            # file name of documents written as lines


def _glue(df: DataFrame, by: Sequence[str], order: Sequence[str], text: Column, sep: str,
          name: str = "text") -> DataFrame:
    """Concatenate the rows of one part (at most ``PART`` of them) in order."""
    item = F.struct(*order, text.alias("_x"))
    return df.groupBy(*by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(item)), lambda v: v["_x"]), sep).alias(name))


def _at(ch, kind: int, part) -> list[Column]:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [lit(ch).cast("long").alias("ch"), F.lit(kind).alias("kind"), lit(part).cast("long").alias("part")]


# ---- subtitles and transcript ----------------------------------------------------------------

def to_srt(cues: DataFrame) -> DataFrame:
    """SRT parts ``(book, part, text)``; join them with a line feed."""
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), fmt_ts("st", ","), F.lit(" --> "),
                     fmt_ts("en", ","), F.lit("\n"), F.col("txt"), F.lit("\n"))
    d = cues.withColumn("part", F.floor((F.col("n") - 1) / PART))
    return _glue(d, ["book", "part"], ["n"], block, "\n")


def to_vtt(cues: DataFrame) -> DataFrame:
    """WebVTT parts; the first one carries the header."""
    block = F.concat(fmt_ts("st", "."), F.lit(" --> "), fmt_ts("en", "."), F.lit("\n"),
                     escape_markup("txt", "vtt"), F.lit("\n"))
    d = cues.withColumn("part", F.floor((F.col("n") - 1) / PART))
    g = _glue(d, ["book", "part"], ["n"], block, "\n")
    return g.withColumn("text", F.when(F.col("part") == 0, F.concat(F.lit("WEBVTT\n\n"), F.col("text")))
                        .otherwise(F.col("text")))


def to_transcript(books: DataFrame, chapters: DataFrame, sents: DataFrame) -> DataFrame:
    """Plain-text transcript parts ``(book, ch, kind, part, text)``; concatenate as they are.

    Sentences without text are skipped before their paragraph flag is read.
    """
    ready = chapters.filter(is_ready("status"))
    s = sents.withColumn("_t", squash("t")).filter("_t <> ''").join(
        ready.select("book", "ch"), ["book", "ch"], "left_semi")
    s = scan.prev_value(s, ["book", "ch"], ["i"], F.floor(F.col("i") / BLOCK),
                        _pp=F.coalesce(F.col("p").cast("int"), F.lit(0)))
    sep = F.when(F.col("_pp").isNull(), "\n\n").when(F.col("_pp") == 1, "\n").otherwise(" ")
    body = _glue(s.withColumn("part", F.floor(F.col("i") / PART)), ["book", "ch", "part"], ["i"],
                 F.concat(sep, F.col("_t")), "").select("book", *_at(F.col("ch"), 1, F.col("part")), "text")
    # An empty chapter leaves its blank line to the next heading.
    full = s.select("book", "ch").distinct().withColumn("_full", F.lit(True))
    h = ready.join(full, ["book", "ch"], "left")
    h = scan.prev_value(h, ["book"], ["ch"], F.floor(F.col("ch") / BLOCK),
                        _prev_full=F.coalesce("_full", F.lit(False)))
    head = h.select("book", *_at(F.col("ch"), 0, 0), F.concat(
        F.when(F.col("_prev_full") == F.lit(False), "\n").otherwise(""),
        F.lit("\n\n\n"), F.rtrim(F.concat(F.lit("## "), squash("title")))).alias("text"))
    top = books.select("book", *_at(-1, 0, 0), F.concat(
        F.coalesce(F.nullif(F.col("title"), F.lit("")), "book"),
        F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit("\nby "), F.col("author"))).otherwise("")
    ).alias("text"))
    end = books.select("book", *_at(2 ** 62, 2, 0), F.lit("\n").alias("text"))
    return top.unionByName(head).unionByName(body).unionByName(end)


# ---- manifest --------------------------------------------------------------------------------

def build_manifest(books: DataFrame, chapters: DataFrame, tl: DataFrame, topics: DataFrame,
                   cancelled: DataFrame | None = None) -> DataFrame:
    """Manifest JSON in parts ``(book, ch, kind, part, text)``; concatenated they are one document.

    Totals, readiness and status come from the chapters; start times are recomputed.
    """
    from bookflow.operators.timeline import chapter_starts
    status = book_status(chapters, cancelled)
    meta = books.drop("status", "chapters_total", "chapters_ready", "total_duration").join(status, "book")
    cols = [c for c in meta.columns if c not in ("book", "id", "timing_version")]
    head_json = F.to_json(F.struct(F.col("book").alias("id"), *cols,
                                   F.lit(TIMING_VERSION).alias("timing_version")))
    head = meta.select("book", *_at(-1, 0, 0), F.concat(
        F.regexp_replace(head_json, r"\}$", ""), F.lit(',"chapters":[')).alias("text"))
    foot = meta.select("book", *_at(2 ** 62, 9, 0), F.lit("]}").alias("text"))

    first = chapters.groupBy("book").agg(F.min("ch").alias("_first"))
    c = chapter_starts(chapters).join(first, "book")
    c_json = F.to_json(F.struct(chapter_id("ch").alias("id"), F.col("ch").alias("index"), "title", "level",
                                "page", "status", "audio", "duration",
                                F.round("start_global", 3).alias("start_global")))
    c_head = c.select("book", *_at(F.col("ch"), 0, 0), F.concat(
        F.when(F.col("ch") > F.col("_first"), ",").otherwise(""), F.regexp_replace(c_json, r"\}$", ""),
        F.lit(',"topics":[')).alias("text"))
    mid = c.select("book", *_at(F.col("ch"), 2, 0), F.lit('],"sentences":[').alias("text"))
    tail = c.select("book", *_at(F.col("ch"), 4, 0), F.lit("]}").alias("text"))

    def rows(df, pos, json, kind):
        x = F.concat(F.when(F.col(pos) > 0, ",").otherwise(""), json)
        g = _glue(df.withColumn("part", F.floor(F.col(pos) / PART)), ["book", "ch", "part"], [pos], x, "")
        return g.select("book", *_at(F.col("ch"), kind, F.col("part")), "text")

    t = rows(topics, "pos", F.to_json(F.struct("title", "level", "time"), {"ignoreNullFields": "false"}), 1)
    p = F.when(F.col("p").cast("int") == 1, 1)
    s = rows(tl, "i", F.to_json(F.struct("i", "t", "s", "e", "cs", "ce", p.alias("p"))), 3)
    out = head
    for d in (c_head, t, mid, s, tail, foot):
        out = out.unionByName(d)
    return out


# ---- notes -----------------------------------------------------------------------------------

def _note_parts(books, notes, chapters, header: Column, heading, body, after: DataFrame | None = None
                ) -> DataFrame:
    titles = chapters.select("book", "ch", squash("title").alias("_title"))
    n = notes.join(titles, ["book", "ch"], "left").withColumn("_title", F.coalesce(
        F.nullif(F.col("_title"), F.lit("")),
        F.concat(F.lit("Chapter "), (F.col("ch") + 1).cast("string"))))
    n = scan.row_index_sorted(n, ["book", "ch"], ["si", "cs", "created", "seq"], "_k")
    text = _glue(n.withColumn("part", F.floor(F.col("_k") / PART)), ["book", "ch", "part"], ["_k"], body,
                 "\n").select("book", *_at(F.col("ch"), 1, F.col("part")), "text")
    heads = n.groupBy("book", "ch").agg(F.first("_title").alias("_title")).select(
        "book", *_at(F.col("ch"), 0, 0), heading.alias("text"))
    none = books.join(notes.select("book").distinct(), "book", "left_anti").select(
        "book", *_at(0, 0, 0), F.lit("\n_No notes yet._").alias("text"))
    top = books.select("book", *_at(-1, 0, 0), header.alias("text"))
    out = top.unionByName(heads).unionByName(text).unionByName(none)
    return out if after is None else out.unionByName(after)


def _title() -> Column:
    return squash(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("book")))


def notes_markdown(books: DataFrame, notes: DataFrame, chapters: DataFrame, today: Column) -> DataFrame:
    """Markdown parts in reading order; join them with a line feed and end with one."""
    author = squash("author")
    has = author != ""
    header = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), yaml_scalar(_title())),
        F.when(has, F.concat(F.lit("author: "), yaml_scalar(author))),
        F.concat(F.lit("date: "), F.date_format(today, "yyyy-MM-dd")), F.lit("tags: [audiobook, notes]"),
        F.lit("---"), F.lit(""), F.concat(F.lit("# "), _title(), F.lit(" — Notes")),
        F.when(has, F.concat(F.lit("\n*by "), author, F.lit("*"))))
    quote, note, tags = squash("exact"), strip(F.coalesce("note", F.lit(""))), inline_tags(F.col("tags"))
    meta = F.concat(F.lit("*["), fmt_clock("s"), F.lit("]*"),
                    F.when(tags != "", F.concat(F.lit("  "), tags)).otherwise(""))
    body = F.concat(F.lit("\n"), F.when(quote != "", F.concat(blockquote(quote), F.lit("\n\n"))).otherwise(""),
                    meta, F.when(note != "", F.concat(F.lit("\n\n**Note:** "), note)).otherwise(""))
    return _note_parts(books, notes, chapters, header, F.concat(F.lit("\n## "), F.col("_title")), body)


def notes_obsidian(books: DataFrame, notes: DataFrame, chapters: DataFrame, today: Column,
                   source: str) -> DataFrame:
    """Callouts with block ids, and a tag list in the front matter.  ``source`` labels the exporter."""
    from bookflow.operators.notes import tag_list
    tags = scan.row_index(tag_list(notes).select("book", "at.*", "slug"), ["book"], ["seq", "pos"],
                          F.floor(F.col("seq") / BLOCK), "_k")
    tags = tags.select("book", *_at(-1, 1, F.col("_k")), F.concat(F.lit("  - "), "slug").alias("text"))
    author = squash("author")
    header = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), yaml_scalar(_title())),
        F.when(author != "", F.concat(F.lit("author: "), yaml_scalar(author))),
        F.concat(F.lit("date: "), F.date_format(today, "yyyy-MM-dd")), F.lit(f"source: {source}"),
        F.concat(F.lit("book_id: "), yaml_scalar("book")), F.lit("tags:\n  - audiobook\n  - notes"))
    close = books.select("book", *_at(-1, 2, 0), F.concat(F.lit("---\n\n# "), _title()).alias("text"))
    quote, note, inline = squash("exact"), strip(F.coalesce("note", F.lit(""))), inline_tags(F.col("tags"))
    body = F.concat_ws(
        "\n", F.concat(F.lit("\n> [!quote] "), F.col("_title"), F.lit(" — ["), fmt_clock("s"), F.lit("]")),
        F.when(quote != "", blockquote(quote)),
        F.when((note != "") | (inline != ""), ">"),
        F.when(note != "", blockquote(note)), F.when(inline != "", F.concat(F.lit("> "), inline)),
        block_id(F.col("ch"), F.col("si")))
    return _note_parts(books, notes, chapters, header, F.concat(F.lit("\n## "), F.col("_title")), body,
                       tags.unionByName(close))


def notes_documents(notes: DataFrame, part: int = PART) -> DataFrame:
    """Notes documents ``{book, version, notes[]}`` in reading order, in parts of ``part`` notes.

    A note may hold some 12,000 characters, so whoever writes the parts to files takes them one by one, without any gathered.
    """
    from bookflow.settings import NOTE_FIELDS
    fields = [f for f in NOTE_FIELDS if f in notes.columns]
    n = scan.row_index_sorted(notes, ["book"], ["ch", "si", "cs", "created", "id"], "_k")
    x = F.concat(F.when(F.col("_k") > 0, ",").otherwise(""), F.to_json(F.struct(*fields)))
    n = n.withColumn("part", F.floor(F.col("_k") / part))
    body = (n.withColumn("text", x) if part == 1 else _glue(n, ["book", "part"], ["_k"], x, "")).select(
        "book", *_at(0, 1, F.col("part")), "text")
    b = notes.select("book").distinct()
    head = b.select("book", *_at(-1, 0, 0), F.concat(
        F.regexp_replace(F.to_json(F.struct("book", F.lit(1).alias("version"))), r"\}$", ""),
        F.lit(',"notes":[')).alias("text"))
    tail = b.select("book", *_at(1, 0, 0), F.lit("]}").alias("text"))
    return head.unionByName(body).unionByName(tail)


# ---- feed and package ------------------------------------------------------------------------

def feed_items(books: DataFrame, chapters: DataFrame, files: DataFrame, base_url: str,
               default_author: str = "") -> DataFrame:
    """Podcast episodes: ready chapters with audio, numbered from 1 in chapter order."""
    d = chapters.filter(is_ready("status") & (F.coalesce("audio", F.lit("")) != ""))
    d = scan.row_index(d, ["book"], ["ch"], F.floor(F.col("ch") / BLOCK), "episode")
    f = files.select("book", F.col("name").alias("audio"), F.col("length").alias("_len"))
    d = d.join(f, ["book", "audio"], "left").join(
        books.select("book", "created", F.coalesce(F.nullif(F.col("author"), F.lit("")),
                                                   F.lit(default_author)).alias("author")), "book")
    base = base_url.rstrip("/")
    return d.select(
        "book", "ch", (F.col("episode") + 1).alias("episode"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(
            F.lit("Chapter "), (F.col("ch") + 1).cast("string"))).alias("title"),
        F.concat(F.lit(base + "/media/"), "book", F.lit("/"), "audio").alias("url"),
        F.coalesce("_len", F.lit(0)).cast("long").alias("length"),
        F.when(F.lower("audio").endswith(".mp3"), "audio/mpeg").otherwise("audio/wav").alias("mime"),
        F.concat_ws("-", "book", chapter_id("ch")).alias("guid"),
        pub_date("created", F.col("ch").cast("int")).alias("pub_date"),
        fmt_dur("duration").alias("duration"), "author")


def feed_xml(books: DataFrame, items: DataFrame, base_url: str, description: Column) -> DataFrame:
    """RSS parts per book; join them with a line feed.  ``description`` is an expression over books."""
    base = base_url.rstrip("/")
    x = lambda c: escape_markup(c, "xml")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), x(c), F.lit(f"</{name}>"))
    url = lambda leaf: F.concat(F.lit(base + "/api/books/"), "book", F.lit("/" + leaf))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("book"))
    head = books.select("book", *_at(-1, 0, 0), F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'),
        F.lit('<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" '
              'xmlns:atom="http://www.w3.org/2005/Atom">'),
        F.lit("  <channel>"), F.concat(F.lit("    "), tag("title", title)),
        F.concat(F.lit("    "), tag("link", F.lit(base))),
        F.concat(F.lit("    <atom:link href="), escape_markup(url("feed.xml"), "attr"),
                 F.lit(' rel="self" type="application/rss+xml"/>')),
        F.lit("    <language>en</language>"), F.concat(F.lit("    "), tag("itunes:author", F.col("author"))),
        F.concat(F.lit("    "), tag("description", description)),
        F.concat(F.lit("    "), tag("itunes:summary", description)),
        F.lit("    <itunes:explicit>false</itunes:explicit>"),
        F.concat(F.lit("    <itunes:image href="), escape_markup(url("cover.png"), "attr"), F.lit("/>")),
        F.concat(F.lit("    <image>"), tag("url", url("cover.png")), tag("title", title),
                 tag("link", F.lit(base)), F.lit("</image>")),
        F.lit('    <itunes:category text="Books"/>')).alias("text"))
    item = F.concat_ws(
        "\n", F.lit("    <item>"), F.concat(F.lit("      "), tag("title", F.col("title"))),
        F.concat(F.lit("      <itunes:episode>"), F.col("episode").cast("string"), F.lit("</itunes:episode>")),
        F.lit("      <itunes:episodeType>serial</itunes:episodeType>"),
        F.concat(F.lit("      <enclosure url="), escape_markup("url", "attr"), F.lit(' length="'),
                 F.col("length").cast("string"), F.lit('" type="'), "mime", F.lit('"/>')),
        F.concat(F.lit('      <guid isPermaLink="false">'), x(F.col("guid")), F.lit("</guid>")),
        F.concat(F.lit("      <pubDate>"), "pub_date", F.lit("</pubDate>")),
        F.concat(F.lit("      <itunes:duration>"), "duration", F.lit("</itunes:duration>")),
        F.concat(F.lit("      "), tag("itunes:author", F.col("author"))), F.lit("    </item>"))
    body = _glue(items.withColumn("part", F.floor(F.col("episode") / PART)), ["book", "part"], ["episode"],
                 item, "\n").select("book", *_at(0, 1, F.col("part")), "text")
    foot = books.select("book", *_at(1, 2, 0), F.lit("  </channel>\n</rss>").alias("text"))
    return head.unionByName(body).unionByName(foot)


def package_plan(books: DataFrame, chapters: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to pack per eligible book, and the refused books with the reason.

    Only ready books qualify, and every audio file of a ready chapter must exist.
    """
    wanted = chapters.filter(is_ready("status") & (F.coalesce("audio", F.lit("")) != "")).select(
        "book", F.col("audio").alias("name"))
    have = files.select("book", "name")
    missing = wanted.join(have, ["book", "name"], "left_anti").groupBy("book").agg(
        F.min("name").alias("missing"))
    ready = is_ready("status")
    refused = books.filter(~ready).select("book", F.concat(F.lit("status "), "status").alias("reason")).unionByName(
        books.filter(ready).join(missing, "book").select(
            "book", F.concat(F.lit("missing "), "missing").alias("reason")))
    ok = books.filter(ready).join(missing, "book", "left_anti").select("book")
    notes = have.filter("name = 'notes.json'")
    listing = (ok.select("book", F.lit("manifest.json").alias("name"), F.lit(0).alias("kind"))
               .unionByName(notes.join(ok, "book", "left_semi").withColumn("kind", F.lit(1)))
               .unionByName(wanted.join(ok, "book", "left_semi").withColumn("kind", F.lit(2))))
    return listing, refused


def write_parts(parts: DataFrame, path: str, order: Sequence[str] = ("ch", "kind", "part")) -> None:
    """Write documents as text: a folder per book, its files and lines in document order.

    Range partitioning cuts a long document over several files instead of one task.  Each part
    ends with a line feed, so this suits documents whose parts are joined by one. One rename commits all files, not one for each.
    """
    write_documents(parts, path, LINES, "\n", order=order)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(book, line)`` of what ``write_parts`` has written; tasks list and read the files."""
    files = listing.listed(spark, f"{path.rstrip('/')}/*/*/*/{LINES}*")
    return listing.lines(files).select(unquoted("dir").alias("book"), "line")
