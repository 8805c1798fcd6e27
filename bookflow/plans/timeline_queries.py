"""Registered queries: timelines, as-of lookups, cues and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.functions import text as T
from bookflow.operators import chapters as CH, export, segment, structure, timeline as TL
from bookflow.operators.lookup import asof_grid
from bookflow.plans import inputs as I, structure_queries as SQ
from bookflow.plans.structure_queries import BOUNDS, SLICES, chapters, corpus
from bookflow.plans.text_queries import _ts
from bookflow.settings import new_folder, stage

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


@query(f"""WITH {I.CORPUS_SENT}, {I.sql_timeline()}, u AS (SELECT book, sum(length(raw)) AS n FROM pg GROUP BY book),
  b AS (SELECT book, count(DISTINCT page) AS n_pages, count(*) AS n_sentences, sum({I.sql_words('t')})::BIGINT AS n_words,
    ((sum(dur + gap) * 1000 + 12000) // 24000) / 1000.0::DOUBLE AS duration_s FROM tl GROUP BY book),
  c AS (SELECT book, sum(length(text))::BIGINT AS n_chars FROM cl GROUP BY book)
  SELECT book, n_pages, n_sentences, n_words, n_chars, duration_s FROM b JOIN c USING (book)""")
def book_totals(spark, sf):
    """Flagship: clean, segment and time every book; totals per book in one aggregation.

    No order is needed for totals, so pages never meet: the only shuffles deal raw texts over the tasks and bring one
    partial sum per task and book together.
    """
    from bookflow.functions.times import est_samples
    from bookflow.operators.clean import clean_text
    d = I.dealt(I.table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    d = d.select(F.col("source").alias("book"), clean_text("text").alias("text"))
    d = d.withColumn("_s", segment.sentence_spans("text"))
    gap = lambda p: F.when(p, 7680).otherwise(2160)
    add = lambda f: F.aggregate("_s", F.lit(0).cast("long"), lambda a, s: a + f(s))
    page = d.select("book", F.length("text").alias("c"), F.size("_s").alias("n"),
                    add(lambda s: est_samples(s["t"]) + gap(s["p"])).alias("samples"),
                    add(lambda s: T.word_count(s["t"])).alias("w"))
    return page.groupBy("book").agg(
        F.count_if(F.col("n") > 0).alias("n_pages"), F.sum("n").alias("n_sentences"), F.sum("w").alias("n_words"),
        F.sum("c").cast("long").alias("n_chars"), TL._ms(F.sum("samples")).alias("duration_s"))


@query(f"""WITH {I.CORPUS_SENT}, {I.sql_timeline()} SELECT book, page, k::INTEGER AS k, i, s, e FROM tl""")
def timeline(spark, sf):
    return TL.timeline(I.spoken_sentences(spark, sf)).select("book", "page", "k", "i", "s", "e")


@query(f"""WITH {I.CORPUS_SENT}, {I.sql_timeline()} SELECT book, i, settled AS s, e FROM tl""")
def settled(spark, sf):
    """The general operator on stored (raw) times."""
    raw = stage(TL.timeline(I.spoken_sentences(spark, sf)).select("book", "ch", "i", "s", "e"), "raw_times")
    return TL.settle(raw).select("book", "i", "s", "e")


@query(f"""WITH {I.CORPUS_SENT}, {I.sql_timeline()} SELECT book, i, settled FROM tl""")
def settled_in_one_scan(spark, sf):
    return TL.timeline(I.spoken_sentences(spark, sf)).select("book", "i", "settled")


@query(f"""WITH {I.TURN_SENT}, tlq AS (SELECT *, {I.sql_words('t')} AS w FROM sen),
  d AS (SELECT book, ch, sum(greatest(8400, w * 4800) + CASE WHEN p THEN 7680 ELSE 2160 END) AS n FROM tlq GROUP BY 1, 2)
  SELECT book, ch, ((n * 1000 + 12000) // 24000) / 1000.0::DOUBLE AS duration FROM d""")
def pluggable_duration(spark, sf):
    """A different duration function: 0.2 seconds per word."""
    model = lambda t: F.greatest(F.lit(8400), T.word_count(t) * 4800).cast("long")
    return TL.chapter_durations(I.turn_sentences(spark, sf), model)


TURN_TL = f"{I.TURN_SENT}, {I.sql_timeline()}"


def turn_timeline(spark, sf):
    # Sentences are cut once, the timeline reads them twice.
    sents = stage(TL.spoken(I.turn_sentences(spark, sf)), "turn_sentences")
    return stage(TL.timeline(sents).select(
        "book", "ch", "k", F.col("i").cast("int").alias("i"), "t", "cs", "ce", "p", "s", "e", "settled"), "turns")


@query(f"""WITH {TURN_TL}, tp AS (SELECT book, ch, i AS pos, CASE WHEN i % 2 = 0 THEN s ELSE s + 0.0001::DOUBLE END AS time FROM tl WHERE i % 3 < 2),
  old AS (SELECT book FROM (SELECT DISTINCT book FROM tl) WHERE book::INTEGER % 3 <> 0)
  SELECT tp.book, tp.ch, tp.pos::INTEGER AS pos, coalesce(CASE WHEN tp.book IN (FROM old) THEN settled END, tp.time) AS time,
    CASE WHEN tp.book::INTEGER % 3 = 1 THEN 2 WHEN tp.book::INTEGER % 3 = 2 THEN 2 ELSE 3 END AS timing_version
  FROM tp LEFT JOIN tl ON tl.book = tp.book AND tl.ch = tp.ch AND tl.s = tp.time""")
def upgrade_timings(spark, sf):
    """Topic times follow the settled starts in books below the current timing version only."""
    tl = turn_timeline(spark, sf)
    m = F.col("book").cast("int") % 3
    books = tl.select("book").distinct().withColumn(
        "timing_version", F.when(m == 0, 3).when(m == 1, 1))
    topics = tl.filter("i % 3 < 2").select("book", "ch", F.col("i").alias("pos"), F.when(
        F.col("i") % 2 == 0, F.col("s")).otherwise(F.col("s") + 0.0001).alias("time"))
    b, _, t = TL.upgrade_timings(books, tl.select("book", "ch", "i", "s", "e"), topics)
    return t.join(b, "book")


@query(f"""WITH {TURN_TL} SELECT book, ch, i::INTEGER AS i, CASE WHEN book::INTEGER % 3 > 0 THEN settled ELSE s END AS s, e FROM tl""")
def upgraded_sentences(spark, sf):
    """The sentence table of the same upgrade: old books are settled, the others stay."""
    tl = turn_timeline(spark, sf)
    m = F.col("book").cast("int") % 3
    books = tl.select("book").distinct().withColumn("timing_version", F.when(m == 0, 3).when(m == 1, 1))
    return TL.upgrade_timings(books, tl.select("book", "ch", "i", "s", "e"), tl.select("book", "ch", F.col("s").alias("time")))[1]


PROBES = """prb AS (SELECT e.event_id, (e.user_id % 100)::VARCHAR AS book, (e.event_id % 8) AS ch, e.value - 2 AS t FROM events e)"""


def _probes(spark, sf):
    return I.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 100).cast("string").alias("book"), (F.col("event_id") % 8).alias("ch"),
        (F.col("value") - 2).alias("t"))


@query(f"""WITH {TURN_TL}, {PROBES} SELECT p.event_id, coalesce(max(tl.i), -1)::INTEGER AS i FROM prb p
  LEFT JOIN tl ON tl.book = p.book AND tl.ch = p.ch AND tl.s <= p.t GROUP BY p.event_id""")
def active_sentence(spark, sf):
    """Sentence being spoken at each event's time; -1 before the first or in a missing chapter."""
    return asof_grid(_probes(spark, sf), turn_timeline(spark, sf), ["book", "ch"], "t", "s", "i").select("event_id", "i")


@query(f"""WITH {TURN_TL}, {PROBES}, o AS (SELECT event_id, book, ch, (event_id * 7) % 900 AS rel FROM prb),
  a AS (SELECT o.event_id, arg_max(tl.s, tl.i) FILTER (tl.cs <= o.rel) AS s, arg_min(tl.s, tl.i) AS f FROM o
    LEFT JOIN tl ON tl.book = o.book AND tl.ch = o.ch GROUP BY o.event_id)
  SELECT event_id, coalesce(s, f, 0) AS time FROM a""")
def time_at_char(spark, sf):
    p = _probes(spark, sf).select("event_id", "book", "ch", (F.col("event_id") * 7 % 900).alias("rel"))
    return TL.time_at_char(p, turn_timeline(spark, sf)).select("event_id", "time")


@query(f"""WITH {SLICES}, {I.sql_sentences('sls')}, {I.sql_timeline()},
  tp AS (SELECT m.book, c.ch, m.seq, m.title, m.off - c.start AS rel FROM mk m JOIN ch c ON c.book = m.book
    AND c.start < m.off AND m.off < c."end" WHERE m.level >= 2),
  a AS (SELECT tp.book, tp.ch, tp.seq, tp.title, arg_max(tl.settled, tl.i) FILTER (tl.cs <= tp.rel) AS s,
    arg_min(tl.settled, tl.i) AS f FROM tp LEFT JOIN tl USING (book, ch) GROUP BY 1, 2, 3, 4)
  SELECT book, ch, seq, title, coalesce(s, f, 0) AS time FROM a""")
def topic_times(spark, sf):
    """From headings to times: chapters, slices, sentences, timeline, topics."""
    pages = corpus(spark, sf)
    m, ch = chapters(spark, sf, pages)
    ch = stage(ch, "chapters")
    sents = TL.spoken(segment.sentences(structure.page_slices(ch, pages))).drop("t", "ce")
    tl = TL.timeline(stage(sents, "chapter_sentences"))
    tl = stage(tl.select("book", "ch", "i", "cs", F.col("settled").alias("s")), "chapter_timeline")
    return TL.time_at_char(TL.topics_of_chapters(m, ch), tl).select("book", "ch", "seq", "title", "time")


@query("""SELECT o_custkey::VARCHAR AS book, o_orderkey AS ch,
  round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS start_global FROM orders""")
def chapter_starts(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("book"),
                                            F.col("o_orderkey").alias("ch"), F.col("o_totalprice").alias("duration"))
    return TL.chapter_starts(o).select("book", "ch", F.round("start_global", 2).alias("start_global"))


@query(f"""WITH {TURN_TL} SELECT book, ch, i::INTEGER AS i, coalesce(sum(p::INTEGER) OVER (PARTITION BY book, ch ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS para FROM tl""")
def paragraph_ids(spark, sf):
    return TL.paragraph_ids(turn_timeline(spark, sf)).select("book", "ch", "i", "para")


@query(f"""WITH {TURN_TL} SELECT book, ch, i::INTEGER AS i, lag(i) OVER w::INTEGER AS prev_i, lead(i) OVER w::INTEGER AS next_i FROM tl
  WINDOW w AS (PARTITION BY book, ch ORDER BY i)""".replace("lag(i) OVER w::INTEGER", "CAST(lag(i) OVER w AS INTEGER)")
       .replace("lead(i) OVER w::INTEGER", "CAST(lead(i) OVER w AS INTEGER)"))
def adjacent_sentences(spark, sf):
    return TL.neighbours(turn_timeline(spark, sf)).select("book", "ch", "i", "prev_i", "next_i")


@query("""WITH w AS (SELECT l_orderkey AS si, l_linenumber AS w, l_quantity AS st, l_quantity + l_discount - 0.03::DOUBLE AS en FROM lineitem),
  g AS (SELECT si, arg_min(st, w) AS s, arg_max(en, w) AS e FROM (SELECT si, w, min(st) AS st, min(en) AS en FROM w GROUP BY 1, 2) GROUP BY si),
  x AS (SELECT o_custkey AS ch, o_orderkey AS si, s, greatest(e, s) AS e FROM orders LEFT JOIN g ON si = o_orderkey),
  y AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY ch ORDER BY si ROWS UNBOUNDED PRECEDING) AS le FROM x)
  SELECT ch, si, round(coalesce(s, le, 0), 3) AS s, round(coalesce(e, le, 0), 3) AS e FROM y""")
def align_spans(spark, sf):
    """Order lines as words, orders as sentences of a customer; some orders have no lines."""
    w = I.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_quantity").alias("start"), F.min(F.col("l_quantity") + F.col("l_discount") - 0.03).alias("end"))
    o = I.table(spark, sf, "orders").select(F.lit("b").alias("book"), F.col("o_custkey").alias("ch"),
                                            F.col("o_orderkey").alias("si"))
    w = w.join(o, w.l_orderkey == o.si).select("book", "ch", "si", F.col("l_linenumber").alias("w"), "start", "end")
    return TL.align_spans(w, o).select("ch", "si", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


# Turns spoken in chunks of 120 characters: every third chunk has no words, some have no audio, some sentences no words.
_CHUNKED = f"""WITH RECURSIVE {I.TURN_SENT}, n AS (SELECT book, ch, k, t, length(t) AS n, p, row_number() OVER (PARTITION BY book, ch ORDER BY k) AS r FROM sen),
  f AS (SELECT book, ch, k, t, r, n, p, 0::BIGINT AS chunk, CASE WHEN p THEN 0 ELSE n END AS used, p AS shut FROM n WHERE r = 1
    UNION ALL SELECT n.book, n.ch, n.k, n.t, n.r, n.n, n.p, f.chunk + CASE WHEN f.shut OR (f.used > 0 AND f.used + n.n > 120) THEN 1 ELSE 0 END,
      CASE WHEN n.p THEN 0 WHEN f.used > 0 AND f.used + n.n > 120 THEN n.n ELSE f.used + n.n END, n.p FROM f JOIN n ON n.book = f.book AND n.ch = f.ch AND n.r = f.r + 1),
  d AS (SELECT book, ch, chunk, k AS i, t, p, {I.sql_samples('t')} AS dur, k - min(k) OVER c AS pos, count(*) OVER c AS m,
      bool_or(k % 5 <> 2) OVER c AND (chunk + ch) % 3 <> 0 AND chunk % 7 <> 6 AS ok, len(string_split(t, ' ')) AS nw, max(k) OVER c AS last FROM f WINDOW c AS (PARTITION BY book, ch, chunk)),
  l0 AS (SELECT *, CASE WHEN i % 5 <> 2 THEN 0.6::DOUBLE * pos END AS s0, CASE WHEN i % 5 <> 2 THEN 0.04::DOUBLE * (nw - 1) + 0.6::DOUBLE * pos + 0.03::DOUBLE END AS e0,
      coalesce(sum(dur + 2160) OVER (PARTITION BY book, ch, chunk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t0 FROM d),
  l AS (SELECT *, coalesce(s0, last_value(e0 IGNORE NULLS) OVER w, 0) AS sl, coalesce(e0, last_value(e0 IGNORE NULLS) OVER w, 0) AS el FROM l0
      WINDOW w AS (PARTITION BY book, ch, chunk ORDER BY i ROWS UNBOUNDED PRECEDING)),
  ck AS (SELECT book, ch, chunk, CASE WHEN bool_or(ok) THEN 24000 * max(m) + 7 * chunk ELSE sum(dur + 2160) END + CASE WHEN bool_or(p AND i = last) THEN 7680 ELSE 2160 END AS total FROM l GROUP BY 1, 2, 3),
  st AS (SELECT book, ch, chunk, coalesce(sum(total) OVER (PARTITION BY book, ch ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ck)
  SELECT book, ch, chunk, i::INTEGER AS i, CASE WHEN ok THEN floor(start / 24.0::DOUBLE + sl * 1000 + 0.5) / 1000 ELSE ((start + t0) * 1000 + 12000) // 24000 / 1000.0::DOUBLE END AS s,
    CASE WHEN ok THEN floor(start / 24.0::DOUBLE + el * 1000 + 0.5) / 1000 ELSE ((start + t0 + dur) * 1000 + 12000) // 24000 / 1000.0::DOUBLE END AS e FROM l JOIN st USING (book, ch, chunk)"""


@query(_CHUNKED)
def chunked_timeline(spark, sf):
    sents = stage(I.turn_sentences(spark, sf), "turn_sentences")
    d = sents.join(segment.chunk_sentences(sents, budget=120).drop("n"), ["book", "ch", "page", "k"]).select(
        "book", "ch", "chunk", F.col("k").alias("i"), "t", "p")
    d = stage(d, "turn_chunks")
    heard = (F.col("chunk") + F.col("ch")) % 3 != 0
    first = d.groupBy("book", "ch", "chunk").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    start = F.lit(0.04) * F.col("w") + F.lit(0.6) * (F.col("i") - F.col("first"))
    words = d.join(first, ["book", "ch", "chunk"]).where(heard & (F.col("i") % 5 != 2)).withColumn(
        "w", F.explode(F.sequence(F.lit(0), F.size(F.split("t", " ")) - 1))).select(
        "book", "ch", "chunk", F.col("i").alias("si"), "w", start.alias("start"), (start + F.lit(0.03)).alias("end"))
    audio = first.where(heard & (F.col("chunk") % 7 != 6)).select("book", "ch", "chunk", (F.col("n") * 24000 + F.col("chunk") * 7).alias("samples"))
    return TL.chunked_timeline(d, words, audio).select("book", "ch", "chunk", F.col("i").cast("int").alias("i"), "s", "e")


# ---- cues and exports: conversations as books, turns as chapters, every fifth turn pending ------

CUES = f"""{TURN_TL}, dur AS (SELECT book, ch, ((sum(dur + gap) * 1000 + 12000) // 24000) / 1000.0::DOUBLE AS duration FROM tl0 GROUP BY 1, 2),
  chp AS (SELECT book, ch, duration, CASE WHEN (book::INTEGER + ch) % 5 = 4 THEN 'pending' WHEN ch = 0 THEN NULL ELSE 'ready' END AS status,
    'Turn ' || (ch + 1) AS title FROM dur),
  sh AS (SELECT book, ch, coalesce(sum(duration) OVER (PARTITION BY book ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift
    FROM chp WHERE coalesce(status, 'ready') = 'ready'),
  cu0 AS (SELECT book, ch, i, settled + shift AS st, e + shift AS en, t AS txt FROM tl JOIN sh USING (book, ch)),
  cu AS (SELECT book, ch, i, st, CASE WHEN en <= st THEN st + 0.5 ELSE en END AS en, txt,
    row_number() OVER (PARTITION BY book ORDER BY ch, i) AS n FROM cu0 WHERE txt <> '')"""


def turn_chapters(spark, sf, tl=None):
    # One short row for each turn, that exports read many times.
    d = stage(TL.chapter_durations(I.turn_sentences(spark, sf)), "turn_durations")
    pending = (F.col("book").cast("int") + F.col("ch")) % 5 == 4
    return d.withColumns({
        "status": F.when(pending, "pending").when(F.col("ch") == 0, None).otherwise("ready"),
        "title": F.concat(F.lit("Turn "), (F.col("ch") + 1).cast("string"))})


def turn_books(spark, sf):
    c = I.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("book")).distinct()
    return c.withColumns({"title": F.concat(F.lit("Talk: "), "book"), "author": F.when(
        F.col("book").cast("int") % 2 == 0, "A. \"N\" Other").otherwise("")})


def turn_cues(spark, sf):
    tl = turn_timeline(spark, sf).withColumn("s", F.col("settled"))
    return TL.cues(turn_chapters(spark, sf), tl)


@query(f"WITH {CUES} SELECT book, ch, i::INTEGER AS i, n, round(st, 3) AS st, round(en, 3) AS en, txt FROM cu")
def whole_book_cues(spark, sf):
    return turn_cues(spark, sf).select("book", "ch", "i", "n", F.round("st", 3).alias("st"), F.round("en", 3).alias("en"), "txt")


@query(f"""WITH {CUES} SELECT book, 0::BIGINT AS part, string_agg(n || chr(10) || {_ts('st', ',')} || ' --> ' || {_ts('en', ',')} || chr(10) || txt || chr(10),
  chr(10) ORDER BY n) AS text FROM cu GROUP BY book""")
def cues_srt(spark, sf):
    return export.to_srt(turn_cues(spark, sf))


@query(f"""WITH {CUES} SELECT book, 0::BIGINT AS part, 'WEBVTT' || chr(10) || chr(10) || string_agg({_ts('st', '.')} || ' --> ' || {_ts('en', '.')} || chr(10) ||
  replace(replace(replace(txt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10), chr(10) ORDER BY n) AS text FROM cu GROUP BY book""")
def cues_vtt(spark, sf):
    return export.to_vtt(turn_cues(spark, sf))


@query(f"""WITH {CUES}, s AS (SELECT tl.*, sum(p::INTEGER) OVER (PARTITION BY tl.book, tl.ch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS para
    FROM tl JOIN sh USING (book, ch)),
  pa AS (SELECT book, ch, coalesce(para, 0) AS para, string_agg(t, ' ' ORDER BY i) AS x FROM s GROUP BY 1, 2, 3),
  b AS (SELECT DISTINCT conv_id::VARCHAR AS book FROM conversations)
  SELECT book, -1::BIGINT AS ch, 0 AS kind, 0::BIGINT AS part, 'Talk: ' || book || CASE WHEN book::INTEGER % 2 = 0 THEN chr(10) || 'by A. "N" Other' ELSE '' END AS text FROM b
  UNION ALL SELECT book, ch, 0, 0, chr(10) || chr(10) || chr(10) || '## Turn ' || (ch + 1) FROM sh
  UNION ALL SELECT book, ch, 1, 0, chr(10) || chr(10) || string_agg(x, chr(10) ORDER BY para) FROM pa GROUP BY 1, 2
  UNION ALL SELECT book, 4611686018427387904, 2, 0, chr(10) FROM b""")
def transcript(spark, sf):
    """In parts; a turn has fewer sentences than a part holds."""
    return export.to_transcript(turn_books(spark, sf), turn_chapters(spark, sf), turn_timeline(spark, sf))


@query(f"""WITH {CUES}, s AS (SELECT tl.*, sum(p::INTEGER) OVER (PARTITION BY tl.book, tl.ch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS para
    FROM tl JOIN sh USING (book, ch)),
  pa AS (SELECT book, ch, coalesce(para, 0) AS para, string_agg(t, ' ' ORDER BY i) AS x FROM s GROUP BY 1, 2, 3),
  b AS (SELECT DISTINCT conv_id::VARCHAR AS book FROM conversations),
  parts AS (SELECT book, -1::BIGINT AS ch, 0 AS kind, 0::BIGINT AS part, 'Talk: ' || book || CASE WHEN book::INTEGER % 2 = 0 THEN chr(10) || 'by A. "N" Other' ELSE '' END AS text FROM b
    UNION ALL SELECT book, ch, 0, 0, chr(10) || chr(10) || chr(10) || '## Turn ' || (ch + 1) FROM sh
    UNION ALL SELECT book, ch, 1, 0, chr(10) || chr(10) || string_agg(x, chr(10) ORDER BY para) FROM pa GROUP BY 1, 2
    UNION ALL SELECT book, 4611686018427387904, 2, 0, chr(10) FROM b)
  SELECT book, line, count(*) AS n FROM (SELECT book, unnest(string_split(text, chr(10))) AS line FROM parts) GROUP BY book, line""")
def transcript_files(spark, sf):
    """Transcripts written as text files, a folder per book, and read back line by line."""
    path = new_folder(spark, "transcripts")
    export.write_parts(transcript(spark, sf), path)
    return export.read_lines(spark, path).groupBy("book", "line").agg(F.count("*").alias("n"))


MANIFEST_PARTS = f"""WITH {CUES}, ok AS (SELECT *, coalesce(status, 'ready') = 'ready' AS ok, min(ch) OVER (PARTITION BY book) AS first,
    round(coalesce(sum(duration) OVER (PARTITION BY book ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS sg FROM chp),
  bt AS (SELECT book, count(*) AS n, count(*) FILTER (ok) AS r, round(sum(CASE WHEN ok THEN duration ELSE 0 END), 3) AS total, bool_and(ok) AS whole FROM ok GROUP BY book),
  sj AS (SELECT book, ch, i, CASE WHEN i > 0 THEN ',' ELSE '' END || '{{"i":' || i || ',"t":' || to_json(t) || ',"s":' || to_json(s) || ',"e":' || to_json(e) ||
    ',"cs":' || cs || ',"ce":' || ce || CASE WHEN p THEN ',"p":1' ELSE '' END || '}}' AS x FROM tl)
  SELECT book, -1::BIGINT AS ch, 0 AS kind, 0::BIGINT AS part, '{{"id":' || to_json(book) || ',"title":' || to_json('Talk: ' || book) || ',"author":' ||
    to_json(CASE WHEN book::INTEGER % 2 = 0 THEN 'A. "N" Other' ELSE '' END) || ',"created":"2024-01-01T00:00:00","chapters_total":' || n || ',"chapters_ready":' || r ||
    ',"total_duration":' || to_json(total) || ',"status":"' || CASE WHEN whole THEN 'ready' ELSE 'partial' END || '","timing_version":2,"chapters":[' AS text FROM bt
  UNION ALL SELECT book, 4611686018427387904, 9, 0, ']}}' FROM bt
  UNION ALL SELECT book, ch, 0, 0, CASE WHEN ch > first THEN ',' ELSE '' END || '{{"id":"ch' || lpad(ch::VARCHAR, 4, '0') || '","index":' || ch || ',"title":' || to_json(title) || ',"level":1,"page":0' ||
    CASE WHEN status IS NULL THEN '' ELSE ',"status":"' || status || '"' END || ',"duration":' || to_json(duration) || ',"start_global":' || to_json(sg::DOUBLE) || ',"topics":[' FROM ok
  UNION ALL SELECT book, ch, 2, 0, '],"sentences":[' FROM chp UNION ALL SELECT book, ch, 4, 0, ']}}' FROM chp
  UNION ALL SELECT book, ch, 1, (i // 4) // 1024, string_agg(CASE WHEN i > 0 THEN ',' ELSE '' END || '{{"title":' || to_json(substr(t, 1, 9)) || ',"level":2,"time":null}}', '' ORDER BY i)
    FROM tl WHERE i % 4 = 0 GROUP BY 1, 2, 4
  UNION ALL SELECT book, ch, 3, i // 1024, string_agg(x, '' ORDER BY i) FROM sj GROUP BY 1, 2, 4"""


@query(MANIFEST_PARTS)
def manifest_parts(spark, sf):
    """Manifest documents in parts."""
    tl, books, ch, topics = _manifest_inputs(spark, sf)
    return export.build_manifest(books, ch, tl, topics)


def _manifest_inputs(spark, sf):
    tl = turn_timeline(spark, sf)
    books = turn_books(spark, sf).withColumn("created", F.lit("2024-01-01T00:00:00"))
    ch = turn_chapters(spark, sf).withColumns({"level": F.lit(1), "page": F.lit(0), "audio": F.lit(None).cast("string")})
    topics = tl.filter("i % 4 = 0").withColumn("pos", F.floor(F.col("i") / 4)).select(
        "book", "ch", "pos", F.substring("t", 1, 9).alias("title"), F.lit(2).alias("level"), F.lit(None).cast("double").alias("time"))
    return tl, books, ch, topics


def _sql_label(k: int) -> str:
    """Whether paragraph ``k`` is a label: it matches the pattern or repeats the title."""
    key = I.sql_key(f"h{k}")
    return (f"(h{k} <> '' AND (regexp_matches(h{k}, '^[A-Za-z]+[.]$') OR (key <> '' AND ({key} = key "
            f"OR (length(key) >= 4 AND contains(key, {key}))))))")


_PARA = f"'^{I.WS}*([^\\n]+?){I.WS}*(?:\\n\\n|\\n|$)'"
# Words of capitals: two of them with no letter between; two such words or more, then a lone small letter.
_CAPS = r"'^((?:(?:[^A-Za-z \n]+ )*[^ \n\p{Ll}]*[A-Z][^ \na-zA-Z\p{Ll}]*[A-Z][^ \n\p{Ll}]* ){2,})[a-z]\s'"


def _sql_after_blank(cut: str) -> str:
    return f"{cut} + length(regexp_extract(substr(t, ({cut} + 1)::BIGINT), '^{I.WS}*'))"


# A rule says every "the" twice.
_SAID = r"(t || repeat(' the', len(list_filter(regexp_split_to_array(lower(t), '[^\pL\pN\pM\p{Pc}]+'), lambda w: w = 'the'))))"
CHAPTER_PIPELINE = f"""WITH {BOUNDS},
  cs AS (SELECT * EXCLUDE (ch), row_number() OVER (PARTITION BY book ORDER BY start, seq) - 1 AS ch FROM ch
    WHERE NOT (coalesce(TRY_CAST(substr(book, 4) AS INTEGER) % 2 = 0, FALSE) AND page BETWEEN 3 AND 5)),
  sl AS (SELECT c.book, c.ch, o.page, greatest(o.page_off, c.start) - c.start AS base,
    substr(o.text, greatest(c.start - o.page_off, 0) + 1, greatest(least(c."end" - o.page_off, length(o.text)) - greatest(c.start - o.page_off, 0), 0)) AS text
    FROM cs c JOIN off o ON o.book = c.book AND o.page_off < c."end" AND o.page_off + length(o.text) > c.start),
  h0 AS (SELECT book, ch, text AS t, {I.sql_key('title')} AS key, {I.sql_norm(I.sql_strip('title'))} AS plain
    FROM sl JOIN cs USING (book, ch) WHERE base = 0 AND text <> ''),
  h1 AS (SELECT *, length(regexp_extract(t, {_PARA})) AS n1, regexp_extract(t, {_PARA}, 1) AS g1, substr(t, n1 + 1) AS r1 FROM h0),
  h2 AS (SELECT *, length(regexp_extract(r1, {_PARA})) AS n2, regexp_extract(r1, {_PARA}, 1) AS g2, substr(r1, n2 + 1) AS r2 FROM h1),
  h3 AS (SELECT *, length(regexp_extract(r2, {_PARA})) AS n3, regexp_extract(r2, {_PARA}, 1) AS g3 FROM h2),
  h4 AS (SELECT *, {", ".join(f"CASE WHEN length(g{k}) <= 90 THEN {I.sql_strip(f'g{k}')} ELSE '' END AS h{k}" for k in (1, 2, 3))} FROM h3),
  h5 AS (SELECT *, CASE WHEN NOT {_sql_label(1)} THEN 0 WHEN NOT {_sql_label(2)} THEN n1 WHEN NOT {_sql_label(3)} THEN n1 + n2 ELSE n1 + n2 + n3 END AS c1 FROM h4),
  h6 AS (SELECT *, {_sql_after_blank('c1')} AS a1, length(plain) AS pl FROM h5),
  h7 AS (SELECT *, CASE WHEN pl >= 4 AND lower(substr(t, (a1 + 1)::BIGINT, pl)) = lower(plain) AND regexp_matches(substr(t, (a1 + pl + 1)::BIGINT, 1), '[ \n\t.,:;-]')
    THEN a1 + pl + length(regexp_extract(substr(t, (a1 + pl + 1)::BIGINT), '^[ \n\t.,:;-]*')) ELSE c1 END AS c2 FROM h6),
  h8 AS (SELECT *, {_sql_after_blank('c2')} AS a2 FROM h7),
  h9 AS (SELECT *, length(regexp_extract(substr(t, (a2 + 1)::BIGINT), {_CAPS}, 1)) AS nc FROM h8),
  cut AS (SELECT book, ch, CASE WHEN key <> '' AND nc > 0 THEN a2 + nc + length(regexp_extract(substr(t, (a2 + nc + 1)::BIGINT), '^[ \n\t]*')) ELSE c2 END AS cut FROM h9),
  s2 AS (SELECT book, ch AS old_ch, page, greatest(0, base - coalesce(cut, 0)) AS base,
    CASE WHEN base = 0 THEN substr(text, (coalesce(cut, 0) + 1)::BIGINT) ELSE text END AS text FROM sl LEFT JOIN cut USING (book, ch) WHERE text <> ''),
  wd AS (SELECT book, old_ch FROM s2 GROUP BY 1, 2 HAVING sum({I.sql_words('text')}) > 0),
  fin AS (SELECT book, old_ch, title, (start + coalesce(cut, 0))::BIGINT AS start, row_number() OVER (PARTITION BY book ORDER BY start + coalesce(cut, 0), seq) - 1 AS ch
    FROM (SELECT book, ch AS old_ch, seq, title, start, cut FROM cs LEFT JOIN cut USING (book, ch)) JOIN wd USING (book, old_ch)),
  src AS (SELECT book, fin.ch, page, base, text FROM s2 JOIN fin USING (book, old_ch) WHERE text <> ''),
  {I.sql_sentences('src')},
  {I.sql_timeline(said=_SAID)}
  SELECT book, ch, title, start, page, k::INTEGER AS k, t, cs, ce, s, e FROM tl JOIN (SELECT book, ch, title, start FROM fin) USING (book, ch)"""


@query(CHAPTER_PIPELINE)
def chapter_pipeline(spark, sf):
    """Headings of the corpus to chapters and their sentence times; books of even sources skip the chapters of one page range."""
    pages = corpus(spark, sf)
    marks = stage(SQ.markers(spark, sf, pages), "markers")
    profiles = pages.select("book").distinct().where(F.substring("book", 4, 9).cast("int") % 2 == 0).select("book", F.struct(
        F.array(F.lit("no such title")).alias("titles"), F.array(F.array(F.lit(3), F.lit(5))).alias("page_ranges")).alias("skip_sections"))
    rules = T.compile_rules([{"from": "the", "to": "the the"}])
    chapters, tl = CH.chapter_pipeline(pages, marks, profiles, ["^[A-Za-z]+[.]$"], rules)
    return tl.join(chapters.select("book", "ch", "title", "start"), ["book", "ch"]).select(
        "book", "ch", "title", "start", "page", "k", "t", "cs", "ce", "s", "e")
