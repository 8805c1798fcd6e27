"""The supplied tables seen as books, pages, chapters, notes and progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.operators import clean, segment, structure, timeline
from bookflow.settings import configure, drop, stage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A supplied table, as it lies: how finely files are split is set when the job is submitted."""
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over tasks by a hash of their key before a costly step for each row, whatever files they came in."""
    return df.repartition(*keys)


def raw_pages(spark, sf) -> DataFrame:
    """documents as pages: book = source, page = position by doc_id."""
    return clean.number_pages(table(spark, sf, "documents"), "source", "doc_id", "text")


def _clean_pages(spark, sf) -> DataFrame:
    return stage(clean.clean_pages(raw_pages(spark, sf)), "clean_pages")


def clean_corpus(spark, sf) -> DataFrame:
    """Cleaned pages with their offset in the book; written once, then scanned by column."""
    return structure.page_offsets(_clean_pages(spark, sf))


def corpus(spark, sf) -> DataFrame:
    """The same written with the offsets, for several readers; of the texts one copy stays on the disks."""
    pages = _clean_pages(spark, sf)
    out = stage(structure.page_offsets(pages), "corpus")
    drop(pages)
    return out


def whole_book_slices(spark, sf) -> DataFrame:
    """Every book one chapter: a slice per page, based at the page offset."""
    return clean_corpus(spark, sf).select("book", F.lit(0).cast("long").alias("ch"), "page",
                                          F.col("page_off").alias("base"), "text")


def corpus_sentences(spark, sf) -> DataFrame:
    return stage(segment.sentences(whole_book_slices(spark, sf)), "sentences")


def spoken_sentences(spark, sf) -> DataFrame:
    """Places and spoken lengths of the corpus' sentences, without their text."""
    return stage(timeline.spoken(segment.sentences(whole_book_slices(spark, sf))).select("book", "ch", "page", "k", "p", "first", "dur"), "sentences")


def turn_slices(spark, sf) -> DataFrame:
    """conversations as chapters: book = conv_id, chapter = turn, lines as paragraphs."""
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("book"), F.col("turn").alias("ch"),
                    F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("base"),
                    F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def turn_sentences(spark, sf) -> DataFrame:
    return segment.sentences(turn_slices(spark, sf))


def thousandths(percent):
    """A percentage as a fraction in whole thousandths; ties don't depend on an engine's rounding."""
    return F.floor(percent * 10 + 0.5) / 1000.0


def progress(spark, sf) -> DataFrame:
    """events as reading progress; ``seq`` is the arrival order."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("book"),
        (F.col("user_id") % 3).cast("string").alias("device"), (F.col("event_id") % 7).cast("int").alias("ci"),
        F.col("value").alias("t"), (F.col("event_id") % 50).cast("int").alias("si"),
        thousandths(F.least(F.lit(100.0), F.col("value"))).alias("frac"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("updated"), F.col("event_id").alias("seq"))


# ---- the same views for the SQL side -----------------------------------------------------------

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_norm(x: str) -> str:
    for a, b in (("‘", "''"), ("’", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"),
                 ("…", "..."), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
                 ("ﬅ", "st"), ("ﬆ", "st"), (" ", " ")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_key(x: str) -> str:
    x = f"regexp_replace(lower({sql_norm(x)}), '^\\s*(?:chapter|section|part)\\s+[\\divxlc]+[:.\\s-]*', '')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[\\pL\\pN_]+'))"


def sql_samples(x: str) -> str:
    tok = f"(CASE WHEN {sql_strip(x)} = '' THEN 0 ELSE len(regexp_extract_all({sql_strip(x)}, '{WS}+')) + 1 END)"
    return f"CAST(floor(greatest(0.35::DOUBLE, {tok} / 2.9::DOUBLE) * 24000) AS BIGINT)"


PAGE_NO = r"^\s*(?:[ivxlcdmIVXLCDM]+|\p{Nd}+)\s*$"
BREAK = r"\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}\x1c-\x1e]"


def sql_lines(x: str) -> str:
    return f"list_transform(regexp_split_to_array({x}, '{BREAK}'), lambda s: {sql_strip('s')})"


def sql_join(lines: str) -> str:
    marked = f"array_to_string(list_transform({lines}, lambda s: CASE WHEN s = '' THEN chr(10) ELSE s END), ' ')"
    return sql_strip(f"regexp_replace(regexp_replace({marked}, ' ?\\n[ \\n]*', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")


def sql_clean(x: str, extra: str = "TRUE") -> str:
    hyph = f"regexp_replace({sql_norm(x)}, '([\\pL\\pN_])[\\x{{ad}}-]\\n([\\pL\\pN_])', '\\1\\2', 'g')"
    return sql_join(f"list_filter({sql_lines(hyph)}, lambda s: s = '' OR (NOT regexp_matches(s, '{PAGE_NO}') AND {extra}))")


PAGES = """pg AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page,
  text AS raw FROM documents)"""
CLEAN = f"""{PAGES}, cl AS (SELECT book, page, {sql_clean('raw')} AS text FROM pg),
  off AS (SELECT book, page, text, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY book ORDER BY page
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_off FROM cl)"""

SENT = r"""[.!?]*[^.!?]+(?:[.!?]+["'')\]]*|\z)"""


def sql_sentences(src: str) -> str:
    """CTEs from ``src(book, ch, page, base, text)`` to ``sen(book, ch, page, k, t, cs, ce, p)``."""
    return rf"""par0 AS (SELECT book, ch, page, base, regexp_extract_all(text, '\n*[^\n]+(?:\n[^\n]+)*') AS l FROM {src}),
  par1 AS (SELECT book, ch, page, base, unnest(l) AS x, generate_subscripts(l, 1) AS pk FROM par0),
  par2 AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY book, ch, page ORDER BY pk
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS po, length(x) - length(ltrim(x, chr(10))) AS n FROM par1),
  par AS (SELECT book, ch, page, base, pk, po + n AS pcs, substr(x, n + 1) AS t FROM par2),
  sn0 AS (SELECT book, ch, page, base, pk, pcs, regexp_extract_all(t, '{SENT}') AS l FROM par),
  sn1 AS (SELECT book, ch, page, base, pk, pcs, unnest(l) AS x, generate_subscripts(l, 1) AS sk FROM sn0),
  sn2 AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY book, ch, page, pk ORDER BY sk
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so, length(regexp_extract(x, '^[.!?]*')) AS gap FROM sn1),
  sn3 AS (SELECT *, substr(x, gap + 1) AS m FROM sn2),
  sn4 AS (SELECT book, ch, page, base, pk, sk, {sql_strip('m')} AS t,
    pcs + so + gap + length(regexp_extract(m, '^{WS}*')) AS c FROM sn3),
  sen AS (SELECT book, ch, page, row_number() OVER (PARTITION BY book, ch, page ORDER BY pk, sk) - 1 AS k, t,
    CAST(base + c AS BIGINT) AS cs, CAST(base + c + length(t) AS BIGINT) AS ce,
    row_number() OVER (PARTITION BY book, ch, page, pk ORDER BY sk DESC) = 1 AS p FROM sn4 WHERE t <> '')"""


CORPUS_SENT = f"""{CLEAN}, sl AS (SELECT book, 0::BIGINT AS ch, page, page_off AS base, text FROM off),
  {sql_sentences('sl')}"""
TURN_SENT = f"""tsl AS (SELECT CAST(conv_id AS VARCHAR) AS book, turn AS ch, 0::BIGINT AS page, 0::BIGINT AS base,
  replace(text, chr(10), chr(10) || chr(10)) AS text FROM conversations),
  {sql_sentences('tsl')}"""


def sql_timeline(src: str = "sen", said: str = "t") -> str:
    """CTEs from sentences to ``tl`` with i, s, e, settled; ``said`` is what is spoken of one."""
    ms = lambda x: f"((({x}) * 1000 + 12000) // 24000)"
    w = "OVER (PARTITION BY book, ch ORDER BY page, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""tl0 AS (SELECT *, {sql_samples(said)} AS dur, CASE WHEN p THEN 7680 ELSE 2160 END AS gap FROM {src}),
  tl1 AS (SELECT *, CAST(coalesce(sum(dur + gap) {w}, 0) AS BIGINT) AS t0,
    row_number() OVER (PARTITION BY book, ch ORDER BY page, k) - 1 AS i FROM tl0),
  tl2 AS (SELECT *, {ms('t0')} AS sm, {ms('t0 + dur')} AS em FROM tl1),
  tl3 AS (SELECT *, lag(em, 1, 0) OVER (PARTITION BY book, ch ORDER BY i) AS pm FROM tl2),
  tl AS (SELECT book, ch, page, k, i, t, cs, ce, p, dur, gap, sm / 1000.0::DOUBLE AS s, em / 1000.0::DOUBLE AS e,
    ((2 * sm - least(greatest(sm - pm, 0), 500) + 1) // 2) / 1000.0::DOUBLE AS settled FROM tl3)"""


PROGRESS = """pr AS (SELECT CAST(user_id AS VARCHAR) AS "user", event_type AS book, CAST(user_id % 3 AS VARCHAR) AS device,
  CAST(event_id % 7 AS INTEGER) AS ci, value AS t, CAST(event_id % 50 AS INTEGER) AS si,
  floor(least(100.0::DOUBLE, value) * 10 + 0.5) / 1000.0::DOUBLE AS frac, epoch_us(ts) // 1000 AS updated, event_id AS seq FROM events)"""
