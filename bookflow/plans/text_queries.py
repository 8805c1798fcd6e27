"""Registered queries: text functions, page cleaning, segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.functions import text as T
from bookflow.functions import times as X
from bookflow.operators import clean, segment
from bookflow.plans import inputs as I
from bookflow.sources.html import html_to_text

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


# ---- cleaning --------------------------------------------------------------------------------

@query(f"SELECT doc_id, {I.sql_norm('text')} AS text FROM documents")
def normalize_unicode(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.normalize_unicode("text").alias("text"))


@query("""SELECT doc_id, regexp_replace(replace(text, ' th', '-' || chr(10) || 'th'),
  '([\\pL\\pN_])[\\x{ad}-]\\n([\\pL\\pN_])', '\\1\\2', 'g') AS text FROM documents""")
def dehyphenate(spark, sf):
    broken = F.replace(F.col("text"), F.lit(" th"), F.lit("-\nth"))
    return I.table(spark, sf, "documents").select("doc_id", T.dehyphenate(broken).alias("text"))


@query(f"SELECT doc_id, {I.sql_squash('text')} AS text, {I.sql_words('text')}::INTEGER AS n_words FROM documents")
def squash_and_count(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.squash("text").alias("text"),
                                                  T.word_count("text").alias("n_words"))


@query(f"""WITH {I.CLEAN} SELECT book, page, text FROM cl""")
def clean_lines(spark, sf):
    return clean.clean_pages(I.raw_pages(spark, sf))


RUN = f"""{I.PAGES}, ls AS (SELECT book, page, list_filter({I.sql_lines('raw')}, lambda s: s <> '') AS l FROM pg),
  ed AS (SELECT book, unnest([l[1], l[-1]]) AS line FROM ls WHERE len(l) > 0),
  cnt AS (SELECT book, line, count(*) AS n FROM ed WHERE length(line) <= 80
    AND NOT regexp_matches(line, '{I.PAGE_NO}') GROUP BY book, line),
  np AS (SELECT book, count(*) AS n_pages FROM pg GROUP BY book),
  run AS (SELECT book, line, n FROM cnt JOIN np USING (book) WHERE n >= 3 AND n / n_pages >= 0.05)"""


@query(f"WITH {RUN} SELECT book, line, n FROM run")
def running_lines(spark, sf):
    """Threshold 0.05: the supplied texts have hardly any repeated edge line."""
    d = I.table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("text").alias("raw"))
    return clean.running_lines(d, threshold=0.05)


@query(f"""WITH {RUN}, ra AS (SELECT book, list(line) AS rl FROM run GROUP BY book)
  SELECT book, page, {I.sql_clean('raw', "(rl IS NULL OR NOT list_contains(rl, s))")} AS text
  FROM pg LEFT JOIN ra USING (book)""")
def clean_without_running_lines(spark, sf):
    d = I.table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("text").alias("raw"))
    return clean.clean_pages(I.raw_pages(spark, sf), clean.running_lines(d, threshold=0.05))


@query(f"""WITH {I.PAGES}, x AS (SELECT book, page, {I.sql_lines(I.sql_norm('raw'))} AS l FROM pg),
  y AS (SELECT book, page, list_transform(l, lambda s: CASE WHEN s = '' THEN '' ELSE
    nullif({I.sql_strip("regexp_replace(replace(s, 'the ', ' '), '[ \\t]+', ' ', 'g')")}, '') END) AS l FROM x),
  z AS (SELECT book, page, list_filter(l, lambda s: s IS NOT NULL AND (s = '' OR NOT (
    regexp_matches(s, '{I.PAGE_NO}') OR regexp_matches(s, '^[.•·*_=~\\-–—\\s]{{2,}}$') OR regexp_matches(s, '^(En|Der) '))))
    AS l FROM y)
  SELECT book, page, {I.sql_join('l')} AS text FROM z""")
def profile_cleaning(spark, sf):
    pages = I.raw_pages(spark, sf)
    books = pages.select("book").distinct()
    prof = books.select(
        "book",
        F.struct(F.array(F.lit("^En "), F.lit("([")).alias("drop_line_patterns"),
                 F.array(F.lit("the ")).alias("drop_substrings"), F.lit(True).alias("drop_decorative"),
                 F.lit(True).alias("strip_page_numbers"), F.lit(False).alias("fix_letter_spacing"),
                 F.lit(None).cast("int").alias("header_zone_max_y"),
                 F.lit(None).cast("int").alias("footer_zone_min_y")).alias("cleaning"),
        F.struct(F.array(F.lit("^Der ")).alias("patterns")).alias("heading_labels"))
    return clean.clean_pages_profile(pages, prof)


@query(f"""WITH {I.PAGES}, ls AS (SELECT book, page, {I.sql_lines('raw')} AS l FROM pg),
  u AS (SELECT book, page, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line, len(l) AS n FROM ls),
  g AS (SELECT book, page, line, least(1000, greatest(0, line * 1000 // n)) AS y, text FROM u WHERE text <> ''),
  kk AS (SELECT DISTINCT book, page, {I.sql_key('text')} AS k FROM g WHERE y <= 20 OR y >= 960)
  SELECT book, page, k AS key FROM kk WHERE k <> ''""")
def zone_keys(spark, sf):
    pages = I.raw_pages(spark, sf)
    prof = pages.select("book").distinct().select("book", F.struct(
        F.lit(20).alias("header_zone_max_y"), F.lit(960).alias("footer_zone_min_y")).alias("cleaning"))
    return clean.zone_keys(clean.line_geometry(pages), prof).select("book", "page", F.explode(F.array_distinct("zone")).alias("key"))


@query(f"""WITH {I.PAGES}, ls AS (SELECT book, page, {I.sql_lines('raw')} AS l FROM pg),
  u AS (SELECT book, page, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line, len(l) AS n FROM ls)
  SELECT book, page, line::INTEGER AS line, least(1000, greatest(0, line * 1000 // n))::INTEGER AS y, text FROM u WHERE text <> ''""")
def line_geometry(spark, sf):
    return clean.line_geometry(I.raw_pages(spark, sf))


@query("""SELECT l_orderkey::VARCHAR AS book, l_linenumber::BIGINT AS page, string_agg(l_linestatus, '' ORDER BY l_partkey, l_linestatus) AS text,
    round(max(l_quantity), 1) AS size, bool_or(l_returnflag = 'R') AS bold, least(1000, greatest(0, trunc(min(l_tax) * 1000)))::INTEGER AS y
  FROM lineitem GROUP BY 1, 2""")
def merge_spans(spark, sf):
    """Order lines as text spans: the merged line per (order, line number)."""
    li = I.table(spark, sf, "lineitem")
    spans = li.select(F.col("l_orderkey").cast("string").alias("book"),
                      F.col("l_linenumber").cast("long").alias("page"), F.lit(0).alias("line"),
                      F.col("l_partkey").alias("span"), F.col("l_quantity").alias("size"),
                      F.when(F.col("l_returnflag") == "R", "Serif-Bold").otherwise("Serif").alias("font"), F.col("l_tax").alias("y0"),
                      F.lit(1.0).alias("height"), F.col("l_linestatus").alias("text"))
    return clean.merge_spans(spans).select("book", "page", "text", "size", "bold", "y")


# ---- HTML ------------------------------------------------------------------------------------

def _html_sql() -> str:
    c = "regexp_replace(CASE WHEN b <> '' THEN b ELSE html END, '<!--.*?-->', '', 'gs')"
    for tag in ("script", "style", "head", "title", "nav"):
        c = f"regexp_replace({c}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'gsi')"
    block = "p|div|section|article|blockquote|li|ul|ol|table|tr|td|th|h1|h2|h3|h4|h5|h6|br|hr|figure|figcaption|pre|header|footer"
    c = f"replace({c}, chr(13), '')"
    c = f"regexp_replace({c}, '</(?:{block})\\s*>|<(?:br|hr)\\b[^>]*>', chr(10), 'gi')"
    c = f"regexp_replace({c}, '<[/!?A-Za-z][^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"),
                 ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    seg = I.sql_strip("regexp_replace(s, '[ \\t]+', ' ', 'g')")
    return f"""WITH x AS (SELECT page_id, html, regexp_extract(html, '<body\\b[^>]*>(.*)', 1, 'si') AS b FROM pages),
      y AS (SELECT page_id, {I.sql_norm(c)} AS c FROM x)
      SELECT page_id, array_to_string(list_filter(list_transform(string_split(c, chr(10)), lambda s: {seg}),
        lambda s: s <> ''), chr(10) || chr(10)) AS text FROM y"""


@query(_html_sql())
def html_to_text_pages(spark, sf):
    pages = I.dealt(I.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", html_to_text("html").alias("text"))


# ---- segmentation ----------------------------------------------------------------------------

@query(f"WITH {I.TURN_SENT} SELECT book, ch, pk::INTEGER - 1 AS par, pcs::INTEGER AS cs, (pcs + length(t))::INTEGER AS ce, t FROM par")
def paragraph_spans(spark, sf):
    d = I.turn_slices(spark, sf).select("book", "ch", F.posexplode(segment.paragraph_spans("text")).alias("par", "s"))
    return d.select("book", "ch", "par", "s.cs", "s.ce", "s.t")


@query(f"WITH {I.CORPUS_SENT} SELECT book, ch, page, k::INTEGER AS k, t, cs, ce, p FROM sen")
def sentence_spans(spark, sf):
    return segment.sentences(I.whole_book_slices(spark, sf)).drop("first")


@query(f"WITH {I.TURN_SENT} SELECT book, ch, k::INTEGER AS k, t, cs, ce, p FROM sen")
def paragraph_flags(spark, sf):
    return I.turn_sentences(spark, sf).select("book", "ch", "k", "t", "cs", "ce", "p")


@query(f"""WITH RECURSIVE {I.TURN_SENT}, n AS (SELECT book, ch, k, length(t) AS n, p,
    row_number() OVER (PARTITION BY book, ch ORDER BY k) AS r FROM sen),
  f AS (SELECT book, ch, k, r, n, p, 0::BIGINT AS chunk, CASE WHEN p THEN 0 ELSE n END AS used, p AS shut FROM n WHERE r = 1
    UNION ALL SELECT n.book, n.ch, n.k, n.r, n.n, n.p,
      f.chunk + CASE WHEN f.shut OR (f.used > 0 AND f.used + n.n > 120) THEN 1 ELSE 0 END,
      CASE WHEN n.p THEN 0 WHEN f.used > 0 AND f.used + n.n > 120 THEN n.n ELSE f.used + n.n END, n.p
    FROM f JOIN n ON n.book = f.book AND n.ch = f.ch AND n.r = f.r + 1)
  SELECT book, ch, k::INTEGER AS k, n::INTEGER AS n, chunk FROM f""")
def chunk_sentences(spark, sf):
    """Budget 120 characters, so that chunks also close inside paragraphs."""
    return segment.chunk_sentences(I.turn_sentences(spark, sf), budget=120).drop("page")


# ---- scalar functions ------------------------------------------------------------------------

@query(f"""SELECT doc_id, {I.sql_key('text')} AS k FROM documents""")
def match_keys(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.match_key("text").alias("k"))


@query(f"""SELECT p_partkey, CASE WHEN regexp_replace(substr(trim(regexp_replace(lower(p_name || ' ' || p_type || ' & ' || p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 24), '-+$', '') = ''
  THEN 'book' ELSE regexp_replace(substr(trim(regexp_replace(lower(p_name || ' ' || p_type || ' & ' || p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 24), '-+$', '') END AS slug FROM part""")
def slugs(spark, sf):
    p = I.table(spark, sf, "part")
    name = F.concat_ws(" ", "p_name", "p_type", F.lit("&"), "p_brand", "p_name")
    return p.select("p_partkey", T.slugify(name, 24).alias("slug"))


@query(f"""WITH x AS (SELECT doc_id, unnest({I.sql_lines('text')}) AS s FROM documents)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(s, '{I.PAGE_NO}')) AS n_numbers,
    count(*) FILTER (regexp_matches(s, '^[.•·*_=~\\-–—\\s]{{2,}}$')) AS n_decor FROM x GROUP BY doc_id""")
def line_tests(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", F.explode(clean.split_lines("text")).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_page_number("s")).alias("n_numbers"),
                                   F.count_if(T.is_decorative("s")).alias("n_decor"))


@query("""SELECT p_partkey, 'see ' || upper(replace(p_name, ' ', '')) || ' again a b' AS s FROM part""")
def letter_spacing(spark, sf):
    """Names set with a blank after every letter come back as words."""
    word = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    spaced = F.concat(F.lit("see "), F.trim(F.regexp_replace(word, "(.)", "$1 ")), F.lit(" again a b"))
    return I.table(spark, sf, "part").select("p_partkey", T.fix_letter_spacing(spaced).alias("s"))


@query("""WITH x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r, lower(tag) AS lk, tag, pos FROM
    (SELECT doc_id, trim(regexp_replace(trim(t), '^#+', '')) AS tag, pos FROM
      (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM
        (SELECT doc_id, string_split_regex(replace(text, ' ', ',#'), '[,\\n]+') AS l FROM documents))) WHERE tag <> ''),
  y AS (SELECT doc_id, substr(tag, 1, 40) AS tag, pos, lower(substr(tag, 1, 40)) AS lk FROM x),
  z AS (SELECT doc_id, lk, arg_min(tag, pos) AS tag, min(pos) AS pos FROM y GROUP BY doc_id, lk),
  w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM z)
  SELECT doc_id, string_agg(tag, '|' ORDER BY pos) AS tags,
    string_agg('#' || coalesce(nullif(regexp_replace(regexp_replace(tag, '\\s+', '-', 'g'), '[^0-9A-Za-z_/\\-]', '', 'g'), ''), 'tag'), ' ' ORDER BY pos) AS inline_tags
  FROM w WHERE r <= 20 GROUP BY doc_id""")
def tags(spark, sf):
    """Tags from the words of a document: a string split at commas, '#' stripped."""
    raw = F.replace(F.col("text"), F.lit(" "), F.lit(",#"))
    # A filter would be pushed down and clean every word a second time.
    some = F.explode(F.filter(F.array(T.norm_tags(T.split_tags(raw))), lambda t: F.size(t) > 0))
    d = I.dealt(I.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", some.alias("t"))
    return d.select("doc_id", F.array_join("t", "|").alias("tags"),
                    T.inline_tags(F.col("t")).alias("inline_tags"))


@query("""SELECT c_custkey, CASE WHEN s = '' OR regexp_matches(s, '^[ \\-?]') OR regexp_matches(s, '[:#\\[\\]{},&*!|>%@`"'']')
  THEN '"' || replace(replace(s, '\\', '\\\\'), '"', '\\"') || '"' ELSE s END AS y,
  '> ' || replace(s, ' ', chr(10) || '> ') AS bq,
  CASE WHEN length(s) > 12 THEN substr(s, 1, 11) || '…' ELSE s END AS cut
  FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment || ' "' || c_custkey || '"'
    ELSE '- \\' || c_mktsegment END AS s FROM customer)""")
def quoting(spark, sf):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    s = (F.when(k % 4 == 0, "").when(k % 4 == 1, F.col("c_name"))
          .when(k % 4 == 2, F.concat(seg, F.lit(' "'), k.cast("string"), F.lit('"')))
          .otherwise(F.concat(F.lit("- \\"), seg)))
    return I.table(spark, sf, "customer").select(
        "c_custkey", T.yaml_scalar(s).alias("y"), T.blockquote(F.replace(s, F.lit(" "), F.lit("\n"))).alias("bq"),
        T.truncate(s, 12).alias("cut"))


@query("""SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml,
  replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
  CASE WHEN contains(a, '"') AND contains(a, '''') THEN '"' || replace(a, '"', '&quot;') || '"' WHEN contains(a, '"') THEN '''' || a || '''' ELSE '"' || a || '"' END AS attr
  FROM (SELECT *, replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '&#10;'), chr(13), '&#13;'), chr(9), '&#9;') AS a FROM pages)""")
def escaping(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id", T.escape_markup("html", "xml").alias("xml"),
        T.escape_markup("html", "html").alias("html"), T.escape_markup("html", "attr").alias("attr"))


@query("""SELECT page_id, regexp_replace(CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'http://' || u END, '/$', '') AS url
  FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://', '') || '/' END AS u FROM pages)""")
def urls(spark, sf):
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(
        F.concat(F.lit(" "), F.regexp_replace("url", "^https?://", ""), F.lit("/ ")))
    return I.table(spark, sf, "pages").select("page_id", T.normalize_url(u).alias("url"))


@query("""SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(^|[^\\pL\\pN_])the([^\\pL\\pN_]|$)', '\\1THEE\\2', 'gi'), '(^|[^\\pL\\pN_])the([^\\pL\\pN_]|$)', '\\1THEE\\2', 'gi'), '([\\pL\\pN_])ou([^\\pL\\pN_]|$)', '\\1-ou-\\2', 'g'), 'and of', '$1 \\ und')
  AS text FROM documents""")
def pronunciation(spark, sf):
    rules = T.compile_rules([
        {"from": "the", "to": "THEE"},
        {"from": r"(\w)ou\b", "to": r"\1-ou-", "regex": True, "ignore_case": False},
        {"from": "and of", "to": "$1 \\ und", "ignore_case": False, "whole_word": False},
        {"from": "(", "to": "x", "regex": True}])
    d = I.table(spark, sf, "documents")
    return d.select("doc_id", T.apply_rules("text", rules).alias("text"))


@query(f"""WITH {I.TURN_SENT} SELECT book, ch, k::INTEGER AS k,
  array_to_string(list_filter(string_split_regex(regexp_replace(lower(t), '[^a-z'' ]+', ' ', 'g'), ' +'), lambda w: w <> ''), '|') AS words FROM sen""")
def aligner_words(spark, sf):
    return I.turn_sentences(spark, sf).select("book", "ch", "k", F.array_join(T.norm_words("t"), "|").alias("words"))


@query("""SELECT o_orderkey, format('ch{:04d}', o_orderkey % 12000) AS chapter_id,
  format('{}-ch{:02d}', lower(o_orderstatus), o_orderkey % 120) AS stem,
  format('^ch{}-s{}', o_orderkey % 50 + 1, o_custkey % 90) AS block,
  CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'Generating · ' || (o_orderkey % 9) || '/9 chapters'
    ELSE 'Incomplete · ' || (o_orderkey % 9) || '/9 · tap to resume' END AS label,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'Paused' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 1 THEN 'Cancelling'
    WHEN o_orderstatus = 'F' THEN 'Generating' WHEN o_orderstatus = 'O' THEN 'Generation stopped' ELSE 'Generation incomplete' END AS banner
  FROM orders""")
def labels(spark, sf):
    o = I.table(spark, sf, "orders")
    st = F.when(F.col("o_orderstatus") == "F", None).when(F.col("o_orderstatus") == "O", "generating").otherwise("partial")
    active, k = F.col("o_orderstatus") == "F", F.col("o_orderkey")
    return o.withColumn("st", st).select(
        "o_orderkey", T.chapter_id(k % 12000).alias("chapter_id"),
        T.subtitle_stem(F.lower("o_orderstatus"), k % 120).alias("stem"),
        T.block_id(k % 50, F.col("o_custkey") % 90).alias("block"),
        T.status_label("st", k % 9, F.lit(9)).alias("label"),
        T.banner_label("st", active, active & (k % 3 == 0), active & (k % 3 == 1)).alias("banner"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN trim(p_name) ELSE trim(replace(p_type || '_v' || p_size, '_', ' ')) END AS title FROM part""")
def book_titles(spark, sf):
    meta = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name")).otherwise("  ")
    path = F.concat(F.lit("/in.box/a/"), "p_type", F.lit("_v"), F.col("p_size").cast("string"), F.lit(".pdf"))
    return I.table(spark, sf, "part").select("p_partkey", T.book_title(meta, path).alias("title"))


@query("""SELECT p_partkey, (k = 'small ring' OR contains(k, 'copper') OR k = 'mix' OR contains(k, 'anodized')) AS hit FROM
  (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]+', ' ', 'g')) AS k FROM part)""")
def title_match(spark, sf):
    """Every second name and some wanted titles are in full-width letters."""
    want = F.array(F.lit("Small  Ring!"), F.lit("ＣＯＰＰＥＲ"), F.lit("mix"), F.lit("..."), F.lit("Ａｎｏｄｉｚｅｄ"))
    wide = F.translate("p_name", WIDE[0], WIDE[1])
    name = F.when(F.col("p_partkey") % 2 == 0, wide).otherwise(F.col("p_name"))
    return I.table(spark, sf, "part").select("p_partkey", T.title_matches(name, want).alias("hit"))


WIDE = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + k) for k in range(26))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 5 <> 4""")
def tolerant_json(spark, sf):
    """Objects behind prose or in a code fence; broken replies yield nothing."""
    e, m = I.table(spark, sf, "events"), F.col("event_id") % 5
    reply = (F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("Here: "), "props"))
              .when(m == 2, F.concat(F.lit("```json\n"), "props", F.lit("\n``` done")))
              .when(m == 3, F.concat(F.lit("so "), "props", F.lit(" as asked")))
              .otherwise(F.lit("no {object here")))
    d = e.select("event_id", T.json_object(reply).alias("j")).filter("j IS NOT NULL")
    return d.select("event_id", F.from_json("j", "struct<k:int>")["k"].alias("k"))


@query("""SELECT event_id, substr(sha256(concat_ws(chr(31), event_type, props, format('{:.3f}', value))), 1, 16) AS key,
  sha1('v1:m:' || props) AS source FROM events""")
def content_keys(spark, sf):
    return I.table(spark, sf, "events").select(
        "event_id", T.content_key("event_type", "props", F.format_string("%.3f", "value")).alias("key"),
        T.source_key(F.encode("props", "UTF-8"), "m").alias("source"))


# ---- times -----------------------------------------------------------------------------------

def _ts(x: str, sep: str) -> str:
    ms = f"CAST(round_even({x} * 1000, 0) AS BIGINT)"
    return (f"format('{{:02d}}:{{:02d}}:{{:02d}}{sep}{{:03d}}', {ms} // 3600000, {ms} % 3600000 // 60000, "
            f"{ms} % 60000 // 1000, {ms} % 1000)")


def _clock(t: str) -> str:
    return (f"CASE WHEN {t} >= 3600 THEN format('{{}}:{{:02d}}:{{:02d}}', {t} // 3600, {t} % 3600 // 60, {t} % 60) "
            f"ELSE format('{{}}:{{:02d}}', {t} // 60, {t} % 60) END")


@query(f"""SELECT l_orderkey, l_linenumber, {_ts('l_extendedprice', ',')} AS srt, {_ts('l_extendedprice', '.')} AS vtt,
  {_clock('CAST(floor(l_extendedprice) AS BIGINT)')} AS clock, {_clock('CAST(round_even(l_extendedprice, 0) AS BIGINT)')} AS dur,
  CASE WHEN m < 60 THEN m || 'm' WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS hm
  FROM (SELECT *, CAST(floor(l_extendedprice / 60 + 0.5) AS BIGINT) AS m FROM lineitem)""")
def clock_formats(spark, sf):
    p = F.col("l_extendedprice")
    return I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", X.fmt_ts(p, ",").alias("srt"), X.fmt_ts(p, ".").alias("vtt"),
        X.fmt_clock(p).alias("clock"), X.fmt_dur(p).alias("dur"), X.fmt_hm(p).alias("hm"))


@query("""SELECT o_orderkey, strftime(o_orderdate + to_minutes(o_orderkey % 3000), '%a, %d %b %Y %H:%M:%S') || ' GMT' AS pub FROM orders""")
def pub_dates(spark, sf):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return I.table(spark, sf, "orders").select(
        "o_orderkey", X.pub_date(iso, (F.col("o_orderkey") % 3000).cast("int")).alias("pub"))


@query(f"WITH {I.TURN_SENT} SELECT book, ch, k::INTEGER AS k, {I.sql_samples('t')} / 24000.0::DOUBLE AS sec FROM sen")
def est_duration(spark, sf):
    return I.turn_sentences(spark, sf).select("book", "ch", "k", X.est_duration("t").alias("sec"))


@query("""SELECT event_id, floor(f * 1000000)::BIGINT AS frac, least(100, greatest(0, floor(f * 100 + 0.5)))::INTEGER AS pct,
  CASE WHEN f > 0 THEN CASE WHEN event_type = 'view' AND f >= 0.999 THEN 100 ELSE least(100, greatest(2, floor(f * 100 + 0.5))) END END::INTEGER AS card
  FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (10.0::DOUBLE + value) / 60.0::DOUBLE) END AS f FROM events)""")
def progress_percent(spark, sf):
    total = F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(60.0)
    f = X.progress_frac(F.lit(10.0), "value", total)
    st = F.when(F.col("event_type") == "view", "ready").otherwise("generating")
    return I.table(spark, sf, "events").select(
        "event_id", F.floor(f * 1000000).alias("frac"), X.percent(f).alias("pct"), X.card_percent(f, st).alias("card"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE WHEN event_id % 4 = 1 THEN 0.0::DOUBLE ELSE value END AS f,
  CASE WHEN event_id % 4 = 2 THEN user_id ELSE 7 END::INTEGER AS n FROM events""")
def safe_numbers(spark, sf):
    m = F.col("event_id") % 4
    num = F.when(m == 0, "abc").when(m == 1, "NaN").otherwise(F.col("value").cast("string"))
    whole = F.when(m == 2, F.col("user_id").cast("string")).when(m == 3, F.lit(None)).otherwise("x")
    return I.table(spark, sf, "events").select("event_id", X.as_float(num).alias("f"), X.as_int(whole, 7).alias("n"))
