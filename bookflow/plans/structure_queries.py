"""Registered queries: offsets, headings, markers, chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.functions import text as T
from bookflow.operators import clean, segment, structure
from bookflow.plans import inputs as I
from bookflow.settings import stage
from bookflow.sources.files import flatten_toc, resolve_href

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


def _lines(spark, sf):
    """Lines of documents with a made-up but deterministic font size and weight."""
    g = clean.line_geometry(I.raw_pages(spark, sf))
    g = g.withColumn("text", F.regexp_replace("text", r"\.$", ""))
    return g.withColumns({"size": (10 + F.length("text") % 7).cast("double"), "bold": F.length("text") % 5 == 0})


LINES = f"""{I.PAGES}, lr AS (SELECT book, page, {I.sql_lines('raw')} AS l FROM pg),
  lu AS (SELECT book, page, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line, len(l) AS n FROM lr),
  ln AS (SELECT book, page, line, text, (10 + length(text) % 7)::DOUBLE AS size, length(text) % 5 = 0 AS bold
    FROM (SELECT * REPLACE (regexp_replace(text, '\\.$', '') AS text) FROM lu WHERE text <> ''))"""

# Markers: one-word lines open chapters (level 1), two-word lines are topics; located in the
# cleaned pages, where a line keeps its place but lines are joined by blanks.
HEAD1, HEAD2 = r"^[A-Za-z]+\.$", r"^[A-Za-z]+ [a-z]+\.$"


def corpus(spark, sf):
    return I.corpus(spark, sf)


def headings(spark, sf, lines_as=None):
    raw = I.raw_pages(spark, sf).withColumnRenamed("raw", "text")
    d = structure.scan_headings(raw, rf"{HEAD1}|{HEAD2}")
    return d.withColumns({
        "level": F.when(F.col("title").rlike(HEAD1), 1).otherwise(2),
        "seq": F.col("page") * 100000 + F.col("seq")})


HEADINGS = rf"""hp AS (SELECT book, page, string_split(raw, chr(10)) AS l FROM pg),
  hu AS (SELECT book, page, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS q FROM hp),
  hs AS (SELECT book, page, q, {I.sql_strip('x')} AS title FROM hu),
  hd AS (SELECT book, page, page * 100000 + q AS seq, CASE WHEN regexp_matches(title, '{HEAD1}') THEN 1 ELSE 2 END AS level, title
    FROM hs WHERE length(title) BETWEEN 2 AND 90 AND regexp_matches(title, '{HEAD1}|{HEAD2}'))"""


def _loc(page: str = "greatest(0, least(page, mx))") -> str:
    want, norm = f"substr({I.sql_key('title')}, 1, 40)", I.sql_key("text")
    return f"""lj AS (SELECT h.*, o.page_off, o.text, {want} AS w, {norm} AS nk FROM
      (SELECT hd.*, mx FROM hd JOIN (SELECT book, max(page) AS mx FROM off GROUP BY book) USING (book)) h
      JOIN off o ON o.book = h.book AND o.page = {page.replace('page', 'h.page', 1)}),
    mk AS (SELECT book, seq, level, title, page, CAST(page_off + CASE WHEN w <> '' AND strpos(nk, w) > 0
      THEN CAST(floor((strpos(nk, w) - 1)::DOUBLE / greatest(1, length(nk)) * length(text)) AS BIGINT) ELSE 0 END AS BIGINT) AS off FROM lj)"""


MARKERS = f"{I.CLEAN}, {HEADINGS}, {_loc()}"


def markers(spark, sf, pages):
    return structure.locate_headings(headings(spark, sf), pages).select(
        "book", "seq", "level", "title", "page", "off")


BOUNDS = f"""{MARKERS}, len AS (SELECT book, CAST(sum(length(text) + 2) - 2 AS BIGINT) AS book_len FROM cl GROUP BY book),
  m1 AS (SELECT book, seq, title, page, off AS start, lead(off) OVER (PARTITION BY book ORDER BY off, seq) AS nx
    FROM mk WHERE level = 1),
  b0 AS (SELECT book, seq, title, page, start, coalesce(nx, book_len) AS "end" FROM m1 JOIN len USING (book)
    UNION ALL SELECT book, -1, 'Front Matter', 0, 0, min(start) FROM m1 GROUP BY book HAVING min(start) >= 600),
  ch AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY start, seq) - 1 AS ch FROM b0)"""


def chapters(spark, sf, pages):
    m = stage(markers(spark, sf, pages), "markers")
    return m, structure.number_chapters(structure.chapter_bounds(m, structure.book_lengths(pages)))


# ---- coordinates -----------------------------------------------------------------------------

@query(f"WITH {I.CLEAN} SELECT book, page, page_off FROM off")
def page_offsets(spark, sf):
    return I.clean_corpus(spark, sf).select("book", "page", "page_off")


@query(f"""WITH {I.CLEAN}, p AS (SELECT source AS book, doc_id, doc_id * 37 AS off FROM documents)
  SELECT p.book, p.doc_id, max(o.page)::BIGINT AS page FROM p JOIN off o ON o.book = p.book AND o.page_off <= p.off GROUP BY 1, 2""")
def page_of_offset(spark, sf):
    pages = corpus(spark, sf).select("book", "page", "page_off")
    probes = I.table(spark, sf, "documents").select(
        F.col("source").alias("book"), "doc_id", (F.col("doc_id") * 37).alias("off"))
    return structure.page_of_offset(probes, pages).select("book", "doc_id", "page")


# ---- headings --------------------------------------------------------------------------------

@query(f"WITH {I.PAGES}, {HEADINGS} SELECT book, page, seq, level, title FROM hd")
def heading_scan(spark, sf):
    return headings(spark, sf)


@query(f"WITH {MARKERS} SELECT book, seq, level, title, page, off FROM mk")
def locate_headings(spark, sf):
    return markers(spark, sf, corpus(spark, sf))


@query(f"""WITH {I.CLEAN}, {HEADINGS}, j AS (SELECT hd.*, o.page_off, o.text, strpos(lower(text), lower(title)) AS p,
      substr({I.sql_key('title')}, 1, 40) AS w, {I.sql_key('text')} AS nk FROM hd
    JOIN off o ON o.book = hd.book AND o.page = hd.page)
  SELECT book, seq, CAST(page_off + CASE WHEN p > 0 THEN p - 1 WHEN w <> '' AND strpos(nk, w) > 0
    THEN CAST(floor((strpos(nk, w) - 1)::DOUBLE / greatest(1, length(nk)) * length(text)) AS BIGINT) ELSE 0 END AS BIGINT) AS off FROM j""")
def locate_headings_direct(spark, sf):
    """Titles as written, else by their keys, else the page's start."""
    return structure.locate_headings(headings(spark, sf), corpus(spark, sf), "direct").select("book", "seq", "off")


@query(f"""WITH {I.CLEAN}, t AS (SELECT source AS book, doc_id, substr({I.sql_key('text')}, 1, 40) AS w FROM documents
    ),
  k AS (SELECT book, page, {I.sql_key('text')} AS nk FROM cl)
  SELECT t.book, t.doc_id, coalesce(min(k.page), 0)::BIGINT AS page FROM t LEFT JOIN k
    ON k.book = t.book AND t.w <> '' AND contains(k.nk, t.w) GROUP BY 1, 2""")
def first_page_with(spark, sf):
    """Where in its book does each document's opening occur first?"""
    titles = I.table(spark, sf, "documents").select(
        F.col("source").alias("book"), "doc_id", F.col("text").alias("title"))
    return structure.first_page_with(titles, corpus(spark, sf)).select("book", "doc_id", "page")


@query(f"""WITH {I.PAGES}, q AS (SELECT substr(text, 5, 9) AS q FROM benchmark UNION SELECT '...'),
  n AS (SELECT DISTINCT q, {I.sql_key('q')} AS nd FROM q WHERE {I.sql_key('q')} <> ''),
  k AS (SELECT book, page, raw, {I.sql_key('raw')} AS nk FROM pg),
  h AS (SELECT q, book, page, raw, row_number() OVER (PARTITION BY q, book ORDER BY page) AS r FROM n JOIN k ON contains(nk, nd))
  SELECT q, book, page, CASE WHEN r <= 5 THEN substr({I.sql_squash('raw')}, 1, 200) END AS snippet FROM h""")
def page_find(spark, sf):
    q = I.table(spark, sf, "benchmark").select(F.substring("text", 5, 9).alias("q")).unionByName(
        spark.createDataFrame([("...",)], "q string")).distinct()
    return structure.page_find(I.raw_pages(spark, sf), q)


@query(f"""WITH {LINES}, r AS (SELECT book, size, row_number() OVER (PARTITION BY book ORDER BY size) AS r,
    count(*) OVER (PARTITION BY book) AS n FROM ln) SELECT book, size AS median FROM r WHERE r = n // 2 + 1""")
def upper_median(spark, sf):
    return structure.upper_median(_lines(spark, sf), "book", "size")


FONT = f"""{LINES}, r AS (SELECT book, size, row_number() OVER (PARTITION BY book ORDER BY size) AS r,
    count(*) OVER (PARTITION BY book) AS n FROM ln), md AS (SELECT book, size AS body FROM r WHERE r = n // 2 + 1),
  fh AS (SELECT book, page, line, text, size, bold FROM ln JOIN md USING (book)
    WHERE (size >= body * 1.25::DOUBLE OR (bold AND size >= body * 1.1::DOUBLE)) AND length(text) BETWEEN 2 AND 90
    AND right(text, 1) NOT IN ('.', ',', ';', ':'))"""


@query(f"WITH {FONT} SELECT book, page, line::INTEGER AS line, text, size, bold FROM fh")
def font_headings(spark, sf):
    return structure.font_headings(_lines(spark, sf)).select("book", "page", "line", "text", "size", "bold")


@query(f"""WITH RECURSIVE {MARKERS}, o AS (SELECT book, seq, off, row_number() OVER (PARTITION BY book ORDER BY off, seq) AS r FROM mk),
  f AS (SELECT book, seq, off, r, off AS kept, TRUE AS keep FROM o WHERE r = 1 UNION ALL
    SELECT o.book, o.seq, o.off, o.r, CASE WHEN o.off - f.kept >= 2000 THEN o.off ELSE f.kept END, o.off - f.kept >= 2000
    FROM f JOIN o ON o.book = f.book AND o.r = f.r + 1)
  SELECT book, seq, off FROM f WHERE keep""")
def thin_markers(spark, sf):
    """Markers at least 2000 characters after the last kept one (the fold is not a lag)."""
    m = stage(markers(spark, sf, corpus(spark, sf)), "markers")
    return structure.thin_markers(m, 2000).select("book", "seq", "off")


@query(f"""WITH {FONT}, np AS (SELECT book, count(*) AS n_pages FROM pg GROUP BY book),
  c AS (SELECT book, count(*) AS n FROM fh GROUP BY book)
  SELECT book, n AS n_markers FROM c JOIN np USING (book) WHERE NOT (n > greatest(4, n_pages // 20 + 5) AND n > 80)""")
def noise_guard(spark, sf):
    """Guard on a tenth of the page count, so that it bites at this size."""
    n = I.table(spark, sf, "documents").groupBy(F.col("source").alias("book")).agg(
        F.floor(F.count("*") / 10).alias("n_pages"))
    kept = structure.noise_guard(structure.font_headings(_lines(spark, sf)), n)
    return kept.groupBy("book").agg(F.count("*").alias("n_markers"))


@query(f"""WITH {I.CLEAN}, f AS (SELECT book, page, page_off, text, {I.sql_strip("string_split(text, chr(10) || chr(10))[1]")} AS x FROM off)
  SELECT book, page, CASE WHEN length(x) BETWEEN 1 AND 80 THEN x ELSE 'Section ' || (page + 1) END AS title, page_off AS off
  FROM f WHERE {I.sql_words('text')} > 0""")
def spine_markers(spark, sf):
    return structure.spine_markers(I.clean_corpus(spark, sf)).select("book", "page", "title", "off")


@query(f"""WITH {MARKERS}, has AS (SELECT DISTINCT book FROM mk WHERE level = 1 AND substr(book, 4)::INTEGER % 2 = 0)
  SELECT book, seq, title, off, 'headings' AS toc_source FROM mk WHERE book IN (FROM has) AND level = 1
  UNION ALL SELECT book, page, 'Section ' || (page + 1), page_off, 'spine' FROM off
    WHERE book NOT IN (FROM has) AND {I.sql_words('text')} > 0""")
def prefer_source(spark, sf):
    """Headings for even books; the others fall back to one chapter per page."""
    pages = corpus(spark, sf)
    even = F.substring("book", 4, 9).cast("int") % 2 == 0
    a = markers(spark, sf, pages).filter((F.col("level") == 1) & even)
    b = structure.spine_markers(pages).withColumn("title", F.concat(
        F.lit("Section "), (F.col("page") + 1).cast("string")))
    return structure.prefer_source([("headings", a), ("spine", b)]).select(
        "book", "seq", "title", "off", "toc_source")


@query(f"""WITH {MARKERS}, k AS (SELECT book, page, page_off, text, {I.sql_key('text')} AS nk FROM off),
  l AS (SELECT source AS book, doc_id AS seq, substr({I.sql_key("split_part(text, chr(10), 1)")}, 1, 40) AS w FROM documents),
  fp AS (SELECT l.book, l.seq, l.w, coalesce(min(k.page) FILTER (contains(k.nk, l.w) AND l.w <> ''), 0) AS page FROM l
    JOIN k ON k.book = l.book GROUP BY 1, 2, 3)
  SELECT fp.book, fp.seq, CAST(k.page_off + CASE WHEN w <> '' AND strpos(nk, w) > 0 THEN CAST(floor((strpos(nk, w) - 1)::DOUBLE
      / greatest(1, length(nk)) * length(text)) AS BIGINT) ELSE 0 END AS BIGINT) AS off
    FROM fp JOIN k ON k.book = fp.book AND k.page = fp.page""")
def profile_markers(spark, sf):
    """Listed markers without a page: each document's first line is looked up as a title."""
    docs = I.table(spark, sf, "documents")
    listed = docs.groupBy(F.col("source").alias("book")).agg(F.array_sort(F.collect_list(
        F.struct("doc_id", F.struct(F.lit(1).alias("level"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                                    F.lit(None).cast("int").alias("page")).alias("m")))).alias("x"))
    prof = listed.select("book", F.struct(F.lit("correct").alias("toc"), F.transform(
        "x", lambda v: v["m"]).alias("markers"), F.lit(None).cast("string").alias("heading_pattern")).alias("structure"))
    ids = listed.select("book", F.posexplode(F.transform("x", lambda v: v["doc_id"])).alias("seq", "doc_id"))
    got = structure.profile_markers(prof, corpus(spark, sf))
    return got.join(ids, ["book", "seq"]).select("book", F.col("doc_id").alias("seq"), "off")


@query(f"""WITH RECURSIVE {I.CLEAN}, {HEADINGS.replace('FROM pg', 'FROM (SELECT book, page, text AS raw FROM cl)').replace(HEAD1 + '|' + HEAD2, '^[A-Z]').replace('WHEN regexp_matches(title, ' + "'" + HEAD1 + "'" + ') THEN', 'WHEN TRUE THEN')}, {_loc()},
  o AS (SELECT book, seq, off, row_number() OVER (PARTITION BY book ORDER BY off, seq) AS r FROM mk),
  f AS (SELECT book, seq, off, r, off AS kept, TRUE AS keep FROM o WHERE r = 1 UNION ALL
    SELECT o.book, o.seq, o.off, o.r, CASE WHEN o.off - f.kept >= 200 THEN o.off ELSE f.kept END, o.off - f.kept >= 200
    FROM f JOIN o ON o.book = f.book AND o.r = f.r + 1)
  SELECT book, off FROM f WHERE keep""")
def derived_markers(spark, sf):
    """Markers from each book's own heading pattern over the cleaned paragraphs."""
    pages = corpus(spark, sf)
    prof = pages.select("book").distinct().select("book", F.struct(
        F.lit("derive").alias("toc"),
        F.lit(None).cast("array<struct<level:int,title:string,page:int>>").alias("markers"),
        F.lit("^[A-Z]").alias("heading_pattern")).alias("structure"))
    return structure.profile_markers(prof, pages).select("book", "off")


# ---- tables of contents ----------------------------------------------------------------------

TOC = """WITH r AS (SELECT r_name AS book, 0 AS seq, 1 AS level, r_name AS title, 'doc/' || lower(r_name) || '.xhtml' AS href FROM region),
  n AS (SELECT r_name AS book, 2 AS level, n_name AS title, n_name || '.xhtml#' || n_nationkey AS href,
    row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS seq FROM nation JOIN region ON n_regionkey = r_regionkey),
  t AS (SELECT book, seq, level, title, href FROM r UNION ALL SELECT book, seq, level, title, href FROM n)"""


def _toc(spark, sf):
    """Navigation trees from the geography: a region with its nations below it."""
    n, r = I.table(spark, sf, "nation"), I.table(spark, sf, "region")
    child = F.struct(F.col("n_nationkey").alias("k"), F.struct(
        F.col("n_name").alias("title"),
        F.concat("n_name", F.lit(".xhtml#"), F.col("n_nationkey").cast("string")).alias("href")).alias("x"))
    j = r.join(n, r.r_regionkey == n.n_regionkey, "left").groupBy("r_name").agg(F.transform(F.array_sort(
        F.collect_list(F.when(F.col("n_nationkey").isNotNull(), child))), lambda v: v["x"]).alias("c"))
    nav = F.to_json(F.array(F.struct(
        F.col("r_name").alias("title"), F.concat(F.lit("doc/"), F.lower("r_name"), F.lit(".xhtml")).alias("href"),
        F.col("c").alias("children"))))
    return flatten_toc(j.select(F.col("r_name").alias("book"), nav.alias("nav")), "book", "nav")


@query(f"{TOC} SELECT book, seq::INTEGER AS seq, level, title, href FROM t")
def flatten_toc_nav(spark, sf):
    return _toc(spark, sf)


@query(f"""{TOC}, s AS (SELECT r_name AS book, c_custkey AS page, CASE c_custkey % 2 WHEN 0 THEN 'x/' || n_name || '.xhtml'
    ELSE 'doc/' || lower(r_name) || '.xhtml' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)
  SELECT t.book, t.seq::INTEGER AS seq, level, title, max(page) AS page FROM t JOIN s ON s.book = t.book AND
    (s.name = split_part(t.href, '#', 1) OR regexp_extract(s.name, '[^/]*$') = regexp_extract(split_part(t.href, '#', 1), '[^/]*$'))
  GROUP BY 1, 2, 3, 4""")
def resolve_toc_links(spark, sf):
    c, n, r = (I.table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    spine = j.select(F.col("r_name").alias("book"), F.col("c_custkey").alias("page"), F.when(
        F.col("c_custkey") % 2 == 0, F.concat(F.lit("x/"), "n_name", F.lit(".xhtml"))).otherwise(
        F.concat(F.lit("doc/"), F.lower("r_name"), F.lit(".xhtml"))).alias("name"))
    return resolve_href(_toc(spark, sf), spine)


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS name, 1 + c_custkey % 50 AS d FROM customer),
    n AS (SELECT k, name, d, unnest(generate_series(1, d)) AS l FROM c)
  SELECT k::VARCHAR AS book, (l - 1)::INTEGER AS seq, l::INTEGER AS level, name || ' ' || l AS title, l || '.xhtml' AS href FROM n WHERE l % 5 <> 0
  UNION ALL SELECT k::VARCHAR, (2 * d - l)::INTEGER, l::INTEGER, 'leaf ' || l, NULL FROM n""")
def flatten_deep_toc(spark, sf):
    """Trees of 1 to 50 levels, a customer each: on every level an entry that holds the next ones, and a leaf behind it; every fifth
    entry has no title."""
    depth = 1 + F.col("c_custkey") % 50
    leaf = lambda l: F.concat(F.lit('{"title": "leaf '), l.cast("string"), F.lit('"}'))
    entry = lambda l, inner: F.concat(
        F.lit('{"href": "'), l.cast("string"), F.lit('.xhtml", "title": "'), F.when(l % 5 == 0, " ").otherwise(F.concat("c_name", F.lit(" "), l.cast("string"))),
        F.lit('", "children": '), inner, F.lit("}"))
    tree = F.aggregate(F.sequence(depth, F.lit(1).cast("bigint")), F.lit("[]"), lambda inner, l: F.concat(F.lit("["), entry(l, inner), F.lit(", "), leaf(l), F.lit("]")))
    return flatten_toc(I.dealt(I.table(spark, sf, "customer"), "c_custkey").select(F.col("c_custkey").cast("string").alias("book"), tree.alias("nav")), "book", "nav")


# ---- chapters --------------------------------------------------------------------------------

@query(f"""WITH {BOUNDS} SELECT book, ch, title, page, start, "end" FROM ch""")
def chapter_bounds(spark, sf):
    _, ch = chapters(spark, sf, corpus(spark, sf))
    return ch.select("book", "ch", "title", "page", "start", "end")


SLICES = f"""{BOUNDS}, sl AS (SELECT c.book, c.ch, o.page, greatest(o.page_off, c.start) - c.start AS base,
    substr(o.text, greatest(c.start - o.page_off, 0) + 1, greatest(least(c."end" - o.page_off, length(o.text))
      - greatest(c.start - o.page_off, 0), 0)) AS text
    FROM ch c JOIN off o ON o.book = c.book AND o.page_off < c."end" AND o.page_off + length(o.text) > c.start),
  sls AS (SELECT * FROM sl WHERE text <> '')"""


@query(f"WITH {SLICES} SELECT book, ch, page, base::BIGINT AS base, text FROM sls")
def page_slices(spark, sf):
    pages = corpus(spark, sf)
    return structure.page_slices(chapters(spark, sf, pages)[1], pages)


@query(f"""WITH {SLICES}, w AS (SELECT book, ch, sum({I.sql_words('text')}) AS w FROM sls GROUP BY 1, 2)
  SELECT book, c.ch AS old_ch, row_number() OVER (PARTITION BY book ORDER BY start, seq) - 1 AS ch, title
  FROM ch c JOIN w USING (book, ch) WHERE w > 0""")
def drop_empty_chapters(spark, sf):
    pages = corpus(spark, sf)
    ch = stage(chapters(spark, sf, pages)[1], "chapters")
    return structure.drop_empty(ch, structure.page_slices(ch, pages)).select("book", "old_ch", "ch", "title")


@query(f"""WITH {BOUNDS} SELECT book, ch, title FROM ch WHERE NOT (page BETWEEN 3 AND 7 OR {I.sql_key('title')} = 'the'
  OR contains({I.sql_key('title')}, 'front matter'))""")
def skip_sections(spark, sf):
    pages = corpus(spark, sf)
    prof = pages.select("book").distinct().select("book", F.struct(
        F.array(F.lit("The!"), F.lit("Front  Matter")).alias("titles"),
        F.array(F.array(F.lit(3), F.lit(7)), F.array(F.lit(9))).alias("page_ranges")).alias("skip_sections"))
    return structure.skip_sections(chapters(spark, sf, pages)[1], prof).select("book", "ch", "title")


SECT = f"""{I.CORPUS_SENT}, w0 AS (SELECT book, page, k, cs, ce, {I.sql_words('t')} AS w,
    row_number() OVER (PARTITION BY book ORDER BY page, k) AS r FROM sen),
  f AS (SELECT book, page, k, cs, ce, r, 0::BIGINT AS section, CASE WHEN w >= 1400 THEN 0 ELSE w END AS acc, w >= 1400 AS closes FROM w0 WHERE r = 1
    UNION ALL SELECT n.book, n.page, n.k, n.cs, n.ce, n.r, f.section + f.closes::INTEGER,
      CASE WHEN f.acc + n.w >= 1400 THEN 0 ELSE f.acc + n.w END, f.acc + n.w >= 1400
    FROM f JOIN w0 n ON n.book = f.book AND n.r = f.r + 1)"""


def _sections(spark, sf):
    s = I.corpus_sentences(spark, sf)
    s = s.select("book", "page", "k", F.col("cs").alias("start"), F.col("ce").alias("end"),
                 T.word_count("t").alias("w"))
    return structure.fixed_sections(s)


@query(f"""WITH RECURSIVE {SECT} SELECT book, page, k::INTEGER AS k, closes, section FROM f""")
def fixed_sections(spark, sf):
    return _sections(spark, sf).select("book", "page", "k", "closes", "section")


@query(f"""WITH RECURSIVE {SECT}, len AS (SELECT book, CAST(sum(length(text) + 2) - 2 AS BIGINT) AS book_len FROM cl GROUP BY book),
  g AS (SELECT book, section, min(cs) AS first, max(ce) AS last, bool_or(closes) AS closed FROM f GROUP BY 1, 2)
  SELECT book, 'Section ' || (section + 1) AS title,
    coalesce(lag(last) OVER (PARTITION BY book ORDER BY section), first) AS start,
    CASE WHEN closed THEN last ELSE book_len END AS "end" FROM g JOIN len USING (book)""")
def section_bounds(spark, sf):
    d = stage(_sections(spark, sf), "sections")
    pages = corpus(spark, sf)
    return structure.section_bounds(d, structure.book_lengths(pages)).select("book", "title", "start", "end")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 11 WHEN 1 THEN 18 WHEN 2 THEN 16 WHEN 3 THEN 22 ELSE 0 END::INTEGER AS cut
  FROM documents""")
def heading_cut(spark, sf):
    """Labels put in front of each text are cut again, and nothing else."""
    m, body = F.col("doc_id") % 5, F.concat(F.lit("x"), "text")
    text = (F.when(m == 0, F.concat(F.lit("CHAPTER 1\n\n"), body)).when(m == 1, F.concat(F.lit("ONE\n\nA Fine Title\n"), body))
             .when(m == 2, F.concat(F.lit("The Third Word: "), body))
             .when(m == 3, F.concat(F.lit("FERRIES , AND HARBOUR n the "), body)).otherwise(body))
    title = F.when(m == 2, "The Third Word").when(m == 3, "Connected People").otherwise("Ａ Ｆｉｎｅ Title")
    pats = F.array(F.lit("^CHAPTER [0-9]+$"), F.lit("(["), F.lit("^(ONE|TWO)$"))
    return I.table(spark, sf, "documents").select(
        "doc_id", structure.heading_cut(text, title, pats).alias("cut"))


@query(f"""WITH RECURSIVE {I.PAGES}, {HEADINGS}, n AS (SELECT book, max(page) + 1 AS n FROM pg GROUP BY book),
  l1 AS (SELECT book, page, min(seq) AS seq FROM hd WHERE level = 1 GROUP BY 1, 2),
  st AS (SELECT book, page FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY seq) AS r FROM l1 WHERE page >= 6) WHERE r <= 8),
  cand AS (SELECT pg.book, pg.page, pg.raw, pg.page < 6 OR l1.page IS NOT NULL AS priority FROM pg JOIN n USING (book)
    LEFT JOIN l1 ON l1.book = pg.book AND l1.page = pg.page
    WHERE pg.page < 6 OR pg.page BETWEEN n // 2 - 1 AND n // 2 + 1 OR pg.page >= n - 3 OR (pg.book, pg.page) IN (FROM st)),
  v AS (SELECT book, page, priority, '--- PAGE ' || page || ' ---' || chr(10) || 'TEXT:' || chr(10) ||
      CASE WHEN length(b) > cap THEN substr(b, 1, cap) || ' …[truncated]' ELSE b END AS view
    FROM (SELECT *, {I.sql_strip('raw')} AS b, CASE WHEN priority THEN 1800 ELSE 1000 END AS cap FROM cand)),
  tc AS (SELECT book, sum(length(title) + 6 + length(page::VARCHAR) + 2 * (level - 1)) AS t FROM hd GROUP BY book),
  o AS (SELECT v.*, 67 + coalesce(t, 8) AS u0, row_number() OVER (PARTITION BY book ORDER BY NOT priority, page) AS r FROM v LEFT JOIN tc USING (book)),
  f AS (SELECT book, page, priority, view, r, u0 + length(view) AS used, TRUE AS keep, TRUE AS has FROM o WHERE r = 1
    UNION ALL SELECT o.book, o.page, o.priority, o.view, o.r,
      CASE WHEN f.used + length(o.view) <= 15000 OR NOT f.has THEN f.used + length(o.view) ELSE f.used END,
      f.used + length(o.view) <= 15000 OR NOT f.has, f.has OR f.used + length(o.view) <= 15000
    FROM f JOIN o ON o.book = f.book AND o.r = f.r + 1)
  SELECT book, page, priority, view FROM f WHERE keep""")
def sample_pages(spark, sf):
    return structure.sample_pages(I.raw_pages(spark, sf), headings(spark, sf), budget=15000)


# ---- profiles and rules ----------------------------------------------------------------------

@query("""SELECT p_partkey::VARCHAR AS book, p_partkey % 4 <> 3 AS usable, CASE WHEN p_partkey % 4 IN (1, 3) THEN 'trust' ELSE 'derive' END AS toc,
  CASE WHEN p_partkey % 4 <> 3 THEN p_name END AS sub, CASE WHEN p_partkey % 4 <> 3 THEN p_size END AS zone FROM part""")
def profile_replies(spark, sf):
    """Profiles from replies with fences, prose or nothing usable, written out and read again."""
    from bookflow.sources.profiles import parse_profiles, profile_json
    m = F.col("p_partkey") % 4
    body = F.concat(F.lit('{"cleaning": {"drop_substrings": ["'), "p_name", F.lit('"], "header_zone_max_y": '),
                    F.col("p_size").cast("string"), F.lit('}, "structure": {'), F.when(m == 1, "").otherwise('"toc": "derive"'), F.lit("}}"))
    reply = (F.when(m == 0, body).when(m == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
              .when(m == 2, F.concat(F.lit("Result "), body, F.lit(" (end)"))).otherwise("no idea {"))
    p = parse_profiles(I.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("book"), reply.alias("r")), "book", "r")
    again = parse_profiles(profile_json(p), "book", "doc").drop("usable").join(p.select("book", "usable"), "book")
    return again.select("book", "usable", F.col("structure.toc").alias("toc"),
                        F.get("cleaning.drop_substrings", F.lit(0)).alias("sub"), F.col("cleaning.header_zone_max_y").alias("zone"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0")
def valid_rules(spark, sf):
    """Every third pattern has an open bracket and is dropped."""
    p = I.table(spark, sf, "part")
    rx = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "([").otherwise(".*"))
    return clean.valid_rules(p.withColumn("pattern", rx)).select("p_partkey", "p_name")
