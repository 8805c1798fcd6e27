"""Registered queries: library, progress cards, resume, search, feed, package."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.operators import catalog as C
from bookflow.operators import export, search as S
from bookflow.plans import inputs as I
from bookflow.plans.text_queries import _clock
from bookflow.plans.timeline_queries import TURN_TL, turn_timeline
from bookflow.settings import stage
from bookflow.sources import files as FS
from bookflow.sources import manifests as M

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


# Customers as books, orders as chapters, order lines as sentences.  Every fourth book declares
# its counts, every seventh manifest is damaged, order status O means "no status given".
BASE = """o AS (SELECT o_custkey AS cust, 'c' || o_custkey AS book, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ch, o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'P' THEN 'pending' END AS status, o_totalprice AS duration, o_orderdate,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'ch' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.mp3' ELSE '.wav' END END AS audio,
    CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'Order <' || o_orderkey || '>' END AS title FROM orders),
  bk AS (SELECT c_custkey AS cust, 'c' || c_custkey AS book, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE 'c' || c_custkey END AS title,
    CASE WHEN c_custkey % 5 = 0 THEN 'generating' WHEN c_custkey % 5 = 1 THEN 'ready' WHEN c_custkey % 5 = 2 THEN 'partial' ELSE 'ready' END AS status,
    '2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00' AS created, c_acctbal AS bal FROM customer)"""


def chapters(spark, sf):
    o = I.table(spark, sf, "orders")
    from bookflow.operators import scan
    d = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("book"), "o_orderkey",
                 F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "P", "pending").alias("status"),
                 F.col("o_totalprice").alias("duration"),
                 F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("ch"), F.col("o_orderkey").cast("string"), F.when(
                     F.col("o_orderkey") % 2 == 0, ".mp3").otherwise(".wav"))).alias("audio"),
                 F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(F.concat(F.lit("Order <"), F.col("o_orderkey").cast("string"), F.lit(">"))).alias("title"))
    return scan.row_index(d, ["book"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 4096), "ch")


def books(spark, sf):
    c, k = I.table(spark, sf, "customer"), F.col("c_custkey")
    book = F.concat(F.lit("c"), k.cast("string"))
    return c.select(book.alias("book"), F.when(k % 3 > 0, F.col("c_name")).otherwise(book).alias("title"),
                    F.when(k % 5 == 0, "generating").when(k % 5 == 2, "partial").otherwise("ready").alias("status"),
                    F.format_string("2024-01-%02dT10:00:00", k % 28 + 1).alias("created"),
                    F.col("c_acctbal").alias("bal"), k.alias("cust"))


def manifests(spark, sf, summary=False):
    """Manifest documents as JSON text, parsed like files would be."""
    c = chapters(spark, sf)
    per = c.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", F.struct(
        F.concat(F.lit("ch"), F.col("ch").cast("string")).alias("id"), F.col("ch").alias("index"), "title", "status", "audio", "duration",
        F.array(F.struct(F.col("title").alias("title"), F.lit(3).alias("level"))).alias("topics"),
        F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int")), lambda i: F.struct(
            i.alias("i"), F.concat(F.lit("s"), i.cast("string")).alias("t"), (i * 2.0).alias("s"))).alias("sentences"))
        .alias("c")))), lambda x: x["c"]).alias("chapters"))
    b = books(spark, sf).join(per, "book", "left")
    k = F.col("cust")
    doc = F.to_json(F.struct(
        F.when(k % 2 == 0, F.col("book")).alias("id"), F.when(k % 3 > 0, F.col("title")).alias("title"),
        F.when(k % 5 != 1, F.col("status")).alias("status"), F.col("created"),
        F.when(k % 4 == 0, F.lit(99)).alias("chapters_total"), F.when(k % 4 == 0, F.lit(7)).alias("chapters_ready"),
        F.when(k % 4 == 0, F.col("bal")).alias("total_duration"), F.col("chapters")))
    bad = F.when(k % 7 == 0, F.substring(doc, 1, 25)).otherwise(doc)
    return M.parse_manifests(b.select("book", bad.alias("doc")), "doc", "book", summary)


N_CH = """n AS (SELECT book, count(*) AS n, count(*) FILTER (coalesce(status, 'ready') = 'ready') AS r FROM o GROUP BY book)"""
SUMMARY = f"""{BASE}, {N_CH}, sm AS (SELECT bk.book AS id, title, status, CASE WHEN cust % 4 = 0 THEN 99 ELSE coalesce(n, 0) END::BIGINT AS n_chapters,
  CASE WHEN cust % 4 = 0 THEN 7 ELSE coalesce(r, 0) END::BIGINT AS chapters_ready,
  CASE WHEN cust % 4 = 0 THEN bal ELSE 0 END AS duration, created, bk.book AS dir FROM bk LEFT JOIN n ON n.book = bk.book WHERE cust % 7 <> 0)"""


@query(f"WITH {SUMMARY} SELECT id, title, status, n_chapters, chapters_ready, duration, created FROM sm")
def library_summary(spark, sf):
    return C.library_summary(manifests(spark, sf, summary=True)).select(
        "id", "title", "status", "n_chapters", "chapters_ready", "duration", "created")


@query(f"WITH {SUMMARY} SELECT count(*) AS books, count(*) FILTER (status = 'generating') AS generating FROM sm")
def library_counts(spark, sf):
    return C.library_counts(C.library_summary(manifests(spark, sf, summary=True)))


@query(f"WITH {SUMMARY} SELECT id, title, created FROM sm ORDER BY lower(title), dir")
def library_by_title(spark, sf):
    return C.library_order(C.library_summary(manifests(spark, sf, summary=True)), "title").select("id", "title", "created")


@query(f"""WITH {BASE} SELECT o.book, o.ch::INTEGER AS ch, o.title, coalesce(o.status, 'ready') AS status, 'ch' || o.ch AS chapter_id, o.duration
  FROM o WHERE cust % 7 <> 0""")
def manifest_chapters(spark, sf):
    return M.manifest_chapters(manifests(spark, sf)).select("book", "ch", "title", "status", "chapter_id", "duration")


@query(f"""WITH {BASE}, s AS (SELECT book, ch, cust, unnest(range(0, o_orderkey % 3 + 1)) AS i FROM o)
  SELECT book, ch::INTEGER AS ch, i::INTEGER AS i, 's' || i AS t, (i * 2)::DOUBLE AS s, 0 AS p FROM s WHERE cust % 7 <> 0""")
def manifest_sentences(spark, sf):
    return M.manifest_sentences(manifests(spark, sf)).select("book", "ch", "i", "t", "s", "p")


@query(f"""WITH {BASE} SELECT book, ch::INTEGER AS ch, 0 AS pos, title, 3 AS level FROM o WHERE cust % 7 <> 0""")
def manifest_topics(spark, sf):
    return M.manifest_topics(manifests(spark, sf)).select("book", "ch", "pos", "title", "level")


@query(f"""WITH {BASE} SELECT book, ch::INTEGER AS ch, title, coalesce(status, 'ready') AS status, (o_orderkey % 3 + 1)::BIGINT AS n_sentences,
  1::BIGINT AS n_topics FROM o WHERE cust % 7 <> 0""")
def chapter_info(spark, sf):
    return C.chapter_info(manifests(spark, sf))


@query("""WITH s AS (SELECT l_orderkey AS ch, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS ch, 1 AS n FROM orders WHERE o_orderkey % 3 = 0)
  SELECT 'b' AS book, ch, coalesce(s.n, 0)::BIGINT AS n_sentences, coalesce(t.n, 0)::BIGINT AS n_topics FROM s FULL JOIN t USING (ch)""")
def chapter_counts(spark, sf):
    s = I.table(spark, sf, "lineitem").select(F.lit("b").alias("book"), F.col("l_orderkey").alias("ch"))
    t = I.table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.lit("b").alias("book"), F.col("o_orderkey").alias("ch"))
    return C.chapter_counts(s, t)


@query("""SELECT l_suppkey::VARCHAR AS book, count(*) AS n_sentences FROM lineitem GROUP BY 1""")
def total_sentences(spark, sf):
    return C.total_sentences(I.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("book")))


@query(f"""WITH {BASE}, s AS (SELECT book, coalesce(status, 'ready') AS st, duration FROM o)
  SELECT book, count(*) AS chapters_total, count(*) FILTER (st = 'ready') AS chapters_ready,
    round(sum(CASE WHEN st = 'ready' THEN duration ELSE 0 END), 2) AS total_duration,
    CASE WHEN substr(book, 2)::INTEGER % 10 = 0 THEN 'cancelled' WHEN bool_and(st = 'ready') THEN 'ready' ELSE 'partial' END AS status FROM s GROUP BY book""")
def book_status(spark, sf):
    cancelled = books(spark, sf).filter("cust % 10 = 0").select("book")
    return C.book_status(chapters(spark, sf), cancelled).withColumn("total_duration", F.round("total_duration", 2))


@query(f"""WITH {SUMMARY}, {I.PROGRESS.replace('event_type AS book', "'c' || (event_id % 90) AS book")},
  l AS (SELECT "user", book, arg_max(struct_pack(ci, t, si, frac, updated, device, seq), seq) AS r, max(seq) AS seq FROM pr GROUP BY 1, 2),
  x AS (SELECT l."user", l.book, sm.title, r.ci AS ci, r.t AS t, r.updated AS updated, r.frac AS frac, created, dir, status FROM l JOIN sm ON sm.id = l.book
    WHERE NOT (status = 'ready' AND r.frac >= 0.5)),
  y AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY updated DESC, created DESC, dir) AS rn FROM x)
  SELECT "user", book, title, ci, t, updated, floor(frac * 100 + 0.5)::INTEGER AS pct FROM y WHERE rn = 1""")
def continue_listening(spark, sf):
    """Fractions are doubled so that half-read books count as finished in this data."""
    from bookflow.streaming.progress import latest_positions
    p = I.progress(spark, sf).withColumn("book", F.concat(F.lit("c"), (F.col("seq") % 90).cast("string")))
    p = latest_positions(p).withColumns({"frac": F.when(F.col("frac") >= 0.5, 1.0).otherwise(F.col("frac")), "_f": F.col("frac")})
    d = C.continue_listening(C.library_summary(manifests(spark, sf, summary=True)), p)
    return d.join(p.select("user", "book", "_f"), ["user", "book"]).withColumn(
        "pct", F.floor(F.col("_f") * 100 + 0.5).cast("int")).drop("_f")


@query(f"""WITH {SUMMARY}, {I.PROGRESS.replace('event_type AS book', "'c' || (event_id % 90) AS book")},
  l AS (SELECT "user", book, max(frac) AS frac FROM pr GROUP BY "user", book)
  SELECT id, "user", frac, CASE WHEN frac > 0 THEN CASE WHEN status = 'ready' AND frac >= 0.999 THEN 100 ELSE least(100, greatest(2, floor(frac * 100 + 0.5))) END END::INTEGER AS listened,
    CASE WHEN status <> 'ready' THEN least(100, CASE WHEN n_chapters > 0 THEN floor(chapters_ready::DOUBLE / n_chapters * 100 + 0.5) ELSE 0 END) END::INTEGER AS generated
  FROM sm LEFT JOIN l ON l.book = sm.id""")
def cards(spark, sf):
    p = I.progress(spark, sf).withColumn("book", F.concat(F.lit("c"), (F.col("seq") % 90).cast("string")))
    p = p.groupBy("user", "book").agg(F.max("frac").alias("frac"))
    return C.cards(C.library_summary(manifests(spark, sf, summary=True)), p).select("id", "user", "frac", "listened", "generated")


@query(f"""WITH {BASE}, p AS (SELECT DISTINCT user_id::VARCHAR AS "user", 'c' || (event_id % 90) AS book, user_id % 9 AS ci, CASE WHEN user_id % 4 = 0 THEN 1.0 ELSE 0.4 END AS frac FROM events),
  r AS (SELECT book, ch FROM o WHERE coalesce(status, 'ready') = 'ready'), f AS (SELECT book, min(ch) AS f FROM r GROUP BY book),
  j AS (SELECT p."user", p.book, p.ci, bk.status = 'ready' AND p.frac >= 0.999 AS fin, r.ch IS NOT NULL AS ok, f FROM p JOIN bk USING (book) LEFT JOIN f USING (book)
    LEFT JOIN r ON r.book = p.book AND r.ch = p.ci)
  SELECT "user", book, CASE WHEN ok AND NOT fin THEN ci ELSE coalesce(f, -1) END::INTEGER AS target,
    CASE WHEN ok AND NOT fin THEN 12.5 WHEN coalesce(f, -1) = ci AND NOT fin THEN 12.5 ELSE 0 END::DOUBLE AS start_at FROM j""")
def opening_target(spark, sf):
    p = I.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user"), F.concat(F.lit("c"), (F.col("event_id") % 90).cast("string")).alias("book"),
        (F.col("user_id") % 9).alias("ci"), F.lit(12.5).alias("t"), F.when(F.col("user_id") % 4 == 0, 1.0).otherwise(0.4).alias("frac")).distinct()
    return C.opening_target(books(spark, sf), chapters(spark, sf), p)


FILES = """fl AS (SELECT DISTINCT 'c' || o_custkey AS book, 'ch' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.mp3' ELSE '.wav' END AS name, (l_partkey * 10) AS length
    FROM (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey)"""


def files(spark, sf):
    """An audio file exists for every order that has lines."""
    li = I.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("pk"))
    o = I.table(spark, sf, "orders").join(li, "o_orderkey")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("book"), F.concat(
        F.lit("ch"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".mp3").otherwise(".wav")).alias("name"),
        (F.col("pk") * 10).alias("length"))


@query(f"""WITH {BASE}, {FILES} SELECT book, ch, o_orderkey FROM o WHERE NOT (coalesce(status, 'ready') = 'ready' AND audio IS NOT NULL
  AND (book, audio) IN (SELECT (book, name) FROM fl))""")
def resume_plan(spark, sf):
    return C.resume_plan(chapters(spark, sf), files(spark, sf)).select("book", "ch", "o_orderkey")


@query(f"""WITH {BASE}, {FILES}, d AS (SELECT o.*, coalesce(status, 'ready') = 'ready' AND audio IS NOT NULL AND (book, audio) IN (SELECT (book, name) FROM fl) AS ok FROM o)
  SELECT book, count(*) FILTER (ok) AS chapters_ready, round(sum(CASE WHEN ok THEN duration ELSE 0 END), 2) AS total_duration FROM d GROUP BY book""")
def resume_totals(spark, sf):
    return C.resume_totals(chapters(spark, sf), files(spark, sf)).withColumn("total_duration", F.round("total_duration", 2))


@query("""SELECT c_custkey, c_custkey % 3 <> 2 AND c_name IN (SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') FROM orders) AS has_source FROM customer""")
def source_available(spark, sf):
    b = I.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 2, F.col("c_name")).otherwise("").alias("source_pdf"))
    inbox = I.table(spark, sf, "orders").select(F.format_string("Customer#%09d", "o_custkey").alias("name"))
    return C.with_source(b, inbox).select("c_custkey", "has_source")


@query("""SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)""")
def not_installed(spark, sf):
    remote = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return C.not_installed(remote, I.table(spark, sf, "orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("id")))


@query("""SELECT o_custkey::VARCHAR AS book, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def delete_books(spark, sf):
    t = I.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("book"), "o_orderkey", "o_totalprice")
    gone = I.table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("book"))
    return C.delete_books(t, gone)


def _topics(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").dropDuplicates(["l_orderkey", "l_linenumber"])
    li = I.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    c = chapters(spark, sf).select("book", "ch", "o_orderkey")
    return li.join(c, li.l_orderkey == c.o_orderkey).select(
        "book", "ch", F.col("l_linenumber").cast("int").alias("pos"), F.concat(F.lit("Part "), F.col("l_linenumber").cast("string")).alias("title"),
        (F.col("l_linenumber") % 3 + 2).cast("int").alias("level"), F.when(F.col("q") > 10, F.col("q")).alias("time"))


TOPICS = """tpc AS (SELECT o.book, o.ch, l_linenumber::INTEGER AS pos, 'Part ' || l_linenumber AS title, CASE WHEN q > 10 THEN q END AS time
  FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2) JOIN o ON o.o_orderkey = l_orderkey)"""


@query(f"""WITH {BASE}, {TOPICS} SELECT book, ch, 0 AS kind, 0 AS pos, title, coalesce(status, 'ready') = 'ready' AS enabled,
    CASE WHEN coalesce(status, 'ready') = 'ready' THEN duration END AS time FROM o
  UNION ALL SELECT t.book, t.ch, 1, pos, t.title, coalesce(status, 'ready') = 'ready' AND t.time IS NOT NULL, t.time FROM tpc t JOIN o ON o.book = t.book AND o.ch = t.ch""")
def outline(spark, sf):
    return C.outline(chapters(spark, sf), _topics(spark, sf)).drop("level")


@query(f"""WITH {BASE}, {TOPICS} SELECT book, ch, 0 AS kind, 0 AS pos, title, coalesce(status, 'ready') = 'ready' AS enabled,
    CASE WHEN coalesce(status, 'ready') = 'ready' THEN duration END AS time FROM o
  UNION ALL SELECT t.book, t.ch, 1, pos, t.title, coalesce(status, 'ready') = 'ready', t.time
    FROM tpc t JOIN o ON o.book = t.book AND o.ch = t.ch WHERE t.time IS NOT NULL""")
def outline_phone(spark, sf):
    return C.outline(chapters(spark, sf), _topics(spark, sf), timed_only=True).drop("level")


@query(f"""WITH {SUMMARY}, jb AS (SELECT 'c' || (event_id % 300) AS id, max(event_id) AS e FROM events GROUP BY 1),
  j AS (SELECT id, e::VARCHAR AS job, CASE e % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'paused' WHEN 2 THEN 'cancelling' ELSE 'done' END AS st FROM jb)
  SELECT sm.id, sm.status AS manifest_status, chapters_ready, n_chapters AS chapters_total, job IS NOT NULL AS active, coalesce(st = 'paused', FALSE) AS paused,
    coalesce(st = 'cancelling', FALSE) AS cancelling, CASE WHEN job IS NULL THEN '' ELSE 'm' || job END AS message,
    substr(sm.id, 2)::INTEGER IN (SELECT o_custkey FROM orders) AS has_source
  FROM sm LEFT JOIN (FROM j WHERE st <> 'done') j ON j.id = sm.id""")
def generation_state(spark, sf):
    s = C.library_summary(manifests(spark, sf, summary=True)).withColumn("source_pdf", F.concat("id", F.lit(".pdf")))
    e = I.table(spark, sf, "events").groupBy(F.concat(F.lit("c"), (F.col("event_id") % 300).cast("string")).alias("book")).agg(F.max("event_id").alias("e"))
    m = F.col("e") % 4
    jobs = e.select("book", F.col("e").cast("string").alias("job"), F.when(m == 0, "running").when(m == 1, "paused").when(
        m == 2, "cancelling").otherwise("done").alias("status"), F.concat(F.lit("m"), F.col("e").cast("string")).alias("message"))
    inbox = I.table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("name"))
    return C.generation_state(s, jobs, inbox)


# ---- search ----------------------------------------------------------------------------------

def _search_sql(cap: int, keep: int) -> str:
    esc = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    return f"""WITH {TURN_TL}, q AS (SELECT DISTINCT substr(text, 3, 4 + item_id % 4) AS q FROM benchmark UNION SELECT '  ' UNION SELECT 'e'),
    n AS (SELECT q, lower({I.sql_strip('q')}) AS nd FROM q WHERE {I.sql_strip('q')} <> ''),
    it AS (SELECT DISTINCT book, ch, 0 AS kind, 0::BIGINT AS pos, 0.0::DOUBLE AS time, 'Turn ' || (ch + 1) AS text FROM tl
      UNION ALL SELECT book, ch, 1, i, CASE WHEN i % 2 = 0 THEN s END, substr(t, 1, 12) FROM tl WHERE i % 3 = 0
      UNION ALL SELECT book, ch, 2, i, s, t FROM tl),
    h AS (SELECT n.q, n.nd, it.*, row_number() OVER (PARTITION BY q, book ORDER BY ch, kind, pos) AS r FROM it JOIN n ON contains(lower(it.text), n.nd)),
    k AS (SELECT *, row_number() OVER (PARTITION BY q, book ORDER BY kind = 2, r) AS rank FROM h WHERE r <= {cap}),
    z AS (SELECT *, strpos(lower(text), nd) - 1 AS idx, greatest(0, strpos(lower(text), nd) - 31) AS a,
      least(length(text), strpos(lower(text), nd) - 1 + length(nd) + 50) AS b FROM k WHERE rank <= {keep})
    SELECT q, book, rank::INTEGER AS rank, ch, kind, time, CASE WHEN a > 0 THEN '…' ELSE '' END || {esc('substr(text, a + 1, idx - a)')} || '<mark>' ||
      {esc('substr(text, idx + 1, length(nd))')} || '</mark>' || {esc('substr(text, idx + length(nd) + 1, b - idx - length(nd))')} ||
      CASE WHEN b < length(text) THEN '…' ELSE '' END AS snippet FROM z"""


def _search(spark, sf, cap, keep):
    tl = turn_timeline(spark, sf)
    ch = tl.select("book", "ch").distinct().withColumn("title", F.concat(F.lit("Turn "), (F.col("ch") + 1).cast("string")))
    tp = tl.filter("i % 3 = 0").select("book", "ch", F.col("i").alias("pos"), F.substring("t", 1, 12).alias("title"),
                                       F.when(F.col("i") % 2 == 0, F.col("s")).alias("time"))
    b = I.table(spark, sf, "benchmark")
    q = b.select(F.expr("substring(text, 3, 4 + int(item_id % 4))").alias("q")).unionByName(
        b.select(F.explode(F.array(F.lit("  "), F.lit("e"))).alias("q"))).distinct()
    return S.search(S.search_items(ch, tp, tl), q, cap, keep)


@query(_search_sql(201, 60))
def search_topk(spark, sf):
    return _search(spark, sf, 201, 60)


@query(_search_sql(20, 6))
def search_topk_small_caps(spark, sf):
    """Caps of 20 and 6, so that both cut."""
    return _search(spark, sf, 20, 6)


# ---- feed and package ------------------------------------------------------------------------

@query(f"""WITH {BASE}, {FILES}, e AS (SELECT o.*, row_number() OVER (PARTITION BY book ORDER BY ch) AS episode FROM o
    WHERE coalesce(status, 'ready') = 'ready' AND audio IS NOT NULL)
  SELECT e.book, e.ch, e.episode, CASE WHEN e.title = '' THEN 'Chapter ' || (e.ch + 1) ELSE e.title END AS title,
    'http://host/media/' || e.book || '/' || audio AS url, coalesce(length, 0)::BIGINT AS length,
    CASE WHEN audio LIKE '%.mp3' THEN 'audio/mpeg' ELSE 'audio/wav' END AS mime, e.book || '-ch' || lpad(e.ch::VARCHAR, 4, '0') AS guid,
    strftime(created::TIMESTAMP + to_minutes(e.ch), '%a, %d %b %Y %H:%M:%S') || ' GMT' AS pub_date,
    {_clock('CAST(round_even(e.duration, 0) AS BIGINT)')} AS duration, 'nobody' AS author
  FROM e JOIN bk USING (book) LEFT JOIN fl ON fl.book = e.book AND fl.name = e.audio""")
def feed_items(spark, sf):
    b = books(spark, sf).withColumn("author", F.lit(""))
    return export.feed_items(b, chapters(spark, sf), files(spark, sf), "http://host/", "nobody")


# Titles of books hold no markup, those of chapters do.
FEED_PARTS = f"""WITH {BASE}, {FILES}, e AS (SELECT o.*, row_number() OVER (PARTITION BY book ORDER BY ch) AS episode FROM o
    WHERE coalesce(status, 'ready') = 'ready' AND audio IS NOT NULL),
  it AS (SELECT e.book, episode, '    <item>' || chr(10) || '      <title>' || replace(replace(CASE WHEN e.title = '' THEN 'Chapter ' || (e.ch + 1) ELSE e.title END, '<', '&lt;'), '>', '&gt;') || '</title>' || chr(10) ||
    '      <itunes:episode>' || episode || '</itunes:episode>' || chr(10) || '      <itunes:episodeType>serial</itunes:episodeType>' || chr(10) ||
    '      <enclosure url="http://host/media/' || e.book || '/' || audio || '" length="' || coalesce(length, 0) || '" type="' || CASE WHEN audio LIKE '%.mp3' THEN 'audio/mpeg' ELSE 'audio/wav' END || '"/>' || chr(10) ||
    '      <guid isPermaLink="false">' || e.book || '-ch' || lpad(e.ch::VARCHAR, 4, '0') || '</guid>' || chr(10) ||
    '      <pubDate>' || strftime(created::TIMESTAMP + to_minutes(e.ch), '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate>' || chr(10) ||
    '      <itunes:duration>' || ({_clock('CAST(round_even(e.duration, 0) AS BIGINT)')}) || '</itunes:duration>' || chr(10) || '      <itunes:author>A &amp; B</itunes:author>' || chr(10) || '    </item>' AS x
    FROM e JOIN bk USING (book) LEFT JOIN fl ON fl.book = e.book AND fl.name = e.audio)
  SELECT book, -1::BIGINT AS ch, 0 AS kind, 0::BIGINT AS part, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:atom="http://www.w3.org/2005/Atom">' || chr(10) ||
    '  <channel>' || chr(10) || '    <title>' || title || '</title>' || chr(10) || '    <link>http://host</link>' || chr(10) ||
    '    <atom:link href="http://host/api/books/' || book || '/feed.xml" rel="self" type="application/rss+xml"/>' || chr(10) || '    <language>en</language>' || chr(10) ||
    '    <itunes:author>A &amp; B</itunes:author>' || chr(10) || '    <description>' || title || ' by A &amp; B</description>' || chr(10) || '    <itunes:summary>' || title || ' by A &amp; B</itunes:summary>' || chr(10) ||
    '    <itunes:explicit>false</itunes:explicit>' || chr(10) || '    <itunes:image href="http://host/api/books/' || book || '/cover.png"/>' || chr(10) ||
    '    <image><url>http://host/api/books/' || book || '/cover.png</url><title>' || title || '</title><link>http://host</link></image>' || chr(10) || '    <itunes:category text="Books"/>' AS text FROM bk
  UNION ALL SELECT book, 1, 2, 0, '  </channel>' || chr(10) || '</rss>' FROM bk
  UNION ALL SELECT book, 0, 1, episode // 1024, string_agg(x, chr(10) ORDER BY episode) FROM it GROUP BY 1, 4"""


@query(FEED_PARTS)
def feed_xml(spark, sf):
    """Feed documents in parts."""
    b = books(spark, sf).withColumn("author", F.lit("A & B"))
    items = export.feed_items(b, chapters(spark, sf), files(spark, sf), "http://host/", "nobody")
    return export.feed_xml(b, items, "http://host/", F.concat("title", F.lit(" by "), "author"))


PACK = f"""{BASE}, {FILES}, wt AS (SELECT book, audio AS name FROM o WHERE coalesce(status, 'ready') = 'ready' AND audio IS NOT NULL),
  ms AS (SELECT book, min(name) AS m FROM wt WHERE (book, name) NOT IN (SELECT (book, name) FROM fl) GROUP BY book)"""


@query(f"""WITH {PACK}, ok AS (SELECT book FROM bk WHERE status = 'ready' AND book NOT IN (SELECT book FROM ms))
  SELECT book, 'manifest.json' AS name, 0 AS kind FROM ok UNION ALL SELECT wt.book, name, 2 FROM wt JOIN ok USING (book)
  UNION ALL SELECT book, 'notes.json', 1 FROM ok WHERE substr(book, 2)::INTEGER % 2 = 0""")
def package_files(spark, sf):
    """Every second book has notes."""
    notes = books(spark, sf).where("cust % 2 = 0").select("book", F.lit("notes.json").alias("name"), F.lit(9).cast("long").alias("length"))
    return export.package_plan(books(spark, sf), chapters(spark, sf), files(spark, sf).unionByName(notes))[0]


@query(f"""WITH {PACK} SELECT book, CASE WHEN status <> 'ready' THEN 'status ' || status ELSE 'missing ' || m END AS reason FROM bk LEFT JOIN ms USING (book)
  WHERE status <> 'ready' OR m IS NOT NULL""")
def package_refused(spark, sf):
    return export.package_plan(books(spark, sf), chapters(spark, sf), files(spark, sf))[1]


@query("""SELECT p_partkey, regexp_extract(path, '[^/]*$') AS name, length FROM (SELECT p_partkey, p_size AS length,
  '/in/' || p_brand || '/' || p_name || CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.epub' ELSE '.txt' END AS path FROM part) WHERE lower(path) LIKE '%.pdf' OR path LIKE '%.epub'""")
def inbox_suffixes(spark, sf):
    p, k = I.table(spark, sf, "part"), F.col("p_partkey") % 3
    path = F.concat(F.lit("/in/"), "p_brand", F.lit("/"), "p_name", F.when(k == 0, ".PDF").when(k == 1, ".epub").otherwise(".txt"))
    return FS.by_suffix(p.select("p_partkey", path.alias("path"), F.col("p_size").alias("length"))).select("p_partkey", "name", "length")


@query("""SELECT n_nationkey::INTEGER AS n_nationkey, x.f AS "from", x.t AS "to", row_number() OVER (PARTITION BY n_nationkey ORDER BY length(x.f) DESC) - 1 AS seq FROM
  (SELECT n_nationkey, unnest([{'f': n_name, 't': 'x$1'}, {'f': n_name || '-' || n_nationkey, 't': 'y'}]) AS x FROM nation)""".replace("- 1 AS seq", "- 1 AS seq").replace("row_number() OVER (PARTITION BY n_nationkey ORDER BY length(x.f) DESC) - 1", "CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY length(x.f) DESC) - 1 AS INTEGER)"))
def rule_files(spark, sf):
    """Commented rule files in object form; longer keys come first."""
    n = I.table(spark, sf, "nation")
    doc = F.concat(F.lit('// names\n{\n  # one per line\n"'), "n_name", F.lit('": "x$1", "'), "n_name", F.lit("-"),
                   F.col("n_nationkey").cast("string"), F.lit('": "y"}'))
    return FS.parse_rules(n.select("n_nationkey", doc.alias("doc")), "doc", "n_nationkey").select("n_nationkey", "from", "to", "seq")
