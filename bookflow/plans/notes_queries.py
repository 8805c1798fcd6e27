"""Registered queries: annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookflow.functions import text as T
from bookflow.operators import export, notes as N
from bookflow.operators.lookup import asof_grid  # noqa: F401
from bookflow.plans import inputs as I
from bookflow.plans.timeline_queries import TURN_TL, turn_timeline
from bookflow.plans.text_queries import _clock
from bookflow.settings import stage
from bookflow.sources.files import parse_notes

QUERIES, SQL = {}, {}
NOW = "2030-01-01T00:00:00Z"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp")


# ---- validation: events as notes with dirty fields ---------------------------------------------

def _dirty(spark, sf):
    e, k = I.dealt(I.table(spark, sf, "events"), "event_id"), F.col("event_id")
    s = lambda c: c.cast("string")
    return e.select(
        F.col("event_type").alias("book"), F.concat(F.lit("n"), s(k)).alias("id"), k.alias("seq"),
        F.when(k % 9 == 0, "x").otherwise(s(k % 7)).alias("ch"), s(k % 11).alias("si"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(s(k % 5)).alias("sj"), s(k * 3).alias("cs"), F.lit("oops").alias("ce"),
        F.when(k % 6 == 0, "NaN").otherwise(s(F.col("value"))).alias("s"), F.lit(None).cast("string").alias("e"),
        F.repeat("props", 200).alias("exact"), F.repeat("props", 9).alias("prefix"), F.lit(None).cast("string").alias("suffix"),
        F.when(k % 3 == 0, "GREEN").when(k % 3 == 1, "teal").alias("color"),
        F.array(F.concat(F.lit("#"), "event_type"), F.upper("event_type"), F.concat(F.lit("t"), s(k % 4))).alias("tags"),
        F.when(k % 2 == 0, F.repeat(F.lit(" "), 3)).otherwise(F.concat(F.lit("body "), s(k))).alias("note"),
        F.when(k % 5 == 0, "note").when(k % 5 == 1, "bogus").alias("kind"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"))


COERCED = """c0 AS (SELECT event_id AS k, event_type AS book, 'n' || event_id AS id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 7 END::INTEGER AS ch,
    (event_id % 11)::INTEGER AS a, CASE WHEN event_id % 4 = 0 THEN event_id % 11 ELSE event_id % 5 END::INTEGER AS b, (event_id * 3)::INTEGER AS cs, 0 AS ce,
    CASE WHEN event_id % 6 = 0 THEN 0 ELSE value END::DOUBLE AS s, 0::DOUBLE AS e, substr(repeat(props, 200), 1, 2000) AS exact, substr(repeat(props, 9), 1, 64) AS prefix,
    CASE WHEN event_id % 3 = 0 THEN 'green' ELSE 'yellow' END AS color, event_type || '|t' || (event_id % 4) AS tags,
    CASE WHEN event_id % 2 = 0 THEN '   ' ELSE 'body ' || event_id END AS note,
    CASE WHEN event_id % 5 = 0 OR event_id % 2 = 1 THEN 'note' ELSE 'highlight' END AS kind,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events),
  co AS (SELECT *, least(a, b) AS si, greatest(a, b) AS sj FROM c0)"""
_FIELDS = "book, id, ch, si, sj, cs, ce, s, e, exact, prefix, '' AS suffix, color, tags, note, kind"


def _flat(df, *more):
    return df.select("book", "id", "ch", "si", "sj", "cs", "ce", "s", "e", "exact", "prefix", "suffix", "color",
                     F.array_join("tags", "|").alias("tags"), "note", "kind", *more)


def _n_chapters(spark, sf):
    return I.table(spark, sf, "events").select(F.col("event_type").alias("book")).distinct().withColumn("n", F.length("book"))


@query(f"WITH {COERCED} SELECT {_FIELDS} FROM co WHERE ch < length(book)")
def note_validation(spark, sf):
    """A book has as many chapters as its name has letters."""
    return _flat(N.coerce_notes(_dirty(spark, sf), _n_chapters(spark, sf))[0])


@query(f"WITH {COERCED} SELECT book, id, ch FROM co WHERE ch >= length(book)")
def note_rejects(spark, sf):
    return N.coerce_notes(_dirty(spark, sf), _n_chapters(spark, sf))[1].select("book", "id", "ch")


@query(f"WITH {COERCED} SELECT {_FIELDS}, stamp AS created, stamp AS updated FROM co")
def note_documents(spark, sf):
    """Notes documents, wrapped or a bare array, parsed and validated: one small document per event."""
    d = _dirty(spark, sf).drop("ce")
    note = F.to_json(F.array(F.struct(*[c for c in d.columns if c not in ("book", "seq")])))
    doc = F.when(F.col("seq") % 2 == 0, note).otherwise(F.concat(F.lit('{"version": 1, "notes": '), note, F.lit("}")))
    docs = stage(d.select("book", doc.alias("doc")), "note_documents")
    c = N.coerce_notes(parse_notes(docs, "book", "doc"))[0]
    return _flat(c, "created", "updated")


@query(f"""WITH {COERCED}, n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ch, si, cs, stamp, id) - 1 AS r FROM co),
  x AS (SELECT book, r, CASE WHEN r > 0 THEN ',' ELSE '' END || '{{"id":' || to_json(id) || ',"ch":' || ch || ',"si":' || si || ',"sj":' || sj || ',"cs":' || cs || ',"ce":' || ce || ',"s":' || to_json(s) ||
    ',"e":' || to_json(e) || ',"exact":' || to_json(exact) || ',"prefix":' || to_json(prefix) || ',"suffix":"","color":"' || color || '","tags":' || to_json(string_split(tags, '|')) ||
    ',"note":' || to_json(note) || ',"kind":"' || kind || '","created":"' || stamp || '","updated":"' || stamp || '"}}' AS j FROM n)
  SELECT book, 0::BIGINT AS ch, 1 AS kind, r // 1024 AS part, string_agg(j, '' ORDER BY r) AS text FROM x GROUP BY 1, 4
  UNION ALL SELECT DISTINCT book, -1, 0, 0, '{{"book":' || to_json(book) || ',"version":1,"notes":[' FROM co UNION ALL SELECT DISTINCT book, 1, 0, 0, ']}}' FROM co""")
def note_document_parts(spark, sf):
    """Notes documents per book, in parts of 1024 notes."""
    return export.notes_documents(N.coerce_notes(_dirty(spark, sf))[0])


@query(f"""WITH {COERCED} SELECT {_FIELDS.replace(' id,', '')}, '{NOW}' AS created, '{NOW}' AS updated, 32 AS id_length, 1::BIGINT AS same_id FROM co WHERE ch < length(book)""")
def note_creation(spark, sf):
    """New notes; their ids can't be told beforehand, but are of one length and never shared."""
    d = N.create_notes(_dirty(spark, sf), _n_chapters(spark, sf), now())
    same = d.groupBy("id").agg(F.count("*").alias("same_id"))
    return _flat(d).join(d.select("book", "id", "created", "updated").join(same, "id"), ["book", "id"]).withColumn(
        "id_length", F.length("id")).drop("id")


@query(f"""WITH {COERCED}, p AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'blue' END AS pc, CASE WHEN k % 7 < 2 THEN 'patched' END AS pn FROM c0 WHERE k % 2 = 0)
  SELECT co.book, co.id, coalesce(pc, color) AS color, coalesce(pn, note) AS note,
    CASE WHEN p.k IS NULL THEN kind WHEN trim(coalesce(pn, note)) <> '' THEN 'note' ELSE 'highlight' END AS kind,
    CASE WHEN p.k IS NULL THEN stamp ELSE '{NOW}' END AS updated, stamp AS created FROM co LEFT JOIN p ON p.k = co.k""")
def note_patches(spark, sf):
    base = N.coerce_notes(_dirty(spark, sf))[0]
    k = F.col("seq")
    p = _dirty(spark, sf).filter(k % 2 == 0).select("book", "id", F.when(k % 3 == 0, "BLUE").alias("color"),
                                                   F.when(k % 7 < 2, "patched").alias("note"))
    return N.patch_notes(base, p, now()).select("book", "id", "color", "note", "kind", "updated", "created")


@query(f"WITH {COERCED} SELECT book, id FROM co WHERE k % 3 <> 0")
def note_deletion(spark, sf):
    d = _dirty(spark, sf)
    return N.delete_notes(d, d.filter("seq % 3 = 0")).select("book", "id")


@query("""SELECT event_type AS book, 'n' || event_id AS id FROM events WHERE event_id % 2 = 1""")
def soft_deletes(spark, sf):
    """Fresh tombstones for half of the notes leave the other half alive after a merge."""
    d = _dirty(spark, sf).select("book", "id", "seq", "created", "updated")
    graves = N.tombstones(d.filter("seq % 2 = 0"), now())
    return N.merge_with_tombstones(d, graves)[0].select("book", "id")


@query("""SELECT event_type AS book, 'n' || event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'x' ELSE (event_id % 7)::VARCHAR END AS ch, (event_id % 11)::VARCHAR AS si,
    CASE WHEN event_id % 4 > 0 THEN (event_id % 5)::VARCHAR END AS sj, (event_id * 3)::VARCHAR AS cs, 'oops' AS ce, CASE WHEN event_id % 6 = 0 THEN 'NaN' ELSE value::VARCHAR END AS s,
    CAST(NULL AS VARCHAR) AS e, repeat(props, 200) AS exact, repeat(props, 9) AS prefix, CAST(NULL AS VARCHAR) AS suffix,
    CASE event_id % 3 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'teal' END AS color, '#' || event_type || '|' || upper(event_type) || '|t' || (event_id % 4) AS tags,
    CASE WHEN event_id % 2 = 0 THEN '   ' ELSE 'body ' || event_id END AS note, CASE event_id % 5 WHEN 0 THEN 'note' WHEN 1 THEN 'bogus' END AS kind,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated, FALSE AS deleted FROM events""")
def durable_fields(spark, sf):
    """Notes without the fields that only a session knows; those that last keep their values."""
    d = _dirty(spark, sf).withColumns({"_orphan": F.lit(True), "tmp": F.lit(1), "deleted": F.lit(False)})
    return N.clean_note(d).withColumn("tags", F.array_join("tags", "|"))


# ---- merging: every event is a version of one of 700 notes, on both sides with other ids --------

SIDES = """la AS (SELECT 'b' || (event_id % 700 % 5) AS book, 'n' || (event_id % 700) AS id, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:00:00Z') AS u,
    event_type = 'error' AS deleted, event_type AS note, 0 AS side FROM events),
  ra AS (SELECT 'b' || ((event_id * 7 + 3) % 700 % 5) AS book, 'n' || ((event_id * 7 + 3) % 700) AS id, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:00:00Z') AS u,
    event_type = 'error' AS deleted, event_type AS note, 1 AS side FROM events),
  al AS (FROM la UNION ALL FROM ra)"""


def _sides(spark, sf):
    e = I.table(spark, sf, "events")
    st = F.date_format("ts", "yyyy-MM-dd'T'HH:00:00'Z'")

    def side(n):
        return e.select(F.concat(F.lit("b"), (n % 5).cast("string")).alias("book"), F.concat(F.lit("n"), n.cast("string")).alias("id"),
                        F.col("event_id").alias("seq"), st.alias("created"), st.alias("updated"),
                        (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("note"),
                        *[F.lit(0).alias(c) for c in ("ch", "si", "sj", "cs", "ce")], *[F.lit(0.0).alias(c) for c in ("s", "e")],
                        *[F.lit("").alias(c) for c in ("exact", "prefix", "suffix")], F.lit("yellow").alias("color"),
                        F.array().cast("array<string>").alias("tags"), F.lit("note").alias("kind"))

    return side(F.col("event_id") % 700), side((F.col("event_id") * 7 + 3) % 700)


_WIN = """w AS (SELECT book, id, arg_max(note, (u, side, seq)) AS note, max(u) AS updated, arg_max(deleted, (u, side, seq)) AS deleted,
  min(u) FILTER (side = 0) AS c0 FROM al GROUP BY 1, 2)"""


@query(f"WITH {SIDES}, {_WIN} SELECT book, id, note, updated FROM w")
def lww_merge(spark, sf):
    a, b = _sides(spark, sf)
    return N.merge_lww(a, b, now()).select("book", "id", "note", "updated")


@query(f"WITH {SIDES}, {_WIN} SELECT book, id, note, updated FROM w WHERE NOT deleted")
def lww_tombstones(spark, sf):
    return N.merge_with_tombstones(*_sides(spark, sf))[0].select("book", "id", "note", "updated")


@query(f"WITH {SIDES}, {_WIN} SELECT book, id FROM w WHERE deleted")
def lww_dead_ids(spark, sf):
    return N.merge_with_tombstones(*_sides(spark, sf))[1]


@query("""SELECT event_type AS book, 'n' || event_id AS id FROM events WHERE event_id % 3 = 0 OR event_id % 3 = 1 AND minute(ts) > 30""")
def unpushed_notes(spark, sf):
    """Remote lacks a third of the notes and holds a third at the half hour."""
    e, k = I.table(spark, sf, "events"), F.col("event_id")
    base = e.select(F.col("event_type").alias("book"), F.concat(F.lit("n"), k.cast("string")).alias("id"), k, "ts")
    local = base.withColumns({"created": F.lit(None).cast("string"), "updated": F.date_format("ts", "yyyy-MM-dd HH:mm")})
    remote = local.filter(k % 3 != 0).withColumn("updated", F.when(k % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:30")).otherwise(F.col("updated")))
    return N.unpushed(local, remote).select("book", "id")


@query("""SELECT DISTINCT user_id::VARCHAR AS book FROM events WHERE value > 60""")
def changed_note_sets(spark, sf):
    e = I.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("book"), F.col("event_id").cast("string").alias("id"),
                                            F.lit("2024").alias("created"), F.lit("2024").alias("updated"), "value")
    return N.changed_books(e, e.withColumn("updated", F.when(F.col("value") > 60, "2025").otherwise(F.col("updated"))))


@query("""WITH t AS (SELECT source AS book, doc_id AS seq, unnest(l) AS tag, generate_subscripts(l, 1) AS pos FROM
    (SELECT source, doc_id, string_split(text, ' ') AS l FROM documents)),
  g AS (SELECT book, seq, pos, coalesce(nullif(regexp_replace(regexp_replace(trim(tag, chr(10) || ' '), '\\s+', '-', 'g'), '[^0-9A-Za-z_/\\-]', '', 'g'), ''), 'tag') AS slug FROM t)
  SELECT book, arg_min(slug, (seq, pos)) AS slug FROM g GROUP BY book, lower(slug)""")
def distinct_tags(spark, sf):
    d = I.table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("seq"),
                                               F.split("text", " ").alias("tags"))
    return N.tag_list(d).select("book", "slug")


@query("""WITH r AS (SELECT doc_id AS seq, substr(sha256(concat_ws(chr(31), text, lang)), 1, 16) AS key, doc_id % 11 = 0 AS bad FROM documents),
  d AS (SELECT DISTINCT substr(sha256(concat_ws(chr(31), text, lang)), 1, 16) AS key FROM documents WHERE doc_id % 13 = 0)
  SELECT key, arg_min(seq, (bad, seq)) AS seq, count(*) AS n_requests FROM r WHERE key NOT IN (FROM d) GROUP BY key""")
def content_key_dedup(spark, sf):
    d = I.table(spark, sf, "documents")
    key = T.content_key("text", "lang")
    done = d.filter("doc_id % 13 = 0").select(key.alias("key")).distinct()
    req = d.select(F.col("doc_id").alias("seq"), "text", "lang", F.when(F.col("doc_id") % 11 == 0, "error").otherwise("done").alias("status"))
    return N.dedup_requests(req, key, done).select("key", "seq", "n_requests")


# ---- anchoring -------------------------------------------------------------------------------

RANGES = """rg AS (SELECT event_id, (user_id % 100)::VARCHAR AS book, (event_id % 8) AS ch, (event_id % 5)::INTEGER AS si, (event_id % 5 + event_id % 3)::INTEGER AS sj FROM events)"""
ANCHORS = f"""{TURN_TL}, {RANGES}, rs AS (SELECT rg.event_id, rg.book, rg.ch, si, sj, i, t, cs, ce, s, e FROM rg JOIN tl ON tl.book = rg.book AND tl.ch = rg.ch
    AND tl.i BETWEEN si - 3 AND sj + 3),
  an AS (SELECT event_id, book, ch, si, sj, max(cs) FILTER (i = si) AS cs, max(ce) FILTER (i = sj) AS ce, max(s) FILTER (i = si) AS s, max(e) FILTER (i = sj) AS e,
    string_agg(t, ' ' ORDER BY i) FILTER (i BETWEEN si AND sj) AS exact, coalesce(right(string_agg(t, ' ' ORDER BY i) FILTER (i < si), 32), '') AS prefix,
    coalesce(substr(string_agg(t, ' ' ORDER BY i) FILTER (i > sj), 1, 32), '') AS suffix FROM rs GROUP BY 1, 2, 3, 4, 5
    HAVING cs IS NOT NULL AND ce IS NOT NULL)"""


def _ranges(spark, sf):
    k = F.col("event_id")
    return I.table(spark, sf, "events").select(k, (F.col("user_id") % 100).cast("string").alias("book"), (k % 8).alias("ch"),
                                               (k % 5).cast("int").alias("si"), (k % 5 + k % 3).cast("int").alias("sj"))


@query(f"WITH {ANCHORS} SELECT event_id, book, ch, si, sj, cs, ce, s, e, exact, prefix, suffix FROM an")
def note_anchors(spark, sf):
    return N.note_anchors(_ranges(spark, sf), turn_timeline(spark, sf))


def _moved(spark, sf):
    """Anchored notes whose stored range is off by the event number modulo 3, some with a lost quote."""
    a = N.note_anchors(_ranges(spark, sf), turn_timeline(spark, sf))
    k = F.col("event_id")
    d = (k % 3).cast("int")
    return a.select("book", "ch", k.cast("string").alias("id"), (F.col("si") + d).alias("si"), (F.col("sj") + d).alias("sj"),
                    F.when(k % 10 == 9, "not in any book").when(k % 10 == 8, " ").otherwise(F.col("exact")).alias("exact"),
                    F.lit("").alias("prefix"), F.lit("").alias("suffix"))


@query(f"""WITH {ANCHORS}, mv AS (SELECT book, ch, event_id::VARCHAR AS id, (si + event_id % 3)::INTEGER AS si, (sj + event_id % 3)::INTEGER AS sj,
    CASE WHEN event_id % 10 = 9 THEN 'not in any book' WHEN event_id % 10 = 8 THEN '' ELSE exact END AS q FROM an),
  rc AS (SELECT book, ch, string_agg(t, ' ' ORDER BY i) AS recon, count(*) AS n FROM tl GROUP BY 1, 2),
  ro AS (SELECT book, ch, i, sum(length(t) + 1) OVER (PARTITION BY book, ch ORDER BY i) - length(t) - 1 AS ro FROM tl),
  nw AS (SELECT mv.book, mv.ch, mv.id, string_agg(t, ' ' ORDER BY i) AS x FROM mv JOIN tl ON tl.book = mv.book AND tl.ch = mv.ch AND i BETWEEN si AND sj GROUP BY 1, 2, 3),
  j AS (SELECT mv.*, nw.x, n, strpos(recon, q) - 1 AS idx, si >= 0 AND sj < n AND si <= sj AS ok FROM mv JOIN rc USING (book, ch) LEFT JOIN nw USING (book, ch, id)),
  k AS (SELECT j.*, ok AND (q = '' OR x = q) AS keep, (SELECT max(i) FROM ro WHERE ro.book = j.book AND ro.ch = j.ch AND ro.ro <= idx) AS fi,
    (SELECT max(i) FROM ro WHERE ro.book = j.book AND ro.ch = j.ch AND ro.ro < idx + length(q)) AS fj FROM j)
  SELECT book, ch, id, CASE WHEN keep THEN si WHEN q <> '' AND idx >= 0 THEN fi END::INTEGER AS new_si,
    CASE WHEN keep THEN sj WHEN q <> '' AND idx >= 0 THEN fj END::INTEGER AS new_sj, NOT (keep OR (q <> '' AND idx >= 0)) AS orphan FROM k""")
def reanchor(spark, sf):
    return N.reanchor(_moved(spark, sf), turn_timeline(spark, sf)).select("book", "ch", "id", "new_si", "new_sj", "orphan")


@query(f"""WITH {TURN_TL}, {RANGES}, n AS (SELECT book, ch, count(*) AS n FROM tl GROUP BY 1, 2),
  x AS (SELECT rg.book, rg.ch, event_id, ['yellow', 'green', 'blue'][event_id % 3 + 1] AS color, unnest(range(si, sj + 1)) AS i FROM rg JOIN n USING (book, ch) WHERE sj < n)
  SELECT book, ch, i::INTEGER AS i, arg_max(color, event_id) AS color FROM x GROUP BY 1, 2, 3""")
def highlight_colors(spark, sf):
    r = _ranges(spark, sf).withColumns({"seq": F.col("event_id"), "color": F.element_at(
        F.array(F.lit("yellow"), F.lit("green"), F.lit("blue")), (F.col("event_id") % 3 + 1).cast("int"))})
    n = turn_timeline(spark, sf).groupBy("book", "ch").agg(F.count("*").alias("n_sentences"))
    return N.highlight_colors(r, n)


@query(f"WITH {RANGES} SELECT event_id, book, ch, si FROM rg WHERE ch = 3")
def notes_of_chapter(spark, sf):
    return _ranges(spark, sf).filter("ch = 3").select("event_id", "book", "ch", "si")


@query(f"""WITH {TURN_TL}, b AS (SELECT event_id, (user_id % 100)::VARCHAR AS book, (event_id % 8) AS ci, value AS t FROM events),
  x AS (SELECT b.*, (SELECT max(i) FROM tl WHERE tl.book = b.book AND tl.ch = b.ci AND tl.s <= b.t) AS i FROM b)
  SELECT x.event_id, x.book, x.ci, x.t, coalesce(tl.t, '') AS snip, CASE WHEN (x.book, x.ci) IN (SELECT (book, ch) FROM tl) THEN 'Turn ' || (ci + 1) END AS ch_title
  FROM x LEFT JOIN tl ON tl.book = x.book AND tl.ch = x.ci AND tl.i = x.i""")
def bookmarks(spark, sf):
    tl = turn_timeline(spark, sf)
    ch = tl.select("book", "ch").distinct().withColumn("title", F.concat(F.lit("Turn "), (F.col("ch") + 1).cast("string")))
    m = I.table(spark, sf, "events").select("event_id", (F.col("user_id") % 100).cast("string").alias("book"),
                                            (F.col("event_id") % 8).alias("ci"), F.col("value").alias("t"))
    return N.bookmarks(m, tl, ch)


# ---- exports: event types as books, events as notes ----------------------------------------------

EXP = """nt AS (SELECT event_type AS book, event_id AS seq, (event_id % 3) AS ch, (event_id % 40) AS si, event_id AS cs, value AS s,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE props || '  ' || event_id END AS exact, CASE WHEN event_id % 3 = 0 THEN ' Body ' || event_id || chr(10) || '> x ' ELSE '' END AS note,
    CASE WHEN event_id % 2 = 0 THEN '' ELSE 'Key point ' || (event_id % 5) END AS tag FROM events),
  bo AS (SELECT DISTINCT event_type AS book, 'A: ' || event_type AS title, CASE WHEN length(event_type) > 5 THEN 'Nob ody' ELSE '' END AS author FROM events
    UNION ALL SELECT r_name, r_name, '' FROM region)"""


def _export_inputs(spark, sf):
    e, k = I.table(spark, sf, "events"), F.col("event_id")
    n = e.select(F.col("event_type").alias("book"), k.alias("seq"), (k % 3).alias("ch"), (k % 40).alias("si"), k.alias("cs"),
                 F.col("value").alias("s"), F.lit("").alias("created"),
                 F.when(k % 4 == 0, "").otherwise(F.concat("props", F.lit("  "), k.cast("string"))).alias("exact"),
                 F.when(k % 3 == 0, F.concat(F.lit(" Body "), k.cast("string"), F.lit("\n> x "))).otherwise("").alias("note"),
                 F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Key point "), (k % 5).cast("string")))).alias("tags"))
    b = e.select(F.col("event_type").alias("book")).distinct().select(
        "book", F.concat(F.lit("A: "), "book").alias("title"), F.when(F.length("book") > 5, "Nob ody").otherwise("").alias("author"))
    b = b.unionByName(I.table(spark, sf, "region").select(F.col("r_name").alias("book"), F.col("r_name").alias("title"), F.lit("").alias("author")))
    ch = b.select("book", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("ch")).withColumn("title", F.when(F.col("ch") == 0, "Intro").otherwise(""))
    return b, n, ch


_CT = "CASE ch WHEN 0 THEN 'Intro' ELSE 'Chapter ' || (ch + 1) END"
_SQ = "trim(regexp_replace(exact, '\\s+', ' ', 'g'))"
_NB = "trim(note, chr(10) || ' ')"
_TG = "CASE WHEN tag = '' THEN '' ELSE '#' || replace(tag, ' ', '-') END"
_CK = _clock("CAST(floor(s) AS BIGINT)")


_PARTS = "SELECT *, (row_number() OVER (PARTITION BY book, ch ORDER BY si, cs) - 1) // 1024 AS part FROM nt"
_HEADS = f"""SELECT DISTINCT book, ch, 0, 0, chr(10) || '## ' || {_CT} FROM nt
  UNION ALL SELECT book, 0, 0, 0, chr(10) || '_No notes yet._' FROM bo WHERE book NOT IN (SELECT book FROM nt)"""
_FRONT = """'---' || chr(10) || 'title: ' || CASE WHEN title LIKE '%:%' THEN '"' || title || '"' ELSE title END || chr(10) || CASE WHEN author <> '' THEN 'author: ' || author || chr(10) ELSE '' END ||
    'date: 2030-01-01' || chr(10) || """


@query(f"""WITH {EXP} SELECT book, -1::BIGINT AS ch, 0 AS kind, 0::BIGINT AS part, {_FRONT} 'tags: [audiobook, notes]' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || ' — Notes' ||
    CASE WHEN author <> '' THEN chr(10) || chr(10) || '*by ' || author || '*' ELSE '' END AS text FROM bo
  UNION ALL {_HEADS}
  UNION ALL SELECT book, ch, 1, part, string_agg(chr(10) || CASE WHEN exact <> '' THEN '> ' || {_SQ} || chr(10) || chr(10) ELSE '' END || '*[' || ({_CK}) || ']*' ||
    CASE WHEN tag <> '' THEN '  ' || {_TG} ELSE '' END || CASE WHEN note <> '' THEN chr(10) || chr(10) || '**Note:** ' || {_NB} ELSE '' END, chr(10) ORDER BY si, cs) FROM ({_PARTS}) GROUP BY 1, 2, 4""")
def notes_markdown(spark, sf):
    return export.notes_markdown(*_export_inputs(spark, sf), now())


@query(f"""WITH {EXP}, tg AS (SELECT book, tag, row_number() OVER (PARTITION BY book ORDER BY seq) - 1 AS k FROM
    (SELECT book, replace(tag, ' ', '-') AS tag, min(seq) AS seq FROM nt WHERE tag <> '' GROUP BY 1, 2))
  SELECT book, -1::BIGINT AS ch, 0 AS kind, 0::BIGINT AS part, {_FRONT} 'source: x' || chr(10) || 'book_id: ' || book || chr(10) || 'tags:' || chr(10) || '  - audiobook' || chr(10) || '  - notes' AS text FROM bo
  UNION ALL SELECT book, -1, 1, k, '  - ' || tag FROM tg UNION ALL SELECT book, -1, 2, 0, '---' || chr(10) || chr(10) || '# ' || title FROM bo
  UNION ALL {_HEADS}
  UNION ALL SELECT book, ch, 1, part, string_agg(chr(10) || '> [!quote] ' || {_CT} || ' — [' || ({_CK}) || ']' || CASE WHEN exact <> '' THEN chr(10) || '> ' || {_SQ} ELSE '' END ||
    CASE WHEN note <> '' OR tag <> '' THEN chr(10) || '>' ELSE '' END || CASE WHEN note <> '' THEN chr(10) || '> ' || replace({_NB}, chr(10), chr(10) || '> ') ELSE '' END ||
    CASE WHEN tag <> '' THEN chr(10) || '> ' || {_TG} ELSE '' END || chr(10) || '^ch' || (ch + 1) || '-s' || si, chr(10) ORDER BY si, cs) FROM ({_PARTS}) GROUP BY 1, 2, 4""")
def notes_obsidian(spark, sf):
    return export.notes_obsidian(*_export_inputs(spark, sf), now(), "x")
