"""Annotations: validation, merging, anchoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bookflow.functions.arrays import let
from bookflow.functions.text import norm_tags, occurrences, slug_tag, squash, strip
from bookflow.functions.times import as_float, as_int
from bookflow.operators import scan
from bookflow.operators.lookup import asof_scan, substring_join
from bookflow.settings import (BLOCK, COLORS, KINDS, MAX_CONTEXT, MAX_EXACT, MAX_NOTE, NOTE_FIELDS,
                               stage)

READING_ORDER = ["ch", "si", "cs", "created"]
PLAYER_ORDER = ["ch", "si", "s"]


# ---- validation ------------------------------------------------------------------------------

def _kind(kind: Column, note: Column) -> Column:
    derived = F.when(strip(F.coalesce(note, F.lit(""))) != "", "note").otherwise("highlight")
    return F.when(kind.isin(*KINDS), kind).otherwise(derived)


def _color(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit(COLORS[0])))
    return F.when(low.isin(*COLORS), low).otherwise(COLORS[0])


def _cut(c: str, n: int) -> Column:
    return F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)


def coerce_notes(raw: DataFrame, n_chapters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean notes and rejected ones (chapter out of range).

    Bad numbers become 0, swapped sentence ranges are put right, texts and tags are cut to
    their bounds, unknown colours become the first one, the kind follows from the body.
    """
    si = F.greatest(F.lit(0), as_int("si"))
    sj = F.greatest(F.lit(0), F.when(F.col("sj").isNull(), as_int("si")).otherwise(as_int("sj")))
    d = raw.withColumns({
        "ch": as_int("ch"), "_si": F.least(si, sj), "_sj": F.greatest(si, sj),
        "cs": as_int("cs"), "ce": as_int("ce"), "s": as_float("s"), "e": as_float("e"),
        "exact": _cut("exact", MAX_EXACT), "prefix": _cut("prefix", MAX_CONTEXT),
        "suffix": _cut("suffix", MAX_CONTEXT), "color": _color(F.col("color")),
        "tags": norm_tags(F.coalesce("tags", F.array().cast("array<string>"))),
        "kind": _kind(F.col("kind"), _cut("note", MAX_NOTE)), "note": _cut("note", MAX_NOTE),
    }).withColumns({"si": F.col("_si"), "sj": F.col("_sj")}).drop("_si", "_sj")
    if n_chapters is None:
        return d, d.filter(F.lit(False))
    d = d.join(n_chapters.select("book", F.col("n").alias("_n")), "book", "left")
    ok = F.coalesce(F.col("ch").between(0, F.col("_n") - 1), F.lit(False))
    return d.filter(ok).drop("_n"), d.filter(~ok).drop("_n")


def clean_note(df: DataFrame) -> DataFrame:
    """The durable fields only."""
    return df.select(*[c for c in df.columns if c == "book" or c in NOTE_FIELDS])


def create_notes(raw: DataFrame, n_chapters: DataFrame, now: Column) -> DataFrame:
    """New notes: validated, with an id from all their fields (``seq`` among them, if the input numbers its rows)
    and equal created/updated stamps."""
    good, _ = coerce_notes(raw, n_chapters)
    stamp = utc_stamp(now)
    told = [c for c in good.columns if c not in ("id", "created", "updated")]
    key = F.substring(F.sha2(F.concat(F.to_json(F.struct(*told)), stamp), 256), 1, 32)
    return good.withColumns({"id": key, "created": stamp, "updated": stamp})


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def patch_notes(notes: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Overwrite only the fields present (non-null) in the patch; created stays.

    The kind is the patch's if valid, else it follows from the merged body. Several patches of one note
    count field by field: the last one that has the field, by ``seq`` if the patches have it.
    """
    fields = [c for c in ("ch", "si", "sj", "cs", "ce", "s", "e", "exact", "prefix", "suffix", "color",
                          "tags", "note") if c in patches.columns]
    order = F.col("seq") if "seq" in patches.columns else F.monotonically_increasing_id()
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at")))
    p = patches.withColumn("_at", order).groupBy("book", "id").agg(
        F.lit(True).alias("_hit"), (last("kind") if "kind" in patches.columns else F.lit(None).cast("string")).alias("_kind"),
        *[last(c).alias(f"_p_{c}") for c in fields])
    d = notes.join(p, ["book", "id"], "left")
    merged = d.withColumns({c: F.coalesce(f"_p_{c}", c) for c in fields})
    patched, _ = coerce_notes(merged.withColumn("kind", F.when(F.col("_hit"), F.col("_kind")).otherwise(
        F.col("kind"))))
    return patched.withColumn("updated", F.when(F.col("_hit"), utc_stamp(now)).otherwise(
        F.col("updated"))).select(notes.columns)


def delete_notes(notes: DataFrame, gone: DataFrame) -> DataFrame:
    return notes.join(gone.select("book", "id"), ["book", "id"], "left_anti")


def tombstones(gone: DataFrame, now: Column) -> DataFrame:
    """Soft deletes: they win by their stamp and spread like any other change."""
    return gone.select("book", "id", F.lit(True).alias("deleted"), utc_stamp(now).alias("updated"))


# ---- merging ---------------------------------------------------------------------------------

def _newest(df: DataFrame, stamp: Column) -> DataFrame:
    """Latest record per (book, id); of equal stamps the later side, then the later position.

    ``max_by`` combines before the shuffle: many copies of one note cost one row per task.
    """
    keep = [c for c in df.columns if c not in ("book", "id")]
    best = F.max_by(F.struct(*keep), F.struct(stamp.alias("u"), "_side", "_seq"))
    return df.filter(F.col("id") != "").groupBy("book", "id").agg(best.alias("w")).select(
        "book", "id", "w.*")


def _sided(df: DataFrame, side: int) -> DataFrame:
    seq = F.col("seq") if "seq" in df.columns else F.lit(0)
    return df.withColumns({"_side": F.lit(side), "_seq": seq.cast("long")}).drop("seq")


def merge_lww(local: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Last write wins; incoming records win ties and are validated; no tombstones here."""
    clean, _ = coerce_notes(incoming)
    u = _sided(local, 0).unionByName(_sided(clean, 1), allowMissingColumns=True)
    firsts = local.groupBy("book", "id").agg(F.max("created").alias("_c0"))
    w = _newest(u, F.coalesce("updated", F.lit("")))
    stamp = utc_stamp(now)
    return w.join(firsts, ["book", "id"], "left").withColumns({
        "created": F.coalesce(F.nullif("created", F.lit("")), "_c0", stamp),
        "updated": F.coalesce(F.nullif("updated", F.lit("")), stamp)}).drop("_c0", "_side", "_seq")


def merge_with_tombstones(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live notes and dead ids; the stamp falls back to ``created``, ``b`` wins ties."""
    u = _sided(a, 0).unionByName(_sided(b, 1), allowMissingColumns=True)
    stamp = F.coalesce(F.nullif("updated", F.lit("")), "created", F.lit(""))
    w = _newest(u, stamp).drop("_side", "_seq")
    dead = F.coalesce("deleted", F.lit(False))
    return w.filter(~dead).drop("deleted"), w.filter(dead).select("book", "id")


def _stamp() -> Column:
    """An empty stamp is none."""
    return F.coalesce(F.nullif("updated", F.lit("")), "created", F.lit(""))


def unpushed(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local notes that are missing remotely or older there."""
    r = remote.select("book", "id", _stamp().alias("_r"))
    mine = _stamp()
    return local.join(r, ["book", "id"], "left").filter(
        F.col("_r").isNull() | (F.col("_r") < mine)).drop("_r")


def changed_books(a: DataFrame, b: DataFrame) -> DataFrame:
    """Books whose set of (id, stamp) differs between two note sets."""
    s = lambda d, n: d.select("book", "id", _stamp().alias(n))
    d = s(a, "_a").join(s(b, "_b"), ["book", "id"], "full")
    return d.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("book").distinct()


def tag_list(notes: DataFrame) -> DataFrame:
    """Distinct tag slugs per book, ignoring case; first spelling in note order wins."""
    t = notes.select("book", "seq", F.posexplode("tags").alias("pos", "tag"))
    t = t.select("book", F.struct("seq", "pos").alias("at"), slug_tag("tag").alias("slug"))
    g = t.groupBy("book", F.lower("slug").alias("_k")).agg(F.min_by("slug", "at").alias("slug"),
                                                           F.min("at").alias("at"))
    return g.select("book", "slug", "at")


def dedup_requests(requests: DataFrame, key: Column, done: DataFrame | None = None) -> DataFrame:
    """One run per content key: the first request starts it, and again after an error.

    ``requests(seq, status)``; keys in ``done`` are served from the cache and never run.
    """
    d = requests.withColumn("key", key)
    if done is not None:
        d = d.join(done.select("key"), "key", "left_anti")
    # Only the first usable request of a key runs; combined before the shuffle.
    ok = F.coalesce("status", F.lit("running")) != "error"
    cols = [c for c in d.columns if c != "key"]
    first = F.min_by(F.struct(*cols), F.struct((~ok).alias("bad"), F.col("seq")))
    return d.groupBy("key").agg(first.alias("r"), F.count("*").alias("n_requests")).select(
        "key", "r.*", "n_requests")


# ---- anchoring -------------------------------------------------------------------------------

def note_anchors(ranges: DataFrame, tl: DataFrame) -> DataFrame:
    """Anchor fields of sentence ranges: quote, offsets, times and 32 characters of context."""
    d = ranges.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), F.col("si") - 3), F.col("sj") + 3)))
    d = d.join(tl.select("book", "ch", F.col("i").cast("int").alias("i"), "t", "cs", "ce", "s", "e"),
               ["book", "ch", "i"])

    def text(cond):
        got = F.array_sort(F.collect_list(F.when(cond, F.struct("i", "t"))))
        return F.array_join(F.transform(got, lambda x: x["t"]), " ")

    at = lambda c, i: F.max(F.when(F.col("i") == F.col(i), F.col(c))).alias(c)
    keys = ranges.columns
    g = d.groupBy(*keys).agg(at("cs", "si"), at("ce", "sj"), at("s", "si"), at("e", "sj"),
                             text(F.col("i").between(F.col("si"), F.col("sj"))).alias("exact"),
                             text(F.col("i") < F.col("si")).alias("_pre"),
                             text(F.col("i") > F.col("sj")).alias("_suf"))
    tail = F.substring(F.col("_pre"), F.greatest(F.lit(1), F.length("_pre") - 31), F.lit(32))
    # A range that leaves the chapter has no end sentence and gives no anchor.
    return g.filter("cs IS NOT NULL AND ce IS NOT NULL").withColumns(
        {"prefix": tail, "suffix": F.substring("_suf", 1, 32)}).drop("_pre", "_suf")


LEVELS = 40                                   # of ranges that halve; a chapter has fewer than 2^39 sentences


def _halves(lo: Column, hi: Column) -> Column:
    """A range as the few aligned ranges of 2^level places (level, place) that make it up; at most two of each level."""
    piece = "array<struct<level:int,place:bigint>>"

    def step(s: Column, level: Column) -> Column:
        a, b, on = s["a"], s["b"], s["a"] <= s["b"]
        left, right = on & (a % 2 == 1), on & (b % 2 == 0)
        one = lambda hit, at: F.when(hit, F.array(F.struct(level.alias("level"), at.alias("place")))).otherwise(F.array().cast(piece))
        # A range of one place is taken from one side only.
        right = right & ~(left & (a == b))
        up = lambda x: F.when(on, F.shiftright(x, 1)).otherwise(x)
        return F.struct(up(a + F.when(left, 1).otherwise(0)).alias("a"), up(b - F.when(right, 1).otherwise(0)).alias("b"),
                        F.concat(s["out"], one(left, a), one(right, b)).alias("out"))

    start = F.struct(lo.cast("bigint").alias("a"), hi.cast("bigint").alias("b"), F.array().cast(piece).alias("out"))
    done = lambda s: s["out"]
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, done)


def highlight_runs(notes: DataFrame, n_sentences: DataFrame) -> DataFrame:
    """``(book, ch, from, to, color)``: runs of sentences with one colour; where notes overlap the last in list order wins.

    A note costs two bounds and a few aligned ranges however long it is. The latest note of every aligned range is found by an
    aggregate; between two neighbouring bounds the colour is that of the latest range above the first of them. No chapter is swept by one task.
    """
    d = notes.join(n_sentences, ["book", "ch"]).filter(
        (F.col("si") >= 0) & (F.col("sj") < F.col("n_sentences")) & (F.col("si") <= F.col("sj")))
    d = stage(d.select("book", "ch", "seq", "color", "si", "sj"), "highlights")
    top = d.select("book", "ch", "seq", "color", F.explode(_halves(F.col("si"), F.col("sj"))).alias("x")).groupBy(
        "book", "ch", "x.level", "x.place").agg(F.max(F.struct("seq", "color")).alias("top"))
    bounds = d.select("book", "ch", F.explode(F.array(F.col("si").cast("bigint"), F.col("sj").cast("bigint") + 1)).alias("from")).distinct()
    runs = scan.next_value(bounds, ["book", "ch"], ["from"], F.floor(F.col("from") / BLOCK), to=F.col("from") - 1).where("to IS NOT NULL")
    up = runs.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("place", F.expr("shiftright(from, level)"))
    found = up.join(top, ["book", "ch", "level", "place"]).groupBy("book", "ch", "from", "to").agg(F.max("top").alias("top"))
    return found.select("book", "ch", "from", "to", "top.color")


def highlight_colors(notes: DataFrame, n_sentences: DataFrame) -> DataFrame:
    """The runs as one row for each sentence."""
    d = highlight_runs(notes, n_sentences).withColumn("i", F.explode(F.sequence("from", "to")))
    return d.select("book", "ch", F.col("i").cast("int").alias("i"), "color")


SPAN = 4096                                   # characters per block of chapter text, at least
_AROUND = MAX_CONTEXT + 8                     # context on either side of a hit


def _chapter_blocks(sents: DataFrame) -> DataFrame:
    """Chapter text (sentences joined by a blank) in blocks with an overlap on both sides.

    ``_span`` is the chapter's block size: at least SPAN, and no less than the longest quote that is
    searched there. So a hit that starts in a block ends in the next at the latest, and all blocks of a chapter
    hold its text twice. ``at`` is the offset of ``text`` in the chapter.
    """
    span = F.col("_span")
    d = sents.select("book", "ch", "_span", "_ro", F.concat("t", F.lit(" ")).alias("_t"))
    cut = d.select("book", "ch", "_span", "_ro", "_t", F.explode(F.sequence(
        F.floor(F.col("_ro") / span), F.floor((F.col("_ro") + F.length("_t") - 1) / span))).alias("blk"))
    frm = F.greatest(F.lit(0), F.col("blk") * span - F.col("_ro"))
    to = F.least(F.length("_t"), (F.col("blk") + 1) * span - F.col("_ro"))
    cut = cut.select("book", "ch", "_span", "blk", (F.col("_ro") + frm).alias("pos"),
                     F.substring(F.col("_t"), (frm + 1).cast("int"), (to - frm).cast("int")).alias("x"))

    def glue(df):
        return df.groupBy("book", "ch", "_span", "blk").agg(
            F.min("pos").alias("at"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))),
                                     lambda v: v["x"]), "").alias("text"))

    own = glue(cut)
    before = own.select("book", "ch", "_span", (F.col("blk") + 1).alias("blk"),
                        (F.col("at") + F.greatest(F.lit(0), F.length("text") - _AROUND)).alias("pos"),
                        F.substring("text", -_AROUND, _AROUND).alias("x"))
    after = own.select("book", "ch", "_span", (F.col("blk") - 1).alias("blk"), F.col("at").alias("pos"),
                       F.col("text").alias("x"))
    # The context of a hit that reaches the end of the next block is at the start of the one after it.
    beyond = own.select("book", "ch", "_span", (F.col("blk") - 2).alias("blk"), F.col("at").alias("pos"),
                        F.substring("text", 1, _AROUND).alias("x"))
    me = own.select("book", "ch", "_span", "blk", F.col("at").alias("pos"), F.col("text").alias("x"))
    # Neighbours of blocks that do not exist themselves make rows without own positions.
    return glue(me.unionByName(before).unionByName(after).unionByName(beyond))


def reanchor(notes: DataFrame, tl: DataFrame) -> DataFrame:
    """Where each note lies in the current text: ``(…, new_si, new_sj, orphan)``.

    The stored range if its text is unchanged; else the quote is searched, a repeated quote is
    told apart by its context, the first hit is the fallback; no hit makes an orphan.
    """
    n = notes.withColumn("_nid", F.struct("book", "id")).withColumn("_q", strip(F.coalesce("exact", F.lit(""))))
    size = tl.groupBy("book", "ch").agg(F.count("*").alias("_n"))
    n = n.join(size, ["book", "ch"], "left").withColumn(
        "_in", F.coalesce((F.col("si") >= 0) & (F.col("sj") < F.col("_n")) & (F.col("si") <= F.col("sj")),
                          F.lit(False)))
    # Unchanged?  A range of more sentences than the quote has characters cannot spell it.
    probe = n.filter("_in AND _q <> ''").filter(F.col("sj") - F.col("si") <= F.length("_q"))
    probe = probe.select("book", "ch", "id", "_q", F.explode(F.sequence("si", "sj")).alias("i"))
    same = (probe.join(tl.select("book", "ch", F.col("i").cast("int").alias("i"), "t"), ["book", "ch", "i"])
            .groupBy("book", "id", "_q").agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), " ").alias("_now"))
            .filter("_now = _q").select("book", "id", F.lit(True).alias("_same")))
    n = stage(n.join(same, ["book", "id"], "left"), "note_ranges")
    kept = F.coalesce("_same", F.lit(False)) | ((F.col("_q") == "") & F.col("_in"))
    lost = n.filter(~kept & (F.col("_q") != "")).select("book", "ch", "id", "_q", "prefix", "suffix")

    sents = scan.prefix_sum(tl.select("book", "ch", "i", "t"), ["book", "ch"], ["i"],
                            F.floor(F.col("i") / BLOCK), _ro=(F.length("t") + 1).cast("long"))
    sents = stage(sents, "sentence_offsets")
    longest = lost.groupBy("book", "ch").agg(F.greatest(F.lit(SPAN), F.max(F.length("_q"))).cast("long").alias("_span"))
    todo = sents.join(longest, ["book", "ch"])
    hits = substring_join(stage(_chapter_blocks(todo), "chapter_blocks"), lost, "text", "_q", ["blk"], ["book", "ch"],
                          carry=["text", "at", "_span"])
    own_from, own_to = F.col("blk") * F.col("_span") - F.col("at"), (F.col("blk") + 1) * F.col("_span") - F.col("at")
    # Hits that start in the block itself; hits in the overlap belong to the neighbour.
    spots = F.filter(occurrences("text", "_q"), lambda p: (p >= own_from) & (p < own_to))

    def best_of(v):
        """The hit whose context fits, else the first: (context differs, place); the context is only cut where there is one."""
        pre, suf, size = v["pre"], v["suf"], F.length("_q")

        def placed(p):
            left, end = F.greatest(F.lit(0), p - F.length(pre) - 4), p + size
            before = F.when(pre == "", True).otherwise(squash(F.substring(F.col("text"), left + 1, p - left)).endswith(pre))
            after = F.when(suf == "", True).otherwise(squash(F.substring(F.col("text"), end + 1, F.length(suf) + 4)).startswith(suf))
            return F.struct((~(before & after)).alias("bad"), (F.col("at") + p).alias("pos"))
        # A note without context takes the first hit.
        return F.when((pre == "") & (suf == ""), F.struct(F.lit(False).alias("bad"), (F.col("at") + F.array_min(v["spots"])).alias("pos"))).otherwise(
            F.array_min(F.transform(v["spots"], placed)))

    once = F.struct(squash("prefix").alias("pre"), squash("suffix").alias("suf"), spots.alias("spots"))
    # The best hit of a block is chosen in its row: a quote of one letter costs a row for each block, not a copy of the block for each hit.
    best = hits.withColumn("_h", let(once, best_of)).where("_h.pos IS NOT NULL").groupBy(
        "book", "ch", "id", F.length("_q").alias("_len")).agg(F.min("_h").alias("h"))
    best = best.select("book", "ch", "id", F.col("h.pos").alias("_a"),
                       (F.col("h.pos") + F.col("_len") - 1).alias("_b"))
    best = stage(best, "note_hits")
    starts = sents.select("book", "ch", "_ro", F.col("i").cast("int").alias("_i"))
    a = asof_scan(best, starts, ["book", "ch"], "_a", "_ro", ["_i"], 1 << 16).withColumnRenamed("_i", "_fi")
    b = asof_scan(a, starts, ["book", "ch"], "_b", "_ro", ["_i"], 1 << 16).withColumnRenamed("_i", "_fj")
    d = n.join(b.select("book", "id", "_fi", "_fj"), ["book", "id"], "left")
    return d.withColumns({
        "new_si": F.when(kept, F.col("si")).otherwise(F.col("_fi")),
        "new_sj": F.when(kept, F.col("sj")).otherwise(F.col("_fj"))}).withColumn(
        "orphan", F.col("new_si").isNull()).drop("_nid", "_q", "_n", "_in", "_same", "_fi", "_fj")


def bookmarks(marks: DataFrame, tl: DataFrame, chapters: DataFrame) -> DataFrame:
    """Bookmarks in (ci, t) order per book, labelled with chapter title and active sentence."""
    from bookflow.operators.lookup import asof_grid
    d = asof_grid(marks.withColumn("ch", F.col("ci")), tl, ["book", "ch"], "t", "s", "i")
    text = tl.select("book", "ch", F.col("i").cast("int").alias("i"), F.col("t").alias("snip"))
    d = d.join(text, ["book", "ch", "i"], "left").join(
        chapters.select("book", "ch", F.col("title").alias("ch_title")), ["book", "ch"], "left")
    return d.withColumn("snip", F.coalesce("snip", F.lit(""))).drop("ch", "i").orderBy("book", "ci", "t")
