"""Golden values and properties on small fixtures."""

import json
import re

import pytest
from pyspark.sql import functions as F

from bookflow.functions import text as T
from bookflow.functions import times as X
from bookflow.operators import catalog, clean, export, notes, segment, structure, timeline
from bookflow.sources import files, manifests
from bookflow.sources.html import html_to_text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_scalars(spark):
    cases = [
        (T.normalize_unicode(F.lit("ﬁne “q” – … ª")), 'fine "q" - ... a'),
        (T.dehyphenate(F.lit("exam-\nple soft­\nly a- \nb")), "example softly a- \nb"),
        (T.fix_letter_spacing(F.lit("T H E cat is a b. (X Y Z)")), "THE cat is a b. (XYZ)"),
        (T.slugify(F.lit("  Ünï & Code!! ")), "n-code"), (T.slugify(F.lit("???")), "book"),
        (T.match_key(F.lit("Chapter IV: The  End!")), "the end"),
        (T.word_count(F.lit("é été ab_1 -")), 3), (T.token_count(F.lit(" a  b\tc ")), 3),
        (T.is_page_number(F.lit("xiv")), True), (T.is_page_number(F.lit("page 3")), False),
        (T.is_decorative(F.lit("* * *")), True), (T.escape_markup(F.lit('a"b'), "attr"), "'a\"b'"),
        (T.normalize_url(F.lit(" host:8000/ ")), "http://host:8000"), (T.normalize_url(F.lit("  ")), None),
        (X.fmt_ts(F.lit(3725.0125), ","), "01:02:05,012"), (X.fmt_ts(F.lit(float("nan")), "."), "00:00:00.000"),
        (X.fmt_clock(F.lit(65.9)), "1:05"), (X.fmt_clock(F.lit(3725.0)), "1:02:05"), (X.fmt_dur(F.lit(59.6)), "1:00"),
        (X.fmt_hm(F.lit(6780.0)), "1h 53m"), (X.fmt_hm(F.lit(2700.0)), "45m"), (X.fmt_hm(F.lit(7200.0)), "2h"),
        (X.est_duration(F.lit("Hi.")), 0.35), (X.card_percent(F.lit(0.001), F.lit("ready")), 2),
        (T.book_title(F.lit(" "), F.lit("/x/my_book.v2.pdf")), "my book.v2"),
        (T.snippet(F.lit("x" * 40 + "Needle<" + "y" * 80), F.lit("needle")),
         "…" + "x" * 30 + "<mark>Needle</mark>&lt;" + "y" * 49 + "…"),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [row[i] for i in range(len(cases))] == [w for _, w in cases]


def test_tags(spark):
    assert one(spark, T.norm_tags(T.split_tags(F.lit("#a, A\nb")))) == ["a", "b"]
    many = one(spark, T.norm_tags(F.array(*[F.lit(f"t{i}") for i in range(25)])))
    assert len(many) == 20
    assert one(spark, T.norm_tags(F.array(F.lit("#" + "x" * 50)))) == ["x" * 40]


def test_rules(spark):
    rules = T.compile_rules([{"from": "GPT-4", "to": "G P T four"}, {"from": "GPT", "to": "$1 \\"},
                             {"from": r"(\w+)@", "to": r"\1 at ", "regex": True}, {"from": "(", "to": "x", "regex": True}])
    assert one(spark, T.apply_rules(F.lit("GPT-4 gpt GPTs me@x"), rules)) == "G P T four $1 \\ GPTs me at x"


def test_cleaning(spark):
    raw = "Head\nIt was exam-\nple “text”\n12\ngoes on.\n\n* * *\nNew  para\nHead"
    pages = spark.createDataFrame([("b", 0, raw), ("b", 1, "Head\nyes\n"), ("b", 2, "Head"), ("b", 3, "  \n"), ("b", 4, "")],
                                  "book string, page long, raw string")
    run = {(r.line, r.n) for r in clean.running_lines(pages).collect()}
    assert run == {("Head", 5)}                      # a one-line page counts its line twice
    got = {r.page: r.text for r in clean.clean_pages(pages, clean.running_lines(pages)).collect()}
    assert got == {0: 'It was example "text" goes on.\n\n* * * New para', 1: "yes", 2: "", 3: "", 4: ""}


def test_profile_cleaning(spark):
    raw = "The Book\nT H E start site.com\nsite.com\n. . .\nCHAPTER 1\n7\nbody\n\nend"
    pages = spark.createDataFrame([("b", 0, raw)], "book string, page long, raw string")
    lines = spark.createDataFrame([("b", 0, 20, "THE book"), ("b", 0, 500, "body")], "book string, page long, y int, text string")
    prof = spark.createDataFrame([("b", (["([", "^CHAPTER"], ["site.com"], True, True, None, 50, None), (None,))],
                                 "book string, cleaning struct<drop_line_patterns:array<string>,drop_substrings:array<string>,"
                                 "fix_letter_spacing:boolean,drop_decorative:boolean,strip_page_numbers:boolean,"
                                 "header_zone_max_y:int,footer_zone_min_y:int>, heading_labels struct<patterns:array<string>>")
    assert clean.clean_pages_profile(pages, prof, lines).first().text == "THE start body\n\nend"


SENT = re.compile(r"[^.!?]+(?:[.!?]+[\"')\]]*|\Z)")


def brute_sentences(text):
    out = []
    for par in re.finditer(r"[^\n]+(?:\n(?!\n)[^\n]+)*", text):
        for m in SENT.finditer(par.group()):
            s = m.group().strip()
            if s:
                at = par.start() + m.start() + len(m.group()) - len(m.group().lstrip())
                out.append((at, at + len(s), s))
    return out


def test_sentence_offsets(spark):
    texts = ["", "...", "A. B? C!", '"Hi." he said.. Then', "One\ntwo. Three\n\n?Four.) x\n\n\n\nfive", " \n\n a.b \n.c\n\n",
             "x" * 10 + ". " * 700 + "end", "Wait... what?! (Yes.) 'No.' é. Ünï!"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    for r in df.select("n", "text", segment.sentence_spans("text").alias("s")).collect():
        assert [(x.cs, x.ce, x.t) for x in r.s] == brute_sentences(r.text)
        for i, x in enumerate(r.s):
            nxt = r.s[i + 1].cs if i + 1 < len(r.s) else None
            assert r.text[x.cs:x.ce] == x.t
            assert x.p == (nxt is None or "\n\n" in r.text[x.ce:nxt])


def test_settle_golden(spark):
    tl = spark.createDataFrame([("b", 0, 0, 0.31, 2.5), ("b", 0, 1, 2.74, 5.0), ("b", 0, 2, 5.9, 8.0), ("b", 0, 3, 8.0, 8.0)],
                               "book string, ch int, i int, s double, e double")
    topics = spark.createDataFrame([("b", 0, "t", 2.74), ("b", 0, "u", None)], "book string, ch int, title string, time double")
    books = spark.createDataFrame([("b", None)], "book string, timing_version int")
    b, t, tp = timeline.upgrade_timings(books, tl, topics)
    assert [r.s for r in t.orderBy("i").collect()] == [0.155, 2.62, 5.65, 8.0]
    assert {r.title: r.time for r in tp.collect()} == {"t": 2.62, "u": None}
    b2, t2, _ = timeline.upgrade_timings(b, t, tp)          # a second run changes nothing
    assert [r.s for r in t2.orderBy("i").collect()] == [0.155, 2.62, 5.65, 8.0]


def test_align_zero_width(spark):
    words = spark.createDataFrame([("b", 0, 0, 0, 0.1, 0.5), ("b", 0, 0, 1, 0.6, 0.9), ("b", 0, 2, 0, 1.0, 0.8)],
                                  "book string, ch int, si int, w int, start double, end double")
    s = spark.createDataFrame([("b", 0, i) for i in range(3)], "book string, ch int, si int")
    got = {r.si: (r.s, r.e) for r in timeline.align_spans(words, s).collect()}
    assert got == {0: (0.1, 0.9), 1: (0.9, 0.9), 2: (1.0, 1.0)}


def test_heading_cut(spark):
    pats = F.array(F.lit(r"^CHAPTER \d+$"))
    cut = lambda text, title, p=pats: structure.heading_cut(F.lit(text), F.lit(title), p)
    none = F.array().cast("array<string>")
    cases = [("CHAPTER 1\n\nONE\n\nbody", "One", 16), ("Title\n\nTitle body", "Title", 13), ("body only", "Other", 0),
             ("FERRIES , BARGES , AND HARBOURS n the day", "A Port", 32), ("NASA AND ESA agree", "A Port", 0)]
    row = spark.range(1).select(*[cut(a, b).alias(f"c{i}") for i, (a, b, _) in enumerate(cases)],
                                cut("Same\n\nx", "", none).alias("z")).first()
    assert list(row) == [c for _, _, c in cases] + [0]


def test_html(spark):
    page = ("<html><head><title>x</title></head><body><nav>n</nav><p>A &amp;lt; b&copy;<script>var t='</p>';</script></p>"
            "<!-- c --><div>D<br>E&nbsp;&eacute;</div>tail</body></html>")
    assert one(spark, html_to_text(F.lit(page))) == "A &lt; b©\n\nD\n\nE é\n\ntail"


def _manifest():
    return {"id": "the-light", "title": "The Light", "timing_version": 2, "chapters": [
        {"id": "ch0000", "index": 0, "title": "One", "duration": 12.5, "topics": [{"title": "T", "time": 5.0}],
         "sentences": [{"i": 0, "t": "a", "s": 0.0, "e": 2.0, "p": 1}, {"i": 1, "t": "b", "s": 2.0, "e": 5.0}]}]}


def test_readers(spark, tmp_path):
    for name, text in (("a", json.dumps(_manifest(), indent=1)), ("bad", '{"id": "x", "chap'), ("c", '{"created": "2024"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    (tmp_path / "a" / "notes.json").write_text('{"book": "the-light", "notes": [{"id": "n1", "ch": 0, "si": "2"}, {"id": "n2"}]}')
    (tmp_path / "c" / "notes.json").write_text('[{"id": "n3", "ch": 1}]')
    (tmp_path / "bad" / "notes.json").write_text("17")
    m = manifests.read_manifests(spark, str(tmp_path))
    assert {r.id: r.title for r in m.collect()} == {"the-light": "The Light", "c": "c"}
    ch = manifests.manifest_chapters(m).collect()
    assert [(c.book, c.ch, c.status, c.duration) for c in ch] == [("the-light", 0, "ready", 12.5)]
    assert manifests.manifest_topics(m).first().level == 2
    assert [(s.i, s.p) for s in manifests.manifest_sentences(m).orderBy("i").collect()] == [(0, 1), (1, 0)]
    s = {r.id: (r.n_chapters, r.chapters_ready, r.status) for r in catalog.library_summary(m).collect()}
    assert s == {"the-light": (1, 1, "ready"), "c": (0, 0, "ready")}
    n = files.read_notes(spark, str(tmp_path))
    assert {(r.book, r.id) for r in n.collect()} == {("the-light", "n1"), ("the-light", "n2"), ("c", "n3")}
    (tmp_path / "B.EPUB").write_text("12345")
    (tmp_path / "a.pdf").write_text("1")
    (tmp_path / "x.txt").write_text("1")
    got = [(r.name, r.length) for r in files.scan_inbox(spark, str(tmp_path)).collect()]
    assert got == [("B.EPUB", 5), ("a.pdf", 1)]
    (tmp_path / "rules.json").write_text('// c\n[{"from": "Dr\\\\.", "to": "Doctor", "regex": true},\n  # x\n {"from": ""}]')
    r = files.read_rules(spark, str(tmp_path / "rules.json")).collect()
    assert [(x["from"], x.to, x.regex, x.whole_word) for x in r] == [("Dr\\.", "Doctor", True, True)]


def _doc(parts, sep):
    rows = sorted(parts.collect(), key=lambda r: (r.ch, r.kind, r.part))
    return sep.join(r.text for r in rows)


def test_manifest_parts_make_one_document(spark):
    b = spark.createDataFrame([("b", 'T "q"', "A")], "book string, title string, author string")
    c = spark.createDataFrame([("b", 0, "One", 1, 0, "ready", "ch0.mp3", 2.5), ("b", 1, "Two", 1, 3, "pending", None, 1.5)],
                              "book string, ch long, title string, level int, page int, status string, audio string, duration double")
    s = spark.createDataFrame([("b", 0, i, f"s\\{i}", i * 1.0, i + 1.0, i, i + 1, i % 2) for i in range(1500)],
                              "book string, ch long, i int, t string, s double, e double, cs int, ce int, p int")
    t = spark.createDataFrame([("b", 0, 0, "x", 2, None)], "book string, ch long, pos int, title string, level int, time double")
    d = json.loads(_doc(export.build_manifest(b, c, s, t), ""))
    assert (d["id"], d["title"], d["status"], d["chapters_total"], d["chapters_ready"], d["total_duration"], d["timing_version"]) == (
        "b", 'T "q"', "partial", 2, 1, 2.5, 2)
    assert [x["start_global"] for x in d["chapters"]] == [0.0, 2.5]
    assert [x["i"] for x in d["chapters"][0]["sentences"]] == list(range(1500))
    assert d["chapters"][0]["sentences"][1] == {"i": 1, "t": "s\\1", "s": 1.0, "e": 2.0, "cs": 1, "ce": 2, "p": 1}
    assert "p" not in d["chapters"][0]["sentences"][0] and d["chapters"][1]["sentences"] == []
    assert d["chapters"][0]["topics"] == [{"title": "x", "level": 2, "time": None}]


def test_note_exports(spark):
    cols = ("book string, seq long, ch long, si long, cs long, s double, created string, exact string, note string, tags array<string>")
    n = spark.createDataFrame([("demo", 0, 0, 2, 1, 65.0, "", "q", "Multi\n> line", ["idea", "key point"]),
                               ("demo", 1, 1, 0, 1, 3725.0, "", "r", "", ["Idea"])], cols)
    b = spark.createDataFrame([("demo", "Demo: A Book", "")], "book string, title string, author string")
    c = spark.createDataFrame([("demo", 0, "Intro"), ("demo", 1, "Two")], "book string, ch long, title string")
    day = F.lit("2030-01-01").cast("timestamp")
    md = _doc(export.notes_markdown(b, n, c, day), "\n")
    for want in ("*[1:05]*", "*[1:02:05]*", "#idea #key-point", "## Intro", "## Two", 'title: "Demo: A Book"'):
        assert want in md
    ob = _doc(export.notes_obsidian(b, n, c, day, "x"), "\n")
    for want in ("> [!quote] Intro — [1:05]", "^ch1-s2", "^ch2-s0", "tags:\n  - audiobook\n  - notes\n  - idea\n  - key-point\n---"):
        assert want in ob
    assert "_No notes yet._" in _doc(export.notes_markdown(b, n.filter("false"), c, day), "\n")


def test_transcript_empty_chapter(spark):
    b = spark.createDataFrame([("b", "T", "A")], "book string, title string, author string")
    c = spark.createDataFrame([("b", 0, "One", None, 1.0), ("b", 1, "Two", "ready", 1.0), ("b", 2, "P", "pending", 1.0), ("b", 3, "End", "ready", 1.0)],
                              "book string, ch long, title string, status string, duration double")
    s = spark.createDataFrame([("b", 0, 0, "a", 0), ("b", 0, 1, " ", 1), ("b", 0, 2, "b", 1), ("b", 0, 3, "c", 0), ("b", 2, 0, "no", 1)],
                              "book string, ch long, i long, t string, p int")
    assert _doc(export.to_transcript(b, c, s), "") == "T\nby A\n\n\n## One\n\na b\nc\n\n\n## Two\n\n\n\n## End\n"


def test_merge_is_idempotent(spark):
    cols = "book string, id string, seq long, created string, updated string, deleted boolean, note string"
    a = spark.createDataFrame([("b", "1", 0, "c", "2024-01-02", False, "old"), ("b", "2", 1, "c", None, False, "x"),
                               ("b", "3", 2, "c", "2024-01-05", False, "alive"), ("b", "", 3, "c", "z", False, "no id")], cols)
    b = spark.createDataFrame([("b", "1", 0, "c", "2024-01-02", False, "tie"), ("b", "2", 1, "d", None, True, "gone"),
                               ("b", "3", 2, "c", "2024-01-04", True, "late grave")], cols)
    live, dead = notes.merge_with_tombstones(a, b)
    assert {(r.id, r.note) for r in live.collect()} == {("1", "tie"), ("3", "alive")}
    assert {r.id for r in dead.collect()} == {"2"}
    again, _ = notes.merge_with_tombstones(live.withColumn("deleted", F.lit(False)), b)
    assert {(r.id, r.note) for r in again.collect()} == {("1", "tie"), ("3", "alive")}


def brute_anchor(note, sents):
    exact = (note["exact"] or "").strip()
    inside = note["si"] >= 0 and note["sj"] < len(sents) and note["si"] <= note["sj"]
    if not exact:
        return (note["si"], note["sj"]) if inside else None
    if inside and " ".join(sents[note["si"]:note["sj"] + 1]) == exact:
        return note["si"], note["sj"]
    recon = " ".join(sents)
    hits = [i for i in range(len(recon)) if recon.startswith(exact, i)]
    if not hits:
        return None
    norm = lambda x: " ".join(x.split())
    pre, suf = norm(note["prefix"]), norm(note["suffix"])
    fits = [p for p in hits if norm(recon[max(0, p - len(pre) - 4):p]).endswith(pre)
            and norm(recon[p + len(exact):p + len(exact) + len(suf) + 4]).startswith(suf)]
    at = (fits or hits)[0]
    starts, acc = [], 0
    for s in sents:
        starts.append(acc)
        acc += len(s) + 1
    return max(i for i, s in enumerate(starts) if s <= at), max(i for i, s in enumerate(starts) if s < at + len(exact))


def test_reanchor_by_context(spark):
    import random
    r = random.Random(11)
    sents = [" ".join(r.choice(["aa", "ab", "ba", "abab", "c."]) for _ in range(r.randrange(1, 6))) for _ in range(1500)]
    rows = []
    for n in range(60):
        si = r.randrange(len(sents) - 3)
        sj = si + r.randrange(3)
        moved = r.choice([0, 1, -1, 7])
        exact = " ".join(sents[si:sj + 1]) if n % 9 else r.choice(["", "zzz", "ab"])
        rows.append({"book": "b", "ch": 0, "id": str(n), "si": si + moved, "sj": sj + moved, "exact": exact,
                     "prefix": " ".join(sents[max(0, si - 3):si])[-32:] if n % 2 else "",
                     "suffix": " ".join(sents[sj + 1:sj + 4])[:32] if n % 3 else ""})
    tl = spark.createDataFrame([("b", 0, i, t) for i, t in enumerate(sents)], "book string, ch int, i int, t string")
    nd = spark.createDataFrame(rows, "book string, ch int, id string, si int, sj int, exact string, prefix string, suffix string")
    got = {x.id: None if x.orphan else (x.new_si, x.new_sj) for x in notes.reanchor(nd, tl).collect()}
    assert got == {x["id"]: brute_anchor(x, sents) for x in rows}


def test_page_slices_cover_chapters(spark):
    texts = ["aaaa bbbb. cccc", "", "dddd eeee", "ffff. gggg hhhh"]
    pages = structure.page_offsets(spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book string, page long, text string"))
    full = "\n\n".join(texts)
    cuts = [0, 5, 12, 30, len(full)]
    ch = spark.createDataFrame([("b", i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], "book string, ch long, start long, end long")
    for r in structure.page_slices(ch, pages).collect():
        start = cuts[r.ch] + r.base
        assert full[start:start + len(r.text)] == r.text
    tl = segment.sentences(structure.page_slices(ch, pages)).collect()
    for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
        assert sorted((x.cs, x.ce, x.t) for x in tl if x.ch == c) == brute_sentences(full[a:b])


def test_reanchor_finds_quotes_of_any_length(spark):
    t = [f"Sentence {i} has {i * i} words in it." for i in range(700)]
    tl = spark.createDataFrame([("b", 0, i, x, float(i), i + 0.5) for i, x in enumerate(t)], "book string, ch int, i long, t string, s double, e double")
    ask = {"short": (5, 5), "block": (100, 210), "long": (3, 690), "gone": None}
    rows = [("b", k, 0, 9000, 9000, " ".join(t[r[0]:r[1] + 1]) if r else "not in there", "", "") for k, r in ask.items()]
    n = spark.createDataFrame(rows, "book string, id string, ch int, si int, sj int, exact string, prefix string, suffix string")
    got = {r.id: (r.new_si, r.new_sj) if not r.orphan else None for r in notes.reanchor(n, tl).collect()}
    assert got == ask


def test_several_patches_of_one_note(spark):
    base = notes.coerce_notes(spark.createDataFrame(
        [("b", "n1", 0, 1, 1, 0, 5, 0.0, 1.0, "quote", "", "", "yellow", ["t"], "old", "note", "2024", "2024", 1)],
        "book string, id string, ch int, si int, sj int, cs int, ce int, s double, e double, exact string, prefix string, suffix string, "
        "color string, tags array<string>, note string, kind string, created string, updated string, seq long"))[0]
    p = spark.createDataFrame([("b", "n1", "blue", None, 1), ("b", "n1", "green", "new", 2), ("b", "n1", None, "newest", 3)],
                              "book string, id string, color string, note string, seq long")
    got = notes.patch_notes(base, p, F.current_timestamp()).collect()
    assert [(r.color, r.note) for r in got] == [("green", "newest")]


def test_empty_stamps_are_none(spark):
    kind = "book string, id string, created string, updated string"
    local = spark.createDataFrame([("b", "n", "2025", "")], kind)
    remote = spark.createDataFrame([("b", "n", "2024", "")], kind)
    assert notes.unpushed(local, remote).count() == 1
    assert notes.changed_books(local, remote).count() == 1


def test_new_notes_have_ids_of_their_own(spark):
    rows = [("b", 0, 1, 1, c, c + 2, 0.0, 1.0, "q", "", "", "yellow", ["t"], "n", "note", s) for c in (0, 5) for s in (1, 2)]
    raw = spark.createDataFrame(rows, "book string, ch int, si int, sj int, cs int, ce int, s double, e double, exact string, prefix string, "
                                      "suffix string, color string, tags array<string>, note string, kind string, seq long")
    n = spark.createDataFrame([("b", 3)], "book string, n int")
    got = notes.create_notes(raw, n, F.current_timestamp())
    assert got.select("id").distinct().count() == 4


def test_chapter_pipeline(spark):
    from bookflow.operators import chapters
    texts = ["Preface words only here. More of them.", "CHAPTER 1\n\nThe Ferry\n\nThe boat was late. Nobody minded the rain.",
             "It came at noon.", "CHAPTER 2\n\n", "Notes\n\nA list of names.", "CHAPTER 3\n\nThe end came soon."]
    pages = structure.page_offsets(spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book string, page long, text string"))
    off = [sum(len(t) + 2 for t in texts[:i]) for i in range(len(texts))]
    marks = spark.createDataFrame([("b", 1, 1, "The Ferry", 1, off[1]), ("b", 2, 1, "Chapter 2", 3, off[3]), ("b", 3, 1, "Notes", 4, off[4]),
                                   ("b", 4, 1, "Chapter 3", 5, off[5])], "book string, seq long, level int, title string, page long, off long")
    prof = spark.createDataFrame([("b", (["notes"], None))], "book string, skip_sections struct<titles:array<string>,page_ranges:array<array<int>>>")
    rules = T.compile_rules([{"from": "late", "to": "late late late late late late"}])
    ch, tl = chapters.chapter_pipeline(pages, marks, prof, ["^CHAPTER [0-9]+$"], rules)
    lead = len("CHAPTER 1\n\nThe Ferry\n\n")
    assert [(r.ch, r.title, r.start) for r in ch.orderBy("ch").collect()] == [
        (0, "The Ferry", off[1] + lead), (1, "Chapter 3", off[5] + len("CHAPTER 3\n\n"))]
    got = tl.orderBy("ch", "i").collect()
    assert [(r.ch, r.t) for r in got] == [(0, "The boat was late."), (0, "Nobody minded the rain."), (0, "It came at noon."), (1, "The end came soon.")]
    whole = "\n\n".join(texts)
    start = {r.ch: r.start for r in ch.collect()}
    assert all(whole[start[r.ch] + r.cs:start[r.ch] + r.ce] == r.t for r in got)
    plain = chapters.chapter_pipeline(pages, marks, prof, ["^CHAPTER [0-9]+$"])[1].orderBy("ch", "i").collect()
    assert got[0].e > plain[0].e and [r.t for r in got] == [r.t for r in plain]


def test_text_after_the_last_section_is_one(spark):
    pages = structure.page_offsets(spark.createDataFrame([("b", 0, "a b c.\n\n..."), ("c", 0, "a b c.  ")], "book string, page long, text string"))
    sents = spark.createDataFrame([(k, 0, 0, 3, 0, 6) for k in "bc"], "book string, page long, k int, w int, start long, end long")
    d = structure.fixed_sections(sents, 3)
    got = structure.section_bounds(d, structure.book_lengths(pages)).orderBy("book", "start").collect()
    assert [(r.book, r.title, r.start, r.end) for r in got] == [("b", "Section 1", 0, 6), ("b", "Section 2", 6, 11), ("c", "Section 1", 0, 6)]


def test_staged_folders_go(spark):
    import os
    from bookflow import settings
    d = settings.stage(spark.range(3), "gone")
    path = settings._staged[-1].removeprefix("file:")
    assert d.count() == 3 and os.path.isdir(path)
    keep, settings._staged[:] = settings._staged[:-1], settings._staged[-1:]
    settings.drop_staged(spark)
    settings._staged[:] = keep
    assert not os.path.exists(path)


def test_navigation_trees(spark):
    """Preorder over any depth; untitled entries count but go; nulls and damaged documents have no entries."""
    deep = {"title": "t60"}
    for k in range(59, 0, -1):
        deep = {"title": f"t{k}", "href": f"h{k}", "children": [deep, {"title": "", "children": [{"title": f"x{k}"}]}]}
    want = []

    def walk(entries, level):
        for x in entries:
            want.append((len(want), level, x["title"], x.get("href")))
            walk(x.get("children") or [], level + 1)
    walk([deep, {"title": " A ", "children": None}], 1)
    docs = [("a", json.dumps([deep, {"title": " A ", "children": None}])), ("b", None), ("c", ""), ("d", '[{"title": "x"'), ("e", "[]")]
    got = [tuple(r) for r in files.flatten_toc(spark.createDataFrame(docs, "key string, doc string"), "key", "doc").orderBy("book", "seq").collect()]
    assert [r for r in got if r[0] == "a"] == [("a", s, level, t.strip(), h) for s, level, t, h in want if t]
    assert {r[0] for r in got} <= {"a", "d"}
    assert files.flatten_toc(spark.createDataFrame([], "key string, doc string"), "key", "doc").count() == 0


def test_batch_forms_of_cutting_and_counting(spark):
    """Sentences, lines and tokens are taken in batches, with the odd white space and ends that the expressions knew."""
    texts = [None, "", " \n\n", "...", "One. ... Two!? (x).\" ) z\n\n\n\x1f . Three\u3000", "\n\nA\nb. c\n\n.\n", "a\u2003b\x1cc  d\te"]
    d = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    got = {r["n"]: r for r in d.select("n", segment.sentence_spans("text").alias("s"), X.est_samples("text").alias("a"), X.est_samples_all("text").alias("b")).collect()}
    assert got[0]["s"] is None and [got[k]["s"] for k in (1, 2, 3)] == [[], [], []]
    assert all([(x.cs, x.ce, x.t) for x in got[k]["s"]] == brute_sentences(texts[k]) for k in (4, 5, 6))
    assert [(x.p, x["first"]) for x in got[5]["s"]] == [(False, True), (True, False)]
    assert all(r["a"] == r["b"] for r in got.values())
    raw = spark.createDataFrame([("b", 0, "12\r\n one \x0btwo\x85\n\u2029iv\n three\t x\n\n")], "book string, page long, raw string")
    assert clean.clean_pages(raw).first()["text"] == "one two\n\nthree x"
    slim = timeline.spoken(spark.createDataFrame([("b", 0, 0, 0, "One two.", True, True)], "book string, ch long, page long, k int, t string, p boolean, first boolean"))
    assert timeline.timeline(slim.drop("t")).first()["settled"] == 0.0    # the text isn't read again


def test_keys_in_batches(spark):
    """Keys of whole texts in batches, and their first characters from the start of a text, are those of the expressions."""
    texts = [None, "", "Chapter IV: The  \u212aing\u2019s \u0130\u017f ok", " part\t12. - x", "part 12", "chapter\u00a0one", "a" * 39 + "!" * 900 + "bc",
             " " * 700 + "Section x. " + "Word, " * 300, "é" * 800 + "x y z" * 30, "chapter " + "1" * 700 + " end of it"]
    d = spark.createDataFrame(list(enumerate(texts)), "n long, t string")
    rows = d.select(T.match_key("t").alias("a"), T.match_key_all("t").alias("b"), F.substring(T.match_key("t"), 1, 40).alias("c"), T.key_head("t", 40).alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows)


def test_navigation_trees_are_parsed_once(spark):
    """plain trees are read where they lie, without a round for each level; odd ones still give what Spark's JSON parser reads."""
    deep = "[" + '{"title": "d", "children": [' * 420 + "]}" * 420 + "]"
    odd = ["{'title': 'a'}", '{"title": "one", "children": {"title": "two"}}', '[{"title": 5, "href": true}]', '[{"title": "x", "title": "y"}]', "[1, {\"title\": \"z\"}]",
           '[{"title": "q", "children": "[{\\"title\\": \\"w\\"}]"}]', '[{"title": "t"}] tail', '[{"title": NaN}]', '[null, {"title": "n"}]', '"text"', "5", "{broken", '[{"title": "\\ud83d"}]']
    plain = ['[{"title": " a\\u00e9\\ud83d\\ude00 ", "href": "h", "children": [{"title": "b", "children": []}, {"Title": "no"}, {"title": "c", "page": 1}]}, {"title": null}, {"title": "e"}]', "[]", "[{}]"]
    docs = [(f"o{k}", x) for k, x in enumerate(odd)] + [(f"p{k}", x) for k, x in enumerate(plain)] + [("n", None), ("e", "")]
    d = spark.createDataFrame(docs, "book string, nav string")
    want = files._rounds(d).withColumn("title", T.strip(F.coalesce("title", F.lit("")))).filter("title <> ''")
    assert sorted(map(tuple, files.flatten_toc(d, "book", "nav").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert [files._entries(x) is None for x in odd] == [True] * len(odd) and files._entries(deep) is None and [files._entries(x) for x in plain[1:]] == [[], [(0, 1, None, None)]]
    alone = files.flatten_toc(d.where("book LIKE 'p%'"), "book", "nav")
    assert "Union" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == 4
