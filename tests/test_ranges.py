"""Ranges, medians and lookups against plain versions, with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from bookflow.functions.text import title_matches
from bookflow.operators import clean, lookup, notes, structure, timeline


def test_halves_make_up_the_range(spark):
    r = random.Random(1)
    ranges = [(0, 0), (5, 5), (6, 6), (0, 1 << 30), (7, 8), *(sorted((r.randrange(300), r.randrange(300))) for _ in range(80))]
    for lo, hi, out in spark.createDataFrame(ranges, "a long, b long").select("a", "b", notes._halves(F.col("a"), F.col("b"))).collect():
        spans = sorted((x.place << x.level, ((x.place + 1) << x.level) - 1) for x in out)
        assert spans[0][0] == lo and spans[-1][1] == hi and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:])) and len(out) <= 62


def test_highlights(spark):
    r = random.Random(2)
    rows = [("b", r.randrange(2), k, r.choice("xyz"), *sorted((r.randrange(60), r.randrange(60)))) for k in range(60)]
    rows += [("b", 0, 99, "q", 0, 10_000_000), ("b", 1, 98, "q", 5, 10_000_001), ("b", 1, 97, "q", 9, 8)]
    d = spark.createDataFrame(rows, "book string, ch int, seq int, color string, si int, sj int")
    n = spark.createDataFrame([("b", 0, 10_000_001), ("b", 1, 10_000_001)], "book string, ch int, n_sentences long")
    runs = notes.highlight_runs(d, n).collect()
    want = {}
    for _, ch, seq, color, si, sj in sorted(rows, key=lambda x: x[2]):
        if si <= sj < 10_000_001:
            want.update({(ch, i): color for i in [*range(si, min(sj, 80) + 1), *([sj] if sj > 80 else [])]})
    assert len(runs) < 250
    got = {}
    for x in runs:
        got.update({(x.ch, i): x.color for i in [*range(x["from"], min(x.to, 80) + 1), *([x.to] if x.to > 80 else [])]})
    assert got == want


def test_median_of_a_hot_key(spark):
    d = spark.range(20_000).select(F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
                                   (F.col("id") * 7919 % 10_007).cast("double").alias("v")).unionByName(
        spark.createDataFrame([("one", 3.0), ("none", None), (None, 2.0), (None, 1.0)], "k string, v double"))
    got = {r[0]: r[1] for r in structure.upper_median(d, "k", "v").collect()}
    by = {}
    for k, v in d.collect():
        if v is not None:
            by.setdefault(k, []).append(v)
    assert got == {k: sorted(x)[len(x) // 2] for k, x in by.items()}


@pytest.mark.parametrize("cell", [8, 1000])
def test_asof_with_a_hot_place(spark, cell):
    r = random.Random(3)
    starts = [("k%d" % (i % 3), r.randrange(500), i) for i in range(90)] + [("far", 1, 1), ("far", 90_000, 2)]
    probes = [("k0", 250, 1000 + i) for i in range(400)] + [("k%d" % (i % 5), r.randrange(-20, 600), i) for i in range(200)] + [("far", 89_999, 5), ("far", 90_001, 6)]
    got = lookup.asof_cells(spark.createDataFrame(probes, "k string, t long, n long"), spark.createDataFrame(starts, "k string, s long, i long"),
                            ["k"], "t", "s", ["i"], cell).collect()
    assert len(got) == len(probes)
    for k, t, n, i in got:
        best = max(((s, x) for q, s, x in starts if q == k and s <= t), default=None)
        assert i == (best[1] if best else None)


def test_full_width_titles_and_bad_patterns(spark):
    d = spark.createDataFrame([("Ｉｎｄｅｘ",), ("ﬁnal notes",), ("other",), (None,)], "t string")
    hit = title_matches("t", F.array(F.lit("index"), F.lit(None), F.lit("Final  Notes!")))
    assert [r[0] for r in d.select(F.coalesce(hit, F.lit(False))).collect()] == [True, True, False, False]
    text = spark.createDataFrame([("ＣＨＡＰＴＥＲ １\n\nprose goes on", "Ｃｈａｐｔｅｒ Ｏｎｅ"), ("Ｏｎｅ\n\nprose", "One"), ("One\n\nprose", None)], "x string, t string")
    cut = [r[0] for r in text.select(structure.heading_cut("x", "t", F.array(F.lit("(["), F.lit("^x$")))).collect()]
    assert cut == [11, 5, 0]                      # a numbered label has an empty key, which every title holds


def test_many_pattern_lists(spark):
    """Every row has a list of its own; only so many stay compiled."""
    d = spark.range(5000).select(F.array(F.concat(F.lit("line "), F.col("id").cast("string")), F.lit("other")).alias("l"),
                                 F.array(F.concat(F.lit("^line "), F.col("id").cast("string"), F.lit("$")), F.lit("([")).alias("p"))
    assert d.select(clean.match_any("l", "p").alias("m")).where(F.col("m") != F.array(F.lit(True), F.lit(False))).count() == 0


def test_chunks_without_audio_fall_back(spark):
    sents = spark.createDataFrame([("b", 0, c, i, "one two three", p) for c, i, p in [(0, 0, False), (0, 1, False), (1, 2, True), (2, 3, False)]],
                                  "book string, ch int, chunk long, i long, t string, p boolean")
    words = spark.createDataFrame([("b", 0, 0, 0, 0, 0.1, 0.4), ("b", 0, 0, 0, 1, 0.5, 0.9)], "book string, ch int, chunk long, si long, w int, start double, end double")
    audio = spark.createDataFrame([("b", 0, 0, 48_000), ("b", 0, 1, 99)], "book string, ch int, chunk long, samples long")
    got = [(r.i, r.s, r.e) for r in timeline.chunked_timeline(sents, words, audio).orderBy("i").collect()]
    d = 3 / 2.9
    t1 = 2 + 0.09
    t2 = t1 + d + 0.09 + 0.32
    want = [(0, 0.1, 0.9), (1, 0.9, 0.9), (2, t1, t1 + d), (3, t2, t2 + d)]
    assert [g[0] for g in got] == [0, 1, 2, 3]
    assert all(abs(a - b) <= 0.0011 for g, w in zip(got, want) for a, b in zip(g[1:], w[1:]))


def test_all_occurrences(spark):
    from bookflow.functions.text import occurrences
    rows = [("abcabc", "abc"), ("aaaa", "aa"), ("xab", "ab"), ("x", "y"), ("", "a"), ("a.b\\E.a.b", "a.b"), ("é\U0001F600é\U0001F600", "\U0001F600"), ("e" * 9000, "e"), (None, "a"),
            ("line\nline\n", "e\nl"), ("ab", "abc"), ("x\\E", "\\E")]
    got = spark.createDataFrame(rows, "t string, q string").select("t", "q", occurrences("t", "q").alias("p")).collect()
    for t, q, p in got:
        assert (p or []) == [k for k in range(len(t or "")) if t.startswith(q, k)]


def test_needles_in_many_blocks(spark, monkeypatch):
    """Blocks of a few needles, written and read by tasks; pairs hold no text unless asked for."""
    monkeypatch.setattr(lookup, "NEEDLE_CHARS", 12)
    texts = [(k, f"text number {k} of {k % 7} and {'x' * (k % 5)}") for k in range(60)] + [(99, None), (98, "")]
    needles = [(w,) for w in ("1", "number 3", "xxxx", "of 6 and", "none of them", "", "text", "é")]
    items = spark.createDataFrame(texts, "i int, t string")
    got = lookup.substring_join(items, spark.createDataFrame(needles, "n string"), "t", "n", ["i"])
    assert got.columns == ["n", "i"]
    want = sorted((n, i) for i, t in texts for (n,) in needles if n and t and n in t)
    assert sorted(map(tuple, got.collect())) == want
