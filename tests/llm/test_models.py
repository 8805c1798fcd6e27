"""Language ID, toxicity and page extraction: held-out accuracy and odd rows."""

import collections
import math
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookflow.llm import html_crf, langid, toxicity
from bookflow.llm.queries import QUERIES, fold

SF = "/root/testdata/sf0.01"


def test_language_query_on_held_out_rows(spark):
    got = QUERIES["op3_langid"](spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]]
    assert list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(docs)
    both = got.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


@pytest.fixture(scope="module")
def languages(spark):
    """Three families, two of them with several members."""
    r = random.Random(4)
    syllables = {"en": "the ing er on th", "de": "der ung sch ei th", "fr": "eau oi ment le", "es": "ción os que la", "it": "zione gli che la",
                 "fi": "kk yy ää ssa"}
    rows = [(k, " ".join("".join(r.choice(s.split()) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 40))), lang)
            for k, (lang, s) in enumerate(x for x in syllables.items() for _ in range(60))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_families_and_pairs(spark, languages, odd, none):
    model = langid.fit(languages, F.col("doc_id") % 3 != 0)
    assert set(model.family_svm) == {"germanic", "romance", "uralic"}
    assert set(model.pair_svm) == {("de", "en"), ("es", "fr"), ("es", "it"), ("fr", "it")}
    got = langid.identify(languages.where("doc_id % 3 = 0"), model)
    assert got.where("lang = lang_pred").count() / got.count() > 0.95
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (2, 3, 4, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == "und" if r["text"] is None else 0 < r["score"] <= 1
    assert langid.identify(none, model).count() == 0


def test_copies_count_once(spark, languages):
    """A language of few texts in many copies is learned from all of them, each once."""
    hashed = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    few = languages.where("lang = 'fi'").where(hashed > 0.1).limit(5)
    copies = few.crossJoin(spark.range(200)).drop("id")
    low = languages.where("lang = 'en'").orderBy(hashed).limit(1).crossJoin(spark.range(500)).drop("id")
    docs = languages.where("lang <> 'fi'").unionByName(copies).unionByName(low)
    got = {r["lang"]: r["count"] for r in langid.learned_from(docs, "text", "lang", F.lit(True), 50).groupBy("lang").count().collect()}
    assert got["fi"] == 5 and set(got) == {"en", "de", "fr", "es", "it", "fi"} and max(got.values()) <= 60
    # A share of the rows instead of the texts would have taken none of these.
    model = langid.fit(docs, F.lit(True), sample=50)
    assert {r["lang_pred"] for r in langid.identify(few, model).collect()} == {"fi"}


def test_parts_of_a_long_text_add_up(monkeypatch):
    texts = ["Ein langer Text, né? " * 300, "", None, "b"]
    whole = langid.features(texts)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert abs(langid.features(texts) - whole).max() < 0.02
    assert not whole[1].any() and not whole[2].any()


def test_nothing_learned(spark, odd):
    model = langid.fit(odd, F.lit(False))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()} == {("und", 0.0)}
    one = langid.fit(odd.where("lang = 'fr'"), F.lit(True))
    assert langid.identify(odd.where("doc_id = 1"), one).first()["lang_pred"] == "fr"


# ---- toxicity ----------------------------------------------------------------------------------

def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, sf).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and got.score.between(0, 1).all()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    both = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    toxic = both[both.toxic == 1]
    assert both[both.toxic == 0].predicted.mean() < 0.01
    assert toxic.predicted.mean() > 0.75          # about a tenth of the labels are junk without an insult


def test_features_see_the_text():
    x = toxicity.Extractor({"=idiot": 5.0, "^mor": 4.0})
    row = dict(zip(toxicity.FEATURE_NAMES, x.row("You are an IDIOT!! Such a nice day, 1d10t.")))
    assert row["hit_density"] == 2 / 9 and row["near_person"] == 0.5 and row["hidden_hits"] == 1 / 9
    assert row["exclaimed"] > 0 and row["repeated_marks"] > 0 and row["capital_words"] > 0
    assert x.row(None) == x.row("") and not any(x.row(None))


def test_terms_of_long_texts_need_no_copies(spark):
    """512 labelled texts of 100 kB in one batch: what is held depends on the terms alone."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    words = [f"w{k:05d}x" for k in range(30_000)]
    texts = [" ".join(rng.choice(words, 12_500)) for _ in range(512)]
    assert min(map(len, texts)) > 95_000
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 2 for k in range(512)], pa.int32()), pa.array([k % 3 for k in range(512)], pa.int32())],
                                   ["text", "toxic", "part"])
    n, most = collections.Counter(), 0
    for out in toxicity._document_terms(iter([b])):
        most = max(most, out.nbytes)
        for r in zip(*(c.to_pylist() for c in out.columns), strict=True):
            n[r[:3]] += r[3]
    assert most < 32 << 20
    for k in range(3):
        held = sum(words[k] in set(t.split()) for t in texts[4::6])
        assert n[(f"={toxicity.terms_of(words[k])[0][0][1:]}", 0, 1)] >= held


def plain_features(text, terms):
    """The features again, word by word."""
    tokens = (text or "").split()
    flat = []
    for t in tokens:
        own, hidden = toxicity.terms_of(t)
        best = max((x for x in own if x in terms), key=lambda x: terms[x], default="")
        core = re.sub(r"^[\W_]+|[\W_]+$", "", t)
        flat.append((best, hidden, core.lower() in toxicity.SECOND_PERSON, len(core) > 1 and core.isupper()))
    n, chars, text = max(1, len(tokens)), max(1, len(text or "")), text or ""
    at = [k for k, f in enumerate(flat) if f[0]]
    person = [k for k, f in enumerate(flat) if f[2]]
    near = [min((abs(k - p) for p in person), default=99) <= toxicity.NEAR for k in at]
    return [math.log1p(len(at)), math.log1p(len({flat[k][0] for k in at})), len(at) / n, max((sum(k <= j < k + toxicity.SPAN for j in at) for k in at), default=0) / toxicity.SPAN,
            max((terms[flat[k][0]] for k in at), default=0.0), len(person) / n, sum(near) / max(1, len(near)), sum(c.isupper() for c in text) / chars,
            sum(f[3] for f in flat) / n, text.count("!") / n, text.count("?") / n, sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text) / chars,
            sum(text.count(m) for m in ("!!", "??", "?!")) / n, sum(f[1] for f in flat) / n, sum(f[1] and bool(f[0]) for f in flat) / n, math.log1p(len(tokens))]


def test_scores_against_plain_versions(spark):
    """Features word by word, every tree walked by its text form, the calibration by pooling neighbours."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, lambda c: F.crc32(F.col(c).cast("string")) % 3 != 1)
    some = [r["text"] for r in docs.where("doc_id % 7 = 3").collect()] + ["", "YOU id1ot!! you @re what?! " + " ".join(list(model.terms)[:3]).replace("=", "").replace("^", "")]
    made = toxicity.Extractor(model.terms)
    for t in some:
        assert np.allclose(made.row(t), plain_features(t, model.terms), atol=1e-12)

    def walk(lines, x, depth=0):
        """Follows the printed conditions of one tree."""
        line = lines.pop(0)
        if line.strip().startswith("Predict"):
            return float(line.split(":")[1])
        m = re.match(r"\s*If \(feature (\d+) <= ([-+.\dE]+)\)", line)
        left = walk(lines, x)
        assert lines.pop(0).strip().startswith("Else")
        right = walk(lines, x)
        return left if x[int(m[1])] <= float(m[2]) else right
    trees = [t.toDebugString.splitlines()[1:] for t in model.trees.trees]
    weights = list(model.trees.treeWeights)

    def raw(x):
        return 1 / (1 + math.exp(-2 * sum(w * walk(list(t), x) for w, t in zip(weights, trees, strict=True))))
    bounds, levels = list(model.calibration.boundaries), list(model.calibration.predictions)
    got = toxicity.score(spark.createDataFrame([(t,) for t in some], "text string"), model).collect()
    for r in got:
        p = raw(plain_features(r["text"], model.terms))
        want = float(np.interp(p, bounds, levels)) * 0.999 + p * 0.001
        assert abs(r["score"] - min(1, max(0, want))) < 1e-9 and r["predicted"] == (r["score"] >= 0.7)
    data = toxicity.labelled_sample(docs, labels, lambda c: F.crc32(F.col(c).cast("string")) % 3 != 1, toxicity.SAMPLE, "doc_id", "text", "toxic")
    rows = data.collect()
    lexicon = toxicity.lexicons(data)[2]
    pairs = sorted((raw(plain_features(r["text"], lexicon)), r["toxic"]) for r in rows if r["part"] == 2)
    pools = []
    for x in sorted({p for p, _ in pairs}):
        own = [y for p, y in pairs if abs(p - x) < 1e-15]
        pools.append([sum(own), len(own), x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    for s, n, lo, hi in pools:
        for x in (lo, hi):
            assert abs(np.interp(x, bounds, levels) - s / n) < 1e-6


def test_toxicity_odd_rows(spark, odd, none):
    ids = spark.range(400).select(F.col("id").alias("doc_id"))
    docs = ids.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("you stupid fool number "), "doc_id")).otherwise(
        F.concat(F.lit("a kind word for number "), "doc_id")))
    labels = ids.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).unionByName(
        spark.createDataFrame([(None, 1), (5, None), (6, 7)], "doc_id bigint, toxic int"))
    model = toxicity.fit(docs, labels, lambda c: fold(c, 3) != 1)
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and dict(got.dtypes)["score"] == "double" and "_text" in got.columns
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score(none, model).count() == 0
    fit = toxicity.score(docs, model).agg(F.min(F.when(F.col("doc_id") % 3 == 0, F.col("score"))),
                                          F.max(F.when(F.col("doc_id") % 3 != 0, F.col("score")))).first()
    assert fit[0] >= 0.7 > fit[1]
    for empty in (labels.limit(0), labels.where("toxic = 0")):
        alone = toxicity.fit(docs, empty, lambda c: fold(c, 3) != 1)
        assert {r["score"] for r in toxicity.score(docs, alone).select("score").distinct().collect()} == {0.0}


# ---- pages -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def field():
    return html_crf.train()


def test_composed_pages_held_out(field):
    wrong = total = 0
    for page, labels in html_crf.labelled_pages(150, seed=77):
        got = field.viterbi(html_crf.block_features(html_crf.leaf_blocks(page)))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong / total < 0.01


def test_viterbi_is_the_best_path(field):
    import itertools

    import numpy as np
    for page, _ in itertools.islice(html_crf.labelled_pages(20, seed=5), 20):
        names = html_crf.block_features(html_crf.leaf_blocks(page))[:9]
        e = field._emissions(field._ids(names, False))
        score = lambda y: sum(e[k][c] for k, c in enumerate(y)) + sum(field.step[a][b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(names)), key=score)
        assert np.isclose(score(best), score(field.viterbi(names)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><!-- <p>ad</p> --><div class="ad">Buy this now.</div>
<article><h1>Salt &amp; sea</h1><p><b>The first&nbsp;paragraph
 says &#8222;much&#8220;.<br><p>The second one has &quot;words&quot; in it &am<p>%s</article>
<section class="comments"><h3>Comments</h3><p>I don't agree with this at all.</p></section>
<footer>&copy; example &middot; all rights. <a href=x>Imprint</a></footer></bo"""


def test_page(field):
    got = html_crf.main_text(PAGE % "Third.", field)
    assert got == 'Salt & sea\nThe first paragraph says „much“.\nThe second one has "words" in it &am\nThird.'


@pytest.mark.parametrize("inside,want", [
    ("Where <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds, all is well.", "Where a=2 holds, all is well."),
    ("Where <math><mi>a</mi> holds, all is well.", "Where a holds, all is well."),
    ("It <svg><text>no</text></svg>goes on from here.", "It goes on from here."),
    ("It goes on <svg class=x> from here.", "It goes on from here.")])
def test_formulas_and_open_drawings(field, inside, want):
    page = PAGE % f"{inside}<p>The last one is here."
    assert html_crf.main_text(page, field) == html_crf.main_text(PAGE % f"{want}<p>The last one is here.", field)
    assert f"{want}\nThe last one is here." in html_crf.main_text(page, field)


def test_a_drawing_ends_at_its_own_end():
    texts = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert texts("<p>a <svg><path><p>b<svg><text>no</text></svg><p>c") == ["a", "b", "c"]
    assert texts("<p>a <svg><svg>x</svg><text>no</text></svg> b<p>c") == ["a b", "c"]
    assert texts("<p>a <svg><title>t</title><style>s</style><text>lost") == ["a lost"]
    assert texts("<svg>" * 20_000 + "<p>end") == ["end"]


def test_features_of_paths_add_up(field):
    pages = [p for p, _ in html_crf.labelled_pages(20, 99)] + ["<div class='a b'><div class=a><p>x</div><p class=b>y<section id=c><li>z<li>w</section>v"]
    for page in pages:
        blocks = html_crf.leaf_blocks(page)
        assert np.allclose(field.page_emissions(blocks), field._emissions(field._ids(html_crf.block_features(blocks), False)))


@pytest.mark.parametrize("tag", ["<div>", "<div class=%d>", "<section>", "<ul><li>", "<table><tr><td>", "<template>", "<b>", "</p>", "<p>"])
def test_depth_costs_no_more_than_length(field, tag):
    import time
    page = "".join((tag % k if "%" in tag else tag) + "word " for k in range(100_000))
    t0 = time.process_time()
    html_crf.main_text(page, field)
    assert time.process_time() - t0 < 30
    page = "".join((tag % k if "%" in tag else tag) for k in range(100_000)) + "</section>" * 1000 + "<article><p>A text, long enough. And here is more of it."
    t0 = time.process_time()
    html_crf.main_text(page, field)
    assert time.process_time() - t0 < 5 * tag.count("<")


def test_noscript_and_open_templates(field):
    texts = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert texts("<p>a<noscript> b <i>c</i></noscript> d<p>e") == ["a b c d", "e"]
    assert texts("<p>a<template>gone<p>too</template> b") == ["a b"]
    assert texts("<p>a<template>left<p>b<iframe>c") == ["aleft", "bc"]
    assert texts("<p>a<script>gone<p>b") == ["a"]


def test_pages_query(spark):
    import re
    got = QUERIES["op6_html_crf"](spark, SF).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    assert list(got.columns) == ["url", "text", "n_chars"] and len(got) == len(pages)
    import html
    for k, page in pages.html.items():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", re.sub(r"<script.*?</script>|<!--.*?-->", "", page, flags=re.S), re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", b.replace("<b>", "").replace("</b>", "")))).strip()
                  for b in re.split(r"</?(?:p|h1)>", body))
        assert got.text[k] == "\n".join(b for b in blocks if b) and got.n_chars[k] == len(got.text[k])


def test_odd_pages(spark, field):
    rows = [(1, None), (2, ""), (3, "plain words only"), (4, "<p>"), (5, "<script>never closed <p>x"), (6, "<p>a" * 5000), (7, "< <> </> <!x <b"),
            (7, "<article><p>" + "long text goes on. " * 200_000 + "</p></article>"), (8, "<svg><text>no</text></svg><textarea><p>no</textarea>"),
            (9, "<table><tr><td>one<td>two<tr><td>three</table>"), (10, "<a href='x>y'>l</a>")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id int, html string, n_chars string")
    got = html_crf.extract(df, field).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[4] == by[5] == by[8] == ""
    assert len(by[7]) > 3_000_000
    assert html_crf.extract(df.limit(0), field).count() == 0
    assert [b.text for b in html_crf.leaf_blocks(rows[9][1])] == ["one", "two", "three"]


def test_data_is_there():
    assert os.path.isdir(SF)
