"""What stays within bounds however many rows, files and keys there are."""

import time
from collections import Counter
from urllib.parse import quote

import pandas as pd
from pyspark.sql import functions as F

from bookflow import settings
from bookflow.functions import text as T
from bookflow.operators import structure
from bookflow.settings import configure, stage
from bookflow.sources import documents as D, files, listing, manifests
from bookflow.streaming import jobs, ordered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark):
    """400,000 rows lie in a file of some 2 MB, but take tens of MB in a hash table on the driver."""
    configure(spark)
    rows = stage(spark.range(400_000).withColumn("text", F.concat(F.repeat(F.lit("x"), 50), (F.col("id") % 100).cast("string"))), "many")
    few = stage(spark.range(100).withColumn("n", F.col("id")), "few")
    other = spark.range(10_000_000).withColumnRenamed("id", "a")
    assert "BroadcastHashJoin" not in plan(other.join(rows, F.col("a") == F.col("id")))
    assert "BroadcastHashJoin" in plan(other.join(few, F.col("a") == F.col("id")))


def _library(spark, tmp_path, name, text, n=300):
    path = str(tmp_path / "docs")
    D.write_documents(spark.range(n).select(F.concat(F.lit("d+ %"), F.col("id").cast("string")).alias("book"), F.lit(-1).cast("long").alias("ch"), text.alias("text")), path, name)
    return path


def _files(df, name):
    """Documents that the driver knows by name."""
    return [f for f in df.inputFiles() if f.endswith(name)]


def test_the_driver_knows_no_file_of_an_inbox(spark, tmp_path):
    """F3"""
    path = _library(spark, tmp_path, "a.PDF", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")))
    got = files.scan_inbox(spark, f"{path}/*/*/*")
    assert _files(got, ".PDF") == []
    rows = got.collect()
    assert len(rows) == 300 and sum(r.length for r in rows) == sum(k % 7 for k in range(300)) and {r.name for r in rows} == {"a.PDF"}


def test_the_driver_knows_no_notes_file(spark, tmp_path):
    """F7"""
    path = _library(spark, tmp_path, "notes.json", F.concat(F.lit('[{"id": "n'), F.col("id").cast("string"), F.lit('"}]')))
    got = files.read_notes(spark, f"{path}/*/*")
    assert _files(got, ".json") == []
    assert {(r.book, r.id) for r in got.collect()} == {(quote(f"d+ %{k}", safe=" "), f"n{k}") for k in range(300)}


def test_the_driver_knows_no_manifest_file(spark, tmp_path):
    """F8; a list holds several manifests, a damaged file none."""
    k = F.col("id")
    doc = F.concat(F.lit('{"id": "b'), k.cast("string"), F.lit('", "title": "T"}'))
    doc = F.when(k % 3 == 0, doc).when(k % 3 == 1, F.concat(F.lit("["), doc, F.lit(', {"title": "U"}, {"n_pages": "x"}]'))).otherwise(F.substring(doc, 1, 12))
    got = manifests.read_manifests(spark, f"{_library(spark, tmp_path, 'manifest.json', doc)}/*/*")
    assert _files(got, ".json") == []
    want = {(f"b{k}", "T") for k in range(300) if k % 3 < 2} | {(quote(f"d+ %{k}", safe=" "), "U") for k in range(300) if k % 3 == 1}
    assert {(r.id, r.title) for r in got.collect()} == want


def test_a_long_document_is_never_one_row(spark, tmp_path):
    """neither what is staged nor what is returned holds more than a block."""
    text = "".join(chr(0x61 + k % 26) + "é😀" for k in range(40_000))
    path = str(tmp_path / "docs")
    D.write_documents(spark.createDataFrame([("b", -1, text)], "book string, ch long, text string"), path, "doc.txt")
    known = len(settings._staged)
    got = {r.block: r.text for r in D.read_blocks(spark, path, "doc.txt", 1000).collect()}
    assert "".join(got[k] for k in range(len(got))) == text
    for at in settings._staged[known:]:
        d = spark.read.parquet(at)
        for c, kind in d.dtypes:
            assert kind != "string" or d.agg(F.max(F.length(c))).first()[0] <= 1000


def test_the_driver_knows_no_document(spark, tmp_path):
    """many small documents, in tasks of many files."""
    path = _library(spark, tmp_path, "feed.xml", F.concat(F.lit("é"), F.col("id").cast("string")))
    got = D.read_blocks(spark, path, "feed.xml")
    assert _files(got, ".xml") == [] and listing.dealt(listing.listed(spark, f"{path}/*/*/*/feed.xml")).rdd.getNumPartitions() == 1
    assert {(r.document, r.block, r.text) for r in got.collect()} == {(f"d+ %{k}", 0, f"é{k}") for k in range(300)}


def test_state_goes_with_slots_not_with_keys():
    """calls to the state store for 5000 keys of one slot and bucket, and their rows in order."""
    calls = Counter()

    class State:
        def __init__(self):
            self.held = {}

        def getValue(self, key):
            calls["get"] += 1
            return self.held.get(key)

        def get(self):
            return self.getValue(())

        def updateValue(self, key, value):
            calls["put"] += 1
            self.held[key] = value

        def update(self, value):
            self.updateValue((), value)

        def removeKey(self, key):
            calls["remove"] += 1
            del self.held[key]

    class Handle:
        getMapState = getValueState = lambda self, *a: State()
        registerTimer = lambda self, at: calls.update(["timer"])

    class Now:
        getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: 100

    columns = ["book", "version", "chapters_ready", "status", "gained"]
    p = ordered.InOrder(jobs._changes, ["book"], "version", ["version"], 100, columns)
    p.init(Handle())
    rows = pd.DataFrame([(f"b{k % 5000}", 99 - k // 5000, 99 - k // 5000, "x", 0) for k in range(10_000)], columns=columns)
    list(p.handleInputRows((0,), iter([rows]), None))
    got = pd.concat(p.handleExpiredTimer((0,), Now(), Now()))
    assert sum(calls.values()) < 20
    assert [tuple(r) for r in got[got["book"] == "b7"].to_numpy()] == [("b7", 98, 98, "x", 98), ("b7", 99, 99, "x", 1)] and len(got) == 10_000


def _seconds(df):
    start = time.time()
    rows = df.collect()
    return rows, time.time() - start


def test_a_text_of_many_tags_takes_time_by_their_number(spark):
    """60,000 tags that all differ, each compared with those before it, took minutes."""
    text = F.concat_ws(",", F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda k: F.concat(F.lit("#T"), (k % 59_999).cast("string"))))
    rows, took = _seconds(spark.range(1).select(T.norm_tags(T.split_tags(text)).alias("t")))
    assert rows[0].t == [f"T{k}" for k in range(1, 21)] and took < 20


def test_labels_are_matched_in_lines_that_the_text_gives_once(spark):
    """what goes into the function of patterns comes out of it, and no step reads it from the text again."""
    d = spark.createDataFrame([("CHAPTER 1\n \nONE\n   body", "x"), ("\n " + "y" * 91 + "\nONE\nbody", "x"), ("ONE \x1c\n\n", "x"), ("ONE", ""), (None, "x")], "a string, b string")
    cut = d.select(structure.heading_cut("a", "b", F.array(F.lit("^CHAPTER [0-9]+$"), F.lit("^ONE$"))).alias("n"))
    assert [r.n for r in cut.collect()] == [16, 0, 7, 3, 0]
    above = plan(cut).split("ArrowEvalPython")[0]
    assert above.count("regexp_extract(") <= 1 and "substring_index(" not in above


def test_a_page_of_many_entries_gets_one_key(spark):
    """a text of which 400 entries ask is normalised once, not once for each."""
    body = " ".join(f"word{k}" for k in range(30_000))
    pages = spark.createDataFrame([("b", 0, 0, "x"), ("b", 1, 3, body)], "book string, page long, page_off long, text string")
    toc = spark.range(400).select(F.lit("b").alias("book"), "id", F.concat(F.lit("Word"), (F.col("id") + 29_000).cast("string")).alias("title"), F.lit(1).alias("page"))
    found = structure.locate_headings(toc, pages)
    assert "regexp_replace(lower(text" not in plan(found) and "text" not in found.columns
    assert {r.off for r in found.collect()} == {3 + body.index(f"word{k}") for k in range(29_000, 29_400)}


def test_sentences_of_chapters_are_cut_and_spoken_once(spark):
    """sums over the sentences read what was written, they don't cut, say and measure every sentence again."""
    from bookflow.operators.chapters import chapter_pipeline
    pages = spark.createDataFrame([("b", 0, 0, "One.\n\nthe end of the story. Next")], "book string, page long, page_off long, text string")
    marks = spark.createDataFrame([("b", 0, 1, "One.", 0, 0)], "book string, seq long, level int, title string, page long, off long")
    _, tl = chapter_pipeline(pages, marks, None, ["^[A-Za-z]+[.]$"], T.compile_rules([{"from": "the", "to": "the the"}]))
    assert "regexp" not in plan(tl) and "ArrowEvalPython" not in plan(tl) and "_samples" not in tl.columns
    assert [(r.t, r.dur) for r in tl.orderBy("i").collect()] == [("the end of the story.", 57931), ("Next", 8400)]


def test_notes_are_written_one_by_one(spark, monkeypatch):
    """no part that goes to a notes file holds several notes; its bytes are those of the gathered parts."""
    from bookflow.plans import document_queries, notes_queries
    seen, write = [], D.write_documents
    monkeypatch.setattr(D, "write_documents", lambda parts, *rest: (seen.append(parts), write(parts, *rest)))
    sf = "/root/testdata/sf0.001"
    document_queries.written_note_documents(spark, sf)
    assert "collect_list" not in plan(seen[0])
    assert seen[0].agg(F.max(F.size(F.split("text", '"exact":')))).first()[0] == 2
    whole = lambda d: {r.book: "".join(x.text for x in sorted(r.p)) for r in d.groupBy("book").agg(F.collect_list(F.struct("ch", "kind", "part", "text")).alias("p")).collect()}
    assert whole(seen[0]) == whole(notes_queries.note_document_parts(spark, sf))
