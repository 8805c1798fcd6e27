"""Documents as files: whole after a commit, nothing after a failure, whatever way they are cut."""

import os

import pytest
from pyspark.sql import functions as F

from bookflow.operators import scan
from bookflow.sources import documents as D


def parts(spark, books=5, n=40):
    return spark.range(books * n).select(
        F.concat(F.lit("böok/"), F.floor(F.col("id") / n).cast("string"), F.lit(" %")).alias("book"), (F.col("id") % n - 1).alias("ch"), F.lit(0).alias("kind"),
        F.concat(F.lit("part "), F.col("id").cast("string"), F.lit(" – "), F.repeat(F.lit("xyz\r\n"), (F.col("id") % 7).cast("int"))).alias("text"))


def expected(d, end):
    out = {}
    for r in d.orderBy("book", "ch", "kind").collect():
        out[r["book"]] = out.get(r["book"], "") + r["text"] + end
    return out


def read(spark, path, name="doc.txt", chars=50):
    out = {}
    for r in D.read_blocks(spark, path, name, chars).orderBy("document", "block").collect():
        out[r["document"]] = out.get(r["document"], "") + r["text"]
    return out


@pytest.mark.parametrize("segment", [1, 300, 1 << 20])
def test_written_and_read_back(spark, tmp_path, segment):
    d, path = parts(spark), f"file://{tmp_path}/docs"
    D.write_documents(d.repartition(7), path, "doc.txt", "\n", segment_bytes=segment)
    assert read(spark, path) == expected(d, "\n")
    files = [os.path.join(a, x) for a, _, xs in os.walk(tmp_path) for x in xs if not x.endswith(".crc")]
    assert (len(files) == 200) if segment == 1 else len(files) >= 5
    blocks = D.read_blocks(spark, path, "doc.txt", 50).groupBy("document").agg(F.max("block").alias("last"), F.count("*").alias("n"))
    assert blocks.where("n <> last + 1").count() == 0


def test_append_and_overwrite(spark, tmp_path):
    d, path = parts(spark, 2), str(tmp_path / "docs")
    D.write_documents(d.where("book LIKE '%0 %'"), path, "doc.txt")
    D.write_documents(d.where("book LIKE '%1 %'"), path, "doc.txt")
    assert read(spark, path) == expected(d, "")
    D.write_documents(d.where("book LIKE '%1 %'"), path, "doc.txt", mode="overwrite")
    assert list(read(spark, path)) == ["böok/1 %"] and len(os.listdir(path)) == 1


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "docs")
    d = parts(spark)
    bad = d.withColumn("text", F.when((F.col("book") == "böok/3 %") & (F.col("ch") == 30), F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        D.write_documents(bad, path, "doc.txt", segment_bytes=1)
    assert [x for _, _, xs in os.walk(path) for x in xs] == []
    D.write_documents(d, path, "doc.txt")
    assert read(spark, path) == expected(d, "")


def test_commit_leaves_out_what_lost_attempts_wrote(tmp_path):
    w = D.DocumentWriter(str(tmp_path), "doc.txt", False, 1 << 20)
    for folder in ("000001-5", "000001-9", "000002-6"):
        os.makedirs(f"{w.staging}/{folder}/book")
        open(f"{w.staging}/{folder}/book/doc.txt", "w").write(folder)
    w.commit([D.TaskFiles("000001-9"), D.TaskFiles("000002-6"), D.TaskFiles("")])
    assert sorted(os.listdir(f"{tmp_path}/{w.write_id}")) == ["000001-9", "000002-6"] and len(os.listdir(tmp_path)) == 1


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    D.write_documents(parts(spark).where("false"), path, "doc.txt")
    assert [x for _, _, xs in os.walk(path) for x in xs if not x.endswith(".crc")] == []


def test_places_in_a_hot_order(spark):
    """All rows of one key at one place of the order still spread over ranges."""
    d = spark.range(5000).select(F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 9).cast("string"))).alias("k"), F.lit(1).alias("a"), (F.col("id") * 7919 % 5003).alias("b"))
    got = scan.row_index_sorted(d.repartition(6), ["k"], ["a", "b"], "n").collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["b"], r["n"]))
    assert len(got) == 5000 and all([n for _, n in sorted(x)] == list(range(len(x))) for x in by.values())


def test_lines_of_documents(spark, tmp_path, monkeypatch):
    """Lines come back as they were written, empty ones too, whatever chunks files are read in."""
    from bookflow.operators import export
    from bookflow.sources import listing
    monkeypatch.setattr(listing, "CHUNK", 3)
    rows = [("a b+ü", -1, "top\n"), ("a b+ü", 0, "one é\n\ntwo"), ("c", -1, ""), ("c", 5, "x" * 20 + "\r y")]
    export.write_parts(spark.createDataFrame(rows, "book string, ch long, text string"), f"file://{tmp_path}/lines", ("ch",))
    got = sorted((r["book"], r["line"]) for r in export.read_lines(spark, f"file://{tmp_path}/lines").collect())
    assert got == sorted([("a b+ü", x) for x in ("top", "", "one é", "", "two")] + [("c", ""), ("c", "x" * 20 + "\r y")])


def test_notes_are_parsed_once_for_each_form(spark):
    from bookflow.sources.files import parse_notes
    docs = [("b", '[{"id":"1"},null]'), ("c", '{"book":"z","notes":[{"id":"2"}]}'), ("d", "[]"), ("e", "x"), ("f", None)]
    p = parse_notes(spark.createDataFrame(docs, "book string, doc string"), "book", "doc")
    assert p._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2
    assert sorted((r["book"], r["seq"], r["id"]) for r in p.collect()) == [("b", 0, "1"), ("b", 1, None), ("z", 0, "2")]


@pytest.mark.parametrize("segment", [300, 1 << 20])
def test_packed_documents(spark, tmp_path, segment):
    """packed files hold a fraction of their text, and give it back in order however they are cut."""
    d, path = parts(spark).withColumn("text", F.concat("text", F.repeat(F.lit("again "), 200))), f"file://{tmp_path}/docs"
    D.write_documents(d.repartition(7), path, "doc.txt", "\n", segment_bytes=segment, packed=True)
    assert read(spark, path) == expected(d, "\n")
    files = [os.path.join(a, x) for a, _, xs in os.walk(tmp_path) for x in xs if x.startswith("doc.txt")]
    assert all(f.endswith(".zst") for f in files)
    assert sum(map(os.path.getsize, files)) * 3 < sum(len(x.encode()) for x in expected(d, "\n").values())


def test_notes_documents_are_packed(spark, monkeypatch):
    """the notes of a book, written as a document, don't lie on the disks as plain text."""
    from bookflow.plans import document_queries
    seen, write = [], D.write_documents
    monkeypatch.setattr(D, "write_documents", lambda parts, *rest: (seen.append(rest), write(parts, *rest)))
    document_queries.written_note_documents(spark, "/root/testdata/sf0.001")
    assert seen[0][1:] == ("notes.json", "", True)


def test_one_copy_of_the_texts_stays(spark, tmp_path):
    """of the cleaned pages one copy lies on the disks, and what a staged write has shuffled goes when it ends."""
    from bookflow import settings
    from bookflow.plans import inputs
    d = spark.createDataFrame([(k, f"b{k % 3}", f"Page {k}.\nIt ends here.") for k in range(20)], "doc_id bigint, source string, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(settings._staged)
    got = inputs.corpus(spark, str(tmp_path))
    assert got.count() == 20 and got.agg(F.max("page")).first()[0] == 6
    new = set(settings._staged) - before
    assert not any("clean_pages" in p for p in new) and sum("corpus" in p for p in new) == 1
    assert not [x for x in os.listdir(settings.work_dir(spark)) if x.startswith("clean_pages") and f"{settings.work_dir(spark)}/{x}" not in before]
    assert spark.conf.get(settings.CLEANUP) == "false"
