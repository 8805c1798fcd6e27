"""Sharding, fill-in-middle and clustering: against plain versions, exact inverses, and odd tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.llm import clustering, fim, sharding

KEY = "k"


# ---- sharding ---------------------------------------------------------------------------------

def plain_permutation(rows: int, key: str = KEY) -> list[int]:
    """The walk on Python integers."""
    a = max(1, math.ceil(math.sqrt(rows)))
    b = (rows + a - 1) // a

    def once(x: int) -> int:
        lo, hi = x % a, x // a
        for i in range(sharding.ROUNDS):
            drawn = int(hashlib.sha256(f"{key}:{i}:{hi if i % 2 == 0 else lo}".encode()).hexdigest()[:sharding.HEX], 16)
            lo, hi = ((lo + drawn) % a, hi) if i % 2 == 0 else (lo, (hi + drawn) % b)
        return hi * a + lo
    out = []
    for x in range(rows):
        x = once(x)
        while x >= rows:
            x = once(x)
        out.append(x)
    return out


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 17, 1000, 4099])
def test_permutation(spark, rows):
    got = [r[0] for r in spark.range(rows).select(sharding.permute(F.col("id"), F.lit(rows).cast("bigint"), KEY)).collect()]
    assert got == plain_permutation(rows)
    assert sorted(got) == list(range(rows))


def test_row_at_is_the_inverse(spark):
    rows = spark.range(997).withColumn("n", F.lit(997).cast("bigint")).withColumn("place", sharding.permute(F.col("id"), F.col("n"), KEY))
    back = sharding.row_at(F.pmod("place", F.lit(8)), F.call_function("div", "place", F.lit(8)), F.col("n"), 8, KEY)
    assert rows.where(back != F.col("id")).count() == 0


def test_large_numbers(spark):
    rows = F.lit(10**15).cast("bigint")
    d = spark.range(2000).select((F.col("id") * 499_999_999_999).alias("x")).where("x < 1000000000000000")
    out = d.withColumn("y", sharding.permute(F.col("x"), rows, KEY)).withColumn("z", sharding.permute(F.col("y"), rows, KEY, forth=False))
    assert out.where("y < 0 OR y >= 1000000000000000 OR x <> z").count() == 0
    assert out.select("y").distinct().count() == d.count()


def order(d):
    return [d["doc_id"], F.sha2(d["text"], 256)]


def test_split_of_the_table_does_not_matter(spark):
    d = spark.range(3000).select(F.pmod("id", F.lit(700)).alias("doc_id"), F.concat(F.lit("t"), F.pmod("id", F.lit(900))).alias("text"))
    one, many = (sorted(map(tuple, sharding.deal(x, 8, KEY, order(x)).collect())) for x in (d.coalesce(1), d.repartition(13)))
    assert one == many
    by = Counter(r[2] for r in one)
    assert max(by.values()) - min(by.values()) <= 1
    for s, n in by.items():
        assert sorted(r[3] for r in one if r[2] == s) == list(range(n))
    ranked = sorted([(r[0], hashlib.sha256(r[1].encode()).hexdigest(), r[2] + 8 * r[3]) for r in one])
    places = plain_permutation(3000)
    rank = Counter()
    want = Counter()
    for (i, h, place), w in zip(ranked, places, strict=True):
        rank[(i, h, place)] += 1
        want[(i, h, w)] += 1
    assert rank == want


def test_one_row_repeated(spark):
    """Rows that nothing tells apart are a third of all, and get places of their own."""
    d = spark.range(6000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    out = sharding.deal(d, 8, KEY, order(d))
    assert out.select("shard", "slot").distinct().count() == 6000
    assert out.where("doc_id = 7").groupBy("shard").count().count() == 8


def test_odd_rows_are_dealt(spark, odd, none):
    d = odd.withColumn("shard", F.lit("old")).withColumn("_row", F.lit(1))
    got = sharding.deal(d, 3, KEY, order(d))
    assert got.columns == [*odd.columns, "_row", "shard", "slot"]
    rows = got.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert Counter((r["shard"]) for r in rows) == {0: 4, 1: 4, 2: 4}
    assert sharding.deal(none, 3, KEY, order(none)).count() == 0


def test_written_shards_are_in_slot_order(spark, odd, tmp_path):
    d = odd.select("doc_id", "text")
    sharding.write_shards(sharding.deal(d, 3, KEY, order(d)), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(repr, back.select("doc_id", "text").collect())) == sorted(map(repr, d.collect()))
    for s in range(3):
        slots = [r["slot"] for r in spark.read.parquet(str(tmp_path / "shards" / f"shard={s}")).coalesce(1).collect()]
        assert slots == list(range(4))


# ---- fill in the middle -----------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n, h = len(tokens), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def checked_fim(d):
    out = fim.untransform(fim.transform(d))
    rows = out.collect()
    for r in rows:
        want = plain_fim(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["output_sha256"] == sha(want[4])
        assert r["restored"] == (r["text"] or "") and r["restored_sha256"] == sha(r["text"] or "")
        marks = b"<P><S><M>"
        data = (r["text"] or "").encode()
        assert b"".join((marks if p["buffer"] else data)[p["start"]:p["start"] + p["length"]] for p in r["pieces"]).decode() == want[4]
    return rows


def test_fim_of_odd_rows(spark, odd, none):
    rows = checked_fim(odd.withColumn("form", F.lit("old")).withColumn("output", F.lit(1)))
    assert len(rows) == odd.count()
    assert [c for c in fim.transform(odd).columns if c in odd.columns] == odd.columns
    assert fim.untransform(fim.transform(none)).count() == 0


def test_fim_texts(spark):
    parts = ["a", " ", "\t", "\n", "ä", " ", "\U0001F600", "word", "<P", ">", "<M", "é", "\x0b", "\x1f", "<S>"]
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(parts, rng.integers(0, 30), p=[*[.07] * 14, .02]))) for i in range(1500)]
    forms = Counter(r["form"] for r in checked_fim(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert set(forms) == {"plain", "spm", "psm"} and forms["spm"] > 2 * forms["psm"]


def test_cut_and_arrange():
    p = [fim.Piece(0, 0, 4), fim.Piece(0, 10, 3)]
    assert fim.cut(p, 2, 5) == [[fim.Piece(0, 0, 2)], [fim.Piece(0, 2, 2), fim.Piece(0, 10, 1)], [fim.Piece(0, 11, 2)]]
    assert fim.cut([], 0, 0) == [[], [], []]
    assert fim.cut(p, 0, 7) == [[], p, []]


# ---- clustering -------------------------------------------------------------------------------

def plain_clusters(rows, k=8, rounds=10, seed="3"):
    """Lloyd's rounds on Python integers; rows of (id, integers)."""
    keyed = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in rows)
    centroids = [list(q) for _, q in keyed[:k]]

    def assign():
        out = []
        for _, q in rows:
            far = [sum((int(a) - int(b)) ** 2 for a, b in zip(q, c, strict=True)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out
    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            mine = [q for (_, q), (c, _) in zip(rows, own, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    per = Counter()
    for c, d in own:
        per[c] += d
    return sorted((str(i), c, d, per[c], sum(per.values()), sha(",".join(map(str, centroids[c])))) for (i, _), (c, d) in zip(rows, own, strict=True))


def clustered(spark, rows, **more):
    d = spark.createDataFrame([(i, [v / 1024 for v in q]) for i, q in rows], "vec_id bigint, embedding array<double>")
    out = clustering.cluster(d, 8, more.pop("rounds", 10), "3", **more).drop("embedding")
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (20, 64))
    t = clustering.transform(x)
    assert ((t[0] - t[1]) ** 2).sum() == 64 * ((x[0] - x[1]) ** 2).sum()
    back = np.zeros_like(t)
    back[:, clustering.ORDER] = t
    again = np.zeros_like(t)
    again[:, clustering.ORDER] = clustering.transform(back)
    assert (again == 64 * x).all()


@pytest.mark.parametrize("spread", [2, 300, 1 << 18, 1 << 25])
def test_search_finds_the_first_nearest(spread):
    rng = np.random.default_rng(spread)
    x, c = rng.integers(-spread, spread, (400, 64)), rng.integers(-spread, spread, (8, 64))
    c[5] = c[2]                                       # a tie
    x[:20] = c[2]
    kind = object if spread > clustering.WIDE else np.int64
    cluster, far = clustering.nearest(clustering.transform(x).astype(kind), clustering.transform(c).astype(kind))
    d = ((x[:, None, :].astype(object) - c[None, :, :].astype(object)) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (far == 64 * d.min(axis=1)).all()
    assert (cluster[:20] == 2).all()


@pytest.mark.parametrize("spread", [1, 400, 1 << 24])
def test_clusters(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(i, rng.integers(-spread, spread + 1, 64).tolist()) for i in range(150)]
    assert clustered(spark, rows, rounds=4) == plain_clusters(rows, rounds=4)


def test_repeated_vectors_and_ids(spark):
    rng = np.random.default_rng(9)
    q = [rng.integers(-50, 50, 64).tolist() for _ in range(6)]
    rows = [(i % 7 if i % 3 else None, q[i % 6]) for i in range(90)]
    assert clustered(spark, rows) == plain_clusters(rows)
    few = rows[:3]
    assert clustered(spark, few) == plain_clusters(few)


def test_unusable_vectors_and_clashing_names(spark):
    good = [1.5] * 64
    rows = [(1, good, "x"), (2, None, "x"), (3, good[:63], "x"), (4, [*good[:63], None], "x"), (5, [*good[:63], math.nan], "x"),
            (6, [*good[:63], math.inf], "x"), (7, [], "x"), (None, [-2.25] * 64, None), (1, good, "x")]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, distance string").withColumn("_q", F.lit(1)).withColumn("other", F.lit("o"))
    out = clustering.cluster(d, 8, 10, "3")
    assert out.columns == ["vec_id", "embedding", "_q", "other", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r["vec_id"]), r["distance"], r["other"]) for r in out.collect()) == [("1", 0, "o"), ("1", 0, "o"), ("None", 0, "o")]
    assert clustering.cluster(d.where("false"), 8, 10, "3").count() == 0
    with pytest.raises(Exception, match="clustering"):
        clustering.cluster(spark.createDataFrame([(1, [1e300] * 64)], "vec_id bigint, embedding array<double>"), 8, 1, "3").count()
