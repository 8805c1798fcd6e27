"""Blocked scans and folds against plain Python, with one key holding most of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import scan
from bookflow.operators.structure import fixed_sections, thin_markers
from bookflow.operators.lookup import asof_grid, asof_scan, substring_join


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    return [("hot" if r.random() < 0.7 else f"k{r.randrange(5)}", i, r.randrange(9), r.random() < 0.3)
            for i in range(600)]


def _by_key(rows):
    out = {}
    for k, i, v, b in sorted(rows, key=lambda x: x[1]):
        out.setdefault(k, []).append((i, v, b))
    return out


def test_scans(spark, rows):
    df = spark.createDataFrame(rows, "k string, i long, v long, b boolean")
    blk = F.floor(F.col("i") / 10)
    d = scan.prefix_sum(df, ["k"], ["i"], blk, before=F.col("v"))
    d = scan.row_index(d, ["k"], ["i"], blk, "pos")
    d = scan.prefix_max(d, ["k"], ["i"], blk, top=F.col("v"))
    d = scan.last_value(d, ["k"], ["i"], blk, seen=F.when(F.col("b"), F.col("v")))
    d = scan.prev_value(d, ["k"], ["i"], blk, pv=F.col("v"))
    d = scan.next_value(d, ["k"], ["i"], blk, nv=F.col("v"))
    got = {(r.k, r.i): (r.before, r.pos, r.top, r.seen, r.pv, r.nv) for r in d.collect()}
    for k, xs in _by_key(rows).items():
        seen = None
        for p, (i, v, b) in enumerate(xs):
            seen = v if b else seen
            vs = [x[1] for x in xs]
            assert got[k, i] == (sum(vs[:p]), p, max(vs[:p], default=None), seen,
                                 vs[p - 1] if p else None, vs[p + 1] if p + 1 < len(vs) else None)


def test_sessions(spark, rows):
    df = spark.createDataFrame(rows, "k string, i long, v long, b boolean")
    got = {(r.k, r.i): r.n for r in scan.sessions(df, ["k"], "i", 3, F.floor(F.col("i") / 7), "n").collect()}
    for k, xs in _by_key(rows).items():
        n, last = -1, None
        for i, _, _ in xs:
            n += last is None or i - last > 3
            last = i
            assert got[k, i] == n


def test_finite_state_over_many_super_blocks(spark, rows):
    df = spark.createDataFrame(rows, "k string, i long, v long, b boolean").withColumn("v", F.col("v").cast("int"))

    def step(s, row):
        t = s + row[0]
        return np.where(t >= 20, 0, t)

    d = scan.finite_state(df, ["k"], ["i"], F.floor(F.col("i") / 10), ["v"], 20, step, name="s", fan=4)
    got = {(r.k, r.i): r.s for r in d.collect()}
    for k, xs in _by_key(rows).items():
        acc = 0
        for i, v, _ in xs:
            assert got[k, i] == acc
            acc = 0 if acc + v >= 20 else acc + v


def test_sections_restart_at_zero(spark):
    r = random.Random(3)
    rows = [("b", p, k, r.randrange(1, 90)) for p in range(1200) for k in range(2)]
    df = spark.createDataFrame(rows, "book string, page long, k int, w int")
    got = {(x.page, x.k): (x.section, x.closes) for x in fixed_sections(df).collect()}
    n = acc = 0
    for _, p, k, w in rows:
        acc += w
        assert got[p, k] == (n, acc >= 1400)
        if acc >= 1400:
            n, acc = n + 1, 0


def test_thin_markers_keeps_by_the_last_kept(spark):
    offs = [0, 150, 300, 450, 460, 900, 1099, 1100, 1300]
    df = spark.createDataFrame([("b", i, o) for i, o in enumerate(offs)], "book string, seq long, off long")
    assert sorted(r.off for r in thin_markers(df, 200).collect()) == [0, 300, 900, 1100, 1300]


def test_asof(spark):
    r = random.Random(5)
    st = sorted({round(r.uniform(0, 5000), 1) for _ in range(80)})
    starts = [("b", s, i) for i, s in enumerate(st)] + [("one", 3.0, 0)]
    probes = [(n, "b", t) for n, t in enumerate([-1.0, 0.0, st[0], st[-1], 9e9] + [r.uniform(-10, 5100) for _ in range(300)])]
    probes += [(1000, "one", 2.9), (1001, "one", 3.0), (1002, "none", 1.0)]
    s = spark.createDataFrame(starts, "k string, s double, i int")
    p = spark.createDataFrame(probes, "n int, k string, t double")
    got = {x.n: x.i for x in asof_grid(p, s, ["k"], "t", "s", "i").collect()}
    alt = {x.n: x.i for x in asof_scan(p, s, ["k"], "t", "s", ["i"], 100.0).collect()}
    for n, k, t in probes:
        want = max([i for kk, ss, i in starts if kk == k and ss <= t], default=-1)
        assert got[n] == want
        assert (alt[n] if alt[n] is not None else -1) == want


def test_active_sentence_boundaries(spark):
    s = spark.createDataFrame([("b", 0, 0.0), ("b", 1, 2.0), ("b", 2, 5.0)], "k string, i int, s double")
    probes = [-0.5, 0.0, 1.9, 2.0, 4.9, 5.0, 999.0]
    p = spark.createDataFrame([("b", t) for t in probes] + [("empty", 1.0)], "k string, t double")
    got = {(r.k, r.t): r.i for r in asof_grid(p, s, ["k"], "t", "s", "i").collect()}
    assert [got["b", t] for t in probes] == [-1, 0, 0, 1, 1, 2, 2]
    assert got["empty", 1.0] == -1


def test_substring_join(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abc \n") for _ in range(r.randrange(0, 60))) for _ in range(60)]
    needles = ["", "a", "ab", "cab", "abcabca", "\n", "zz", "a b", "bb\na"] + [texts[i][3:15] for i in range(8)]
    it = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    nd = spark.createDataFrame([(n,) for n in dict.fromkeys(needles)], "q string")
    got = {(r.id, r.q) for r in substring_join(it, nd, "x", "q", ["id"]).collect()}
    assert got == {(i, q) for i, t in enumerate(texts) for q in needles if q and q in t}


@pytest.mark.parametrize("n", [1, 256, 257, 5000])
@pytest.mark.parametrize("keyed", [False, True])
def test_substring_join_of_any_number_of_needles(spark, n, keyed, monkeypatch):
    from bookflow.operators import lookup
    monkeypatch.setattr(lookup, "NEEDLE_CHARS", 20_000)
    monkeypatch.setattr(lookup, "TEXT_CHARS", 4_000)
    r = random.Random(n)
    texts = [("hot" if i % 3 else f"k{i % 5}", i, " ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(0, 60)))) for i in range(150)]
    needles = [("hot" if i % 2 else "k0", f"w{i} " if i % 4 else f"w{i} w{(i * 7) % 3000}") for i in range(n)]
    it = spark.createDataFrame([*texts, ("none", 999, "w1 w2"), ("k0", 1000, None)], "k string, id int, x string")
    nd = spark.createDataFrame(needles, "k string, q string")
    if keyed:
        got = {(x.id, x.q) for x in substring_join(it, nd, "x", "q", ["id"], ["k"]).collect()}
        assert got == {(i, q) for k, i, t in texts for kk, q in needles if k == kk and q in t}
    else:
        got = {(x.id, x.q) for x in substring_join(it, nd.select("q"), "x", "q", ["id"]).collect()}
        assert got == {(i, q) for _, i, t in [*texts, (0, 999, "w1 w2")] for _, q in needles if q in t}


def test_reset_sum_is_the_fold(spark):
    r = np.random.default_rng(4)
    for limit, states, forced in ((20, 20, False), (20, 21, True), (1, 1, False), (300, 301, True)):
        def step(s, row):
            t = s + row[0]
            return np.where((t >= limit) | (len(row) > 1 and row[1] == 1), 0, np.minimum(t, limit))
        for n in (1, 2, 50, 400):
            x = r.integers(0, 9, (n, 1))
            x = np.concatenate([x, r.random((n, 1)) < 0.05], axis=1).astype(int) if forced else x
            plain, quick = scan.Stepwise(step, states), scan.ResetSum(limit, states)
            assert plain.table(x).tolist() == quick.table(x).tolist()
            for e in {0, states - 1, states // 2}:
                assert plain.states(x, e).tolist() == quick.states(x, e).tolist()


def test_folds_take_many_groups_at_a_time(spark):
    """Groups of all lengths, cut by batches of three rows, without a call for each of them."""
    rng = np.random.default_rng(5)
    rows = [(k, None if k == 3 else f"b{k % 5}", i, int(v)) for k in range(12) for i, v in enumerate(rng.integers(0, 9, [1, 2, 3, 7, 40][k % 5]))]
    df = spark.createDataFrame(rows, "k long, b string, i long, v int").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        d = scan.finite_state(df.where("b IS NOT NULL"), ["k", "b"], ["i"], F.floor(F.col("i") / 4), ["v"], 20, scan.ResetSum(20, 20), name="s", fan=2)
        assert "FlatMapGroupsInPandas" not in d._jdf.queryExecution().toString()
        got = {(r["k"], r["i"]): r["s"] for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want, s, last = {}, 0, None
    for k, b, i, v in rows:
        s = 0 if k != last else s
        if b is not None:
            want[k, i] = s
        s, last = (0 if s + v >= 20 else s + v), k
    assert got == want
