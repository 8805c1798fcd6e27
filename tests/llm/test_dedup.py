"""SimHash, decontamination and chat collapse against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from bookflow.llm import chat, decontaminate, simhash


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(ids, linked):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(i)
    return [min((ids[j] for j in groups[find(i)] if ids[j] is not None), default=None) for i in range(len(ids))]


def test_masks_cover_every_pair_within_the_radius():
    r = random.Random(1)
    for radius in (2, 4):
        tables = simhash.masks(64, radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            diff = sum(1 << b for b in r.sample(range(64), radius))
            assert any(diff & m == 0 for m in tables)


@pytest.mark.parametrize("block", [8192, 5])
def test_links_and_components(spark, block):
    r = random.Random(block)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 3, 60])):
            fps.add(x)
            for b in r.sample(range(64), r.randrange(6)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    got = {x["node"]: x["root"] for x in simhash.components(simhash.links(df, 4, block)).collect()}
    want = _components(signed, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert {s: got.get(s, s) for s in signed} == dict(zip(signed, want))


def test_near_duplicates(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    fps = [_fingerprint(t) if len(t or "") < 9999 else simhash.fingerprint(t) for _, t in rows]
    comp = _components([d for d, _ in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    want = collections.Counter((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comp))
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(none).count() == 0


def test_long_texts_add_up_slices(monkeypatch):
    text = " ".join(str(k * 7919 % 1009) for k in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 100)
    assert simhash.fingerprint(text) == whole == _fingerprint(text)


# ---- decontamination ---------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hits(docs, items):
    low = lambda t: WORD.findall((t or "").encode().lower())
    windows = collections.defaultdict(set)
    for item, t in items:
        w = low(t)
        for p in range(max(0, len(w) - 13) + 1) if w else ():
            windows[tuple(w[p:p + 13])].add(item)
    for doc, t in docs:
        w, hit, found = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p:p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[k]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def tested():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["Él", "ñu", "A1"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.choice([1, 3, 5, 13, 14, 40]))) for k in range(12)] + [(50, None), (51, " ..! "), (2, say(20))]
    docs = []
    for k in range(60):
        parts = [say(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            w = (r.choice(items)[1] or "").split()
            a = r.randrange(len(w) + 1)
            parts += [" ".join(w[a:a + r.randrange(30)]).upper(), say(r.randrange(20))]
        docs.append((k, r.choice([" ", "\n", "; "]).join(parts)))
    return docs + [(100, None), (101, ""), (102, docs[3][1] * 40), (None, docs[4][1]), (5, docs[5][1])], items


@pytest.mark.parametrize("shard,phrase_bytes", [(8 << 20, 4 << 20), (900, 400)])
def test_contamination(spark, tested, shard, phrase_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    docs, items = tested
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id int, text string"),
                                      spark.createDataFrame(items * 3, "item_id int, text string"), strip="clean", phrase_bytes=phrase_bytes).collect()
    text = dict(docs)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == \
        collections.Counter(_hits(docs, [(str(i), t) for i, t in items]))
    for r in got:
        t = r["text"] or ""
        cut = [t[s["start"]:s["end"]] for s in r["spans"]]
        assert sum(len(WORD.findall(c.encode().lower())) for c in cut) == r["n_hit"]
        assert len(r["clean"]) == len(t) - sum(map(len, cut))
    assert text


def test_contamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (None, "est assis devant la porte"), (3, None)], "item_id int, text string")
    got = decontaminate.contamination(odd, bench)
    assert got.count() == odd.count() and dict(got.dtypes)["spans"].startswith("array")
    by = {r["doc_id"]: r for r in got.where("doc_id in (1, 2, 3)").collect()}
    assert by[1]["contaminated"] and by[1]["n_hit"] == 6 and not by[2]["contaminated"] and by[3]["n_words"] == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0


def test_suffix_order_and_index():
    r = np.random.default_rng(2)
    for top in (1, 2, 5):
        runs = [np.append(r.integers(1, top + 1, r.integers(1, 40)), 0) for _ in range(30)] * 2
        s = np.concatenate(runs).astype(np.int32)
        ends = iter(range(-len(s), 0))
        keyed = [int(x) if x else next(ends) for x in s]
        order = decontaminate.suffix_order(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: keyed[i:])
        index = decontaminate.FMIndex(s, top, sample=4)
        for n in (1, 3):
            phrases = r.integers(1, top + 1, (20, n))
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases.tolist(), lo, hi):
                want = [i for i in range(len(s)) if s[i:i + n].tolist() == p]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ---- chat -------------------------------------------------------------------------------------

def _maximal(turns):
    convs = collections.defaultdict(list)
    for c, t, role, text in turns:
        convs[c].append((t, role, text))
    said = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))] for c, v in convs.items()}
    first = lambda c: (c is not None, c or 0)
    return {c: len(s) for c, s in said.items() if not any(
        o != c and x[:len(s)] == s and (len(x) > len(s) or first(o) < first(c)) for o, x in said.items())}


def test_collapse_and_render(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS_IN_BLOCK", 2)
    r = random.Random(8)
    turns = []
    for c in range(60):
        n = r.randrange(1, 12)
        base = r.randrange(4)
        turns += [(c, t, "user" if t % 2 == 0 else "assistant", f"{base}-{t if t < 8 else r.randrange(3)}") for t in range(n)]
    turns += [(100, -3, None, None), (100, 5000, "user", ""), (None, 0, "user", "alone"), (101, None, "user", "no turn"), (101, 0, "user", "x"),
              (102, 0, " System ", "a<|im_end|>b"), (103, 0, "user", None), (104, 0, "user", "")]
    df = spark.createDataFrame([(*t, "c") for t in turns], "conv_id int, turn int, role string, text string, n_turns string")
    got = chat.render(df).collect()
    want = _maximal(turns)
    assert {g["conv_id"]: g["n_turns"] for g in got} == want
    assert collections.Counter((g["conv_id"], g["turn"]) for g in got) == collections.Counter((c, t) for c, t, _, _ in turns if c in want)
    by = {(g["conv_id"], g["turn"]): g["rendered"] for g in got}
    assert by[102, 0] == "<|im_start|>system\na< |im_end|>b<|im_end|>\n"
    assert by[100, -3] == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.render(df.limit(0)).count() == 0


def test_repeated_turns_are_turns(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a")], "conv_id int, turn int, role string, text string")
    assert {g["conv_id"]: g["n_turns"] for g in chat.render(df).collect()} == {1: 2}
