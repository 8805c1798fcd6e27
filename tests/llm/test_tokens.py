"""BPE and token files against the tokenizers library, and exact round trips."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs

from pyspark.sql import functions as F

from bookflow.llm import bpe, pieces, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.PrefixBPE(PATH)


ALPHABET = [*"aab'sstdrevml LL12 \n\t  .,!'¡é漢  　\u0085😀²ⅷ", "<|endoftext|>", "'ll", "'re", "  ", "ing", "tion", "\r\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_pieces_are_the_librarys(text):
    from tokenizers import Regex, pre_tokenizers
    want = [p for p, _ in pre_tokenizers.Split(Regex(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"), "isolated").pre_tokenize_str(text)]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = pieces.split(codes, np.array([0])).tolist()
    assert [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])] == want


@pytest.mark.parametrize("chunk", [23, 1 << 20])
def test_ids_are_the_librarys(library, own, chunk, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    r = random.Random(chunk)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(400)]
    cache = pieces.PieceCache(lambda ps: [own.encode(p.encode()) for p in ps])
    got = pieces.encode_texts(texts, cache, *pieces.specials(PATH))
    for t, x in zip(texts, got):
        want = library.encode(t, add_special_tokens=False).ids
        assert x.tolist() == want
        assert own.decode(x) == library.decode(want, skip_special_tokens=False) == t


def test_every_token_is_its_own_encoding(own):
    for i in own.ids:
        assert own.encode(own.bytes[i]) == [i]


def test_random_bytes(library, own):
    r = random.Random(5)
    for _ in range(300):
        word = "".join(r.choice("aeinorst") for _ in range(r.randrange(1, 30)))
        assert own.encode(word.encode()) == library.encode(word, add_special_tokens=False).ids


def test_equal_hashes_fall_back(own, monkeypatch):
    monkeypatch.setattr(pieces, "piece_hashes", lambda codes, starts, lengths, seed: (
        np.zeros(len(starts), np.uint64) if seed == 1 else codes[starts].astype(np.uint64)))
    cache = pieces.PieceCache(lambda ps: [own.encode(p.encode()) for p in ps])
    assert pieces.encode_texts(["one two three"], cache)[0].tolist() == [x for p in ("one", " two", " three") for x in own.encode(p.encode())]


def test_bpe_operator(spark, odd, none, library):
    rows = bpe.encode(odd, PATH).collect()
    texts = [r["text"] for r in odd.collect()]
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(ids)
        assert ids.tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
        assert r["score"] == "c" and r["_text"] == "c"
    assert bpe.encode(none, PATH).count() == 0


def test_token_files(spark, odd, none, library):
    manifest = token_files.write_token_files(odd, PATH, 2)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    docs = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    assert [r["doc_id"] for r in got] == [d for d, _ in docs]
    start = 0
    for r, (_, text) in zip(got, docs):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert zlib.crc32(r["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = token_files.read_token_files(manifest, [2, 7, 99]).collect()
    assert sorted(r["doc_id"] for r in some) == [2, 7, 7]
    assert token_files.read_token_files(token_files.write_token_files(none, PATH, 2)).count() == 0


def _file(tmp_path, docs):
    path = str(tmp_path / "shard.zst")
    with fs.LocalFileSystem().open_output_stream(path, compression=None) as out:
        w = token_files.ShardWriter(out)
        for d, ids in docs:
            w.add(d, ids)
        w.close()
    return path


def test_a_hot_id_is_dealt_over_shards(spark, library):
    """A third of all rows have no id, a third one id; shards that hold no wanted document aren't opened."""
    d = spark.range(900).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"),
                                F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(d, PATH, 2)
        shards = manifest.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shards) > 2 and max(r["n_docs"] for r in shards) < 600
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert len(rows) == 900 and [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    for r in shards:
        if r["first"] is None or not r["first"] <= 8 <= r["last"]:
            os.rename(r["path"], r["path"] + ".away")
    got = token_files.read_token_files(manifest, [8]).collect()
    assert [(r["doc_id"], r["start"]) for r in got] == [(r["doc_id"], r["start"]) for r in rows if r["doc_id"] == 8]


def test_readers_decompress_only_what_is_asked(tmp_path):
    r = np.random.default_rng(1)
    docs = [(d, r.integers(0, 50_000, 20_000).astype(np.uint32)) for d in range(60)]
    path = _file(tmp_path, docs)
    with fs.LocalFileSystem().open_input_file(path) as f:
        reader = token_files.ShardReader(f)
        (d, start, ids), = reader.documents({37})
        assert (d, start, reader.frames_read) == (37, 37 * 20_000, 1)
        assert np.array_equal(np.frombuffer(ids, "<u4"), docs[37][1])
        assert len(reader.directory) > 10
    # Any zstandard reader can read the whole file: skippable frames are skipped.
    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert len(whole) == sum(4 * len(x) for _, x in docs) + 60 * 17 + 4 * len(reader.directory)


def test_damage_is_seen(tmp_path):
    path = _file(tmp_path, [(1, np.arange(50_000, dtype=np.uint32))])
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 3] ^= 1
    open(path, "wb").write(raw)
    with fs.LocalFileSystem().open_input_file(path) as f, pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.ShardReader(f).documents())
    open(path, "wb").write(raw[:-1])
    with fs.LocalFileSystem().open_input_file(path) as f, pytest.raises((ValueError, struct.error)):
        token_files.ShardReader(f)
