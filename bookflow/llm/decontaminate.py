"""Benchmark decontamination: an FM-index per shard of training text, searched backwards for test phrases.

A shard is a bounded run of a partition's documents.  Its text, as a sequence of word codes, is indexed by its
Burrows-Wheeler transform with ranks from a wavelet matrix; all phrases are searched at once from their last word
to their first; occurrences are located by walking back to sampled suffix positions; overlapping ones merge into
removal spans.  Words that no phrase has can't be part of an occurrence: they end the indexed runs, and
runs shorter than the shortest phrase are left out, which changes no result.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import forget_worker_state, free_name, piece_hashes, ragged
from bookflow.settings import new_folder

WINDOW = 13            # words of a phrase
PERCENT = 20           # contaminated: at least one word in so many is hit
SHARD_BYTES = 2 << 20  # text under one index; a longer document has one to itself
PHRASE_BYTES = 4 << 20  # benchmark text in one phrase table
SAMPLE = 32            # every so many positions of a run keep their place


def _symbols() -> np.ndarray:
    """Bytes of words as themselves, A-Z as a-z, others as 0."""
    lut = np.zeros(256, np.uint8)
    lut[0x30:0x3A] = np.arange(0x30, 0x3A)
    lut[0x61:0x7B] = np.arange(0x61, 0x7B)
    lut[0x41:0x5B] = np.arange(0x61, 0x7B)
    lut[0x80:] = np.arange(0x80, 0x100)
    return lut


class Words:
    """Words of many texts: ``start`` and ``length`` in their joined bytes, and ``first``: the first word of each text."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        self.symbols = _symbols()[np.frombuffer(b"".join(texts), np.uint8)]
        word = np.concatenate([[False], self.symbols > 0, [False]])
        text = np.zeros(len(word), bool)         # a text begins here
        text[1 + self.edges] = True
        self.start = np.flatnonzero(word[1:-1] & (~word[:-2] | text[1:-1]))
        self.length = np.flatnonzero(word[1:-1] & (~word[2:] | text[2:])) + 1 - self.start
        self.first = np.searchsorted(self.start, self.edges)

    def hashes(self, seed: int, only: np.ndarray | None = None) -> np.ndarray:
        start, length = (self.start, self.length) if only is None else (self.start[only], self.length[only])
        return piece_hashes(self.symbols, start, length, seed)


class Phrases:
    """Distinct windows of benchmark items as word codes (from 1), by length, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        words = Words([(t or "").encode() for _, t in items])
        self.hash, at = np.unique(words.hashes(1), return_index=True)
        self.check = words.hashes(2)[at]
        codes = (np.searchsorted(self.hash, words.hashes(1)) + 1).tolist()
        found: dict[tuple[int, ...], set[str]] = {}
        for k, (item, _) in enumerate(items):
            own = codes[words.first[k]:words.first[k + 1]]
            for p in range(max(0, len(own) - window) + 1) if own else ():
                found.setdefault(tuple(own[p:p + window]), set()).add(item)
        ordered = sorted(found, key=lambda p: (len(p), p))
        self.items = [sorted(found[p]) for p in ordered]
        self.by_length: list[tuple[int, np.ndarray]] = []      # number of the first, their codes
        for n in sorted({len(p) for p in ordered}):
            own = [k for k, p in enumerate(ordered) if len(p) == n]
            self.by_length.append((own[0], np.array([ordered[k] for k in own], np.int32)))
        self.shortest = len(ordered[0]) if ordered else 0

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, hash=self.hash, check=self.check, items=np.frombuffer(json.dumps(self.items).encode(), np.uint8),
                 base=np.array([k for k, _ in self.by_length], np.int64), **{f"own{k}": own for k, (_, own) in enumerate(self.by_length)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, body: bytes) -> Phrases:
        got, out = np.load(io.BytesIO(body)), cls([])
        out.hash, out.check, out.items = got["hash"], got["check"], json.loads(got["items"].tobytes())
        out.by_length = [(int(k), got[f"own{n}"]) for n, k in enumerate(got["base"])]
        out.shortest = min((own.shape[1] for _, own in out.by_length), default=0)
        return out

    def codes(self, words: Words) -> np.ndarray:
        """Code of every word; 0 for those that no phrase has."""
        if not len(self.hash):
            return np.zeros(len(words.start), np.int32)
        h = words.hashes(1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        known = np.flatnonzero(self.hash[at] == h)
        known = known[self.check[at[known]] == words.hashes(2, known)]
        out = np.zeros(len(h), np.int32)
        out[known] = at[known] + 1
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; 0 is an end mark, each smaller than the next and than all else."""
    n = len(symbols)
    key = symbols.astype(np.int64) + n
    ends = np.flatnonzero(symbols == 0)
    key[ends] = np.arange(len(ends))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + 1, np.int64)             # place of the first suffix that is equal so far
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 1
    while True:
        single = new & np.append(new[1:], True)
        open_at = np.flatnonzero(~single)        # places in the order whose suffixes are not told apart
        if not len(open_at):
            return order
        pos = order[open_at]
        second = rank[np.minimum(pos + k, n)]
        group = rank[pos]
        by = np.lexsort((second, group))
        pos, second, group = pos[by], second[by], group[by]
        order[open_at] = pos
        new[open_at] = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank[pos] = np.maximum.accumulate(np.where(new[open_at], open_at, 0))
        k *= 2


class WaveletMatrix:
    """Ranks in a sequence of small numbers, level by level from the highest bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        now = values
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.origin = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = ones[at]
            at = np.where((value >> level) & 1, zeros + one, at - one)
        return at

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often value stands before the place."""
        return self._down(value, at) - self.origin[value]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at the place, and how often it stands before it."""
        value = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one, bit = ones[at], ones[at + 1] - ones[at]
            value = value * 2 + bit
            at = np.where(bit, zeros + one, at - one)
        return value, at - self.origin[value]


class FMIndex:
    """Of a sequence of codes from 1, in runs each ended by a 0."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.bwt = WaveletMatrix(symbols[order - 1].astype(np.int64), max(1, int(top).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        begins = np.concatenate([[True], symbols[:-1] == 0])
        kept = begins | (np.arange(self.n) % sample == 0)
        self.sampled = kept[order]
        self.place = np.where(self.sampled, order, 0)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k].astype(np.int64)
            lo[live] = self.before[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.before[c] + self.bwt.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back until a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            out[live[done]] = self.place[rows[live[done]]] + steps[live[done]]
            live = live[~done]
            c, before = self.bwt.access(rows[live])
            rows[live] = self.before[c] + before
            steps[live] += 1
        return out


def find(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in a shard: first word, number of words, phrase."""
    none = np.zeros(0, np.int64)
    codes = phrases.codes(words) if phrases.shortest else none
    n = len(codes)
    if not n:
        return none, none, none
    # Runs of known words within one text.
    known = codes > 0
    cut = np.zeros(n + 1, bool)
    cut[words.first] = True
    begins = np.flatnonzero(known & (cut[:-1] | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & (cut[1:] | ~np.append(known[1:], False))) + 1
    long = ends - begins >= phrases.shortest
    begins, sizes = begins[long], (ends - begins)[long]
    if not len(begins):
        return none, none, none
    word = ragged(begins, sizes + 1)             # one more: the end mark
    last = np.cumsum(sizes + 1) - 1
    symbols = codes[np.minimum(word, n - 1)]
    symbols[last] = 0
    index = FMIndex(symbols, len(phrases.hash))
    at, size, which = [none], [none], [none]
    for base, own in phrases.by_length:
        lo, hi = index.search(own)
        many = hi - lo
        at.append(word[index.locate(ragged(lo, many))])
        size.append(np.full(int(many.sum()), own.shape[1], np.int64))
        which.append(np.repeat(base + np.arange(len(own)), many))
    return np.concatenate(at), np.concatenate(size), np.concatenate(which)


def _shards(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with about SHARD_BYTES of text."""
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
        begin, size = 0, 0
        for k, t in enumerate(texts):
            if size and size + len(t) > SHARD_BYTES:
                yield batch.slice(begin, k - begin), texts[begin:k]
                begin, size = k, 0
            size += len(t)
        if texts:
            yield batch.slice(begin), texts[begin:]


def merge(spans: list) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _build_block(rows: pa.Table) -> pa.Table:
    """The phrase table of one block of items."""
    phrases = Phrases(list(zip(rows.column("i").to_pylist(), rows.column("t").to_pylist(), strict=True)))
    return pa.table({"block": rows.column("block").slice(0, 1), "body": pa.array([phrases.to_bytes()], pa.binary())})


def _read_block(folder: str, block: int) -> Phrases:
    """The phrase table of a block, from the file that a task wrote of it (none: no phrases)."""
    import pyarrow.dataset as ds
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(f"{folder}/block={block}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return Phrases([])
    found = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=True).to_table(columns=["body"])
    return Phrases.from_bytes(found.column(0)[0].as_py())


def _search(folder: str, blocks: int, out: dict[str, str], strip: str) -> Callable:
    """The result columns of each document: every shard is searched for one block of phrases after the other.

    Spans are code points of the text. A single block stays in the task's memory, of several one at a time does.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        only = _read_block(folder, 0) if blocks == 1 else None
        for batch, texts in _shards(batches, 0):
            words = Words(texts)
            hits: list[list[tuple[int, int]]] = [[] for _ in texts]
            found: list[set[str]] = [set() for _ in texts]
            for k in range(blocks):
                phrases = only or _read_block(folder, k)
                start, size, which = find(words, phrases)
                doc = np.searchsorted(words.first, start, "right") - 1
                for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True):
                    hits[d].append((s, s + n))
                for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                    found[d].update(phrases.items[w])
            n_words = np.diff(words.first).tolist()
            n_hit, spans, clean = [], [], []
            for d, own in enumerate(map(merge, hits)):
                n_hit.append(sum(e - s for s, e in own))
                base, t = int(words.edges[d]), texts[d]
                cut = [(int(words.start[s]) - base, int(words.start[e - 1] + words.length[e - 1]) - base) for s, e in own]
                spans.append([{"start": len(t[:a].decode()), "end": len(t[:b].decode())} for a, b in cut])
                if strip:
                    keep, last = [], 0
                    for a, b in cut:
                        keep.append(t[last:a])
                        last = b
                    clean.append(b"".join([*keep, t[last:]]).decode())
            items = [",".join(sorted(x)) for x in found]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            new = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                   "n_items": pa.array(map(len, found), pa.int64()),
                   "items_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in items], pa.string()),
                   "contaminated": pa.array([h > 0 and PERCENT * h >= n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_()),
                   "spans": pa.array(spans, span)}
            if strip:
                new[strip] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new.values()],
                                             [*batch.schema.names[1:], *(out[c] for c in new)])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", keep: list[str] | None = None, strip: str = "",
                  phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256, contaminated and spans (start, end: code points of the text to
    remove) to every row of ``docs``; with ``strip`` also a column of that name with the text without the spans.

    Lower-cases A-Z; words are runs of digits, letters a-z and everything beyond ASCII.  A phrase is 13
    consecutive words of an item; an item of fewer words, but not none, is one phrase.  A word inside any
    occurrence is hit.  n_items counts the items with occurring phrases, items_sha256 is over their ids, sorted as
    strings and joined by commas; contaminated if words are hit and they are at least one in 20.  Null
    and empty texts have no words; an item whose id is null counts under the empty id; items of one id are
    one.  ``keep`` names the columns to keep (default: all); of clashing names the new ones win.  Repeated rows
    come out repeated; an empty table or benchmark gives rows without hits.

    Documents are never moved.  Distinct benchmark rows are dealt into blocks of about ``phrase_bytes``; tasks write a phrase
    table of each to the shared folder, and the tasks that search read one after the other: the driver knows the folder only.
    """
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *([strip] if strip else [])]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    [src] = free_name(docs, "_src")
    rows = docs.select(docs[text].alias(src), *[docs[c] for c in kept])
    tests = benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("")).alias("i"), benchmark[item_text].alias("t")).distinct()
    total = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // phrase_bytes))
    folder = new_folder(docs.sparkSession, "phrases")
    (tests.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))).groupBy("block")
     .applyInArrow(_build_block, "block bigint, body binary").write.partitionBy("block").parquet(folder))
    kinds = dict(zip(names, ["bigint", "bigint", "bigint", "string", "boolean", "array<struct<start:int,end:int>>", "string"]))  # noqa: B905
    plain = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != src),
                       *(f"`{n}` {k}" for n, k in kinds.items())])
    return rows.mapInArrow(_search(folder, blocks, {n: n for n in names}, strip), plain)
