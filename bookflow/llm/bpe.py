"""Byte-level BPE by dynamic programming over prefixes, and the way back from ids to text.

The last token of a prefix's encoding is unique, and token ``t`` is the last one of the prefix
that ends at ``i`` exactly when it ends there and the last token of what precedes it can stand
before it: encoding the two together gives the two.  So one pass over a piece stores a last
token for every prefix, and the back-pointers give its ids.  Which tokens end at a place is read
off a suffix automaton of the vocabulary: its state is the longest text read last that occurs in
any token, and its suffix links lead to the shorter ones.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bookflow.llm.common import free_name, ragged, worker_state
from bookflow.llm.pieces import PieceCache, encode_texts, specials

#: Pair tests a worker remembers; beyond it starts afresh, which costs time, not results.
PAIRS = 150_000


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable bytes for themselves,
    the others for 256 onwards, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class SuffixAutomaton:
    """All substrings of a set of byte strings.  ``word[s]``: the string that is state s's longest, or -1."""

    def __init__(self, words: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends = [self._add(w) for w in words]
        self.word = [-1] * len(self.next)
        for k, s in enumerate(ends):
            self.word[s] = k
        # above[s]: the nearest state on the way of suffix links whose longest string is a word.
        self.above = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            up = self.link[s]
            self.above[s] = up if up > 0 and self.word[up] >= 0 else self.above[up] if up > 0 else 0

    def _new(self, size: int, link: int, following: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _parent(self, p: int, c: int, q: int) -> int:
        """The state of the string of p followed by c, of which q may hold longer ones: then split q."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._new(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, word: bytes) -> int:
        last = 0
        for c in word:
            q = self.next[last].get(c)
            if q is not None:
                last = self._parent(last, c, q)
                continue
            now, p = self._new(self.size[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p >= 0:
                self.link[now] = self._parent(p, c, self.next[p][c])
            last = now
        return last


class PrefixBPE:
    """A byte-level BPE vocabulary file (``vocab`` and ``merges``) and its two directions."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols = byte_symbols()
        vocab = model["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}     # of the merge that joins a pair
        self.made: dict[int, int] = {}                 # rank of the merge that makes a token; bytes have none
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, r)
            if whole not in self.made:
                self.made[whole], self.parts[whole] = r, pair
        usable = [i for i in self.bytes if len(self.bytes[i]) == 1 or i in self.made]
        self.ids = usable
        self.automaton = SuffixAutomaton([self.bytes[i] for i in usable])
        self.known: dict[tuple[int, int], bool] = {}
        special, special_id = specials(path)
        top = max([*self.bytes, special_id]) + 1
        spelt = [self.bytes.get(i, b"") for i in range(top)]
        if special:
            spelt[special_id] = special.encode()
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_len = np.fromiter(map(len, spelt), np.int64, top)
        self.spelt_at = np.cumsum(self.spelt_len) - self.spelt_len

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens a and b stay two when their bytes are encoded together.

        Undo the merges inside both, latest first.  The two that touch at the border at some moment
        would have merged if their pair ranks before the merges that took either of them away (of
        equal merges the left one comes first).
        """
        pair = (a, b)
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[pair] = self._test(a, b)
        return found

    def _test(self, a: int, b: int) -> bool:
        rank, made, parts = self.rank, self.made, self.parts
        left_until = right_until = 1 << 40
        while True:
            r = rank.get((a, b))
            if r is not None and r < left_until and r <= right_until:
                return False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if rb >= ra:
                right_until, b = rb, parts[b][0]
            else:
                left_until, a = ra, parts[a][1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece of the splitting pattern."""
        sa, ids, compatible = self.automaton, self.ids, self.compatible
        following, link, size, word, above = sa.next, sa.link, sa.size, sa.word, sa.above
        last, before = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        state = matched = 0
        for i, c in enumerate(piece, 1):
            while state and c not in following[state]:
                state = link[state]
                matched = size[state]
            state = following[state][c]
            matched += 1
            v = state if matched == size[state] and word[state] >= 0 else above[state]
            while True:
                t, p = ids[word[v]], i - size[v]
                if p == 0 or compatible(last[p], t):
                    last[i], before[i] = t, p
                    break
                v = above[v]
        out, i = [], len(piece)
        while i:
            out.append(last[i])
            i = before[i]
        return out[::-1]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        at = ragged(self.spelt_at[ids], self.spelt_len[ids])
        return self.spelt[at].tobytes().decode("utf-8", "replace")


def prefix_encoder(path: str) -> tuple[PrefixBPE, PieceCache]:
    """The vocabulary and the worker's cache of encoded pieces."""
    def make():
        bpe = PrefixBPE(path)
        return bpe, PieceCache(lambda pieces: [bpe.encode(p.encode()) for p in pieces])
    return worker_state(f"prefix_bpe:{path}", make)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """Add the ids of each whole text (``ids``, little-endian unsigned 32-bit), the text that they decode to
    (``decoded``), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``vocabulary`` names the vocabulary file, ``keep`` the columns to keep (default: all); of columns whose
    names clash with the new ones the new ones win.  Null and empty texts have no ids and decode to the empty
    text.  The vocabulary's own added token in a text becomes its one id.  Rows are neither moved nor merged:
    repeated rows come out repeated, an empty table stays empty.  A worker holds one Arrow batch, the automaton
    and bounded caches.  Pass ``ids=""`` or ``decoded=""`` to leave these columns out.
    """
    new = {n.lower() for n in (ids, decoded, "n_tokens", "ids_sha256", "decoded_sha256") if n}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    src = free_name(docs, "_text")[0]
    rows = docs.select(*[docs[c] for c in kept], docs[text].alias(src))
    special, special_id = specials(vocabulary)
    plain = rows.drop(src).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain), *([f"`{ids}` binary"] if ids else []),
                        *([f"`{decoded}` string"] if decoded else []), "n_tokens bigint, ids_sha256 string, decoded_sha256 string"])
    return rows.mapInArrow(_encode_batches(vocabulary, special, special_id, src, ids, decoded), schema)


def _encode_batches(vocabulary: str, special: str, special_id: int, src: str, ids: str, decoded: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = prefix_encoder(vocabulary)
        for batch in batches:
            at = batch.schema.names.index(src)
            got = encode_texts([t or "" for t in batch.column(at).to_pylist()], cache, special, special_id)
            texts = [bpe.decode(x) for x in got]
            new = {"n_tokens": pa.array([len(x) for x in got], pa.int64()),
                   "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in got], pa.string()),
                   "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())}
            if decoded:
                new = {decoded: pa.array(texts, pa.string())} | new
            if ids:
                new = {ids: pa.array([x.astype("<u4").tobytes() for x in got], pa.binary())} | new
            kept = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *new.values()],
                                             [*(batch.schema.names[k] for k in kept), *new])
    return run
