"""Whole texts as token ids: byte-level pieces found in bulk, each distinct piece encoded once.

Byte-level BPE never merges across the pieces of its splitting pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
so a text's ids are its pieces' ids in order.  ``split`` finds the pieces of many texts with
array operations over code points; ``PieceCache`` keeps the ids of distinct pieces in a worker.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from bookflow.llm.common import piece_hashes, ragged, worker_state

#: Code points that are worked on at once; longer texts are cut where a piece ends in any case.
CHUNK = 1 << 18
#: Distinct pieces a worker remembers; beyond it starts afresh, which costs time, not results.
REMEMBERED = 500_000

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The contractions of the splitting pattern, and Unicode's white space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
               0x205F, 0x3000]


def _classes() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    first = {"L": LETTER, "N": NUMBER}
    kinds[:] = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
                           np.uint8, 0x110000)
    kinds[WHITE_SPACE] = SPACE
    return kinds


def split(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of all pieces in ``codes``, texts beginning at ``edges`` (sorted, may repeat)."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kinds = worker_state("code_classes", _classes)[codes]
    first = np.zeros(n + 1, bool)          # a text begins here (or all ends)
    first[edges] = True
    first[0] = first[n] = True
    start = np.zeros(n + 1, bool)
    start[1:n] = kinds[1:] != kinds[:-1]
    start |= first
    # A white-space run before other text gives its last character away: to the next piece if
    # it is a plain space, to a piece of its own if not.
    run_end = np.flatnonzero((kinds == SPACE) & start[1:] & ~first[1:])     # text goes on after it
    glued = run_end[codes[run_end] == 0x20]
    start[run_end] = True
    start[glued + 1] = False
    # Contractions: an apostrophe that begins a piece.
    quotes = np.flatnonzero((codes == 0x27) & start[:n])
    for q in quotes[(quotes + 1 < n)]:
        for c in CONTRACTIONS:
            e = q + 1 + len(c)
            if e <= n and not first[q + 1:e].any() and all(codes[q + 1 + k] == ord(x) for k, x in enumerate(c)):
                start[q + 1:e] = False
                # What follows is a piece of its own, also if it goes on with letters; a space keeps
                # what was decided for it.
                start[e] = True
                break
    return np.flatnonzero(start[:n])


class PieceCache:
    """Ids of distinct pieces, filled by ``encode`` (list of str -> list of id lists)."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)    # hashes in order, and where their ids are
        self.check = np.zeros(1024, np.uint64)
        self.off = np.zeros(1024, np.int64)
        self.len = np.zeros(1024, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def ids(self, text: str, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each piece has."""
        lengths = np.diff(np.append(starts, len(codes)))
        key, check = piece_hashes(codes, starts, lengths, 1), piece_hashes(codes, starts, lengths, 2)
        distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBERED:
            self._clear()
        place = np.searchsorted(self.keys, distinct)
        found = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        found[inside] = self.keys[place[inside]] == distinct[inside]
        slots = np.full(len(distinct), -1)
        slots[found] = self.slots[place[found]]
        new = np.flatnonzero(~found)
        if len(new):
            s, e = starts[at[new]].tolist(), (starts[at[new]] + lengths[at[new]]).tolist()
            got = self.encode([text[a:b] for a, b in zip(s, e, strict=True)])
            many = np.fromiter(map(len, got), np.int64, len(got))
            slots[new] = np.arange(len(self.keys), len(self.keys) + len(new))
            self.keys = np.insert(self.keys, place[new], distinct[new])
            self.slots = np.insert(self.slots, place[new], slots[new])
            self.check, self.off, self.len = (self._room(a, len(self.keys)) for a in (self.check, self.off, self.len))
            self.check[slots[new]] = check[at[new]]
            self.len[slots[new]] = many
            self.off[slots[new]] = self.used + np.cumsum(many) - many
            self.flat = self._room(self.flat, self.used + int(many.sum()))
            self.flat[self.used:self.used + int(many.sum())] = np.fromiter((x for g in got for x in g), np.uint32)
            self.used += int(many.sum())
        slots = slots[back]
        if (self.check[slots] != check).any():      # two pieces with one 64-bit hash: encode all plainly
            ends = starts + lengths
            got = self.encode([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            return (np.fromiter((x for g in got for x in g), np.uint32),
                    np.fromiter(map(len, got), np.int64, len(got)))
        many = self.len[slots]
        return self.flat[ragged(self.off[slots], many)], many


def _cut(text: str) -> Iterator[str]:
    """Parts of a long text, cut only where white space follows other text: a piece ends there."""
    at = 0
    while len(text) - at > CHUNK:
        cut = at + CHUNK
        while cut < len(text) and not (text[cut].isspace() and ord(text[cut]) in WHITE_SPACE
                                       and ord(text[cut - 1]) not in WHITE_SPACE):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _chunks(texts: Iterable[str], special: str) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Parts of texts up to about CHUNK code points: (parts, text of each, 1 if ``special`` follows)."""
    parts, owner, then, size = [], [], [], 0
    for k, t in enumerate(texts):
        whole = t.split(special) if special and special in t else [t]
        for j, w in enumerate(whole):
            cuts = list(_cut(w))
            for i, x in enumerate(cuts):
                if size + len(x) > CHUNK and parts:
                    yield parts, owner, then
                    parts, owner, then, size = [], [], [], 0
                parts.append(x)
                owner.append(k)
                then.append(int(i == len(cuts) - 1 and j < len(whole) - 1))
                size += len(x)
    if parts:
        yield parts, owner, then


def encode_texts(texts: list[str], cache: PieceCache, special: str = "", special_id: int = 0) -> list[np.ndarray]:
    """Ids (uint32) of every text; ``special`` in a text becomes ``special_id``, as the library does."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    mark = np.array([special_id], np.uint32)
    for parts, owner, then in _chunks(texts, special):
        text = "".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        edges = np.cumsum(sizes) - sizes
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = split(codes, edges)
        ids, many = cache.ids(text, codes, starts)
        before = np.concatenate([[0], np.cumsum(many)])
        bounds = before[np.searchsorted(starts, np.append(edges, len(codes)))].tolist()
        for i, k in enumerate(owner):
            out[k].append(ids[bounds[i]:bounds[i + 1]])
            if then[i]:
                out[k].append(mark)
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]


def specials(path: str) -> tuple[str, int]:
    """The one added token of a vocabulary file, with its id ("" and 0 without one)."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if len(added) > 1:
        raise ValueError("vocabularies with several added tokens are not supported")
    return (added[0]["content"], added[0]["id"]) if added else ("", 0)
