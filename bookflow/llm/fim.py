"""Fill-in-middle transformation with piece tables.

A document is a list of pieces (buffer, start, length) over two buffers that never change: its text in UTF-8, and the marks. Cutting
splits a piece, arranging permutes the three parts and puts marks between them, and the inverse permutation restores the
text. Text is only read where a list of pieces is streamed, into a hash or into the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bookflow.llm.common import free_name

# Marks of the parts, and the shares of changed documents and of those with the suffix first.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
RATE, SPM_RATE = 50, 80
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PARTS = ("prefix", "middle", "suffix")                # in text order

TEXT, SIGNS = 0, 1                                    # buffers
SENTINELS = b"".join(MARKS.values())
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
CONTENT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces array<struct<buffer:int,start:bigint,length:bigint>>"


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


Pieces = list[Piece]


def cut(pieces: Pieces, *ends: int) -> list[Pieces]:
    """The pieces up to each end (ascending), and those behind the last; a piece with an end inside is split."""
    out, at, left = [[] for _ in range(len(ends) + 1)], 0, list(pieces)[::-1]
    for k, end in enumerate([*ends, sum(p.length for p in pieces)]):
        while left and at < end:
            p = left.pop()
            if at + p.length > end:
                left.append(Piece(p.buffer, p.start + end - at, at + p.length - end))
                p = p._replace(length=end - at)
            out[k].append(p)
            at += p.length
    return out


def arrange(parts: dict[str, Pieces], form: str) -> Pieces:
    """The parts in the form's order, each behind its mark."""
    return [p for name in ORDERS[form] for p in (Piece(SIGNS, SENTINELS.index(MARKS[name]), len(MARKS[name])), *parts[name])]


def restore(output: memoryview, form: str | None) -> Pieces:
    """Pieces over an output that make up its text again: cut at the marks, without them, in text order."""
    whole = [Piece(TEXT, 0, len(output))]
    if form not in ORDERS:
        return whole
    held, ends = bytes(output), []
    for name in ORDERS[form]:                         # a changed text holds no marks of its own
        at = held.index(MARKS[name], ends[-1] if ends else 0)
        ends += [at, at + len(MARKS[name])]
    between = cut(whole, *ends)
    parts = dict(zip(ORDERS[form], between[2::2], strict=True))
    return [p for name in PARTS for p in parts[name]]


def stream(pieces: Iterable[Piece], text: memoryview) -> Iterator[memoryview]:
    buffers = {TEXT: text, SIGNS: memoryview(SENTINELS)}
    for p in pieces:
        yield buffers[p.buffer][p.start:p.start + p.length]


def digest(pieces: Iterable[Piece], text: memoryview) -> str:
    h = hashlib.sha256()
    for part in stream(pieces, text):
        h.update(part)
    return h.hexdigest()


def token_ends(text: memoryview) -> np.ndarray:
    """Byte ends of the tokens: runs of other characters with the blanks before them, and blanks at the end."""
    blank = BLANK[np.frombuffer(text, np.uint8)]
    last = np.ones(len(blank), bool)                  # the last character of a run, or of the text
    last[:-1] = ~blank[:-1] & blank[1:]
    return np.flatnonzero(last) + 1


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four numbers that only the seed and the id decide (a null id is an empty one)."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]


def code_points(part: memoryview) -> int:
    return int(((np.frombuffer(part, np.uint8) & 0xC0) != 0x80).sum())


def plan(text: memoryview, h: list[int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, Pieces]:
    """Tokens, form, code points of prefix and middle, and the pieces of the output."""
    ends, whole = token_ends(text), [Piece(TEXT, 0, len(text))] if len(text) else []
    n, held = len(ends), bytes(text)
    if not held or h[2] % 100 >= rate or any(m in held for m in MARKS.values()):
        return n, "plain", None, None, whole
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    at = [0, *ends.tolist()]
    a, b = (at[k] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    parts = dict(zip(PARTS, cut(whole, a, b), strict=True))
    return n, form, code_points(text[:a]), code_points(text[a:b]), arrange(parts, form)


def _views(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of every text, not copied (null: none)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    for k in range(len(column)):
        yield data[offsets[k]:offsets[k + 1]] if column[k].is_valid else memoryview(b"")


def _schema(fields, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), more])


def transform(docs: DataFrame, seed: str = "42", doc_id: str = "doc_id", text: str = "text", output: str = "output",
              rate: int = RATE, spm_rate: int = SPM_RATE, keep: list[str] | None = None) -> DataFrame:
    """Add tokens ``n``, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``, the ``pieces`` (bytes of the text: buffer 0; of the
    marks: buffer 1), ``output`` and its ``output_sha256`` to every row.

    Null and empty texts are plain, as are texts that hold a mark. One narrow pass: rows don't depend on each other, so repeated
    rows come out repeated, equal ids with other texts each by the same draws; an empty table stays empty; a null id draws as
    an empty one. ``keep`` names the columns to keep (default: all); of clashing names the new ones win.
    """
    new = {"n", "form", "prefix_chars", "middle_chars", "pieces", "output_sha256", output.lower()}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    src, key = free_name(docs, "_text", "_id")
    rows = docs.select(docs[text].alias(src), docs[doc_id].cast("bigint").alias(key), *[docs[c] for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(),
                 pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))]
        for b in batches:
            found, outputs, hashes = [], [], []
            for view, own in zip(_views(b.column(0)), b.column(1).to_pylist(), strict=True):
                found.append(plan(view, draws(seed, own), rate, spm_rate))
                outputs.append(b"".join(stream(found[-1][4], view)))
                hashes.append(digest(found[-1][4], view))
            columns = [pa.array([[p._asdict() for p in x] for x in c] if k == 4 else c, t) for k, (c, t) in enumerate(
                zip(zip(*found, strict=True), kinds, strict=True))] if found else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[2:], *columns, pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string())],
                [*b.schema.names[2:], "n", "form", "prefix_chars", "middle_chars", "pieces", output, "output_sha256"])
    return rows.mapInArrow(run, _schema(rows.drop(src, key).schema, f"{CONTENT}, `{output}` string, output_sha256 string"))


def untransform(rows: DataFrame, output: str = "output", form: str = "form", restored: str = "restored",
                keep: list[str] | None = None) -> DataFrame:
    """Add the ``restored`` text and its ``restored_sha256``, from output and form alone; null outputs restore to empty texts."""
    kept = [c for c in (rows.columns if keep is None else keep) if c.lower() not in (restored.lower(), "restored_sha256")]
    src, shape = free_name(rows, "_output", "_form")
    given = rows.select(rows[output].alias(src), rows[form].alias(shape), *[rows[c] for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hashes = [], []
            for view, f in zip(_views(b.column(0)), b.column(1).to_pylist(), strict=True):
                pieces = restore(view, f)
                texts.append(b"".join(stream(pieces, view)))
                hashes.append(digest(pieces, view))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string())],
                                             [*b.schema.names[2:], restored, "restored_sha256"])
    return given.mapInArrow(run, _schema(given.drop(src, shape).schema, f"`{restored}` string, restored_sha256 string"))
