"""SimHash near-duplicates: fingerprints, all links within a radius by covering masks, components.

Two fingerprints differ in at most r bits.  Give every bit a code in {1 .. 2^(r+1) - 1}; the codes of r bits
span at most r of the r + 1 dimensions, so some v other than zero is orthogonal to all of them.  The table of v
compares the bits whose code has an odd product with v, so it doesn't see the differing bits: every
pair within the radius has equal keys in at least one of the 2^(r+1) - 1 tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.llm.common import forget_worker_state
from bookflow.settings import stage

WORDS, SEED, BITS, RADIUS = 4, 42, 64, 4
#: Fingerprints of a bucket that meet in one task; larger buckets are cut into such blocks, every two of which meet.
BLOCK = 8192
SLICE = 1 << 16        # shingles whose bits are counted at once
EDGES = 1 << 18        # links that are reduced to a forest at once


def masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The compared bits of each table."""
    tables = (1 << (radius + 1)) - 1
    codes = [1 + i % tables for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, tables + 1)]


def fingerprint(text: str | None) -> int:
    """Of one text; bit i is set if it is set in over half of its shingles' hashes."""
    words = (text or "").encode().lower().split()      # of bytes: A-Z only; white space is 9-13 and 32
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    digest, ends = xxhash.xxh64_intdigest, ends.tolist()
    hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1:])] or [digest(flat, SEED)]  # noqa: B905
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), SLICE):
        h = np.array(hashes[k:k + SLICE], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its 64-bit fingerprint ``fp`` (as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links that connect the same nodes: every node with the smallest of its group."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = back[:len(a)], back[len(a):]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def bucket_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: breadth first, each compared with those not
    reached yet."""
    left, a, b = fps, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                front.extend(found.tolist())
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _links_of_runs(radius: int):
    """Rows sorted by bucket in, links out; a bucket may go on in the next batch."""
    def emit(a: list, b: list) -> pa.RecordBatch:
        x, y = forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, a, b, held = None, [], [], 0
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            now = now if rest is None else [np.concatenate(p) for p in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            new = np.any([c[1:] != c[:-1] for c in now[:4]], axis=0)
            bounds = np.concatenate([[0], np.flatnonzero(new) + 1])
            rest = [c[bounds[-1]:].copy() for c in now]
            for x, y in _links(now[4].view(np.uint64), bounds, radius):
                a.append(x)
                b.append(y)
                held += len(x)
            if held > EDGES:
                yield emit(a, b)
                a, b, held = [], [], 0
        if rest is not None:
            for x, y in _links(rest[4].view(np.uint64), np.array([0, len(rest[4])]), radius):
                a.append(x)
                b.append(y)
        if a:
            yield emit(a, b)
    return run


def _links(fps: np.ndarray, bounds: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.diff(bounds)
    two = bounds[:-1][sizes == 2]
    near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
    if near.any():
        yield fps[two[near]], fps[two[near] + 1]
    for s, e in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist(), strict=True):
        x, y = bucket_links(np.unique(fps[s:e]), radius)
        if len(x):
            yield x, y


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect all fingerprints ``fp`` (distinct) connected by steps of at most ``radius`` bits.

    Buckets of one are dropped after counting.  A bucket of more than ``block`` fingerprints is dealt into
    blocks, of which every two meet in a task of their own; no task holds more than two.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(BITS, radius)]
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
                                 for k, m in enumerate(signed)])).alias("x")
    keyed = distinct.select("fp", spread).select("fp", "x.t", "x.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Never a broadcast: Spark sizes what an explode makes as what went in, here one row of 31.
    cells = (keyed.join(sizes.hint("merge"), ["t", "key"])
             .withColumn("m", F.ceil(F.col("n") / F.lit(block)).cast("int"))
             .withColumn("i", F.pmod(F.xxhash64("fp"), F.col("m").cast("long")).cast("int"))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
             .select("t", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp"))
    by = ["t", "key", "lo", "hi"]
    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(_links_of_runs(radius), "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (u, v); root is the smallest node reached.

    Alternating stars: every node passes the smallest neighbour on, first to its larger neighbours, then to its
    smaller ones, until nothing changes.  Each round is written to the shared folder.
    """
    oriented = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = stage(oriented, "links"), None
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                             F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stage(small.select("e.*").where("u != v").distinct(), "links")
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if sums == seen:
            break
        seen = sums
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits) and component_id of every row.

    Lower-cases A-Z, takes words without white space (9-13 and 32) and shingles of four words, repeats included
    (of fewer words: all of them).  Rows link if their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest doc_id that links lead to, the row's own included (null if all are null).  Null,
    empty and blank texts have fingerprint zero, which links like any other.  Repeated rows are kept and share
    their component; an empty table gives an empty result; other columns are not read.

    Exact copies meet in a partial aggregation to one fingerprint before any bucket is made, so a large group of
    them costs nothing; links are a forest per bucket, never all pairs.
    """
    fps = stage(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fp"), radius))
    # Written, as is the smallest id of each: the join back isn't tied to the aggregate's partitions, so a root of many can be split.
    rooted = stage(distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    member = rooted.join(lowest.hint("merge"), "root").select("fp", "component_id")
    return fps.join(member.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
