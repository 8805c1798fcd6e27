"""Exact top-k inner products by distributed histogram selection.

Every round scores all candidates against all queries, block against block. A task counts, per query, its scores in
the buckets of the query's current range, from the top down to the bucket of its own k-th best (below
that no bucket can hold the k-th of all). The counts of all tasks, summed, show the bucket of the k-th best; the next
round splits that bucket, until its width is one and the k-th score is known. A last round keeps
what is above it and, of what equals it, as many smallest ids as are missing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookflow.settings import stage

QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096     # vectors
SCORES = 1 << 21                              # scores held at once
BUCKETS = 512
LARGEST = (1 << 62) - 1


def quantize(df: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component as a double; without vectors that are null or empty or hold null or
    non-finite components."""
    x = df.select(df[vec_id].cast("bigint").alias("vec_id"),
                  F.transform(df[vector], lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("q"),
                  df[vector].alias("raw"))
    sound = F.forall("raw", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return x.where(F.col("raw").isNotNull() & (F.size("raw") > 0) & sound & F.col("vec_id").isNotNull()).select("vec_id", "q")


def _pack(block: int, kind: str):
    """Rows (vec_id, q, lo, width, need) as blocks of equal dimension: little-endian i64 arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        number = 0

        def out(dim: int, rows: list) -> pa.RecordBatch:
            ids, vectors, state = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), f"{kind}_ids": [np.array(ids, "<i8").tobytes()],
                f"{kind}_v": [np.concatenate(vectors).astype("<i8").tobytes()],
                f"{kind}_state": [np.array(state, "<i8").tobytes()]})

        for batch in batches:
            ids = batch.column(0).to_pylist()
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            state = list(zip(*(batch.column(k).to_pylist() for k in range(2, batch.num_columns)), strict=True)) or [()] * len(ids)
            for k, e in enumerate(ends.tolist()):
                b = int(ends[k - 1]) if k else 0
                rows = held.setdefault(e - b, [])
                rows.append((ids[k], flat[b:e], state[k]))
                if len(rows) == block:
                    yield out(e - b, rows)
                    held[e - b] = []
                    number += 1
        for dim, rows in held.items():
            if rows:
                yield out(dim, rows)
    return run


def _packed(df: DataFrame, block: int, kind: str) -> DataFrame:
    return df.mapInArrow(_pack(block, kind), f"dim int, {kind}_ids binary, {kind}_v binary, {kind}_state binary")


def _exact_product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where every partial sum is below 2^53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ c.T.astype(float)).astype(np.int64) if top < 2 ** 53 else q @ c.T


def _cells(batches: Iterator[pa.RecordBatch], width: int):
    """Scores of each pair of blocks, in parts: query ids, their state, candidate ids, scores (own pairs masked)."""
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            qi, ci = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
            q, c = np.frombuffer(row["q_v"], "<i8").reshape(-1, dim), np.frombuffer(row["c_v"], "<i8").reshape(-1, dim)
            state = np.frombuffer(row["q_state"], "<i8").reshape(-1, width)
            step = max(1, SCORES // max(1, len(ci)))
            for k in range(0, len(qi), step):
                ids = qi[k:k + step]
                yield ids, state[k:k + step], ci, _exact_product(q[k:k + step], c), ids[:, None] != ci[None, :]


def _count(k: int, buckets: int):
    """(query, bucket, n) of a block pair, from the top bucket to that of its own k-th best. State: low end, bucket
    width, number of buckets, how many are wanted inside the range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, state, _, scores, other in _cells(batches, 3):
            low, width, need = (state[:, j][:, None] for j in range(3))
            bucket = np.where(other & (scores >= low), (scores - low) // width, -1)
            bucket[bucket >= buckets] = -1
            rows = len(ids)
            n = np.bincount((np.arange(rows)[:, None] * (buckets + 1) + bucket + 1).ravel(), minlength=rows * (buckets + 1))
            n = n.reshape(rows, buckets + 1)[:, 1:]
            above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
            q, b = np.nonzero((n > 0) & (above < need))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(b.astype(np.int64)), pa.array(n[q, b].astype(np.int64))],
                                                 ["q", "b", "n"])
    return run


def _select(k: int):
    """Candidates above the k-th score and the smallest ids of those that equal it. State: that score, how many equal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, state, ci, scores, other in _cells(batches, 2):
            least, ties = state[:, 0], state[:, 1]
            order = np.argsort(ci, kind="stable")
            s, o = scores[:, order], other[:, order]
            q1, c1 = np.nonzero(o & (s > least[:, None]))
            equal = o & (s == least[:, None])
            q2, c2 = np.nonzero(equal & (np.cumsum(equal, axis=1) <= ties[:, None]))
            q, c = np.concatenate([q1, q2]), np.concatenate([c1, c2])
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(ci[order][c]), pa.array(s[q, c])],
                                                 ["q", "c", "score"])
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int, buckets: int = BUCKETS,
          query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` candidates with the highest integer inner product for every
    query, ties to the smaller vec_id; a query's own row (equal id) doesn't count.

    Both sides have vec_id and q (array<bigint>, see ``quantize``); only vectors of equal dimension are compared. A
    query with fewer candidates gets all; a query without any gets no row. Ids may repeat among the candidates
    (each row counts); repeated query ids are taken as one row of the smallest vector. Empty tables give empty results.
    Scores must be below 2^62, whatever their sign.

    Queries travel in blocks to every block of candidates by an equi-join on a dealt number, not by a broadcast, so
    neither side needs to be small. What is shuffled afterwards is at most ``k`` counts or rows for each query
    and pair of blocks; a large group of equal vectors adds none.
    """
    queries = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    c = stage(_packed(candidates.select("vec_id", "q"), candidate_block, "c").drop("c_state").withColumn(
        "cell", F.monotonically_increasing_id()), "candidate-blocks")
    q = stage(queries, "queries")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    longest = [d.agg(F.max(norm)).first()[0] or 0.0 for d in (candidates, q)]
    bound = min(math.ceil(longest[0] * longest[1] * (1 + 1e-9)) + 1, LARGEST)
    cells = c.count()

    def met(states: DataFrame) -> DataFrame:
        """Every block of queries (vec_id, q, then their state) with every block of candidates of its dimension."""
        blocks = _packed(states, query_block, "q").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(max(cells, 1) - 1))))
        # Never a broadcast: Spark sizes what an explode makes as what went in, however many cells there are.
        return blocks.join(numbered.hint("merge"), ["cell", "dim"])

    # Number the candidate blocks 0 .. cells - 1 (a few rows for every thousand vectors).
    numbers = c.select("cell").select("cell", (F.row_number().over(Window.orderBy("cell")) - 1).alias("number"))
    numbered = c.join(numbers, "cell").drop("cell").withColumnRenamed("number", "cell")

    # lo: low end of the range; need: how many of the best are wanted from inside it.
    width = 1
    while width * buckets < 2 * bound + 1:
        width *= buckets
    state = q.select("vec_id", "q", F.lit(-bound).cast("long").alias("lo"), F.lit(width).cast("long").alias("width"),
                     F.lit(k).cast("long").alias("need"))
    while True:
        counts = met(state).mapInArrow(_count(k, buckets), "q bigint, b bigint, n bigint")
        total = counts.groupBy("q", "b").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("b"))
        tally = total.withColumn("upto", F.sum("n").over(down)).withColumn("above", F.col("upto") - F.col("n"))
        # The bucket in which the wanted number is reached, or else the lowest: then all are wanted.
        picked = (tally.withColumnRenamed("q", "vec_id").join(state.select("vec_id", "lo", "width", "need"), "vec_id")
                  .where(F.col("above") < F.col("need"))
                  .groupBy("vec_id").agg(F.min_by(F.struct((F.col("lo") + F.col("b") * F.col("width")).alias("lo"),
                                                           (F.col("need") - F.col("above")).alias("need"), "n"), F.col("b")).alias("x")))
        if width == 1:
            # need may exceed what is there: a query with fewer candidates than k.
            final = picked.select("vec_id", F.col("x.lo").alias("least"), F.col("x.need").alias("ties"))
            break
        width //= buckets
        state = stage(q.join(picked, "vec_id").select("vec_id", "q", "x.lo", F.lit(width).cast("long").alias("width"), "x.need"), "ranges")
    states = stage(q.join(final, "vec_id").select("vec_id", "q", "least", "ties"), "ranges")
    rows = met(states).mapInArrow(_select(k), "q bigint, c bigint, score bigint")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return (rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select(F.col("q").alias("query_id"), "rank", F.col("c").alias("vec_id"), "score"))
