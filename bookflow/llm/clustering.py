"""Clustering by nearest centroids: Lloyd's rounds in exact integers, with a progressive search in Walsh-Hadamard coefficients.

The transform H of 64 integers has integer coefficients and |H(x) - H(c)|^2 = 64 |x - c|^2. Vectors are transformed once, centroids in
every round. Squared differences of coefficients are added from coarse (few sign changes) to fine. After each step the leading
centroid's distance has an upper bound, and centroids whose sum is already above it are strictly worse and go; those
that stay get all 64 coefficients, so that the smallest distance and its ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import free_name
from bookflow.settings import stage

SIZE = 64                                            # components
STEPS = (4, 8, 16, 32, 64)                           # coefficients after each step of the search
#: Components from here on could have distances beyond a long; from WIDE on sums are kept in unbounded integers.
TOO_LARGE, WIDE = 1 << 27, 1 << 20


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of rows of 64 integers, those with few sign changes first."""
    n, step = x.shape[0], 1
    while step < SIZE:
        pairs = x.reshape(n, SIZE // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, SIZE)
        step *= 2
    return x[:, ORDER]


def sequency_order() -> np.ndarray:
    """Places of the coefficients by the number of sign changes of their row."""
    k = np.arange(SIZE)
    signs = np.array([[bin(i & j).count("1") & 1 for j in k] for i in k])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


ORDER = sequency_order()


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of coefficients the first of the nearest centroids (rows of coefficients) and 64 times the squared distance."""
    n, k, done = len(x), len(c), 0
    sums = np.zeros((n, k), x.dtype)
    alive = np.ones((n, k), bool)
    energy = (x * x).sum(axis=1), (c * c).sum(axis=1)    # of the coefficients to come
    for upto in STEPS:
        rest_c = energy[1] - (c[:, done:upto] ** 2).sum(axis=1)
        rest_x = energy[0] - (x[:, done:upto] ** 2).sum(axis=1)
        for j in range(k):
            at = np.flatnonzero(alive[:, j])
            d = x[at, done:upto] - c[j, done:upto]
            sums[at, j] += (d * d).sum(axis=1)
        # (u - v)^2 <= 2 u^2 + 2 v^2: no centroid is farther than its sum and twice the energies left.
        bound = sums + 2 * (rest_x[:, None] + rest_c[None, :])
        alive &= sums <= np.where(alive, bound, bound.max(initial=0)).min(axis=1)[:, None]
        energy, done = (rest_x, rest_c), upto
    last = np.where(alive, sums, sums.max(initial=0) + 1)
    cluster = last.argmin(axis=1)
    return cluster, last[np.arange(n), cluster]


def quantized(rows: DataFrame, vector: str, scale: int, out: str) -> DataFrame:
    """The rows whose vector has 64 components, none null or not finite, with ``floor(scale * x)`` of each."""
    x = F.transform(rows[vector], lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))

    def number(v: Column) -> Column:
        small = F.abs(v * scale) < TOO_LARGE
        return F.when(small, F.floor(v * scale)).otherwise(
            F.raise_error(F.lit(f"clustering: {scale} times a component is {TOO_LARGE} or more")).cast("bigint"))
    return rows.where((F.size(rows[vector]) == SIZE) & whole).withColumn(out, F.transform(x, number))


def _matrix(rows: pa.Array) -> np.ndarray:
    """Lists of 64 integers as a matrix."""
    x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
    return x if not x.size or np.abs(x).max() < WIDE * SIZE else x.astype(object)


def _like(x: np.ndarray, c: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 if every sum of squares fits, else both as unbounded integers."""
    c = np.array(c, object)
    wide = x.dtype == object or max(map(abs, c.flat), default=0) >= WIDE * SIZE
    return (x.astype(object), c) if wide else (x, c.astype(np.int64))


def coefficients(rows: DataFrame, source: str, out: str) -> DataFrame:
    """``source`` (64 integers) of every row replaced by its coefficients ``out``."""
    others = rows.select(*[c for c in rows.columns if c != source], source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = transform(b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SIZE), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], out])
    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in others.drop(source).schema), f"`{out}` array<bigint>"]
    return others.mapInArrow(run, ", ".join(schema))


COUNT, INERTIA = -1, -2


def totals(vectors: DataFrame, coefs: str, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """Per cluster the sum of each coefficient (0 to 63), the number of vectors (COUNT) and of squared distances (INERTIA).

    A task adds up all its batches and gives 66 numbers for each of its clusters; so many come to the driver, whatever the table's size.
    """
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, SIZE + 2), object)
        for b in batches:
            x, c = _like(_matrix(b.column(0)), centroids)
            cluster, far = nearest(x, c)
            for j in np.unique(cluster).tolist():
                own = cluster == j
                sums[j] += np.array([*x[own].sum(axis=0).tolist(), int(own.sum()), sum(map(int, far[own])) // SIZE], object)
        j, pos = np.nonzero(sums)
        where = np.where(pos < SIZE, pos, np.where(pos == SIZE, COUNT, INERTIA))
        values = [f"{v}" for v in sums[j, pos]]
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(where, pa.int32()),
                                          pa.array(values, pa.string()).cast(pa.decimal128(38, 0))], ["cluster", "pos", "v"])
    found = vectors.select(coefs).mapInArrow(run, "cluster int, pos int, v decimal(38,0)").groupBy("cluster", "pos").agg(F.sum("v").alias("v"))
    return {(r["cluster"], r["pos"]): int(r["v"]) for r in found.collect()}


def moved(centroids: list[list[int]], found: dict[tuple[int, int], int]) -> list[list[int]]:
    """Centroids (components) as floored means of their vectors; empty ones stay. The transform is its own inverse, times 64."""
    out = []
    for j, old in enumerate(centroids):
        n = found.get((j, COUNT), 0)
        sums = np.zeros(SIZE, object)
        sums[ORDER] = [found.get((j, p), 0) for p in range(SIZE)]
        natural = np.zeros(SIZE, object)
        natural[ORDER] = transform(sums.reshape(1, SIZE))[0]
        out.append([int(v) // SIZE // n for v in natural] if n else old)
    return out


def transformed(centroids: list[list[int]]) -> list[list[int]]:
    return transform(np.array(centroids, object).reshape(-1, SIZE)).tolist()


def cluster(rows: DataFrame, k: int, rounds: int, seed: str, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024,
            keep: list[str] | None = None) -> DataFrame:
    """Add ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` to the rows that have a usable vector.

    Centroids start as the k vectors with the smallest SHA-256 of ``seed:id`` (a null id is an empty one; of equal ids the smaller vector
    first; a repeated row is a vector of its own; fewer vectors give fewer centroids). Rows whose vector is null, has not 64
    components, or holds null or non-finite ones take no part; a component of 2^27 / ``scale`` or more is an error. Ties go to the smaller
    cluster. An empty table stays empty. ``keep`` names the columns to keep (default: all); of clashing names the new ones win.

    Every round is one narrow pass over the coefficients, written once to the shared folder, and a sum per cluster.
    """
    new = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    kept = [c for c in (rows.columns if keep is None else keep) if c.lower() not in new]
    q, coefs, key, at = free_name(rows, "_q", "_coefficients", "_hash", "_cluster")
    usable = quantized(rows, vector, scale, q)
    id_text = F.coalesce(rows[vec_id].cast("string"), F.lit(""))
    first = usable.select(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256).alias(key), q).orderBy(key, q).limit(k)
    centroids = [list(r[q]) for r in first.collect()]
    vectors = stage(coefficients(usable.select(*kept, q), q, coefs), "coefficients")
    for _ in range(rounds if centroids else 0):
        centroids = moved(centroids, totals(vectors, coefs, transformed(centroids)))
    last = transformed(centroids)
    found = totals(vectors, coefs, last) if centroids else {}
    if max(found.values(), default=0) >= 1 << 63:
        raise OverflowError("clustering: the inertia is beyond a long")
    others = vectors.select(*kept, coefs)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, far = nearest(*_like(_matrix(b.column(b.num_columns - 1)), last))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own, pa.int32()), pa.array([int(d) // SIZE for d in far], pa.int64())],
                                             [*b.schema.names[:-1], at, "distance"])
    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*kept).schema), f"`{at}` int, distance bigint"]
    facts = [F.struct(F.lit(found.get((j, INERTIA), 0)).cast("bigint").alias("own"),
                      F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()).alias("sha")) for j, c in enumerate(centroids)]
    fact = F.element_at(F.array(*facts), F.col(at) + 1) if facts else F.lit(None).cast("struct<own:bigint,sha:string>")
    inertia = sum(found.get((j, INERTIA), 0) for j in range(len(centroids)))
    return others.mapInArrow(assign, ", ".join(schema)).select(
        *kept, F.col(at).alias("cluster"), "distance", fact["own"].alias("cluster_inertia"), F.lit(inertia).cast("bigint").alias("inertia"),
        fact["sha"].alias("centroid_sha256"))
