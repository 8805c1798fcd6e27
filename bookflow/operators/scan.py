"""Ordered scans that never put a whole key into one task.

A window ``PARTITION BY book ORDER BY page`` sorts a whole book in one task, and one book may
hold a third of all rows.  Here every scan takes a *block* column, a non-decreasing integer
function of the order (page number div 4096, offset div 1 MiB, hour of a time stamp).  The
window runs inside ``(key, block)``; one small summary row per block is carried over to the
next block; both meet in an equi-join on ``(key, block)``, which reuses the window's exchange.
The only per-key work left is over block summaries, some thousand times fewer than the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from bookflow.settings import stage

BLK = "_blk"


def _cols(order: Sequence) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _named(df: DataFrame, values: dict[str, Column]) -> tuple[DataFrame, dict[str, str]]:
    names = {n: f"_in_{n}" for n in values}
    return df.withColumns({names[n]: v for n, v in values.items()}), names


def _summary(df: DataFrame, by: Sequence[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*by, BLK).agg(*aggs)


def _join_back(rows: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.join(carry, [*by, BLK], "left")


def prefix_sum(df: DataFrame, by: Sequence[str], order: Sequence, block: Column,
               **measures: Column) -> DataFrame:
    """Add, per measure, the sum over all earlier rows of the key (0 for the first row)."""
    src, tmp = _named(df.withColumn(BLK, block), measures)
    local = W.partitionBy(*by, BLK).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, -1)
    blocks = W.partitionBy(*by).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    rows = src.withColumns({n: F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in tmp.items()})
    totals = _summary(src, by, [F.sum(c).alias(c) for c in tmp.values()])
    carry = totals.select(*by, BLK, *[F.coalesce(F.sum(c).over(blocks), F.lit(0)).alias(f"_c_{n}")
                                      for n, c in tmp.items()])
    out = _join_back(rows, carry, by)
    return out.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in tmp}).drop(
        BLK, *tmp.values(), *[f"_c_{n}" for n in tmp])


def prefix_max(df: DataFrame, by: Sequence[str], order: Sequence, block: Column,
               **measures: Column) -> DataFrame:
    """Add, per measure, the largest value of all earlier rows (null for the first row)."""
    src, tmp = _named(df.withColumn(BLK, block), measures)
    local = W.partitionBy(*by, BLK).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, -1)
    blocks = W.partitionBy(*by).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    rows = src.withColumns({n: F.max(c).over(local) for n, c in tmp.items()})
    tops = _summary(src, by, [F.max(c).alias(c) for c in tmp.values()])
    carry = tops.select(*by, BLK, *[F.max(c).over(blocks).alias(f"_c_{n}") for n, c in tmp.items()])
    out = _join_back(rows, carry, by)
    return out.withColumns({n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in tmp}).drop(
        BLK, *tmp.values(), *[f"_c_{n}" for n in tmp])


def sessions(df: DataFrame, by: Sequence[str], ts: str, gap: int, block: Column, name: str,
             *ties: str) -> DataFrame:
    """Number the bursts of a key: a new one starts after more than ``gap`` units of silence."""
    order = [ts, *ties]
    d = prev_value(df, by, order, block, _pt=F.col(ts))
    new = F.when(F.col("_pt").isNull() | (F.col(ts) - F.col("_pt") > gap), 1).otherwise(0)
    d = d.withColumn("_new", new.cast("long"))
    d = prefix_sum(d, by, order, block, _before=F.col("_new"))
    return d.withColumn(name, F.col("_before") + F.col("_new") - 1).drop("_pt", "_new", "_before")


def row_index(df: DataFrame, by: Sequence[str], order: Sequence, block: Column,
              name: str) -> DataFrame:
    """Add the 0-based position of each row within its key."""
    return prefix_sum(df, by, order, block, **{name: F.lit(1).cast("long")})


def row_index_sorted(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``row_index`` for orders without a block function: rows are dealt by ranges of (key, order), sorted and written once.

    Many rows at one place of the order are many ranges. One short row for each (range, key) is carried on.
    """
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumns({
        "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    dealt = stage(dealt, "ranges")
    sizes = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    return dealt.join(sizes, [*by, "_part"], "left").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def last_value(df: DataFrame, by: Sequence[str], order: Sequence, block: Column,
               **values: Column) -> DataFrame:
    """Add, per value, the latest non-null one up to and including the row (as-of carry)."""
    src, tmp = _named(df.withColumn(BLK, block), values)
    local = W.partitionBy(*by, BLK).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, 0)
    blocks = W.partitionBy(*by).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    rows = src.withColumns({n: F.last(c, ignorenulls=True).over(local) for n, c in tmp.items()})
    pos = F.struct(*_cols(order))
    ends = _summary(src, by, [F.max_by(c, F.when(F.col(c).isNotNull(), pos)).alias(c)
                              for c in tmp.values()])
    carry = ends.select(*by, BLK, *[F.last(c, ignorenulls=True).over(blocks).alias(f"_c_{n}")
                                    for n, c in tmp.items()])
    out = _join_back(rows, carry, by)
    return out.withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in tmp}).drop(
        BLK, *tmp.values(), *[f"_c_{n}" for n in tmp])


def _neighbour(df, by, order, block, values, step: int) -> DataFrame:
    src = df.withColumn(BLK, block)
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    src = src.withColumn("_in", packed)
    local = W.partitionBy(*by, BLK).orderBy(*_cols(order))
    blocks = W.partitionBy(*by).orderBy(BLK)
    shift, edge = (F.lag, F.max_by) if step < 0 else (F.lead, F.min_by)
    rows = src.withColumn("_near", shift("_in").over(local))
    ends = _summary(src, by, [edge("_in", F.struct(*_cols(order))).alias("_edge")])
    carry = ends.select(*by, BLK, shift("_edge").over(blocks).alias("_far"))
    out = _join_back(rows, carry, by).withColumn("_got", F.coalesce("_near", "_far"))
    return out.withColumns({n: F.col("_got")[n] for n in values}).drop(
        BLK, "_in", "_near", "_far", "_got")


def prev_value(df: DataFrame, by: Sequence[str], order: Sequence, block: Column,
               **values: Column) -> DataFrame:
    """Add values of the previous row of the key (null for the first)."""
    return _neighbour(df, by, order, block, values, -1)


def next_value(df: DataFrame, by: Sequence[str], order: Sequence, block: Column,
               **values: Column) -> DataFrame:
    """Add values of the next row of the key (null for the last)."""
    return _neighbour(df, by, order, block, values, 1)


# ---- folds that depend on the last kept element ----------------------------------------------

Step = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Stepwise:
    """Any fold, given as ``step(states, row)``, which maps an array of states by one row of inputs."""

    def __init__(self, step: Step, states: int):
        self.step, self.count = step, states

    def table(self, inputs: np.ndarray) -> np.ndarray:
        """Exit state for every possible entry state."""
        distinct = back = np.arange(self.count, dtype=np.int32)
        for k, x in enumerate(inputs):
            distinct = self.step(distinct, x)
            if k % 32 == 31 and len(distinct) > 1:      # entries that have met stay together
                uniq, inv = np.unique(distinct, return_inverse=True)
                if len(uniq) < len(distinct):
                    distinct, back = uniq, inv[back]
        return distinct[back].astype(np.int32)

    def states(self, inputs: np.ndarray, entry: int) -> np.ndarray:
        """State before each row."""
        cur, out = np.array([entry]), []
        for x in inputs:
            out.append(int(cur[0]))
            cur = self.step(cur, x)
        return np.asarray(out, dtype=np.int32)


class ResetSum:
    """A sum that starts again at 0 after the row with which it reaches ``limit`` (or whose second input is 1).

    The entry state only decides the first such row; from there on the way is the same for all. So a block of
    n rows costs a few searches in its prefix sums, whatever the number of states. Amounts aren't negative.
    """

    def __init__(self, limit: int, states: int):
        self.limit, self.count = limit, states

    def _closes(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums before the rows (and of all), the next forced row, the next close after each close (n: none)."""
        n = len(inputs)
        total = np.concatenate([[0], np.cumsum(inputs[:, 0].astype(np.int64))])
        forced = np.full(n + 1, n)
        if inputs.shape[1] > 1:
            at = np.where(inputs[:, 1] == 1, np.arange(n), n)
            forced[:n] = np.minimum.accumulate(at[::-1])[::-1]
        following = np.minimum(np.searchsorted(total[1:], total[1:] + self.limit), forced[1:])
        return total, forced, following

    def _first(self, total: np.ndarray, forced: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(total[1:], self.limit - entry), forced[0])

    def table(self, inputs: np.ndarray) -> np.ndarray:
        total, forced, following = self._closes(inputs)
        n, entry = len(inputs), np.arange(self.count)
        last = np.where(following < n, following, np.arange(n))
        while (last[last] != last).any():
            last = last[last]
        first = self._first(total, forced, entry)
        after = total[n] - total[last[np.minimum(first, n - 1)] + 1]
        return np.where(first < n, after, entry + total[n]).astype(np.int32)

    def states(self, inputs: np.ndarray, entry: int) -> np.ndarray:
        total, forced, following = self._closes(inputs)
        n, closes, at = len(inputs), [], int(self._first(total, forced, np.array([entry]))[0])
        while at < n:
            closes.append(at)
            at = int(following[at])
        before = np.searchsorted(closes, np.arange(n)) - 1       # the last close above each row
        base = np.concatenate([total[np.array(closes, dtype=np.int64) + 1], [-entry]])
        return (total[:n] - base[before]).astype(np.int32)


def _by_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[pa.Table, list[int]], pa.Table],
              fields: Sequence[T.StructField]) -> DataFrame:
    """``run`` over whole groups in order, many of them at a time: a table and where its groups begin (and the last ends).

    A call for each group would cost milliseconds, thousands of times what a small group's rows do. A group that a batch cuts is held until
    it is complete, so a task holds a batch and a group.
    """
    sorted_ = df.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order])

    def changes(t: pa.Table) -> np.ndarray:
        """Rows at which a group begins."""
        new = np.zeros(len(t), dtype=bool)
        new[:1] = True
        for k in keys:
            codes = t[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def done(t: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        return iter(run(t, [*cuts.tolist(), len(t)]).to_batches())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []                 # of one group, the last one seen
        for b in batches:
            if not len(b):
                continue
            # What is held is one group: its last row tells whether it goes on.
            near = pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), b] if held else [b])
            cuts = changes(near) - (1 if held else 0)
            if len(cuts) == 1:
                held.append(b)
                continue
            last = int(cuts[-1])
            t = pa.Table.from_batches([*held, b.slice(0, last)])
            yield from done(t, changes(t))
            held = [b.slice(last)]
        if held:
            t = pa.Table.from_batches(held)
            yield from done(t, changes(t))

    return sorted_.mapInArrow(over, T.StructType(list(fields)))


def finite_state(df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column,
                 inputs: Sequence[str], states: int, step: Step | ResetSum, start: int = 0,
                 name: str = "state", fan: int = 1024) -> DataFrame:
    """Add the state before each row of a sequential fold whose state is an int below ``states``.

    A fold that resets itself (sections of 1400 words, markers 400 characters apart) is not a
    prefix sum.  But each block is a function from entry state to exit state, and functions
    compose: tables per block, tables per ``fan`` blocks, then entry states on the way down.
    ``step`` is a function as in ``Stepwise``, or a ``ResetSum``, which costs no more than its rows.
    """
    fold = step if isinstance(step, ResetSum) else Stepwise(step, states)
    src = df.withColumn(BLK, block.cast("long")).withColumn("_sup", F.col(BLK) - F.pmod(BLK, F.lit(fan)))
    ins, ordr, keys = list(inputs), list(order), list(by)
    tab, entry = T.StructField("_tab", T.ArrayType(T.IntegerType())), T.StructField("_entry", T.IntegerType())

    def inputs_of(t: pa.Table) -> np.ndarray:
        return np.column_stack([t[c].to_numpy() for c in ins])

    def table(cols: pa.Table, lo: int, hi: int, x: np.ndarray) -> np.ndarray:
        return fold.table(x[lo:hi])

    def heads(cols: list[str], one, prepare):
        """One row for each group: its key and what ``one`` makes of its rows."""
        def run(t: pa.Table, cuts: list[int]) -> pa.Table:
            x = prepare(t)
            tabs = [one(t, lo, hi, x) for lo, hi in zip(cuts, cuts[1:])]
            return t.select(cols).take(pa.array(cuts[:-1])).append_column("_tab", pa.array(tabs, pa.list_(pa.int32())))
        return run

    slim = src.select(*keys, "_sup", BLK, *dict.fromkeys([*ordr, *ins]))
    # Needed on the way up and on the way down: written once, one short table per block.
    own = [*keys, "_sup", BLK]
    tables = stage(_by_group(slim, own, ordr, heads(own, table, inputs_of), [*slim.select(*own).schema, tab]), "fold_tables")

    def rows_of(t: pa.Table) -> np.ndarray:
        return t["_tab"].combine_chunks().flatten().to_numpy().reshape(len(t), states)

    def compose(t: pa.Table, lo: int, hi: int, tabs: np.ndarray) -> np.ndarray:
        out = tabs[lo]
        for nxt in tabs[lo + 1:hi]:
            out = nxt[out]
        return out

    def walk(t: pa.Table, cuts: list[int]) -> pa.Table:
        """The state before each of a group's rows."""
        tabs, given = rows_of(t), t["_entry"].to_numpy() if "_entry" in t.column_names else None
        at = np.empty(len(t), dtype=np.int32)
        for lo, hi in zip(cuts, cuts[1:]):
            s = start if given is None else given[lo]
            for k in range(lo, hi):
                at[k] = s
                s = tabs[k][s]
        return t.drop_columns([c for c in ("_tab", "_entry") if c in t.column_names]).append_column("_entry", pa.array(at))

    above = [*keys, "_sup"]
    sup_tables = _by_group(tables, above, [BLK], heads(above, compose, rows_of), [*tables.select(*above).schema, tab])
    sup_entry = _by_group(sup_tables, keys, ["_sup"], walk, [*sup_tables.select(*above).schema, entry])
    below = tables.join(sup_entry, above).select(*own, "_tab", "_entry")
    blk_entry = _by_group(below, above, [BLK], walk, [*below.select(*own).schema, entry])

    def states_of_rows(t: pa.Table, cuts: list[int]) -> pa.Table:
        x, given = inputs_of(t), t["_entry"].to_numpy()
        out = np.concatenate([fold.states(x[lo:hi], int(given[lo])) for lo, hi in zip(cuts, cuts[1:])])
        return t.drop_columns(["_entry"]).append_column(name, pa.array(out, pa.int32()))

    joined = src.join(blk_entry.drop("_sup"), [*keys, BLK])
    joined = joined.select(*[c for c in joined.columns if c != "_entry"], "_entry")
    return _by_group(joined, [*keys, BLK], ordr, states_of_rows, [*joined.drop("_entry").schema, T.StructField(name, T.IntegerType())]).drop(BLK, "_sup")
