"""Sharding: a keyed permutation of global row numbers deals rows over shards and slots, by DataFrame functions only.

Rows are numbered in one order of the whole table. The number is permuted by a Feistel network over two digits (the number in a
base near the root of the row count), and walked on along its cycle while it is not a row number. The permuted number modulo the
shard count is the shard, its quotient the slot: counts differ by at most one, slots have no gaps, and both can be computed from
the row number alone, as the row number can from shard and slot (``row_at``). The same rows and key give the same shuffle, however
the table is split into files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookflow.llm.common import free_name
from bookflow.settings import stage

ROUNDS = 6
#: Steps along a cycle. Fewer numbers than the base are no row numbers: up to 64 * 64 rows no walk is longer, and beyond them a
#: number needs a longer one with a chance below 1e-100; that would be an error, never a wrong place.
WALK = 64
HEX = 12                                             # hexadecimal digits of a round's hash


def number_rows(rows: DataFrame, order: list[Column], number: str = "row", total: str = "rows") -> DataFrame:
    """``rows`` with their 0-based place in ``order`` and the number of all rows.

    Rows are dealt by ranges, sorted and written once to the shared folder; a number is the rows of all ranges before plus the place in
    the own one. Rows that ``order`` doesn't tell apart get any of their numbers; where one such group holds a third of
    all rows it is spread over many ranges. Only one row for each range (task of the exchange) meets in one task.
    """
    part, at, tie, *keys = free_name(rows, "_part", "_at", "_tie", *[f"_key{i}" for i in range(len(order))])
    keyed = rows.withColumns(dict(zip(keys, order, strict=True)) | {tie: F.monotonically_increasing_id()})
    by = [F.col(k).asc_nulls_first() for k in [*keys, tie]]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(*keys, tie)
    placed = stage(dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}),
                   "numbered-rows")
    every = Window.orderBy(part)
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    # One short row for each range, written: the join sees its size and sends it to the rows, not the rows to it.
    before = stage(sizes.select(part, (F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"),
                                F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all")),
                   "range-sizes")
    return (placed.join(before, part).withColumns({number: F.col("_before") + F.col(at), total: F.col("_all")})
            .select(*rows.columns, number, total))


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _feistel(number: Column, rows: Column, key: str, forth: bool) -> Column:
    """One application of the network (or of its inverse) to a number below the product of both bases.

    Even rounds add a keyed hash of the upper digit to the lower one, odd rounds the other way round.
    """
    lower = F.greatest(F.ceil(F.sqrt(rows.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    upper = _div(rows + lower - 1, lower)            # their product is at least the row count and less than one base above it

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        digest = F.sha2(F.concat_ws(":", F.lit(key), i.cast("string"), F.when(even, s["hi"]).otherwise(s["lo"]).cast("string")), 256)
        drawn = F.conv(F.substring(digest, 1, HEX), 16, 10).cast("bigint") * (1 if forth else -1)
        return F.struct(F.when(even, F.pmod(s["lo"] + drawn, lower)).otherwise(s["lo"]).alias("lo"),
                        F.when(even, s["hi"]).otherwise(F.pmod(s["hi"] + drawn, upper)).alias("hi"))

    rounds = F.array(*map(F.lit, range(ROUNDS) if forth else reversed(range(ROUNDS))))
    digits = F.struct(F.pmod(number, lower).alias("lo"), _div(number, lower).alias("hi"))
    return F.aggregate(rounds, digits, step, lambda s: s["hi"] * lower + s["lo"])


def permute(number: Column, rows: Column, key: str, forth: bool = True) -> Column:
    """The place of row ``number`` among ``rows`` in the shuffle of ``key``; with ``forth`` false the row at a place."""
    def walked(start: Column) -> Column:
        end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start,
                          lambda x, _: F.when(x < rows, x).otherwise(_feistel(x, rows, key, forth)))
        lost = F.raise_error(F.lit("sharding: a cycle is longer than the walk")).cast("bigint")
        return F.when(start < rows, start).otherwise(_once(end, lambda x: F.when(x < rows, x).otherwise(lost)))
    return _once(_feistel(number, rows, key, forth), walked)


def row_at(shard: Column, slot: Column, rows: Column, shards: int, key: str) -> Column:
    """The row number that is dealt to a slot of a shard."""
    return permute(slot * shards + shard, rows, key, forth=False)


def deal(docs: DataFrame, shards: int, key: str, order: list[Column], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``docs`` with the ``shard`` (0 up) and ``slot`` (0 up in each shard, no gaps) of every row.

    ``order`` tells rows apart, so that a null, an empty or a very long text is a row like any other; null values come first. Rows equal in
    all of ``order`` (repeated rows) each get a place of their own, and it doesn't matter which. Columns of ``docs`` named like the new ones
    give way; all others stay. An empty table stays empty. Fewer rows than shards leave the last shards empty. A shard's content
    depends on all rows: with one more row or shard nearly every row moves.
    """
    own = docs.drop(*[c for c in docs.columns if c.lower() in (shard.lower(), slot.lower())])
    number, rows, place = free_name(own, "_row", "_rows", "_place")
    placed = number_rows(own, order, number, rows).withColumn(place, permute(F.col(number), F.col(rows), key))
    return placed.select(*own.columns, F.pmod(F.col(place), F.lit(shards)).cast("int").alias(shard), _div(F.col(place), F.lit(shards).cast("bigint")).alias(slot))


def write_shards(dealt: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Write a dealt table to one folder for each shard, rows in slot order over its files; a shard may have many tasks."""
    dealt.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
