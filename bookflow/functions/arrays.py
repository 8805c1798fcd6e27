"""Array folds that stay linear in the array length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP = 256


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lens: Column, start: Column) -> Column:
    zero = F.struct(start.cast("int").alias("pos"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lens, zero, lambda a, x: F.struct(
        (a["pos"] + x).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")),
        lambda a: a["out"])


def prefix_lengths(pieces: Column) -> Column:
    """Start of each string when the strings are laid end to end.

    Appending to an array copies it, so the fold runs over groups of 256: the copying is
    bounded per group and a page with 100,000 sentences stays cheap.
    """
    def grouped(groups):
        sums = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(groups, _running(sums, F.lit(0)), _running))

    n = F.greatest(F.lit(1), F.ceil(F.size(pieces) / _GROUP))
    lens = F.transform(pieces, F.length)
    return let(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1),
                           lambda g: F.slice(lens, (g * _GROUP + 1).cast("int"), _GROUP)), grouped)
