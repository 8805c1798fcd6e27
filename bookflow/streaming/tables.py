"""Tables that streams keep up to date: Spark's Parquet writer with dynamic partition overwrite.

Rows are dealt over a fixed number of partitions by a hash of their key. A micro-batch reads and writes the partitions that it touches and no
others. Merging twice changes nothing, so a batch that is tried again after a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.operators.notes import merge_with_tombstones
from bookflow.settings import stage

PARTITIONS = 64
SLOT = "_slot"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table without its partition column; None before the first batch."""
    try:
        return spark.read.parquet(path).drop(SLOT)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def merge_batches(path: str, by: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame],
                  partitions: int = PARTITIONS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: ``merge`` of the touched part of the table (None: no table yet) and the batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        slot = F.pmod(F.xxhash64(*by), F.lit(partitions)).cast("int")
        new = stage(batch.withColumn(SLOT, slot), "micro-batch")
        touched = [r[0] for r in new.select(SLOT).distinct().collect()]      # at most ``partitions``
        if not touched:
            return
        old = None
        if read_table(spark, path) is not None:
            old = spark.read.parquet(path).where(F.col(SLOT).isin(touched)).drop(SLOT)
        merged = stage(merge(old, new.drop(SLOT)).withColumn(SLOT, slot), "merged")
        merged.repartition(SLOT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SLOT).parquet(path)
    return write


def _merge_notes(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    base = old if old is not None else batch.filter(F.lit(False)).drop("seq")
    live, dead = merge_with_tombstones(base, batch)
    stamp = F.coalesce(F.nullif("updated", F.lit("")), F.nullif("created", F.lit("")))   # an empty stamp is none
    stamps = base.unionByName(batch, allowMissingColumns=True).groupBy("book", "id").agg(F.max(stamp).alias("updated"))
    graves = dead.join(stamps, ["book", "id"]).withColumn("deleted", F.lit(True))
    return live.withColumn("deleted", F.lit(False)).unionByName(graves, allowMissingColumns=True).select(*base.columns)


def merge_notes_batches(path: str, partitions: int = PARTITIONS) -> Callable[[DataFrame, int], None]:
    """Notes: last write wins with tombstones, which stay in the table, so that an older copy arriving later can't revive a note."""
    return merge_batches(path, ["book", "id"], _merge_notes, partitions)
