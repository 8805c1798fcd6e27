"""Fixed values of the data contract, and the session settings the plans rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# ---- Fixed values (results depend on them; do not tune) -----------------------------------
SAMPLE_RATE = 24000            # audio samples per second
WORDS_PER_SECOND = 2.9         # speech rate of the deterministic duration model
MIN_SENTENCE_SECONDS = 0.35
SENTENCE_GAP_MS = 90
PARAGRAPH_GAP_MS = 320
SENTENCE_LEAD_MS = 250
TIMING_VERSION = 2
SECTION_WORDS = 1400           # words that close a section when a book has no chapters
FRONT_MATTER_CHARS = 600
CHUNK_CHARS = 1200
SAMPLE_BUDGET = 40000
MAX_NOTE, MAX_EXACT, MAX_CONTEXT, MAX_TAGS, MAX_TAG = 10_000, 2_000, 64, 20, 40
COLORS = ("yellow", "green", "blue", "pink", "purple")
KINDS = ("highlight", "note")
NOTE_FIELDS = ("id", "ch", "si", "sj", "cs", "ce", "s", "e", "exact", "prefix", "suffix",
               "color", "tags", "note", "kind", "created", "updated", "deleted")
BOOK_SUFFIXES = (".pdf", ".epub")

# Rows of one key that may meet in one task: every ordered scan first works inside blocks of
# this many positions and then carries one small total per block (operators/scan.py).
BLOCK = 4096

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split over several tasks even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows here are small but costly (regular expressions, JSON): do not merge partitions below
    # what the cores can share just because they hold few bytes.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # What is staged is compressed, rows in a hash table aren't: without this a join takes many times the bytes that it may
    # broadcast, through the driver, because their files are small.
    "spark.sql.sources.fileCompressionFactor": "16.0",
    # Recursive queries (navigation trees) over any number of books.
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts travel in Arrow batches: they are bounded in bytes, not only in rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Timers and several states of one key need this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings; cluster sizing is left to whoever submits the job."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


#: Shuffle files of an execution are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []
_staged: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Without that setting a local session (tests) gets one temporary folder of its own; a cluster
    gets an error, as its executors could not see each other's local files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-bookflow-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = _own[0]
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; ``drop_staged`` deletes it too."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an expensive intermediate once and read it back.

    Consumers then scan only the columns they need (an offset scan reads the lengths, not the
    text), lineage is cut, and a lost executor costs a re-read instead of a recomputation. What the write has shuffled
    goes from the disks when it ends: nothing reads it again.
    """
    path, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(staged: DataFrame) -> None:
    """Delete what ``stage`` has written once nothing reads it any more."""
    _staged.remove(staged.staged_at)
    _delete(staged.sparkSession, staged.staged_at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete what ``stage`` has written in this process; call it once the results are written."""
    while _staged:
        _delete(spark, _staged.pop())
