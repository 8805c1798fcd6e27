"""Files that tasks list and read: the driver learns the folders above them, never the files.

Spark's file sources keep every file's name and status on the driver and open a task for a few dozen small files; a folder of
millions of documents outgrows both. Here the last components of a pattern are matched by tasks, and files are dealt over tasks by
their bytes and their number.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.settings import stage

TASK_BYTES, TASK_FILES = 32 << 20, 16384       # of files that one task reads
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096        # of what a task passes on at once
CHUNK = 1 << 20
#: Files of this ending are compressed as they are written and read; their bytes count for so many.
PACKED, PACKED_RATIO = ".zst", 16
LISTED = "root string, folder string, rel string, dir string, name string, length long, modificationTime timestamp"


def _wild(part: str) -> bool:
    return any(c in part for c in "*?[")


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def _folders(spark: SparkSession, pattern: str) -> list[tuple[str, str]]:
    """The folders that match a pattern: as URI and as Hadoop shows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    parts, out = pattern.rstrip("/").split("/")[::-1], []
    for s in found:
        shown, uri = s.getPath().toString(), s.getPath().toUri().toString()
        names = shown.split("/")[::-1]
        if s.isDirectory() and not any(_wild(p) and _hidden(n) for p, n in zip(parts, names)):
            out.append((uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri, shown))
    return out


def _walk(fs, base: str, parts: list[str]) -> Iterator:
    """Files below ``base`` whose path matches ``parts``."""
    from pyarrow.fs import FileSelector, FileType
    if _wild(parts[0]):
        found = [f for f in fs.get_file_info(FileSelector(base, allow_not_found=True)) if fnmatchcase(f.base_name, parts[0]) and not _hidden(f.base_name)]
    else:
        found = [fs.get_file_info(f"{base}/{parts[0]}")]
    for f in found:
        if parts[1:] and f.type == FileType.Directory:
            yield from _walk(fs, f.path, parts[1:])
        elif not parts[1:] and f.type == FileType.File:
            yield f


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded in rows and bytes."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if n >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def listed(spark: SparkSession, pattern: str, by_tasks: int = 2) -> DataFrame:
    """Files that match ``pattern`` (LISTED), whose last ``by_tasks`` components tasks match; ``dir`` is the name of a file's folder.

    Written once, so that what reads the files knows how many there are and how large.
    """
    head, *parts = pattern.rstrip("/").rsplit("/", by_tasks)
    folders = _folders(spark, head)
    s, t = pa.string(), pa.timestamp("us", "UTC")
    schema = pa.schema([("root", s), ("folder", s), ("rel", s), ("dir", s), ("name", s), ("length", pa.int64()), ("modificationTime", t)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        def rows():
            for b in batches:
                for root, shown in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    fs, base = FileSystem.from_uri(root)
                    for f in _walk(fs, base.rstrip("/"), parts):
                        yield root, shown, f.path[len(base.rstrip("/")) + 1:], f.path.rsplit("/", 2)[-2], f.base_name, f.size, f.mtime
        return _batches(rows(), schema, lambda r: 100)

    d = spark.createDataFrame(folders, "root string, folder string").repartition(max(1, min(len(folders), 1024)))
    return stage(d.mapInArrow(run, LISTED), "files")


def dealt(files: DataFrame) -> DataFrame:
    """Listed files over as many tasks as their bytes (or characters, once known) and their number ask for."""
    weight = F.greatest("length", "n") if "n" in files.columns else F.when(
        F.col("name").endswith(PACKED), F.col("length") * PACKED_RATIO).otherwise(F.col("length"))
    n, size = files.agg(F.count("*"), F.sum(weight)).first()
    return files.repartition(1 + (size or 0) // TASK_BYTES + n // TASK_FILES, "root", "rel")


def _opened(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[tuple]:
    """Every listed file's open stream with its kept columns."""
    from pyarrow.fs import FileSystem
    known: dict[str, tuple] = {}
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("root", "rel", *keep)]
        for root, rel, *kept in zip(*cols, strict=True):
            if root not in known:
                known[root] = FileSystem.from_uri(root)
            fs, base = known[root]
            with fs.open_input_stream(f"{base.rstrip('/')}/{rel}") as f:
                yield f, kept


def _texts(f) -> Iterator[str]:
    """A stream's text in chunks."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    while data := f.read(CHUNK):
        yield decode(data)
    yield decode(b"", True)


def whole_texts(files: DataFrame) -> DataFrame:
    """(dir, name, value): every listed file's whole text."""
    schema = pa.schema([("dir", pa.string()), ("name", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*kept, "".join(_texts(f))) for f, kept in _opened(batches, ["dir", "name"]))
        return _batches(rows, schema, lambda r: len(r[2]) + 50)
    return dealt(files).mapInArrow(run, "dir string, name string, value string")


def lines(files: DataFrame) -> DataFrame:
    """(dir, line): the listed files' lines, without their line feeds."""
    schema = pa.schema([("dir", pa.string()), ("line", pa.string())])

    def cut(f, name: str) -> Iterator[tuple]:
        rest: list[str] = []                           # pieces of a line that goes on
        for text in _texts(f):
            *ended, last = text.split("\n")
            for x in ended:
                yield name, "".join([*rest, x])
                rest = []
            rest.append(last)
        if last := "".join(rest):
            yield name, last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for f, kept in _opened(batches, ["dir"]) for r in cut(f, *kept))
        return _batches(rows, schema, lambda r: len(r[1]) + 50)
    return dealt(files).mapInArrow(run, "dir string, line string")


def lengths(files: DataFrame) -> DataFrame:
    """The listed files with ``n``, their code points."""
    keep = ["dir", "name", "length"]
    s = pa.string()
    schema = pa.schema([("dir", s), ("name", s), ("length", pa.int64()), ("root", s), ("rel", s), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*kept, sum(map(len, _texts(f)))) for f, kept in _opened(batches, [*keep, "root", "rel"]))
        return _batches(rows, schema, lambda r: 100)
    return dealt(files).mapInArrow(run, "dir string, name string, length long, root string, rel string, n long")


def blocks(files: DataFrame, chars: int) -> DataFrame:
    """(dir, name, block, x, whole): the files' texts, whose offset in their document is ``start``, cut where a block of ``chars`` ends.

    ``whole`` tells blocks that need no piece of another file: full ones, and the last of a document (``start`` + ``n`` = ``total``).
    """
    s = pa.string()
    schema = pa.schema([("dir", s), ("name", s), ("block", pa.int64()), ("x", s), ("whole", pa.bool_())])

    def cut(f, name: str, of: str, start: int, total: int) -> Iterator[tuple]:
        at, rest = start, ""
        for text in _texts(f):
            rest, i = rest + text, 0
            while len(rest) - i >= (n := chars - at % chars):
                yield name, of, at // chars, rest[i:i + n], n == chars
                at, i = at + n, i + n
            rest = rest[i:]
        if rest:
            yield name, of, at // chars, rest, at % chars == 0 and at + len(rest) == total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for f, kept in _opened(batches, ["dir", "name", "start", "total"]) for r in cut(f, *kept))
        return _batches(rows, schema, lambda r: len(r[3]) + 50)
    return dealt(files).mapInArrow(run, "dir string, name string, block long, x string, whole boolean")
