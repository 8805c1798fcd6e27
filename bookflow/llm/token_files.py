"""Token files: documents' ids in independent zstandard frames, with a directory and a seek table.

A shard holds the documents of one range of ids in ascending order:

* data frames, each a whole zstandard frame with its own content checksum, of whole documents
  (about FRAME_BYTES; a longer document has a frame to itself): u32 number of documents, then
  per document i64 id, u8 "id is null" and u64 number of ids, then all ids as u32;
* a skippable frame: the directory, per data frame first and last id, documents, ids;
* the seek table of the public zstandard seekable format: per frame compressed size, plain size
  and the low half of the plain bytes' XXH64, then the number of frames and the closing mark.

A reader takes the tail of the file, and then only the frames whose documents are asked for.
All numbers are little-endian.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import worker_state
from bookflow.llm.pieces import PieceCache, encode_texts, specials
from bookflow.operators.scan import prefix_sum
from bookflow.settings import stage, work_dir

FRAME_BYTES = 256 << 10
# Fixed values of the public format.
SKIPPABLE, SEEK_TABLE, CLOSING = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY, FOOTER = "<III", "<IBI"
ENTRY_SIZE, FOOTER_SIZE = struct.calcsize(ENTRY), struct.calcsize(FOOTER)
DIRECTORY = np.dtype([("first", "<i8"), ("last", "<i8"), ("docs", "<u4"), ("ids", "<u8"), ("nulls", "<u4")])


def pack_frame(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    sizes = np.array([len(x) for x in ids], "<u8")
    return b"".join([struct.pack("<I", len(ids)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                     np.array([d is None for d in doc_ids], "u1").tobytes(), sizes.tobytes(),
                     *(x.astype("<u4").tobytes() for x in ids)])


def unpack_frame(plain: bytes) -> tuple[list[int | None], list[bytes]]:
    n = struct.unpack_from("<I", plain)[0]
    doc_ids = np.frombuffer(plain, "<i8", n, 4).tolist()
    null = np.frombuffer(plain, "u1", n, 4 + 8 * n)
    sizes = np.frombuffer(plain, "<u8", n, 4 + 9 * n).astype(np.int64) * 4
    ends = 4 + 17 * n + np.cumsum(sizes)
    return ([None if x else d for d, x in zip(doc_ids, null, strict=True)],
            [plain[e - s:e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)])


class ShardWriter:
    """Writes one shard to an open stream."""

    def __init__(self, out):
        self.out, self.table, self.directory = out, [], []
        self.doc_ids, self.ids, self.size = [], [], 0
        self.zip = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.ids and self.size + 4 * len(ids) > FRAME_BYTES:
            self._flush()
        self.doc_ids.append(doc_id)
        self.ids.append(ids)
        self.size += 4 * len(ids)

    def _flush(self) -> None:
        plain = pack_frame(self.doc_ids, self.ids)
        packed = self.zip.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        real = [d for d in self.doc_ids if d is not None]
        self.directory.append((min(real, default=0), max(real, default=-1), len(self.ids), sum(map(len, self.ids)),
                               len(self.ids) - len(real)))
        self.doc_ids, self.ids, self.size = [], [], 0

    def close(self) -> None:
        if self.ids:
            self._flush()
        listed = np.array(self.directory, DIRECTORY).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(listed)) + listed)
        self.table.append((8 + len(listed), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        body = b"".join(struct.pack(ENTRY, *x) for x in self.table) + struct.pack(FOOTER, len(self.table), CHECKSUMS, CLOSING)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(body)) + body)


class ShardReader:
    """Reads documents of one shard from an open random-access file; ``frames_read`` counts what it decompressed."""

    def __init__(self, file):
        self.file, self.frames_read = file, 0
        size = file.size()
        frames, flags, closing = struct.unpack(FOOTER, self._at(size - FOOTER_SIZE, FOOTER_SIZE))
        if closing != CLOSING or flags != CHECKSUMS:
            raise ValueError("not a token file: no seek table")
        start = size - FOOTER_SIZE - ENTRY_SIZE * frames
        self.table = list(struct.iter_unpack(ENTRY, self._at(start, ENTRY_SIZE * frames)))
        offsets = np.concatenate([[0], np.cumsum([t[0] for t in self.table])])
        self.offsets = offsets.tolist()
        at, long = self.offsets[-2], self.table[-1][0]
        self.directory = np.frombuffer(self._at(at, long)[8:], DIRECTORY)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> tuple[list[int | None], list[bytes]]:
        packed, plain_size, check = self.table[k]
        plain = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[k], packed), max_output_size=plain_size)
        if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        self.frames_read += 1
        return unpack_frame(plain)

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, ids before it in the shard, its ids) of all documents, or of the wanted ones."""
        before = np.concatenate([[0], np.cumsum(self.directory["ids"].astype(np.int64))]).tolist()
        ask = sorted(wanted) if wanted is not None else None
        for k, d in enumerate(self.directory):
            if ask is not None and not within(ask, d["first"], d["last"]):
                continue
            start = before[k]
            for doc_id, ids in zip(*self.frame(k), strict=True):
                if wanted is None or doc_id in wanted:
                    yield doc_id, start, ids
                start += len(ids) // 4


def within(ask: list[int], first: int, last: int) -> bool:
    """Whether one of the sorted numbers lies in a range."""
    return bisect.bisect_left(ask, first) < bisect.bisect_right(ask, last)


def _filesystem(folder: str):
    """Executors reach the shared folder through its own scheme."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def library_encoder(vocabulary: str) -> PieceCache:
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(vocabulary)
        return PieceCache(lambda pieces: [e.ids for e in tok.encode_batch_fast(pieces, add_special_tokens=False)])
    return worker_state(f"library_bpe:{vocabulary}", make)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text with the tokenizers library, append ``end_id`` and write shards in ascending order of
    ``doc_id``; returns their manifest: shard (ascending as the ids), path, n_docs, n_tokens, first and last id (null:
    none), base (ids of all shards before).

    Null and empty texts are just the end id; null ids come first; repeated rows are written as often as they
    occur, rows of one id in the order of a hash of their texts; an id (or none) that a third of all rows have is dealt over many
    shards. An empty table has an empty manifest.  Only ``doc_id`` and ``text`` are read.  The range partitioning moves texts, not ids, so that its sampling pass doesn't encode.  A task that
    runs twice writes two files; the manifest names the one whose task was taken.
    """
    folder = folder or f"{work_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    special, special_id = specials(vocabulary)
    order = ["doc_id", "hash", "tie"]
    ordered = (docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text].isNull(), docs[text]).alias("hash"),
                           F.monotonically_increasing_id().alias("tie"))
               .repartitionByRange(*order).sortWithinPartitions(*order).drop("hash", "tie"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, out, writer, docs_n, ids_n, first, last = library_encoder(vocabulary), None, None, 0, 0, None, None
        shard = TaskContext.get().partitionId()
        system, base = _filesystem(folder)
        path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.zst"
        end = np.array([end_id], np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(path, compression=None)
                writer = ShardWriter(out)
            got = encode_texts([t or "" for t in batch.column(1).to_pylist()], cache, special, special_id)
            for d, x in zip(batch.column(0).to_pylist(), got, strict=True):
                writer.add(d, np.concatenate([x, end]))
                docs_n, ids_n, last = docs_n + 1, ids_n + len(x) + 1, d
                first = d if first is None else first
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [path],
                                              "n_docs": pa.array([docs_n], pa.int64()), "n_tokens": pa.array([ids_n], pa.int64()),
                                              "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64())})

    done = stage(ordered.mapInArrow(write, "shard bigint, path string, n_docs bigint, n_tokens bigint, first bigint, last bigint"), "token-manifest")
    return prefix_sum(done, [], ["shard"], F.expr("shard div 4096"), base=F.col("n_tokens")).withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of all
    documents, or of the wanted ones: then only the frames that may hold them are decompressed."""
    names = set(wanted) if wanted is not None else None
    ask = sorted(names) if names is not None else None
    # One shard a task; the manifest has one small row per shard.
    rows = manifest.select("folder", "path", "base", "first", "last").repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if ask is not None and (row["first"] is None or not within(ask, row["first"], row["last"])):
                    continue                         # no wanted document: the file isn't opened
                system, _ = _filesystem(row["folder"])
                with system.open_input_file(row["path"]) as f:
                    block, size = [], 0
                    for doc_id, start, ids in ShardReader(f).documents(names):
                        block.append((doc_id, row["base"] + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > (4 << 20):
                            yield _rows(block)
                            block, size = [], 0
                    if block:
                        yield _rows(block)

    return rows.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _rows(block: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block, strict=True), kinds.values(), strict=True)],
                                      list(kinds))
