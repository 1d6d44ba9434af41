"""Token ids in Arrow files with fixed-size rows: equal-length sequences and their masks.

A file (Arrow's random-access IPC format) has rows of exactly ``length`` ids and a mask of
the same length (false: padding), as fixed-size lists in batches of equally many rows.
So the place of any sequence is known without reading others, and a mapped file gives it
without copying. Documents lie one after another in ascending id order, across the
ends of rows; only a file's last row is padded. Beside each file lies an index
(``.docs.arrow``) with the place of every document.

Documents are range-partitioned by id; every task sorts, encodes and writes its own
file under a temporary name and renames it when complete. A repeated task writes the
same bytes again, so executors may be lost at any time. Memory: some batches.

Defined results: null and empty texts have the end id alone; null ids come first;
rows with equal ids are documents of their own, in order of a hash of the text;
an empty table has no files. Very long texts span many rows. Other columns of the
input take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.scratch import new_path, ship, written
from flowsift.llm.tokens import encode_with_end, release
from flowsift.llm.words import pieces

ROWS = 64
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


def file_schema(length: int, width: int) -> pa.Schema:
    """width: bytes of an id, 2 or 4."""
    ids = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([
        pa.field("ids", pa.list_(pa.field("item", ids, False), length), False),
        pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False),
    ])


class TokenFileWriter:
    """Appends runs of ids; rows go out in batches of ROWS."""

    def __init__(self, sink: pa.NativeFile, length: int, width: int):
        self.schema, self.length = file_schema(length, width), length
        self.dtype = np.uint16 if width == 2 else np.uint32
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def _rows(self, ids: np.ndarray, real: int) -> None:
        n = len(ids) // self.length
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        item = self.schema.field("ids").type.value_type
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.Array.from_buffers(item, len(ids), [None, pa.py_buffer(ids)]), type=self.schema.field("ids").type),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field("mask").type),
        ]
        assert len(lists[0]) == n
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        block = ROWS * self.length
        if self.waiting >= block:
            flat = np.concatenate(self.held)
            full = len(flat) // block * block
            for k in range(0, full, block):
                self._rows(np.ascontiguousarray(flat[k : k + block]), block)
            self.held, self.waiting = [flat[full:].copy()], len(flat) - full

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.held)
            ids = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            ids[: len(flat)] = flat
            self._rows(ids, len(flat))
        self.out.close()


class TokenFile:
    """Random access to a written file: rows, and runs of ids from any place."""

    def __init__(self, source: pa.NativeFile, length: int):
        self.reader, self.length = pa.ipc.open_file(source), length
        self.at, self.flat = -1, np.zeros(0, np.uint16)

    def _batch(self, i: int) -> np.ndarray:
        if i != self.at:
            self.at, self.flat = i, self.reader.get_batch(i).column("ids").flatten().to_numpy()
        return self.flat

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one row; the ids are a view of the file."""
        batch = self.reader.get_batch(row // ROWS)
        r = row % ROWS
        flat = batch.column("ids").flatten().to_numpy()
        mask = batch.column("mask").slice(r, 1).flatten().to_numpy(zero_copy_only=False)
        return flat[r * self.length : (r + 1) * self.length], mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        block = ROWS * self.length
        parts = []
        while n > 0:
            i, inside = divmod(start, block)
            part = self._batch(i)[inside : inside + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else self.flat[:0]


def open_source(path: str) -> pa.NativeFile:
    """The file mapped into memory where it is local, else opened."""
    system, inner = fs.FileSystem.from_uri(path)
    return pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, length: int = 2048, width: int = 2) -> DataFrame:
    """Writes the files; returns a row per file: shard, path, n_docs, n_tokens, base (ids in all files before)."""
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, mark = task.partitionId(), f"{task.taskAttemptId()}-{uuid.uuid4().hex}"
        system, base = fs.FileSystem.from_uri(folder)
        out, sink, index_sink, index, tokens, count = None, None, None, None, 0, 0
        temp = f"{base}/_{mark}"
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                if out is None:
                    system.create_dir(base, recursive=True)
                    sink, index_sink = system.open_output_stream(temp), system.open_output_stream(f"{temp}.docs")
                    out, index = TokenFileWriter(sink, length, width), pa.ipc.new_file(index_sink, INDEX)
                ids, at = encode_with_end(part.column("text"), tokenizer, end)
                out.add(ids)
                index.write_batch(pa.record_batch(
                    [part.column("doc_id"), pa.array(at[:-1] + tokens), pa.array(np.diff(at))], schema=INDEX
                ))
                tokens, count = tokens + len(ids), count + part.num_rows
        if out is None:
            return
        out.close()
        index.close()
        sink.close()
        index_sink.close()
        name = f"part-{shard:06d}"
        system.move(f"{temp}.docs", f"{base}/{name}.docs.arrow")
        system.move(temp, f"{base}/{name}.arrow")
        release()
        yield pa.record_batch({
            "shard": pa.array([shard], pa.int64()), "path": pa.array([f"{folder}/{name}"]),
            "n_docs": pa.array([count], pa.int64()), "n_tokens": pa.array([tokens], pa.int64()),
        })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order", "text").drop("order")
    files = written(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(files: DataFrame, length: int = 2048) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before), n_tokens, ids (unsigned 32-bit, little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with open_source(f"{path}.arrow") as source, open_source(f"{path}.docs.arrow") as index_source:
                    file, index = TokenFile(source, length), pa.ipc.open_file(index_source)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        starts, n = docs.column("start").to_numpy(), docs.column("length").to_numpy()
                        for k in range(0, len(n), 1000):
                            ids = [file.tokens(s, m).astype("<u4").tobytes() for s, m in zip(starts[k : k + 1000].tolist(), n[k : k + 1000].tolist(), strict=True)]
                            yield pa.record_batch({
                                "doc_id": docs.column("doc_id").slice(k, 1000), "start": pa.array(starts[k : k + 1000] + base),
                                "n_tokens": pa.array(n[k : k + 1000]), "ids": pa.array(ids, pa.binary()),
                            })

    placed = written(files.select("shard", "path", "base"), "token-files")
    spread = placed.repartitionByRange(max(1, placed.count()), "shard")  # about a file a task
    return spread.select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(docs, new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
