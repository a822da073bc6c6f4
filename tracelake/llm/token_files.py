"""Token ids as binary files in ascending doc_id order (format: `pfor`), written and read by the executors.

Documents are dealt by ranges of (doc_id, number of the row), so that one id of many rows is many tasks' work, and sorted
there; a task writes files of about `FILE_TOKENS` ids under
names of its own attempt, and only the names in the manifest count, so a task that is run again leaves at most a
file nobody reads. The manifest has a row for each file; running sums over it, first within a task's files, then over the
tasks' totals, give each document's start.

Nulls: a null text is an empty one (its end id only); a null doc_id comes first and is null again when read.
Ties: rows of one doc_id lie next to each other in any order. An empty table makes an empty manifest. Further
columns are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import pfor
from tracelake.llm.byte_bpe import worker_bpe
from tracelake.llm.common import Workspace, frugal, text_or_empty

FILE_TOKENS = 2_000_000
NO_ID = -(2**63)
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer_path: str, workspace: Workspace, end_id: int, percentile: float = pfor.PERCENTILE, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """The manifest of the files with all documents' ids, the end id after each."""
    folder = workspace.path("files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, part = worker_bpe(tokenizer_path), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        store, base = _open(folder)
        doc_ids: list[int] = []
        blobs: list[bytes] = []
        seq = n_ids = 0

        def flush() -> pa.RecordBatch:
            data = pfor.write_file(np.array(doc_ids, dtype="<i8"), np.array([len(b) // 4 for b in blobs], dtype="<u4"), np.frombuffer(b"".join(blobs), dtype="<u4"), percentile)
            name = f"ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.pfor"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            row = (part, seq, f"{folder}/{name}", len(blobs), n_ids, len(data))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for doc_id, ids in zip(rows["doc_id"].to_pylist(), bpe.encode_batch(rows["text"].to_pylist()), strict=True):
                    doc_ids.append(NO_ID if doc_id is None else doc_id)
                    blobs.append(ids + end)
                    n_ids += len(blobs[-1]) // 4
                    if n_ids >= file_tokens:
                        yield flush()
                        doc_ids, blobs, n_ids, seq = [], [], 0, seq + 1
        if blobs:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = numbered.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    return workspace.save("manifest", dealt.mapInArrow(frugal(write), MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the manifest's files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    so_far = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", so_far(Window.orderBy("part")).alias("before"))  # a row for each writing task
    files = manifest.join(parts.hint("merge"), "part").select("path", (F.col("before") + so_far(Window.partitionBy("part").orderBy("seq"))).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist(), strict=True):
                store, name = _open(path)
                with store.open_input_stream(name) as f:
                    doc_ids, lengths, ids = pfor.read_file(f.read())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                for at in range(0, len(doc_ids), 512):
                    part = slice(at, at + 512)
                    i, j = int(starts[part][0]), int(ends[part][-1])
                    offsets = pa.py_buffer((4 * np.concatenate((starts[part], [j])) - 4 * i).astype("<i4").tobytes())
                    data = pa.py_buffer(ids[i:j].astype("<u4").tobytes())
                    m = len(doc_ids[part])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[part], pa.int64(), mask=doc_ids[part] == NO_ID), pa.array(first + starts[part]), pa.array(lengths[part].astype(np.int64)), pa.Array.from_buffers(pa.binary(), m, [None, offsets, data])], names=["doc_id", "start", "n_tokens", "ids"])

    return files.repartition(n, "path").mapInArrow(frugal(read), "doc_id long, start long, n_tokens long, ids binary")
