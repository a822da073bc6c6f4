"""SentencePiece columns of a table of texts: ids, what they decode to, and digests of both.

Codec and its bounds: `merge_codec`. Nulls: a null text is an empty one, a null doc_id stays null. Repeated rows each
give a row. An empty table gives an empty result. Of the input's columns the key and the text are read, whatever
others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import frugal, text_or_empty
from tracelake.llm.merge_codec import worker_codec

#: Rows that are in Python's memory at a time.
ROWS = 128
COLUMNS = {
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "decoded": (pa.string(), "string"),
    "n_tokens": (pa.int64(), "long"),
    "ids_sha256": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
}


def sentencepiece_columns(docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("ids", "decoded"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the wanted columns (see `COLUMNS`) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model_path)
        decimal = [str(i) for i in range(codec.library.get_piece_size())]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = codec.encode_batch(part["text"].to_pylist())
                decoded = codec.decode_batch(ids) if any(c.startswith("decoded") for c in columns) else []
                made = {
                    "ids": lambda ids=ids: ids,
                    "decoded": lambda decoded=decoded: decoded,
                    "n_tokens": lambda ids=ids: list(map(len, ids)),
                    "ids_sha256": lambda ids=ids: [hashlib.sha256(",".join(map(decimal.__getitem__, i)).encode()).hexdigest() for i in ids],
                    "decoded_sha256": lambda decoded=decoded: [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
                }
                yield pa.RecordBatch.from_arrays([part["key"], *(pa.array(made[c](), COLUMNS[c][0]) for c in columns)], names=["key", *columns])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(frugal(work), ", ".join([f"key {kind}", *(f"{c} {COLUMNS[c][1]}" for c in columns)])).withColumnRenamed("key", key)
