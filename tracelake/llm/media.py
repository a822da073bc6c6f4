"""Media columns of tables: MPEG audio streams made from texts, and what parsing finds in any streams.

Nulls: a null text is an empty one, null bytes give nulls; a null key stays null. Bytes that are no MPEG audio have no
frames. Repeated rows each give a row. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import frugal, text_or_empty
from tracelake.llm.mpeg_audio import build, parse, payload

BLOCK = 64
ROWS = 64
STREAMS = "key {key}, n_bytes long, media binary"
PARSED = "key {key}, feature string, frames long, samples long, rate int, seconds double, heard_seconds double, frame_offsets array<long>, resyncs long, skipped long, crc_checked long, crc_bad long, payload binary"
DIGESTS = "key {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, seconds double, frame_offsets array<long>"


def text_streams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text in UTF-8, filled with zeros to a positive multiple of 64 bytes, as a stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t.encode() for t in part["text"].to_pylist()]
                media = [build(t + bytes(max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(frugal(work), STREAMS.format(key=docs.schema[key].dataType.simpleString()))


def parsed_streams(streams: DataFrame) -> DataFrame:
    """What `parse` finds in each row's media, and the payload of streams that `text_streams` wrote (else null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for data in part["media"].to_pylist():
                    if data is None:
                        rows.append((None,) * 12)
                        continue
                    a = parse(data)
                    own = payload(data, a) if "PRIV:payload_bytes" in a.tags else None
                    rows.append((a.feature(), a.frames, a.samples, a.rate, float(a.duration), float(a.heard), a.offsets.tolist(), a.resyncs, a.skipped, a.crc_checked, a.crc_bad, own))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.binary())
                names = ["key", "feature", "frames", "samples", "rate", "seconds", "heard_seconds", "frame_offsets", "resyncs", "skipped", "crc_checked", "crc_bad", "payload"]
                yield pa.RecordBatch.from_arrays([part["key"], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return streams.select("key", "media").mapInArrow(frugal(work), PARSED.format(key=streams.schema["key"].dataType.simpleString()))


def stream_digests(streams: DataFrame) -> DataFrame:
    """Digests of each stream and of the payload read back from it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for data in part["media"].to_pylist():
                    audio = parse(data)
                    own = payload(data, audio)
                    rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), audio.feature(), audio.frames, float(audio.duration), audio.offsets.tolist()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part["key"], part["n_bytes"], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "seconds", "frame_offsets"])

    return streams.mapInArrow(frugal(work), DIGESTS.format(key=streams.schema["key"].dataType.simpleString()))
