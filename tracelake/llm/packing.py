"""Best-fit packing planned over a histogram of lengths.

The plan depends only on how many pieces there are of each length, at most `capacity` counts, so the driver makes
it from that histogram alone. Bins are kept as counts too: per free space a list of (first sequence, how many).
Lengths go in from the longest on, each into the bins with the least free space that takes it, else into new bins.
What comes out says, for ranges of ranks within a length, in which sequences and at which offset those pieces lie.
Pieces then take their slots by their rank within their length.

Nulls: a null text is an empty one. Ties: pieces of one length and repeated rows are ranked in any order, each
gets a slot of its own. An empty table gives an empty result. `token_pieces` does not carry further columns; `pack` does,
whatever their names, save sequence_id and offset, which give way to the result's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.llm.byte_bpe import worker_bpe
from tracelake.llm.common import Workspace, frugal, text_or_empty, unused

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: its ids as little-endian unsigned 32-bit integers, the end id among them.

    A document of more than `capacity` tokens is cut into pieces of `capacity`, of which the first may be shorter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = worker_bpe(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(part["doc_id"].to_pylist(), bpe.encode_batch(part["text"].to_pylist()), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for piece in range(-(-n // capacity)):
                        stop = n if n <= capacity else start + ((n - 1) % capacity + 1 if piece == 0 else capacity)
                        for column, value in zip(out, (doc_id, piece, start, stop - start, ids[4 * start : 4 * stop]), strict=True):
                            column.append(value)
                        start = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(frugal(cut), PIECES)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of ranks, sequence of the first, offset) for every range of pieces that lie alike."""
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens can't be packed into {capacity}")
        for space in range(length, capacity):
            each = space // length  # a bin takes as many as it can, since it stays the tightest
            while left and free[space]:
                first, bins = free[space].pop()
                full = min(bins, left // each)
                for k in range(each if full else 0):
                    slots.append((length, rank, full, first, capacity - space + k * length))
                    rank += full
                left -= full * each
                if full:
                    free[space - each * length].append((first, full))
                if full < bins and left:
                    for k in range(left):
                        slots.append((length, rank + k, 1, first + full, capacity - space + k * length))
                    free[space - left * length].append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < bins:
                    free[space].append((first + full, bins - full))
        each = capacity // length
        full, rest = divmod(left, each)
        for bins, filled in ((full, each), (1, rest)):
            if bins and filled:
                for k in range(filled):
                    slots.append((length, rank, bins, sequences, k * length))
                    rank += bins
                free[capacity - filled * length].append((sequences, bins))
                sequences += bins
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY, workspace: Workspace | None = None) -> DataFrame:
    """`pieces` (any columns, with length) and for each row sequence_id and offset.

    Ranks within a length need no task that sees all pieces of a length: rows are numbered as they are written, dealt by a
    hash of that number, ranked within (length, deal), and each deal's first rank is a running sum of counts. So neither
    a length nor a key that many rows have makes one task's work.
    """
    spark = pieces.sparkSession
    workspace = workspace or Workspace(spark, "packing")
    pieces = pieces.drop(*(c for c in pieces.columns if c.lower() in ("sequence_id", "offset")))
    row, deal, n, first, rank = unused(pieces.columns, "row", "deal", "n", "first", "rank")
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = workspace.save("pieces", pieces.withColumn(row, F.monotonically_increasing_id()))
    table = numbered.withColumn(deal, F.pmod(F.xxhash64(row), F.lit(deals)).cast("int"))
    counts = workspace.save("counts", table.groupBy("length", deal).agg(F.count("*").alias(n)))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum(n)).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy(deal).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", deal, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = F.row_number().over(Window.partitionBy("length", deal).orderBy(row))
    # up to capacity * deals rows: merged with what the window has sorted already, never broadcast
    ranked = table.withColumn(rank, within).join(firsts.hint("merge"), ["length", deal])
    ranked = ranked.select(*pieces.columns, (F.col(first) + F.col(rank) - 1).alias(rank))

    slots = np.array(sorted(plan_slots(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast(slots)  # some rows for each length, whatever the number of pieces
    span = int(max(histogram.values(), default=0)) + 1

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts, _, sequence, offset = plan.value.T
        keys = lengths * span + starts
        for batch in batches:
            ranks = np.asarray(batch[rank]).astype(np.int64)
            at = np.searchsorted(keys, np.asarray(batch["length"]).astype(np.int64) * span + ranks, side="right") - 1
            kept = batch.drop_columns([rank])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence[at] + ranks - starts[at], pa.int64()), pa.array(offset[at], pa.int64())], names=[*kept.schema.names, "sequence_id", "offset"])

    schema = StructType(pieces.schema.fields[:]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(frugal(take), schema)
