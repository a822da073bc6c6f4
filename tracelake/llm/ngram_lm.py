"""Bigram language model whose counts live in a log-frequency Bloom filter (after Talbot and Osborne 2007).

A bigram seen c times has the quantised count q = 1 + floor(log2 c). For every level j = 1..q the filter holds the
bigram with j, so probing j = 1, 2, ... until a probe fails gives q back (at times too much, never too little). Level
j stands for the middle of its counts, (3 * 2^(j-1) - 1) / 2. Smoothing is Dirichlet's: p(w | h) = (count(h w) +
weight * p(w)) / (count(h) + weight) with p(w) = (c + 0.1) / (N + 0.1 * (V + 1)); counts of words are exact.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case and one end after each text, which is the first word's
history too. Words are known by 64-bit hashes.

Plan: texts are written once as tokenised chunks, a file each in the shared folder (each word's hash once, then numbers);
only files that the saved manifest names count. A chunk sends, for each hash range
in which it has any, its words and bigrams once with their counts. The task of a range adds them up, builds the range's
part of the filter, saves it, and probes it for all the bigrams that chunks sent, whether of training texts or not: so the
probes go to the part that holds their range, and the filter, which grows with the corpus, is never in one place. Exact
counts of words and quantised ones of bigrams (a byte each) come back to the chunks, which score their texts.

Every byte sent stands for a word or bigram of a chunk, so messages grow with the corpus. So does their number: chunks and
ranges both grow with the square root of the corpus (SPREAD), as does a task's memory: at 10^13 tokens a chunk has 25
million. No key can be hot, since a chunk sends a word or bigram once. Within a range bigrams are known by 40 bits.

Nulls: a null text is an empty one (its end alone is scored); a null doc_id is held in (its row trains) and stays null.
Repeated rows are texts of their own. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import Workspace, frugal, text_or_empty
from tracelake.llm.shingles import mix

#: Least tokens of a chunk, and least entries sent to a range.
CHUNK_TOKENS, RANGE_ENTRIES = 500_000, 1_000_000
#: Tokens of a chunk and entries of a range, by the square root of the corpus' tokens.
SPREAD = 8
#: Bytes of text for a token when its number is estimated.
TOKEN_BYTES = 6
#: Filter bits for each (bigram, level), and probes for each.
BITS, PROBES = 10, 5
WEIGHT = 200.0
END = np.uint64(0x5EED0E4DC0FFEE11)
_M = np.uint64(0xD6E8FEB86659FD93)
CHUNKS = "chunk string, n_train long, n_tokens long"
LOW = np.uint64(2**40 - 1)


def bigram_hashes(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history * _M ^ mix(word))


def _probe_places(hashes: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """(PROBES, n) bit places in a part of `bits` bits."""
    a = mix(hashes ^ mix(np.atleast_1d(np.asarray(level, dtype=np.uint64))))
    b = mix(a) | np.uint64(1)
    spread = (a[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * b[None, :]) >> np.uint64(32)
    return (spread * np.uint64(bits)) >> np.uint64(32)


def build_part(hashes: np.ndarray, counts: np.ndarray, bits_each: int = BITS) -> bytes:
    """The filter of one hash range, `bits_each` bits for each entry."""
    level = 1 + np.floor(np.log2(counts)).astype(np.int64)
    entries = int(level.sum())
    bits = 8 * -(-max(64, entries * bits_each) // 8)
    filled = np.zeros(bits, dtype=np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        for row in _probe_places(hashes[level >= j], j, bits):
            filled[row.astype(np.int64)] = 1
    return np.packbits(filled, bitorder="little").tobytes()


def probe_levels(part: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The quantised count of each bigram by repeated probes."""
    level = np.zeros(len(hashes), dtype=np.int64)
    asked, j = np.arange(len(hashes)), 1
    while len(asked):
        there = np.ones(len(asked), dtype=bool)
        for row in _probe_places(hashes[asked], j, 8 * len(part)):
            there &= (part[(row >> np.uint64(3)).astype(np.int64)] >> (row & np.uint64(7)).astype(np.uint8)) & 1 > 0
        asked = asked[there]
        level[asked] = j
        j += 1
    return level


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def tokenised(docs: DataFrame, held_out: Column, folder: str, chunk_tokens: int) -> DataFrame:
    """A row for each chunk, which is a file of texts as numbers into the chunk's list of word hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        ids: list = []
        held: list = []
        texts: list[np.ndarray] = []
        size = 0
        store, base = _open(folder)

        def flush() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), dtype=np.uint64, count=len(number))
            order = np.argsort(words)  # ascending, so that hash ranges are slices
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            tokens = place[np.concatenate([np.zeros(0, dtype=np.uint32), *texts])]
            out = io.BytesIO()
            np.savez(
                out,
                doc_ids=np.array([0 if i is None else i for i in ids], dtype=np.int64),
                nulls=np.array([i is None for i in ids], dtype=bool),
                held=np.array(held, dtype=bool),
                lengths=np.array(list(map(len, texts)), dtype=np.int64),
                words=words[order],
                tokens=tokens,
            )
            name = f"chunk-{uuid.uuid4().hex}.npz.zst"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}", compression="zstd") as f:
                f.write(out.getbuffer())
            row = (f"{folder}/{name}", len(held) - sum(held), len(tokens) + len(held))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["chunk", "n_train", "n_tokens"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for doc_id, out, text in zip(rows["doc_id"].to_pylist(), rows["held"].to_pylist(), rows["text"].to_pylist(), strict=True):
                    words = text.encode().lower().split()
                    for w in set(words).difference(number):
                        number[w] = len(number)
                    ids.append(doc_id)
                    held.append(bool(out))
                    texts.append(np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words)))
                    size += len(words) + 1
                    if size >= chunk_tokens:
                        yield flush()
                        number, ids, held, texts, size = {}, [], [], [], 0
        if ids:
            yield flush()

    return docs.select("doc_id", held_out.alias("held"), text_or_empty().alias("text")).mapInArrow(frugal(work), CHUNKS)


class _Chunk:
    def __init__(self, path: str):
        store, name = _open(path)
        with store.open_input_stream(name, compression="zstd") as f:
            data = np.load(io.BytesIO(f.read()))
        self.doc_ids, self.nulls, self.held, self.lengths, self.words, self.tokens = (data[n] for n in ("doc_ids", "nulls", "held", "lengths", "words", "tokens"))

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each token's text, token numbers) with an end, numbered len(words), after each text."""
        ends = np.cumsum(self.lengths + 1) - 1
        out = np.full(int(self.lengths.sum()) + len(self.lengths), len(self.words), dtype=np.int64)
        inside = np.ones(len(out), dtype=bool)
        inside[ends] = False
        out[inside] = self.tokens
        return np.repeat(np.arange(len(self.lengths)), self.lengths + 1), out

    def pairs(self) -> tuple[np.ndarray, ...]:
        """For each token its text, its word, the word before it and its bigram's place among the distinct ones; and these'
        hashes, ascending."""
        text, stream = self.stream()
        end = len(self.words)
        history = np.concatenate(([end], stream[:-1]))  # an end stands before each text
        pair, at = np.unique(history * (end + 1) + stream, return_inverse=True)
        hashes = np.append(self.words, END)
        bi = bigram_hashes(hashes[pair // (end + 1)], hashes[pair % (end + 1)])
        order = np.argsort(bi, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return text, stream, history, place[at], bi[order]


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _low_bytes(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray((hashes & LOW).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_low_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


SENT = "r int, chunk string, words binary, counts binary, bigrams binary, others binary"


def _sent(ranges: int):
    """Chunks to messages: for each hash range the chunk's words and bigrams in it, with their counts in training texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch["chunk"].to_pylist()):
            c = _Chunk(path)
            text, stream, _, place, bi = c.pairs()
            trains = ~c.held[text]
            count = np.bincount(stream[trains], minlength=len(c.words) + 1)[:-1]
            pair_count = np.bincount(place[trains], minlength=len(bi))
            edges = np.arange(ranges + 1)
            w_at = np.searchsorted(_range_of(c.words, ranges), edges)
            b_at = np.searchsorted(_range_of(bi, ranges), edges)
            out: list[list] = [[], [], [], [], [], []]
            for r in range(ranges):
                w, b = slice(w_at[r], w_at[r + 1]), slice(b_at[r], b_at[r + 1])
                if w.start == w.stop and b.start == b.stop:
                    continue
                other = np.flatnonzero(pair_count[b] != 1)  # most bigrams stand once in a chunk
                values = (r, path, c.words[w].tobytes(), count[w].astype("<u4").tobytes(), _low_bytes(bi[b]), np.stack((other, pair_count[b][other])).astype("<u4").tobytes())
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(out, (pa.int32(), pa.string(), *[pa.binary()] * 4), strict=True)], names=["r", "chunk", "words", "counts", "bigrams", "others"])

    return work


ANSWERED = "r int, chunk string, counts binary, levels binary, part binary, distinct long, tokens long"
_SENT = pa.schema([("r", pa.int32()), ("chunk", pa.string()), *((n, pa.binary()) for n in ("words", "counts", "bigrams", "others"))])
_ANSWERED = pa.schema([("r", pa.int32()), ("chunk", pa.string()), *((n, pa.binary()) for n in ("counts", "levels", "part")), ("distinct", pa.int64()), ("tokens", pa.int64())])


def _range_task(bits_each: int):
    """One hash range, which is a task: its part of the filter (a row without chunk), and each chunk's answers (rows without part)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches, _SENT).to_pydict()
        if not group["r"]:
            return
        words = np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in group["words"]])
        counts = np.concatenate([np.frombuffer(b, dtype="<u4") for b in group["counts"]]).astype(np.int64)
        distinct, at = np.unique(words, return_inverse=True)
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, at, counts)
        answers = np.split(total[at].astype("<i8"), np.cumsum([len(b) // 8 for b in group["words"]])[:-1])
        del words, counts, at

        keys = np.concatenate([_from_low_bytes(b) for b in group["bigrams"]])
        sizes = np.array([len(b) // 5 for b in group["bigrams"]])
        seen = np.ones(len(keys), dtype=np.int64)
        for first, others in zip(np.cumsum(sizes) - sizes, group["others"], strict=True):
            where, what = np.frombuffer(others, dtype="<u4").reshape(2, -1)
            seen[first + where.astype(np.int64)] = what
        distinct, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, weights=seen, minlength=len(distinct)).astype(np.int64)
        part = build_part(distinct[n > 0], n[n > 0], bits_each)
        level = probe_levels(np.frombuffer(part, dtype=np.uint8), distinct).astype(np.uint8)
        levels = np.split(level[at], np.cumsum(sizes)[:-1])

        r = group["r"][0]
        for at in range(0, len(answers), 64):
            some = slice(at, at + 64)
            n = len(group["chunk"][some])
            columns = [[r] * n, group["chunk"][some], [a.tobytes() for a in answers[some]], [b.tobytes() for b in levels[some]], [None] * n, [0] * n, [0] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ANSWERED.types, strict=True)], schema=_ANSWERED)
        row = (r, None, None, None, part, int((total > 0).sum()), int(total.sum()))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ANSWERED.types, strict=True)], schema=_ANSWERED)

    return work


def score_texts(docs: DataFrame, held_out: Column, workspace: Workspace | None = None, chunk_tokens: int = CHUNK_TOKENS, range_entries: int = RANGE_ENTRIES, bits: int = BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each text, learning from those not held out."""
    spark = docs.sparkSession
    workspace = workspace or Workspace(spark, "lm")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    side = int(SPREAD * (size / TOKEN_BYTES) ** 0.5)
    chunks = workspace.save("chunks", tokenised(docs, held_out, workspace.path("texts"), max(chunk_tokens, side)))
    sums = chunks.agg(F.sum("n_train").alias("n_train"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n")).first()
    n_chunks, n_train, entries = sums["n"], sums["n_train"] or 0, sums["n_tokens"] or 0
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + 20 * entries // range_entries)  # work for all cores
    ranges = max(1, least, -(-entries // max(range_entries, side)))
    n_parts = max(1, n_chunks)  # about a chunk a task
    sent = chunks.select("chunk").repartition(n_parts, "chunk").mapInArrow(frugal(_sent(ranges)), SENT)
    answered = workspace.save("answered", sent.repartitionById(ranges, "r").mapInArrow(frugal(_range_task(bits)), ANSWERED))
    sums = answered.where("chunk IS NULL").agg(F.sum("distinct").alias("v"), F.sum("tokens").alias("n")).first()
    n_tokens = int(sums["n"] or 0) + n_train
    vocabulary = int(sums["v"] or 0) + (1 if n_train else 0)

    answers = answered.where("chunk IS NOT NULL").select("chunk", "r", "counts", "levels").repartition(n_parts, "chunk").sortWithinPartitions("chunk", "r")
    scored = answers.mapInArrow(frugal(_scorer(n_tokens, vocabulary, n_train)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _scorer(n_tokens: int, vocabulary: int, n_train: int):
    def scores(path: str, counts: list[bytes], levels: list[bytes]) -> pa.RecordBatch:
        c = _Chunk(path)
        text, stream, history, place, _ = c.pairs()
        count = np.append(np.frombuffer(b"".join(counts), dtype="<i8"), n_train).astype(np.float64)
        level = np.frombuffer(b"".join(levels), dtype=np.uint8).astype(np.float64)
        share = (count + 0.1) / (n_tokens + 0.1 * (vocabulary + 1))
        seen = np.where(level > 0, (3.0 * 2.0 ** (level - 1) - 1) / 2, 0.0)[place]
        before = count[history]
        p = (np.minimum(seen, before) + WEIGHT * share[stream]) / (before + WEIGHT)
        n = len(c.lengths)
        known = np.bincount(text, weights=count[stream] > 0, minlength=n).astype(np.int64)
        base = np.bincount(text, weights=np.log10(share)[stream], minlength=n)
        score = np.bincount(text, weights=np.log10(p), minlength=n)
        return pa.RecordBatch.from_arrays([pa.array(c.doc_ids, mask=c.nulls), pa.array(c.held), pa.array(c.lengths + 1), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk and ascending range: a chunk's answers in a row are those of its words and bigrams in a row."""
        chunk, counts, levels = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                for path, a, b in zip(rows["chunk"].to_pylist(), rows["counts"].to_pylist(), rows["levels"].to_pylist(), strict=True):
                    if path != chunk:
                        if chunk is not None:
                            yield scores(chunk, counts, levels)
                        chunk, counts, levels = path, [], []
                    counts.append(a)
                    levels.append(b)
        if chunk is not None:
            yield scores(chunk, counts, levels)

    return work
