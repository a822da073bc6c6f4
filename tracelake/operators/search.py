"""Phrase search with BM25 ranking over token postings.

Tokens are lower-case runs of letters and digits without diacritics. A phrase must stand in one column, its tokens in a row.
`search` looks for a phrase that is known when the query is built in the text itself, with its tokens set apart by blanks:
one pass for the totals, one for the hits; only three numbers and the hits are shuffled.
`postings` is an index to be kept; `with_changes` and `phrase_hits` keep and read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

#: Letters with marks and what they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"
K1, B = 1.2, 0.75


def _tokens(text: str) -> list[str]:
    """As `search_tokens`, of a phrase that is known when the query is built."""
    folded = text.lower().translate(str.maketrans(MARKED, PLAIN))
    return "".join(c if c.isalpha() or c.isnumeric() else " " for c in folded).split()


def search_tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.translate(F.lower(text), MARKED, PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def once(value: Column, use) -> Column:
    """use(value) with the value computed once a row, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def set_apart(text: Column) -> Column:
    """The text's tokens, each between two blanks of its own; nothing where there is none."""
    folded = F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"[^\p{L}\p{N}]+", "  "))
    return once(folded, lambda t: F.when(t == "", "").otherwise(F.concat(F.lit(" "), t, F.lit(" "))))


def phrase_starts(tokens: Column, phrase: Column) -> Column:
    """Places at which the tokens of a phrase stand in a row; none for an empty phrase."""

    def of(t: Column) -> Column:
        n = F.size(phrase)
        at = F.when((n > 0) & (F.size(t) >= n), F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: (F.get(t, i - 1) == F.get(phrase, F.lit(0))) & (F.slice(t, i, n) == phrase))

    return once(tokens, of)


def search(table: DataFrame, key: str, columns: list[str], phrase: str, scope: Column | None = None, limit: int | None = None) -> DataFrame:
    """(key, hits, score) of the rows in which one of the columns has the phrase, best first.

    The score is BM25 of the phrase as one term, over all rows and columns together; the scope filters after matching and
    before the limit, so it changes no score.
    """
    tokens = _tokens(phrase)
    wanted = "".join(f" {t} " for t in tokens)
    overlaps = any(tokens[:n] == tokens[-n:] for n in range(1, len(tokens)))

    def of(text: Column) -> Column:
        if overlaps:  # a look ahead, so that a token may be in two hits
            hits = F.when(F.contains(text, F.lit(wanted)), F.regexp_count(text, F.lit(f"(?={wanted})"))).otherwise(0)
        else:
            hits = F.floor((F.length(text) - F.length(F.replace(text, F.lit(wanted), F.lit("")))) / len(wanted)) if tokens else F.lit(0)
        length = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("  "), F.lit(" "))) + 1)
        return F.struct(hits.alias("hits"), length.alias("length"))

    each = F.array(*(once(set_apart(F.coalesce(c, F.lit(""))), of) for c in columns))
    add = lambda parts, name: F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n + x[name])
    both = once(each, lambda parts: F.struct(add(parts, "hits").alias("hits"), add(parts, "length").alias("length")))
    # as a generator, which keeps filters and sums from computing it again
    counted = table.select(key, (scope if scope is not None else F.lit(True)).alias("in_scope"), F.explode(F.array(both)).alias("c")).select(key, "in_scope", "c.hits", "c.length")
    totals = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.sum((F.col("hits") > 0).cast("long")).alias("df"))
    found = counted.where("hits > 0").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = found.where("in_scope").select(key, "hits", score.alias("score")).orderBy(F.col("score").desc(), key)
    return out if limit is None else out.limit(limit)


def snippet(tokens: Column, phrase: Column, size: int = 10) -> Column:
    """Tokens around the first hit, the hit in brackets, "..." where something is left out."""
    at, n = F.get(phrase_starts(tokens, phrase), F.lit(0)), F.size(phrase)
    first = F.greatest(F.lit(1), at - F.floor((F.lit(size) - n) / 2).cast("int"))
    last = F.least(F.size(tokens), first + size - 1)
    before, hit, after = F.slice(tokens, first, at - first), F.slice(tokens, at, n), F.slice(tokens, at + n, F.greatest(F.lit(0), last - at - n + 1))
    text = F.concat_ws(" ", before, F.concat(F.lit("["), F.array_join(hit, " "), F.lit("]")), after)
    return F.when(at.isNotNull(), F.concat(F.when(first > 1, "...").otherwise(""), text, F.when(last < F.size(tokens), "...").otherwise("")))


#: Rows that `postings` makes before it hands them on.
POSTINGS_ROWS = 20_000


def _places(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Postings of texts, given as (key, tokens joined by blanks)."""
    for batch in batches:
        tokens, positions, owners, lengths = [], [], [], []

        def rows() -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *map(len, positions)]), pa.int32())
            flat = pa.array(np.fromiter(chain.from_iterable(positions), np.int32))
            keys = batch.column(0).take(pa.array(owners, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), keys, pa.ListArray.from_arrays(ends, flat), pa.array(lengths, pa.int32())], names=names)

        for at, joined in enumerate(batch.column(1)):
            words = joined.as_py().split()
            found: dict[str, list[int]] = {}
            for place, word in enumerate(words):
                found.setdefault(word, []).append(place)
            tokens += found
            positions += found.values()
            owners += [at] * len(found)
            lengths += [len(words)] * len(found)
            if len(tokens) >= POSTINGS_ROWS:
                yield rows()
                tokens, positions, owners, lengths = [], [], [], []
        if tokens:
            yield rows()


def postings(table: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, positions, length) of every text. A text's postings are made from its tokens at once, without a shuffle.

    Python gets a text's tokens as one string and holds one text's tokens and some `POSTINGS_ROWS` rows at a time.
    """
    schema = StructType().add("token", "string").add(key, table.schema[key].dataType).add("positions", ArrayType(IntegerType())).add("length", IntegerType())
    tokens = F.array_join(search_tokens(F.coalesce(text, F.lit(""))), " ")
    return table.select(key, tokens.alias("tokens")).mapInArrow(lambda batches: _places(batches, schema.names), schema)


def with_changes(index: DataFrame, changed: DataFrame, key: str, text: str) -> DataFrame:
    """The index after rows of `changed` (key, text; a null text is a deletion) were inserted, updated or deleted; one change a
    key. In foreachBatch it is written as the next generation."""
    kept = index.join(changed.select(key).distinct(), key, "left_anti").select(*index.columns)
    return kept.unionByName(postings(changed.where(F.col(text).isNotNull()), key, text))


def phrase_hits(index: DataFrame, key: str, phrase: str) -> DataFrame:
    """(key, hits) of the texts that have the phrase: the postings of its tokens alone are read and met by key."""
    tokens = _tokens(phrase)
    asked = F.array(*map(F.lit, tokens)).cast("array<string>")
    here = index.where(F.col("token").isin(*set(tokens))).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at"), F.count("*").alias("n"))
    full = here.where(F.col("n") == len(set(tokens)))
    starts = F.filter(F.col("at")[tokens[0]] if tokens else F.array().cast("array<int>"), lambda p: F.forall(F.sequence(F.lit(0), F.lit(len(tokens) - 1)), lambda k: F.array_contains(F.col("at")[F.get(asked, k)], p + k)))
    return full.select(key, F.size(starts).cast("long").alias("hits")).where("hits > 0") if tokens else full.select(key, F.lit(0).cast("long").alias("hits")).limit(0)
