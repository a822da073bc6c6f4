"""Removal of repeated lines by overlapping three-line windows, in DataFrame operations only.

A text's lines are what line feeds separate. Every run of `WINDOW` consecutive lines is hashed (a text of fewer
lines is one window of all its lines; an empty text has none). Windows with one hash are one window: its first
occurrence, by (doc_id, text hash, line), stays and each later one covers its lines. Covered lines go, the others
keep their order. Overlapping occurrences merge, since a line goes once however many windows cover it.

Two independent 64-bit hashes make a window's identity. Only they, never lines, are shuffled. Least positions are found with
a map-side combine, and occurrences meet their window's first one without a task that gets all of a hot window's
(`common.join_split`).
Nulls: a null text stays null; a null doc_id sorts first. Repeated rows (same doc_id and text) are one document: all
stay alike. Extra columns are kept, whatever their names; those with the result's names (a parameter) give way. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import HOT_ROWS, Workspace, join_split, unused

WINDOW = 3
RESULT = ("n_lines", "n_removed", "removed")


def _windows(lines: Column, width: int) -> Column:
    """array<struct<i, h, g>> over an array of lines."""
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b")))

    def of(each: Column) -> Column:
        def at(i: Column) -> Column:
            part = F.slice(each, i + 1, width)
            return F.struct(i.alias("i"), F.xxhash64(part["a"], F.size(part)).alias("h"), F.xxhash64(part["b"], F.size(part)).alias("g"))

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(each) - width, F.lit(0))), at)

    # a one-element array holds the hashes, so that they are computed once and not once for each window
    return F.flatten(F.transform(F.array(hashed), of))


def repeated_lines(docs: DataFrame, width: int = WINDOW, workspace: Workspace | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, text_hash, gone): for each document with a later occurrence, its text's hash and the covered lines' numbers."""
    workspace = workspace or Workspace(docs.sparkSession, "linededup")
    windows = (
        docs.where(F.length("text") > 0)
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(_windows(F.split("text", "\n", -1), width)).alias("w"))
        .select("doc_id", "text_hash", "w.i", "w.h", "w.g")
    )
    windows = workspace.save("windows", windows)
    place = F.struct("doc_id", "text_hash", "i")
    seen = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    repeated = workspace.save("repeated", seen.where(F.col("first") != F.col("last")).select("h", "g", "first", "n"))
    met = join_split(windows, repeated, ["h", "g"], "n", windows.count(), hot_rows=hot_rows)
    covered = met.where(place != F.col("first")).groupBy("doc_id", "text_hash").agg(F.collect_set("i").alias("starts"))
    return covered.select("doc_id", "text_hash", F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + width - 1)))).alias("gone"))


def drop_repeated_lines(docs: DataFrame, width: int = WINDOW, workspace: Workspace | None = None, names: tuple[str, str, str] = RESULT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`docs` with the covered lines taken out of `text`, and, under `names`, how many lines it had, how many went, and
    these lines' numbers, ascending."""
    n_lines, n_removed, removed = names
    docs = docs.drop(*(c for c in docs.columns if c.lower() in {n.lower() for n in names}))
    h, i, t, gone, lines, edges = unused([*docs.columns, *names], "hash", "id", "text_hash", "gone", "lines", "edges")
    drops = repeated_lines(docs, width, workspace, hot_rows).select(F.col("doc_id").alias(i), F.col("text_hash").alias(t), F.col("gone").alias(gone))
    joined = docs.withColumn(h, F.xxhash64("text")).join(drops, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), "left")
    joined = joined.withColumn(lines, F.split("text", "\n", -1))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    went = F.when(F.col(gone).isNull(), F.array().cast("array<int>")).otherwise(F.filter(F.array_sort(gone), lambda k: k < F.size(lines)))
    joined = joined.withColumn(n_lines, count).withColumn(removed, went).withColumn(n_removed, F.size(removed))
    # the lines between one removed line and the next stay as they are
    joined = joined.withColumn(edges, F.concat(F.array(F.lit(-1)), F.col(removed), F.array(F.size(lines))))
    edge = lambda k: F.get(edges, k)
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.slice(lines, edge(k - 1) + 2, edge(k) - edge(k - 1) - 1)))
    text = F.when(F.col(n_removed) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*docs.columns, n_lines, n_removed, removed)
