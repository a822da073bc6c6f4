"""Blocks of text to chunks, content versions and identities.

Packing depends on the order of one content's blocks alone, so each content is packed by itself inside a row, by a fold
over its blocks' lengths that yields ranges of blocks; no shuffle is needed and no content is split between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import token_estimate
from tracelake.operators.search import once

TARGET, OVERLAP = 4000, 0.10
BLOCKS = "array<struct<text:string,char_start:int,char_end:int,section_path:string,location_label:string>>"


def cut_blocks(blocks: Column, target: int) -> Column:
    """Blocks in which each one of more than `target` characters is cut: at the last blank within reach, else at `target`; blanks
    at a cut belong to no piece, and blank pieces are none."""
    reach = f".{{1,{target}}}\\z" + (f"|.{{1,{target - 1}}}(?= )" if target > 1 else "") + f"|.{{{target}}}"
    whole, piece = (F.lit(f"(?s)({reach}) *"), 0), (F.lit(f"(?s)({reach}) *"), 1)

    def pieces(b: Column) -> Column:
        def at(spans: Column) -> Column:
            before = lambda k: F.aggregate(F.slice(spans, 1, k), F.lit(0), lambda n, x: n + F.length(x))

            def of(p: Column, k: Column) -> Column:
                start = b["char_start"] + before(k)
                return F.struct(p.alias("text"), start.alias("char_start"), (start + F.length(p)).alias("char_end"), b["section_path"].alias("section_path"), b["location_label"].alias("location_label"))

            return F.filter(F.transform(F.regexp_extract_all(b["text"], *piece), of), lambda x: x["text"].rlike(r"(?U)\S"))

        return once(F.regexp_extract_all(b["text"], *whole), at)

    return F.flatten(F.transform(blocks, lambda b: F.when(F.length(b["text"]) > target, pieces(b)).otherwise(F.array(F.struct(*(b[f].alias(f) for f in ("text", "char_start", "char_end", "section_path", "location_label")))))))


def packed_ranges(lengths: Column, target: int, overlap: float) -> Column:
    """array<struct<first, last>> of blocks, by their lengths, that make up each chunk.

    A block goes into the open chunk if its blocks' characters stay within `target`, else it opens the next one behind the
    last blocks of the open one that together have at most target * overlap characters, whether or not it fits there.
    """
    spare = int(target * overlap)
    start = F.struct(F.lit(0).alias("first"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def of(n: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            size = F.get(n, i).cast("long")
            carried = F.lit(0)
            if spare:
                behind = lambda j: F.aggregate(F.slice(n, j + 1, i - j), F.lit(0).cast("long"), lambda t, x: t + x)
                carried = F.size(F.filter(F.sequence(s["first"], i - 1), lambda j: behind(j) <= spare))
            first = i - carried
            kept = F.aggregate(F.slice(n, first + 1, carried), F.lit(0).cast("long"), lambda t, x: t + x) if spare else F.lit(0).cast("long")
            opened = F.struct(first.cast("int").alias("first"), (kept + size).alias("size"), F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (i - 1).cast("int").alias("last")))).alias("done"))
            longer = F.struct(s["first"].alias("first"), (s["size"] + size).alias("size"), s["done"].alias("done"))
            return F.when((i == 0) | (s["size"] + size <= target), longer).otherwise(opened)

        def close(s: Column) -> Column:
            return F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (F.size(n) - 1).cast("int").alias("last"))))

        none = F.array().cast("array<struct<first:int,last:int>>")
        return F.when(F.size(n) == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(n) - 1, F.lit(0))), start, step, close))

    return once(lengths, of)


def chunks(contents: DataFrame, key: str, target: int = TARGET, overlap: float = OVERLAP) -> DataFrame:
    """(key, ordinal, text, char_start, char_end, section_path, sha256, token_estimate) from rows with an array `blocks`; a row
    without blocks has no chunks."""
    if target <= 0 or not 0 <= overlap < 1:
        raise ValueError("target must be positive and overlap in [0, 1)")
    units = contents.select(key, cut_blocks(F.coalesce("blocks", F.array().cast(BLOCKS)), target).alias("units"))
    ranges = units.withColumn("ranges", packed_ranges(F.transform("units", lambda u: F.length(u["text"])), target, overlap))
    each = ranges.select(key, "units", F.posexplode("ranges").alias("ordinal", "r"))
    run = F.slice("units", F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + 1)
    packed = each.select(
        key, "ordinal", F.array_join(F.transform(run, lambda u: u["text"]), "\n\n").alias("text"), F.get("units", F.col("r.first"))["char_start"].alias("char_start"),
        F.get("units", F.col("r.last"))["char_end"].alias("char_end"), F.get("units", F.col("r.first"))["section_path"].alias("section_path"),
    )
    return packed.withColumn("sha256", F.sha2("text", 256)).withColumn("token_estimate", token_estimate("text"))


def visible_blocks(blocks: Column, start: Column, end: Column) -> Column:
    """Blocks inside a half-open range of characters."""
    return F.filter(blocks, lambda b: (b["char_start"] >= start) & (b["char_end"] <= end))


def content_versions(submissions: DataFrame, artifact: str, text: str, at: str) -> DataFrame:
    """(artifact, sha256, version_key, first_at, is_current): a version for each distinct content; the last submission's is current."""
    hashed = submissions.select(F.col(artifact).alias("artifact"), F.sha2(text, 256).alias("sha256"), F.col(at).alias("at"))
    each = hashed.groupBy("artifact", "sha256").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    last = each.groupBy("artifact").agg(F.max("last_at").alias("newest"))
    w = Window.partitionBy("artifact").orderBy("first_at", "sha256")
    numbered = each.join(last, "artifact").withColumn("version_key", F.concat(F.lit("v"), F.row_number().over(w)))
    return numbered.select("artifact", "sha256", "version_key", "first_at", (F.col("last_at") == F.col("newest")).alias("is_current"))


def to_fetch(listed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Listed artifacts whose version mark is not the stored one (new ones among them), before anything is fetched."""
    return listed.join(stored.select(key, F.col("version_marker").alias("stored_marker")), key, "left").where(~F.col("version_marker").eqNullSafe(F.col("stored_marker")))


def new_objects(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Contents by hash that the store lacks, once each, with the folder each belongs to."""
    hashed = incoming.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    return hashed.join(stored.select("sha256"), "sha256", "left_anti").withColumn("prefix", F.substring("sha256", 1, 2))
