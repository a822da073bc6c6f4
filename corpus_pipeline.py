"""From documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame: the columns of
documents, or, from the last, the packed pieces. Nulls, ties, repeated rows and empty tables are handled as the
operators' modules say. A document whose every line goes as repeated is dropped; one that was empty before stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import tokenizers
from tracelake.llm.common import Workspace, unused
from tracelake.llm.linededup import drop_repeated_lines
from tracelake.llm.minhash import one_of_each_group
from tracelake.llm.packing import pack, token_pieces
from tracelake.llm.quality import kept_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated three-line windows; n_chars follows the text."""
    n_lines, n_removed, removed = names = tuple(unused(docs.columns, "n_lines", "n_removed", "removed"))
    out = drop_repeated_lines(docs, names=names)
    out = out.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_lines)))
    out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return one_of_each_group(docs, width=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces of at most 2048 tokens and their places in sequences."""
    pieces = token_pieces(docs, tokenizers.path("byte_bpe_50k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the fitted classifier nor the plan of the packing; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    workspace = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = workspace.save(f"stage-{k}", stage(spark, docs, sf_dir))
    return docs
