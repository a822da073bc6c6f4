"""Query of operator 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import documents
from tracelake.llm.minhash import near_duplicates


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op2_minhash_dedup": op2_minhash_dedup}
ORACLES: dict[str, str] = {}
