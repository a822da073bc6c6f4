"""Query of operator 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import tokenizers
from tracelake.llm.common import Workspace, documents
from tracelake.llm.token_files import read_token_files, write_token_files


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(documents(spark, sf_dir), tokenizers.path("byte_bpe_50k.json"), Workspace(spark, "op8"), end_id=2)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_files": op8_token_files}
ORACLES: dict[str, str] = {}
