"""Query of operator 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import tokenizers
from tracelake.llm.common import documents
from tracelake.llm.sentencepieces import sentencepiece_columns


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_columns(documents(spark, sf_dir), tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES: dict[str, str] = {}
