"""Query of operator 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import Workspace, documents
from tracelake.llm.media import stream_digests, text_streams


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Workspace(spark, "op10").save("media", text_streams(documents(spark, sf_dir)))
    return stream_digests(stored).withColumnRenamed("key", "doc_id")


QUERIES = {"op10_mpeg_audio": op10_mpeg_audio}
ORACLES: dict[str, str] = {}
