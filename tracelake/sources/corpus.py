"""A frozen evaluation corpus as JSON: explicit schemas, a reader, a writer and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "schema_version string, key string, name string, artifacts array<struct<artifact_id:string,kind:string,title:string,occurred_at:string,filename:string,material:boolean>>, "
    "checkpoints array<struct<checkpoint_id:string,cutoff_at:string,brief_type:string>>"
)
TRUTH = (
    "schema_version string, project_key string, items array<struct<item_id:string,kind:string,canonical_title:string,aliases:array<string>,"
    "transitions:array<struct<transition_id:string,type:string,mentions:array<struct<artifact_id:string,statement:string,observed_owner:string>>,owner:string,due_date:string,status:string,supersedes_item_id:string,materiality:string>>>>"
)
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, ground truths) of every project folder; no schema is inferred."""
    reader = lambda schema, name: spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/{name}")
    return reader(MANIFEST, "manifest.json"), reader(TRUTH, "ground_truth.json")


def write(frame: DataFrame, folder: str) -> None:
    frame.write.mode("error").json(folder)


def transitions(truths: DataFrame) -> DataFrame:
    """(scope, item_id, kind, title, transition_id, ..., materiality) a row for each transition."""
    one = truths.select(F.col("project_key").alias("scope"), F.explode("items").alias("i")).select("scope", "i.item_id", "i.kind", F.col("i.canonical_title").alias("title"), "i.aliases", F.posexplode("i.transitions").alias("nth", "t"))
    return one.select("scope", "item_id", "kind", "title", "aliases", "nth", "t.transition_id", F.col("t.type").alias("type"), "t.owner", F.col("t.due_date").alias("due"), "t.status", F.col("t.supersedes_item_id").alias("supersedes"), "t.materiality", "t.mentions")


def faults(manifests: DataFrame, truths: DataFrame, texts: DataFrame) -> DataFrame:
    """(scope, what, id): times that don't compare, items that don't begin with create, mentions not in their artifact's text.

    texts: (artifact_id, text).
    """
    artifact = manifests.select(F.col("key").alias("scope"), F.explode("artifacts").alias("a"))
    times = artifact.where(~F.col("a.occurred_at").rlike(STAMP)).select("scope", F.lit("time").alias("what"), F.col("a.artifact_id").alias("id"))
    steps = transitions(truths)
    starts = steps.where("nth = 0 AND type <> 'create'").select("scope", F.lit("first_transition").alias("what"), F.col("item_id").alias("id"))
    said = steps.select("scope", "transition_id", F.explode("mentions").alias("m")).select("scope", "transition_id", "m.artifact_id", "m.statement")
    missing = said.join(texts, "artifact_id", "left").where(~F.coalesce(F.contains("text", "statement"), F.lit(False))).select("scope", F.lit("mention").alias("what"), F.col("transition_id").alias("id"))
    return times.union(starts).union(missing)
