"""Checks of extracted statements and links, review read models, audit entries and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions import values as D


def validated(observations: DataFrame, spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """observations (observation_id, owner_text, date_value) with `fault`: the first, in span order, of unknown chunk, span out
    of bounds, empty quote, quote mismatch; then an owner no quote names, then a malformed or implausible date; null if sound.

    spans: (observation_id, ordinal, chunk_id, start, end, quote); chunks: (chunk_id, text).
    """
    at = spans.join(chunks.select("chunk_id", "text"), "chunk_id", "left").withColumn("fault", T.span_fault(F.col("text"), F.col("start"), F.col("end"), F.col("quote")))
    per = at.groupBy("observation_id").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ordinal"))).alias("span_fault"), F.array_sort(F.collect_list(F.struct("ordinal", "quote"))).alias("quoted"))
    said = F.array_join(F.transform("quoted", lambda q: q["quote"]), " ")
    per = per.select("observation_id", "span_fault", F.lower(T.collapse_space(said)).alias("quotes"))
    day = F.to_date(F.try_to_timestamp("date_value", F.lit("yyyy-MM-dd")))
    unsupported = (F.col("owner_text") != "") & ~F.coalesce(F.contains(F.col("quotes"), F.lower(T.collapse_space("owner_text"))), F.lit(False))
    bad_date = F.col("date_value").isNotNull() & ~F.coalesce(D.plausible_year(day), F.lit(False))
    fault = F.coalesce("span_fault", F.when(F.col("quotes").isNull(), "empty_quote"), F.when(unsupported, "unsupported_owner"), F.when(bad_date, "malformed_date"))
    return observations.join(per, "observation_id", "left").select(*observations.columns, fault.alias("fault"))


def link_faults(links: DataFrame, targets: DataFrame, contents: DataFrame, chunks: DataFrame) -> DataFrame:
    """links (link_id, target_id, scope, content_id, chunk_id, start, end, quote) with the first thing wrong, or null."""
    t = targets.select("target_id", F.col("scope").alias("target_scope"))
    c = contents.select("content_id", F.col("scope").alias("content_scope"))
    k = chunks.select("chunk_id", F.col("content_id").alias("chunk_content"), "text")
    out = links.join(t, "target_id", "left").join(c, "content_id", "left").join(k, "chunk_id", "left")
    fault = (
        F.when(F.col("target_scope").isNull() | (F.col("target_scope") != F.col("scope")), "unknown_target")
        .when(F.col("content_scope").isNull() | (F.col("content_scope") != F.col("scope")), "unknown_content")
        .when(F.col("chunk_id").isNotNull() & ~F.coalesce(F.col("chunk_content") == F.col("content_id"), F.lit(False)), "chunk_of_other_content")
        .when(F.col("chunk_id").isNotNull(), T.span_fault(F.col("text"), F.col("start"), F.col("end"), F.col("quote")))
    )
    return out.select(*links.columns, fault.alias("fault"))


def extraction_runs(results: DataFrame, run: str) -> DataFrame:
    """(run, chunks, refused, tokens_in, tokens_out, usd, status): refused chunks are counted and passed over, a failed one ends the run."""
    out = results.groupBy(run).agg(
        F.count("*").alias("chunks"), F.sum((F.col("outcome") == "refused").cast("long")).alias("refused"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.max((F.col("outcome") == "failed").cast("int")).alias("any_failed"),
    )
    return out.withColumn("usd", D.model_cost(F.col("tokens_in"), F.col("tokens_out"))).withColumn("status", F.when(F.col("any_failed") == 1, "failed").when(F.col("refused") == F.col("chunks"), "refused").otherwise("completed")).drop("any_failed")


def pending(statements: DataFrame, proposals: DataFrame) -> DataFrame:
    """Statements without a proposal: a second run proposes nothing twice."""
    return statements.join(proposals.select("statement_id").distinct(), "statement_id", "left_anti")


def patch(action: Column, kind: Column, title: Column, description: Column, owner: Column, due: Column, due_text: Column, supersedes: Column) -> Column:
    """JSON of what a proposal changes; nulls are left out. Only a superseding item names the one it replaces. An update gives the
    fields that it is about, the others being null."""
    fields = [kind.alias("kind"), title.alias("canonical_title"), description.alias("canonical_description"), owner.alias("owner_person_id"), due.alias("due_date"), due_text.alias("due_date_text")]
    new = F.to_json(F.struct(*fields, F.when(action == "SUPERSEDE", supersedes).alias("supersedes_ledger_item_id")))
    changed = F.to_json(F.struct(owner.alias("owner_person_id"), due.alias("due_date"), due_text.alias("due_date_text")))
    return F.when(action.isin("CREATE", "SUPERSEDE"), new).when(action == "COMPLETE", '{"status":"completed"}').when(action == "CANCEL", '{"status":"canceled"}').when(action == "UPDATE", changed).otherwise("{}")


def cards(proposals: DataFrame, statements: DataFrame, items: DataFrame, links: DataFrame, contents: DataFrame) -> DataFrame:
    """One row a pending proposal with its statement, target and evidence, in the queue's order."""
    evidence = links.join(contents.select("content_id", F.col("title").alias("source")), "content_id", "left").groupBy("statement_id").agg(F.array_sort(F.collect_set(F.struct("source", "quote"))).alias("evidence"))
    target = items.select(F.col("item_id").alias("target_id"), F.col("title").alias("target_title"), F.col("status").alias("target_status"))
    out = proposals.where("status = 'pending'").join(statements, "statement_id").join(target, "target_id", "left").join(evidence, "statement_id", "left")
    from tracelake.operators.relational import review_order

    return out.orderBy(*review_order("action", "created_at"), "proposal_id")


def audit_entries(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, action, before_json, after_json) of every row that was created, changed or deleted."""
    a = before.select(key, F.to_json(F.struct(*fields)).alias("before_json"))
    b = after.select(key, F.to_json(F.struct(*fields)).alias("after_json"))
    action = F.when(F.col("before_json").isNull(), "create").when(F.col("after_json").isNull(), "delete").otherwise("update")
    return a.join(b, key, "full").where(~F.col("before_json").eqNullSafe(F.col("after_json"))).select(key, action.alias("action"), "before_json", "after_json")


def recurring(corrections: DataFrame, least: int = 2) -> DataFrame:
    return corrections.groupBy("signature").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def preview(rows: DataFrame, matched: str, order: Sequence[Column], n: int = 5) -> DataFrame:
    """The first n rows that match and the first n that don't."""
    w = Window.partitionBy(matched).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= n)


def evidence_list(artifacts: DataFrame, versions: DataFrame) -> DataFrame:
    """Artifacts with their number of versions and the current one's key."""
    per = versions.groupBy("artifact").agg(F.count("*").alias("versions"), F.max(F.when(F.col("is_current"), F.col("version_key"))).alias("current_key"))
    return artifacts.join(per, "artifact", "left").withColumn("versions", F.coalesce("versions", F.lit(0)))


def accepted_share(reviews: DataFrame) -> DataFrame:
    """Acceptance and acceptance without an edit."""
    yes, plain = F.col("action").isin("accept", "edit"), F.col("action") == "accept"
    return reviews.agg(D.ratio(F.sum(yes.cast("long")), F.count("*")).alias("acceptance"), D.ratio(F.sum(plain.cast("long")), F.count("*")).alias("edit_free_acceptance"))
