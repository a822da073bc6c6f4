"""Versions of ledger items as event rows folded by windows: intervals, states as of a time, diffs and rules.

A window's partition is one item. An item's versions are few by nature; `state_as_of`, whose groups can be large, folds by
grouped maxima instead, which combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import vocabulary as V


def intervals(events: DataFrame, item: str, at: str, ties: str, fields: Sequence[str]) -> DataFrame:
    """A version an event: number, carried-forward fields (null means unchanged), valid_from and the next one's as valid_to."""
    w = Window.partitionBy(item).orderBy(at, ties)
    out = events.withColumn("version_no", F.row_number().over(w).cast("long")).withColumn("valid_to", F.lead(at).over(w)).withColumnRenamed(at, "valid_from")
    w2 = Window.partitionBy(item).orderBy("valid_from", ties).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({f: F.last(f, ignorenulls=True).over(w2) for f in fields})


def current(events: DataFrame, item: str, at: str, ties: str, fields: Sequence[str]) -> DataFrame:
    """The projection: every item's last known value of each field, and its number of versions."""
    order = F.struct(at, ties)
    return events.groupBy(item).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields), F.max(at).alias("updated_at"), F.count("*").alias("versions"))


def state_as_of(events: DataFrame, item: str, at: str, ties: str, fields: Sequence[str], cutoff) -> DataFrame:
    """As `current`, of what was visible strictly before the cutoff."""
    return current(events.where(F.col(at) < cutoff), item, at, ties, fields)


def superseded_state(states: DataFrame, links: DataFrame, item: str) -> DataFrame:
    """States in which an item that another one supersedes is superseded, whatever it says itself. links: (item, by)."""
    over = links.select(F.col("item").alias(item)).distinct().withColumn("over", F.lit(True))
    return states.join(over, item, "left").withColumn("status", F.when(F.col("over"), "superseded").otherwise(F.col("status"))).drop("over")


def changes(versions: DataFrame, item: str, fields: dict[str, str]) -> DataFrame:
    """For each later version what the one before it said where they differ, "was ..." joined by "; "."""
    w = Window.partitionBy(item).orderBy("version_no")
    parts = []
    for field, said in fields.items():
        before = F.lag(field).over(w)
        parts.append(F.when(before.isNotNull() & ~before.eqNullSafe(F.col(field)), F.concat(F.lit(f"was {said}"), before.cast("string"))))
    return versions.select(item, "version_no", F.concat_ws("; ", *parts).alias("previous")).where("version_no > 1")


def previous_event(rows: DataFrame, key: str, at: str, ties: str, of: Column) -> DataFrame:
    """For each row the latest earlier one of its key for which `of` holds (as-of join), strictly before it."""
    strictly = Window.partitionBy(key).orderBy(at, ties).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous", F.max(F.when(of, F.struct(at, ties))).over(strictly))


def transition_rules(spark: SparkSession) -> DataFrame:
    """(kind, transition, from_status, to_status) of every legal transition; a fixed table of a few hundred rows."""
    rows = []
    for kind in V.KINDS:
        for transition, starts in V.FROM_STATUS.items():
            for start in starts:
                for to in V.STATUSES_OF_KIND[kind]:
                    fixed = V.INITIAL_STATUS[kind] if transition in ("create", "reopen") else V.TO_STATUS.get(transition)
                    if (fixed is None or to == fixed) and (transition != "update" or to in V.LIVE):
                        rows.append((kind, transition, start, to))
    return spark.createDataFrame(rows, "kind string, transition string, from_status string, to_status string")


def illegal(transitions: DataFrame) -> DataFrame:
    """Rows of (kind, transition, from_status, to_status, ...) that the rules don't allow."""
    rules = transition_rules(transitions.sparkSession)
    same = [transitions[c].eqNullSafe(rules[c]) for c in ("kind", "transition", "from_status", "to_status")]
    return transitions.join(F.broadcast(rules), same, "left_anti")


def corrections(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str], reason: Column, target: str) -> DataFrame:
    """(key, field, original, corrected, signature) of every field that was known and is different now."""
    a = before.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields))
    b = after.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields), reason.alias("reason"))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("original"), F.col(f"b_{f}").alias("corrected")) for f in fields)))
    out = a.join(b, key).select(key, "reason", pairs.alias("p")).select(key, "p.*", "reason")
    out = out.where(F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("corrected")))
    return out.select(key, "field", "original", "corrected", F.concat_ws(":", F.lit(target), "field", "reason").alias("signature"))


def created_items(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items at their kind's initial status, and their first versions, from new (item_id, kind, title, ...) rows."""
    status = F.coalesce(*(F.when(F.col("kind") == k, F.lit(s)) for k, s in V.INITIAL_STATUS.items()))
    version = F.concat(F.col("item_id").cast("string"), F.lit(":1"))
    items = new.withColumns({"status": status, "current_version_id": version})
    versions = new.withColumns({"status": status, "version_id": version, "version_no": F.lit(1).cast("long"), "transition": F.lit("create"), "from_version_id": F.lit(None).cast("string")})
    return items, versions


def review_actions(proposals: DataFrame, requests: DataFrame) -> DataFrame:
    """What each requested review does: outcome and the action, target, status and fields that hold.

    proposals: proposal_id, status, action, target_id, patch_* (kind, title, owner, due); requests: proposal_id, verb
    (accept, edit_accept, mark_complete, mark_superseded, treat_as_new, reject), edit_* (action, target_id, status, kind,
    title, owner, due; null keeps the proposal's). A reviewed proposal is repeated, a conflict can't be accepted as it is, a
    rejected one changes nothing, treat_as_new has no target whatever was proposed.
    """
    c = F.col
    forced = F.when(c("verb") == "mark_complete", "completed").when(c("verb") == "mark_superseded", "superseded").when(c("verb") == "edit_accept", c("edit_status"))
    edits = c("verb").isin("edit_accept", "treat_as_new")
    action = (
        F.when(c("verb") == "treat_as_new", "CREATE").when(forced == "completed", "COMPLETE").when(forced == "superseded", "SUPERSEDE").when(forced == "canceled", "CANCEL")
        .otherwise(F.coalesce(F.when(edits, c("edit_action")), c("action")))
    )
    outcome = (
        F.when(c("status") != "pending", "repeated").when(c("verb") == "reject", "rejected")
        .when((c("verb") == "accept") & (c("action") == "CONFLICT"), "not_applicable").otherwise("applied")
    )
    applied = F.col("outcome") == "applied"
    out = proposals.join(requests, "proposal_id").withColumn("outcome", outcome).withColumn("effective", F.when(applied, action))
    target = F.when(applied & (c("effective") != "CREATE"), F.coalesce(F.when(edits, c("edit_target_id")), c("target_id")))
    fields = [F.when(applied, F.coalesce(F.when(edits, c(f"edit_{f}")), c(f"patch_{f}"))).alias(f) for f in ("kind", "title", "owner", "due")]
    return out.select("proposal_id", "verb", "outcome", c("effective").alias("action"), target.alias("target_id"), F.when(applied, forced).alias("new_status"), *fields)


def superseding_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old items closed and their successors created, each pointing to the other. new: (item_id, supersedes, ...)."""
    link = new.select(F.col("supersedes").alias("item_id"), F.col("item_id").alias("by"))
    closed = old.join(link, "item_id").withColumn("status", F.lit("superseded")).withColumnRenamed("by", "superseded_by").withColumn("supersedes", F.lit(None).cast("string"))
    created = new.withColumn("superseded_by", F.lit(None).cast("string"))
    return closed.unionByName(created, allowMissingColumns=True)


def reviewed(proposals: DataFrame, reviews: DataFrame, items: DataFrame) -> DataFrame:
    """What becomes of each reviewed proposal: applied, rejected, repeated, stale (its item has moved on) or no change."""
    first = reviews.groupBy("proposal_id").agg(F.min_by("action", F.struct("at", "review_id")).alias("verdict"), F.count("*").alias("n_reviews"))
    out = proposals.join(first, "proposal_id").join(items.select(F.col("item_id").alias("target_id"), "current_version"), "target_id", "left")
    fate = (
        F.when(F.col("status") != "pending", "repeated")
        .when(F.col("verdict") == "reject", "rejected")
        .when(F.col("target_id").isNotNull() & ~F.col("current_version").eqNullSafe(F.col("expected_version")), "stale")
        .when(F.col("proposed").isin("NO_OP", "ADD_EVIDENCE"), "no_change")
        .otherwise("applied")
    )
    return out.withColumn("fate", fate)
