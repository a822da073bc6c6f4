"""Scoring of claims against ground truth: as-of states, mergeable ratios, thresholds and a verdict.

A ratio is a pair of sums, so partial results combine before and after every shuffle and pool by adding.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions import values as D
from tracelake.functions import vocabulary as V
from tracelake.operators.search import once


#: Parts of a hot run, and needles that one broadcast row holds.
SALTS, SHORT = 16, 1_000


def visible(transitions: DataFrame, mentions: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(checkpoint_id, transition...) whose earliest mention is strictly before the checkpoint's cutoff.

    mentions: (transition_id, at); checkpoints: (checkpoint_id, scope, cutoff); transitions have a scope.
    """
    first = mentions.groupBy("transition_id").agg(F.min("at").alias("seen_at"))
    return transitions.join(first, "transition_id").join(checkpoints, "scope").where(F.col("seen_at") < F.col("cutoff"))


def truth(seen: DataFrame) -> DataFrame:
    """(checkpoint_id, item_id, owner, due, status, last_materiality) folded over visible transitions; superseded items are superseded."""
    order = F.struct("seen_at", "transition_id")
    last = lambda f: F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f)
    state = seen.groupBy("checkpoint_id", "item_id").agg(last("owner"), last("due"), last("status"), F.max_by("materiality", order).alias("last_materiality"))
    over = seen.where("supersedes IS NOT NULL").select("checkpoint_id", F.col("supersedes").alias("item_id")).distinct().withColumn("over", F.lit(True))
    return state.join(over, ["checkpoint_id", "item_id"], "left").withColumn("status", F.when(F.col("over"), "superseded").otherwise(F.col("status"))).drop("over")


def matched(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Claims with the item that has their kind and normalised title or alias; the first item where several have it."""
    names = items.select("scope", "kind", "item_id", F.explode(F.concat(F.array("title"), "aliases")).alias("name")).select("scope", "kind", T.normal_form("name").alias("form"), "item_id")
    first = names.groupBy("scope", "kind", "form").agg(F.min("item_id").alias("item_id"))
    return claims.withColumn("form", T.normal_form("title")).join(first, ["scope", "kind", "form"], "left").drop("form")


def field_match(expected: Column, said: Column) -> Column:
    """Null where nothing is expected, else whether it is what was said."""
    return F.when(expected.isNotNull(), F.coalesce(expected == said, F.lit(False)))


def ratios(rows: DataFrame, keys: list[str], metrics: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(keys, metric, numerator, denominator, value): each metric counts its first condition among its second."""
    sums = []
    for name, (hit, of) in metrics.items():
        inside = F.coalesce(of, F.lit(False))
        sums.append(F.struct(F.lit(name).alias("metric"), F.sum(F.when(inside & F.coalesce(hit, F.lit(False)), 1).otherwise(0)).alias("numerator"), F.sum(F.when(inside, 1).otherwise(0)).alias("denominator")).alias(name))
    out = rows.groupBy(*keys).agg(*sums).select(*keys, F.explode(F.array(*metrics)).alias("m")).select(*keys, "m.*")
    return out.withColumn("value", D.ratio(F.col("numerator"), F.col("denominator")))


def pooled(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Ratios pooled by adding numerators and denominators."""
    out = metrics.groupBy(*keys, "metric").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    return out.withColumn("value", D.ratio(F.col("numerator"), F.col("denominator")))


#: Kinds that a meeting's brief shows by their current state.
MEETING_KINDS = ("commitment", "open_question", "risk", "blocker")
ENDING = ("complete", "resolve", "cancel", "supersede")


def expected(states: DataFrame) -> DataFrame:
    """The states (checkpoint_id, brief_type, item_id, kind, status, last_materiality, ...) that a brief must show: those whose last
    transition is not ambiguous; in a meeting's brief only live ones of the kinds it has sections for."""
    meeting = F.col("brief_type") == "meeting_preparation"
    shown = F.col("kind").isin(*MEETING_KINDS) & ~F.coalesce(F.col("status").isin(*V.TERMINAL), F.lit(False))
    return states.where(~F.col("last_materiality").eqNullSafe(F.lit("ambiguous")) & (~meeting | shown))


def checkpoint_rows(claims: DataFrame, states: DataFrame) -> DataFrame:
    """Merged claims and items that exist at a checkpoint side by side, and claims that match no item (item_id null) for themselves.

    claims: checkpoint_id, item_id, kind, owner, due, status, has_evidence, a row for each claimed item or unmatched claim;
    states: all items that exist, with brief_type, last_materiality and last_transition. exists, required and claimed say
    what a row is; *_ok whether a field is as it should be, null where nothing is to be.
    """
    said = claims.select("checkpoint_id", "item_id", *(F.col(f).alias(f"said_{f}") for f in ("kind", "owner", "due", "status")), "has_evidence", F.lit(True).alias("claimed"))
    must = expected(states).select("checkpoint_id", "item_id", F.lit(True).alias("required"))
    real = states.join(must, ["checkpoint_id", "item_id"], "left").withColumn("exists", F.lit(True))
    both = said.join(real, ["checkpoint_id", "item_id"], "full").fillna(False, ["claimed", "exists", "required", "has_evidence"])
    plain = lambda c: T.normal_form(c)
    fields = {"kind": field_match(F.col("kind"), F.col("said_kind")), "status": field_match(F.col("status"), F.col("said_status")), "owner": field_match(plain(F.col("owner")), plain(F.col("said_owner"))), "due": field_match(F.col("due"), F.col("said_due"))}
    return both.withColumns({f"{f}_ok": x for f, x in fields.items()})


def checkpoint_metrics() -> dict[str, tuple[Column, Column]]:
    """Of checkpoint_rows. Precision credits any item that exists; all others look at required items."""
    c = F.col
    both, ok = c("claimed") & c("required"), lambda f: F.coalesce(c(f"{f}_ok"), F.lit(True))
    ended = c("last_transition").isin(*ENDING)
    return {
        "item_precision": (c("claimed") & c("exists"), c("claimed")),
        "item_recall": (both, c("required")),
        **{f"field_accuracy_{f}": (c(f"{f}_ok"), both & c(f"{f}_ok").isNotNull()) for f in ("kind", "status", "owner", "due")},
        "transition_accuracy": (c("status_ok"), both & ended & c("status_ok").isNotNull()),
        "current_state_accuracy": (both & ok("kind") & ok("status") & ok("owner") & ok("due"), c("required")),
    }


def claim_metrics() -> dict[str, tuple[Column, Column]]:
    """Of single claims (type, kind, has_evidence): only claims of fact or inference about an item count."""
    factual = F.col("type").isin("fact", "inference") & F.col("kind").isNotNull()
    return {"evidence_correctness": (F.col("has_evidence"), factual), "unsupported_claim_rate": (~F.col("has_evidence"), factual)}


def checkpoint_scores(claims: DataFrame, merged: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """The ten metrics of every checkpoint as (keys, metric, numerator, denominator, value). claims are single, merged by item."""
    return ratios(checkpoint_rows(merged, states), keys, checkpoint_metrics()).unionByName(ratios(claims, keys, claim_metrics()))


def combined_accuracy(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The four field accuracies pooled into one."""
    fields = metrics.where(F.col("metric").startswith("field_accuracy_")).withColumn("metric", F.lit("field_accuracy_combined"))
    return pooled(fields, keys)


def misleading(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """(checkpoint_id, item_id, why): of checkpoint_rows a wrong status or owner of a required item, or an item that does not exist
    yet, each with evidence; and of single factual claims those without evidence."""
    c = F.col
    wrong = c("claimed") & c("required") & c("has_evidence") & (~F.coalesce(c("status_ok"), F.lit(True)) | ~F.coalesce(c("owner_ok"), F.lit(True)))
    early = c("claimed") & ~c("exists") & c("item_id").isNotNull() & c("has_evidence")
    state = rows.withColumn("why", F.when(wrong, "wrong_state").when(early, "premature")).where("why IS NOT NULL").select("checkpoint_id", "item_id", "why")
    bare = claims.where(claim_metrics()["evidence_correctness"][1] & ~c("has_evidence")).select("checkpoint_id", "item_id", F.lit("unsupported").alias("why"))
    return state.unionByName(bare)


def containment(texts: DataFrame, needles: DataFrame, text_key: str, needle_key: str, words: int = 4) -> DataFrame:
    """(text_key, needle_key) of every needle that stands verbatim in a text.

    texts: (key, text); needles: (key, needle). Texts and needles meet on a hash of `words` consecutive
    words: a needle brings one such run, whole words of its inside, chosen by the least hash, a text brings all of its own,
    once each; only pairs that meet are compared. A run that very many texts have is spread by salt. Needles of too few
    words for a run are a query set that all texts are scanned for, in blocks of SHORT needles, a broadcast row each.
    """
    def runs(text: Column) -> Column:
        def of(parts: Column) -> Column:
            n = F.size(parts) - words + 1
            return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.slice(parts, i + 1, words))))).otherwise(F.array().cast("array<bigint>"))

        return once(F.split(text, " ", -1), of)

    inner = F.regexp_extract("needle", r"(?s)^[^ ]* (.*) [^ ]*$", 1)
    keyed = needles.withColumn("run", F.array_min(runs(inner)))
    spread = texts.select(F.col(text_key), F.explode(runs(F.col("text"))).alias("run"), F.pmod(F.xxhash64(text_key, "text"), F.lit(SALTS)).cast("int").alias("salt"))
    asked = keyed.where("run IS NOT NULL").select(needle_key, "run", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = spread.join(asked, ["run", "salt"]).select(text_key, needle_key).distinct()
    confirmed = met.join(needles, needle_key).join(texts, text_key).where(F.contains("text", "needle")).select(text_key, needle_key)
    short = keyed.where("run IS NULL").select(needle_key, "needle")
    blocks = -(-short.count() // SHORT)
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64(needle_key), F.lit(blocks)) == k).agg(F.collect_list(F.struct(needle_key, "needle")).alias("some"))  # one row
        held = texts.crossJoin(F.broadcast(block)).select(text_key, F.explode(F.filter("some", lambda n: F.contains(F.col("text"), n["needle"]))).alias("n"))
        confirmed = confirmed.unionByName(held.select(text_key, F.col("n")[needle_key].alias(needle_key)))
    return confirmed


def budgeted(artifacts: DataFrame, scope: str, at: str, key: str, size: str, budget: int) -> DataFrame:
    """Artifacts picked newest first while they fit the budget; the first is always taken, one that does not fit is skipped.

    The choice depends on the order, so a scope's sizes are folded in one row; only keys and sizes are in it.
    """
    listed = artifacts.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col(at).cast("timestamp"))).alias("o"), F.col(key).alias("k"), F.col(size).cast("long").alias("n")))).alias("a"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{artifacts.schema[key].dataType.simpleString()}>").alias("taken"))

    def step(state: Column, x: Column) -> Column:
        takes = (F.size(state["taken"]) == 0) | (state["used"] + x["n"] <= budget)
        return F.struct(F.when(takes, state["used"] + x["n"]).otherwise(state["used"]).alias("used"), F.when(takes, F.concat(state["taken"], F.array(x["k"]))).otherwise(state["taken"]).alias("taken"))

    return listed.select(scope, F.explode(F.aggregate("a", start, step)["taken"]).alias(key))


#: Check -> (least or most allowed, strictly or not, bound). Those of THRESHOLDS_OF_EACH hold for every project.
THRESHOLDS = {
    "item_precision": (">=", 0.90), "item_recall": (">=", 0.80), "evidence_correctness": (">=", 0.95), "unsupported_claim_rate": ("<=", 0.02),
    "materially_misleading_rate": ("<", 0.05), "current_state_accuracy": (">=", 0.85), "project_assignment_error": ("<=", 0.01), "cross_project_leakage": ("<=", 0.0),
    "acceptance_rate": (">=", 0.80), "edit_free_acceptance_rate": (">=", 0.65), "review_burden_minutes_per_sync": ("<=", 5.0), "review_burden_seconds_per_item": ("<=", 20.0),
    "meeting_prep_time_saved": (">=", 1.0), "beats_baseline": (">=", 1.0),
}
THRESHOLDS_OF_EACH = {"item_recall": (">=", 0.75), "materially_misleading_rate": ("<", 0.05)}
#: A check that one of these fails stops the project.
STOPS = ("beats_baseline", "cross_project_leakage", "materially_misleading_rate")


def _holds(value: Column, way: Column, bound: Column) -> Column:
    return F.when(way == ">=", value >= bound).when(way == "<", value < bound).otherwise(value <= bound)


def threshold_checks(overall: DataFrame, by_project: DataFrame | None = None) -> DataFrame:
    """(metric, value, bound, state) of the fourteen checks: pass, fail, or not_evaluable where there is no value.

    overall: (metric, value); by_project: (project, metric, value). A project without a value breaks no bound. The misleading
    rate is judged by project alone, and passes where there are none.
    """
    spark = overall.sparkSession
    bounds = spark.createDataFrame([(k, m, way, b) for k, (m, (way, b)) in enumerate(THRESHOLDS.items(), 1)], "place int, metric string, way string, bound double")
    each = spark.createDataFrame([(m, way, b) for m, (way, b) in THRESHOLDS_OF_EACH.items()], "metric string, way string, bound double")
    if by_project is None:
        by_project = spark.createDataFrame([], "metric string, value double")
    broken = by_project.select("metric", "value").join(F.broadcast(each), "metric").groupBy("metric").agg(F.max(~_holds(F.col("value"), F.col("way"), F.col("bound"))).alias("broken"), F.max("value").alias("worst"))
    out = F.broadcast(bounds).join(overall.select("metric", "value"), "metric", "left").join(broken, "metric", "left")
    only_each = F.col("metric") == "materially_misleading_rate"
    value = F.when(only_each, F.col("worst")).otherwise(F.col("value"))
    fine = ~F.coalesce("broken", F.lit(False)) & (only_each | _holds(F.col("value"), F.col("way"), F.col("bound")))
    state = F.when(F.col("value").isNull() & ~only_each, "not_evaluable").when(fine, "pass").otherwise("fail")
    return out.select("metric", value.alias("value"), "bound", state.alias("state"))


def prep_time_saved(percent: Column, minutes: Column) -> Column:
    """1 or 0: at least half the time and ten minutes saved; null where no times are known."""
    return F.when(percent.isNull() & minutes.isNull(), F.lit(None)).otherwise(F.coalesce((percent >= 50.0) & (minutes >= 10.0), F.lit(False)).cast("double"))


def beats_baseline(state: Column, base_state: Column, unsupported: Column, base_unsupported: Column) -> Column:
    """1 or 0: current state better by 0.1 or unsupported claims fewer by half; null where neither can be said."""
    better, fewer = state - base_state, F.when(base_unsupported > 0, 1 - unsupported / base_unsupported)
    return F.when(better.isNotNull() | fewer.isNotNull(), (F.coalesce(better >= 0.10, F.lit(False)) | F.coalesce(fewer >= 0.50, F.lit(False))).cast("double"))


def verdict(checks: DataFrame) -> DataFrame:
    """STOP where a check of STOPS fails, GO if all pass, else ITERATE; with how many passed, failed and could not be evaluated."""
    state = F.col("state")
    stop = F.coalesce(F.max(F.col("metric").isin(*STOPS) & (state == "fail")), F.lit(False))
    count = lambda name: F.sum((state == name).cast("long"))
    said = F.when(stop, "STOP").when(F.min(state == "pass"), "GO").otherwise("ITERATE")
    return checks.agg(said.alias("verdict"), count("pass").alias("passed"), count("fail").alias("failed"), count("not_evaluable").alias("not_evaluable"))


def report(by_project: DataFrame, composite: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: the report as JSON and as Markdown. by_project: (project, metric, numerator, denominator, value); composite the same
    without a project; checks as `threshold_checks` gives them. A row a metric or check, never a row a claim."""
    metric = F.struct("metric", "numerator", "denominator", "value")
    shown = F.when(F.col("value").isNull(), "n/a").otherwise(F.concat(F.format_number(F.col("value") * 100, 1), F.lit("% ("), F.col("numerator").cast("long").cast("string"), F.lit("/"), F.col("denominator").cast("long").cast("string"), F.lit(")")))
    projects = by_project.groupBy("project").agg(F.array_sort(F.collect_list(metric)).alias("metrics")).agg(F.array_sort(F.collect_list(F.struct("project", "metrics"))).alias("per_project"))
    whole = composite.agg(F.array_sort(F.collect_list(metric)).alias("composite"), F.array_sort(F.collect_list(F.concat(F.lit("- "), "metric", F.lit(": "), shown))).alias("lines"))
    listed = checks.agg(F.array_sort(F.collect_list(F.struct("metric", "value", "bound", "state"))).alias("threshold_checks"), F.array_sort(F.collect_list(F.concat(F.lit("- "), "metric", F.lit(": "), "state"))).alias("states"))
    one = projects.crossJoin(whole).crossJoin(listed).crossJoin(verdict(checks))  # one row each
    text = F.concat(F.lit("# Evaluation\n\n## Verdict\n"), "verdict", F.lit("\n\n## Metrics\n"), F.array_join("lines", "\n"), F.lit("\n\n## Thresholds\n"), F.array_join("states", "\n"), F.lit("\n"))
    return one.select(F.to_json(F.struct("per_project", "composite", "threshold_checks", "verdict")).alias("json"), text.alias("markdown"))


def scripted_review(proposals: DataFrame) -> DataFrame:
    """proposals (action, is_repeat_mention, transition) with what a reviewer who knows the truth does: review_action and the edited
    action and status, null where they stay."""
    c, nothing = F.col, F.lit(None).cast("string")
    accepts = ~c("is_repeat_mention") & (c("transition") == "create") & (c("action") == "CREATE")
    new = ~c("is_repeat_mention") & (c("transition") == "create") & (c("action") != "CREATE")
    return proposals.withColumns({
        "review_action": F.when(accepts, "accept").when(new, "treat_as_new").otherwise("edit_accept"),
        "edited_action": F.when(c("is_repeat_mention"), "ADD_EVIDENCE").when(new, "CREATE").when(c("transition").isin("update_owner", "update_date"), "UPDATE").otherwise(nothing),
        "edited_status": F.when(c("is_repeat_mention"), nothing).when(c("transition") == "supersede", "superseded").when(c("transition") == "update_status", c("status")).otherwise(nothing),
    })


def review_burden(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Minutes and seconds an item of reviewing, at fixed seconds for each action."""
    seconds = F.coalesce(*(F.when(F.col("action") == a, F.lit(s)) for a, s in V.REVIEW_SECONDS.items()), F.lit(0))
    out = reviews.groupBy(*keys).agg(F.sum(seconds).cast("long").alias("seconds"), F.count("*").alias("n"))
    return out.select(*keys, (F.col("seconds") / 60.0).alias("minutes"), D.ratio(F.col("seconds"), F.col("n")).alias("seconds_per_item"))


def latest_attempt(rows: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The latest row of each key; of several at one time the last by `ties`."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), *(F.col(t).desc() for t in ties))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
