"""Read models: briefs in ordered sections, claims checked against facts, meetings and their cutoffs.

A brief's sections show the state of a scope, so they are made once a scope, whatever the number of its meetings; what
differs between meetings is their purpose and how many of the scope's newest changes lie at or after the cutoff.
`for_meetings` puts the two together for the meetings that are asked for.

Inputs. items: item_id, scope, kind, title, status, owner, due, updated_at. versions: version_id, item_id, scope, kind,
valid_from, title, status, owner, due, transition, previous. scopes: scope, objective, stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions import vocabulary as V

#: Most changes in a project's brief, and in a meeting's.
RECENT, SINCE = 15, 200
PROJECT_SECTIONS = {
    "objective_and_scope": "Objective and Scope", "current_stage": "Current Stage", "recent_changes": "Recent Changes", "next_milestone": "Next Milestone",
    "open_commitments": "Open Commitments", "decisions": "Decisions", "risks_and_blockers": "Risks and Blockers", "unresolved_questions": "Unresolved Questions",
}
MEETING_SECTIONS = {
    "meeting_purpose": "Meeting Purpose", "changes_since_previous": "Changes Since Previous Meeting", "outstanding_commitments": "Outstanding Commitments",
    "decisions_required": "Decisions Required", "risks_and_blockers": "Risks Requiring Discussion", "unanswered_questions": "Unanswered Questions", "suggested_topics": "Suggested Discussion Topics",
}
FACT = ("scope", "section", "section_no", "position", "item_id", "version_id", "kind", "title", "status", "owner", "due", "at", "transition", "note")


def _numbered(section: Column, sections: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, sections)), section).cast("long")


def _facts(rows: DataFrame, sections: Sequence[str], *more: str) -> DataFrame:
    """Rows with section and position, and whatever of FACT they have, as facts, after the columns `more`."""
    named = rows.withColumn("section_no", _numbered(F.col("section"), sections))
    strings = ("version_id", "kind", "title", "status", "transition", "note")
    return named.select(*more, *(c if c in named.columns else F.lit(None).cast("string" if c in strings else "timestamp_ntz" if c == "at" else "date" if c == "due" else "long").alias(c) for c in FACT))


def _state_facts(items: DataFrame, section: Column, order: Sequence[Column], most: dict[str, int] | None = None) -> DataFrame:
    """Items that have a section, numbered in it by `order`, then the latest updated first."""
    w = Window.partitionBy("scope", "section").orderBy(*order, F.col("updated_at").desc(), "item_id")
    placed = items.withColumn("section", section).where("section IS NOT NULL").withColumn("position", F.row_number().over(w).cast("long"))
    for name, n in (most or {}).items():
        placed = placed.where((F.col("section") != name) | (F.col("position") <= n))
    return placed


def newest_changes(versions: DataFrame, n: int) -> DataFrame:
    """Each scope's n newest versions, numbered from 1; Spark limits each map task's scopes before the shuffle."""
    w = Window.partitionBy("scope").orderBy(F.col("valid_from").desc(), F.col("version_id").desc())
    return versions.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= n).withColumns({"at": F.col("valid_from"), "note": F.col("previous")})


def project_brief(items: DataFrame, versions: DataFrame, scopes: DataFrame) -> DataFrame:
    """Facts of the eight sections of every scope's current state.

    Milestones and commitments go by due date (unknown last) and title, decisions and questions by title, risks and
    blockers by kind and title; the one nearest milestone, the 15 newest changes. A section without facts has no rows.
    """
    live, kind, status = F.col("status").isin(*V.LIVE), F.col("kind"), F.col("status")
    section = (
        F.when(live & (kind == "milestone"), "next_milestone").when(live & (kind == "commitment"), "open_commitments")
        .when((status == "active") & (kind == "decision"), "decisions").when(live & kind.isin("risk", "blocker"), "risks_and_blockers")
        .when((status == "open") & (kind == "open_question"), "unresolved_questions")
    )
    dated = F.col("section").isin("next_milestone", "open_commitments")
    order = [F.when(dated, F.col("due")).asc_nulls_last(), F.when(F.col("section") == "risks_and_blockers", kind).asc(), F.col("title").asc()]
    state = _state_facts(items, section, order, {"next_milestone": 1})
    changes = newest_changes(versions, RECENT).withColumn("section", F.lit("recent_changes"))
    meta = scopes.select("scope", F.lit("objective_and_scope").alias("section"), F.lit(1).cast("long").alias("position"), F.col("objective").alias("title"))
    stage = scopes.where("stage <> ''").select("scope", F.lit("current_stage").alias("section"), F.lit(1).cast("long").alias("position"), F.col("stage").alias("title"))
    names = list(PROJECT_SECTIONS)
    return _facts(meta, names).unionByName(_facts(stage, names)).unionByName(_facts(changes, names)).unionByName(_facts(state, names))


def meeting_state(items: DataFrame, versions: DataFrame) -> DataFrame:
    """Facts of the sections that all meetings of a scope share, and its 200 newest changes.

    Commitments go by owner known, due known, due date; an open question with an owner is a decision required, one
    without is unanswered, both by title; risks and blockers by kind and title.
    """
    live, kind = F.col("status").isin(*V.LIVE), F.col("kind")
    asked = (F.col("status") == "open") & (kind == "open_question")
    section = (
        F.when(live & (kind == "commitment"), "outstanding_commitments").when(asked & F.col("owner").isNotNull(), "decisions_required")
        .when(live & kind.isin("risk", "blocker"), "risks_and_blockers").when(asked, "unanswered_questions")
    )
    owed, risks = F.col("section") == "outstanding_commitments", F.col("section") == "risks_and_blockers"
    order = [F.when(owed, F.col("owner").isNull()).asc(), F.when(owed, F.col("due")).asc_nulls_last(), F.when(risks, kind).asc(), F.when(~owed, F.col("title")).asc()]
    state = _state_facts(items, section, order)
    changes = newest_changes(versions, SINCE).withColumn("section", F.lit("changes_since_previous"))
    names = list(MEETING_SECTIONS)
    return _facts(changes, names).unionByName(_facts(state, names))


def meetings_prepared(cutoffs: DataFrame, versions: DataFrame) -> DataFrame:
    """cutoffs (scope, meeting_id, cutoff) with n_changes: how many of the scope's newest changes a meeting's brief shows."""
    recent = newest_changes(versions, SINCE).groupBy("scope").agg(F.array_sort(F.collect_list("valid_from")).alias("times"))  # SINCE times at most
    n = F.size(F.filter(F.coalesce("times", F.array().cast("array<timestamp_ntz>")), lambda t: t >= F.col("cutoff")))
    return cutoffs.join(recent, "scope", "left").select("scope", "meeting_id", "cutoff", n.cast("long").alias("n_changes"))


def for_meetings(meetings: DataFrame, state: DataFrame, prepared: DataFrame) -> DataFrame:
    """meeting_id and the facts of every asked meeting (scope, meeting_id, title, purpose, at), its own purpose first."""
    asked = meetings.join(prepared.select("scope", "meeting_id", "n_changes"), ["scope", "meeting_id"])
    shown = asked.select("scope", "meeting_id", "n_changes").join(state, "scope").where("section <> 'changes_since_previous' OR position <= n_changes")
    purpose = asked.select("meeting_id", "scope", F.lit("meeting_purpose").alias("section"), F.lit(1).cast("long").alias("position"), "title", F.col("purpose").alias("note"), "at")
    return _facts(purpose, list(MEETING_SECTIONS), "meeting_id").unionByName(shown.select("meeting_id", *FACT))


def meeting_order(at: str) -> list[Column]:
    """Newest first, those without a time last."""
    return [F.col(at).desc_nulls_last()]


def cutoffs(meetings: DataFrame, created: DataFrame) -> DataFrame:
    """Each meeting's cutoff: an override, else the latest time of the scope's meetings strictly before it, else the scope's
    creation. A meeting without a time has none before it."""
    moment = F.unix_micros(F.col("at").cast("timestamp"))
    w = Window.partitionBy("scope").orderBy("moment").rangeBetween(Window.unboundedPreceding, -1)  # no meeting of the same time
    before = meetings.withColumn("moment", moment).withColumn("earlier", F.when(F.col("at").isNotNull(), F.max("at").over(w)))
    return before.join(created, "scope", "left").select("scope", "meeting_id", F.coalesce("override", "earlier", "created_at").alias("cutoff"))


# --- claims ---------------------------------------------------------------------------------------------------------


def without_facts(facts: DataFrame, excluded: DataFrame) -> DataFrame:
    """Facts less those (fact_id) that the user unchecked."""
    return facts.join(excluded.select("fact_id").distinct(), "fact_id", "left_anti")


def checked_claims(claims: DataFrame, facts: DataFrame, self_evident: Sequence[str] = ()) -> DataFrame:
    """claims (claim_id, section, type, fact_ids) with validation and cited: the facts (fact_id, section, has_evidence) that they
    resolve to, in their order; of an invalid claim that resolves to none, what it asked for.

    A fact counts in its own section only. Types other than fact and inference need none and are valid. Else a claim
    without one is invalid_reference, one whose facts all lack evidence unsupported, unless its section speaks for itself.
    """
    asked = claims.select("claim_id", "section", F.posexplode("fact_ids").alias("nth", "fact_id"))
    found = asked.join(facts.select("fact_id", "section", "has_evidence"), ["fact_id", "section"])
    each = found.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("nth", "fact_id"))).alias("r"), F.max("has_evidence").alias("proved"))
    none = F.array().cast(claims.schema["fact_ids"].dataType)
    resolved = F.coalesce(F.transform("r", lambda x: x["fact_id"]), none)
    state = (
        F.when(~F.col("type").isin("fact", "inference"), "valid").when(F.size(resolved) == 0, "invalid_reference")
        .when(F.col("section").isin(*self_evident) | F.coalesce("proved", F.lit(False)), "valid").otherwise("unsupported")
    )
    out = claims.join(each, "claim_id", "left").withColumn("validation", state)
    cited = F.when((F.col("validation") == "valid") | (F.size(resolved) > 0), resolved).otherwise(F.coalesce("fact_ids", none))
    return out.select(*claims.columns, "validation", cited.alias("cited"))


def fallback_claims(facts: DataFrame, claims: DataFrame, self_evident: Sequence[str] = ()) -> DataFrame:
    """A claim for each fact of the sections that have facts but no valid claim, in its own words: (section, type, fact_ids, text, validation)."""
    missing = facts.join(claims.where("validation = 'valid'").select("section").distinct(), "section", "left_anti")
    validation = F.when(F.col("section").isin(*self_evident) | F.col("has_evidence"), "valid").otherwise("unsupported")
    said = T.claim_sentence(F.col("title"), F.col("owner").cast("string"), F.col("due").cast("string"), F.col("status"), F.col("transition"), F.col("note"))
    return missing.select("section", F.lit("fact").alias("type"), F.array("fact_id").alias("fact_ids"), said.alias("text"), validation.alias("validation"))


def claim_evidence(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence of the claimed facts, once per claim."""
    return claims.select("claim_id", F.explode("fact_ids").alias("fact_id")).join(links, "fact_id").select("claim_id", "content_id", "quote").distinct()


def citations(links: DataFrame) -> DataFrame:
    """(claim_id, citation): " [1](viewer link) [source](its address)" of links (claim_id, ordinal, artifact_id, char_start, char_end, url)."""
    view = F.concat(F.lit("evidence?artifact_id="), "artifact_id", F.lit("&char_start="), "char_start", F.lit("&char_end="), "char_end")
    listed = links.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", view.alias("view"), "url"))).alias("l"))
    mark = lambda x, k: F.concat(F.lit("["), k + 1, F.lit("]"), F.coalesce(F.concat(F.lit("("), x["view"], F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" [source]("), x["url"], F.lit(")")), F.lit("")))
    return listed.select("claim_id", F.concat(F.lit(" "), F.array_join(F.transform("l", mark), " ")).alias("citation"))


def markdown(claims: DataFrame, scopes: DataFrame, cited: DataFrame | None = None, title: str = "Current Project Brief", sections: dict[str, str] | None = None) -> DataFrame:
    """(scope, markdown) from valid claims (scope, claim_id, section, ordinal, type, text): all sections, in their order."""
    sections = sections or PROJECT_SECTIONS
    mark = F.when(F.col("type") == "inference", "**Inference:** ").when(F.col("type") == "suggestion", "**Suggestion:** ").otherwise("")
    valid = claims.where("validation = 'valid'") if "validation" in claims.columns else claims
    valid = valid.join(cited, "claim_id", "left") if cited is not None else valid.withColumn("citation", F.lit(""))
    line = F.concat(F.lit("- "), mark, "text", F.coalesce("citation", F.lit("")))
    said = valid.groupBy("scope", "section").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("l"))
    by_section = said.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("section", F.array_join(F.transform("l", lambda x: x["line"]), "\n")))).alias("said"))
    parts = [F.concat(F.lit(f"## {heading}\n"), F.coalesce(F.col("said")[key], F.lit("- No accepted items.")), F.lit("\n")) for key, heading in sections.items()]
    text = F.concat(F.concat_ws("\n", F.concat(F.lit(f"# {title} — "), "name", F.lit("\n")), *parts))
    return scopes.join(by_section, "scope", "left").select("scope", text.alias("markdown"))


def fact_payload(row: Sequence[str] = ("fact_id", "kind", "title", "detail", "status", "owner_name", "due_date", "effective_at", "transition_type", "previous_summary")) -> Column:
    """JSON of a fact for a prompt; what is not set is left out."""
    return F.to_json(F.struct(*row))


def section_payloads(facts: DataFrame, sections: dict[str, str]) -> DataFrame:
    """(scope, payload): JSON of each scope's sections that have facts, in order."""
    each = facts.groupBy("scope", "section").agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*(c for c in facts.columns if c not in ("scope", "section", "position"))).alias("f")))).alias("f"))
    listed = each.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("section", F.transform("f", lambda x: x["f"])))).alias("m"))
    parts = F.filter(F.array(*(F.struct(F.lit(k).alias("section"), F.lit(h).alias("heading"), F.col("m")[k].alias("facts")) for k, h in sections.items())), lambda s: s["facts"].isNotNull())
    return listed.select("scope", F.to_json(parts).alias("payload"))


def extraction_prompt(name: Column, objective: Column, stage: Column, title: Column, source: Column, author: Column, occurred: Column, chunk: Column, text: Column) -> Column:
    """A model call's input: project, source and one chunk, with the quoted text set off. The labels are fixed values."""
    stated = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Not stated"))
    return F.concat(
        F.lit("<project>\nName: "), name, F.lit("\nObjective: "), objective, F.lit("\nStage: "), stated(stage), F.lit("\n</project>\n<source_metadata>\nTitle: "), stated(title),
        F.lit("\nSource type: "), stated(source), F.lit("\nAuthor/participants: "), stated(author), F.lit("\nOccurred at: "), stated(occurred),
        F.lit('\n</source_metadata>\n<source_chunk id="'), chunk, F.lit('">\n'), text, F.lit("\n</source_chunk>\n"),
    )
