"""Rule tiers: the first tier that hits decides, and why it hit is kept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import text as T


def _array(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>") if values else F.array().cast("array<string>")


def _first(array: Column, test) -> Column:
    return F.get(F.filter(array, test), F.lit(0))


def _result(tier: Column, reason: Column, against: Column) -> Column:
    matched = tier.isNotNull() & against.isNull()
    why = F.when(against.isNotNull() & tier.isNotNull(), F.concat(F.lit("excluded despite "), tier, F.lit(" ("), reason, F.lit("): "), against)).when(against.isNotNull(), F.concat(F.lit("excluded by "), against)).otherwise(reason)
    return F.struct(matched.alias("matched"), F.when(matched, tier).alias("tier"), why.alias("reason"))


def event_match(event_id: Column, title: Column, description: Column, emails: Column, rules: Mapping) -> Column:
    """struct<matched, tier, reason> of a calendar event: event id, project term, domain or participant, include rule; any exclude overrides.

    `emails` is the organizer's, then the attendees'. Lists in `rules` may be empty, patterns None.
    """
    searched = F.concat_ws("\n", title, description)
    term = T.term_hit(searched, _array(rules.get("project_name_terms")))
    domain = rules.get("client_domain")
    at_domain = _first(emails, lambda e: T.email_domain(e) == domain) if domain else F.lit(None).cast("string")
    listed = _first(emails, lambda e: F.array_contains(_array(rules.get("participant_emails")), e)) if rules.get("participant_emails") else F.lit(None).cast("string")
    wanted = T.term_hit(searched, _array(rules.get("include_terms")))
    pattern, unless = rules.get("include_regex"), rules.get("exclude_regex")
    by_pattern = searched.rlike(f"(?i){pattern}") if pattern else F.lit(False)
    against = F.concat(F.lit("term "), T.term_hit(searched, _array(rules.get("exclude_terms"))))
    if unless:
        against = F.coalesce(against, F.when(searched.rlike(f"(?i){unless}"), F.lit(f"pattern {unless}")))
    by_id = F.array_contains(_array(rules.get("included_event_ids")), event_id) if rules.get("included_event_ids") else F.lit(False)
    tiers = [
        (by_id, "event_id", event_id),
        (term.isNotNull(), "project_name_term", term),
        (at_domain.isNotNull(), "domain_participant", at_domain),
        (listed.isNotNull(), "domain_participant", listed),
        (wanted.isNotNull(), "include_rule", wanted),
        (by_pattern, "include_rule", F.lit(pattern)),
    ]
    return _ladder(tiers, against)


def meeting_match(recording_id: Column, recorded_by: Column, emails: Column, url: Column, start: Column, rules: Mapping) -> Column:
    """struct<matched, tier, reason> of a recorded meeting: manual, recorded by, domain, participant, scheduled (link, then closed windows)."""
    domain, people = rules.get("client_domain"), rules.get("participant_emails")
    at_domain = _first(emails, lambda e: T.email_domain(e) == domain) if domain else F.lit(None).cast("string")
    listed = _first(emails, lambda e: F.array_contains(_array(people), e)) if people else F.lit(None).cast("string")
    window = F.lit(None).cast("string")
    for lo, hi in reversed(rules.get("scheduled_windows") or ()):
        window = F.when(start.between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")), F.lit(f"{lo}/{hi}")).otherwise(window)
    tiers = [
        (F.array_contains(_array(rules.get("included_recording_ids")), recording_id) if rules.get("included_recording_ids") else F.lit(False), "manual", recording_id),
        (F.array_contains(_array(rules.get("recorded_by_emails")), recorded_by) if rules.get("recorded_by_emails") else F.lit(False), "recorded_by", recorded_by),
        (at_domain.isNotNull(), "client_domain", at_domain),
        (listed.isNotNull(), "participant", listed),
        (F.array_contains(_array(rules.get("meeting_urls")), url) if rules.get("meeting_urls") else F.lit(False), "scheduled_event", url),
        (window.isNotNull(), "scheduled_event", window),
    ]
    return _ladder(tiers, F.lit(None).cast("string"))


def _ladder(tiers: list[tuple[Column, str, Column]], against: Column) -> Column:
    tier, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for hit, name, why in reversed(tiers):
        hit = F.coalesce(hit, F.lit(False))
        tier, reason = F.when(hit, name).otherwise(tier), F.when(hit, why).otherwise(reason)
    return _result(tier, reason, against)


def availability(tier: Column) -> Column:
    """A meeting known only by its slot is stored, but assigned to nothing."""
    return F.when(tier == "scheduled_event", "unassigned").when(tier.isNotNull(), "available")


def configured(rules: Mapping, lists: tuple[str, ...], patterns: tuple[str, ...] = ()) -> bool:
    """Whether a boundary says anything; a pattern that is no regular expression says nothing."""
    import re

    def valid(p) -> bool:
        try:
            return bool(p) and bool(re.compile(p))
        except re.error:
            return False

    return any(rules.get(k) for k in lists) or any(valid(rules.get(p)) for p in patterns)


def boundary(json: Column) -> Column:
    """Rules from JSON: blanks dropped, entries trimmed and, for addresses and domains, in lower case without a leading @."""
    parsed = F.from_json(json, "struct<project_name_terms:array<string>,include_terms:array<string>,exclude_terms:array<string>,participant_emails:array<string>,client_domain:string>")
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    lower = F.regexp_replace(F.lower(F.trim(parsed["client_domain"])), "^@", "")
    return F.struct(
        *(clean(parsed[k]).alias(k) for k in ("project_name_terms", "include_terms", "exclude_terms")),
        F.transform(clean(parsed["participant_emails"]), F.lower).alias("participant_emails"),
        F.nullif(lower, F.lit("")).alias("client_domain"),
    )
