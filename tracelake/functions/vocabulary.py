"""The word lists, phrase lists and tables that results depend on. Keep them as they are."""

from __future__ import annotations

PUNCTUATION = ".,;:!?\"'`‘’“”()[]{}"

STATUS_WORDS = (
    "open", "active", "completed", "complete", "resolved", "resolve", "canceled", "cancelled", "cancel", "superseded", "supersede",
    "pending", "done", "blocked", "create", "created", "update", "updated", "reopen", "reopened", "correct", "corrected",
)
DATE_WORDS = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "today", "tomorrow", "yesterday", "tonight", "week", "weeks", "month", "months", "day", "days", "year", "years",
    "next", "last", "this", "soon", "later", "eod", "eow", "asap", "now", "currently",
)
STOP_WORDS = ("the", "a", "an", "of", "to", "for", "on", "in", "at", "by", "is", "was", "will", "be")
VOLATILE_WORDS = STATUS_WORDS + DATE_WORDS + STOP_WORDS
DATE_SHAPE = r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}(/\d{2,4})?|\d{1,2}(st|nd|rd|th)|\d+)$"
SENTENCE_STARTERS = ("the", "this", "that", "we", "i", "they", "he", "she", "it", "our", "their", "a", "an")
VAGUE_DATES = ("soon", "eventually", "tbd", "sometime", "later", "at some point", "down the road")

FUTURE = (
    "will finish", "will send", "will complete", "will deploy", "will ship", "plans to", "planning to", "going to", "intends to",
    "intend to", "expects to", "expected to", "aims to", "hopes to", "scheduled to", "is set to", "due to",
)
COMPLETION = (
    "is complete", "is now complete", "has been sent", "was sent", "has been approved", "was approved", "has been deployed",
    "was deployed", "has shipped", "was shipped", "shipped", "is done", "marked complete", "marked as complete", "completed on",
    "has finished", "finished", "delivered", "signed off", "signed-off", "closed out", "wrapped up",
)
DELAY = ("delayed", "postponed", "pushed back", "blocked", "not yet", "still pending", "on hold", "stalled", "slipping")
CANCELLATION = (
    "cancel", "cancelled", "canceled", "no longer needed", "won't proceed", "will not proceed", "abandoned", "scrapped",
    "called off", "dropped entirely", "no longer pursuing",
)
DATE_CHANGE = (
    "moved to", "pushed to", "pushed back to", "new target", "now due", "rescheduled to", "changed to", "updated to", "new date",
    "now targeting", "moved the date",
)
ASSISTANCE = ("will help", "is helping", "helping out", "assisting", "support from", "pairing with", "lending a hand")
ASSIGNMENT = (
    "now owned by", "reassigned to", "re-assigned to", "assigned to", "will own", "is now responsible for", "taking over",
    "took over", "handed off to", "handed it off to", "ownership moves to", "new owner",
)
SUPERSESSION = ("instead of", "replaces", "replacing", "supersedes", "superseding", "in place of", "rather than", "overrides", "overriding")
BLOCKING = (
    "cannot proceed", "can't proceed", "unable to proceed", "is now blocking", "work is blocked", "stopped work",
    "blocking progress", "halted",
)
LOCAL_REFERENCE = (
    "that date", "this decision", "the above", "as mentioned", "per the previous", "that item", "this action", "the previous",
    "as discussed", "aforementioned", "same as before", "per above", "the aforementioned",
)
#: cue -> (phrases, phrases that suppress it)
CUES = {
    "completion": (COMPLETION, FUTURE),
    "cancellation": (CANCELLATION, ()),
    "delay": (DELAY, ()),
    "date_change": (DATE_CHANGE, ()),
    "owner_assignment": (ASSIGNMENT, ASSISTANCE),
    "supersession": (SUPERSESSION, ()),
    "blocking": (BLOCKING, ()),
    "local_reference": (LOCAL_REFERENCE, ()),
}

KINDS = ("commitment", "decision", "milestone", "risk", "blocker", "open_question", "stakeholder")
STATUSES = ("open", "active", "completed", "resolved", "canceled", "superseded")
STATUSES_OF_KIND = {
    "commitment": ("open", "active", "completed", "canceled", "superseded"),
    "decision": ("active", "canceled", "superseded"),
    "milestone": ("open", "active", "completed", "canceled", "superseded"),
    "risk": ("open", "active", "resolved", "canceled", "superseded"),
    "blocker": ("open", "active", "resolved", "canceled", "superseded"),
    "open_question": ("open", "resolved", "canceled", "superseded"),
    "stakeholder": ("active", "canceled", "superseded"),
}
INITIAL_STATUS = {k: "active" if k in ("decision", "stakeholder") else "open" for k in KINDS}
LIVE = ("open", "active")
TERMINAL = ("completed", "resolved", "canceled", "superseded")
#: transition -> statuses it may start from; None is "no version yet"
FROM_STATUS = {
    "create": (None,),
    "update": LIVE,
    "complete": LIVE,
    "resolve": LIVE,
    "cancel": LIVE,
    "supersede": LIVE,
    "reopen": TERMINAL,
    "correct": (None, *STATUSES),
}
TO_STATUS = {"complete": "completed", "resolve": "resolved", "cancel": "canceled", "supersede": "superseded"}
SECONDARY_KINDS = {"decision": "milestone", "risk": "blocker", "blocker": "risk"}
SUPERSEDABLE = ("decision", "milestone", "commitment", "open_question")

WEIGHTS = {
    "subject_token_similarity": 0.35, "owner_match": 0.20, "date_proximity": 0.15, "item_type_compatibility": 0.10,
    "shared_named_entities": 0.10, "source_local_reference": 0.10, "mutually_exclusive_owner": -0.25,
    "completed_long_ago": -0.20, "corrected_field_disagreement": -0.20,
}
STRONG, MARGIN, REVIEW, SAME, NEAR_DAYS, LONG_AGO_DAYS, TOKEN_FLOOR, SEARCH_LIMIT, RECENT_LIMIT = 0.82, 0.15, 0.65, 0.75, 14, 30, 0.20, 10, 5
BANDS = ("low", "medium", "high")
REVIEW_SECONDS = {"accept": 8, "edit": 25, "reject": 15}
USD_PER_MILLION = {"in": 2.0, "out": 12.0}

QUOTE_MARKS = (
    r"(?i)^\s*On .{0,300}\bwrote:\s*$",
    r"(?i)^\s*-{2,}\s*Original Message\s*-{2,}\s*$",
    r"(?i)^\s*-{2,}\s*Forwarded message\s*-{2,}\s*$",
    r"^--\s?$",
)
QUOTED_LINE = r"^\s*>"
