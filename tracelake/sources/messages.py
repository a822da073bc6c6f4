"""Mail, events and meetings as text: bodies from MIME parts, and headers with the offset at which the body begins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import text as T


def body_text(leaves: Column) -> Column:
    """From array<struct<mime, filename, data>> (depth first, data in base64url): all plain parts, else HTML as text; null if neither."""
    own = F.filter(leaves, lambda p: F.coalesce(p["filename"], F.lit("")) == "")
    of = lambda mime: F.transform(F.filter(own, lambda p: F.lower(p["mime"]) == mime), lambda p: T.decode_base64url(p["data"]))
    plain, html = of("text/plain"), of("text/html")
    return F.when(F.size(plain) > 0, F.array_join(plain, "\n\n")).when(F.size(html) > 0, T.html_to_text(F.array_join(html, "\n\n")))


def mail_text(subject: Column, sender: Column, to: Column, cc: Column, date: Column, message_id: Column, body: Column) -> Column:
    """struct<text, body_start>: the known headers a line each, a blank line, the body."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws("\n", line("Subject", subject), line("From", sender), line("To", to), line("Cc", cc), line("Date", date), line("Message-ID", message_id))
    return F.struct(F.concat(head, F.lit("\n\n"), F.coalesce(body, F.lit(""))).alias("text"), (F.length(head) + 2).alias("body_start"))


def event_text(title: Column, start: Column, end: Column, organizer: Column, attendees: Column, link: Column, description: Column) -> Column:
    """struct<text, description_start> of a calendar event."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    people = F.when(F.size(attendees) > 0, F.array_join(attendees, ", "))
    head = F.concat_ws("\n", line("Event", title), line("Start", start), line("End", end), line("Organizer", organizer), line("Attendees", people), line("Link", link))
    return F.struct(F.concat(head, F.lit("\n\n"), F.coalesce(description, F.lit(""))).alias("text"), (F.length(head) + 2).alias("description_start"))


def meeting_text(title: Column, start: Column, turns: Column, summary: Column, actions: Column) -> Column:
    """struct<text, transcript_start, transcript_end>: a header, "[time] Speaker: text" turns, then what others made of it, marked so."""
    head = F.concat_ws("\n", F.concat(F.lit("Meeting: "), title), F.concat(F.lit("Start: "), start))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("["), t["start"], F.lit("] "), F.coalesce(t["speaker"], F.lit("Unknown")), F.lit(": "), t["text"])), "\n\n")
    extra = F.concat_ws("\n\n", F.concat(F.lit("Summary (secondary):\n"), summary), F.when(F.size(actions) > 0, F.concat(F.lit("Action items (secondary):\n"), F.array_join(actions, "\n"))))
    text = F.concat(head, F.lit("\n\n"), spoken, F.when(extra != "", F.concat(F.lit("\n\n"), extra)).otherwise(""))
    return F.struct(text.alias("text"), (F.length(head) + 2).alias("transcript_start"), (F.length(head) + 2 + F.length(spoken)).alias("transcript_end"))


def first_speakers(turns: Column) -> Column:
    """Distinct speakers in the order in which they first speak."""
    return F.array_distinct(F.filter(F.transform(turns, lambda t: t["speaker"]), lambda s: s.isNotNull()))
