"""What the paged services ask for and what of their answers counts: folder trees, mail queries, calendar windows, retries.

Listings are DataFrames of recorded answers (`paged`). Bounds and defaults are fixed values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions import values as D

#: Least, usual and most days of a calendar scan, back and ahead.
BACK, AHEAD = (1, 180, 730), (1, 90, 365)
ATTEMPTS, BASE_SECONDS, MOST_SECONDS = 5, 0.5, 20.0


def folder_tree(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """(folder_id, depth) of the folders below the roots (folder_id), these among them, each once at its least depth.

    listing: parent_id, id, mime. A recursive query over folders alone; one that lies below itself ends the walk of its
    branch after 100 steps (spark.sql.cteRecursionLevelLimit), and more than a million steps need a higher
    spark.sql.cteRecursionRowLimit.
    """
    spark, tag = listing.sparkSession, uuid.uuid4().hex
    listing.where(T.drive_class("mime") == "folder").select(F.col("parent_id").alias("p"), F.col("id").alias("c")).createOrReplaceTempView(f"folders_{tag}")
    roots.select(F.col("folder_id").alias("r")).createOrReplaceTempView(f"roots_{tag}")
    walk = f"WITH RECURSIVE walk(folder_id, depth) AS (SELECT r, 0 FROM roots_{tag} UNION ALL SELECT c, depth + 1 FROM walk JOIN folders_{tag} ON p = folder_id WHERE depth < 99) SELECT folder_id, CAST(min(depth) AS LONG) AS depth FROM walk GROUP BY folder_id"
    return spark.sql(walk)


def drive_files(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Listed files in any folder below the roots, with how they are had (download or export); folders and native files other than
    documents are none."""
    kind = T.drive_class("mime")
    files = listing.withColumn("how", F.when(kind == "google_doc", "export").when(kind == "downloadable", "download")).where("how IS NOT NULL")
    return files.join(folder_tree(listing, roots).select(F.col("folder_id").alias("parent_id")), "parent_id", "left_semi")


def mail_since(last_success: Column, hours: int = 48) -> Column:
    """The day from which mail is asked for: that of the overlap's start; null where there was no success."""
    return F.date_format(D.overlap_start(last_success, hours), "yyyy/MM/dd")


def mail_query(label: Column, query: Column, since: Column) -> Column:
    """The search for a boundary: label, query in brackets, first day, as far as they are given."""
    given = lambda c: F.nullif(c, F.lit(""))
    quoted = F.concat(F.lit('label:"'), F.replace(given(label), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat_ws(" ", quoted, F.concat(F.lit("("), given(query), F.lit(")")), F.concat(F.lit("after:"), given(since)))


def mail_messages(listed: DataFrame, answers: DataFrame, key: str = "message_id") -> DataFrame:
    """Listed messages with their metadata (key, status, ...); those that have gone or are closed since (403, 404) are passed over."""
    return listed.join(answers.where(~F.col("status").isin(403, 404)), key)


def scan_window(now: Column, days_back: int = BACK[1], days_ahead: int = AHEAD[1]) -> tuple[Column, Column]:
    """First and last moment of a calendar scan."""
    for name, days, (least, _, most) in (("days_back", days_back, BACK), ("days_ahead", days_ahead, AHEAD)):
        if not least <= days <= most:
            raise ValueError(f"{name} must be between {least} and {most}")
    return F.timestamp_add("DAY", F.lit(-days_back), now), F.timestamp_add("DAY", F.lit(days_ahead), now)


def scanned(events: DataFrame, now: Column, days_back: int = BACK[1], days_ahead: int = AHEAD[1], at: str = "start", end: str = "end") -> DataFrame:
    """Events that lie in the window, if only in part; cancelled ones are shown, too."""
    first, last = scan_window(now, days_back, days_ahead)
    return events.where((F.coalesce(end, at) > first) & (F.col(at) < last))


def retry_fate(status: Column, attempt: Column) -> Column:
    """ok, fail, or retry up to the last attempt."""
    fate = D.retry_class(status)
    return F.when((fate == "retry") & (attempt >= ATTEMPTS), "fail").otherwise(fate)


def retry_delay(attempt: Column, retry_after: Column, share: Column) -> Column:
    """Seconds before the next attempt: what the service states as a number, else a share (in [0, 1)) of the doubled delay."""
    number = F.when(retry_after.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(retry_after).cast("double"))
    stated = F.when(number.isNotNull(), F.greatest(F.lit(0.0), number))
    return F.coalesce(stated, share * D.backoff(attempt, BASE_SECONDS, MOST_SECONDS))
