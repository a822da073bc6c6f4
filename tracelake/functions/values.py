"""Dates, numbers and JSON, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import vocabulary as V


def stated_date(value: Column, text: Column) -> Column:
    """struct<value, original_text, ambiguous>; ambiguous is a phrase without a date, or a vague one."""
    day = F.to_date(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))
    vague = F.lower(F.trim(text)).isin(*V.VAGUE_DATES)
    return F.struct(day.alias("value"), text.alias("original_text"), F.coalesce((day.isNull() & text.isNotNull()) | vague, F.lit(False)).alias("ambiguous"))


def utc_from_mail_date(text: Column) -> Column:
    """The UTC timestamp of a mail header's date, or null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", "")
    zoned = F.regexp_replace(F.regexp_replace(bare, r"\s+(GMT|UT|UTC|Z)$", " +0000"), r"\s+", " ")
    tries = [F.try_to_timestamp(zoned, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")]
    return F.coalesce(*tries)


def overlap_start(last_success: Column, hours: int = 48) -> Column:
    return F.timestamp_add("HOUR", F.lit(-hours), last_success)


def event_start(date_time: Column, date: Column) -> Column:
    return F.coalesce(date_time, F.concat(date, F.lit("T00:00:00Z")))


def plausible_year(day: Column) -> Column:
    return F.year(day).between(2000, 2100)


def date_proximity(a: Column, b: Column, window: int = V.NEAR_DAYS) -> Column:
    near = F.greatest(F.lit(0.0), 1.0 - F.abs(F.datediff(a, b)) / float(window))
    return F.when(a.isNotNull() & b.isNotNull(), near).when(a.isNull() & b.isNull(), 0.5).otherwise(0.25)


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def model_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * V.USD_PER_MILLION["in"] + tokens_out / 1e6 * V.USD_PER_MILLION["out"]


def backoff(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def retry_class(status: Column) -> Column:
    """What a fetch does about a response: give up, try again, or go on."""
    return F.when(status.isin(401, 403, 404), "fail").when(status.isin(408, 429) | (status >= 500), "retry").when(status >= 400, "fail").otherwise("ok")


def weakest_band(*bands: Column) -> Column:
    rank = lambda b: F.when(b == "low", 0).when(b == "medium", 1).otherwise(2)
    return F.element_at(F.array(*map(F.lit, V.BANDS)), F.least(*map(rank, bands)) + 1)


def json_digest(*columns: Column) -> Column:
    """A version mark: the first 16 hex digits of the columns' JSON's hash."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)
