"""Lookups, lists, latest-per-key, set operations, upserts and constraints over ledger-like tables.

Every operator is DataFrame to DataFrame without an action. Keys are null-safe only where a docstring says so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(table: DataFrame, scope: str, value, order: Sequence[Column] = (), **wanted) -> DataFrame:
    """Rows of one scope; each further name=value filters if the value isn't None (a list means any of it)."""
    out = table.where(F.col(scope) == value)
    for name, v in wanted.items():
        if v is not None:
            out = out.where(F.col(name).isin(*v) if isinstance(v, (list, tuple)) else F.col(name) == v)
    return out.orderBy(*order) if order else out


def top_recent(table: DataFrame, at: str, n: int, ties: Sequence[str], since=None) -> DataFrame:
    """The n latest rows, of those at or after `since`; planned as one TakeOrdered, never a full sort."""
    out = table if since is None else table.where(F.col(at) >= since)
    return out.orderBy(F.col(at).desc(), *ties).limit(n)


def latest_per_key(table: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Every row at its key's latest time, ties included: a grouped maximum joined back, so no key is one task's work."""
    last = table.groupBy(*key).agg(F.max(at).alias(at))
    return table.join(last, [*key, at], "left_semi")


def latest_failures(attempts: DataFrame, key: Sequence[str], at: str, failed: Column, limit: int | None = None) -> DataFrame:
    """Latest attempts that failed; a key whose later attempt succeeded is not in it."""
    out = latest_per_key(attempts, key, at).where(failed)
    return out if limit is None else out.orderBy(F.col(at).desc(), *key).limit(limit)


def next_number(table: DataFrame, key: Sequence[str], number: str) -> DataFrame:
    return table.groupBy(*key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("long").alias("next_no"), F.concat(F.lit("v"), F.count("*") + 1).alias("next_key"))


def only_in(table: DataFrame, scope: Column, value: str) -> DataFrame:
    """Distinct values that the rows in scope have and no other row has (EXCEPT)."""
    return table.where(scope).select(value).subtract(table.where(~scope).select(value))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New rows whose key is not there yet, the first of each key by `order`."""
    first = new.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in new.columns if c not in (*key, *order)])).alias("r")).select(*key, "r.*")
    return first.join(existing.select(*key).distinct(), list(key), "left_anti").select(*new.columns)


def coalesced_update(table: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """`table` with the changes' values, a null leaving what is there (one change a key); keys that are new are added."""
    own = [c for c in table.columns if c not in key]
    changes = changes.select(*key, *(F.col(c).alias(f"new_{c}") if c in changes.columns else F.lit(None).alias(f"new_{c}") for c in own))
    return table.join(changes, list(key), "full").select(*key, *(F.coalesce(f"new_{c}", c).alias(c) for c in own)).select(*table.columns)


def marked_superseded(table: DataFrame, scope: Column, keep: Column, status: str = "status") -> DataFrame:
    return table.withColumn(status, F.when(scope & ~keep & (F.col(status) == "valid"), "superseded").otherwise(F.col(status)))


def counts_by(tables: Mapping[str, DataFrame], scope: str) -> DataFrame:
    """(name, scope, n) of every table: what deleting a scope would take."""
    return reduce(DataFrame.unionByName, [t.groupBy(F.col(scope).alias("scope")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "scope", "n") for name, t in tables.items()])


def verified_objects(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """(sha256, state) of listed objects: ok, corrupt where the stored bytes have another hash, missing where there are none (which
    is no corruption: they may have been missing before)."""
    found = stored.select("sha256", F.sha2("content", 256).alias("actual")).groupBy("sha256").agg(F.max(F.col("actual") == F.col("sha256")).alias("sound"))
    state = F.when(F.col("sound").isNull(), "missing").when(F.col("sound"), "ok").otherwise("corrupt")
    return listed.select("sha256").distinct().join(found, "sha256", "left").select("sha256", state.alias("state"))


def without_scope(tables: Mapping[str, DataFrame], scope: str, value) -> dict[str, DataFrame]:
    """The tables less a scope's rows, dependants and all; rows of a null scope stay."""
    return {name: t.where(~F.col(scope).eqNullSafe(F.lit(value))) for name, t in tables.items()}


def scope_counts(tables: Mapping[str, DataFrame], scope: str, hashes: Mapping[str, str] | None = None) -> DataFrame:
    """`counts_by`, and as `orphans` how many distinct objects of the tables in `hashes` (table -> column) only that scope has."""
    out = counts_by(tables, scope)
    for name, column in (hashes or {}).items():
        owners = tables[name].where(F.col(column).isNotNull()).groupBy(column).agg(F.min(scope).alias("scope"), F.max(scope).alias("other"))
        alone = owners.where("scope = other").groupBy("scope").agg(F.count("*").alias("n"))
        out = out.unionByName(alone.select(F.lit(f"orphans of {name}").alias("name"), "scope", "n"))
    return out


def broken_checks(table: DataFrame, checks: Mapping[str, Column], key: Sequence[str]) -> DataFrame:
    """(key, check) for every check that a row breaks; a null outcome is no breach, as in SQL."""
    hits = F.filter(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return table.select(*key, F.explode(hits).alias("check"))


def repeated_keys(table: DataFrame, key: Sequence[str], where: Column | None = None) -> DataFrame:
    """Breaches of (partial) uniqueness; rows with a null in the key break none."""
    rows = table if where is None else table.where(where)
    return rows.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    keys = parent.select(*(F.col(p).alias(c) for c, p in on.items()))
    return child.dropna(subset=list(on)).join(keys, list(on), "left_anti")


def due_order(due: str, title: str) -> list[Column]:
    return [F.col(due).asc_nulls_last(), F.col(title).asc()]


def ranked(table: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n of each group; Spark limits each map task's groups before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return table.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= n)


#: What is reviewed first.
REVIEW_PRIORITY = {"CONFLICT": 0, "SUPERSEDE": 1, "CANCEL": 1, "UPDATE": 1, "COMPLETE": 2, "CREATE": 3, "ADD_EVIDENCE": 4, "NO_OP": 5}


def review_order(action: str, created: str) -> list[Column]:
    """By the action's priority, then oldest first."""
    first = F.coalesce(*(F.when(F.col(action) == a, F.lit(n)) for a, n in REVIEW_PRIORITY.items()), F.lit(9))
    return [first.asc(), F.col(created).asc()]


def placed(rows: DataFrame, coarse: Sequence[Column], fine: Sequence[Column], name: str = "place") -> DataFrame:
    """`rows` with their places in the whole order, coarse first. Rows are ranked within each combination of coarse values, behind
    the number of rows in all before; so no task sorts more than one combination's rows, and a window sees a row for each."""
    keys = [f"_{name}_{k}" for k in range(len(coarse))]
    keyed = rows.withColumns(dict(zip(keys, (c if not isinstance(c, tuple) else c[0] for c in coarse), strict=True)))
    down = [isinstance(c, tuple) for c in coarse]
    order = [F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_first() for k, d in zip(keys, down, strict=True)]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # a row a combination
    offsets = keyed.groupBy(*keys).agg(F.count("*").alias("_n")).select(*(F.col(k).alias(f"{k}_") for k in keys), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    nth = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*fine)))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return nth.join(offsets, same).select(*rows.columns, (F.col("_offset") + F.col("_nth")).alias(name))


def grouped_first_seen(rows: DataFrame, title: Column, place: str) -> DataFrame:
    """(title, first_place, n): groups in the order in which they are first seen, `place` being a row's place."""
    return rows.groupBy(title.alias("title")).agg(F.min(place).alias("first_place"), F.count("*").alias("n"))


def merged_claims(claims: DataFrame, item: str, order: str) -> DataFrame:
    """A row an item: its first known status, owner and due date, its evidence in order, its texts joined."""
    gathered = claims.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(order, "status", "owner", "due", "text", "evidence"))).alias("c"))
    first = lambda f: F.get(F.filter(F.transform("c", lambda x: x[f]), lambda v: v.isNotNull()), F.lit(0)).alias(f)
    evidence = F.array_distinct(F.flatten(F.transform("c", lambda x: F.coalesce(x["evidence"], F.array().cast("array<string>")))))
    return gathered.select(item, first("status"), first("owner"), first("due"), F.array_join(F.transform("c", lambda x: x["text"]), " | ").alias("text"), evidence.alias("evidence"))


def by_owner(items: DataFrame, owner: str, columns: Sequence[str]) -> DataFrame:
    """Items by their owner's name, `Unassigned` last, then by `columns`: a sort, so that no owner's items are one task's."""
    named = items.withColumn(owner, F.coalesce(owner, F.lit("Unassigned")))
    return named.orderBy((F.col(owner) == "Unassigned").asc(), F.lower(owner).asc(), owner, *columns).select(owner, *columns)
