"""Every query that has SQL gives the SQL's rows, and none is empty; on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tracelake.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"orphan_hash_except", "expression_key_lookup", "vanished_items", "jaccard_pairs", "foreign_key_orphans", "scope_filter_list", "claim_item_match", "latest_failed_per_key", "open_items_by_due", "bm25_topk"}


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in frame.collect())
    assert rows or name in MAY_BE_EMPTY
    if name in catalog.ORACLES:
        found = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert sorted(repr(tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in columns)) for r in found.fetchall()) == rows


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
