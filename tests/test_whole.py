"""Queries that take all rows and whole texts, where a cut would show."""

from __future__ import annotations

import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelake.operators import reconcile as R
from tracelake.plans import catalog, ledger_queries


def test_whole_texts(spark, tmp_path):
    rows = [(1, "word " * 100 + "first end", "en", "web"), (1, "word " * 100 + "second end", "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = catalog.QUERIES["observation_fingerprint"](spark, str(tmp_path)).collect()
    assert len({r["fingerprint"] for r in prints}) == 2
    mails = catalog.QUERIES["mail_text"](spark, str(tmp_path)).collect()
    assert {r["mail"][r["body_start"]:] for r in mails} == {t for _, t, _, _ in rows}


def test_whole_review_queue(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["review_queue_order"](spark, sf).orderBy("place").collect()
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert n > 2200 and [r["place"] for r in got] == list(range(1, n + 1))


def test_whole_key_ranges(spark):
    sf = "/root/testdata/sf0.001"
    rows = {n: catalog.QUERIES[n](spark, sf).collect() for n in ("distinct_links", "bulk_supersede", "commitments_by_owner", "owner_resolution", "claim_item_match")}
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("events", "orders", "part", "customer")}
    assert {r["user_id"] for r in rows["distinct_links"]} == {r["user_id"] for r in t["events"].select("user_id").collect()}
    orders = {r["o_orderkey"] for r in t["orders"].collect()}
    assert {r["o_orderkey"] for r in rows["bulk_supersede"]} == {r["mention_id"] for r in rows["owner_resolution"]} == orders
    assert len(rows["commitments_by_owner"]) == t["orders"].where("o_orderstatus = 'O'").join(t["customer"], t["orders"]["o_custkey"] == t["customer"]["c_custkey"]).count()
    owners = [r["owner"] for r in rows["commitments_by_owner"]]
    assert owners == sorted(owners, key=lambda o: (o == "Unassigned", o))
    assert all(r["outcome"] != "unknown" for r in rows["owner_resolution"] if r["mention_id"] % 3 == 1)
    assert {r["claim_id"] for r in rows["claim_item_match"]} == {r["p_partkey"] for r in t["part"].where("p_partkey % 4 = 0").collect()}


def test_whole_meetings(spark):
    sf = "/root/testdata/sf0.001"
    there = {r["event_id"] for r in spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'").collect()}
    for name in ("meeting_cutoffs", "meetings_newest_first", "meeting_prep_sections"):
        assert {r["meeting_id"] for r in catalog.QUERIES[name](spark, sf).collect()} == there


def test_html_with_cut_entities(spark, tmp_path):
    """Titles are cut in the midst of entities, from about one page in 300 on."""
    rows = [(1, "<title>a &amp; b &amp</title><p>c</p>"), (2, "<p>x &quot</p>&ltp; &ampq; &copy2; &nosuch; &#65; &amp;lt;"), (3, "&lt;&gt"), (4, "<p>&amp;</p>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in catalog.QUERIES["html_to_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "a & b &amp\nc", 2: "x &quot\n&ltp; &ampq; &copy2; &nosuch; A &lt;", 3: "<&gt", 4: "&"}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet' WHERE page_id <> 2")
        assert dict(con.execute(catalog.ORACLES["html_to_text"]).fetchall()) == {k: t for k, t in got.items() if k != 2}


def test_blocks_of_a_long_text(spark, tmp_path):
    """Time grows with a text's length, not with its square: this took minutes when each block counted the whole text."""
    rows = [(0, ""), (1, "x" * 9), (2, "é" * 10), (70, "x" * 2_000_000), (71, "x" * 25), (5, "x" * 399)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    got = {r["doc_id"]: r["n"] for r in catalog.QUERIES["visible_blocks"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 60
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == dict(con.execute(catalog.ORACLES["visible_blocks"]).fetchall()) == {0: 0, 1: 0, 2: 0, 70: 40, 71: 1, 5: 38}


def _copied_parts(spark, tmp_path, n: int):
    p = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(60).localCheckpoint()
    copies = p.crossJoin(spark.range(n)).withColumn("p_partkey", p["p_partkey"] + F.col("id") * 200).drop("id")
    copies.withColumn("p_brand", F.concat(F.lit("b"), F.col("p_partkey") % 2)).withColumn("p_size", F.lit(1)).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    return con


def _as_by_sql(spark, tmp_path, con, name):
    frame = catalog.QUERIES[name](spark, str(tmp_path))
    columns = sorted(frame.columns)
    plain = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    got = Counter(plain(r) for r in frame.select(*columns).collect())
    assert got and got == Counter(map(plain, con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()))


def test_pairs_of_parts_with_copies(spark, tmp_path, monkeypatch):
    """Copies make several units of three; each unit is compared once."""
    monkeypatch.setattr(R, "UNIT", 3)
    _as_by_sql(spark, tmp_path, _copied_parts(spark, tmp_path, 8), "jaccard_pairs")


def test_pairs_of_parts_of_all_sizes(spark, tmp_path, monkeypatch):
    """Only parts of one size were paired, by the SQL too. With repeated and empty words, nulls and a key of two parts."""
    monkeypatch.setattr(R, "UNIT", 2)
    names = ("red pump", "pump blue", "red red", "", "a  b", None, "red pump", "green")
    rows = [(k, names[k % 8], (f"b{k % 2}", "b0", None)[k % 3], (k % 5, None)[k % 7 == 0]) for k in range(48)] + [(3, "red pump", "b0", 9), (3, "green", "b0", 9), (None, "red pump", "b0", 9)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want, there = Counter(), [(k, n.split(" "), brand) for k, n, brand, _ in rows if None not in (k, n, brand)]
    for a, x, of_a in there:
        for b, y, of_b in there:
            if a < b and of_a == of_b and (common := len({*x} & {*y})):
                want[a, b, round(common / (len(x) + len(y) - common), 6)] += 1
    assert want == Counter(tuple(r) for r in catalog.QUERIES["jaccard_pairs"](spark, str(tmp_path)).select("a", "b", "similarity").collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        _as_by_sql(spark, tmp_path, con, "jaccard_pairs")


def test_pairs_meet_on_words(spark, monkeypatch):
    """All texts of a group were compared with each other; now only those that share a word, each pair of them once."""
    rows = spark.range(3000).selectExpr("id", "'g' AS g", "array('x' || id % 1500, 'y' || id % 1500, 'z' || id) AS words")
    compared = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (compared.add(1), x)[1], "double").asNondeterministic()
    jaccard = R.T.jaccard
    monkeypatch.setattr(R.T, "jaccard", lambda a, b: count(jaccard(a, b)))
    found = R.similar_pairs(rows, "id", ["g"], "words", 6).collect()
    assert sorted(map(tuple, found)) == [(k, k + 1500, 0.5) for k in range(1500)] and compared.value == 3000 + 1500


@pytest.mark.parametrize("name", ["candidate_tiers", "match_features_score", "match_outcome"])
def test_candidates_of_parts_with_copies(spark, tmp_path, monkeypatch, name):
    """More copies of a text than a phrase search or recency takes, in several units."""
    monkeypatch.setattr(R, "UNIT", 3)
    _as_by_sql(spark, tmp_path, _copied_parts(spark, tmp_path, 25), name)


def test_alike_parts_are_paired_once(spark, tmp_path):
    _copied_parts(spark, tmp_path, 25)
    pairs, s_units, i_units = R.units(*ledger_queries._parts(spark, str(tmp_path)))
    n, n_items = pairs.count(), i_units.agg(F.sum(F.size("item_ids"))).first()[0]
    assert n_items == 48 * 25 and s_units.agg(F.sum(F.size("statement_ids"))).first()[0] == 12 * 25
    assert 4 * n < catalog.QUERIES["candidate_tiers"](spark, str(tmp_path)).count()


@pytest.mark.parametrize("name", ["match_features_score", "match_outcome"])
def test_rows_are_prepared_once(spark, tmp_path, name):
    """Each branch prepared all parts anew, and the driver planned all of it at once."""
    _copied_parts(spark, tmp_path, 25)
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/part.parquet" not in plan and "tracelake/units-" in plan and plan.count("Exchange") < 40


def test_what_words_find_needs_no_units_of_its_own(spark, tmp_path):
    """A text's first ten rows were units of their own, as many scores as rows; now only recent rows and other hits are."""
    _copied_parts(spark, tmp_path, 25)
    asked, there = ledger_queries._parts(spark, str(tmp_path))
    texts = there.groupBy("scope", "kind", "title").count().count()
    i_units = R.units(asked, there, tiered=False)[2]
    assert i_units.agg(F.sum(F.size("item_ids"))).first()[0] == 48 * 25 and i_units.count() <= 2 * texts


def test_outcomes_prepare_each_text_once(spark, tmp_path, monkeypatch):
    """All rows were prepared and compared as arrays of words before those that are alike were brought together."""
    _copied_parts(spark, tmp_path, 25)
    asked, there = ledger_queries._parts(spark, str(tmp_path))
    texts = asked.groupBy("scope", "kind", "subject").count().count() + there.groupBy("scope", "kind", "title").count().count()
    recent = 5 * there.select("scope", "kind").distinct().count()
    rows, prepared = [], R.prepared
    monkeypatch.setattr(R, "prepared", lambda table, *a: (rows.append(table.count()), prepared(table, *a))[1])
    assert catalog.QUERIES["match_outcome"](spark, str(tmp_path)).count() == 12 * 25
    assert rows and sum(rows) <= texts + recent < 60 * 25 / 2


def test_outcomes_with_what_only_a_search_finds(spark, monkeypatch):
    """Long descriptions with the statement's words in a row share too few of them; more rows of a text than a search takes, some null."""
    monkeypatch.setattr(R, "UNIT", 3)
    far = "alpha beta gamma delta " + " ".join(f"w{n}" for n in range(40))
    items = [(i, f"s{i % 2}", "risk" if i % 5 else "blocker", ("plan", "other plan", None)[i % 3], (f"{far} red pump leaks", "red pump leaks", None, far)[i % 4], 1000 - i, i % 4 or None, i % 7 or None, i % 6 == 0, i % 7 == 0) for i in range(120)]
    asked = [(s, f"s{s % 2}", ("risk", "update", "blocker")[s % 3], ("red pump", "gamma", "delta w0 w1 w2 w3 w4", "PLAN", None)[s % 5], ("leaks", "", None)[s // 5 % 3], s % 2 == 0 or None, s % 4 or None, s % 3 or None) for s in range(40)]
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c)).alias(c)
    i = spark.createDataFrame(items, "item_id long, scope string, kind string, title string, description string, at int, item_owner int, item_due int, done boolean, user_corrected boolean")
    i = i.select("item_id", "scope", "kind", "title", "description", F.timestamp_seconds(F.col("at") * 1000).alias("updated_at"), "item_owner", day("item_due"), F.when(F.col("done"), "completed").otherwise("open").alias("item_status"), F.lit("2023-10-01").cast("date").alias("item_updated"), "user_corrected")
    s = spark.createDataFrame(asked, "statement_id long, scope string, kind string, subject string, statement string, refers boolean, person_id int, date_value int").withColumn("date_value", day("date_value"))
    today = F.lit("2024-01-01").cast("date")
    ps, pi = R.prepared(s, "subject", "statement"), R.prepared(i, "title", "description")
    known = pi.select("item_id", F.col("words").alias("item_words"), F.col("names").alias("item_names"), "item_owner", "item_due", "item_status", "item_updated", "user_corrected")
    pairs = R.candidates(ps, pi).join(ps.drop("scope", "kind"), "statement_id").join(known, "item_id").withColumn("today", today)
    scores = R.scored(pairs).select("statement_id", "item_id", F.round("score", 9).alias("score"), "tiers")
    assert scores.where("tiers = array('search')").count() > 20
    plain = lambda rows: sorted((r["statement_id"], r["item_id"], r["score"], r["margin"] and round(r["margin"], 6), r["match_tier"]) for r in rows.collect())
    found, only = [], R._only_searched
    monkeypatch.setattr(R, "_only_searched", lambda *a: (found.append(only(*a)), found[-1])[1])
    got = plain(R.best_candidates(s, i, today, 9))
    assert got == plain(R.outcomes(scores)) and found[0].count() > 0
