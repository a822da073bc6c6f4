"""Queries of the relational core, sorts and set operations, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import values as D
from tracelake.operators import ledger as L
from tracelake.operators import relational as R
from tracelake.plans.roles import ITEMS, TRANSITIONS, items, table, transitions
from tracelake.streaming import sync as Z

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {ITEMS} SELECT item_id, kind, status, owner FROM items WHERE scope = 3 AND kind = 'risk' AND status IN ('open', 'active')")
def scope_filter_list(spark: SparkSession, sf: str) -> DataFrame:
    return R.scoped(items(spark, sf), "scope", 3, (F.col("updated_at").desc(), F.col("item_id")), kind="risk", status=["open", "active"]).select("item_id", "kind", "status", "owner")


@query("SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 15")
def topn_recent_versions(spark, sf):
    return R.top_recent(table(spark, sf, "orders"), "o_orderdate", 15, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id LIMIT 200")
def versions_since_cutoff(spark, sf):
    since = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return R.top_recent(table(spark, sf, "events"), "ts", 200, ["event_id"], since).select("event_id", "user_id", "event_type")


@query("""SELECT user_id, event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 AND event_type = 'error'""")
def latest_failed_per_key(spark, sf):
    return R.latest_failures(table(spark, sf, "events"), ["user_id"], "ts", F.col("event_type") == "error").select("user_id", "event_id")


@query("SELECT sha256(text) AS sha256 FROM documents WHERE source = 'src3' EXCEPT SELECT sha256(text) FROM documents WHERE source <> 'src3'")
def orphan_hash_except(spark, sf):
    hashed = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("sha256"))
    return R.only_in(hashed, F.col("source") == "src3", "sha256")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_scope(spark, sf):
    wanted = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(wanted, "l_orderkey", "left_semi").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS fingerprint FROM documents), n AS (SELECT min(doc_id) AS doc_id, fingerprint FROM d WHERE doc_id % 3 <> 0 GROUP BY fingerprint)
SELECT doc_id, fingerprint FROM n WHERE fingerprint NOT IN (SELECT fingerprint FROM d WHERE doc_id % 3 = 0)""")
def insert_if_absent(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return R.insert_if_absent(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0"), ["fingerprint"], ["doc_id"])


@query("""SELECT 'customer' AS name, c_nationkey AS scope, count(*) AS n FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey
UNION ALL SELECT 'orders', c_nationkey, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def deletion_preview_counts(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "scope")
    s = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "scope")
    o = table(spark, sf, "orders").join(c.select("c_custkey", "scope"), F.col("o_custkey") == F.col("c_custkey"))
    return R.counts_by({"customer": c, "supplier": s, "orders": o}, "scope")


@query("SELECT user_id, max(event_id) + 1 AS next_no, 'v' || (count(*) + 1) AS next_key FROM events GROUP BY user_id")
def next_version_no(spark, sf):
    return R.next_number(table(spark, sf, "events"), ["user_id"], "event_id")


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey END AS k FROM supplier), n AS (SELECT n_name, CASE WHEN n_nationkey <> 4 THEN n_nationkey END AS k FROM nation)
SELECT s_suppkey, n_name FROM s JOIN n ON s.k IS NOT DISTINCT FROM n.k""")
def nullsafe_lookup(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey")).alias("k"))
    n = table(spark, sf, "nation").select("n_name", F.when(F.col("n_nationkey") != 4, F.col("n_nationkey")).alias("nk"))
    return s.join(n, F.col("k").eqNullSafe(F.col("nk"))).select("s_suppkey", "n_name")


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_links(spark, sf):
    return table(spark, sf, "events").select("event_type", "user_id").distinct()


@query("SELECT s_suppkey FROM supplier WHERE lower(trim(s_name)) = 'supplier#000000007'")
def expression_key_lookup(spark, sf):
    return table(spark, sf, "supplier").where(F.lower(F.trim("s_name")) == "supplier#000000007").select("s_suppkey")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'RETAIL' END AS seg, CASE WHEN c_custkey % 6 = 0 THEN 1 END AS nat FROM customer WHERE c_custkey % 2 = 0)
SELECT customer.c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, CAST(coalesce(nat, c_nationkey) AS INT) AS c_nationkey FROM customer LEFT JOIN c USING (c_custkey)""")
def conditional_update(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    key = F.col("c_custkey")
    changes = t.where(key % 2 == 0).select(key, F.when(key % 4 == 0, "RETAIL").alias("c_mktsegment"), F.when(key % 6 == 0, F.lit(1)).alias("c_nationkey"))
    return R.coalesced_update(t, changes, ["c_custkey"])


@query("""WITH ch AS (SELECT c_custkey, 'RETAIL' AS seg, CAST(NULL AS INT) AS nat FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey + 10000000, NULL, CAST(c_custkey % 25 AS INT) FROM customer WHERE c_custkey % 10 = 0)
SELECT coalesce(customer.c_custkey, ch.c_custkey) AS c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, CAST(coalesce(nat, c_nationkey) AS INT) AS c_nationkey FROM customer FULL JOIN ch ON customer.c_custkey = ch.c_custkey""")
def coalesced_upsert(spark, sf):
    """Some rows change, new ones come; a null in a change leaves what is there."""
    t, key = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("c_custkey")
    none = F.lit(None)
    changed = t.where(key % 4 == 0).select("c_custkey", F.lit("RETAIL").alias("c_mktsegment"), none.cast("int").alias("c_nationkey"))
    new = t.where(key % 10 == 0).select((key + 10000000).alias("c_custkey"), none.cast("string").alias("c_mktsegment"), (key % 25).cast("int").alias("c_nationkey"))
    return R.coalesced_update(t, changed.union(new), ["c_custkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey <> 101 AND o_custkey < 50 THEN 'superseded' WHEN o_orderstatus = 'O' THEN 'valid' ELSE o_orderstatus END AS status FROM orders")
def bulk_supersede(spark, sf):
    return _superseded(table(spark, sf, "orders"))


def _superseded(orders: DataFrame) -> DataFrame:
    t = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", "valid").otherwise(F.col("o_orderstatus")).alias("status"))
    return R.marked_superseded(t, F.col("o_custkey") < 50, F.col("o_orderkey") == 101).select("o_orderkey", "status")


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, 'discount' AS "check" FROM lineitem WHERE NOT l_discount <= 0.09
UNION ALL SELECT l_orderkey, l_linenumber, 'quantity' FROM lineitem WHERE NOT l_quantity < 50""")
def check_violations(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("line", F.col("l_linenumber").cast("long"))
    return R.broken_checks(t, {"discount": F.col("l_discount") <= 0.09, "quantity": F.col("l_quantity") < 50}, ["l_orderkey", "line"])


@query("SELECT p_name, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_name HAVING count(*) > 1")
def partial_unique_violations(spark, sf):
    return R.repeated_keys(table(spark, sf, "part"), ["p_name"], F.col("p_size") > 25)


@query("SELECT DISTINCT e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = e.user_id)")
def foreign_key_orphans(spark, sf):
    return R.orphans(table(spark, sf, "events"), table(spark, sf, "supplier"), {"user_id": "s_suppkey"}).select("user_id").distinct()


@query(f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY due ASC NULLS LAST, title) AS rank FROM items WHERE status IN ('open', 'active')) SELECT scope, item_id, rank FROM r WHERE rank <= 5")
def due_order_items(spark, sf):
    live = items(spark, sf).where(F.col("status").isin("open", "active"))
    return R.ranked(live, ["scope"], R.due_order("due", "title"), 5).select("scope", "item_id", "rank")


@query(f"""WITH {ITEMS} SELECT coalesce(CAST(owner AS VARCHAR), 'Unassigned') AS owner, item_id FROM items WHERE status = 'open'""")
def commitments_by_owner(spark, sf):
    open_ones = items(spark, sf).where("status = 'open'").withColumn("owner", F.col("owner").cast("string"))
    return R.by_owner(open_ones, "owner", ["item_id"])


#: Events as proposals of every action there is.
_ACTIONS = ("CONFLICT", "SUPERSEDE", "CANCEL", "UPDATE", "COMPLETE", "CREATE", "ADD_EVIDENCE", "NO_OP", "UNHEARD_OF")
_QUEUE = f"""p AS (SELECT event_id, user_id, ts, ['{"', '".join(_ACTIONS)}'][1 + event_id * 7 % 9] AS action FROM events),
q AS (SELECT *, CASE WHEN action = 'CONFLICT' THEN 0 WHEN action IN ('SUPERSEDE', 'CANCEL', 'UPDATE') THEN 1 WHEN action = 'COMPLETE' THEN 2 WHEN action = 'CREATE' THEN 3 WHEN action = 'ADD_EVIDENCE' THEN 4 WHEN action = 'NO_OP' THEN 5 ELSE 9 END AS priority FROM p),
placed AS (SELECT *, row_number() OVER (ORDER BY priority, ts, event_id) AS place FROM q)"""


def _review_queue(spark: SparkSession, sf: str) -> DataFrame:
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("event_id") * 7 % 9 + 1).cast("int"))
    queue = table(spark, sf, "events").select("event_id", "user_id", "ts", action.alias("action")).withColumn("hour", F.date_trunc("hour", "ts"))
    first = F.coalesce(*(F.when(F.col("action") == a, F.lit(n)) for a, n in R.REVIEW_PRIORITY.items()), F.lit(9))
    return R.placed(queue, [first, F.col("hour")], [*R.review_order("action", "ts"), F.col("event_id")])


@query(f"WITH {_QUEUE} SELECT event_id, action, place FROM placed")
def review_queue_order(spark, sf):
    return _review_queue(spark, sf).select("event_id", "action", "place")


@query(f"WITH {_QUEUE} SELECT CASE WHEN user_id % 10 = 0 THEN 'Unknown source' ELSE 'source ' || user_id % 60 END AS title, min(place) AS first_place, count(*) AS n FROM placed GROUP BY 1")
def queue_by_source(spark, sf):
    title = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("source "), (F.col("user_id") % 60).cast("string")))
    return R.grouped_first_seen(_review_queue(spark, sf), F.coalesce(title, F.lit("Unknown source")), "place")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_reviews(spark, sf):
    """The ten latest (a top-k report)."""
    e = table(spark, sf, "events")
    return R.top_recent(e, "ts", 10, [F.col("event_id").desc()]).select("event_id", "user_id")


@query("""WITH d AS (SELECT sha256(text) AS sha256, doc_id FROM documents) SELECT sha256, CASE WHEN bool_or(doc_id % 5 <> 0 AND doc_id % 7 <> 0) THEN 'ok' WHEN bool_or(doc_id % 5 <> 0) THEN 'corrupt' ELSE 'missing' END AS state FROM d GROUP BY sha256""")
def object_verification(spark, sf):
    """All texts are listed; those of every fifth document are not stored, of every seventh stored as other bytes."""
    d, k = table(spark, sf, "documents").withColumn("sha256", F.sha2("text", 256)), F.col("doc_id")
    stored = d.where(k % 5 != 0).select("sha256", F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return R.verified_objects(d.select("sha256"), stored)


@query("""WITH t AS (SELECT 'orders' AS name, c_nationkey AS scope, o_orderpriority AS h FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'suppliers', s_nationkey, 'h' || s_suppkey % 40 FROM supplier),
o AS (SELECT h, min(scope) AS scope FROM t WHERE name = 'suppliers' GROUP BY h HAVING min(scope) = max(scope))
SELECT name, scope, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'orphans of suppliers', scope, count(*) FROM o GROUP BY scope""")
def deletion_counts(spark, sf):
    """What deleting a scope takes, and the objects that only it has."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("scope"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("scope"), F.concat(F.lit("h"), (F.col("s_suppkey") % 40).cast("string")).alias("h"))
    return R.scope_counts({"orders": o, "suppliers": s}, "scope", {"suppliers": "h"})


@query("""WITH c AS (SELECT l_orderkey AS item, l_linenumber * 100000000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag, l_quantity, l_extendedprice) AS k, CASE WHEN l_linenumber > 1 THEN l_returnflag END AS status, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS owner, CAST(l_partkey AS VARCHAR) AS text FROM lineitem)
SELECT item, (arg_min(status, k) FILTER (status IS NOT NULL)) AS status, (arg_min(owner, k) FILTER (owner IS NOT NULL)) AS owner, count(DISTINCT text) AS n_evidence FROM c GROUP BY item""")
def claim_merge(spark, sf):
    """Lines of orders as claims; several of one number go by their other columns."""
    n = F.col("l_linenumber")
    ties = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    claims = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item"), (n.cast("long") * 100000000 + F.row_number().over(ties)).alias("k"), F.when(n > 1, F.col("l_returnflag")).alias("status"), F.when(n % 2 == 0, F.col("l_suppkey").cast("string")).alias("owner"),
        F.lit(None).cast("date").alias("due"), F.col("l_partkey").cast("string").alias("text"), F.array(F.col("l_partkey").cast("string")).alias("evidence"),
    )
    return R.merged_claims(claims, "item", "k").select("item", "status", "owner", F.size("evidence").cast("long").alias("n_evidence"))


@query("SELECT l_returnflag, round(median(l_quantity), 6) AS median_quantity FROM lineitem GROUP BY l_returnflag")
def median_saved(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.median("l_quantity"), 6).alias("median_quantity"))


@query("SELECT event_type, count(*) AS n, max(ts) IS NOT NULL AS seen FROM events GROUP BY event_type")
def counts_by_action(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").isNotNull().alias("seen"))


@query("""SELECT o_custkey, count(l_orderkey) AS n_links FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def evidence_counts(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("l_orderkey").alias("n_links"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, round(value / 3, 6) AS third FROM events")
def props_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.round(F.col("value") / 3, 6).alias("third"))


# --- versions and states ---------------------------------------------------------------------------------------


@query(f"""WITH {TRANSITIONS}
SELECT event_id, item_id, row_number() OVER w AS version_no, strftime(lead("at") OVER w, '%Y-%m-%d %H:%M:%S') AS valid_to,
  last_value(status IGNORE NULLS) OVER f AS status, last_value(owner IGNORE NULLS) OVER f AS owner, CAST(last_value(due IGNORE NULLS) OVER f AS VARCHAR) AS due
FROM transitions WINDOW w AS (PARTITION BY item_id ORDER BY "at", event_id), f AS (PARTITION BY item_id ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def scd2_intervals(spark, sf):
    v = L.intervals(transitions(spark, sf), "item_id", "at", "event_id", ["status", "owner", "due"])
    return v.select("event_id", "item_id", "version_no", F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss").alias("valid_to"), "status", "owner", F.col("due").cast("string").alias("due"))


@query(f"""WITH {TRANSITIONS}
SELECT item_id, arg_max(status, "at") FILTER (status IS NOT NULL) AS status, arg_max(owner, "at") FILTER (owner IS NOT NULL) AS owner, CAST(arg_max(due, "at") FILTER (due IS NOT NULL) AS VARCHAR) AS due, count(*) AS versions
FROM transitions GROUP BY item_id""")
def current_projection(spark, sf):
    return L.current(transitions(spark, sf), "item_id", "at", "event_id", ["status", "owner", "due"]).select("item_id", "status", "owner", F.col("due").cast("string").alias("due"), "versions")


@query(f"""WITH {TRANSITIONS}
SELECT item_id, arg_max(status, "at") FILTER (status IS NOT NULL) AS status, arg_max(owner, "at") FILTER (owner IS NOT NULL) AS owner
FROM transitions WHERE "at" < TIMESTAMP '2024-01-15 00:00:00' GROUP BY item_id""")
def asof_state_fold(spark, sf):
    cutoff = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return L.state_as_of(transitions(spark, sf), "item_id", "at", "event_id", ["status", "owner"], cutoff).select("item_id", "status", "owner")


@query(f"""WITH {TRANSITIONS}, v AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY "at", event_id) AS version_no, event_type, event_id % 3 AS part FROM transitions),
p AS (SELECT *, lag(event_type) OVER (PARTITION BY item_id ORDER BY version_no) AS t0, lag(part) OVER (PARTITION BY item_id ORDER BY version_no) AS p0 FROM v)
SELECT item_id, version_no, concat_ws('; ', CASE WHEN t0 <> event_type THEN 'was ' || t0 END, CASE WHEN p0 <> part THEN 'was part ' || p0 END) AS previous FROM p WHERE version_no > 1""")
def version_diff_summary(spark, sf):
    v = L.intervals(transitions(spark, sf).withColumn("part", F.col("event_id") % 3), "item_id", "at", "event_id", [])
    return L.changes(v, "item_id", {"event_type": "", "part": "part "})


@query(f"""WITH {TRANSITIONS}, v AS (SELECT event_id, lag(event_type) OVER (PARTITION BY item_id ORDER BY "at", event_id) AS before, event_type FROM transitions),
m AS (SELECT event_id, 'commitment' AS kind, CASE event_type WHEN 'view' THEN 'update' WHEN 'click' THEN 'complete' WHEN 'purchase' THEN 'reopen' WHEN 'error' THEN 'cancel' ELSE 'create' END AS transition,
  CASE before WHEN 'view' THEN 'open' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'open' WHEN 'error' THEN 'canceled' WHEN 'signup' THEN 'open' END AS from_status,
  CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'open' WHEN 'error' THEN 'canceled' ELSE 'open' END AS to_status FROM v)
SELECT event_id, transition, from_status FROM m WHERE NOT (
  (transition = 'create' AND from_status IS NULL) OR (transition IN ('update', 'complete', 'cancel') AND coalesce(from_status IN ('open', 'active'), false)) OR (transition = 'reopen' AND coalesce(from_status IN ('completed', 'canceled'), false)))""")
def transition_violations(spark, sf):
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("item_id").orderBy("at", "event_id"))
    status = lambda c: F.when(c.isin("view", "purchase", "signup"), "open").when(c == "click", "completed").when(c == "error", "canceled")
    kind = F.col("event_type")
    name = F.when(kind == "view", "update").when(kind == "click", "complete").when(kind == "purchase", "reopen").when(kind == "error", "cancel").otherwise("create")
    t = transitions(spark, sf).withColumn("before", before).select("event_id", F.lit("commitment").alias("kind"), name.alias("transition"), status(F.col("before")).alias("from_status"), status(kind).alias("to_status"))
    return L.illegal(t).select("event_id", "transition", "from_status")


@query(f"""WITH {TRANSITIONS}
SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY item_id ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_meeting FROM transitions""")
def previous_meeting_asof(spark, sf):
    t = L.previous_event(transitions(spark, sf), "item_id", "at", "event_id", F.col("event_type") == "purchase")
    return t.select("event_id", F.col("previous")["event_id"].alias("previous_meeting"))


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS s0, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS s1, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS c0, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS c1 FROM orders)
SELECT o_orderkey, 'status' AS field, s0 AS original, s1 AS corrected, 'item:status:typo' AS signature FROM a WHERE s0 <> s1
UNION ALL SELECT o_orderkey, 'owner', CAST(c0 AS VARCHAR), CAST(c1 AS VARCHAR), 'item:owner:typo' FROM a WHERE c0 <> c1""")
def correction_diff(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    a = o.select(k, F.col("o_orderstatus").alias("status"), F.when(k % 4 != 0, F.col("o_custkey")).alias("owner"))
    b = o.select(k, F.when(k % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("owner"))
    return L.corrections(a, b, "o_orderkey", ["status", "owner"], F.lit("typo"), "item")


@query("""WITH c AS (SELECT p_partkey AS item_id, ['commitment', 'decision', 'milestone', 'risk', 'blocker', 'open_question', 'stakeholder'][1 + p_partkey % 7] AS kind FROM part)
SELECT item_id, kind, CASE WHEN kind IN ('decision', 'stakeholder') THEN 'active' ELSE 'open' END AS status, item_id || ':1' AS version_id, 1 AS version_no, 'create' AS transition FROM c""")
def created_items(spark, sf):
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("commitment", "decision", "milestone", "risk", "blocker", "open_question", "stakeholder")))
    made, versions = L.created_items(table(spark, sf, "part").select(k.alias("item_id"), F.element_at(kinds, (k % 7 + 1).cast("int")).alias("kind")))
    return made.join(versions.select("item_id", "version_id", "version_no", "transition"), "item_id").where("current_version_id = version_id").select("item_id", "kind", "status", "version_id", "version_no", "transition")


@query("""WITH r AS (SELECT event_id AS k, ['accept', 'edit_accept', 'mark_complete', 'mark_superseded', 'treat_as_new', 'reject'][1 + event_id % 6] AS verb, event_id % 11 = 0 AS done, ['CREATE', 'UPDATE', 'CONFLICT', 'COMPLETE'][1 + event_id // 6 % 4] AS action FROM events),
o AS (SELECT *, CASE WHEN done THEN 'repeated' WHEN verb = 'reject' THEN 'rejected' WHEN verb = 'accept' AND action = 'CONFLICT' THEN 'not_applicable' ELSE 'applied' END AS outcome FROM r)
SELECT k AS proposal_id, verb, outcome, CASE WHEN outcome = 'applied' THEN CASE verb WHEN 'accept' THEN action WHEN 'mark_complete' THEN 'COMPLETE' WHEN 'mark_superseded' THEN 'SUPERSEDE' WHEN 'treat_as_new' THEN 'CREATE' ELSE CASE WHEN k % 5 = 0 THEN 'ADD_EVIDENCE' ELSE action END END END AS action,
  CASE WHEN outcome = 'applied' AND verb <> 'treat_as_new' AND NOT (action = 'CREATE' AND verb IN ('accept', 'edit_accept') AND (verb = 'accept' OR k % 5 <> 0)) THEN CASE WHEN verb = 'edit_accept' AND k % 4 = 1 THEN k + 1 ELSE k END END AS target_id,
  CASE WHEN outcome = 'applied' THEN CASE WHEN verb IN ('edit_accept', 'treat_as_new') AND k % 3 = 1 THEN 'edited' ELSE 'proposed' END END AS title FROM o""")
def review_actions(spark, sf):
    k, e = F.col("event_id"), table(spark, sf, "events")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    action = F.element_at(F.array(*map(F.lit, ("CREATE", "UPDATE", "CONFLICT", "COMPLETE"))), (F.floor(k / 6) % 4 + 1).cast("int"))
    verb = F.element_at(F.array(*map(F.lit, ("accept", "edit_accept", "mark_complete", "mark_superseded", "treat_as_new", "reject"))), (k % 6 + 1).cast("int"))
    proposals = e.select(k.alias("proposal_id"), F.when(k % 11 == 0, "accepted").otherwise("pending").alias("status"), action.alias("action"), k.alias("target_id"), F.lit("proposed").alias("patch_title"), *none("patch_kind", "patch_owner", "patch_due"))
    requests = e.select(k.alias("proposal_id"), verb.alias("verb"), F.when(k % 5 == 0, "ADD_EVIDENCE").alias("edit_action"), F.when(k % 4 == 1, k + 1).alias("edit_target_id"), F.when(k % 3 == 1, "edited").alias("edit_title"), *none("edit_status", "edit_kind", "edit_owner", "edit_due"))
    return L.review_actions(proposals, requests).select("proposal_id", "verb", "outcome", "action", "target_id", "title")


# --- sync ------------------------------------------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 48 HOURS")
def watermark_overlap(spark, sf):
    return Z.since_overlap(table(spark, sf, "events"), "ts", F.lit("2024-01-25 00:00:00")).select("event_id")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-29 00:00:00')")
def vanished_items(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    known = e.select("user_id").distinct().withColumn("availability", F.lit("available"))
    return Z.vanished(known, e.where(F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")), "user_id").select("user_id")


@query("""WITH r AS (SELECT CAST(hour AS VARCHAR) AS run, count(*) AS discovered, count(*) FILTER (event_type = 'error') AS failed FROM (SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type FROM events) GROUP BY hour)
SELECT run, discovered, failed, CASE WHEN failed = 0 THEN 'completed' WHEN failed >= discovered THEN 'failed' ELSE 'partial' END AS status FROM r""")
def run_status(spark, sf):
    e = table(spark, sf, "events").withColumn("run", F.date_format("ts", "yyyy-MM-dd HH"))
    return Z.run_status(e, "run", F.col("event_type") == "error", "ts").select("run", "discovered", F.col("failed").cast("long").alias("failed"), "status")


@query("SELECT DISTINCT event_id, user_id FROM events")
def idempotent_arrival(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return e.union(e.where("event_id % 20 = 0")).dropDuplicates(["event_id"])


@query("SELECT event_id, round(least(20.0, 0.5 * pow(2.0, event_id % 9)), 6) AS delay, CASE WHEN event_id % 600 IN (401, 403, 404) THEN 'fail' WHEN event_id % 600 IN (408, 429) OR event_id % 600 >= 500 THEN 'retry' WHEN event_id % 600 >= 400 THEN 'fail' ELSE 'ok' END AS fate FROM events")
def retry_plan(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.round(D.backoff(k % 9 + 1, 0.5, 20.0), 6).alias("delay"), D.retry_class(k % 600).alias("fate"))
