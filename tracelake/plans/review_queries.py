"""Queries of statement checks, review read models and previews, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions import values as D
from tracelake.operators import briefs as B
from tracelake.operators import chunking as C
from tracelake.operators import evaluate as E
from tracelake.operators import ledger as L
from tracelake.operators import review as W
from tracelake.plans.roles import table
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


@query("""WITH s AS (SELECT doc_id, text, CAST(doc_id % 20 AS INT) AS a, CAST(doc_id % 20 + 15 AS INT) AS b FROM documents),
q AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 'not there' ELSE substr(text, a + 1, 15) END AS quote FROM s)
SELECT doc_id AS observation_id, CASE WHEN doc_id % 9 = 0 THEN 'unknown_chunk' WHEN b > length(text) THEN 'out_of_bounds' WHEN trim(regexp_replace(quote, '\\s+', ' ', 'g')) = '' THEN 'empty_quote'
  WHEN trim(regexp_replace(substr(text, a + 1, 15), '\\s+', ' ', 'g')) <> trim(regexp_replace(quote, '\\s+', ' ', 'g')) THEN 'quote_mismatch' WHEN doc_id % 5 = 0 THEN 'unsupported_owner' WHEN doc_id % 7 = 0 THEN 'malformed_date' END AS fault FROM q""")
def observation_validation(spark: SparkSession, sf: str) -> DataFrame:
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    a = (k % 20).cast("int")
    quote = F.when(k % 6 == 0, "not there").otherwise(F.substring(F.col("text"), a + 1, F.lit(15)))
    spans = d.select(k.alias("observation_id"), F.lit(0).alias("ordinal"), F.when(k % 9 == 0, -1).otherwise(k).alias("chunk_id"), a.alias("start"), (a + 15).alias("end"), quote.alias("quote"))
    seen = d.select(k.alias("observation_id"), F.when(k % 5 == 0, "nobody at all").alias("owner_text"), F.when(k % 7 == 0, "1999-13-01").otherwise("2024-02-03").alias("date_value"))
    return W.validated(seen, spans, d.select(k.alias("chunk_id"), "text")).select("observation_id", "fault")


@query("""SELECT user_id, count(*) AS chunks, count(*) FILTER (event_type = 'click') AS refused, round(sum(event_id) / 1e6 * 2 + count(*) * 10 / 1e6 * 12, 6) AS usd,
  CASE WHEN count(*) FILTER (event_type = 'error' AND event_id % 50 = 0) > 0 THEN 'failed' WHEN count(*) = count(*) FILTER (event_type = 'click') THEN 'refused' ELSE 'completed' END AS status FROM events GROUP BY user_id""")
def extraction_runs(spark, sf):
    kind, k = F.col("event_type"), F.col("event_id")
    outcome = F.when(kind == "click", "refused").when((kind == "error") & (k % 50 == 0), "failed").otherwise("ok")
    rows = table(spark, sf, "events").select("user_id", outcome.alias("outcome"), k.alias("tokens_in"), F.lit(10).alias("tokens_out"))
    return W.extraction_runs(rows, "user_id").select("user_id", "chunks", "refused", F.round("usd", 6).alias("usd"), "status")


@query("SELECT event_id FROM events WHERE event_id % 4 <> 0")
def pending_statements(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("statement_id"))
    return W.pending(e, e.where("statement_id % 4 = 0")).withColumnRenamed("statement_id", "event_id")


@query("""WITH b AS (SELECT c_custkey AS k, CAST(to_json({'c_mktsegment': c_mktsegment, 'c_nationkey': c_nationkey}) AS VARCHAR) AS j FROM customer WHERE c_custkey % 10 <> 0),
a AS (SELECT c_custkey AS k, CAST(to_json({'c_mktsegment': CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END, 'c_nationkey': c_nationkey}) AS VARCHAR) AS j FROM customer WHERE c_custkey % 10 <> 1)
SELECT coalesce(b.k, a.k) AS c_custkey, CASE WHEN b.k IS NULL THEN 'create' WHEN a.k IS NULL THEN 'delete' ELSE 'update' END AS action, b.j AS before_json, a.j AS after_json FROM b FULL JOIN a ON a.k = b.k WHERE b.j IS DISTINCT FROM a.j""")
def audit_entries(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    after = c.where(k % 10 != 1).withColumn("c_mktsegment", F.when(k % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return W.audit_entries(c.where(k % 10 != 0), after, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("""WITH c AS (SELECT l_returnflag || ':' || l_linestatus || ':' || l_linenumber AS signature FROM lineitem) SELECT signature, count(*) AS n FROM c GROUP BY signature HAVING count(*) >= 2""")
def error_signatures(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat_ws(":", "l_returnflag", "l_linestatus", "l_linenumber").alias("signature"))
    return W.recurring(rows)


@query("""SELECT matched, nth, event_id FROM (SELECT event_type = 'purchase' AS matched, event_id, row_number() OVER (PARTITION BY event_type = 'purchase' ORDER BY ts, event_id) AS nth FROM events) WHERE nth <= 5""")
def rule_preview(spark, sf):
    e = table(spark, sf, "events").withColumn("matched", F.col("event_type") == "purchase")
    return W.preview(e, "matched", [F.col("ts"), F.col("event_id")]).select("matched", "nth", "event_id")


@query("""SELECT round(avg(CASE WHEN event_type IN ('view', 'click') THEN 1.0 ELSE 0.0 END), 6) AS acceptance, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS edit_free_acceptance FROM events""")
def acceptance_rates(spark, sf):
    action = F.when(F.col("event_type") == "view", "accept").when(F.col("event_type") == "click", "edit").otherwise("reject")
    r = W.accepted_share(table(spark, sf, "events").select(action.alias("action")))
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("""SELECT event_id, CASE event_id % 5
  WHEN 0 THEN '{"kind":"risk","canonical_title":"' || event_type || '","canonical_description":"d"' || CASE WHEN event_id % 2 = 0 THEN ',"owner_person_id":"p' || user_id || '"' ELSE '' END || ',"due_date_text":"soon"}'
  WHEN 1 THEN '{"kind":"risk","canonical_title":"' || event_type || '","canonical_description":"d"' || CASE WHEN event_id % 2 = 0 THEN ',"owner_person_id":"p' || user_id || '"' ELSE '' END || ',"due_date_text":"soon","supersedes_ledger_item_id":"i' || event_id || '"}'
  WHEN 2 THEN '{"status":"completed"}' WHEN 3 THEN '{"status":"canceled"}' ELSE '{}' END AS patch FROM events""")
def proposal_patches(spark, sf):
    k = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ("CREATE", "SUPERSEDE", "COMPLETE", "CANCEL", "CONFLICT"))), (k % 5 + 1).cast("int"))
    owner = F.when(k % 2 == 0, F.concat(F.lit("p"), F.col("user_id").cast("string")))
    patch = W.patch(action, F.lit("risk"), F.col("event_type"), F.lit("d"), owner, F.lit(None).cast("string"), F.lit("soon"), F.concat(F.lit("i"), k.cast("string")))
    return table(spark, sf, "events").select("event_id", patch.alias("patch"))


@query("""WITH p AS (SELECT event_id AS k, ['CONFLICT', 'CREATE', 'UPDATE'][1 + event_id % 3] AS action FROM events WHERE event_id % 4 <> 0)
SELECT k AS proposal_id, action, 'said ' || k AS statement, CASE WHEN k % 2 = 0 THEN 'order ' || k END AS target_title, CASE WHEN k % 5 = 0 THEN 2 WHEN k % 5 = 1 THEN 1 ELSE 0 END AS n_evidence FROM p""")
def review_cards(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    text = lambda word, x: F.concat(F.lit(word), x.cast("string"))
    proposals = e.select(k.alias("proposal_id"), k.alias("statement_id"), F.when(k % 4 == 0, "accepted").otherwise("pending").alias("status"), F.element_at(F.array(F.lit("CONFLICT"), F.lit("CREATE"), F.lit("UPDATE")), (k % 3 + 1).cast("int")).alias("action"), F.when(k % 2 == 0, k).alias("target_id"), F.col("ts").alias("created_at"))
    statements = e.select(k.alias("statement_id"), text("said ", k).alias("statement"))
    targets = e.select(k.alias("item_id"), text("order ", k).alias("title"), F.lit("open").alias("status"))
    links = e.where(k % 5 == 0).select(k.alias("statement_id"), k.alias("content_id"), F.lit("one").alias("quote")).union(e.where(k % 5 < 2).select(k, k, F.lit("two"))).union(e.where(k % 5 == 1).select(k, k, F.lit("two")))
    contents = e.select(k.alias("content_id"), F.col("event_type").alias("title"))
    out = W.cards(proposals, statements, targets, links, contents)
    return out.select("proposal_id", "action", "statement", "target_title", F.greatest(F.size("evidence"), F.lit(0)).cast("long").alias("n_evidence"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 9 = 0 AS done, o_orderkey % 4 = 0 AS no, o_orderkey % 5 = 0 AS moved, o_orderkey % 3 = 0 AS plain FROM orders)
SELECT k AS proposal_id, CASE WHEN done THEN 'repeated' WHEN no THEN 'rejected' WHEN moved THEN 'stale' WHEN plain THEN 'no_change' ELSE 'applied' END AS fate FROM r""")
def reviewed_proposals(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    proposals = o.select(k.alias("proposal_id"), k.alias("target_id"), F.when(k % 9 == 0, "accepted").otherwise("pending").alias("status"), F.lit(1).alias("expected_version"), F.when(k % 3 == 0, "NO_OP").otherwise("UPDATE").alias("proposed"))
    first = o.select(k.alias("review_id"), k.alias("proposal_id"), F.when(k % 4 == 0, "reject").otherwise("accept").alias("action"), F.lit(1).alias("at"))
    again = o.where(k % 6 == 0).select((k + 1).alias("review_id"), k.alias("proposal_id"), F.lit("reject").alias("action"), F.lit(2).alias("at"))
    things = o.select(k.alias("item_id"), F.when(k % 5 == 0, 2).otherwise(1).alias("current_version"))
    return L.reviewed(proposals, first.union(again), things).select("proposal_id", "fate")


@query("""SELECT s_suppkey AS item_id, CASE WHEN s_suppkey % 4 = 0 THEN 'superseded' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 1000000 END AS superseded_by, NULL AS supersedes FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT s_suppkey + 1000000, 'open', NULL, s_suppkey FROM supplier WHERE s_suppkey % 4 = 0""")
def superseding_items(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    old = s.select(k.alias("item_id"), F.lit("open").alias("status"))
    new = s.where(k % 4 == 0).select((k + 1000000).alias("item_id"), F.lit("open").alias("status"), k.alias("supersedes"))
    out = L.superseding_items(old, new)
    return out.select("item_id", "status", F.col("superseded_by").cast("long").alias("superseded_by"), F.col("supersedes").cast("long").alias("supersedes"))


@query("""SELECT doc_id, lang AS sender, CASE WHEN doc_id % 3 <> 0 THEN source END AS subject FROM documents""")
def header_values(spark, sf):
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    d = table(spark, sf, "documents")
    headers = F.when(F.col("doc_id") % 3 != 0, F.array(header("FROM", F.col("lang")), header("subject", F.col("source")), header("Subject", F.lit("second")))).otherwise(F.array(header("from", F.col("lang"))))
    return d.select("doc_id", T.header_value(headers, "From").alias("sender"), T.header_value(headers, "SUBJECT").alias("subject"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') || 'T00:00:00Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS start FROM events")
def event_starts(spark, sf):
    whole, day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf, "events").select("event_id", D.event_start(F.when(F.col("event_id") % 3 != 0, whole), day).alias("start"))


@query("""SELECT user_id, sum(CASE event_type WHEN 'view' THEN 8 WHEN 'click' THEN 25 ELSE 15 END) AS seconds, round(sum(CASE event_type WHEN 'view' THEN 8 WHEN 'click' THEN 25 ELSE 15 END) / count(*), 6) AS seconds_per_item FROM events GROUP BY user_id""")
def review_burden(spark, sf):
    action = F.when(F.col("event_type") == "view", "accept").when(F.col("event_type") == "click", "edit").otherwise("reject")
    out = E.review_burden(table(spark, sf, "events").select("user_id", action.alias("action")), ["user_id"])
    return out.select("user_id", F.round(F.col("minutes") * 60).cast("long").alias("seconds"), F.round("seconds_per_item", 6).alias("seconds_per_item"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def latest_attempts(spark, sf):
    return E.latest_attempt(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("SELECT doc_id, len(list_filter(range(0, len(text) // 10), lambda i : i * 10 >= doc_id % 70 AND i * 10 + 10 <= 400 + doc_id % 70)) AS n FROM documents")
def visible_blocks(spark, sf):
    """Blocks of ten characters that lie wholly in a window of 400."""
    k, n = F.col("doc_id") % 70, F.floor(F.length("text") / 10).cast("int")
    block = lambda i: F.struct((i * 10).alias("char_start"), (i * 10 + 10).alias("char_end"))
    # a text's length is counted once a row: within the lambda it would be once a block
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), block)).when(n == 0, F.array().cast("array<struct<char_start:int,char_end:int>>"))
    return table(spark, sf, "documents").select("doc_id", F.size(C.visible_blocks(blocks, k, k + 400)).cast("long").alias("n"))


@query("""WITH v AS (SELECT source AS artifact, sha256(text) AS sha256, min(doc_id) AS first_at, max(doc_id) AS last_at FROM documents GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY first_at, sha256) AS k FROM v)
SELECT artifact, count(*) AS versions, 'v' || arg_max(k, last_at) AS current_key FROM n GROUP BY artifact UNION ALL SELECT 'unread', 0, NULL""")
def evidence_list(spark, sf):
    d = table(spark, sf, "documents")
    artifacts = d.select(F.col("source").alias("artifact")).distinct().union(spark.createDataFrame([("unread",)], "artifact string"))
    return W.evidence_list(artifacts, C.content_versions(d, "source", "text", "doc_id")).select("artifact", "versions", "current_key")


@query("""WITH l AS (SELECT doc_id AS k, text, doc_id % 4 AS scope FROM documents)
SELECT k AS link_id, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'unknown_target' WHEN k % 7 = 0 THEN 'unknown_content' WHEN k % 5 = 0 THEN 'chunk_of_other_content' WHEN k % 3 = 0 THEN NULL WHEN length(text) < 9 THEN 'out_of_bounds' WHEN trim(substr(text, 1, 9)) = '' THEN 'empty_quote' WHEN k % 2 = 0 THEN 'quote_mismatch' END AS fault FROM l""")
def link_faults(spark, sf):
    """Links whose target, content, chunk or quote is wrong in turn; every third has no chunk."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    scope, none = (k % 4).alias("scope"), F.lit(None).cast("long")
    links = d.select(k.alias("link_id"), k.alias("target_id"), scope, k.alias("content_id"), F.when((k % 5 == 0) | (k % 3 != 0), k).otherwise(none).alias("chunk_id"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.when((k % 2 == 0) & (F.trim(F.substring("text", 1, 9)) != ""), F.lit("zzz")).otherwise(F.substring("text", 1, 9)).alias("quote"))
    targets = d.where(k % 11 != 0).select(k.alias("target_id"), F.when(k % 13 == 0, -1).otherwise(k % 4).alias("scope"))
    contents = d.where(k % 7 != 0).select(k.alias("content_id"), scope)
    chunks = d.select(k.alias("chunk_id"), F.when(k % 5 == 0, k + 1).otherwise(k).alias("content_id"), "text")
    return W.link_faults(links, targets, contents, chunks).select("link_id", "fault")


@query("SELECT DISTINCT o_orderkey AS claim_id, l_suppkey AS content_id, l_returnflag AS quote FROM orders JOIN lineitem ON l_orderkey IN (o_orderkey, o_orderkey + 1)")
def claim_evidence(spark, sf):
    k = F.col("o_orderkey")
    claims = table(spark, sf, "orders").select(k.alias("claim_id"), F.array(k, k + 1).alias("fact_ids"))
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_suppkey").alias("content_id"), F.col("l_returnflag").alias("quote"))
    return B.claim_evidence(claims, links)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_type = 'error' THEN 'deleted_external' WHEN event_id % 2 = 0 THEN 'stored' ELSE 'unchanged' END AS fate FROM events")
def item_fates(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", Z.item_fate(k % 5 != 0, F.col("event_type") == "error", k % 2 == 0).alias("fate"))


@query("""SELECT doc_id, '<project>' || chr(10) || 'Name: ' || source || chr(10) || 'Objective: read' || chr(10) || 'Stage: ' || CASE WHEN doc_id % 2 = 0 THEN 'pilot' ELSE 'Not stated' END || chr(10) || '</project>' || chr(10) || '<source_metadata>' || chr(10) || 'Title: ' || source || chr(10) || 'Source type: document' || chr(10)
  || 'Author/participants: Not stated' || chr(10) || 'Occurred at: Not stated' || chr(10) || '</source_metadata>' || chr(10) || '<source_chunk id="' || doc_id || '">' || chr(10) || text || chr(10) || '</source_chunk>' || chr(10) AS prompt FROM documents""")
def extraction_prompts(spark, sf):
    none, c = F.lit(None).cast("string"), F.col
    prompt = B.extraction_prompt(c("source"), F.lit("read"), F.when(c("doc_id") % 2 == 0, "pilot").otherwise(""), c("source"), F.lit("document"), none, none, c("doc_id").cast("string"), c("text"))
    return table(spark, sf, "documents").select("doc_id", prompt.alias("prompt"))
