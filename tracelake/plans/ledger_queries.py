"""Queries of reconciliation, briefs and evaluation, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import vocabulary as V
from tracelake.operators import briefs as B
from tracelake.operators import evaluate as E
from tracelake.operators import reconcile as R
from tracelake.operators import relational as R2
from tracelake.plans.roles import ITEMS, TRANSITIONS, items, table, transitions
from tracelake.plans.text_queries import STATEMENTS, _cue_sql, _normal

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH k AS (SELECT *, o_orderkey % (SELECT count(*) FROM part) AS of FROM orders),
m AS (SELECT o_orderkey AS mention_id, CASE o_orderkey % 3 WHEN 0 THEN 'C' || o_custkey || '@x.example' WHEN 1 THEN p_name ELSE 'nobody ' || o_orderkey END AS owner_text FROM k LEFT JOIN part ON p_partkey = k.of),
names AS (SELECT p_name, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part GROUP BY p_name)
SELECT mention_id, CASE WHEN c_custkey IS NOT NULL OR lo = hi THEN 'resolved' WHEN lo IS NOT NULL THEN 'ambiguous' ELSE 'unknown' END AS outcome, coalesce('c' || c_custkey, CASE WHEN lo = hi THEN 'p' || lo END) AS person_id
FROM m LEFT JOIN customer ON lower(owner_text) = 'c' || c_custkey || '@x.example' LEFT JOIN names ON p_name = owner_text""")
def owner_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Orders name a part by the number of parts, so that every order has one; all parts are aliases."""
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    numbered = o.crossJoin(F.broadcast(p.agg(F.count("*").alias("parts"))))  # one row
    return _owners(spark, sf, numbered.join(p, F.col("o_orderkey") % F.col("parts") == F.col("p_partkey"), "left"), p)


def _owners(spark: SparkSession, sf: str, named: DataFrame, p: DataFrame) -> DataFrame:
    c = table(spark, sf, "customer")
    key = F.col("o_orderkey")
    said = F.when(key % 3 == 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit("@x.example"))).when(key % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("nobody "), key.cast("string")))
    mentions = named.select(key.alias("mention_id"), said.alias("owner_text"))
    people = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("person_id"), F.concat(F.lit(" c"), F.col("c_custkey").cast("string"), F.lit("@X.example")).alias("primary_email"))
    aliases = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("person_id"), F.lit("name").alias("alias_type"), F.col("p_name").alias("normalized_value"))
    return R.owner_resolution(mentions, people, aliases).select("mention_id", "outcome", "person_id")


#: Parts as items of one scope a brand, and as statements about them: the tail of every brand's parts restates the head's names.
_PART_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'commitment' WHEN 1 THEN 'risk' WHEN 2 THEN 'blocker' ELSE 'decision' END"
PARTS = f"""i AS (SELECT p_partkey AS item_id, p_brand AS scope, {_PART_KIND} AS kind, p_name || ' ' || p_type AS title, lower(p_name || ' ' || p_type) AS form, p_size, p_retailprice FROM part WHERE p_partkey % 5 <> 0),
s AS (SELECT p_partkey AS statement_id, p_brand AS scope, {_PART_KIND} AS kind, p_name || ' ' || p_type AS title, lower(p_name || ' ' || p_type) AS form FROM part WHERE p_partkey % 5 = 0)"""


def _raw_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "commitment").when(k % 4 == 1, "risk").when(k % 4 == 2, "blocker").otherwise("decision")
    title = F.concat_ws(" ", "p_name", "p_type")
    p = table(spark, sf, "part")
    there = p.where(k % 5 != 0).select(k.alias("item_id"), F.col("p_brand").alias("scope"), kind.alias("kind"), title.alias("title"), F.lit("").alias("description"), F.timestamp_seconds(k * 86400).alias("updated_at"))
    asked = p.where(k % 5 == 0).select(k.alias("statement_id"), F.col("p_brand").alias("scope"), kind.alias("kind"), title.alias("subject"), F.lit("").alias("statement"), (k % 10 == 0).alias("refers"))
    return asked, there


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    asked, there = _raw_parts(spark, sf)
    return R.prepared(asked, "subject", "statement"), R.prepared(there, "title", "description")


_SETS = """w AS (SELECT s.statement_id, i.item_id, s.kind = i.kind AS is_primary, s.form = i.form AS same,
  list_filter(list_distinct(string_split(s.form, ' ')), lambda t : t <> '') AS a, list_filter(list_distinct(string_split(i.form, ' ')), lambda t : t <> '') AS b, i.item_id AS updated
  FROM s JOIN i ON s.scope = i.scope AND (s.kind = i.kind OR (s.kind = 'risk' AND i.kind = 'blocker') OR (s.kind = 'blocker' AND i.kind = 'risk'))),
c AS (SELECT *, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS j FROM w),
r AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY scope, kind ORDER BY item_id DESC) AS nth FROM i) WHERE nth <= 5),
t AS (SELECT statement_id, item_id, is_primary, j, same, statement_id % 10 = 0 AND item_id IN (SELECT item_id FROM r) AS recent FROM c)"""


@query(f"""WITH {PARTS}, {_SETS},
g AS (SELECT item_id, scope, list_filter(string_split_regex(form, '[^a-z0-9]+'), lambda t : t <> '') AS g FROM i), q AS (SELECT statement_id, scope, list_filter(string_split_regex(form, '[^a-z0-9]+'), lambda t : t <> '') AS q FROM s),
h AS (SELECT statement_id, item_id, len(g) AS length, len(list_filter(range(1, len(g) - len(q) + 2), lambda k : g[k:k + len(q) - 1] = q)) AS hits FROM q JOIN g USING (scope) WHERE len(q) > 0),
z AS (SELECT statement_id, item_id, row_number() OVER (PARTITION BY statement_id ORDER BY hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * length / (SELECT avg(len(g)) FROM g))) DESC, item_id) AS nth FROM h WHERE hits > 0),
y AS (SELECT t.*, nth IS NOT NULL AS found FROM t LEFT JOIN (SELECT * FROM z WHERE nth <= 10) USING (statement_id, item_id))
SELECT statement_id, item_id, is_primary, concat_ws(',', CASE WHEN same THEN 'exact' END, CASE WHEN recent THEN 'recent' END, CASE WHEN found THEN 'search' END, CASE WHEN j >= 0.2 THEN 'tokens' END) AS tiers FROM y WHERE same OR recent OR found OR j >= 0.2""")
def candidate_tiers(spark, sf):
    asked, there = _parts(spark, sf)
    return R.candidates(asked, there).select("statement_id", "item_id", "is_primary", F.array_join("tiers", ",").alias("tiers"))


def _known(asked: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """With what scores depend on."""
    s, i = F.col("statement_id"), F.col("item_id")
    day = lambda first, n: F.date_add(F.lit(first).cast("date"), n.cast("int"))
    asked = asked.withColumns({"person_id": F.when(s % 3 != 0, s % 4), "date_value": F.when(s % 2 == 0, day("2024-01-01", s % 20))})
    there = there.withColumns({
        "item_owner": F.when(i % 3 != 1, i % 4), "item_due": F.when(i % 4 != 3, day("2024-01-01", i % 20)),
        "item_status": F.when(i % 6 == 0, "completed").otherwise("open"), "item_updated": day("2023-10-01", i % 100), "user_corrected": i % 7 == 0,
    })
    return asked, there


_TODAY = "2024-01-01"


_SCORED = f"""{PARTS}, {_SETS},
f AS (SELECT t.statement_id, t.item_id, is_primary, j, same OR recent AS refers,
  CASE WHEN statement_id % 3 <> 0 THEN statement_id % 4 END AS p, CASE WHEN item_id % 3 <> 1 THEN item_id % 4 END AS o,
  CASE WHEN statement_id % 2 = 0 THEN DATE '2024-01-01' + CAST(statement_id % 20 AS INT) END AS d, CASE WHEN item_id % 4 <> 3 THEN DATE '2024-01-01' + CAST(item_id % 20 AS INT) END AS due,
  item_id % 6 = 0 AND 92 - item_id % 100 > 30 AS ago, item_id % 7 = 0 AS corrected FROM t WHERE same OR recent OR j >= 0.2),
x AS (SELECT *, greatest(0.0, least(1.0, 0.35 * j + 0.2 * (CASE WHEN p IS NOT NULL THEN CASE WHEN o IS NULL THEN 0.25 WHEN o = p THEN 1.0 ELSE 0.0 END WHEN o IS NOT NULL THEN 0.25 ELSE 0.5 END)
  + 0.15 * (CASE WHEN d IS NOT NULL AND due IS NOT NULL THEN greatest(0.0, 1.0 - abs(date_diff('day', due, d)) / 14.0) WHEN d IS NULL AND due IS NULL THEN 0.5 ELSE 0.25 END)
  + 0.1 * (CASE WHEN is_primary THEN 1.0 ELSE 0.5 END) + 0.1 * NAMES + 0.1 * (CASE WHEN refers THEN 1.0 ELSE 0.0 END)
  - 0.25 * (CASE WHEN p <> o THEN 1.0 ELSE 0.0 END) - 0.2 * (CASE WHEN ago THEN 1.0 ELSE 0.0 END) - 0.2 * (CASE WHEN corrected AND (coalesce(p <> o, false) OR coalesce(d <> due, false)) THEN 1.0 ELSE 0.0 END))) AS score FROM f
  JOIN (SELECT item_id, list_distinct(list_transform(list_filter(regexp_extract_all(title, '[A-Za-z][A-Za-z''\\-]*'), lambda q : len(q) > 1 AND regexp_matches(q, '^[A-Z]')), lambda q : lower(q))) AS nb FROM i) USING (item_id)
  JOIN (SELECT statement_id, list_distinct(list_transform(list_filter(regexp_extract_all(title, '[A-Za-z][A-Za-z''\\-]*'), lambda q : len(q) > 1 AND regexp_matches(q, '^[A-Z]')), lambda q : lower(q))) AS na FROM s) USING (statement_id))""".replace(
    "NAMES", "(CASE WHEN len(na) = 0 OR len(nb) = 0 THEN 0.0 ELSE len(list_intersect(na, nb)) / (len(na) + len(nb) - len(list_intersect(na, nb))) END)"
)


@query(f"WITH {_SCORED} SELECT statement_id, item_id, round(score, 6) AS score FROM x")
def match_features_score(spark, sf):
    asked, there = _parts(spark, sf)
    return R.scored_candidates(*_known(asked, there.withColumn("item_names", F.col("names"))), F.lit(_TODAY).cast("date"), 6)


@query(f"""WITH {_SCORED}, k AS (SELECT statement_id, item_id, round(score, 9) AS score FROM x), m AS (SELECT *, row_number() OVER w AS nth, score - lead(score) OVER w AS margin FROM k WINDOW w AS (PARTITION BY statement_id ORDER BY score DESC, item_id))
SELECT statement_id, item_id, round(margin, 6) AS margin, CASE WHEN score >= 0.82 AND (margin IS NULL OR margin >= 0.15) THEN 'strong' WHEN score >= 0.65 THEN 'review' ELSE 'uncertain' END AS match_tier FROM m WHERE nth = 1""")
def match_outcome(spark, sf):
    top = R.best_candidates(*_known(*_raw_parts(spark, sf)), F.lit(_TODAY).cast("date"), 9)
    return top.select("statement_id", "item_id", F.round("margin", 6).alias("margin"), "match_tier")


_CASES = "CASE event_id % 12 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(STATEMENTS)) + " END"


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """A case an event: every statement against items of changing kind, state, owner, date and score."""
    e = F.col("event_id")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    k = F.floor(e / 12)
    day = F.lit("2024-03-01").cast("date")
    there = e % 13 != 0
    return table(spark, sf, "events").select(
        "event_id", pick(STATEMENTS, e).alias("statement"), pick((*V.KINDS, "update"), F.floor(e / 5)).alias("kind"), F.when(e % 3 == 0, "inferred").otherwise("explicit").alias("explicitness"),
        F.when(e % 4 == 0, "ambiguous").when(e % 4 == 1, "unknown").otherwise("resolved").alias("owner_outcome"), F.when(e % 4 > 1, e % 3).alias("person_id"),
        F.when(k % 3 != 0, F.date_add(day, (k % 2).cast("int"))).alias("date_value"), F.when(e % 9 == 0, "soon").alias("date_text"), F.when(e % 2 == 0, "someone").alias("owner_text"),
        F.when(there, e).alias("item_id"), F.when(there, pick(V.KINDS, F.floor(e / 7))).alias("item_kind"), F.when(there, pick(("open", "active", "open", "completed"), F.floor(e / 3))).alias("item_status"),
        F.when(there & (k % 2 == 0), k % 3).alias("item_owner"), F.when(there & (k % 5 != 0), day).alias("item_due"), F.when(there, (e % 101) / 100).alias("score"),
        F.when(there & (e % 6 != 0), (e % 31) / 100).alias("margin"), F.when(there, F.when((e % 101 >= 82) & ((e % 6 == 0) | (e % 31 >= 15)), "strong").when(e % 101 >= 65, "review").otherwise("uncertain")).alias("match_tier"),
        F.when(there, (e % 11) / 10).alias("subject_token_similarity"), F.when(there, F.when(e % 17 == 0, 1.0).otherwise(0.0)).alias("corrected_field_disagreement"), F.when(e % 2 == 0, True).alias("has_evidence"),
    )


def _pick_sql(values, by: str) -> str:
    return f"CASE CAST({by} AS BIGINT) % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_K, _THERE = "(event_id // 12)", "event_id % 13 <> 0"
CASES = f"""raw AS (SELECT event_id AS e, {_normal(_CASES)} AS form, {_pick_sql((*V.KINDS, "update"), "event_id // 5")} AS kind, event_id % 3 <> 0 AS explicit_said,
  CASE WHEN event_id % 4 = 0 THEN 'ambiguous' WHEN event_id % 4 = 1 THEN 'unknown' ELSE 'resolved' END AS owner_outcome, CASE WHEN event_id % 4 > 1 THEN event_id % 3 END AS p,
  CASE WHEN {_K} % 3 <> 0 THEN DATE '2024-03-01' + CAST({_K} % 2 AS INT) END AS d, event_id % 2 = 0 OR event_id % 9 = 0 AS said_more, {_THERE} AS there,
  CASE WHEN {_THERE} THEN {_pick_sql(V.KINDS, "event_id // 7")} END AS item_kind, CASE WHEN {_THERE} THEN {_pick_sql(("open", "active", "open", "completed"), "event_id // 3")} END AS item_status,
  CASE WHEN {_THERE} AND {_K} % 2 = 0 THEN {_K} % 3 END AS o, CASE WHEN {_THERE} AND {_K} % 5 <> 0 THEN DATE '2024-03-01' END AS due, CASE WHEN {_THERE} THEN event_id % 101 END AS score,
  CASE WHEN {_THERE} AND event_id % 6 <> 0 THEN event_id % 31 END AS margin, CASE WHEN {_THERE} THEN event_id % 11 END AS sim, {_THERE} AND event_id % 17 = 0 AS corrected, event_id % 2 = 0 AS seen FROM events),
q AS (SELECT *, coalesce(d <> due, false) AS dd, coalesce(owner_outcome = 'resolved' AND p <> o, false) AS od, coalesce(kind <> 'update' AND kind <> item_kind, false) AS ok,
  coalesce(item_status = 'completed', false) AS ended, coalesce(margin < 15 AND score >= 65, false) AS crowded,
  CASE WHEN NOT there THEN NULL WHEN score >= 82 AND (margin IS NULL OR margin >= 15) THEN 'strong' WHEN score >= 65 THEN 'review' ELSE 'uncertain' END AS tier,
  {", ".join(f"({_cue_sql('form', n)}) IS NOT NULL AS c_{n}" for n in V.CUES)} FROM raw),
g AS (SELECT *, c_completion OR c_cancellation OR c_supersession OR dd OR od AS changed FROM q),
z AS (SELECT *, CASE WHEN NOT there AND kind = 'update' THEN 'no_target' WHEN NOT there THEN 'none' WHEN crowded THEN 'crowded' WHEN ended AND (changed OR ok AND c_blocking) THEN 'reversal'
  WHEN ok AND (c_blocking OR c_supersession) THEN 'kind_change' WHEN sim >= 8 AND NOT changed AND NOT c_date_change AND NOT c_owner_assignment THEN 'same' WHEN c_completion THEN 'completion' WHEN c_cancellation THEN 'cancellation'
  WHEN c_supersession AND item_kind IN ('decision', 'milestone', 'commitment', 'open_question') THEN 'supersession' WHEN dd AND NOT od THEN 'date' WHEN od AND NOT dd THEN 'owner'
  WHEN tier = 'uncertain' AND kind <> 'update' THEN 'weak' ELSE 'unclassified' END AS rule FROM g),
a AS (SELECT *, CASE rule WHEN 'no_target' THEN 'CONFLICT' WHEN 'none' THEN 'CREATE' WHEN 'kind_change' THEN 'SUPERSEDE' WHEN 'supersession' THEN 'SUPERSEDE' WHEN 'same' THEN CASE WHEN seen THEN 'NO_OP' ELSE 'ADD_EVIDENCE' END
  WHEN 'completion' THEN 'COMPLETE' WHEN 'cancellation' THEN 'CANCEL' WHEN 'date' THEN CASE WHEN c_date_change THEN 'UPDATE' ELSE 'CONFLICT' END WHEN 'owner' THEN CASE WHEN c_owner_assignment THEN 'UPDATE' ELSE 'CONFLICT' END
  WHEN 'weak' THEN 'CREATE' ELSE 'CONFLICT' END AS action FROM z)"""


@query(f"WITH {CASES} SELECT e AS event_id, rule, action, CASE WHEN rule NOT IN ('no_target', 'none', 'crowded', 'weak') THEN e END AS target_id FROM a")
def action_classification(spark, sf):
    return R.classified(_cases(spark, sf)).select("event_id", "rule", "action", "target_id")


@query(f"""WITH {CASES}, v AS (SELECT *, action = 'UPDATE' OR rule IN ('reversal', 'kind_change', 'completion', 'cancellation', 'supersession') AS explicit,
  item_status IN ('open', 'active') AND CASE WHEN action = 'COMPLETE' THEN item_kind IN ('commitment', 'milestone') ELSE true END AS legal FROM a),
b AS (SELECT e AS event_id, CASE WHEN explicit_said AND (said_more OR d IS NOT NULL) THEN 2 WHEN explicit_said OR said_more OR d IS NOT NULL THEN 1 ELSE 0 END AS x,
  CASE WHEN NOT there THEN 2 WHEN owner_outcome = 'ambiguous' OR corrected OR crowded THEN 0 WHEN tier = 'strong' THEN 2 WHEN tier = 'review' THEN 1 ELSE 0 END AS m,
  CASE WHEN action = 'CONFLICT' THEN 0 WHEN action IN ('CREATE', 'NO_OP', 'ADD_EVIDENCE') THEN 2 WHEN NOT explicit OR NOT legal THEN 0 ELSE 2 END AS u FROM v)
SELECT event_id, ['low', 'medium', 'high'][x + 1] AS extraction_band, ['low', 'medium', 'high'][m + 1] AS match_band, ['low', 'medium', 'high'][u + 1] AS mutation_band, ['low', 'medium', 'high'][least(x, m, u) + 1] AS confidence_band FROM b""")
def confidence_bands(spark, sf):
    return R.confidence(R.classified(_cases(spark, sf))).select("event_id", "extraction_band", "match_band", "mutation_band", "confidence_band")


# --- briefs -------------------------------------------------------------------------------------------------------

#: Events as versions of items, scope by scope, and nations as scopes.
VERSIONS = """versions AS (SELECT CAST(event_id AS VARCHAR) AS version_id, event_id, CAST(event_id % 25 AS INT) AS scope, event_id AS item_id, ts AS valid_from, event_type AS title, 'was ' || event_type AS previous FROM events)"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("version_id"), F.col("event_id").alias("item_id"), (F.col("event_id") % 25).cast("int").alias("scope"), F.lit("commitment").alias("kind"),
        F.col("ts").alias("valid_from"), kind.alias("title"), F.lit("open").alias("status"), F.lit(None).cast("long").alias("owner"), F.lit(None).cast("date").alias("due"), kind.alias("transition"), F.concat(F.lit("was "), kind).alias("previous"),
    )


def _scopes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(n.alias("scope"), F.col("n_name").alias("objective"), F.when(n % 3 != 0, F.concat(F.lit("stage "), F.col("n_regionkey").cast("string"))).alias("stage"), F.col("n_name").alias("name"))


_OPEN = "status IN ('open', 'active')"
#: Items in the order in which they are read, the latest updated first; sections keep it where their own order ties.
_READ = "updated_at DESC, item_id"


@query(f"""WITH {ITEMS}, {VERSIONS},
milestones AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY due IS NULL, due, title, {_READ}) AS position FROM items WHERE kind = 'milestone' AND {_OPEN}),
recent AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY valid_from DESC, event_id DESC) AS position FROM versions)
SELECT n_nationkey AS scope, 'objective_and_scope' AS section, 1 AS section_no, 1 AS position, NULL AS item_id, n_name AS title, NULL AS note FROM nation
UNION ALL SELECT n_nationkey, 'current_stage', 2, 1, NULL, 'stage ' || n_regionkey, NULL FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT scope, 'recent_changes', 3, position, item_id, title, previous FROM recent WHERE position <= 15
UNION ALL SELECT scope, 'next_milestone', 4, position, item_id, title, NULL FROM milestones WHERE position = 1
UNION ALL SELECT scope, 'open_commitments', 5, row_number() OVER (PARTITION BY scope ORDER BY due IS NULL, due, title, {_READ}), item_id, title, NULL FROM items WHERE kind = 'commitment' AND {_OPEN}
UNION ALL SELECT scope, 'decisions', 6, row_number() OVER (PARTITION BY scope ORDER BY title, {_READ}), item_id, title, NULL FROM items WHERE kind = 'decision' AND status = 'active'
UNION ALL SELECT scope, 'risks_and_blockers', 7, row_number() OVER (PARTITION BY scope ORDER BY kind, title, {_READ}), item_id, title, NULL FROM items WHERE kind IN ('risk', 'blocker') AND {_OPEN}
UNION ALL SELECT scope, 'unresolved_questions', 8, row_number() OVER (PARTITION BY scope ORDER BY title, {_READ}), item_id, title, NULL FROM items WHERE kind = 'open_question' AND status = 'open'""")
def brief_sections(spark, sf):
    brief = B.project_brief(items(spark, sf), _versions(spark, sf), _scopes(spark, sf))
    return brief.select("scope", "section", "section_no", "position", "item_id", "title", "note")


def _meetings(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as meetings; some have an override, some the time of another."""
    e, k = table(spark, sf, "events").where("event_type = 'purchase'"), F.col("event_id")
    at = F.when(k % 4 == 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).when(k % 50 != 1, F.col("ts"))
    return e.select((k % 25).cast("int").alias("scope"), k.alias("meeting_id"), at.alias("at"), F.when(k % 20 == 3, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")).alias("override"), F.col("event_type").alias("title"), F.col("props").alias("purpose"))


_CUTOFFS = """mt AS (SELECT CAST(event_id % 25 AS INT) AS scope, event_id AS meeting_id, CASE WHEN event_id % 4 = 0 THEN date_trunc('hour', ts) WHEN event_id % 50 <> 1 THEN ts END AS "at", CASE WHEN event_id % 20 = 3 THEN TIMESTAMP '2024-01-05 00:00:00' END AS override FROM events WHERE event_type = 'purchase'),
times AS (SELECT DISTINCT scope, "at" FROM mt WHERE "at" IS NOT NULL),
cu AS (SELECT mt.scope, meeting_id, mt."at", coalesce(override, t."at", TIMESTAMP '2024-01-01 00:00:00') AS cutoff FROM mt ASOF LEFT JOIN times t ON mt.scope = t.scope AND mt."at" > t."at")"""


def _cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    created = table(spark, sf, "nation").select(F.col("n_nationkey").alias("scope"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    return B.cutoffs(_meetings(spark, sf), created)


@query(f"WITH {_CUTOFFS} SELECT scope, meeting_id, strftime(cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff FROM cu")
def meeting_cutoffs(spark, sf):
    return _cutoffs(spark, sf).select("scope", "meeting_id", F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss").alias("cutoff"))


@query(f"""WITH {_CUTOFFS} SELECT meeting_id, row_number() OVER (ORDER BY "at" IS NULL, "at" DESC, meeting_id) AS place FROM mt""")
def meetings_newest_first(spark, sf):
    day = F.date_trunc("day", "at")
    return R2.placed(_meetings(spark, sf), [(day,)], [*B.meeting_order("at"), F.col("meeting_id")]).select("meeting_id", "place")


_MEETING_STATE = f"""state AS (SELECT scope, 'outstanding_commitments' AS section, row_number() OVER (PARTITION BY scope ORDER BY owner IS NULL, due IS NULL, due, {_READ}) AS position, item_id FROM items WHERE kind = 'commitment' AND {_OPEN}
UNION ALL SELECT scope, 'decisions_required', row_number() OVER (PARTITION BY scope ORDER BY title, {_READ}), item_id FROM items WHERE kind = 'open_question' AND status = 'open' AND owner IS NOT NULL
UNION ALL SELECT scope, 'risks_and_blockers', row_number() OVER (PARTITION BY scope ORDER BY kind, title, {_READ}), item_id FROM items WHERE kind IN ('risk', 'blocker') AND {_OPEN}
UNION ALL SELECT scope, 'unanswered_questions', row_number() OVER (PARTITION BY scope ORDER BY title, {_READ}), item_id FROM items WHERE kind = 'open_question' AND status = 'open' AND owner IS NULL)"""


@query(f"""WITH {ITEMS}, {VERSIONS}, {_MEETING_STATE}
SELECT scope, section, position, item_id FROM state
UNION ALL SELECT scope, 'changes_since_previous', position, item_id FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY valid_from DESC, event_id DESC) AS position FROM versions) WHERE position <= 200""")
def meeting_state(spark, sf):
    return B.meeting_state(items(spark, sf), _versions(spark, sf)).select("scope", "section", "position", "item_id")


@query(f"""WITH {VERSIONS}, {_CUTOFFS}, v AS (SELECT scope, list_sort(list(valid_from)) AS times FROM versions GROUP BY scope)
SELECT scope, meeting_id, least(200, len(list_filter(coalesce(times, []), lambda t : t >= cutoff))) AS n_changes FROM cu LEFT JOIN v USING (scope)""")
def meeting_prep_sections(spark, sf):
    """For every meeting how many changes its brief shows; the sections themselves are its scope's (`meeting_state`)."""
    return B.meetings_prepared(_cutoffs(spark, sf), _versions(spark, sf)).select("scope", "meeting_id", "n_changes")


@query(f"""WITH {ITEMS}, {VERSIONS}, {_CUTOFFS}, {_MEETING_STATE}, last AS (SELECT * FROM cu WHERE meeting_id IN (SELECT max(meeting_id) FROM mt GROUP BY scope)),
ch AS (SELECT meeting_id, v.item_id, row_number() OVER (PARTITION BY meeting_id ORDER BY valid_from DESC, event_id DESC) AS position FROM last JOIN versions v ON v.scope = last.scope AND valid_from >= cutoff)
SELECT meeting_id, 'meeting_purpose' AS section, 1 AS section_no, 1 AS position, NULL AS item_id FROM last
UNION ALL SELECT meeting_id, 'changes_since_previous', 2, position, item_id FROM ch WHERE position <= 200
UNION ALL SELECT meeting_id, section, CASE section WHEN 'outstanding_commitments' THEN 3 WHEN 'decisions_required' THEN 4 WHEN 'risks_and_blockers' THEN 5 ELSE 6 END, position, item_id FROM last JOIN state USING (scope)""")
def meeting_brief_facts(spark, sf):
    """The whole brief of every scope's last entered meeting."""
    m, v = _meetings(spark, sf), _versions(spark, sf)
    last = m.join(m.groupBy("scope").agg(F.max("meeting_id").alias("meeting_id")), ["scope", "meeting_id"], "left_semi")
    facts = B.for_meetings(last, B.meeting_state(items(spark, sf), v), B.meetings_prepared(_cutoffs(spark, sf), v))
    return facts.select("meeting_id", "section", "section_no", "position", "item_id")


_CLAIMS = """c AS (SELECT o_orderkey AS k, o_orderpriority AS section, CASE o_orderkey % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'inference' ELSE 'suggestion' END AS type, CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE [o_orderkey + 1, o_orderkey, 99999999] END AS ids FROM orders),
f AS (SELECT o_orderkey AS fact_id, o_orderpriority AS section, o_orderkey % 5 <> 0 AS has_evidence FROM orders WHERE o_orderkey % 7 <> 0)"""


def _claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k, o = F.col("o_orderkey"), table(spark, sf, "orders")
    kind = F.when(k % 3 == 0, "fact").when(k % 3 == 1, "inference").otherwise("suggestion")
    ids = F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k + 1, k, F.lit(99999999)).cast("array<bigint>"))
    claims = o.select(k.alias("claim_id"), F.col("o_orderpriority").alias("section"), kind.alias("type"), ids.alias("fact_ids"))
    facts = o.where(k % 7 != 0).select(k.alias("fact_id"), F.col("o_orderpriority").alias("section"), (k % 5 != 0).alias("has_evidence"))
    return claims, facts


@query(f"""WITH {_CLAIMS}, r AS (SELECT k, list(fact_id ORDER BY list_position(ids, fact_id)) AS found, bool_or(has_evidence) AS proved FROM (SELECT k, c.section, ids, unnest(ids) AS fact_id FROM c) u JOIN f USING (fact_id, section) GROUP BY k)
SELECT k AS claim_id, CASE WHEN type = 'suggestion' THEN 'valid' WHEN found IS NULL THEN 'invalid_reference' WHEN section = '1-URGENT' OR proved THEN 'valid' ELSE 'unsupported' END AS validation,
  array_to_string(CASE WHEN type = 'suggestion' OR found IS NOT NULL THEN coalesce(found, []) ELSE ids END, ',') AS cited FROM c LEFT JOIN r USING (k)""")
def claim_validation(spark, sf):
    claims, facts = _claims(spark, sf)
    return B.checked_claims(claims, facts, ["1-URGENT"]).select("claim_id", "validation", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"))


@query("""WITH o AS (SELECT *, 's' || o_orderkey % 40 AS section FROM orders)
SELECT o_orderkey AS fact_id, CASE WHEN section = 's1' OR o_orderkey % 3 <> 0 THEN 'valid' ELSE 'unsupported' END AS validation,
  CASE WHEN o_orderkey % 2 = 0 THEN 'order ' || o_orderkey || ' — update (now ' || o_orderstatus || ')' || CASE WHEN o_orderkey % 6 = 0 THEN '; was due' ELSE '' END || '; owner c' || o_custkey || '.'
  ELSE 'order ' || o_orderkey || ' — status: ' || o_orderstatus || ' — owner: c' || o_custkey || '.' END AS text FROM o WHERE section <> 's2'""")
def claim_fallbacks(spark, sf):
    """Claims in the facts' own words for all sections but one, which has a valid claim."""
    k = F.col("o_orderkey")
    facts = table(spark, sf, "orders").select(
        k.alias("fact_id"), F.concat(F.lit("s"), (k % 40).cast("string")).alias("section"), (k % 3 != 0).alias("has_evidence"), F.concat(F.lit("order "), k.cast("string")).alias("title"), F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner"), F.lit(None).cast("date").alias("due"), F.when(k % 2 == 0, "update").alias("transition"), F.when(k % 6 == 0, "was due").alias("note"),
    )
    claims = spark.createDataFrame([("s2", "valid"), ("s3", "unsupported")], "section string, validation string")
    return B.fallback_claims(facts, claims, ["s1"]).select(F.col("fact_ids")[0].alias("fact_id"), "validation", "text")


@query("""WITH c AS (SELECT c_nationkey AS scope, c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'decisions' WHEN 1 THEN 'current_stage' ELSE 'open_commitments' END AS section,
  '- ' || CASE c_custkey % 4 WHEN 1 THEN '**Inference:** ' WHEN 2 THEN '**Suggestion:** ' ELSE '' END || c_name || CASE WHEN c_custkey % 5 = 0 THEN ' [1](evidence?artifact_id=a' || c_custkey || '&char_start=0&char_end=9) [source](http://x/' || c_custkey || ') [2](evidence?artifact_id=b&char_start=1&char_end=2)' ELSE '' END AS line FROM customer WHERE c_custkey % 7 <> 0),
s AS (SELECT scope, section, string_agg(line, chr(10) ORDER BY k) AS said FROM c GROUP BY ALL),
h AS (SELECT * FROM (VALUES (1, 'objective_and_scope', 'Objective and Scope'), (2, 'current_stage', 'Current Stage'), (3, 'recent_changes', 'Recent Changes'), (4, 'next_milestone', 'Next Milestone'), (5, 'open_commitments', 'Open Commitments'), (6, 'decisions', 'Decisions'), (7, 'risks_and_blockers', 'Risks and Blockers'), (8, 'unresolved_questions', 'Unresolved Questions')) AS t(no, section, heading))
SELECT n_nationkey AS scope, '# Current Project Brief — ' || any_value(n_name) || chr(10) || chr(10) || string_agg('## ' || heading || chr(10) || coalesce(said, '- No accepted items.') || chr(10), chr(10) ORDER BY no) AS markdown
FROM nation CROSS JOIN h LEFT JOIN s ON s.scope = n_nationkey AND s.section = h.section GROUP BY n_nationkey""")
def brief_markdown(spark, sf):
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    section = F.when(k % 3 == 0, "decisions").when(k % 3 == 1, "current_stage").otherwise("open_commitments")
    kind = F.when(k % 4 == 1, "inference").when(k % 4 == 2, "suggestion").otherwise("fact")
    claims = c.select(F.col("c_nationkey").alias("scope"), k.alias("claim_id"), section.alias("section"), k.alias("ordinal"), kind.alias("type"), F.col("c_name").alias("text"), F.when(k % 7 != 0, "valid").otherwise("unsupported").alias("validation"))
    there, none = c.where(k % 5 == 0), F.lit(None).cast("string")
    one = there.select(k.alias("claim_id"), F.lit(1).alias("ordinal"), F.concat(F.lit("a"), k.cast("string")).alias("artifact_id"), F.lit("0").alias("char_start"), F.lit("9").alias("char_end"), F.concat(F.lit("http://x/"), k.cast("string")).alias("url"))
    two = there.select(k.alias("claim_id"), F.lit(2).alias("ordinal"), F.lit("b").alias("artifact_id"), F.lit("1").alias("char_start"), F.lit("2").alias("char_end"), none.alias("url"))
    return B.markdown(claims, _scopes(spark, sf), B.citations(one.union(two)))


@query("SELECT o_orderkey AS fact_id, '{\"fact_id\":' || o_orderkey || ',\"kind\":\"' || o_orderstatus || '\"' || CASE WHEN o_orderkey % 2 = 0 THEN ',\"title\":\"' || o_orderpriority || '\"' ELSE '' END || '}' AS payload FROM orders WHERE o_orderkey % 9 <> 0")
def fact_payloads(spark, sf):
    """Facts, less the unchecked ones, as JSON without what is not set."""
    k = F.col("o_orderkey")
    facts = table(spark, sf, "orders").select(k.alias("fact_id"), F.col("o_orderstatus").alias("kind"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("title"))
    kept = B.without_facts(facts, facts.where("fact_id % 9 = 0"))
    return kept.select("fact_id", B.fact_payload(("fact_id", "kind", "title")).alias("payload"))


# --- evaluation -----------------------------------------------------------------------------------------------------


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    """Labels against a simple rule on documents: claimed is "longer than 800 characters", expected is quality 1."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id").select("source", "lang", (F.col("n_chars") > 800).alias("claimed"), (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 1).alias("toxic"))


_METRICS = {"precision": ("claimed AND expected", "claimed"), "recall": ("claimed AND expected", "expected"), "toxic_rate": ("toxic", "claimed"), "never": ("claimed", "claimed AND NOT claimed")}
_GRADED = "g AS (SELECT source, lang, n_chars > 800 AS claimed, quality = 1 AS expected, toxic = 1 AS toxic FROM documents JOIN labels USING (doc_id))"


def _metric_sql(keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS metric, count(*) FILTER (({of}) AND ({hit})) AS numerator, count(*) FILTER ({of}) AS denominator FROM g GROUP BY {keys}" for n, (hit, of) in _METRICS.items())


@query(f"WITH {_GRADED}, m AS ({_metric_sql('source, lang')}) SELECT source, lang, metric, numerator, denominator, round(numerator / nullif(denominator, 0), 6) AS value FROM m")
def metrics_by_group(spark, sf):
    m = E.ratios(_graded(spark, sf), ["source", "lang"], {n: (F.expr(hit), F.expr(of)) for n, (hit, of) in _METRICS.items()})
    return m.select("source", "lang", "metric", F.col("numerator").cast("long").alias("numerator"), F.col("denominator").cast("long").alias("denominator"), F.round("value", 6).alias("value"))


@query(f"WITH {_GRADED}, m AS ({_metric_sql('lang')}) SELECT lang, metric, numerator, denominator, round(numerator / nullif(denominator, 0), 6) AS value FROM m")
def metrics_pooled(spark, sf):
    m = E.pooled(E.ratios(_graded(spark, sf), ["source", "lang"], {n: (F.expr(hit), F.expr(of)) for n, (hit, of) in _METRICS.items()}), ["lang"])
    return m.select("lang", "metric", F.col("numerator").cast("long").alias("numerator"), F.col("denominator").cast("long").alias("denominator"), F.round("value", 6).alias("value"))


#: Checks with their bounds, over graded documents: a source is a project, a longer rule the baseline.
_CHECKS = f"""{_GRADED}, base AS (SELECT count(*) FILTER (n_chars > 300 AND quality = 1) / count(*) FILTER (n_chars > 300) AS value FROM documents JOIN labels USING (doc_id)),
v AS (SELECT count(*) FILTER (claimed AND expected) / count(*) FILTER (claimed) AS p, count(*) FILTER (claimed AND expected) / count(*) FILTER (expected) AS r, count(*) FILTER (claimed AND toxic) / count(*) FILTER (claimed) AS t FROM g),
each AS (SELECT source, count(*) FILTER (claimed AND expected) / nullif(count(*) FILTER (expected), 0) AS r, count(*) FILTER (claimed AND toxic) / nullif(count(*) FILTER (claimed), 0) AS t FROM g GROUP BY source),
k AS (SELECT 'item_precision' AS metric, p AS value, p >= 0.9 AS ok FROM v
  UNION ALL SELECT 'item_recall', r, r >= 0.8 AND (SELECT bool_and(coalesce(r >= 0.75, true)) FROM each) FROM v
  UNION ALL SELECT 'evidence_correctness', 0.96, true UNION ALL SELECT 'unsupported_claim_rate', t, t <= 0.02 FROM v
  UNION ALL SELECT 'materially_misleading_rate', max(t), bool_and(coalesce(t < 0.05, true)) FROM each
  UNION ALL SELECT 'current_state_accuracy', p, p >= 0.85 FROM v UNION ALL SELECT 'project_assignment_error', NULL, NULL UNION ALL SELECT 'cross_project_leakage', 0.0, true
  UNION ALL SELECT 'acceptance_rate', 0.8, true UNION ALL SELECT 'edit_free_acceptance_rate', 0.64, false UNION ALL SELECT 'review_burden_minutes_per_sync', 5.0, true UNION ALL SELECT 'review_burden_seconds_per_item', 20.5, false
  UNION ALL SELECT 'meeting_prep_time_saved', 0.0, false
  UNION ALL SELECT 'beats_baseline', CASE WHEN p - base.value >= 0.1 OR 1 - t / 0.2 >= 0.5 THEN 1.0 ELSE 0.0 END, p - base.value >= 0.1 OR 1 - t / 0.2 >= 0.5 FROM v, base)"""


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    g = _graded(spark, sf).withColumn("all", F.lit(1))
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    share = lambda hit, of: F.sum((hit & of).cast("long")) / F.sum(of.cast("long"))
    c = F.col
    v = g.agg(share(c("expected"), c("claimed")).alias("p"), share(c("claimed"), c("expected")).alias("r"), share(c("toxic"), c("claimed")).alias("t"))
    base = d.agg(share(c("quality") == 1, c("n_chars") > 300).alias("base"))
    beats = E.beats_baseline(c("p"), c("base"), c("t"), F.lit(0.2))
    values = {"item_precision": c("p"), "item_recall": c("r"), "evidence_correctness": F.lit(0.96), "unsupported_claim_rate": c("t"), "current_state_accuracy": c("p"), "cross_project_leakage": F.lit(0.0), "acceptance_rate": F.lit(0.8),
              "edit_free_acceptance_rate": F.lit(0.64), "review_burden_minutes_per_sync": F.lit(5.0), "review_burden_seconds_per_item": F.lit(20.5), "meeting_prep_time_saved": E.prep_time_saved(F.lit(60.0), F.lit(9.0)), "beats_baseline": beats}
    overall = v.crossJoin(F.broadcast(base)).select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), x.cast("double").alias("value")) for m, x in values.items()))).alias("m")).select("m.*")  # one row each
    by_project = E.ratios(g, ["source"], {"item_recall": (c("claimed"), c("expected")), "materially_misleading_rate": (c("toxic"), c("claimed"))})
    return E.threshold_checks(overall, by_project)


@query(f"WITH {_CHECKS} SELECT metric, round(value, 6) AS value, CASE WHEN ok IS NULL THEN 'not_evaluable' WHEN ok THEN 'pass' ELSE 'fail' END AS state FROM k")
def thresholds_verdict(spark, sf):
    return _checked(spark, sf).select("metric", F.round("value", 6).alias("value"), "state")


@query(f"""WITH {_CHECKS} SELECT CASE WHEN bool_or(metric IN ('beats_baseline', 'cross_project_leakage', 'materially_misleading_rate') AND NOT ok) THEN 'STOP' WHEN bool_and(coalesce(ok, false)) THEN 'GO' ELSE 'ITERATE' END AS verdict,
  count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS not_evaluable FROM k""")
def evaluation_verdict(spark, sf):
    return E.verdict(_checked(spark, sf))


#: Items of two checkpoints, a project's brief and a meeting's, and claims about most of them, some wrong, some about nothing.
_POINTS = f"""{ITEMS}, st AS (SELECT item_id % 2 + 1 AS cp, item_id, kind, status, 'c ' || owner AS owner, due, item_id % 13 = 0 AS ambiguous, item_id % 4 = 0 AS ended FROM items),
must AS (SELECT * FROM st WHERE NOT ambiguous AND (cp = 1 OR kind IN ('commitment', 'open_question', 'risk', 'blocker') AND status <> 'completed')),
m AS (SELECT cp, item_id, CASE WHEN item_id % 17 = 0 THEN 'decision' ELSE kind END AS kind, CASE WHEN item_id % 10 = 0 THEN 'canceled' ELSE status END AS status, CASE WHEN item_id % 8 <> 0 THEN 'C ' || substr(owner, 3) || '!' END AS owner, CASE WHEN item_id % 19 = 0 THEN DATE '1999-01-01' ELSE due END AS due, item_id % 3 <> 0 AS proof FROM st WHERE item_id % 6 <> 0
  UNION ALL SELECT item_id % 2 + 1, -item_id, kind, status, NULL, NULL, true FROM items WHERE item_id % 29 = 0 UNION ALL SELECT item_id % 2 + 1, NULL, 'risk', 'open', NULL, NULL, false FROM items WHERE item_id % 31 = 0),
j AS (SELECT must.cp, must.item_id, must.kind = m.kind AS kind_ok, CASE WHEN must.status IS NOT NULL THEN coalesce(must.status = m.status, false) END AS status_ok,
  CASE WHEN must.owner IS NOT NULL THEN coalesce(lower(must.owner) = replace(lower(m.owner), '!', ''), false) END AS owner_ok, CASE WHEN must.due IS NOT NULL THEN coalesce(must.due = m.due, false) END AS due_ok, ended, m.item_id IS NOT NULL AS said, proof FROM must LEFT JOIN m ON m.cp = must.cp AND m.item_id = must.item_id),
cl AS (SELECT item_id % 2 + 1 AS cp, item_id, item_id % 5 <> 0 AS proof FROM items WHERE item_id % 4 <> 1 AND item_id % 9 <> 0)"""


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    i, k = items(spark, sf), F.col("item_id")
    point, none = (k % 2 + 1).alias("checkpoint_id"), lambda n, t: F.lit(None).cast(t).alias(n)
    owner = F.concat(F.lit("c "), F.col("owner").cast("string"))
    states = i.select(point, F.when(k % 2 == 0, "current_project").otherwise("meeting_preparation").alias("brief_type"), "item_id", "kind", "status", owner.alias("owner"), "due", F.when(k % 13 == 0, "ambiguous").otherwise("material").alias("last_materiality"), F.when(k % 4 == 0, "complete").otherwise("update").alias("last_transition"))
    said = i.where(k % 6 != 0).select(
        point, "item_id", F.when(k % 17 == 0, "decision").otherwise(F.col("kind")).alias("kind"), F.when(k % 10 == 0, "canceled").otherwise(F.col("status")).alias("status"),
        F.when(k % 8 != 0, F.concat(F.lit("C "), F.col("owner").cast("string"), F.lit("!"))).alias("owner"), F.when(k % 19 == 0, F.lit("1999-01-01").cast("date")).otherwise(F.col("due")).alias("due"), (k % 3 != 0).alias("has_evidence"),
    )
    early = i.where(k % 29 == 0).select(point, (-k).alias("item_id"), "kind", "status", none("owner", "string"), none("due", "date"), F.lit(True).alias("has_evidence"))
    nothing = i.where(k % 31 == 0).select(point, none("item_id", "long"), F.lit("risk").alias("kind"), F.lit("open").alias("status"), none("owner", "string"), none("due", "date"), F.lit(False).alias("has_evidence"))
    kind = F.when(k % 4 == 0, "fact").when(k % 4 == 1, "suggestion").otherwise("inference")
    claims = i.select(point, "item_id", kind.alias("type"), F.when(k % 9 != 0, F.col("kind")).alias("kind"), (k % 5 != 0).alias("has_evidence"))
    return claims, said.union(early).union(nothing), states


@query(f"""WITH {_POINTS},
r AS (SELECT cp, 'item_precision' AS metric, count(*) FILTER (item_id IN (SELECT item_id FROM st)) AS numerator, count(*) AS denominator FROM m GROUP BY cp
  UNION ALL SELECT cp, 'item_recall', count(*) FILTER (said), count(*) FROM j GROUP BY cp
  {"".join(f" UNION ALL SELECT cp, 'field_accuracy_{f}', count(*) FILTER (said AND {f}_ok), count(*) FILTER (said AND {f}_ok IS NOT NULL) FROM j GROUP BY cp" for f in ("kind", "status", "owner", "due"))}
  UNION ALL SELECT cp, 'transition_accuracy', count(*) FILTER (said AND ended AND status_ok), count(*) FILTER (said AND ended) FROM j GROUP BY cp
  UNION ALL SELECT cp, 'current_state_accuracy', count(*) FILTER (said AND kind_ok AND coalesce(status_ok, true) AND coalesce(owner_ok, true) AND coalesce(due_ok, true)), count(*) FROM j GROUP BY cp
  UNION ALL SELECT cp, 'evidence_correctness', count(*) FILTER (proof), count(*) FROM cl GROUP BY cp UNION ALL SELECT cp, 'unsupported_claim_rate', count(*) FILTER (NOT proof), count(*) FROM cl GROUP BY cp)
SELECT cp AS checkpoint_id, metric, numerator, denominator, round(numerator / nullif(denominator, 0), 6) AS value FROM r
UNION ALL SELECT cp, 'field_accuracy_combined', sum(numerator), sum(denominator), round(sum(numerator) / nullif(sum(denominator), 0), 6) FROM r WHERE metric LIKE 'field%' GROUP BY cp""")
def checkpoint_scores(spark, sf):
    scores = E.checkpoint_scores(*_points(spark, sf), ["checkpoint_id"])
    both = scores.unionByName(E.combined_accuracy(scores, ["checkpoint_id"]).select(*scores.columns))
    return both.select("checkpoint_id", "metric", F.col("numerator").cast("long").alias("numerator"), F.col("denominator").cast("long").alias("denominator"), F.round("value", 6).alias("value"))


@query(f"""WITH {_POINTS} SELECT cp AS checkpoint_id, item_id, 'wrong_state' AS why FROM j WHERE said AND proof AND (NOT status_ok OR NOT owner_ok)
UNION ALL SELECT cp, item_id, 'premature' FROM m WHERE item_id < 0 AND proof UNION ALL SELECT cp, item_id, 'unsupported' FROM cl WHERE NOT proof""")
def misleading_claims(spark, sf):
    claims, merged, states = _points(spark, sf)
    return E.misleading(E.checkpoint_rows(merged, states), claims)


@query("""WITH p AS (SELECT event_id, event_id % 7 = 0 AS again, ['create', 'supersede', 'update_owner', 'update_date', 'update_status'][1 + event_id % 5] AS t, event_id % 3 = 0 AS creates FROM events)
SELECT event_id, CASE WHEN NOT again AND t = 'create' THEN CASE WHEN creates THEN 'accept' ELSE 'treat_as_new' END ELSE 'edit_accept' END AS review_action,
  CASE WHEN again THEN 'ADD_EVIDENCE' WHEN t = 'create' AND NOT creates THEN 'CREATE' WHEN t IN ('update_owner', 'update_date') THEN 'UPDATE' END AS edited_action, CASE WHEN again THEN NULL WHEN t = 'supersede' THEN 'superseded' WHEN t = 'update_status' THEN 'completed' END AS edited_status FROM p""")
def scripted_reviews(spark, sf):
    k = F.col("event_id")
    kinds = F.array(*map(F.lit, ("create", "supersede", "update_owner", "update_date", "update_status")))
    p = table(spark, sf, "events").select("event_id", (k % 7 == 0).alias("is_repeat_mention"), F.element_at(kinds, (k % 5 + 1).cast("int")).alias("transition"), F.when(k % 3 == 0, "CREATE").otherwise("CONFLICT").alias("action"), F.lit("completed").alias("status"))
    return E.scripted_review(p).select("event_id", "review_action", "edited_action", "edited_status")


@query(f"""WITH {TRANSITIONS}, cp AS (SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-08 00:00:00'), (2, TIMESTAMP '2024-01-22 00:00:00')) AS t(checkpoint_id, cutoff)),
s AS (SELECT checkpoint_id, transitions.* FROM transitions, cp WHERE "at" < cutoff), f AS (SELECT checkpoint_id, item_id, arg_max(status, "at") FILTER (status IS NOT NULL) AS status, arg_max(owner, "at") FILTER (owner IS NOT NULL) AS owner FROM s GROUP BY ALL),
ov AS (SELECT DISTINCT checkpoint_id, item_id - 1 AS item_id FROM s WHERE event_type = 'signup' AND event_id % 50 = 0)
SELECT checkpoint_id, item_id, CASE WHEN ov.item_id IS NOT NULL THEN 'superseded' ELSE status END AS status, owner FROM f LEFT JOIN ov USING (checkpoint_id, item_id)""")
def ground_truth_states(spark, sf):
    t = transitions(spark, sf).withColumn("scope", F.lit(1)).withColumn("transition_id", F.col("event_id")).withColumn("materiality", F.lit("material"))
    t = t.withColumn("supersedes", F.when((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 0), F.col("item_id") - 1))
    mentions = t.select("transition_id", "at").union(t.where("event_id % 3 = 0").select("transition_id", F.timestamp_add("DAY", F.lit(2), "at").cast("timestamp_ntz")))
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    points = spark.range(1, 3).select(F.col("id").cast("int").alias("checkpoint_id"), F.lit(1).alias("scope"), F.when(F.col("id") == 1, stamp("2024-01-08 00:00:00")).otherwise(stamp("2024-01-22 00:00:00")).alias("cutoff"))
    return E.truth(E.visible(t, mentions, points)).select("checkpoint_id", "item_id", "status", "owner")


@query("""WITH i AS (SELECT p_brand AS scope, p_type AS kind, p_partkey AS item_id, p_name AS title FROM part WHERE p_partkey % 4 <> 0), n AS (SELECT scope, kind, title, min(item_id) AS item_id FROM i GROUP BY ALL)
SELECT p_partkey AS claim_id, n.item_id FROM part LEFT JOIN n ON p_brand = scope AND p_type = kind AND p_name = title WHERE p_partkey % 4 = 0""")
def claim_item_match(spark, sf):
    """Every fourth part is a claim, the others are items."""
    p = table(spark, sf, "part")
    return _claims_matched(p.where("p_partkey % 4 = 0"), p.where("p_partkey % 4 <> 0"))


def _claims_matched(claimed, kept):
    there = kept.select(F.col("p_brand").alias("scope"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.array().cast("array<string>").alias("aliases"))
    claims = claimed.select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("scope"), F.col("p_type").alias("kind"), F.concat(F.upper("p_name"), F.lit("!")).alias("title"))
    return E.matched(claims, there).select("claim_id", "item_id")
