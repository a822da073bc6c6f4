"""Query of operator 7 and its SQL: a fixity drill over all pages.

Two replicas of the WARC volumes are written; in the second, one stored byte changes in every record whose page_id is divisible
by DRILL. The audit must name just these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import Workspace
from tracelake.llm.warc import DATE, ESCAPED, audit, leaves, placed, records, write_volumes

DRILL = 61


def _damage(page_id: int | None, data: bytes) -> bytes:
    if page_id is None or page_id % DRILL:
        return data
    at = len(data) // 2
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "op7")
    table = records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    manifest = workspace.save("manifest", write_volumes(table, {workspace.path("one"): None, workspace.path("two"): _damage}))
    wrong = audit(leaves(manifest, 0, 1), workspace)
    out = placed(manifest).join(wrong, ["volume", "number"], "left")
    return out.select("page_id", "record_no", "start", "length", "record_sha256", F.coalesce("status", F.lit("sound")).alias("status"))


_URL = "coalesce(url, '')"
for _char, _code in ESCAPED.items():
    _URL = f"replace({_URL}, chr({ord(_char)}), '{_code}')"
_LINE = "|| chr(13) || chr(10) ||"

ORACLE = f"""
WITH p AS (SELECT page_id, {_URL} AS url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
n AS (SELECT *, sha256(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), url, digest)) AS name FROM p),
r AS (
  SELECT page_id, url, digest, 'WARC/1.1' {_LINE} 'WARC-Type: resource' {_LINE}
    'WARC-Record-ID: <urn:uuid:' || concat_ws('-', substr(name, 1, 8), substr(name, 9, 4), '8' || substr(name, 14, 3), '8' || substr(name, 18, 3), substr(name, 21, 12)) || '>' {_LINE}
    'WARC-Target-URI: ' || url {_LINE} 'WARC-Date: {DATE}' {_LINE} 'WARC-Payload-Digest: sha256:' || digest {_LINE}
    'Content-Type: text/html' {_LINE} 'Content-Length: ' || strlen(html) {_LINE} '' {_LINE} html {_LINE} '' {_LINE} '' AS record
  FROM n
)
SELECT page_id, row_number() OVER w - 1 AS record_no,
  CAST(coalesce(sum(strlen(record)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start",
  strlen(record) AS length, sha256(record) AS record_sha256,
  CASE WHEN page_id % {DRILL} = 0 THEN 'corrupt' ELSE 'sound' END AS status
FROM r WINDOW w AS (ORDER BY page_id NULLS FIRST, url, digest)
"""

QUERIES = {"op7_warc_fixity": op7_warc_fixity}
ORACLES = {"op7_warc_fixity": ORACLE}
