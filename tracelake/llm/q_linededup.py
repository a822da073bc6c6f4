"""Query of operator 5 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import documents
from tracelake.llm.linededup import drop_repeated_lines


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i, lines[i + 1 : i + 3] AS window_lines
  FROM (SELECT doc_id, lines, unnest(range(greatest(len(lines) - 3, 0) + 1)) AS i FROM d WHERE text <> '')
),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY window_lines ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1
),
covered AS (SELECT DISTINCT doc_id, i + k AS line FROM later, (SELECT unnest(range(3)) AS k)),
l AS (
  SELECT d.doc_id, u.line, d.lines[u.line + 1] AS content, c.line IS NOT NULL AS gone
  FROM d, LATERAL (SELECT unnest(range(len(d.lines))) AS line) u
  LEFT JOIN covered c ON c.doc_id = d.doc_id AND c.line = u.line
)
SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (gone) AS INT) AS n_removed,
  sha256(coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS text_sha256
FROM l GROUP BY doc_id
"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {"op5_line_dedup": ORACLE}
