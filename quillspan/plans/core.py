"""Queries of the general data-processing operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import hierarchy as H
from quillspan.operators import intervals as I
from quillspan.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return H.endless_nodes(table(spark, d, "markdown_nodes"), "md_doc_id", "id", "parent_id")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(table(spark, d, "markdown_nodes"), "md_doc_id", "id", "parent_id")
    return tree.select("md_doc_id", "id", F.array_join("path", "/").alias("path"), "depth", "root", "status")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(table(spark, d, "markdown_nodes"), "md_doc_id", "id", "parent_id"), "md_doc_id", "id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = I.gaps(table(spark, d, "transcript_segments"), "recording_id", "start_ms", "end_ms")
    return found.withColumnsRenamed({"gap_start": "gap_start_ms", "gap_end": "gap_end_ms"})


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    found = I.periods(table(spark, d, "transcript_segments"), "recording_id", "start_ms", "end_ms")
    return found.withColumnsRenamed({"period_start": "period_start_ms", "period_end": "period_end_ms"})


QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p5_found": p5_found, "p5_periods": p5_periods}

_TREE = """
WITH RECURSIVE n AS (
  SELECT md_doc_id AS d, id, min(nullif(parent_id, '')) AS p FROM markdown_nodes WHERE md_doc_id IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT n.d, n.id, n.p, m.id AS q FROM n LEFT JOIN n m ON m.d = n.d AND m.id = n.p),
t AS (
  SELECT d, id, [id] AS path, CASE WHEN p IS NULL THEN 'root' ELSE 'orphan' END AS status FROM l WHERE q IS NULL
  UNION ALL SELECT l.d, l.id, list_append(t.path, l.id), 'child' FROM t JOIN l ON l.d = t.d AND l.q = t.id)
"""

_COVER = """
WITH s AS (SELECT DISTINCT recording_id AS r, start_ms AS a, end_ms AS b FROM transcript_segments WHERE end_ms > start_ms),
m AS (SELECT *, max(b) OVER (PARTITION BY r ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s)
"""

SQL = {
    "p4_found": _TREE + "SELECT n.d AS md_doc_id, n.id FROM n ANTI JOIN t ON t.d = n.d AND t.id = n.id",
    "p4_paths": _TREE
    + """SELECT d AS md_doc_id, id, array_to_string(path, '/') AS path, CAST(len(path) - 1 AS INTEGER) AS depth, path[1] AS root, status FROM t
UNION ALL SELECT n.d, n.id, NULL, NULL, NULL, 'endless' FROM n ANTI JOIN t ON t.d = n.d AND t.id = n.id""",
    "p4_descendants": _TREE
    + """, x AS (SELECT d, id, path, unnest(range(1, len(path))) AS i FROM t)
SELECT d AS md_doc_id, path[i] AS id, id AS descendant, CAST(len(path) - i AS INTEGER) AS distance FROM x""",
    "p5_found": _COVER + "SELECT r AS recording_id, prev AS gap_start_ms, a AS gap_end_ms FROM m WHERE a > prev",
    "p5_periods": _COVER
    + """, g AS (SELECT *, sum(CASE WHEN prev >= a THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT r AS recording_id, min(a) AS period_start_ms, max(b) AS period_end_ms FROM g GROUP BY r, k""",
}
