"""Queries of scalar functions, reconciliation, rendering, budgets and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import values as V
from quillspan.operators import citations, extension, graph, lines, reconcile, render, summary
from quillspan.session import table
from quillspan.streaming import protocol


def cell_places(spark: SparkSession, d: str) -> DataFrame:
    """Labels of cells written from all order lines and read back."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(5000)).cast("int").alias("column"), F.pmod("l_suppkey", F.lit(9000)).cast("int").alias("row"))
    label = T.cell_label(F.col("row"), F.col("column"))
    return rows.select("l_orderkey", "l_linenumber", T.cell_place(label).alias("p"), T.cell_place(F.concat(F.lit("$"), label, F.lit("!"))).alias("none")).select("l_orderkey", "l_linenumber", "p.row", "p.column", F.col("none.row").alias("none")).distinct()


def transferred(spark: SparkSession, d: str) -> DataFrame:
    """Names written in base64, as percent escapes and as character references, and read back."""
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" <é&+>")).alias("t"))
    b64 = V.transfer(F.encode(F.base64(F.encode("t", "UTF-8")), "UTF-8"), F.lit("base64"))
    return rows.select("c_custkey", b64["body"].cast("string").alias("base64"), T.percent_decoded(F.replace(F.url_encode("t"), F.lit("+"), F.lit("%20"))).alias("percent"), V.entities_decoded(T.escape_html(F.col("t"))).alias("entities"), V.header_decoded(F.concat(F.lit("=?utf-8?b?"), F.base64(F.encode("t", "UTF-8")), F.lit("?="))).alias("header"))


def member_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of archive members of six shapes, one for each order."""
    k = F.col("o_orderkey")
    shapes = [F.concat(F.lit("a/./b"), k.cast("string"), F.lit("\\c")), F.concat(F.lit("/x"), k.cast("string")), F.concat(F.lit("a/../"), k.cast("string")), F.concat(F.lit("C:"), k.cast("string")), F.concat(F.lit("a\x02"), k.cast("string")), F.concat(F.lit("//"), F.lit("ok"))]
    path = F.element_at(F.array(*shapes), (F.pmod(k, F.lit(6)) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.member_path(path).alias("m")).select("o_orderkey", "m.path", "m.reason")


def formula_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells named by a formula for each part."""
    n = F.col("p_size").cast("string")
    formula = F.concat(F.lit("SUM($B$"), n, F.lit(":C9)+a"), n, F.lit('*LOG10(2)&"Z9"+A'), n)
    return table(spark, d, "part").select("p_partkey", F.array_join(V.formula_references(formula), ",").alias("cells"))


def association_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.association_key(F.col("text")), 256).alias("sha256"))


def list_lines(spark: SparkSession, d: str) -> DataFrame:
    """List markers and captions among all lines of documents."""
    rows = lines.lines(table(spark, d, "documents"), "doc_id", "text")
    found = rows.select("doc_id", T.list_marker(F.col("line")).alias("m"), T.caption_kind(F.col("line")).alias("caption"))
    return found.where("m is not null or caption is not null").groupBy("m.marker", "m.ordered", "caption").agg(F.count("*").alias("lines"))


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """How far the boxes of order lines overlap a fixed one."""
    q = F.col("l_quantity")
    value = T.box_overlap((q, q, q * 2, q * 3), (F.lit(10.0), F.lit(20.0), F.lit(60.0), F.lit(90.0)))
    return table(spark, d, "lineitem").groupBy(F.round(value, 6).alias("overlap")).agg(F.count("*").alias("lines"))


def page_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of boxes of each order, and how many boxes each has."""
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("l"), (F.col("l_quantity") + 1 + F.col("l_linenumber")).alias("r"))
    return reconcile.columns(boxes).groupBy("page", "column").agg(F.count("*").alias("boxes"), F.min("l").alias("l"), F.max("r").alias("r"))


def transcript_union(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each recording as native cues, and those with confidence again as an attempt; attempts of recordings
    divisible by three failed."""
    rows = table(spark, d, "transcript_segments").select(F.col("recording_id").alias("media"), F.col("segment_index").alias("item"), "start_ms", "end_ms", "text", "confidence").dropDuplicates(["media", "item"])
    tries = rows.where("confidence is not null").select("media", F.lit("p").alias("provider"), F.when(F.col("media") % 3 == 0, "failed").otherwise("succeeded").alias("status"), "item", "start_ms", "end_ms", "text")
    return reconcile.transcripts(rows, tries).groupBy("media", "origin").agg(F.count("*").alias("cues"), F.min("position").alias("first"), F.max("position").alias("last"))


def rendered_texts(spark: SparkSession, d: str) -> DataFrame:
    """Plain text of headings, paragraphs and list items of each document, and where its source map ends."""
    nodes = table(spark, d, "markdown_nodes").where("kind in ('heading', 'paragraph', 'list_item') and byte_start is not null").dropDuplicates(["md_doc_id", "id"])
    rows = nodes.select(F.col("md_doc_id").alias("doc"), "id", "kind", "text", "level", F.lit(None).cast("array<string>").alias("cells"), F.col("byte_start").alias("place"))
    text = render.render(rows, "text").select("doc", F.sha2("text", 256).alias("sha256"))
    ends = render.source_map(rows, "text").groupBy("doc").agg(F.max("end").alias("bytes"))
    return text.join(ends, "doc")


def node_order(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "markdown_nodes").select(F.col("md_doc_id").alias("graph_id"), "id", F.col("parent_id").alias("parent"), "ordinal", "byte_start").where("id is not null")
    return graph.canonical_keys(nodes).select("graph_id", "id", F.sha2("key", 256).alias("key"))


def source_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang is not null").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return citations.duplicate_keys(table(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_type").alias("key")))


def budget_usage(spark: SparkSession, d: str) -> DataFrame:
    """Sums and maxima of order lines against a budget, and what went over."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("nodes"), F.col("l_linenumber").alias("depth"))
    budget = extension.Budget(nodes=150, depth=5)
    over = budget.exhausted(rows, "l_orderkey").select("l_orderkey", F.split_part("code", F.lit("."), F.lit(2)).alias("axis"), F.lit(True).alias("over"))
    return budget.usage(rows, "l_orderkey").join(over, ["l_orderkey", "axis"], "left").withColumn("over", F.coalesce("over", F.lit(False)))


def replayed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers for the documents with an even number, asked for by content of all."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    recorded = docs.where("doc_id % 2 = 0").select(extension.request_digest("ocr", F.encode("text", "UTF-8"), {"lang": "en"}).alias("digest"), F.lit("succeeded").alias("status"), F.lit(None).cast("string").alias("error"), F.lit("[]").alias("items"))
    return extension.replay(docs, "doc_id", "text", "ocr", recorded, {"lang": "en", "api_key": "x"}).select("doc_id", "status")


def stream_problems(spark: SparkSession, d: str) -> DataFrame:
    """Streams of each user's events; the first event of every fifth user is left out, the terminal of every seventh."""
    events = protocol.emitted(table(spark, d, "events"), "user_id", ["ts", "event_id"])
    broken = events.where("not (stream % 5 = 0 and event = 'item' and sequence = 0)").where("not (stream % 7 = 0 and event = 'terminal')")
    return protocol.problems(broken)


def value_structure(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a value for each order."""
    text = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "l": ['), F.array_join(F.array_repeat(F.lit('{"x": null}'), F.pmod("o_custkey", F.lit(4)).cast("int")), ","), F.lit('], "s": ["a", true]}'))
    facts = summary.structure(table(spark, d, "orders").withColumn("v", text), "o_orderkey", "v")
    return facts.groupBy("objects", "arrays", "nulls", "booleans", "numbers", "strings", "depth").agg(F.count("*").alias("orders"))


QUERIES = {f.__name__: f for f in (
    cell_places, transferred, member_paths, formula_cells, association_keys, list_lines, box_overlaps, page_columns, transcript_union, rendered_texts, node_order, source_languages, repeated_keys, budget_usage, replayed_answers, stream_problems, value_structure,
)}

_SEGMENTS = "(SELECT recording_id AS media, segment_index AS item, any_value(confidence) AS c FROM transcript_segments GROUP BY 1, 2)"
SQL = {
    "cell_places": 'SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_suppkey % 9000 AS INTEGER) AS "row", CAST(l_partkey % 5000 AS INTEGER) AS "column", CAST(NULL AS INTEGER) AS none FROM lineitem',
    "transferred": "SELECT c_custkey, t AS base64, t AS percent, t AS entities, t AS header FROM (SELECT c_custkey, c_name || ' <é&+>' AS t FROM customer)",
    "member_paths": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'a/b' || o_orderkey || '/c' END AS path, ['absolute_path', 'parent_traversal', 'absolute_path', 'control_character', 'absolute_path'][o_orderkey % 6] AS reason FROM orders""",
    "formula_cells": "SELECT p_partkey, array_to_string(list_sort(['A' || p_size, 'B' || p_size || ':C9']), ',') AS cells FROM part",
    "association_keys": r"SELECT doc_id, sha256(trim(regexp_replace(lower(replace(text, 'İ', 'i' || chr(775))), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')) AS sha256 FROM documents WHERE text IS NOT NULL",
    "list_lines": r"""WITH l AS (SELECT unnest(regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+')) AS x FROM (SELECT DISTINCT doc_id, text FROM documents)), m AS (SELECT regexp_replace(x, '[\r\n]+$', '') AS x FROM l),
f AS (SELECT regexp_extract(x, '^\s*(\S+)(?:\s|$)', 1) AS w, CASE WHEN regexp_matches(x, '(?i)^\s*(figure|fig\.?)\s*[0-9ivxlc]+') THEN 'figure' WHEN regexp_matches(x, '(?i)^\s*(table|tab\.)\s*[0-9ivxlc]+') THEN 'table' END AS caption FROM m),
k AS (SELECT caption, w IN ('-', '*', '+', '•', '‣', '◦', '▪') AS b, regexp_matches(w, '^\(?(?:[0-9]+|[ivxlcdmIVXLCDM]{1,4}|[A-Za-z])[.):]$') AS o, w FROM f)
SELECT CASE WHEN b OR o THEN w END AS marker, CASE WHEN b OR o THEN o END AS ordered, caption, count(*) AS lines FROM k WHERE b OR o OR caption IS NOT NULL GROUP BY 1, 2, 3""",
    "box_overlaps": """WITH x AS (SELECT l_quantity AS q FROM lineitem), y AS (SELECT q, greatest(0, least(2 * q, 60) - greatest(q, 10)) * greatest(0, least(3 * q, 90) - greatest(q, 20)) AS s FROM x)
SELECT CASE WHEN q * q * 2 > 0 THEN round(s / least(q * q * 2, 3500), 6) END AS overlap, count(*) AS lines FROM y GROUP BY 1""",
    "page_columns": """WITH b AS (SELECT l_orderkey AS page, l_quantity AS l, l_quantity + 1 + l_linenumber AS r FROM lineitem), m AS (SELECT *, max(r) OVER (PARTITION BY page ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM b),
n AS (SELECT *, sum(CASE WHEN c IS NULL OR least(c, r) - l < 0.35 * (r - l) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY l, r ROWS UNBOUNDED PRECEDING) - 1 AS k FROM m) SELECT page, CAST(k AS BIGINT) AS "column", count(*) AS boxes, min(l) AS l, max(r) AS r FROM n GROUP BY 1, 2""",
    "transcript_union": f"""WITH s AS (SELECT media, count(*) AS n, count(c) AS t FROM {_SEGMENTS} GROUP BY 1) SELECT media, 'native' AS origin, n AS cues, 0 AS first, CAST(n - 1 AS INTEGER) AS last FROM s WHERE t > 0 AND media % 3 <> 0
UNION ALL SELECT media, 'provider', t, CAST(n AS INTEGER), CAST(n + t - 1 AS INTEGER) FROM s WHERE t > 0 AND media % 3 <> 0""",
    "rendered_texts": """WITH n AS (SELECT md_doc_id AS doc, id, any_value(text) AS t, any_value(byte_start) AS b FROM markdown_nodes WHERE kind IN ('heading', 'paragraph', 'list_item') AND byte_start IS NOT NULL GROUP BY 1, 2),
x AS (SELECT doc, string_agg(coalesce(t, ''), chr(10) || chr(10) ORDER BY b, id) || chr(10) AS t FROM n GROUP BY 1) SELECT doc, sha256(t) AS sha256, CAST(octet_length(encode(t)) AS BIGINT) AS bytes FROM x""",
    "node_order": """WITH RECURSIVE r AS (SELECT md_doc_id AS d, id, nullif(parent_id, '') AS p, lpad(coalesce(CAST(ordinal AS VARCHAR), '9999999999'), 10, '0') AS o, lpad(coalesce(CAST(byte_start AS VARCHAR), '9999999999999'), 13, '0') AS a FROM markdown_nodes WHERE id IS NOT NULL),
n AS (SELECT d, id, x.p AS p, x.o || chr(31) || x.a || chr(31) || id AS k FROM (SELECT d, id, first({'p': p, 'o': o, 'a': a} ORDER BY p NULLS FIRST, o, a) AS x FROM r GROUP BY 1, 2)),
t AS (SELECT d, id, k FROM n WHERE p IS NULL OR (d, p) NOT IN (SELECT (d, id) FROM n) UNION ALL SELECT n.d, n.id, t.k || chr(30) || n.k FROM t JOIN n ON n.d = t.d AND n.p = t.id)
SELECT n.d AS graph_id, n.id, sha256(coalesce(t.k, chr(127) || n.id)) AS key FROM n LEFT JOIN t USING (d, id)""",
    "source_languages": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "repeated_keys": "SELECT p_brand AS scope, p_type AS key, count(*) AS entries FROM part GROUP BY 1, 2 HAVING count(*) > 1",
    "budget_usage": """WITH u AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS n, max(l_linenumber) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, 'nodes' AS axis, n AS used, 150::BIGINT AS "limit", n > 150 AS over FROM u UNION ALL SELECT l_orderkey, 'depth', d, 5, d > 5 FROM u""",
    "replayed_answers": "SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) THEN 'succeeded' ELSE 'not_recorded' END AS status FROM documents WHERE text IS NOT NULL",
    "stream_problems": """WITH u AS (SELECT user_id AS stream, count(*) AS n FROM events GROUP BY 1) SELECT stream, 'sequence_gap' AS problem FROM u WHERE stream % 5 = 0 AND n > 1
UNION ALL SELECT stream, 'count_mismatch' FROM u WHERE stream % 5 = 0 AND stream % 7 <> 0 UNION ALL SELECT stream, 'missing_terminal' FROM u WHERE stream % 7 = 0""",
    "value_structure": "SELECT CAST(1 + m AS INTEGER) AS objects, 2 AS arrays, CAST(m AS INTEGER) AS nulls, 1 AS booleans, 1 AS numbers, 1 AS strings, CASE WHEN m > 0 THEN 4 ELSE 3 END AS depth, count(*) AS orders FROM (SELECT o_custkey % 4 AS m FROM orders) GROUP BY m",
}
