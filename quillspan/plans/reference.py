"""Queries of the document-interpretation operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import cues, detect, graph, lines, mail, records
from quillspan.session import table


def text_identity(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.sha256(t).alias("text_sha256"), T.normalized_hash(t).alias("normalized_sha256"), T.n_bytes(t).alias("n_bytes"), F.char_length(t).alias("n_scalars"), T.n_tokens(t).alias("n_tokens"), T.excerpt(t, 40).alias("excerpt"))


def line_units(spark: SparkSession, d: str) -> DataFrame:
    return lines.lines(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "line_no", "byte_start", "byte_end", T.sha256(F.col("line")).alias("line_sha256"))


def line_segments(spark: SparkSession, d: str) -> DataFrame:
    return lines.segments(table(spark, d, "documents"), "doc_id", "text")


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "documents"), "doc_id", "text")


def newline_fidelity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "markdown_documents").select("md_doc_id", "decoded_text").dropDuplicates(["md_doc_id"])
    return lines.newlines(docs, "md_doc_id", "decoded_text")


def identical_texts(spark: SparkSession, d: str) -> DataFrame:
    return lines.identical(table(spark, d, "documents"), "doc_id", "text")


def thread_links(spark: SparkSession, d: str) -> DataFrame:
    return mail.links(table(spark, d, "mail_messages"))


def subject_groups(spark: SparkSession, d: str) -> DataFrame:
    return mail.subject_groups(table(spark, d, "mail_messages"))


def header_message_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "email_headers").where("normalized_name in ('message-id', 'in-reply-to') and unfolded_value is not null")
    return rows.select("header_id", F.array_join(T.message_ids(F.col("unfolded_value")), " ").alias("ids")).distinct()


def mail_zones(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "email_headers").where("normalized_name = 'date'").select("header_id", T.zone_minutes(F.col("unfolded_value")).alias("zone_minutes"))
    return rows.distinct()


def subject_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mail_messages").select("stable_id", "thread_id", "ordinal", "subject").dropDuplicates(["stable_id"])
    root = rows.where("subject is not null").groupBy("thread_id").agg(F.min_by("subject", F.struct("ordinal", "stable_id")).alias("root"))
    both = rows.where("subject is not null").join(root, "thread_id")
    a, b = T.bag(F.col("subject")), T.bag(F.col("root"))
    return both.select("stable_id", F.round(T.jaccard(a, b), 4).alias("jaccard"), F.round(T.dice(a, b), 4).alias("dice"))


def cue_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return cues.overlaps(table(spark, d, "transcript_segments"), "recording_id", "segment_index", "start_ms", "end_ms")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return cues.transcript(table(spark, d, "transcript_segments"), "recording_id", "segment_index", "start_ms", "speaker", "text")


def recording_confidence(spark: SparkSession, d: str) -> DataFrame:
    return cues.mean_confidence(table(spark, d, "transcript_segments"), "recording_id", "segment_index", "confidence")


def recording_participants(spark: SparkSession, d: str) -> DataFrame:
    return records.participants(table(spark, d, "recording_speakers"), "recording_id", "full_name")


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.document_nodes(table(spark, d, "markdown_nodes")).groupBy("graph_id", "kind").agg(F.count("*").alias("nodes"), F.count("text").alias("with_text"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.document_edges(table(spark, d, "markdown_nodes"))


def graph_violations(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "markdown_nodes")
    edges = graph.document_edges(blocks).where("relation = 'contains'")
    return graph.violations(graph.document_nodes(blocks), edges)


def reply_layers(spark: SparkSession, d: str) -> DataFrame:
    found = mail.links(table(spark, d, "mail_messages")).where("resolved")
    edges = found.select(F.lit(0).alias("graph_id"), F.col("target").alias("source"), F.col("stable_id").alias("target"))
    return graph.layers(edges).select(F.col("id").alias("stable_id"), "layer")


def event_walks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    steps = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return graph.walk_signatures(steps, "user_id", "n", "event_type").groupBy("length", "trace").agg(F.count("*").alias("walks"))


def heading_ancestry(spark: SparkSession, d: str) -> DataFrame:
    return graph.heading_paths(table(spark, d, "markdown_nodes"))


def enclosing_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "markdown_nodes").where("byte_start is not null and byte_end is not null").select(F.col("md_doc_id").alias("doc"), "id", F.col("byte_start").alias("a"), F.col("byte_end").alias("b")).dropDuplicates(["doc", "id"])
    return records.enclosing(blocks, blocks)


#: Order priority to the words of a made-up clause: trigger, modal and what is said of it.
CLAUSES = {
    "1-URGENT": ("If", "must not", "must_not", "prohibition", "forbids"), "2-HIGH": ("WHEN", "must", "must", "positive", "requires"), "3-MEDIUM": ("unless", "may", "may", "permission", "allows"),
    "4-NOT SPECIFIED": ("If", "should not", "should_not", "prohibition", "forbids"), "5-LOW": ("While", "shall", "", "", ""),
}


def obligations(spark: SparkSession, d: str) -> DataFrame:
    """Clauses written from all orders and parsed again; those that begin with "While" are none. The texts of the given
    tables hold no modal verb behind a condition."""
    trigger, modal = (F.element_at(F.create_map(*[F.lit(x) for k, v in CLAUSES.items() for x in (k, v[i])]), F.col("o_orderpriority")) for i in (0, 1))
    clause = F.concat(trigger, F.lit("  order "), F.col("o_orderkey"), F.lit(" is\n"), F.col("o_orderstatus"), F.lit(", the clerk of "), F.col("o_custkey"), F.lit(" "), modal, F.lit(" ship it, or not."))
    return table(spark, d, "orders").select("o_orderkey", T.obligation(clause).alias("o")).where("o is not null").select("o_orderkey", "o.*")


def safe_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "markdown_nodes").where("destination is not null").select("md_doc_id", "id", "destination").distinct()
    return rows.select("md_doc_id", "id", T.safe_link(F.col("destination")).alias("link"))


def cell_kinds(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "markdown_nodes").where("kind = 'table_cell'").select("md_doc_id", "id", "text").dropDuplicates(["md_doc_id", "id"])
    return records.cell_kinds(cells, "md_doc_id", "text")


def table_widths(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "markdown_nodes").where("kind = 'table_cell' and parent_id != ''").select("md_doc_id", "id", "parent_id").distinct()
    rows = cells.groupBy("md_doc_id", "parent_id").agg(F.count("*").alias("width"))
    return records.modal_width(rows, "md_doc_id", "width")


def cell_labels(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "markdown_nodes").select("md_doc_id", "id", "kind", "parent_id", "ordinal").distinct()
    rows = nodes.where("kind = 'table_row'").select("md_doc_id", F.col("id").alias("parent_id"), F.col("ordinal").alias("row"))
    cells = nodes.where("kind = 'table_cell' and ordinal is not null").join(rows.where("row is not null"), ["md_doc_id", "parent_id"])
    return cells.select("md_doc_id", "id", T.cell_label(F.col("row"), F.col("ordinal")).alias("label"))


def event_facts(spark: SparkSession, d: str) -> DataFrame:
    return records.json_facts(table(spark, d, "events"), "event_type", "props", "k")


def event_extent(spark: SparkSession, d: str) -> DataFrame:
    return records.time_extent(table(spark, d, "events"), "user_id", "ts")


def repository_identity(spark: SparkSession, d: str) -> DataFrame:
    return records.aggregate_identity(table(spark, d, "markdown_documents"), "repository", "path", "decoded_text")


def row_range(spark: SparkSession, d: str) -> DataFrame:
    return records.select_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], 500, 250, ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"])


def format_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = detect.signals(table(spark, d, "documents").where("text is not null"), "doc_id", "text", packages=False)
    return detect.candidates(found, "doc_id").select("doc_id", "format", "confidence", "decisive", "rank")


def citation_status(spark: SparkSession, d: str) -> DataFrame:
    """Headings of each document, checked against the headings of the next document of the same repository."""
    from pyspark.sql import Window

    docs = table(spark, d, "markdown_documents").select("repository", "md_doc_id").distinct()
    following = docs.withColumn("scope", F.lead("md_doc_id").over(Window.partitionBy("repository").orderBy("md_doc_id"))).where("scope is not null").select("md_doc_id", "scope")
    heads = table(spark, d, "markdown_nodes").where("kind = 'heading' and text is not null").select("md_doc_id", "id", T.normalized_hash(F.col("text")).alias("text_hash")).dropDuplicates(["md_doc_id", "id"])
    anchors = heads.join(following, "md_doc_id").select("scope", F.col("id").alias("anchor"), "text_hash")
    return records.verify_citations(anchors, heads.select(F.col("md_doc_id").alias("scope"), "id", "text_hash"))


QUERIES = {f.__name__: f for f in (
    text_identity, line_units, line_segments, repeated_lines, newline_fidelity, identical_texts, thread_links, subject_groups, header_message_ids, mail_zones, subject_similarity,
    cue_overlaps, transcripts, recording_confidence, recording_participants, graph_nodes, graph_edges, graph_violations, reply_layers, event_walks, heading_ancestry, enclosing_blocks,
    obligations, safe_links, cell_kinds, table_widths, cell_labels, event_facts, event_extent, repository_identity, row_range, format_candidates, citation_status,
)}

def _NORMAL(t: str) -> str:  # noqa: N802
    return f"regexp_replace(regexp_replace({t}, '{T.SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


_LINKS = """
WITH m AS (SELECT stable_id, any_value(message_id) AS message_id, any_value(in_reply_to) AS r FROM mail_messages GROUP BY 1),
f AS (SELECT message_id, min(stable_id) AS target FROM m WHERE message_id IS NOT NULL GROUP BY 1),
e AS (SELECT DISTINCT stable_id, unnest(r) AS reference FROM m),
l AS (SELECT e.stable_id, e.reference, f.target, f.target IS NOT NULL AS resolved FROM e LEFT JOIN f ON f.message_id = e.reference WHERE e.reference <> '')
"""
_SEGMENTS = "(SELECT recording_id, segment_index, any_value(start_ms) AS start_ms, any_value(end_ms) AS end_ms, any_value(speaker) AS speaker, any_value(text) AS text, any_value(confidence) AS confidence FROM transcript_segments GROUP BY 1, 2)"
_EDGES = """
WITH e AS (SELECT DISTINCT md_doc_id AS graph_id, parent_id AS source, 'contains' AS relation, id AS target FROM markdown_nodes WHERE parent_id <> ''
UNION SELECT DISTINCT md_doc_id, id, 'references', destination FROM markdown_nodes WHERE destination IS NOT NULL)
"""
_KIND = "CASE kind " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in graph.NODE_KINDS.items()) + " ELSE kind END"
_NODES = f"(SELECT DISTINCT md_doc_id AS graph_id, id, {_KIND} AS kind, text, ordinal, byte_start, byte_end FROM markdown_nodes)"
_LINES = r"(SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)"
_SUBJECT = "lower(" + _NORMAL("regexp_replace(trim(subject, ' '), '(?i)^((re|fw|fwd)[ ]*:[ ]*)+', '')") + ")"
_BAG = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')".format
_HEADS = ", ".join(f"max(CASE WHEN kind = 'heading' AND coalesce(level, 1) = {n} THEN {{'b': byte_start, 'i': id, 't': text}} END) OVER w AS h{n}" for n in range(1, 7))
_ALIVE = ", ".join(f"CASE WHEN h{n} IS NOT NULL " + " ".join(f"AND (h{m} IS NULL OR h{m} < h{n})" for m in range(1, n)) + f" THEN coalesce(h{n}.t, '') END" for n in range(1, 7))


def _signal(pattern: str) -> str:
    return pattern.replace("'", "''")


SQL = {
    "text_identity": f"""SELECT doc_id, 'sha256:' || sha256(text) AS text_sha256, 'sha256:' || sha256({_NORMAL('text')}) AS normalized_sha256, octet_length(encode(text)) AS n_bytes,
length(text) AS n_scalars, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS n_tokens, CASE WHEN length(text) <= 40 THEN text ELSE text[:39] || '…' END AS excerpt FROM documents""",
    "line_units": r"""WITH x AS (SELECT DISTINCT doc_id, text FROM documents), y AS (SELECT doc_id, text, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+') AS l FROM x), z AS (SELECT doc_id, text, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS line_no FROM y),
u AS (SELECT doc_id, line_no, regexp_replace(w, '[\r\n]+$', '') AS line, CAST(coalesce(sum(octet_length(encode(w))) OVER (PARTITION BY doc_id, text ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM z)
SELECT doc_id, line_no, byte_start, byte_start + octet_length(encode(line)) AS byte_end, 'sha256:' || sha256(line) AS line_sha256 FROM u""",
    "line_segments": f"""WITH RECURSIVE u AS (SELECT doc_id, list_transform(list_filter(l, lambda x: x <> ''), lambda x: octet_length(encode(x))) AS s FROM {_LINES}),
r AS (SELECT doc_id, s, 0 AS i, 0 AS size, 0 AS closed FROM u UNION ALL
SELECT doc_id, s, i + 1, CASE WHEN z >= 1000 THEN 0 ELSE z END, closed + o + CASE WHEN z >= 1000 THEN 1 ELSE 0 END FROM (
SELECT *, CASE WHEN o = 1 THEN s[i + 1] ELSE size + s[i + 1] END AS z FROM (SELECT *, CASE WHEN size > 0 AND size + s[i + 1] > 1500 THEN 1 ELSE 0 END AS o FROM r WHERE i < len(s))))
SELECT r.doc_id, len(s) AS lines, octet_length(encode(d.text)) AS n_bytes, len(regexp_extract_all(d.text, '[^ \\t\\r\\n]+')) AS n_tokens, closed + CASE WHEN size > 0 THEN 1 ELSE 0 END AS n_segments
FROM r JOIN documents d USING (doc_id) WHERE i = len(s)""",
    "repeated_lines": f"""WITH x AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\r\\n]+')) AS line FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, regexp_replace({_NORMAL('lower(line)')}, '[0-9]+', '#', 'g') AS pattern FROM x)
SELECT pattern, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM y WHERE pattern <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""",
    "newline_fidelity": r"""WITH x AS (SELECT md_doc_id, any_value(decoded_text) AS t FROM markdown_documents WHERE decoded_text IS NOT NULL GROUP BY 1),
y AS (SELECT md_doc_id, t, len(regexp_extract_all(t, '\r\n')) AS crlf, len(regexp_extract_all(t, '\n')) AS nl, len(regexp_extract_all(t, '\r')) AS cr FROM x)
SELECT md_doc_id, nl - crlf AS lf, crlf, cr - crlf AS cr, regexp_matches(t, '[\r\n]$') AS ended, (CASE WHEN nl > crlf THEN 1 ELSE 0 END + CASE WHEN crlf > 0 THEN 1 ELSE 0 END + CASE WHEN cr > crlf THEN 1 ELSE 0 END) > 1 AS mixed FROM y""",
    "identical_texts": "SELECT 'sha256:' || sha256(text) AS text_hash, min(doc_id) AS first_id, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "thread_links": _LINKS + "SELECT * FROM l",
    "subject_groups": f"SELECT k AS subject_key, count(*) AS messages, min(stable_id) AS first_id FROM (SELECT DISTINCT stable_id, {_SUBJECT} AS k FROM mail_messages) WHERE k <> '' GROUP BY 1",
    "header_message_ids": """WITH x AS (SELECT DISTINCT header_id, unfolded_value AS v FROM email_headers WHERE normalized_name IN ('message-id', 'in-reply-to') AND unfolded_value IS NOT NULL)
SELECT header_id, array_to_string(CASE WHEN regexp_matches(v, '<[^<>]*>') THEN regexp_extract_all(v, '<[^<>]*>') ELSE regexp_extract_all(v, '[^ \\t\\r\\n]+') END, ' ') AS ids FROM x""",
    "mail_zones": r"""WITH x AS (SELECT DISTINCT header_id, unfolded_value AS v FROM email_headers WHERE normalized_name = 'date'),
y AS (SELECT header_id, v, regexp_extract(v, '([+-])(\d{2})(\d{2})(?: \([^)]*\))?$', ['s', 'h', 'm']) AS z, regexp_extract(v, '\b(UT|UTC|GMT|EST|EDT|CST|CDT|MST|MDT|PST|PDT)$', 1) AS n FROM x)
SELECT header_id, CASE WHEN z.s <> '' THEN (CAST(z.h AS INTEGER) * 60 + CAST(z.m AS INTEGER)) * CASE WHEN z.s = '-' THEN -1 ELSE 1 END
WHEN n IN ('UT', 'UTC', 'GMT') THEN 0 WHEN n = 'EDT' THEN -240 WHEN n IN ('EST', 'CDT') THEN -300 WHEN n IN ('CST', 'MDT') THEN -360 WHEN n IN ('MST', 'PDT') THEN -420 WHEN n = 'PST' THEN -480 END AS zone_minutes FROM y""",
    "subject_similarity": f"""WITH m AS (SELECT stable_id, any_value(thread_id) AS t, any_value(ordinal) AS o, any_value(subject) AS s FROM mail_messages GROUP BY 1),
r AS (SELECT t, arg_min(s, (o, stable_id)) AS root FROM m WHERE s IS NOT NULL GROUP BY 1),
b AS (SELECT stable_id, {_BAG('s')} AS a, {_BAG('root')} AS b FROM m JOIN r USING (t) WHERE s IS NOT NULL),
c AS (SELECT *, len(list_distinct(a || b)) AS u, len(list_distinct(list_intersect(a, b))) AS i, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) AS sh FROM b)
SELECT stable_id, CASE WHEN u = 0 THEN 1.0 ELSE round(i / u, 4) END AS jaccard, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(2 * sh / (len(a) + len(b)), 4) END AS dice FROM c""",
    "cue_overlaps": f"""WITH x AS (SELECT recording_id AS r, segment_index AS i, start_ms AS s, end_ms AS e FROM {_SEGMENTS} WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
y AS (SELECT *, max({{'e': e, 's': -s, 'i': -i}}) OVER (PARTITION BY r ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x)
SELECT r AS recording_id, i AS segment_index, -top.i AS other_index, least(e, top.e) - s AS overlap_ms FROM y WHERE s < top.e""",
    "transcripts": f"""WITH h AS (SELECT recording_id, floor(start_ms / 300000) AS w, count(*) AS n, sha256(string_agg(CASE WHEN speaker <> '' THEN speaker || ': ' || text ELSE text END, chr(10) ORDER BY start_ms NULLS FIRST, segment_index)) AS x
FROM {_SEGMENTS} WHERE text IS NOT NULL GROUP BY 1, 2) SELECT recording_id, CAST(sum(n) AS BIGINT) AS lines, sha256(string_agg(x, chr(10) ORDER BY w NULLS FIRST)) AS transcript_sha256 FROM h GROUP BY 1""",
    "recording_confidence": f"SELECT recording_id, floor(coalesce(least(greatest(sum(CAST(round(confidence * 1000000) AS BIGINT)) / count(confidence) / 1000000, 0.0), 1.0), 0.0) * 10000 + 0.5) / 10000 AS confidence FROM {_SEGMENTS} GROUP BY 1",
    "recording_participants": "SELECT recording_id, string_agg(DISTINCT full_name, '|' ORDER BY full_name) AS names FROM recording_speakers WHERE full_name IS NOT NULL GROUP BY 1",
    "graph_nodes": f"SELECT graph_id, kind, count(*) AS nodes, count(text) AS with_text, CAST(sum(byte_end - byte_start) AS BIGINT) AS bytes FROM {_NODES} GROUP BY 1, 2",
    "graph_edges": _EDGES + "SELECT * FROM e",
    "graph_violations": _EDGES + f""", c AS (SELECT * FROM e WHERE relation = 'contains'), i AS (SELECT graph_id, id, count(*) AS n FROM {_NODES} GROUP BY 1, 2)
SELECT graph_id, 'empty_id' AS rule, '' AS subject, n FROM i WHERE id IS NULL OR id = '' UNION ALL
SELECT graph_id, 'duplicate_id', id, n FROM i WHERE n > 1 AND id <> '' UNION ALL
SELECT graph_id, 'unknown_endpoint', id, count(*) FROM (SELECT graph_id, unnest([source, target]) AS id FROM c) x ANTI JOIN i USING (graph_id, id) GROUP BY 1, 2, 3 UNION ALL
SELECT graph_id, 'self_loop', source, count(*) FROM c WHERE source = target GROUP BY 1, 2, 3 UNION ALL
SELECT graph_id, 'parallel_edge', source || '>' || target, count(*) FROM c GROUP BY graph_id, source, target HAVING count(*) > 1""",
    "reply_layers": _LINKS.replace("WITH", "WITH RECURSIVE", 1) + """, g AS (SELECT DISTINCT target AS a, stable_id AS b FROM l WHERE resolved),
p AS (SELECT a AS id, 0 AS k, [a] AS path FROM (SELECT a FROM g UNION SELECT b FROM g) n WHERE a NOT IN (SELECT b FROM g) UNION ALL SELECT g.b, k + 1, list_append(path, g.b) FROM p JOIN g ON g.a = p.id WHERE NOT list_contains(path, g.b))
SELECT id AS stable_id, CAST(max(k) AS INTEGER) AS layer FROM p GROUP BY 1""",
    "event_walks": """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, min(n) OVER (PARTITION BY user_id, event_type) AS f FROM s), r AS (SELECT user_id, n, dense_rank() OVER (PARTITION BY user_id ORDER BY f) - 1 AS r FROM f),
w AS (SELECT user_id, count(*) AS length, string_agg(CAST(r AS VARCHAR), '.' ORDER BY n) AS trace FROM r GROUP BY 1) SELECT length, trace, count(*) AS walks FROM w GROUP BY 1, 2""",
    "heading_ancestry": f"""WITH b AS (SELECT md_doc_id, id, any_value(kind) AS kind, any_value(level) AS level, any_value(text) AS text, any_value(byte_start) AS byte_start FROM markdown_nodes WHERE byte_start IS NOT NULL GROUP BY 1, 2),
h AS (SELECT md_doc_id, id, {_HEADS} FROM b WINDOW w AS (PARTITION BY md_doc_id ORDER BY byte_start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT md_doc_id AS graph_id, id, array_to_string(list_filter([{_ALIVE}], lambda x: x IS NOT NULL), ' > ') AS path FROM h""",
    "enclosing_blocks": """WITH b AS (SELECT md_doc_id AS doc, id, any_value(byte_start) AS a, any_value(byte_end) AS b FROM markdown_nodes WHERE byte_start IS NOT NULL AND byte_end IS NOT NULL GROUP BY 1, 2)
SELECT i.doc, i.id, arg_min(o.id, (o.b - o.a, o.id)) AS holder FROM b i LEFT JOIN b o ON o.doc = i.doc AND o.a <= i.a AND i.b <= o.b AND o.b > o.a AND NOT (o.a = i.a AND o.b = i.b) GROUP BY 1, 2""",
    "obligations": "SELECT o_orderkey, c.a AS trigger, 'order ' || o_orderkey || ' is ' || o_orderstatus AS condition, 'the clerk of ' || o_custkey AS subject, c.b AS modality, c.c AS polarity, 'ship it, or not' AS action, c.d AS relation FROM orders JOIN (VALUES "
    + ", ".join(f"('{k}', '{v[0].lower()}', '{v[2]}', '{v[3]}', '{v[4]}')" for k, v in CLAUSES.items() if v[2])
    + ") c(k, a, b, c, d) ON c.k = o_orderpriority",
    "safe_links": r"""SELECT DISTINCT md_doc_id, id, CASE WHEN regexp_matches(lower(regexp_replace(destination, '[\x00-\x20\x7f]', '', 'g')), '^(javascript:|vbscript:|file:|data:text/html|data:image/svg\+xml)') THEN '#blocked-active-uri'
ELSE replace(replace(destination, '(', '%28'), ')', '%29') END AS link FROM markdown_nodes WHERE destination IS NOT NULL""",
    "cell_kinds": r"""WITH c AS (SELECT md_doc_id, id, any_value(text) AS text FROM markdown_nodes WHERE kind = 'table_cell' GROUP BY 1, 2), t AS (SELECT md_doc_id, trim(text, ' ') AS t FROM c)
SELECT md_doc_id, CASE WHEN t IS NULL OR lower(t) IN ('', 'null', 'na', 'n/a') THEN 'null' WHEN lower(t) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(t, '^-?(0|[1-9][0-9]{0,17})$') THEN 'integer'
WHEN regexp_matches(t, '^-?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$') THEN 'decimal' WHEN regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' WHEN regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}') THEN 'date-time' ELSE 'text' END AS value_kind, count(*) AS cells FROM t GROUP BY 1, 2""",
    "table_widths": """WITH c AS (SELECT DISTINCT md_doc_id, id, parent_id FROM markdown_nodes WHERE kind = 'table_cell' AND parent_id <> ''), r AS (SELECT md_doc_id, parent_id, count(*) AS w FROM c GROUP BY 1, 2), e AS (SELECT md_doc_id, w, count(*) AS n FROM r GROUP BY 1, 2)
SELECT md_doc_id, arg_max(w, (n, w)) AS modal_width, max(n) AS rows, CAST(sum(n) - max(n) AS BIGINT) AS ragged FROM e GROUP BY 1""",
    "cell_labels": """WITH n AS (SELECT DISTINCT md_doc_id, id, kind, parent_id, ordinal FROM markdown_nodes)
SELECT c.md_doc_id, c.id, CASE WHEN c.ordinal >= 702 THEN chr(CAST(65 + (c.ordinal - 702) // 676 % 26 AS INTEGER)) ELSE '' END || CASE WHEN c.ordinal >= 26 THEN chr(CAST(65 + (c.ordinal - 26) // 26 % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + c.ordinal % 26 AS INTEGER)) || CAST(r.ordinal + 1 AS VARCHAR) AS label
FROM n c JOIN n r ON r.md_doc_id = c.md_doc_id AND r.id = c.parent_id WHERE c.kind = 'table_cell' AND r.kind = 'table_row' AND c.ordinal IS NOT NULL AND r.ordinal IS NOT NULL""",
    "event_facts": "WITH x AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS records, count(k) AS present, count(DISTINCT k) AS values, min(k) AS low, max(k) AS high FROM x GROUP BY 1",
    "event_extent": "SELECT user_id, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1",
    "repository_identity": """WITH x AS (SELECT DISTINCT repository, path, coalesce(octet_length(encode(decoded_text)), 0) AS n, coalesce('sha256:' || sha256(decoded_text), 'none') AS h FROM markdown_documents WHERE path IS NOT NULL),
l AS (SELECT repository, left(sha256(path), 2) AS leaf, count(*) AS m, sum(n) AS n, 'sha256:' || sha256(string_agg(path || ' ' || n || ' ' || h, chr(10) ORDER BY path || ' ' || n || ' ' || h)) AS x FROM x GROUP BY 1, 2)
SELECT repository, CAST(sum(m) AS BIGINT) AS members, CAST(sum(n) AS BIGINT) AS bytes, 'sha256:' || sha256(string_agg(leaf || ' ' || x, chr(10) ORDER BY leaf)) AS identity FROM l GROUP BY 1""",
    "row_range": "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 250 OFFSET 500",
    "format_candidates": r"""WITH d AS (SELECT doc_id, text, upper(hex(encode(text)))[:1024] AS h, list_transform(list_filter(regexp_split_to_array(text, '\r\n|\r|\n')[1:63], lambda x: x <> '')[1:8], lambda x: regexp_replace(x, '"[^"]*"', '', 'g')) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, h, l, list_transform(l, lambda x: length(x) - length(replace(x, ',', ''))) AS c, list_transform(l, lambda x: length(x) - length(replace(x, chr(9), ''))) AS t FROM d),
m AS (SELECT doc_id, CASE """ + " ".join(f"WHEN regexp_matches(h, '{p}') THEN {{'format': '{f}', 'evidence': '{e}', 'w': {w}}}" for f, e, p, w in ((f, e, p, w) for f, p, e, w in detect.MAGIC)) + """ END AS x FROM w),
r AS (""" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS format, '{e}' AS evidence, {w} AS w FROM w WHERE regexp_matches(text, '{_signal(p)}')" for f, e, p, w in detect.SIGNALS) + """
UNION ALL SELECT doc_id, 'csv', 'equal widths', 0.62 FROM w WHERE len(l) >= 2 AND len(list_distinct(c)) = 1 AND c[1] > 0 UNION ALL SELECT doc_id, 'tsv', 'equal widths', 0.62 FROM w WHERE len(l) >= 2 AND len(list_distinct(t)) = 1 AND t[1] > 0),
s AS (SELECT *, false AS decisive FROM r UNION ALL SELECT doc_id, 'text', 'decodes as text', 0.44, false FROM w WHERE doc_id NOT IN (SELECT doc_id FROM r) UNION ALL SELECT doc_id, x.format, x.evidence, x.w, true FROM m WHERE x IS NOT NULL),
c AS (SELECT doc_id, format, round(1 - exp(sum(ln(1 - w))) + 1e-9, 4) AS c, bool_or(decisive) AS decisive FROM s GROUP BY 1, 2),
k AS (SELECT doc_id, format, decisive, CASE WHEN NOT decisive AND bool_or(decisive) OVER (PARTITION BY doc_id) THEN least(c, 0.84) ELSE c END AS confidence FROM c)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, format) AS rank FROM k WHERE confidence >= 0.1""",
    "citation_status": f"""WITH d AS (SELECT DISTINCT repository, md_doc_id FROM markdown_documents), f AS (SELECT md_doc_id, lead(md_doc_id) OVER (PARTITION BY repository ORDER BY md_doc_id) AS scope FROM d),
h AS (SELECT md_doc_id, id, 'sha256:' || sha256({_NORMAL('any_value(text)')}) AS x FROM markdown_nodes WHERE kind = 'heading' AND text IS NOT NULL GROUP BY 1, 2),
a AS (SELECT f.scope, h.id AS anchor, h.x FROM h JOIN f USING (md_doc_id) WHERE f.scope IS NOT NULL), n AS (SELECT md_doc_id, x, count(*) AS n FROM h GROUP BY 1, 2)
SELECT a.scope, a.anchor, CASE WHEN s.x = a.x THEN 'exact' WHEN n.n = 1 THEN 'relocated' WHEN n.n > 1 THEN 'ambiguous' WHEN s.x IS NOT NULL THEN 'changed' ELSE 'missing' END AS status
FROM a LEFT JOIN h s ON s.md_doc_id = a.scope AND s.id = a.anchor LEFT JOIN n ON n.md_doc_id = a.scope AND n.x = a.x""",
}
