"""Queries of the format parsers and their SQL.

Their inputs are written from all rows of the given tables by Spark expressions and read back by a parser, so the SQL can
take the expected rows from the tables themselves and shares nothing with the parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.formats.base import parse, statuses
from quillspan.operators import analysis, citations, decode, detect, schemas, segments
from quillspan.session import table

# Kinds of Markdown nodes whose ranges the table gives as this parser does.
MARKDOWN_KINDS = ("block_quote", "code_fence", "display_math", "footnote_definition", "inline_code", "inline_math", "table", "table_row", "table_cell", "thematic_break")


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(df: DataFrame, key: str, order: Column, line: Column, sep: str) -> DataFrame:
    """key and the lines of its rows in an order."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("x")))).alias("l"))
    return rows.select(key, F.array_join(F.transform("l", lambda p: p["x"]), sep).alias("text"))


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "markdown_documents").select("md_doc_id", "decoded_text").where("decoded_text is not null").dropDuplicates(["md_doc_id"])
    return parse(docs, "md_doc_id", "decoded_text", "markdown").where(F.col("kind").isin(*MARKDOWN_KINDS)).select("md_doc_id", "kind", "byte_start", "byte_end").distinct()


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return parse(table(spark, d, "documents").where("text is not null"), "doc_id", "text", "text").where("kind = 'paragraph'").groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.octet_length("value")).alias("bytes"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """A file for each customer, CRLF between records, quoted cells with line ends, delimiters and quotes."""
    line = _line(F.col("o_orderkey"), ";", F.col("day"), ';"', F.col("o_orderpriority"), '; ""', F.col("o_orderstatus"), '""\n"')
    files = _joined(_orders(spark, d), "o_custkey", F.col("o_orderkey"), line, "\r\n").withColumn("text", F.concat(F.lit("key;day;note\r\n"), "text"))
    cells = parse(files, "o_custkey", "text", "csv")
    records = cells.where("kind = 'record'").select("o_custkey", F.col("node").alias("parent"), F.col("name").cast("int").alias("record"))
    return cells.where("kind = 'cell'").join(records, ["o_custkey", "parent"]).select("o_custkey", "record", F.col("name").alias("column"), "value", _attr("type").alias("type"))


def csv_dialects(spark: SparkSession, d: str) -> DataFrame:
    """The delimiter found in a file of each nation's customers, which differs from nation to nation."""
    sep = F.element_at(F.array(*map(F.lit, (",", "\t", ";", "|"))), F.pmod(F.col("c_nationkey"), F.lit(4)) + 1)
    line = F.concat_ws("", F.col("c_custkey").cast("string"), sep, F.col("c_name"), sep, F.col("c_mktsegment"))
    files = _joined(table(spark, d, "customer"), "c_nationkey", F.col("c_custkey"), line, "\n")
    root = parse(files, "c_nationkey", "text", "csv", header=False).where("node = 0")
    return root.select("c_nationkey", _attr("delimiter").alias("delimiter"), _attr("records").cast("long").alias("records"), _attr("width").cast("int").alias("width"), _attr("last_ended").alias("last_ended"))


def json_values(spark: SparkSession, d: str) -> DataFrame:
    """Scalars of JSON texts by pointer; the key "s" stands twice."""
    text = _line('{"id": ', F.col("o_orderkey"), ', "a/b": [', F.col("o_totalprice"), ', null, {"s": "', F.col("o_orderstatus"), '\\u00e9"}], "s": true, "s": "x"}')
    rows = parse(_orders(spark, d).withColumn("text", text), "o_orderkey", "text", "json")
    return rows.where(~F.col("kind").isin("document", "object", "array")).select("o_orderkey", "kind", _attr("pointer").alias("pointer"), "value", _attr("duplicate").alias("duplicate"))


def jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    """A file of lines for each user's events; every line whose event number ends in 7 is damaged."""
    line = F.when(F.col("event_id") % 10 == 7, _line('{"e": ', F.col("event_id"), ", broken")).otherwise(_line('{"e": ', F.col("event_id"), "}\n"))
    files = _joined(table(spark, d, "events"), "user_id", F.col("event_id"), line, "\n")
    rows = parse(files, "user_id", "text", "jsonl")
    return rows.groupBy("user_id").agg(F.count_if(F.col("kind") == "record").alias("records"), F.count_if((F.col("kind") == "record") & (_attr("malformed") == "true")).alias("malformed"), F.sum(F.when((F.col("kind") == "integer"), F.col("value").cast("long"))).alias("events"), F.max(F.when(F.col("node") == 0, _attr("status"))).alias("status"))


def yaml_values(spark: SparkSession, d: str) -> DataFrame:
    text = _line("c: &c {name: '", F.col("c_name"), "', key: ", F.col("c_custkey"), "}\nagain: *c\nlist:\n- ", F.col("c_nationkey"), "\n- ~\n- !x ", F.col("c_mktsegment"), "\n")
    rows = parse(table(spark, d, "customer").withColumn("text", text), "c_custkey", "text", "yaml")
    return rows.where("kind not in ('document', 'object', 'array')").select("c_custkey", "kind", _attr("pointer").alias("pointer"), F.when(F.col("kind") != "alias", F.col("value")).alias("value"), _attr("tag").alias("tag"))


def toml_values(spark: SparkSession, d: str) -> DataFrame:
    text = _line('name = "', F.col("s_name"), '"\n[a.b]\nkey = ', F.col("s_suppkey"), "\nbal = ", F.format_string("%.1f", F.floor("s_acctbal").cast("double")), "\nday = 2024-01-02\n")
    rows = parse(table(spark, d, "supplier").withColumn("text", text), "s_suppkey", "text", "toml")
    return rows.where("kind not in ('document', 'object')").select("s_suppkey", "kind", _attr("pointer").alias("pointer"), "value")


def xml_elements(spark: SparkSession, d: str) -> DataFrame:
    """A document for each region with its nations as elements of a namespace."""
    line = _line('<n:nation key="', F.col("n_nationkey"), '">', F.col("n_name"), "</n:nation>")
    files = _joined(table(spark, d, "nation"), "n_regionkey", F.col("n_nationkey"), line, "").withColumn("text", F.concat(F.lit('<?xml version="1.0"?><r xmlns:n="urn:n">'), "text", F.lit("</r>")))
    rows = parse(files, "n_regionkey", "text", "xml")
    texts = rows.where("kind = 'text'").select("n_regionkey", F.col("parent").alias("node"), F.col("value").alias("text"))
    found = rows.where("kind = 'element' and name = 'nation'").drop("text").join(texts, ["n_regionkey", "node"])
    return found.select("n_regionkey", _attr("@key").cast("int").alias("n_nationkey"), "text", _attr("path").alias("path"), _attr("namespace").alias("namespace"))


def html_content(spark: SparkSession, d: str) -> DataFrame:
    """Links, active content and metadata of a page for each supplier."""
    page = _line("<!doctype html><html><head><meta name=key content='", F.col("s_suppkey"), "'></head><body><p>one<p onclick='go()'>two <a href=\"https://s.example/", F.col("s_suppkey"), '?a=1&amp;b=2">&lt;', F.col("s_name"), '</a><a href="java\tscript:x">y</a><script>if (a < b) {}</script>')
    rows = parse(table(spark, d, "supplier").withColumn("text", page), "s_suppkey", "text", "html")
    return rows.where("kind in ('link', 'metadata', 'active_content') or kind = 'text' and value like '<%'").select("s_suppkey", "kind", "name", "value")


def cbor_values(spark: SparkSession, d: str) -> DataFrame:
    body = F.unhex(F.concat(F.lit("A3616B1A"), F.lpad(F.hex("o_orderkey"), 8, "0"), F.lit("617361"), F.hex(F.encode("o_orderstatus", "UTF-8")), F.lit("616C83F5F63903E7")))
    rows = parse(_orders(spark, d).withColumn("body", body), "o_orderkey", "body", "cbor")
    return rows.where("kind not in ('document', 'object', 'array')").select("o_orderkey", "kind", _attr("pointer").alias("pointer"), "value")


def msgpack_values(spark: SparkSession, d: str) -> DataFrame:
    body = F.unhex(F.concat(F.lit("83A16BCE"), F.lpad(F.hex("o_orderkey"), 8, "0"), F.lit("A173A1"), F.hex(F.encode("o_orderstatus", "UTF-8")), F.lit("A16C93C3C0D1FC18")))
    rows = parse(_orders(spark, d).withColumn("body", body), "o_orderkey", "body", "msgpack")
    return rows.where("kind not in ('document', 'object', 'array')").select("o_orderkey", "kind", _attr("pointer").alias("pointer"), "value")


def mail_headers(spark: SparkSession, d: str) -> DataFrame:
    """A message for each mail with its subject as an encoded word, read back."""
    rows = table(spark, d, "mail_messages").select("stable_id", "message_id", "subject", F.date_format("sent_at", "dd MMM yyyy HH:mm:ss").alias("at")).dropDuplicates(["stable_id"]).where("subject is not null and at is not null")
    text = F.concat(F.coalesce(_line("Message-ID: ", F.col("message_id"), "\r\n"), F.lit("")), _line("Subject: =?UTF-8?B?", F.replace(F.base64(F.encode("subject", "UTF-8")), F.lit("\r\n"), F.lit("")), "?=\r\nDate: ", F.col("at"), " -0330\r\nContent-Type: text/plain\r\n\r\nbody ", F.col("stable_id"), "\r\n"))
    found = parse(rows.withColumn("text", text), "stable_id", "text", "eml")
    return found.where("kind in ('message_id', 'body') or kind = 'header' and name = 'subject' or kind = 'date'").select("stable_id", "kind", F.trim("value").alias("value"), _attr("zone_minutes").cast("int").alias("zone"))


def mbox_threads(spark: SparkSession, d: str) -> DataFrame:
    """A file for each mailbox with its messages in order; the links of replies, the first message of an id being meant."""
    rows = table(spark, d, "mail_messages").select("mailbox", "stable_id", "message_id", F.get("in_reply_to", F.lit(0)).alias("reply")).dropDuplicates(["stable_id"]).where("message_id is not null")
    line = F.concat(_line("From x@example Thu Jan  1 00:00:00 2024\nMessage-ID: ", F.col("message_id"), "\nX-Key: ", F.col("stable_id")), F.when(F.col("reply") != "", _line("\nIn-Reply-To: ", F.col("reply"))).otherwise(F.lit("")), F.lit("\n\nHello\n>From there\n"))
    files = _joined(rows, "mailbox", F.col("stable_id"), line, "\n")
    found = parse(files, "mailbox", "text", "mbox", max_bytes=1 << 30)
    total = found.where("node = 0").select("mailbox", _attr("variant").alias("variant"), _attr("messages").cast("long").alias("messages"))
    links = found.where("kind = 'thread'").groupBy("mailbox").agg(F.count("*").alias("links"), F.count_if(_attr("resolved") == "true").alias("resolved"), F.sum(_attr("target").cast("long")).alias("targets"))
    return total.join(links, "mailbox", "left").fillna(0, ["links", "resolved"])


def subtitle_cues(spark: SparkSession, d: str) -> DataFrame:
    """SRT and WebVTT files of each recording's segments with both bounds, read back."""
    rows = table(spark, d, "transcript_segments").select("recording_id", "segment_index", "start_ms", "end_ms").dropDuplicates(["recording_id", "segment_index"]).where("start_ms >= 0 and end_ms > start_ms and end_ms < 360000000")

    def clock(ms: str, sep: str) -> Column:
        t = F.col(ms)
        return F.format_string(f"%02d:%02d:%02d{sep}%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)

    srt = _line(F.col("segment_index"), "\n", clock("start_ms", ","), " --> ", clock("end_ms", ","), "\nSPEAKER ", F.col("segment_index") % 3, ": <i>line</i> ", F.col("segment_index"))
    vtt = _line(F.col("segment_index"), "\n", clock("start_ms", "."), " --> ", clock("end_ms", "."), " line:0\n<v SPEAKER ", F.col("segment_index") % 3, "><i>line</i> ", F.col("segment_index"))
    out = None
    for name, line, head in (("srt", srt, ""), ("webvtt", vtt, "WEBVTT\n\n")):
        files = _joined(rows, "recording_id", F.col("segment_index"), line, "\n\n").withColumn("text", F.concat(F.lit(head), "text"))
        cues = parse(files, "recording_id", "text", name).where("kind = 'cue'")
        one = cues.select("recording_id", F.lit(name).alias("format"), F.col("name").cast("int").alias("segment_index"), _attr("start_ms").cast("long").alias("start_ms"), _attr("end_ms").cast("long").alias("end_ms"), _attr("speaker").alias("speaker"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def calendar_events(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    text = _line("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:", F.col("o_orderkey"), "\r\nDTSTART;TZID=Europe/Berlin:", day, "T101500\r\nDTEND;VALUE=DATE:", day, "\r\nRRULE:FREQ=", F.when(F.col("o_orderstatus") == "F", "DAILY").otherwise("NEVER"), ";COUNT=", F.col("o_custkey"), "\r\nSUMMARY:a\\, b", F.col("o_orderkey"), "\r\n c\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    rows = parse(table(spark, d, "orders").withColumn("text", text), "o_orderkey", "text", "icalendar")
    return rows.where("kind in ('temporal', 'recurrence') or kind = 'property' and name = 'summary'").select("o_orderkey", "kind", F.coalesce(_attr("iso"), "value").alias("value"), _attr("temporal").alias("temporal"), _attr("valid").alias("valid"))


def contact_cards(spark: SparkSession, d: str) -> DataFrame:
    text = _line("BEGIN:VCARD\nVERSION:4.0\nN:", F.col("c_name"), ";Given;;;\nitem1.TEL;TYPE=work,voice:+", F.col("c_custkey"), "\nADR:;;Street ", F.col("c_nationkey"), ";Town;;;\nEND:VCARD\n")
    rows = parse(table(spark, d, "customer").withColumn("text", text), "c_custkey", "text", "vcard")
    return rows.where("kind = 'part' or kind = 'property' and name = 'tel'").select("c_custkey", "kind", "name", "value", _attr("param.type").alias("type"))


def notebook_cells(spark: SparkSession, d: str) -> DataFrame:
    """A notebook for each language with the documents of up to 2,000 characters as cells."""
    docs = table(spark, d, "documents").where("text is not null and lang is not null")
    cell = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, "code").otherwise("markdown").alias("cell_type"), F.col("doc_id").cast("string").alias("id"), F.array("text").alias("source")))
    text = F.concat(F.lit('{"nbformat":4,"nbformat_minor":5,"metadata":{},"cells":['), cell, F.lit("]}"))
    rows = parse(docs.withColumn("book", text), "doc_id", "book", "ipynb").where("kind = 'cell'")
    return rows.select("doc_id", _attr("type").alias("type"), F.concat(F.lit("sha256:"), F.sha2("value", 256)).alias("sha256"))


def _bibliography(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all parts in 50 files: most refer to the part before, some to none or to one that is missing."""
    k = F.col("p_partkey")
    parent = F.when(k % 50 == 7, F.lit("nowhere")).when(k % 10 != 1, F.concat(F.lit("p"), (k - 1).cast("string")))
    own = F.when(k % 10 == 1, _line(", publisher = pub # { ", k, "}")).otherwise(F.lit(""))
    entry = F.concat(_line("@book{p", k, ", title = {", F.col("p_name"), "}"), own, F.coalesce(_line(", crossref = {", parent, "}"), F.lit("")), F.lit("}"))
    files = _joined(table(spark, d, "part").withColumn("file", F.floor(k / 10 - F.lit(0.1)).cast("long") % 50), "file", k, entry, "\n")
    return parse(files.withColumn("text", F.concat(F.lit("@string{pub = \"Press\"}\n"), "text")), "file", "text", "bibtex")


def bibliography_fields(spark: SparkSession, d: str) -> DataFrame:
    """The publisher of each entry, its own or inherited over up to nine cross references, with its origin."""
    rows = _bibliography(spark, d)
    entries = rows.where("kind = 'entry'").select("file", "node", F.col("name").alias("key"))
    fields = rows.where("kind = 'field'").select("file", F.col("parent").alias("node"), "name", "value").join(entries, ["file", "node"])
    up = fields.where("name = 'crossref'").groupBy("file", "key").agg(F.collect_list("value").alias("parents"))
    effective, status = citations.inherit(entries.join(up, ["file", "key"], "left").select(F.col("file").alias("scope"), "key", "parents"), fields.select(F.col("file").alias("scope"), "key", "name", "value"))
    found = effective.where("name = 'publisher'").select("scope", "key", "value", "origin", "distance")
    return status.join(found, ["scope", "key"], "left").withColumnRenamed("scope", "file")


def model_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The value taken from answers of four shapes, one for each event: bare, fenced with damage, in a sentence, as a call."""
    shape = F.col("event_id") % 4
    value = F.col("event_id").cast("string")
    text = F.when(shape == 0, _line('{"k": ', value, "}")).when(shape == 1, _line("<think>{not this</think>Sure:\n```json\n{'k': ", value, ", ok: True,}\n```\n")).when(shape == 2, _line('The answer is {"k": ', value, '} as "asked}".')).otherwise(_line('<tool_call>{"name": "run", "arguments": {"k": ', value, "}}</tool_call>"))
    rows = parse(table(spark, d, "events").withColumn("text", text), "event_id", "text", "model_output")
    return rows.where("kind = 'candidate' and attrs['selected'] = 'true'").select("event_id", _attr("grammar").alias("grammar"), _attr("status").alias("status"), F.get_json_object("value", "$.k").cast("long").alias("k"), F.col("name").alias("command"))


def graph_documents(spark: SparkSession, d: str) -> DataFrame:
    """A graph for each customer: orders in a row, every third pointing back at the first. Components and layers."""
    o = _orders(spark, d).select("o_custkey", "o_orderkey")
    listed = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    ident = lambda x: F.concat(F.lit('"o'), x.cast("string"), F.lit('"'))
    nodes = F.array_join(F.transform("l", lambda x: F.concat(F.lit('{"id":'), ident(x), F.lit("}"))), ",")
    ahead = F.transform(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), lambda x, i: F.concat(F.lit('{"source":'), ident(F.element_at("l", i + 1)), F.lit(',"target":'), ident(x), F.lit("}")))
    back = F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.array(F.concat(F.lit('{"source":'), ident(F.element_at("l", -1)), F.lit(',"target":'), ident(F.element_at("l", 1)), F.lit("}")))).otherwise(F.array().cast("array<string>"))
    text = F.concat(F.lit('{"nodes":['), nodes, F.lit('],"edges":['), F.array_join(F.concat(ahead, back), ","), F.lit("]}"))
    rows = parse(listed.select("o_custkey", text.alias("text")), "o_custkey", "text", "graph_json")
    nodes_ = rows.where("kind = 'node'").select(F.col("o_custkey").alias("graph_id"), F.col("name").alias("id"))
    edges = rows.where("kind = 'edge'").select(F.col("o_custkey").alias("graph_id"), _attr("source").alias("source"), _attr("target").alias("target"))
    found = analysis.analyze(edges, nodes_)
    return found.select(F.col("graph_id").alias("o_custkey"), "id", "component", "size", "cyclic", "layer", F.size("cycle").alias("cycle"))


def event_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of each user's graph of event types that follow each other, by the joins for graphs of any size."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    edges = e.where("next is not null").select(F.col("user_id").alias("graph_id"), F.col("event_type").alias("source"), F.col("next").alias("target"))
    return analysis.components(edges).withColumnRenamed("graph_id", "user_id")


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols, imports and calls of a Python and a Rust file for each part."""
    k = F.col("p_partkey")
    python = _line("import os\n\nclass Part", k, ":\n    def size(self):\n        return scale(", F.col("p_size"), ")  # note\n")
    rust = _line("use std::fmt;\n/* fn no() {} */\npub struct Part", k, ' { size: u32 }\nimpl Part', k, ' {\n    pub fn size(&self) -> u32 { scale("}", ', F.col("p_size"), ") }\n}\n")
    parts = table(spark, d, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit("python").alias("f"), python.alias("t")), F.struct(F.lit("rust").alias("f"), rust.alias("t")))).alias("x")).select("p_partkey", F.struct("p_partkey", "x.f").alias("k"), "x.*")
    rows = parse(parts.withColumn("key", F.concat_ws(":", "p_partkey", "f")), "key", "t", F.col("f"))
    return rows.where("kind in ('symbol', 'import', 'call')").select(F.split_part("key", F.lit(":"), F.lit(1)).cast("long").alias("p_partkey"), F.split_part("key", F.lit(":"), F.lit(2)).alias("language"), "kind", "name", _attr("type").alias("type"))


def media_headers(spark: SparkSession, d: str) -> DataFrame:
    """Width and height in the headers of a PNG, a GIF and a BMP image for each part."""
    w, h = F.col("p_size"), (F.col("p_partkey") % 1000 + 1)
    be = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    le2 = lambda x: F.concat(F.substring(F.lpad(F.hex(x.cast("long")), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(x.cast("long")), 4, "0"), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w), be(h), F.lit("080200000000000000"), F.lit("0000000049454E44AE426082"))
    gif = F.concat(F.lit("474946383961"), le2(w), le2(h), F.lit("0000003B"))
    bmp = F.concat(F.lit("424D" + "00" * 12 + "28000000"), le2(w), F.lit("0000"), le2(h), F.lit("000001001800"))
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.unhex(b).alias("b")) for f, b in (("png", png), ("gif", gif), ("bmp", bmp))])).alias("x")).select(F.concat_ws(":", "p_partkey", "x.f").alias("key"), "x.*")
    root = parse(rows, "key", "b", F.col("f")).where("node = 0")
    return root.select(F.split_part("key", F.lit(":"), F.lit(1)).cast("long").alias("p_partkey"), F.col("name").alias("format"), _attr("width").cast("int").alias("width"), _attr("height").cast("int").alias("height"), _attr("status").alias("status"))


# Heads of files in hex with a name and what must be found: (name, hex, format, confidence, contradiction).
HEADS = (
    ("a.png", "89504E470D0A1A0A", "png", "certain", False), ("b.txt", "255044462D312E37", "pdf", "certain", True), ("c", "7B5C727466312061", "rtf", "certain", False), ("d.json", "7B2261223A20312C202262223A205B5D7D", "json", "likely", False), ("e.bin", "1F8B0800", "gzip", "certain", False),
    ("f.ics", "424547494E3A5643414C454E444152", "icalendar", "certain", False), ("g.md", "2320486561640A0A7465787420616E64", "markdown", "likely", False), ("h", "706C61696E20776F7264732068657265", "text", "weak", False), ("i.mp3", "53514C69746520666F726D6174203300", "sqlite", "certain", True),
)


def detect_files(spark: SparkSession, d: str) -> DataFrame:
    """The format of a file for each order: one of a list of heads, by the order's number, with a name that may mislead."""
    heads = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("head")) for n, h, *_ in HEADS])
    rows = _orders(spark, d).select("o_orderkey", F.element_at(heads, (F.pmod("o_orderkey", F.lit(len(HEADS))) + 1).cast("int")).alias("x"))
    found = detect.detect(rows.select("o_orderkey", "x.name", F.unhex("x.head").alias("content")), "o_orderkey", "content", "name")
    grade = F.when(F.col("confidence") >= 0.95, "certain").when(F.col("confidence") >= 0.75, "likely").otherwise("weak")
    return found.select("o_orderkey", "format", grade.alias("grade"), "contradiction")


def decoded_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents written in four encodings and read again by mark or declaration."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.pmod("doc_id", F.lit(4)).alias("n"))
    meta = F.concat(F.lit('<meta charset="utf-8">'), "text")
    content = F.when(F.col("n") == 0, F.encode("text", "UTF-8")).when(F.col("n") == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(F.col("n") == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.encode(meta, "UTF-8"))
    found = decode.decoded(docs.select("doc_id", content.alias("content")), "content")
    return found.select("doc_id", F.when((F.col("encoding") == "windows-1252") | (F.col("encoding") == "utf-8"), "8-bit").otherwise(F.col("encoding")).alias("encoding"), "chosen_by", F.sha2("text", 256).alias("sha256"))


def line_places(spark: SparkSession, d: str) -> DataFrame:
    """Line and column of every node's first byte."""
    docs = table(spark, d, "markdown_documents").select("md_doc_id", "decoded_text").dropDuplicates(["md_doc_id"])
    nodes = table(spark, d, "markdown_nodes").select("md_doc_id", "id", "byte_start").where("byte_start is not null and id is not null").groupBy("md_doc_id", "id").agg(F.min("byte_start").alias("byte_start"))
    return decode.line_columns(nodes.join(docs, "md_doc_id"), "decoded_text", "byte_start").select("md_doc_id", "id", "line", "column")


def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """Events checked against a schema: a number below 50 in k, and a known type."""
    schema = {"type": "object", "required": ["k", "t"], "properties": {"k": {"type": "integer", "maximum": 49}, "t": {"enum": ["click", "view"]}}, "additionalProperties": False}
    text = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "t": "'), "event_type", F.lit('"}'))
    return schemas.validate(table(spark, d, "events").withColumn("text", text), "event_id", "text", schema).select("event_id", "pointer", "rule")


def document_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of all documents: text covered, sizes and order are those of the nodes; none is above the maximum unless it
    is one unit."""
    nodes = table(spark, d, "markdown_nodes").where(F.col("kind").isin("heading", "paragraph", "list_item", "code_fence", "table_cell"))
    rows = nodes.select(F.col("md_doc_id").alias("doc"), "id", F.col("parent_id").alias("parent"), "kind", "text", "byte_start", "level")
    found = segments.segment(rows, segments.SegmentOptions(ancestry=False))
    return found.groupBy("doc").agg(F.sum(F.size("nodes")).alias("nodes"), F.sum("bytes").alias("bytes"), F.count_if((F.col("bytes") > 1500) & (F.size("nodes") > 1) & ~F.col("text").isNull()).cast("long").alias("above"))


def json_summary(spark: SparkSession, d: str) -> DataFrame:
    """Statuses and sizes of the trees of all events' properties, and how deep they nest."""
    events = table(spark, d, "events")
    rows = statuses(parse(events, "event_id", "props", "json"), "event_id")
    return rows.join(events.select("event_id", analysis.json_depth("props").alias("depth")), "event_id").groupBy("status", "nodes", "depth").agg(F.count("*").alias("events"))


QUERIES = {f.__name__: f for f in (
    markdown_blocks, text_blocks, csv_cells, csv_dialects, json_values, jsonl_records, yaml_values, toml_values, xml_elements, html_content, cbor_values, msgpack_values, mail_headers, mbox_threads, subtitle_cues, calendar_events, contact_cards, notebook_cells,
    bibliography_fields, model_candidates, graph_documents, event_components, code_symbols, media_headers, detect_files, decoded_files, line_places, schema_violations, document_segments, json_summary,
)}

_MAIL = "(SELECT stable_id, any_value(mailbox) AS mailbox, any_value(message_id) AS message_id, any_value(in_reply_to) AS r, any_value(subject) AS subject, any_value(sent_at) AS sent_at FROM mail_messages GROUP BY 1)"
SQL = {
    "markdown_blocks": f"SELECT DISTINCT md_doc_id, kind, byte_start, byte_end FROM markdown_nodes JOIN (SELECT DISTINCT md_doc_id FROM markdown_documents WHERE decoded_text IS NOT NULL) USING (md_doc_id) WHERE kind IN {MARKDOWN_KINDS}",
    "text_blocks": r"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, '\A(?:[^\S\n]*\n)+', ''), '(?:\n[^\S\n]*)+\z', ''), '\n(?:[^\S\n]*\n)+')) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS blocks, CAST(sum(octet_length(encode(b))) AS BIGINT) AS bytes FROM t WHERE regexp_matches(b, '\S') GROUP BY 1""",
    "csv_cells": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT o_custkey, CAST(r AS INTEGER) AS record, c AS "column", v AS value, t AS type FROM (SELECT o_custkey, r, unnest(['key', 'day', 'note']) AS c,
unnest([CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority || '; "' || o_orderstatus || '"' || chr(10)]) AS v, unnest(['integer', 'date', 'text']) AS t FROM o)""",
    "csv_dialects": "SELECT c_nationkey, [',', chr(9), ';', '|'][c_nationkey % 4 + 1] AS delimiter, count(*) AS records, 3 AS width, 'false' AS last_ended FROM customer GROUP BY c_nationkey",
    "json_values": """SELECT o_orderkey, k AS kind, p AS pointer, v AS value, u AS duplicate FROM (SELECT o_orderkey, unnest(['integer', 'decimal', 'null', 'string', 'boolean', 'string', 'diagnostic']) AS k, unnest(['/id', '/a~1b/0', '/a~1b/1', '/a~1b/2/s', '/s', '/s', NULL]) AS p,
unnest([CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR), NULL, o_orderstatus || 'é', 'true', 'x', 's']) AS v, unnest([NULL, NULL, NULL, NULL, NULL, '1', NULL]) AS u FROM orders)""",
    "jsonl_records": "SELECT user_id, count(*) AS records, count(*) FILTER (WHERE event_id % 10 = 7) AS malformed, CAST(sum(event_id) FILTER (WHERE event_id % 10 <> 7) AS BIGINT) AS events, CASE WHEN bool_or(event_id % 10 = 7) THEN 'partial' ELSE 'complete' END AS status FROM events GROUP BY 1",
    "yaml_values": """SELECT c_custkey, k AS kind, p AS pointer, v AS value, t AS tag FROM (SELECT c_custkey, unnest(['string', 'integer', 'alias', 'integer', 'null', 'string']) AS k, unnest(['/c/name', '/c/key', '/again', '/list/0', '/list/1', '/list/2']) AS p,
unnest([c_name, CAST(c_custkey AS VARCHAR), NULL, CAST(c_nationkey AS VARCHAR), NULL, c_mktsegment]) AS v, unnest([NULL, NULL, NULL, NULL, NULL, '!x']) AS t FROM customer)""",
    "toml_values": """SELECT s_suppkey, k AS kind, p AS pointer, v AS value FROM (SELECT s_suppkey, unnest(['string', 'integer', 'decimal', 'date']) AS k, unnest(['/name', '/a/b/key', '/a/b/bal', '/a/b/day']) AS p,
unnest([s_name, CAST(s_suppkey AS VARCHAR), CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) || '.0', '2024-01-02']) AS v FROM supplier)""",
    "xml_elements": "SELECT n_regionkey, n_nationkey, n_name AS text, '/r[1]/nation[' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || ']' AS path, 'urn:n' AS namespace FROM nation",
    "html_content": """SELECT s_suppkey, k AS kind, n AS name, v AS value FROM (SELECT s_suppkey, unnest(['metadata', 'active_content', 'link', 'link', 'active_content', 'active_content', 'text']) AS k, unnest(['key', 'handler', 'href', 'href', 'script_url', 'script', NULL]) AS n,
unnest([CAST(s_suppkey AS VARCHAR), 'onclick', 'https://s.example/' || s_suppkey || '?a=1&b=2', 'java' || chr(9) || 'script:x', 'href', 'inline', '<' || s_name]) AS v FROM supplier)""",
    "cbor_values": """SELECT o_orderkey, k AS kind, p AS pointer, v AS value FROM (SELECT o_orderkey, unnest(['integer', 'string', 'boolean', 'null', 'integer']) AS k, unnest(['/k', '/s', '/l/0', '/l/1', '/l/2']) AS p, unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, 'true', NULL, '-1000']) AS v FROM orders)""",
    "mail_headers": f"""WITH m AS {_MAIL}, x AS (SELECT stable_id, unnest(['message_id', 'header', 'date', 'body']) AS kind, unnest([message_id, trim(subject, ' '), strftime(sent_at, '%Y-%m-%dT%H:%M:%S') || '-03:30', 'body ' || stable_id || chr(13)]) AS value, unnest([NULL, NULL, -210, NULL]) AS zone FROM m WHERE subject IS NOT NULL AND sent_at IS NOT NULL)
SELECT stable_id, kind, CASE WHEN kind = 'body' THEN 'body ' || stable_id || chr(13) || chr(10) ELSE value END AS value, CAST(zone AS INTEGER) AS zone FROM x WHERE kind <> 'message_id' OR value IS NOT NULL""",
    "mbox_threads": f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY stable_id) - 1 AS i FROM {_MAIL} WHERE message_id IS NOT NULL), f AS (SELECT mailbox, message_id, min(i) AS t FROM m GROUP BY 1, 2)
SELECT m.mailbox, 'mboxrd' AS variant, count(*) AS messages, count(*) FILTER (WHERE r[1] <> '') AS links, count(f.t) FILTER (WHERE r[1] <> '') AS resolved, CAST(sum(f.t) FILTER (WHERE r[1] <> '') AS BIGINT) AS targets FROM m LEFT JOIN f ON f.mailbox = m.mailbox AND f.message_id = m.r[1] GROUP BY 1""",
    "subtitle_cues": """WITH s AS (SELECT DISTINCT recording_id, segment_index, start_ms, end_ms FROM transcript_segments WHERE start_ms >= 0 AND end_ms > start_ms AND end_ms < 360000000)
SELECT recording_id, f AS format, segment_index, start_ms, end_ms, 'SPEAKER ' || segment_index % 3 AS speaker, 'line ' || segment_index AS value FROM s, (VALUES ('srt'), ('webvtt')) v(f)""",
    "calendar_events": """SELECT o_orderkey, k AS kind, v AS value, t AS temporal, b AS valid FROM (SELECT o_orderkey, unnest(['temporal', 'temporal', 'recurrence', 'property']) AS k, unnest([strftime(o_orderdate, '%Y-%m-%d') || 'T10:15:00', strftime(o_orderdate, '%Y-%m-%d'), 'FREQ=' || CASE WHEN o_orderstatus = 'F' THEN 'DAILY' ELSE 'NEVER' END || ';COUNT=' || o_custkey, 'a, b' || o_orderkey || 'c']) AS v,
unnest(['zoned', 'date', NULL, NULL]) AS t, unnest([NULL, NULL, CASE WHEN o_orderstatus = 'F' AND o_custkey > 0 THEN 'true' ELSE 'false' END, NULL]) AS b FROM orders)""",
    "contact_cards": """SELECT c_custkey, k AS kind, n AS name, v AS value, t AS type FROM (SELECT c_custkey, unnest(['part', 'part', 'property', 'part', 'part']) AS k, unnest(['family', 'given', 'tel', 'street', 'locality']) AS n, unnest([c_name, 'Given', '+' || c_custkey, 'Street ' || c_nationkey, 'Town']) AS v, unnest([NULL, NULL, 'work,voice', NULL, NULL]) AS t FROM customer)""",
    "notebook_cells": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'code' ELSE 'markdown' END AS type, 'sha256:' || sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL",
    "bibliography_fields": """WITH p AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 10 - 0.1) AS BIGINT) % 50 AS file, (p_partkey + 9) % 10 AS n FROM part),
x AS (SELECT *, EXISTS (SELECT 1 FROM p q WHERE q.file = p.file AND q.k BETWEEN p.k - p.n AND p.k AND q.k % 50 = 7) AS cut, (SELECT count(*) FROM p q WHERE q.file = p.file AND q.k BETWEEN p.k - p.n AND p.k) = n + 1 AS whole FROM p)
SELECT file, 'p' || k AS key, CASE WHEN cut OR NOT whole THEN 'unresolved' ELSE 'complete' END AS status, CASE WHEN NOT cut AND whole THEN 'Press ' || (k - n) END AS value, CASE WHEN NOT cut AND whole THEN 'p' || (k - n) END AS origin, CASE WHEN NOT cut AND whole THEN CAST(n AS INTEGER) END AS distance FROM x""",
    "model_candidates": "SELECT event_id, ['raw_json', 'fenced_json', 'json_object_in_text', 'xml_tool_call'][event_id % 4 + 1] AS grammar, CASE WHEN event_id % 4 = 1 THEN 'recovered' ELSE 'complete' END AS status, event_id AS k, CASE WHEN event_id % 4 = 3 THEN 'run' END AS command FROM events",
    "graph_documents": """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS r, count(*) OVER (PARTITION BY o_custkey) AS n, min('o' || o_orderkey) OVER (PARTITION BY o_custkey) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, 'o' || o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN c ELSE 'o' || o_orderkey END AS component, CASE WHEN o_custkey % 3 = 0 THEN CAST(n AS INTEGER) ELSE 1 END AS size, o_custkey % 3 = 0 AS cyclic, CASE WHEN o_custkey % 3 <> 0 THEN CAST(r - 1 AS INTEGER) END AS layer,
CASE WHEN o_custkey % 3 = 0 AND 'o' || o_orderkey = c THEN CAST(n + 1 AS INTEGER) END AS cycle FROM o""",
    "event_components": """WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type AS a, b FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL),
r AS (SELECT user_id, a, b FROM e UNION SELECT r.user_id, r.a, e.b FROM r JOIN e ON e.user_id = r.user_id AND e.a = r.b), n AS (SELECT user_id, a AS id FROM e UNION SELECT user_id, b FROM e)
SELECT n.user_id, n.id, least(n.id, min(x.b)) AS component FROM n LEFT JOIN (SELECT p.* FROM r p JOIN r q ON q.user_id = p.user_id AND q.a = p.b AND q.b = p.a) x ON x.user_id = n.user_id AND x.a = n.id GROUP BY 1, 2""",
    "code_symbols": """SELECT p_partkey, l AS language, k AS kind, n AS name, t AS type FROM (SELECT p_partkey, unnest(['python', 'python', 'python', 'python', 'rust', 'rust', 'rust', 'rust', 'rust']) AS l, unnest(['import', 'symbol', 'symbol', 'call', 'import', 'symbol', 'symbol', 'symbol', 'call']) AS k,
unnest(['os', 'Part' || p_partkey, 'size', 'scale', 'std::fmt', 'Part' || p_partkey, 'Part' || p_partkey, 'size', 'scale']) AS n, unnest([NULL, 'class', 'method', NULL, NULL, 'struct', 'impl', 'function', NULL]) AS t FROM part)""",
    "media_headers": "SELECT p_partkey, f AS format, p_size AS width, CAST(p_partkey % 1000 + 1 AS INTEGER) AS height, 'complete' AS status FROM part, (VALUES ('png'), ('gif'), ('bmp')) v(f)",
    "detect_files": "SELECT o_orderkey, f AS format, g AS grade, c AS contradiction FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{f}', '{g}', {c})" for i, (_, _, f, g, c) in enumerate(HEADS)) + f") v(i, f, g, c) ON i = o_orderkey % {len(HEADS)}",
    "decoded_files": """SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'utf-16le' ELSE '8-bit' END AS encoding, ['content', 'mark', 'mark', 'html'][doc_id % 4 + 1] AS chosen_by, sha256(CASE WHEN doc_id % 4 = 3 THEN '<meta charset="utf-8">' || text ELSE text END) AS sha256 FROM documents WHERE text IS NOT NULL""",
    "line_places": r"""WITH d AS (SELECT md_doc_id, any_value(decoded_text) AS t FROM markdown_documents GROUP BY 1), n AS (SELECT md_doc_id, id, min(byte_start) AS s FROM markdown_nodes WHERE byte_start IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2),
x AS (SELECT md_doc_id, id, CASE WHEN s BETWEEN 0 AND octet_length(encode(t)) THEN decode(encode(t)[1:s]) END AS b FROM n JOIN d USING (md_doc_id))
SELECT md_doc_id, id, CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(regexp_extract(b, '[^\n]*$')) + 1 AS INTEGER) AS "column" FROM x""",
    "schema_violations": """WITH e AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS t FROM events)
SELECT event_id, '/k' AS pointer, 'maximum' AS rule FROM e WHERE k > 49 UNION ALL SELECT event_id, '/t', 'enum' FROM e WHERE k IS NOT NULL AND t NOT IN ('click', 'view')""",
    "document_segments": """WITH n AS (SELECT md_doc_id AS doc, id, any_value(text) AS t FROM markdown_nodes WHERE id IS NOT NULL AND kind IN ('heading', 'paragraph', 'list_item', 'code_fence', 'table_cell') GROUP BY 1, 2)
SELECT doc, count(*) AS nodes, CAST(sum(octet_length(encode(t))) AS BIGINT) AS bytes, 0::BIGINT AS above FROM n WHERE t <> '' GROUP BY 1""",
    "json_summary": "SELECT 'complete' AS status, 3 AS nodes, 1 AS depth, count(*) AS events FROM events",
}
SQL["msgpack_values"] = SQL["cbor_values"]
