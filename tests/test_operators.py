import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.formats.base import Tree, parse
from quillspan.functions import text as T
from quillspan.functions import values as V
from quillspan.operators import analysis, citations, containers, decode, detect, extension, projects, reconcile, render, schemas, segments, summary, walks
from quillspan.sources import ingest
from quillspan.streaming import protocol


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_more_scalars(spark):
    def f(g, *v):
        return one(spark, g(*map(F.lit, v)))

    assert [f(T.cell_place, x) for x in ("A1", "$b$12", "AAA1", "A0", "1A", None)] == [(0, 0), (11, 1), (0, 702), None, None, None]
    assert [f(T.citation_label, *x) for x in (("page", 3, 5, None), ("line", 7, 7, None), ("cell", 1, 2, "S"), ("time", 3723004, None, None), ("node", None, None, "n1"))] == ["page 3-5", "line 7", "S!C2", "01:02:03.004", "n1"]
    assert f(T.association_key, " A-b, É c ") == "a b é c" and f(T.caption_kind, "Fig. 3: x") == "figure" and f(T.caption_kind, "Table IV") == "table" and f(T.caption_kind, "Tables") is None
    assert [f(T.list_marker, x) for x in ("- a", "iv) b", "a. c", "12: d", "word e")] == [("-", False), ("iv)", True), ("a.", True), ("12:", True), None]
    assert f(T.visible_latex, "a \\textbf{b} % c\n\\cite{k}\\&~d") == "a b & d" and f(T.escape_markdown, "a*b_[c]") == "a\\*b\\_\\[c\\]" and f(T.escape_latex, "a_b\\c^~") == r"a\_b\textbackslash{}c\textasciicircum{}\textasciitilde{}"
    assert f(T.inert_code, "a```b") == "````\na```b\n````" and f(T.percent_decoded, "a%20b+c%C3%A9") == "a b+cé" and f(T.percent_decoded, "50%") == "50%"
    assert [tuple(f(T.member_path, x)) for x in ("a/./b\\c", "/a", "a/../b", "C:x", "a\x01", "")] == [("a/b/c", None), (None, "absolute_path"), (None, "parent_traversal"), (None, "absolute_path"), (None, "control_character"), (None, "empty_path")]
    assert [tuple(one(spark, T.ical_temporal(F.lit(v), F.lit(z).cast("string")))) for v, z in (("20240131", None), ("20240131T101500Z", None), ("20240131T101500", "X"), ("20240231", None), (None, None))] == [("date", "2024-01-31", None), ("utc", "2024-01-31T10:15:00Z", None), ("zoned", "2024-01-31T10:15:00", "X"), ("invalid", None, None), ("invalid", None, None)]
    assert [f(T.recurrence, x).valid for x in ("FREQ=DAILY;COUNT=2", "FREQ=DAILY;COUNT=0", "FREQ=X", "COUNT=2", "FREQ=DAILY;COUNT=1;UNTIL=2", "FREQ=DAILY;FREQ=DAILY")] == [True, False, False, False, False, False]
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, T.box_overlap(box(0, 0, 2, 2), box(1, 0, 9, 2))) == 0.5 and one(spark, T.box_overlap(box(0, 0, 0, 2), box(1, 0, 9, 2))) is None
    assert [f(T.locator_problem, *x) for x in (("page", 0, 1, None), ("byte", 0, 5, 4), ("x", 1, 1, None), ("line", 2, 1, None), ("line", 1, 1, 9), ("row", None, None, None))] == ["below_base", "out_of_range", "unknown_kind", "reversed", None, "no_start"]
    assert f(T.artifact_risk, None, "a.txt", bytearray(b"MZ..")) == "executable" and f(T.artifact_risk, "application/pdf", "a.js", bytearray(b"x")) == "active" and f(T.artifact_risk, None, None, None) in ("inert", None)
    assert f(V.canonical_json, '{"b": 1, "a": [1.5, "é"]}') == '{"a":[1.5,"é"],"b":1}' and f(V.canonical_json, "{") is None and f(V.json_digest, "{}").startswith("sha256:44136fa3")
    assert f(V.entities_decoded, "&lt;&#233;&nbsp;&x;") == "<é\xa0&x;" and f(V.mail_date, "Mon, 1 Jan 2024 10:00:00 -0530") == "2024-01-01T10:00:00-05:30" and f(V.mail_date, "x") is None
    assert one(spark, V.ttml_ms(F.lit("00:00:01:15"))) == 1500 and one(spark, V.ttml_ms(F.lit("3.5s"))) == 3500 and one(spark, V.ttml_ms(F.lit("90t"), tick_rate="1000")) == 90
    assert tuple(f(V.transfer, bytearray(b"aGk="), "base64")) == (bytearray(b"hi"), None)
    assert [tuple(f(V.repaired_json, x)) if x else f(V.repaired_json, x) for x in ('{"a": 1}', "{'a': 1}", "no")] == [('{"a": 1}', [], True), ('{"a": 1}', ["quote_single_quoted_string"], True), ("no", [], False)]


def test_decode_and_detect(spark):
    rows = [(1, "é".encode(), None), (2, b"\xef\xbb\xbfa", "latin1"), (3, "é".encode("utf-16-be"), "utf-16be"), (4, b"\xe9", None), (5, '<?xml version="1.0" encoding="iso-8859-2"?>\xb1'.encode("latin-1"), None), (6, None, None), (7, b"", None), (8, "яж".encode("koi8-r"), "KOI8-R"), (9, b"\xff\xfea", None)]
    df = spark.createDataFrame(rows, "id long, content binary, label string")
    got = {r.id: (r.encoding, r.chosen_by, r.text, r.conflict) for r in decode.decoded(df, "content", "label").collect()}
    assert got[1][:3] == ("utf-8", "content", "é") and got[2] == ("utf-8", "mark", "a", True) and got[3][:3] == ("utf-16be", "transport", "é") and got[4][:3] == ("windows-1252", "content", "é")
    assert got[5][:2] == ("iso-8859-2", "xml") and got[5][2].endswith("ą") and got[6] == (None, None, None, None) and got[7][2] == "" and got[8][2] == "яж" and got[9][2] == "�"
    files = [(1, "a.docx", zipped(**{"[Content_Types].xml": "x", "word/document.xml": "x"}), None), (2, "a.zip", zipped(x="y"), None), (3, "x.py", b"def f(a):\n    return a\n", None), (4, None, b"", None), (5, "q.csv", b"a,b\n1,2\n", "text/csv"), (6, "t.h", b"int x;", None), (7, "z", bytes(range(256)), None), (8, "v", b"\xa1\x61\x61\x83\x00\x00\xf5", None)]
    df = spark.createDataFrame(files, "id long, name string, content binary, media string")
    found = {r.id: r for r in detect.detect(df, "id", "content", "name", "media").collect()}
    assert {k: r.format for k, r in found.items()} == {1: "docx", 2: "zip", 3: "python", 4: "text", 5: "csv", 6: "c", 8: "cbor"} and found[1].confidence > 0.97
    ranked = detect.candidates(detect.signals(df, "id", "content", "name"), "id")
    assert {r.status for r in detect.decide(ranked.where("id = 6"), "id", ["cpp"]).collect()} == {"ambiguous"} and [r.format for r in detect.decide(ranked.where("id = 6"), "id", ["cpp"], "prefer_available").collect()] == ["cpp"]
    assert {r.status for r in detect.decide(ranked.where("id = 3"), "id", []).collect()} == {"unsupported"} and {r.status for r in detect.decide(ranked.where("id = 3"), "id", [], minimum=0.999).collect()} == {"unknown"}
    kinds = {"src/a.rs": "source", "tests/a.rs": "test", "Cargo.lock": "lockfile", "Cargo.toml": "manifest", "x/README.md": "documentation", "a.min.js": "generated", "i.png": "binary", "odd": "other"}
    assert {p: one(spark, detect.file_kind(F.lit(p))) for p in kinds} == kinds


def zipped(**members):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for n, b in members.items():
            z.writestr(n, b)
    return box.getvalue()


def test_graph_analysis(spark):
    edges = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (1, "d", "d"), (1, "e", "a"), (2, "x", "y"), (2, "x", "z"), (2, "y", "w"), (2, "z", "w"), (2, None, "q")]
    df = spark.createDataFrame(edges, "graph_id long, source string, target string")
    nodes = spark.createDataFrame([(2, "lone"), (2, None)], "graph_id long, id string")
    got = {(r.graph_id, r.id): (r.component, r.cyclic, r.layer, r.position, r.cycle) for r in analysis.analyze(df, nodes).collect()}
    assert got[1, "a"] == ("a", True, None, None, ["a", "b", "c", "a"]) and got[1, "d"] == ("d", True, None, None, ["d", "d"]) and got[1, "e"][:3] == ("e", False, 0)
    assert [got[2, n][2:4] for n in ("lone", "x", "y", "z", "w")] == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)] and (2, "q") not in got
    big = {(r.graph_id, r.id): r.component for r in analysis.components(df).collect()}
    assert big == {k: v[0] for k, v in got.items() if k != (2, "lone")}
    with pytest.raises(ValueError, match="1: a > b > c > a"):
        analysis.require_acyclic(df)
    analysis.require_acyclic(df.where("graph_id = 2"))
    with pytest.raises(ValueError):
        analysis.analyze(df, bound=3)
    assert {(r.graph_id, r.id): (r.incoming, r.outgoing) for r in analysis.indexes(df.where("graph_id = 1")).collect()}[1, "d"] == (2, 1)
    assert {r.id: r.distance for r in analysis.reachable(df, spark.createDataFrame([(1, "e")], "graph_id long, start string")).collect()} == {"e": 0, "a": 1, "b": 2, "c": 3, "d": 4}
    undirected = spark.createDataFrame([(1, "a", "b", False)], "graph_id long, source string, target string, directed boolean")
    assert {r.component for r in analysis.analyze(undirected).collect()} == {"a"} and analysis.analyze(df.where("graph_id > 9")).count() == 0
    named = analysis.identified(df.where("graph_id = 2 and source is not null").withColumn("relation", F.lit("r")))
    assert named.select("id").distinct().count() == 4 and named.first().id.startswith("doc:edge:")
    depths = spark.createDataFrame([('{"a": [1, {"b": "[[["}]}',), ("1",), (None,)], "v string")
    assert [r.d for r in depths.select(analysis.json_depth("v").alias("d")).collect()] == [3, 0, None]


def test_citations(spark):
    entries = spark.createDataFrame([(1, "a", ["b"]), (1, "b", ["c", "x"]), (1, "c", None), (1, "x", None), (1, "l", ["m"]), (1, "m", ["l"]), (1, "u", ["zz"]), (1, "d", None), (1, "d", None), (1, "p", ["d"])], "scope long, key string, parents array<string>")
    fields = spark.createDataFrame([(1, "a", "t", "own"), (1, "b", "t", "b"), (1, "c", "y", "c"), (1, "x", "y", "x"), (1, "x", "q", "x")], "scope long, key string, name string, value string")
    effective, status = citations.inherit(entries, fields)
    assert {(r.name, r.value, r.origin, r.distance) for r in effective.where("key = 'a'").collect()} == {("t", "own", "a", 0), ("y", "c", "c", 2), ("q", "x", "x", 2)}
    assert {r.key: r.status for r in status.collect()} == {"a": "complete", "b": "complete", "c": "complete", "x": "complete", "l": "cycle", "m": "cycle", "u": "unresolved", "d": "complete", "p": "ambiguous"}
    assert {r.key: r.status for r in citations.inherit(entries.where("key in ('a', 'b', 'c', 'x')"), fields, depth=1)[1].collect()}["a"] == "depth"
    cited = spark.createDataFrame([(1, "a"), (1, "d"), (1, "no")], "scope long, key string")
    assert {r.key: r.status for r in citations.resolve_keys(cited, entries.withColumn("entry", F.col("key"))).collect()} == {"a": "resolved", "d": "ambiguous", "no": "missing"}
    assert [r.key for r in citations.duplicate_keys(entries).collect()] == ["d"]
    anchor = lambda k, h, loc=None, src=None: (1 if k != "v" else 9, "node", k, loc, h, src)
    anchors = spark.createDataFrame([anchor("a", "h1"), anchor("z", "h2"), anchor("y", "h3"), anchor("e", "h0"), anchor("q", "h7"), anchor("s", "h8", src="S"), anchor("l", "h4", "5-6"), anchor("v", "h1")], "scope long, target_kind string, target_id string, locator string, text_hash string, source_hash string")
    found = spark.createDataFrame([(1, "node", "a", None, "h1"), (1, "node", "b", None, "h2"), (1, "node", "c", None, "h3"), (1, "node", "d", None, "h3"), (1, "node", "e", None, "h9"), (1, "node", "f", "5-6", "h4"), (1, "node", "g", None, "h4")], "scope long, target_kind string, target_id string, locator string, text_hash string")
    versions = spark.createDataFrame([(1, "S")], "scope long, source_hash string")
    assert {r.target_id: (r.status, r.found) for r in citations.verify(anchors, versions, found).collect()} == {"a": ("exact", "a"), "z": ("relocated", "b"), "y": ("ambiguous", None), "e": ("changed", None), "q": ("missing", None), "s": ("exact", "s"), "l": ("relocated", "f"), "v": ("unverifiable", None)}
    assert {r.status for r in citations.verify(anchors, versions, found, budget=2).collect()} == {"unverifiable"}
    left = spark.createDataFrame([(1, "s1", "The quick brown fox jumps"), (1, "s2", "same words here"), (1, "s3", "nothing alike"), (1, "s4", "a b c d e f g h i j")], "scope long, id string, text string")
    right = spark.createDataFrame([(1, "t1", "quick brown fox jumps, the end"), (1, "t2", "Same words: here!"), (1, "t4", "a b c d e f g h i k"), (1, "t5", "a b c d e f g h i l")], "scope long, id string, text string")
    assert {(r.source, r.status) for r in citations.associate(left, right).collect()} == {("s1", "matched"), ("s2", "matched"), ("s3", "unmatched"), ("s4", "ambiguous")}


def test_segments(spark):
    o = segments.SegmentOptions
    rows = [(1, "h", None, "heading", "H", 0, 1), (1, "p1", None, "paragraph", "a" * 600, 10, None), (1, "p2", None, "paragraph", "b" * 600, 700, None), (1, "t", None, "table", None, 1400, None), (1, "c1", "t", "table_cell", "x" * 900, 1401, None), (1, "c2", "t", "table_cell", "y" * 900, 2400, None), (1, "p3", None, "paragraph", "z", 3400, None), (1, "p3", None, "paragraph", "z", 3400, None), (2, "e", None, "paragraph", "", 0, None), (None, "n", None, "paragraph", "null doc", None, None)]
    df = spark.createDataFrame(rows, "doc long, id string, parent string, kind string, text string, byte_start long, level int").withColumn("segment", F.lit("clash"))
    got = [(r.doc, r.segment, r.nodes, r.ancestry, r.bytes) for r in segments.segment(df, o()).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, ["h", "p1", "p2"], [], 1201), (1, 1, ["c1", "c2"], ["h"], 1801), (1, 2, ["p3"], ["h"], 2), (None, 0, ["n"], [], 8)], key=str)
    over = [(r.segment, r.nodes, r.overlap) for r in segments.segment(df.where("doc = 1"), o(target=500, maximum=700, overlap=1, ancestry=False, atomic=())).collect()]
    assert over == [(0, ["h", "p1"], []), (1, ["p2"], ["p1"]), (2, ["c1"], ["p2"]), (3, ["c2"], ["c1"]), (4, ["p3"], ["c2"])]
    shards = segments.segment(df.where("doc = 1"), o(), shard=1000).collect()
    assert [n for r in sorted(shards, key=lambda r: (r.shard, r.segment)) for n in r.nodes] == ["h", "p1", "p2", "c1", "c2", "p3"] and all(r.ancestry == ["h"] for r in shards if r.shard)
    assert [(r.event, r.sequence) for r in segments.events(segments.segment(df.where("doc = 1"), o())).orderBy("sequence").collect()] == [("segment", 0), ("segment", 1), ("segment", 2), ("terminal", 3)]
    spans = json.loads(segments.segment(df.where("doc = 1"), o()).where("segment = 1").first().spans)
    assert spans == [["h", "ancestry", 0, 1], ["c1", "content", 1, 901], ["c2", "content", 901, 1801]]
    assert segments.segment(df.where("doc = 1"), o(unit="tokens", target=1, maximum=2, exclude=("table_cell",), ancestry=False)).count() == 4
    with pytest.raises(ValueError):
        o(target=5, maximum=4)


def test_schemas(spark):
    schema = {"type": "object", "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"$ref": "#/$defs/b"}}, "required": ["a"], "additionalProperties": False, "$defs": {"b": {"enum": ["x", "y"]}}}
    found = {(at, rule) for at, rule, _ in schemas.validate_value({"a": 0, "b": "z", "c": 1}, schema)}
    assert found == {("/a", "minimum"), ("/b", "enum"), ("/c", "additionalProperties")} and schemas.validate_value({"a": 1}, schema) == []
    assert [r for _, r, _ in schemas.validate_value([1, 1], {"uniqueItems": True, "maxItems": 1, "items": {"type": "string"}})] == ["type", "type", "maxItems", "uniqueItems"]
    assert schemas.unknown_enum_values({"a": 1, "b": "z"}, schema) == [("/b", '"z"')]
    after = {"type": "object", "properties": {"a": {"type": ["integer", "null"], "minimum": 2}, "n": {}}, "required": ["n"], "additionalProperties": False}
    assert set(schemas.differences(schema, after)) == {("/properties/b", "property_removed", True), ("/properties/n", "required_property_added", True), ("/properties/a", "type_widened", False), ("/properties/a", "minimum_tightened", True)} | {("/properties/a", "no_longer_required", False)}
    df = spark.createDataFrame([(1, '{"a": 0}'), (2, "{"), (3, None), (4, '{"a": 5}')], "id long, v string")
    assert {(r.id, r.rule) for r in schemas.validate(df, "id", "v", schema).collect()} == {(1, "minimum"), (2, "json")}
    m = schemas.Migrations()
    m.register("f", "1", "2", lambda v: v + ["2"])
    m.register("f", "2", "3", lambda v: v + ["3"])
    m.register("f", "1", "3", lambda v: v + ["direct"])
    assert m.migrate("f", "1", "3", []) == ["direct"] and m.route("f", "1", "2") == ["1", "2"]
    with pytest.raises(LookupError):
        m.route("f", "3", "1")
    named = schemas.renamed(spark.createDataFrame([(None, "x", 1)], "name string, title string, k int"), {"title": "name"}, {"k": 7, "z": "d"})
    assert [tuple(r) for r in named.select("name", "k", "z").collect()] == [("x", 1, "d")]


def test_ingest(spark, tmp_path):
    inner = zipped(**{"deep.txt": "deep"})
    inputs = ingest.inputs(spark, [ingest.Request("1", b'{"a": 1}', hint=None), ingest.Request("2", "a,b\n1,2\n"), ingest.Request("3", io.BytesIO(b"\x89PNG\r\n\x1a\n")), ingest.Request("4", b"\x00\x01\x02" * 50)])
    envelopes, nodes = ingest.ingest(inputs)
    got = {r.request_id: (r.format, r.status) for r in envelopes.collect()}
    assert got["1"] == ("json", "complete") and got["2"] == ("csv", "complete") and got["3"][0] == "png" and got["4"] == (None, "unknown") and nodes.where("request_id = '2' and kind = 'cell'").count() == 4
    assert ingest.metrics(envelopes).agg(F.sum("inputs")).first()[0] == 4
    with pytest.raises(ValueError, match="repeat"):
        ingest.inputs(spark, [ingest.Request("1", b""), ingest.Request("1", b"")])
    with pytest.raises(ValueError, match="more than"):
        ingest.inputs(spark, [ingest.Request("1", b"abc")], limit=2)
    for name, body in {"a.py": "x = 1", ".gitignore": "*.log\n!keep.log\nout/\n", "b.log": "l", "keep.log": "k", "out/c.py": "c", "src/d.rs": "fn d() {}", "src/.hid": "h", "img.png": "p", "big.txt": "x" * 500}.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(body)
    found = ingest.repository(spark, str(tmp_path / "r"), ingest.RepositoryOptions(exclude=("src/*.rs",), limit=400))
    listed = {r.path: (r.disposition, r.reasons) for r in found.collect()}
    assert listed["a.py"] == ("parsed", []) and listed["b.log"][1] == ["ignored"] and listed["keep.log"][0] == "parsed" and listed["out/c.py"][1] == ["ignored"] and listed["src/d.rs"][1] == ["glob_excluded"]
    assert listed["src/.hid"][1] == ["hidden"] and listed["img.png"][1] == ["binary"] and listed["big.txt"][1] == ["too_large"] and found.where("sha256 is not null").count() == 2
    assert {r.of: r.entries for r in ingest.inventory_hashes(found).collect()}["source"] == 2
    assert ingest.glob_pattern("a/**/b*.{c,d}") == "^a/(?:.*/)?b[^/]*\\.(?:c|d)$"
    boxes = spark.createDataFrame([(1, zipped(**{"in.zip": inner, "x.gz": gzip.compress(b"gz"), "../bad": "no", "plain.txt": "deep"})), (2, b"none")], "id long, c binary")
    members = containers.members(boxes, "id", "c").collect()
    assert {(r.path, r.depth, r.disposition) for r in members} == {("in.zip", 1, "extracted"), ("x.gz", 1, "extracted"), ("../bad", 1, "rejected"), ("plain.txt", 1, "extracted"), ("in.zip!deep.txt", 2, "extracted"), ("x.gz!member-0", 2, "extracted")}
    all_ = containers.members(boxes, "id", "c")
    assert {r.uses for r in containers.artifacts(all_).where("bytes = 4").collect()} == {2}
    containers.store(all_, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4
    status = {r.path: r.status for r in containers.materialize(all_, str(tmp_path / "files")).collect()}
    assert status["plain.txt"] == "written" and status["in.zip"] == "refused_archive"
    assert containers.members(boxes.where("id = 2"), "id", "c").count() == 0


def test_extension(spark, tmp_path):
    p = extension.Parsers.builtin()
    assert p.select("md").format == "markdown" and p.select("nothing") is None
    with pytest.raises(ValueError):
        p.register(extension.Descriptor("mine", "json"), lambda d, o: Tree("mine"))
    p.register(extension.Descriptor("mine", "json", priority=5, caller=True), lambda d, o: Tree("mine"))
    assert p.select("json").id == "mine" and p.parse(b"", "json")[0][3] == "mine"
    df = spark.createDataFrame([("json",), ("py",), ("?",)], "name string")
    assert {r["name"]: r.parser for r in p.resolve(df, "name").collect()} == {"json": "mine", "py": "builtin.python", "?": None}

    def read(data, options):
        if data == b"bad":
            raise RuntimeError(f"no {options['api_key']}")
        return [{"text": data.decode(), "confidence": 0.5}]

    data = spark.createDataFrame([(1, b"a"), (2, b"bad"), (3, None)], "id long, c binary")
    asked = extension.execute(data, "id", "c", extension.Provider("ocr", "p", "1", read, "m"), {"api_key": "s3cret"})
    got = {r.id: (r.status, r.error, r["items"]) for r in asked.collect()}
    assert got == {1: ("succeeded", None, '[{"confidence":0.5,"text":"a"}]'), 2: ("failed", "RuntimeError: no ***", None), 3: ("missing", None, None)}
    assert extension.execute(data.where("id = 1"), "id", "c", extension.Provider("ocr", "p", "1", read), {"api_key": "x"}).first().status == "failed"
    assert {r.id: r.status for r in extension.replay(data, "id", "c", "ocr", asked.where("id = 1"), {"api_key": "other"}).collect()} == {1: "succeeded", 2: "not_recorded", 3: "not_recorded"}
    used = spark.createDataFrame([("a", 5, 3, 1), ("a", 6, 9, 0), ("b", 1, 1, 0)], "op string, nodes long, depth long, out long")
    assert {(r.op, r.axis): r.used for r in extension.Budget(nodes=10, depth=10).usage(used, "op").collect()} == {("a", "nodes"): 11, ("a", "depth"): 9, ("b", "nodes"): 1, ("b", "depth"): 1}
    assert [tuple(r) for r in extension.Budget(nodes=10).exhausted(used, "op", "out").collect()] == [("a", "budget.nodes.exhausted", 11, 10, "partial")] and extension.Budget.untrusted().depth == 256
    cache, calls = extension.Cache(spark, str(tmp_path / "cache")), []

    def compute(rows):
        calls.append(rows.count())
        return rows.select("key", F.concat(F.lit("v"), "n").alias("value"))

    rows = spark.createDataFrame([("sha256:aa", 1), ("sha256:bb", 2)], "key string, n int")
    assert {r.value for r in cache.load_or_compute(rows, "key", compute)[0].collect()} == {"v1", "v2"}
    more = rows.union(spark.createDataFrame([("sha256:cc", 3)], rows.schema))
    values, fresh = cache.load_or_compute(more, "key", compute)
    assert {r.value for r in values.collect()} == {"v1", "v2", "v3"} and [r.key for r in fresh.collect()] == ["sha256:cc"] and calls == [2, 1]
    key = lambda **o: one(spark, extension.cache_key("op", F.lit("sha256:x"), "p", "1", o, ["b", "a", "b"]))
    assert key(a=1, b=2) == key(b=2, a=1) != key(a=1)
    can = extension.capabilities(spark, p)
    assert can.where("kind = 'format' and name = 'pdf' and available").count() == 1 and extension.unsupported(can).where("kind = 'provider'").count() == 4
    assert extension.normalized('{"b": "/root/x", "a": {"t": 1}}', ["/a/t"], "/root") == '{"a":{},"b":"<root>/x"}'


def test_render(spark):
    rows = [(1, "a", "heading", "T *x*", 2, None, 0), (1, "b", "paragraph", "p_q", None, None, 10), (1, "c", "code_fence", "a```b", None, None, 20), (1, "d", "table_row", None, None, ["1|", "2"], 30), (1, "e", "odd", "raw", None, None, 40)]
    df = spark.createDataFrame(rows, "doc long, id string, kind string, text string, level int, cells array<string>, place long")
    text = render.render(df, "markdown").first().text
    assert text == "## T \\*x\\*\n\np\\_q\n\n````\na```b\n````\n\n| 1\\\\\\| | 2 |\n\n```\n[odd] raw\n```\n" or text.startswith("## T \\*x\\*\n\np\\_q\n\n````\na```b\n````\n\n| 1")
    assert render.render(df, "html", "lossy").first().text == "<h2>T *x*</h2>\n\n<p>p_q</p>\n\n<pre><code>a```b</code></pre>\n\n<tr><td>1|</td><td>2</td></tr>\n"
    assert render.render(df, "latex", "lossy").first().text.startswith("\\subsection{T *x*}\n\np\\_q\n\n\\begin{verbatim}") and [json.loads(x)["id"] for x in render.render(df, "json").first().text.strip().split(",\n")] == list("abcde")
    for format in render.FORMATS:
        assert render.map_problems(render.source_map(df, format), render.render(df, format)).count() == 0
    broken = render.source_map(df, "text").withColumn("start", F.col("start") + 1)
    assert render.map_problems(broken, render.render(df, "text")).count() > 0
    assert [tuple(r) for r in render.losses(df, "text", "lossy").collect()] == [(1, "omitted", 1)]
    with pytest.raises(ValueError):
        render.render(df, "markdown", "strict")
    assert render.render(df, "text", "lossy", shard=15).count() == 3
    clause = spark.createDataFrame([(1, "n", "paragraph", "If a, b must c.", None, None, 0)], df.schema)
    nodes, mapping = render.transform(clause, ["identity", "extract_obligations"])
    assert {r.id for r in nodes.collect()} == {"n", "n:condition", "n:obligation", "n:required-state"} and mapping.where("change = 'derived'").count() == 3
    assert {(r.source, r.relation, r.target) for r in render.obligation_edges(clause).collect()} == {("n:obligation", "conditional_on", "n:condition"), ("n:obligation", "requires", "n:required-state"), ("n:obligation", "derived_from", "n"), ("n", "evidence_for", "n:obligation")}
    with pytest.raises(ValueError):
        render.transform(clause, ["identity", "identity"])


def test_reconcile(spark):
    native = spark.createDataFrame([(1, 0, 0, 5, "a"), (2, 0, 0, 5, "b")], "media long, item int, start_ms long, end_ms long, text string")
    tries = spark.createDataFrame([(1, "p", "succeeded", 0, 0, 5, "A"), (1, "q", "failed", 0, 0, 5, "no")], "media long, provider string, status string, item int, start_ms long, end_ms long, text string")
    assert [(r.media, r.position, r.origin, r.text) for r in reconcile.transcripts(native, tries).orderBy("position").collect()] == [(1, 0, "native", "a"), (1, 1, "provider", "A")]
    regions = "page long, id string, text string, l double, t double, r double, b double"
    have, read = spark.createDataFrame([(1, "n1", "Hello world", 0.0, 0.0, 10.0, 2.0)], regions), spark.createDataFrame([(1, "r1", "hello World", 0.0, 0.0, 10.0, 2.0), (1, "r2", "hello world", 50.0, 50.0, 60.0, 52.0), (1, "r3", "other", 0.0, 0.0, 10.0, 2.0)], regions)
    new, gone = reconcile.new_regions(have, read)
    assert {r.id for r in new.collect()} == {"r2", "r3"} and [(r.id, r.native_id) for r in gone.collect()] == [("r1", "n1")]
    figures = spark.createDataFrame([(1, "f", "figure", 0.0, 10.0, 5.0, 20.0)], "page long, id string, kind string, l double, t double, r double, b double")
    captions = spark.createDataFrame([(1, "c1", "figure", 0.0, 22.0, 5.0, 24.0), (1, "c2", "figure", 0.0, 30.0, 5.0, 32.0), (1, "c3", "table", 0.0, 20.0, 5.0, 21.0)], "page long, id string, kind string, l double, t double, r double, b double")
    assert reconcile.nearest_captions(figures, captions).first().caption == "c1"
    place = "page long, id string, x double, top double, table_id string"
    order = reconcile.reading_order(spark.createDataFrame([(1, "b1", 0.0, 9.0, None), (1, "b2", 0.0, 5.0, "t1")], place), spark.createDataFrame([(1, "t1", 0.0, 5.0)], "page long, id string, x double, top double"), spark.createDataFrame([(1, "f1", 0.0, 20.0)], "page long, id string, x double, top double"))
    assert [r.id for r in order.orderBy("position").collect()] == ["f1", "b1", "t1"]
    glyphs = spark.createDataFrame([(1, 0, float(x), float(x + 1), 0.0 + 5 * y, 2.0 + 5 * y, 2.0, c) for y in (0, 1) for x, c in ((0, "a"), (1, "b"), (2, " "), (3, "c"), (9, "d"))], "page long, line int, l double, r double, t double, b double, h double, char string")
    lined = reconcile.lines(glyphs.drop("line"))
    assert [r.text for r in reconcile.tokens(lined).orderBy("line", "token").collect()] == ["ab", "c", "d"] * 2
    assert [r["column"] for r in reconcile.columns(spark.createDataFrame([(1, 0.0, 4.0), (1, 1.0, 5.0), (1, 9.0, 12.0)], "page long, l double, r double")).orderBy("l").collect()] == [0, 0, 1]
    blocks = spark.createDataFrame([(1, p, f"Title {p}", 0.95) for p in (1, 2, 3)] + [(1, p, f"- {p} -", 0.05) for p in (1, 2)] + [(1, 1, "once", 0.95), (1, 1, "mid", 0.5)], "doc long, page int, text string, y double")
    found = {r.kind: (r.pattern, r.pages, r.confidence) for r in reconcile.repeated_regions(blocks, spark.createDataFrame([(1, 4)], "doc long, pages long")).collect()}
    assert found["header"] == ("title #", 3, 0.9075) and found["page_number"][1] == 2
    entries = spark.createDataFrame([(1, 0, "n")], "image long, item int, text string")
    attempts = spark.createDataFrame([(1, "p", "succeeded", "a b", 0, "a"), (1, "p", "succeeded", "a b", 1, "b"), (2, "p", "succeeded", "whole", 0, "part")], "image long, provider string, status string, whole string, item int, text string")
    assert [(r.image, r.text) for r in reconcile.image_texts(entries, attempts).orderBy("image", "position").collect()] == [(1, "n"), (1, "a"), (1, "b"), (2, "whole"), (2, "part")]


def test_walks(spark):
    nodes = spark.createDataFrame([(1, k, None, f"n{k}", "function") for k in "abcd"], "graph_id long, id string, qualified_name string, name string, kind string")
    edges = spark.createDataFrame([(1, "a", "calls", "b"), (1, "b", "calls", "c"), (1, "b", "likes", "d"), (1, "c", "calls", "a")], "graph_id long, source string, relation string, target string")
    found = walks.walks(walks.code_edges(nodes, edges))
    first = found.where("root = 'a'").first()
    assert first.nodes == ["a", "b", "c"] and first.labels[0] == "na[function]"
    key = spark.createDataFrame([(["x", "y", "x"], ["p", "q", "p"])], "n array<string>, l array<string>").select(walks.signature(F.col("n"), F.col("l")).alias("s"), walks.signature(F.col("n")).alias("f")).first()
    assert key.s.key == "n=2;t=0.1.0;l=p,q,p;e=0>1,1>0" and key.f.labels == ["-", "-", "-"]
    known = spark.createDataFrame([("f1", ["a", "b", "c"], ["p", "q", "r"]), ("f1", ["q", "r", "q"], ["p", "q", "p"]), ("f2", ["k", "l", "m", "n"], ["p", "q", "r", "p"])], "family string, nodes array<string>, labels array<string>")
    seen = spark.createDataFrame([(7, ["x", "y", "z"], ["u", "v", "w"])], "walk_id long, nodes array<string>, labels array<string>")
    counts = walks.relax(known, seen)
    assert {r.family: r.instances for r in counts.collect()} == {"f1": 1, "f2": 1} and walks.dominant(counts).first().family is None
    assert {(r.length, r.family): r.instances for r in walks.trajectory(known, seen).collect()} == {(1, "f1"): 2, (2, "f1"): 2, (3, "f1"): 1, (1, "f2"): 1, (2, "f2"): 1, (3, "f2"): 1}
    assert walks.dominant(walks.relax(known, seen, 2)).first().family == "f1" and walks.dropped(seen, 1).first().nodes == ["x", "z"]


def test_summary(spark):
    df = spark.createDataFrame([(1, '{"a": [{"x": 1}, {"x": null, "y": "s"}], "actor": "Ann", "ts": "5", "id": "i1"}'), (1, '{"actor": "Bo", "ts": "30", "type": "t"}'), (2, "{"), (3, None)], "g long, v string").withColumn("n", F.monotonically_increasing_id())
    facts = summary.structure(df.where("v like '%x%' or g > 1"), "g", "v").orderBy("g").collect()
    assert tuple(facts[0])[1:] == (3, 1, 1, 0, 1, 4, 4) and facts[1].objects is None
    assert {(r.path, r.member): (r["items"], r.present) for r in summary.arrays(df, "g", "v").collect()} == {("/a", None): (2, 2), ("/a", "x"): (2, 2), ("/a", "y"): (2, 1)}
    assert [tuple(r) for r in summary.people(df, "g", "v").collect()] == [(1, ["Ann", "Bo"])]
    times = df.where("g = 1").select("g", F.get_json_object("v", "$.ts").alias("t"))
    assert tuple(summary.extent(times, "g", "t").first()) == (1, "5", "30") and tuple(summary.extent(times.union(times.select("g", F.lit("x"))), "g", "t").first()) == (1, "30", "x")
    assert [r.id for r in summary.representatives(df, "g", "n", "v", 1).where("g = 1").collect()] == ["i1"]
    assert tuple(summary.limited(spark.createDataFrame([(1, c) for c in "cabb"], "g long, c string"), "g", "c", 2).first()) == (1, "a, b", 1)


def test_streams(spark, tmp_path):
    good = protocol.emitted(spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "stream string, n int"), "stream", ["n"])
    assert protocol.problems(good).count() == 0 and protocol.collect_batch(good).count() == 3 and protocol.problems(protocol.within_budget(good, 1)).count() == 0
    bad = spark.createDataFrame([("a", "item", 0, "complete", None), ("b", "item", 1, "complete", None), ("b", "terminal", 2, "complete", 1), ("c", "item", 0, "partial", None), ("c", "terminal", 1, "complete", 2), ("d", "terminal", 0, "complete", 0), ("d", "terminal", 1, "complete", 0)], good.schema)
    assert {(r.stream, r.problem) for r in protocol.problems(bad).collect()} == {("a", "missing_terminal"), ("b", "sequence_gap"), ("c", "count_mismatch"), ("c", "complete_with_partial"), ("d", "several_terminals")}
    with pytest.raises(ValueError):
        protocol.collect_batch(bad)
    text = 'Well:\n```json\n{"a": 1}\n```\nand {"b": 2} done'
    chunks = [("x", i // 7, text[i : i + 7], i + 7 >= len(text)) for i in range(0, len(text), 7)]
    schema = "stream string, position long, chunk string, last boolean"
    whole = [(r.event, r.grammar, r.value) for r in protocol.answer_events(spark.createDataFrame(chunks[::-1], schema)).orderBy("sequence").collect()]
    assert whole[-1] == ("terminal", None, None) and [(e, v) for e, g, v in whole if e == "finished"] == [("finished", '{"a":1}'), ("finished", '{"b":2}')]
    source = tmp_path / "chunks"
    for part in (chunks[3:], chunks[:3]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = protocol.answer_events(stream).writeStream.format("memory").queryName("answers").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    live = [(r.event, r.value) for r in spark.table("answers").orderBy("sequence").collect()]
    assert live[-1][0] == "terminal" and [v for e, v in live if e == "finished"] == ['{"a":1}', '{"b":2}'] and [e for e, _ in live].count("started") == 2
    box = tmp_path / "in"
    box.mkdir()
    (box / "m.csv").write_text("a,b\n1,2\n")
    (box / "m.mbox").write_text("From x Mon\nSubject: s\n\nhi\n")
    for name, found, kind in (("s1", protocol.ingest_stream(spark, str(box)), "cell"), ("s2", protocol.record_stream(spark, str(box), "mbox"), "message")):
        q = found.where(f"kind = '{kind}'").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("s1").count() == 4 and spark.table("s2").count() == 1


def test_projects(spark):
    files = [("p", "main.tex", "\\documentclass{a}\\input{ch/one}\\include{missing}"), ("p", "ch/one.tex", "\\input{two}"), ("p", "ch/two.tex", "x"), ("p", "old.tex", "\\documentclass{a}"), ("q", "a.tex", "\\input{b}"), ("q", "b.tex", "y")]
    df = spark.createDataFrame(files, "project string, path string, text string")
    rows = parse(df.withColumn("k", F.struct("project", "path")), "k", "text", "latex").select("k.*", "*")
    assert {(r.source, r.target, r.resolved) for r in projects.includes(rows, df).collect()} == {("main.tex", "ch/one.tex", True), ("main.tex", "missing.tex", False), ("ch/one.tex", "ch/two.tex", True), ("a.tex", "b.tex", True)}
    assert {(r.project, r.path, r.rank, r.reach) for r in projects.roots(rows, df).collect()} == {("p", "main.tex", 1, 2), ("p", "old.tex", 2, 0), ("q", "a.tex", 1, 1)}
    found = projects.database_logs(spark.createDataFrame([("a.db", 5), ("a.db-wal", 9), ("b.sqlite", 5), ("b.sqlite-wal", 0)], "path string, bytes long"))
    assert {r.path: r.status for r in found.collect()} == {"a.db": "partial", "b.sqlite": "complete"}
    nodes = spark.createDataFrame([(1, "f", "figure", None, 5, 1), (1, "c", "caption", "t", 1, 2), (1, "r", "raw", None, 1, 2), (1, "", "paragraph", "p", 1, 2)], "graph_id long, id string, kind string, text string, byte_start long, byte_end long")
    edges = spark.createDataFrame([(1, "e", "c", "f", "caption_for", True, None)], "graph_id long, id string, source string, target string, relation string, inferred boolean, rule string")
    assert {(r.id, r.figure) for r in projects.figure_groups(nodes, edges).collect()} == {("f", "f"), ("c", "f")}
    assert {(r.rule, r.subject) for r in projects.contract_violations(nodes, edges).collect()} == {("reversed_range", "f"), ("raw_without_text", "r"), ("inferred_without_rule", "e")}
    assert projects.migrated(nodes).where("id like 'doc:node:%' and evidence = 'explicit'").count() == 1
    items = projects.work_items(spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("c", ["zz"]), ("c", None)], "key string, deps array<string>"))
    assert {(r.problem, r.subject) for r in projects.dependency_problems(items).collect()} == {("duplicate_id", "c"), ("unknown_dependency", "zz"), ("cycle", "a")} and items.where("status = 'open'").count() == 4
    said = spark.createDataFrame([(1, '{"command": "run", "x": 1}'), (2, '{"command": "rm"}'), (3, "hello"), (4, '{"command": "run", "y": 1}'), (5, None)], "id long, t string")
    assert {r.id: r.outcome for r in projects.commands(said, "id", "t", ["run"], ["x"]).collect()} == {1: "accepted", 2: "rejected", 3: "none", 4: "rejected", 5: "none"}
    assert all(schemas.validate_named(n, v) == [] for n, v in schemas.EXAMPLES.items()) and set(schemas.EXAMPLES) == set(schemas.CATALOGUE)
