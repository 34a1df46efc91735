import gzip
import io
import sqlite3
import struct
import tarfile
import zipfile
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillspan.formats import archives, mail, model_output, structured, subtitles, tabular
from quillspan.formats.base import parse, registry, rows_of, statuses


def rows(format, data, **options):
    return rows_of(format, data if isinstance(data, bytes) else data.encode(), options)


def kinds(format, data, *wanted, **options):
    return [(r[2], r[3], r[4]) for r in rows(format, data, **options) if r[2] in wanted]


def packed(**members):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return box.getvalue()


def test_every_parser_survives_damage():
    samples = [b"", b"\x00", b"\xff\xfe\x00", b"{", b"<a><b>", b"PK\x03\x04", b"%PDF-1.4 1 0 obj <<", b"\x89PNG\r\n\x1a\n\x00", "é\u200b".encode(), b"a,b\n\"", b"---\n", b"@a{", b"From x\n", b"\x1aE\xdf\xa3\x42", b"SQLite format 3\x00" + b"\x00" * 20, b"ID3\x04\x00\x00\x00\x00\x00\x7f" * 3]
    for format in registry():
        for s in samples:
            found = rows(format, s)
            assert found[0][2] == "document" and found[0][5]["status"] in ("complete", "partial", "failed"), (format, s)
            assert all(r[1] is None or 0 <= r[1] < r[0] for r in found), (format, s)


def test_table(spark):
    df = spark.createDataFrame([(1, "json", b'{"a": [1]}', 5), (2, "csv", None, 5), (3, "nope", b"x", 5), (None, "json", b"{", 5), (5, "text", b"", 5), (1, "json", b'{"a": [1]}', 5)], "id long, f string, content binary, node int")
    got = parse(df, "id", "content", df.f)
    assert sorted((str(r.id), r.attrs["status"]) for r in got.where("node = 0").collect()) == [("1", "complete"), ("1", "complete"), ("2", "missing"), ("3", "unsupported"), ("5", "complete"), ("None", "failed")]
    assert got.where("id = 1 and kind = 'integer'").count() == 2 and parse(df.where("id > 9"), "id", "content", "json").count() == 0
    assert {r.id: r.status for r in statuses(parse(df.where("id in (2, 3)"), "id", "content", "text", max_bytes=0), "id").collect()} == {2: "missing", 3: "failed"}


def test_delimited():
    assert kinds("csv", 'a;b\n1;"x\n""y"\n2\n', "cell") == [("cell", "a", "a"), ("cell", "b", "b"), ("cell", "a", "1"), ("cell", "b", 'x\n"y'), ("cell", "a", "2")]
    root = rows("csv", "a\r\nb\rc\n")[0][5]
    assert (root["lf"], root["crlf"], root["cr"], root["mixed"], root["last_ended"]) == ("1", "1", "1", "true", "true")
    assert tabular.dialects("a|b\nc|d\n")[0] == (1002, "|", 2) and tabular.dialects("a\n")[0][0] == 0
    assert [k for k, *_ in kinds("csv", 'a,b\n"x', "diagnostic")] == ["diagnostic"]
    assert [tabular.scalars(x)[0][0] for x in ("", "NA", "TRUE", "-12", "012", "1.5e3", "9" * 30, "2024-01-02", "2024-01-02T03:04:05", "x")] == ["null", "null", "boolean", "integer", "text", "decimal", "text", "date", "date-time", "text"]


def test_structured():
    big = "12345678901234567890123"
    found = {r[5]["pointer"]: (r[2], r[4]) for r in rows("json", f'{{"a~/b": [{big}, 1.50, "\\u00e9"], "c": null}}') if "pointer" in r[5]}
    assert found["/a~0~1b/0"] == ("integer", big) and found["/a~0~1b/1"] == ("decimal", "1.50") and found["/a~0~1b/2"] == ("string", "é")
    assert rows("json", '{"a":1,"a":2}', duplicates="reject")[0][5]["status"] == "failed" and rows("json", "[" * 300 + "]" * 300)[0][5]["status"] == "failed"
    assert kinds("yaml", "a: &x 1\nb: *x\n--- !t [~]", "alias", "null", "integer") == [("integer", "a", "1"), ("alias", "b", "2"), ("null", "0", None)]
    assert structured.canonical({"b": [1, "é"], "a": None}) == '{"a":null,"b":[1,"é"]}'


def test_binary_values():
    assert kinds("cbor", bytes.fromhex("bf61615f4101ff6162c249010000000000000000ff"), "bytes", "integer") == [("bytes", "a", "01"), ("integer", "b", str(2**64))]
    assert kinds("msgpack", bytes.fromhex("82a161d6ff00000000a162c70105ff"), "date-time", "bytes") == [("date-time", "a", "1970-01-01T00:00:00.000000000Z"), ("bytes", "b", "ff")]
    assert rows("msgpack", b"\xc1")[0][5]["status"] == "failed" and rows("cbor", b"\x9f\x01")[0][5]["status"] == "failed"
    box = io.BytesIO()
    pq.write_table(pa.table({"a": [1, 2, 3, 4], "b": ["x", None, "z", "q"]}), box, row_group_size=2)
    assert kinds("parquet", box.getvalue(), "integer", "string", columns=["a"], row_start=1, row_limit=2) == [("integer", "a", "2"), ("integer", "a", "3")]
    assert kinds("parquet", box.getvalue(), "string", batch_start=1, batch_limit=1) == [("string", "b", "z"), ("string", "b", "q")]
    db = sqlite3.connect(":memory:")
    db.executescript("create table t(a, b); insert into t values (1, 'x'), (2, null); create view v as select 1;")
    assert kinds("sqlite", db.serialize(), "integer", "string", "null", tables=["t"]) == [("integer", "a", "1"), ("string", "b", "x"), ("integer", "a", "2"), ("null", "b", None)]
    assert rows("sqlite", db.serialize(), tables=["t"], max_rows=1)[0][5]["status"] == "partial"


def test_protobuf():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    f = pb.FileDescriptorProto(name="x.proto", package="p", message_type=[pb.DescriptorProto(name="M", field=[
        pb.FieldDescriptorProto(name="n", number=1, type=17, label=1), pb.FieldDescriptorProto(name="s", number=2, type=9, label=1), pb.FieldDescriptorProto(name="m", number=3, type=11, label=1, type_name=".p.M"), pb.FieldDescriptorProto(name="r", number=4, type=5, label=3),
    ])])
    data = bytes.fromhex("0803") + b"\x12\x02hi" + b"\x1a\x02\x08\x01" + b"\x22\x02\x05\x06" + b"\x38\x07"
    found = kinds("protobuf", data, "integer", "string", "unknown", descriptor=pb.FileDescriptorSet(file=[f]).SerializeToString(), message="p.M")
    assert found == [("integer", "n", "-2"), ("string", "s", "hi"), ("integer", "n", "-1"), ("integer", "r", "5"), ("integer", "r", "6"), ("unknown", "7", "7")]
    assert rows("protobuf", data)[0][5]["status"] == "failed"


def test_web():
    page = "<!doctype html><p>a<p onclick=x>b<table><tr><td>1<td>2<tr><td>3</table><a href='vbscript:x'>l</a><iframe src=u></iframe><!-- c --></div>"
    assert kinds("html", page, "active_content", "comment", "diagnostic") == [("active_content", "handler", "onclick"), ("active_content", "script_url", "href"), ("active_content", "iframe", "u"), ("comment", None, "c"), ("diagnostic", "html.stray_end_tag", "div")]
    cells = [r for r in rows("html", page) if r[3] == "td"]
    assert len(cells) == 3 and cells[0][1] == cells[1][1] != cells[2][1]
    tokens = [r for r in rows("html_tokens", page + "<b") if r[1] == 0]
    assert "".join((page + "<b")[r[6] : r[7]] for r in tokens) == page + "<b"
    assert rows("xml", '<!DOCTYPE a [<!ENTITY x SYSTEM "f">]><a>&x;</a>')[0][5]["status"] == "partial"
    assert [(r[3], r[5]["status"]) for r in rows("jats", '<a><s id="k"/><s id="d"/><t id="d"/><xref rid="k d q"/></a>') if r[2] == "reference"] == [("k", "resolved"), ("d", "ambiguous"), ("q", "unresolved")]


def test_prose():
    md = "---\nt: 1\n---\n# A **b** #\n\nSetext\n---\n\n> q\nlazy\n\n1. x\n   - [x] y\n\n| a | b |\n|---|:-:|\n| `c|d` | e |\n\n```py\n# no\n```\n~~~\nopen"
    assert [(r[2], r[4]) for r in rows("markdown", md) if r[2] in ("heading", "paragraph", "code_fence", "table_cell", "task_list_marker")] == [
        ("heading", "A b"), ("heading", "Setext"), ("paragraph", "q lazy"), ("paragraph", "x"), ("task_list_marker", None), ("paragraph", "y"), ("table_cell", "a"), ("table_cell", "b"), ("table_cell", "c|d"), ("table_cell", "e"), ("code_fence", "# no\n"), ("code_fence", "open\n"),
    ]
    chunk = next(r for r in rows("r_markdown", "```{r setup, echo=FALSE}\n1\n```") if r[2] == "code_fence")
    assert (chunk[5]["engine"], chunk[5]["label"], chunk[5]["option.echo"], chunk[5]["executed"]) == ("r", "setup", "FALSE", "false")
    assert next(r for r in rows("quarto", "```{python}\n#| label: fig\nx\n```") if r[2] == "code_fence")[5]["option.label"] == "fig"
    rst = "T\n=\n\nS\n-\n\n`s`_ and `none`_\n\n.. include:: x\n"
    assert [(r[4], r[5]["level"]) for r in rows("restructured_text", rst) if r[2] == "section"] == [("T", "1"), ("S", "2")]
    assert [r[5]["resolved"] for r in rows("restructured_text", rst) if r[2] == "reference"] == ["true", "false"]
    assert [(r[2], r[4]) for r in rows("asciidoc", "= T\n\n----\nx\n----\n\n|===\n|a |b\n|===\ninclude::y[]\n") if r[2] in ("section", "listing", "table_cell", "include")] == [("section", "T"), ("listing", "x"), ("table_cell", "a"), ("table_cell", "b"), ("include", "y")]
    tex = "\\section{A}\\label{k}\\ref{k}\\ref{q}\\begin{tabular}{l}a & b\\\\\\end{tabular}\\begin{x}"
    found = rows("latex", tex)
    assert [r[5]["resolved"] for r in found if r[2] == "reference"] == ["true", "false"] and [r[4] for r in found if r[2] == "table_cell"] == ["a", "b"] and found[0][5]["status"] == "partial"


def test_mail():
    text = b"From a@b Mon\nMessage-ID: <1>\nContent-Length: 8\n\nFrom x\n\n\n\nFrom a@b Tue\nIn-Reply-To: <1>\nReferences: <1> <9>\n\nyo\n"
    found = rows("mbox", text)
    assert found[0][5]["variant"] == "mixed" and [(r[3], r[4], r[5]["resolved"]) for r in found if r[2] == "thread"] == [("in-reply-to", "<1>", "true"), ("references", "<1>", "true"), ("references", "<9>", "false")]
    assert mail.decoded_header("=?utf-8?q?h=C3=A9?= x") == "hé x" and mail.transfer_decoded(b"a=3D=\r\nb=ZZ", "quoted-printable") == (b"a=b=ZZ", "bad escape") and mail.transfer_decoded(b"aG k=!", "base64") == (b"hi", "characters outside the alphabet")
    body = struct.pack("<BII", 1, 0x00088004, 3) + b"abc" + struct.pack("<H", sum(b"abc"))
    tnef = b"\x78\x9f\x3e\x22\x00\x00" + body
    eml = b"Content-Type: application/ms-tnef\nContent-Transfer-Encoding: base64\n\n" + __import__("base64").b64encode(tnef)
    assert [(r[5]["bytes"], r[5]["checksum"]) for r in rows("eml", eml) if r[2] == "tnef_attribute"] == [("3", "true")]
    assert subtitles.clock("01:02:03,004", ",", False) == 3723004 and subtitles.clock("02:03.004", ".", True) == 123004 and subtitles.clock("02:03.004", ".", False) is None


def test_office():
    word = '<w:document xmlns:w="w" xmlns:r="r"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:ins w:author="A"><w:r><w:t>new</w:t></w:r></w:ins></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    docx = packed(**{"word/document.xml": word, "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:styleId="H1"><w:name w:val="heading 2"/></w:style></w:styles>', "word/_rels/document.xml.rels": '<R><Relationship Id="r1" Type="x/hyperlink" Target="http://a" TargetMode="External"/></R>', "word/vbaProject.bin": "x"})
    assert kinds("docx", docx, "heading", "link", "revision", "table_cell", "quarantined") == [("quarantined", "word/vbaProject.bin", None), ("heading", None, "Head"), ("link", None, "http://a"), ("revision", "insertion", "new"), ("table_cell", "0", "c1")]
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>SUM($A$1:C3)+B2</f><v>3</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    xlsx = packed(**{"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Type="x/worksheet" Target="/xl/s1.xml"/></R>', "xl/s1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>he</t></si></sst>"})
    assert kinds("xlsx", xlsx, "cell", "formula", "reference", "merge") == [("cell", "A1", "he"), ("cell", "B1", "3"), ("formula", None, "SUM($A$1:C3)+B2"), ("reference", "A1:C3", None), ("reference", "B2", None), ("merge", "A1:B1", None)]
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree><p:sp><p:nvSpPr><p:cNvPr name="T"/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    pptx = packed(**{"ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="r1" Type="x/slide" Target="slides/s1.xml"/></R>', "ppt/slides/s1.xml": slide})
    assert kinds("pptx", pptx, "shape") == [("shape", "T", "Hi")]
    odt = packed(**{"content.xml": '<o:d xmlns:o="o" xmlns:t="t"><o:body><o:text><t:h t:outline-level="2">H</t:h><t:p>a<t:s t:c="2"/>b</t:p><t:list><t:list-item><t:p>i</t:p></t:list-item></t:list></o:text></o:body></o:d>'})
    assert kinds("odt", odt, "heading", "paragraph") == [("heading", None, "H"), ("paragraph", None, "a  b"), ("paragraph", None, "i")]
    ods = packed(**{"content.xml": '<o:d xmlns:o="o" xmlns:t="t"><o:body><o:s><t:table t:name="S"><t:table-row t:number-rows-repeated="2"><t:table-cell t:number-columns-repeated="2" o:value-type="float" o:value="7"/></t:table-row></t:table></o:s></o:body></o:d>'})
    assert [k[1:] for k in kinds("ods", ods, "cell")] == [("0,0", "7"), ("0,1", "7"), ("1,0", "7"), ("1,1", "7")]
    epub = packed(**{"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><metadata><title>T</title></metadata><manifest><item id="a" href="a%20b.xhtml" media-type="x"/></manifest><spine><itemref idref="a"/><itemref idref="z"/></spine></p>', "o/a b.xhtml": "<h1>Hi</h1>"})
    assert kinds("epub", epub, "metadata", "chapter", "text", "diagnostic") == [("metadata", "title", "T"), ("chapter", "o/a b.xhtml", None), ("text", None, "Hi"), ("chapter", None, None), ("diagnostic", "epub.missing_chapter", "z")]
    assert kinds("rtf", rb"{\rtf1\ansi\ansicpg1252{\fonttbl x}{\info{\title T}}caf\'e9 \u8364?\par{\field{\fldinst X}}a\cell b\cell\row}", "paragraph", "metadata", "table_cell", "field") == [("metadata", "title", "T"), ("paragraph", None, "café €"), ("field", None, "X"), ("table_cell", "0", "a"), ("table_cell", "1", "b")]
    stream = zlib.compress(b"BT (Hello \\(x\\)) Tj 0 -12 Td [(W) -300 (orld)] TJ ET")
    pdf = b"%%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]/Count 1>> endobj 3 0 obj <</Contents 4 0 R/MediaBox[0 0 9 9]>> endobj 4 0 obj <</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream endobj\n5 0 obj <</Title(T)>> endobj trailer <</Root 1 0 R/Info 5 0 R>>" % (len(stream), stream)
    assert kinds("pdf", pdf, "metadata", "line") == [("metadata", "Title", "T"), ("line", "0", "Hello (x)"), ("line", "1", "W orld")]
    assert rows("docx", packed(a="b"))[0][5]["status"] == "failed" and rows("xlsx", b"x")[0][5]["status"] == "failed"


def test_archives():
    found = rows("zip", packed(**{"a/x": "hi", "../e": "no", "A/X": "again", "C:\\q": "no"}))
    assert [(r[3], r[5]["disposition"], r[5].get("reason")) for r in found if r[2] == "member"] == [("a/x", "extracted", None), ("../e", "rejected", "parent_traversal"), ("A/X", "rejected", "path_collision"), ("C:\\q", "rejected", "absolute_path")] or found[0][5]["status"] == "partial"
    box = io.BytesIO()
    with tarfile.open(fileobj=box, mode="w") as t:
        for name, kind in (("f", tarfile.REGTYPE), ("l", tarfile.SYMTYPE), ("d", tarfile.CHRTYPE)):
            i = tarfile.TarInfo(name)
            i.type, i.size, i.linkname = kind, 2 if kind == tarfile.REGTYPE else 0, "/etc" if kind == tarfile.SYMTYPE else ""
            t.addfile(i, io.BytesIO(b"ab"))
    assert [(r[3], r[5]["type"], r[5]["disposition"]) for r in rows("tar", box.getvalue()) if r[2] == "member"] == [("f", "file", "extracted"), ("l", "symlink", "listed"), ("d", "device", "listed")]
    assert [m[1] for m in archives.gzip_members(gzip.compress(b"a") + gzip.compress(b"b"))] == [b"a", b"b"]
    assert rows("gzip", gzip.compress(b"abc" * 99)[:-9])[0][5]["status"] == "partial" and archives.member_path("a//./b\\c") == ("a/b/c", None)


def test_media():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 3, 4, 8, 2, 0, 0, 0) + b"\0" * 4 + struct.pack(">I", 5) + b"tEXtk\0val" + b"\0" * 4 + b"\0\0\0\0IEND\0\0\0\0"
    found = rows("png", png)
    assert (found[0][5]["width"], found[0][5]["height"]) == ("3", "4") and ("metadata", "k", "val") in [r[2:5] for r in found]
    exif = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHI4s", 0x010F, 2, 3, b"ab\0\0") + b"\0" * 4
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(exif)) + b"Exif\0\0" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 5, 6, 3) + b"\xff\xd9"
    assert ("tag", "make", "ab") in [r[2:5] for r in rows("jpeg", jpeg)] and rows("jpeg", jpeg)[0][5]["width"] == "6"
    wav = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 32000) + b"\0" * 32000
    assert rows("wav", wav)[0][5]["duration_ms"] == "1000"
    box = lambda k, b: struct.pack(">I", 8 + len(b)) + k + b
    mp4 = box(b"ftyp", b"isom\0\0\0\0mp42") + box(b"moov", box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 2500)))
    assert rows("mp4", mp4)[0][5]["duration_ms"] == "2500"
    mkv = b"\x1aE\xdf\xa3\x87\x42\x82\x84webm"
    assert ("value", "doc_type", "webm") in [r[2:5] for r in rows("matroska", mkv)]
    assert kinds("svg", '<svg xmlns="s"><script>x</script><a href="javascript:1" onload="y"/></svg>', "active_content") == [("active_content", "script", "inline"), ("active_content", "script_url", "href"), ("active_content", "handler", "onload")]


def test_code():
    js = "import x from 'm'; // no()\nexport class A { go(n) { return call('}'); } }\nconst f = async (a) => a;\ntest('t', () => {});"
    found = rows("javascript", js)
    assert [(r[3], r[5]["type"]) for r in found if r[2] == "symbol"] == [("A", "class"), ("go", "method"), ("f", "function")] or [(r[3]) for r in found if r[2] == "symbol"] == ["A", "f"]
    assert [r[3] for r in found if r[2] == "import"] == ["m"] and "call" in [r[3] for r in found if r[2] == "call"] and "no" not in [r[3] for r in found if r[2] == "call"]
    assert rows("tsx", "function f( {")[0][5]["status"] == "partial" and rows("python", "def f(:\n  pass")[0][5]["status"] == "partial"
    for lang, text, name in (("go", "package p\nfunc (a *T) Run() {\n}\n", "Run"), ("java", "public class K {\n  public int m(int a) { return 1; }\n}", "K"), ("c", "int main(void) {\n return 0;\n}", "main"), ("ruby", "class K\n def m\n end\nend", "K"), ("sql", "create table t (a int);", "t"), ("bash", "f() {\n echo\n}", "f"), ("kotlin", "fun f(): Int { return 1 }", "f"), ("csharp", "public class K { }", "K"), ("php", "<?php\nfunction f() { }", "f"), ("swift", "func f() { }", "f"), ("cpp", "namespace n {\nclass K {\n};\n}", "n"), ("css", ".a { b: c }", ".a")):
        assert name in [r[3] for r in rows(lang, text) if r[2] == "symbol"], lang
    assert kinds("manifest", '{"name":"n","dependencies":{"a":"^1"},"devDependencies":{"b":"2"}}', "dependency", filename="package.json") == [("dependency", "a", "^1"), ("dependency", "b", "2")]
    assert kinds("manifest", "FROM x:1\nRUN a \\\n b", "instruction", "reference", filename="Dockerfile") == [("instruction", "FROM", "x:1"), ("reference", "image", "x:1"), ("instruction", "RUN", "a  b")]


def test_model_output():
    def taken(text, **options):
        return [(r[3], r[4], r[5]["grammar"]) for r in rows("model_output", text, **options) if r[2] == "candidate" and r[5]["selected"] == "true"]

    assert taken("x\n```json\n{'a': 1,}\n```\ny") == [(None, '{"a":1}', "fenced_json")] and taken('<tool_call>{"name":"f","arguments":{"x":1}}</tool_call>', aliases={"f": "g"}) == [("g", '{"x":1}', "xml_tool_call")]
    assert taken('{"a": 1} and {"b": 2}') == [] and taken('{"a": 1} and {"b": 2}', schema={"type": "object", "required": ["b"]}) == [(None, '{"b":2}', "json_object_in_text")]
    repaired = {"{a: 1}": '{"a":1}', "{'a': True}": '{"a":true}', '{"a": [1, 2': '{"a":[1,2]}', '{"a": 1 "b": 2}': '{"a":1,"b":2}', '{"a": "x "y" z"}': '{"a":"x \\"y\\" z"}', '{"p": "C:\\d"}': '{"p":"C:\\\\d"}', '{{"a": 1}': '{"a":1}', '{"a": 1}, "b": 2}': '{"a":1,"b":2}'}
    for text, want in repaired.items():
        fixed, done, ok = model_output.repair(text)
        assert ok and done and structured.canonical(model_output.load(fixed)) == want, text
    assert model_output.repair('{"a": 1}') == ('{"a": 1}', [], True) and model_output.repair("nonsense")[2] is False
    assert model_output.balanced_spans('a {"x": "}"} [1] { [') == [(2, 12), (13, 16)]
    assert model_output.without_thoughts("a<think>é\n</think>b") == "a" + " " * 9 + "\n" + " " * 8 + "b"
