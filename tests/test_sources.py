from pyspark.sql import functions as F

from quillspan.sources.files import delimited, inventory, json_lines, texts
from quillspan.streaming.records import json_stream, run_to_memory, terminals


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe x")
    (tmp_path / ".c.md").write_bytes(b"x")
    rows = {r.name: (r.disposition, r.skip_reasons) for r in inventory(spark, str(tmp_path), limit=3, include=r"\.txt$").collect()}
    assert rows == {"a.txt": ("parsed", ""), "b.txt": ("skipped", "too_large")} | ({".c.md": ("skipped", "hidden,glob_excluded")} if ".c.md" in rows else {})
    assert {r.path[-5:]: r.status for r in texts(spark, str(tmp_path)).collect()}["b.txt"] == "partial"


def test_json_lines(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ("",), (None,), ('{"b": 2}',)], "value string")
    assert [(r.a, r.status) for r in json_lines(df, "a long").collect()] == [(1, "complete"), (None, "malformed"), (None, "blank"), (None, "malformed"), (None, "complete")]


def test_delimited(spark):
    df = spark.createDataFrame([("a,b",), ('"x, ""y""",z',), ("1,2,3",), ("a,",)], "value string")
    assert [(r.p, r.q, r.status) for r in delimited(df, ["p", "q"]).collect()] == [("a", "b", "complete"), ('x, "y"', "z", "complete"), ("1", "2", "ragged"), ("a", "", "complete")]


def test_stream(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"a": 1}\n{"a": \n')
    (tmp_path / "two.jsonl").write_text('{"a": 1}\n\n')
    run_to_memory(terminals(json_stream(spark, str(tmp_path), "a long")), "terminal_rows", "complete")
    rows = {r.name: (r.records, r.malformed, r.status) for r in spark.table("terminal_rows").withColumn("name", F.element_at(F.split("source", "/"), -1)).collect()}
    assert rows == {"one.jsonl": (2, 1, "partial"), "two.jsonl": (1, 0, "complete")}
