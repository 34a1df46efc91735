from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import cues, graph, lines, mail, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    def f(g, *v):
        return one(spark, g(*map(F.lit, v)))

    assert f(T.collapsed, " a\xa0\n b　") == "a b"
    assert one(spark, T.excerpt(F.lit("abcdef"), 4)) == "abc…" and one(spark, T.excerpt(F.lit("abcd"), 4)) == "abcd"
    assert f(T.subject_key, "Re: FWD: re:  A  b") == "a b" and f(T.digit_mask, "Page  12 of 300") == "page # of #"
    assert f(T.is_page_number, "– 12 –") and f(T.is_page_number, "page iv") and not f(T.is_page_number, "chapter")
    assert f(T.message_ids, "<a@b> <c@d>") == ["<a@b>", "<c@d>"] and f(T.message_ids, "x y") == ["x", "y"]
    assert f(T.clock_ms, "01:02:03,004") == 3723004 and f(T.clock_ms, "02:03.004") == 123004 and f(T.clock_ms, "1:2:3") is None
    assert f(T.zone_minutes, "Mon, 1 Jan 2024 10:00:00 -0530") == -330 and f(T.zone_minutes, "1 Jan 2024 EST") == -300 and f(T.zone_minutes, "x") is None
    assert f(T.safe_link, " JavaScript:x") == "#blocked-active-uri" and f(T.safe_link, "http://a/(b)") == "http://a/%28b%29"
    assert [f(T.value_kind, x) for x in ("", "TRUE", "-12", "012", "1.5e3", "2024-01-02", "2024-01-02T03:04:05Z", "x")] == ["null", "boolean", "integer", "text", "decimal", "date", "date-time", "text"]
    assert [one(spark, T.cell_label(F.lit(r), F.lit(c))) for r, c in ((0, 0), (1, 25), (2, 26), (0, 701), (0, 702), (8, 18278), (0, 12356630))] == ["A1", "Z2", "AA3", "ZZ1", "AAA1", "AAAA9", "AAAAAA1"]
    assert f(T.without_thoughts, "a<think>b\nc</think>d<think>e") == "a" + " " * 8 + "\n" + " " * 9 + "d" + " " * 8
    assert f(T.speaker_prefix, "ANNA B: hi") == "ANNA B" and f(T.speaker_prefix, "Anna: hi") is None
    o = f(T.obligation, "If the  file is open, the reader must not write to it..")
    assert tuple(o) == ("if", "the file is open", "the reader", "must_not", "prohibition", "write to it", "forbids")
    assert tuple(f(T.obligation, "when x, may go, and must stay"))[1:5] == ("x", "may go, and", "must", "positive")  # "must" is looked for before "may"
    assert tuple(f(T.obligation, "Unless x, MAY go."))[2:] == (None, "may", "permission", "go", "allows")
    assert all(f(T.obligation, x) is None for x in ("No condition here", "If x, it will go", "If x must go", "If , it must go", "If x, it must.")) and f(T.escape_html, "<a&'>") == "&lt;a&amp;&#39;&gt;" and f(T.pointer, "a/b~c") == "a~1b~0c"
    a, b = F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "abc"))
    assert one(spark, T.jaccard(a, b)) == 2 / 3 and one(spark, T.dice(a, b)) == 2 / 3


def test_lines(spark):
    df = spark.createDataFrame([(1, "é\r\nab\rc"), (2, ""), (3, None), (4, "x" * 1600 + "\n" + "y" * 400)], "id long, t string")
    assert [(r.id, r.line_no, r.line, r.byte_start, r.byte_end) for r in lines.lines(df.where("id < 4").union(df.where("id = 1")), "id", "t").orderBy("id", "line_no").collect()] == [(1, 0, "é", 0, 2), (1, 1, "ab", 4, 6), (1, 2, "c", 7, 8)]
    ends = spark.createDataFrame([(1, "a\n\r\n\rb\r\n")], "id long, t string")
    assert [(r.line, r.byte_start, r.byte_end) for r in lines.lines(ends, "id", "t").orderBy("line_no").collect()] == [("a", 0, 1), ("", 2, 2), ("", 4, 4), ("b", 5, 6)]
    assert {r.id: r.n_segments for r in lines.segments(df, "id", "t").collect()} == {1: 1, 2: 0, 4: 2}


def test_row_range(spark):
    df = spark.range(1000).selectExpr("id % 7 as a", "id as b", "id * 2 as c").repartition(13)
    assert [tuple(r) for r in records.select_rows(df, ["a", "b"], 140, 10, ["b", "c"]).orderBy("b").collect()] == sorted((b, 2 * b) for a, b in sorted((i % 7, i) for i in range(1000))[140:150])
    assert records.select_rows(df, ["a", "b"], 990, 100, []).count() == 10 and records.select_rows(df, ["a"], 1000, 5, []).count() == 0
    assert records.select_rows(df.where("a < 0"), ["a"], 0, 5, []).count() == 0


def test_threads_and_layers(spark):
    df = spark.createDataFrame([(1, "<a>", None, "x"), (2, "<b>", ["<a>", "", "<zz>"], "Re: x"), (3, "<a>", ["<b>"], None), (4, None, ["<b>", "<b>"], "y"), (4, None, ["<b>", "<b>"], "y")], "stable_id long, message_id string, in_reply_to array<string>, subject string")
    assert {(r.stable_id, r.reference, r.target) for r in mail.links(df).collect()} == {(2, "<a>", 1), (2, "<zz>", None), (3, "<b>", 2), (4, "<b>", 2)}
    both = mail.thread_links(df.withColumn("references", F.array(F.lit("<a>"), F.lit("<q>"))))
    assert {(r.relation, r.reference, r.target) for r in both.where("stable_id = 2").collect()} == {("in_reply_to", "<a>", 1), ("in_reply_to", "<zz>", None), ("references", "<a>", 1), ("references", "<q>", None)}
    assert {r.subject_key: r.messages for r in mail.subject_groups(df).collect()} == {"x": 2, "y": 1}
    edges = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "a", "c"), (0, "x", "y"), (0, "y", "x"), (0, "y", "z"), (0, "c", None)], "graph_id long, source string, target string")
    assert {r.id: r.layer for r in graph.layers(edges).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}
    nodes = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (0, "")], "graph_id long, id string")
    found = {(r.rule, r.subject): r.n for r in graph.violations(nodes, spark.createDataFrame([(0, "a", "b"), (0, "a", "b"), (0, "b", "b"), (0, "b", "q")], "graph_id long, source string, target string")).collect()}
    assert found == {("duplicate_id", "a"): 2, ("empty_id", ""): 1, ("parallel_edge", "a>b"): 2, ("self_loop", "b"): 1, ("unknown_endpoint", "q"): 1}


def test_cues_and_citations(spark):
    df = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 5, 8), (1, 2, 9, 12), (1, 3, 12, 13), (1, 3, 12, 13), (2, 0, 5, None)], "t long, i int, s long, e long")
    assert {(r.i, r.other_index, r.overlap_ms) for r in cues.overlaps(df, "t", "i", "s", "e").collect()} == {(1, 0, 3), (2, 0, 1)}
    candidates = spark.createDataFrame([(1, "a", "h1"), (1, "b", "h2"), (1, "c", "h3"), (1, "d", "h3"), (1, "e", "h9")], "scope long, id string, text_hash string")
    anchors = spark.createDataFrame([(1, "a", "h1"), (1, "z", "h2"), (1, "y", "h3"), (1, "e", "h0"), (1, "q", "h7"), (1, "n", None)], "scope long, anchor string, text_hash string")
    assert {r.anchor: r.status for r in records.verify_citations(anchors, candidates).collect()} == {"a": "exact", "z": "relocated", "y": "ambiguous", "e": "changed", "q": "missing", "n": "missing"}
    outer = spark.createDataFrame([(1, "p", 0, 9000), (1, "q", 4000, 4300), (1, "r", 4100, 4200)], "doc long, id string, a long, b long")
    assert {r.id: r.holder for r in records.enclosing(outer, outer).collect()} == {"p": None, "q": "p", "r": "q"}
