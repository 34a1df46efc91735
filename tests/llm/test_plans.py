from quillspan.llm import plans


def test_p2_blocks_takes_all_kinds_and_raw(spark, tmp_path):
    long = "The reader stops at the first of the anchors that has no end and the caller sees what it is. " * 4
    rows = [
        ("a", "paragraph", long, long), ("b", "strong", "x_y", "**x_y**"), ("c", "code_fence", "a = **b\n", "```\na = **b\n```"), ("d", "inline_math", "x_5", "$x_5$"), ("e", "html_block", "<i>n</i>", "<div><i>n</i></div>"),
        ("f", "list", None, "- **one** `a*b*`\n- two"), ("g", "table_row", None, "| **p** | q |"), ("h", "thematic_break", None, "---"), ("i", "list_item", "**one**", "- **one**"), ("j", "footnote_definition", "see it", "[^6]: see it"),
    ]
    df = [(1, k, kind, text, raw, n) for n, (k, kind, text, raw) in enumerate(rows)]
    spark.createDataFrame([*df, df[0]], "md_doc_id long, id string, kind string, text string, raw string, byte_start long").write.parquet(f"{tmp_path}/markdown_nodes.parquet")
    got = {r.id: r for r in plans.p2_blocks(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and {k: (r.plain, r.plain_raw) for k, r in got.items() if k != "a"} == {
        "b": ("x_y", "x_y"), "c": ("a = **b\n", "```\na = **b\n```"), "d": ("x_5", "$x_5$"), "e": ("n", "n"), "f": (None, "- one `a*b*`\n- two"), "g": (None, "p | q"), "h": (None, ""), "i": ("one", "- one"), "j": ("see it", "see it"),
    }
    assert {k for k, r in got.items() if r.label == "bad"} == {"h"} and got["c"].marks == got["d"].marks == 0 and got["f"].marks > 0


def test_p6_turns_end_at_long_pauses(spark, tmp_path):
    rows = [(1, n, 1100 * n + 60_000 * (n > 20), 1100 * n + 60_000 * (n > 20) + 1000, "Anna Berg", f"word{n} said") for n in range(40)]
    spark.createDataFrame(rows, "recording_id long, segment_index int, start_ms long, end_ms long, speaker string, text string").write.parquet(f"{tmp_path}/transcript_segments.parquet")
    spark.createDataFrame([(1, 1, "Anna Berg")], "recording_id long, speaker_no int, full_name string").write.parquet(f"{tmp_path}/recording_speakers.parquet")
    spark.createDataFrame([(1, "en")], "recording_id long, language string").write.parquet(f"{tmp_path}/recordings.parquet")
    assert sorted(r.segment_index for r in plans.p6_turns(spark, str(tmp_path)).collect()) == [0, 21]
    assert [r.segment_index for r in plans.p6_found(spark, str(tmp_path)).collect()] == [0]
