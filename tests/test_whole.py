from collections import Counter

from quillspan.plans import reference


def test_event_walks(spark, tmp_path):
    events = [(i, (7 * i) % 40, i % 2, "abc"[(i * i) % 3]) for i in range(40)] + [(90 + i, i, 5, "a") for i in range(3)]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = Counter()
    for user in (0, 1, 5):
        seen = {}
        trace = [seen.setdefault(e[3], len(seen)) for e in sorted(events, key=lambda e: (e[1], e[0])) if e[2] == user]
        want[len(trace), ".".join(map(str, trace))] += 1
    got = {(r.length, r.trace): r.walks for r in reference.event_walks(spark, str(tmp_path)).collect()}
    assert got == want and sum(n * k for (n, _), k in got.items()) == len(events)


def test_repeated_lines(spark, tmp_path):
    texts = {1: "Page 1 of 9\r\nbody one\rPAGE  2 of 9", 2: "page 7 of 12\n\nother", 3: "other\nother\n", 4: None, 5: "", 6: "alone\nalone"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.pattern: (r.documents, r.occurrences) for r in reference.repeated_lines(spark, str(tmp_path)).collect()}
    assert got == {"page # of #": (2, 3), "other": (2, 3)}
