import random

from quillspan.operators.intervals import gaps, periods

SCHEMA = "e long, s long, t long, w string, a string, b string"


def brute(rows):
    out = {}
    for e in {r[0] for r in rows}:
        spans = sorted((s, t) for x, s, t in rows if x == e and s is not None and t is not None and t > s)
        merged = []
        for s, t in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        if merged:
            out[e] = merged
    return out


def check(spark, rows, shard):
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    want = brute(rows)
    got = sorted((str(r.e), r.period_start, r.period_end) for r in periods(df, "e", "s", "t", shard).collect())
    assert got == sorted((str(e), *m) for e, ms in want.items() for m in ms)
    got = sorted((str(r.e), r.gap_start, r.gap_end) for r in gaps(df, "e", "s", "t", shard).collect())
    assert got == sorted((str(e), x[1], y[0]) for e, ms in want.items() for x, y in zip(ms, ms[1:]))


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(6), s := rng.randrange(-400, 2000), s + rng.choice([1, 3, 9, 40, 300])) for _ in range(250)]
    rows += [(7, 0, 10), (7, 10, 20), (7, 20, 21), (7, 22, 23), (8, 0, 10_000), (8, 55, 60), (8, 9_000, 12_345), (8, 20_000, 20_001)]
    rows += rows[:20] + [(9, 5, 5), (9, 7, 3), (9, None, 3), (9, 3, None), (None, 1, 2), (None, 4, 6)]
    for shard in (10, 64, 300_000):
        check(spark, rows, shard)


def test_empty(spark):
    check(spark, [(1, 5, 5)], 10)
    df = spark.createDataFrame([], SCHEMA)
    assert gaps(df, "e", "s", "t").count() == periods(df, "e", "s", "t").count() == 0
