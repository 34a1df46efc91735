import random

from quillspan.operators.hierarchy import descendants, endless_nodes, hierarchy

SCHEMA = "doc long, id string, parent string, path string, depth string"


def rows(spark, links):
    return spark.createDataFrame([(*x, "clash", "clash") for x in links], SCHEMA)


def brute(links):
    parent = {}
    for d, i, p in links:
        if d is not None and i is not None and (p or (d, i) not in parent):
            old = parent.get((d, i))
            parent[d, i] = min(filter(None, [old, p])) if (old or p) else None
    out = {}
    for d, i in parent:
        path, at = [i], parent[d, i]
        while at and (d, at) in parent and len(path) <= len(parent):
            path.insert(0, at)
            at = parent[d, at]
        out[d, i] = None if len(path) > len(parent) else path
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    links = [(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(130)]
    links += [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "below", "a"), (2, "leaf", "below"), (2, "self", "self")]
    links += [(3, "x", ""), (3, "y", "nowhere"), (3, "z", "y"), (3, "z", "y"), (4, "a", None)]
    links += [(5, f"n{i}", f"n{rng.randrange(40)}") for i in range(40)]
    links += [(6, "root", None)] + [(6, f"s{i}", "root") for i in range(300)]
    want = brute(links)
    df = rows(spark, links)
    tree = hierarchy(df, "doc", "id", "parent")
    got = {(r.doc, r.id): r for r in tree.collect()}
    assert {k: (list(r.path) if r.path is not None else None) for k, r in got.items()} == want
    for k, path in want.items():
        assert got[k].depth == (None if path is None else len(path) - 1)
        assert got[k].root == (None if path is None else path[0])
    assert {(r.doc, r.id) for r in endless_nodes(df, "doc", "id", "parent").collect()} == {k for k, p in want.items() if p is None}
    pairs = {(r.doc, r.id, r.descendant, r.distance) for r in descendants(tree, "doc", "id").collect()}
    assert pairs == {(d, a, i, len(p) - 1 - n) for (d, i), p in want.items() if p for n, a in enumerate(p[:-1])}


def test_nulls_and_empty(spark):
    df = rows(spark, [(None, "a", None), (1, None, "a"), (1, "a", None)])
    assert sorted(r.status for r in hierarchy(df, "doc", "id", "parent").collect()) == ["root", "unnamed", "unnamed"]
    none = rows(spark, [(1, "a", None)]).where("doc = 2")
    assert hierarchy(none, "doc", "id", "parent").count() == 0
    assert endless_nodes(none, "doc", "id", "parent").count() == 0
