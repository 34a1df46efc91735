"""Walks over code graphs: bounded walks from roots, their signatures, and families of walks that fit the evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relations of a code graph that walks follow, and the bounds of walks.
RELATIONS = ("contains", "calls", "imports", "implements", "extends", "references", "tests", "defines", "uses", "depends_on")
MAX_WALKS = 64
MAX_STEPS = 6
LEAST_STEPS = 3


def code_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, source, target and label of the edges of code relations, ends labelled by the first of qualified_name,
    name and id that is there."""
    name = F.coalesce("qualified_name", "name", "id")
    labels = nodes.select("graph_id", F.col("id"), F.concat_ws("", name, F.lit("["), "kind", F.lit("]")).alias("label"))
    kept = edges.where(F.col("relation").isin(*RELATIONS))
    a = labels.select("graph_id", F.col("id").alias("source"), F.col("label").alias("source_label"))
    b = labels.select("graph_id", F.col("id").alias("target"), F.col("label").alias("target_label"))
    return kept.join(a, ["graph_id", "source"]).join(b, ["graph_id", "target"]).select("graph_id", "source", "target", "relation", "source_label", "target_label")


def walks(edges: DataFrame, max_walks: int = MAX_WALKS, max_steps: int = MAX_STEPS, bound: int = 200_000) -> DataFrame:
    """graph_id, root, walk, nodes and labels of the walks from the first ``max_walks`` roots of each graph (nodes without
    a way in; if none, all), depth first in order of names, of three nodes or more. Graphs above ``bound`` edges raise."""
    large = edges.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("graph_id").first()
    if large is not None:
        raise ValueError(f"graph {large[0]} has more than {bound} edges")
    kind = dict(edges.dtypes)["graph_id"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ways: dict[str, list[str]] = {}
        label: dict[str, str] = {}
        for a, b, la, lb in zip(frame["source"], frame["target"], frame["source_label"], frame["target_label"]):
            ways.setdefault(a, []).append(b)
            label[a], label[b] = la, lb
        for outs in ways.values():
            outs.sort()
        inner = {b for outs in ways.values() for b in outs}
        roots = sorted(set(ways) - inner) or sorted(ways)
        out = []
        for root in roots[:max_walks]:
            path, seen, todo = [], set(), [root]
            while todo and len(path) < max_steps:
                node = todo.pop()
                if node in seen:
                    continue
                seen.add(node)
                path.append(node)
                todo += [n for n in reversed(ways.get(node, [])) if n not in seen]
            if len(path) >= LEAST_STEPS:
                out.append((frame["graph_id"].iloc[0], root, len(out), path, [label[n] for n in path]))
        return pd.DataFrame(out, columns=["graph_id", "root", "walk", "nodes", "labels"])

    return edges.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, root string, walk int, nodes array<string>, labels array<string>")


def trace(values: Column) -> Column:
    """Each element as the number of the first one equal to it, counted in order of first occurrence."""
    return F.transform(values, lambda x: F.array_position(F.array_distinct(values), x) - 1)


def signature(nodes: Column, labels: Column | None = None) -> Column:
    """n, trace, labels and key of a walk: nodes renumbered, labels as they are (or all alike, if none are given), the
    steps as a multiset. Equal keys mean the same shape."""
    t = trace(nodes)
    shown = F.transform(nodes, lambda x: F.lit("-")) if labels is None else labels
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat_ws(">", F.element_at(t, i).cast("string"), F.try_element_at(t, i + 1).cast("string")))
    steps = F.array_sort(F.when(F.size(t) > 1, steps).otherwise(F.array().cast("array<string>")))
    key = F.concat_ws(";", F.concat(F.lit("n="), F.size(F.array_distinct(nodes)).cast("string")), F.concat(F.lit("t="), F.array_join(F.transform(t, lambda x: x.cast("string")), ".")), F.concat(F.lit("l="), F.array_join(shown, ",")), F.concat(F.lit("e="), F.array_join(steps, ",")))
    return F.struct(F.size(F.array_distinct(nodes)).alias("n"), t.alias("trace"), shown.alias("labels"), key.alias("key"))


def relax(instances: DataFrame, evidence: DataFrame, length: int | None = None) -> DataFrame:
    """walk_id, family and instances: how many known walks (family, nodes, labels) begin as a walk of evidence (walk_id,
    nodes, labels) does, in the traces of its first ``length`` steps (all, if none is given). Walks meet by the key of
    that beginning, not pair by pair."""
    def beginning(df: DataFrame, n: Column) -> DataFrame:
        cut = F.slice("nodes", F.lit(1), n)
        return df.withColumn("_b", F.concat_ws("|", F.array_join(F.transform(trace(cut), lambda x: x.cast("string")), "."), F.array_join(F.transform(trace(F.slice("labels", F.lit(1), n)), lambda x: x.cast("string")), ".")))

    query = beginning(evidence.withColumn("_n", F.least(F.lit(length) if length else F.size("nodes"), F.size("nodes"))), F.col("_n"))
    sizes = query.select("_n").distinct()  # at most MAX_STEPS lengths
    known = beginning(instances.join(F.broadcast(sizes), F.size("nodes") >= F.col("_n")), F.col("_n"))
    return query.select("walk_id", "_n", "_b").join(known.select("family", "_n", "_b"), ["_n", "_b"]).groupBy("walk_id", "family").agg(F.count("*").alias("instances"))


def dominant(counts: DataFrame) -> DataFrame:
    """walk_id and family with the most instances; null if several share the first place."""
    rank = Window.partitionBy("walk_id").orderBy(F.desc("instances"))
    top = counts.withColumn("r", F.rank().over(rank)).where("r = 1")
    return top.groupBy("walk_id").agg(F.count("*").alias("n"), F.min("family").alias("f")).select("walk_id", F.when(F.col("n") == 1, F.col("f")).alias("family"))


def trajectory(instances: DataFrame, evidence: DataFrame) -> DataFrame:
    """walk_id, length, family and instances after each step of the evidence."""
    steps = evidence.select("walk_id", "nodes", "labels", F.explode(F.sequence(F.lit(1), F.size("nodes"))).alias("length"))
    cut = steps.select(F.struct("walk_id", "length").alias("walk_id"), F.slice("nodes", F.lit(1), F.col("length")).alias("nodes"), F.slice("labels", F.lit(1), F.col("length")).alias("labels"))
    return relax(instances, cut).select("walk_id.walk_id", "walk_id.length", "family", "instances")


def dropped(evidence: DataFrame, at: int) -> DataFrame:
    """The evidence without step ``at`` (counted from 0; the root can't be dropped)."""
    if at == 0:
        raise ValueError("the root stays")
    keep = lambda c: F.filter(F.col(c), lambda x, i: i != at)
    return evidence.withColumns({"nodes": keep("nodes"), "labels": keep("labels")})
