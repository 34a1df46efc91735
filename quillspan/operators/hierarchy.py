"""Parent-child links to full hierarchies by pointer doubling.

Every node first points at its parent. In each round a node takes over the pointer of the node it points at, so the
distance it has covered doubles, and the path segments of the two are joined end to end. A chain of length n is
complete after log2(n) rounds. A round in which no node reaches a top proves that none of the rest ever will: if an
open node at finite depth were left, its ancestors at the depths due in that round would have been completed by it.
What is left is on a cycle or below one.

Only nodes that are somebody's parent take part in the rounds; the others take path and root from their parent in one
join at the end. The state of each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import Scratch


def _links(nodes: DataFrame, key: str, node: str, parent: str) -> DataFrame:
    p = F.col(parent).cast("string")
    return nodes.select(F.col(key).alias("k"), F.col(node).cast("string").alias("id"), F.when(p != "", p).alias("p"))


def _double(nodes: DataFrame, key: str, node: str, parent: str, paths: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, inner nodes with a finite chain, inner nodes without one).

    Inner columns: k, id, ptr (null when finished), dist, top and, if wanted, path (top first).
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "hierarchy")
    links = _links(nodes, key, node, parent)
    refs = links.where("p is not null and k is not null").select("k", F.col("p").alias("id")).distinct()
    inner = links.where("id is not null").join(refs, ["k", "id"], "left_semi").groupBy("k", "id").agg(F.min("p").alias("p"))
    inner = scratch.put(inner, "inner")  # both sides of the next join
    known = inner.select("k", F.col("id").alias("p"), F.lit(True).alias("known"))
    state = inner.join(known, ["k", "p"], "left").select(
        "k", "id", F.when(F.col("known"), F.col("p")).alias("ptr"), F.lit(1).cast("long").alias("dist"), F.col("id").alias("top"),
        *([F.array("id").alias("path")] if paths else []),
    )
    empty = state.where(F.lit(False))
    part, n_active, n_done = _round(scratch, state.withColumn("open", F.col("ptr").isNotNull()), 0)
    done, active = [part.where("not open").drop("open")], part.where("open").drop("open")
    k = 0
    while n_active and n_done:
        k += 1
        target = active
        for d in done:
            target = target.unionByName(d)
        t = target.select("k", F.col("id").alias("ptr"), F.col("ptr").alias("t_ptr"), F.col("dist").alias("t_dist"), F.col("top").alias("t_top"), *([F.col("path").alias("t_path")] if paths else []))
        step = active.join(t, ["k", "ptr"]).select(
            "k", "id", F.col("t_ptr").alias("ptr"), (F.col("dist") + F.col("t_dist")).alias("dist"), F.col("t_top").alias("top"),
            *([F.concat("t_path", "path").alias("path")] if paths else []), F.col("t_ptr").isNotNull().alias("open"),
        )
        part, n_active, n_done = _round(scratch, step, k)
        done.append(part.where("not open").drop("open"))
        active = part.where("open").drop("open")
    finished = empty
    for d in done:
        finished = finished.unionByName(d)
    return links, finished, active if n_active else empty


def _round(scratch: Scratch, state: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """The state of round k as a table, and how many of its nodes are open and finished."""
    part = scratch.put(state, f"round{k}")
    seen = part.agg(F.count_if("open"), F.count_if(~F.col("open"))).first()
    return part, seen[0], seen[1]


def endless_nodes(nodes: DataFrame, key: str, node: str, parent: str) -> DataFrame:
    """Nodes whose chain of parents never ends, being on a cycle or below one.

    A chain ends at a null or empty parent and at a parent that is no node of the same key. Rows with a null key or
    node name are no nodes. Repeated rows count once; if they disagree about the parent, an inner node takes the
    smallest one. Returns key and node.
    """
    links, _, open_ = _double(nodes, key, node, parent, paths=False)
    below = open_.select("k", F.col("id").alias("p"))
    return links.where("id is not null").join(below, ["k", "p"], "left_semi").select(F.col("k").alias(key), F.col("id").alias(node)).distinct()


def hierarchy(nodes: DataFrame, key: str, node: str, parent: str) -> DataFrame:
    """Path, depth and root of every node.

    Returns key, node, path (array from the root to the node), depth (0 at a root), root and status: ``root`` (no
    parent), ``orphan`` (its parent is no node of this key; it counts as a root), ``child`` or ``endless`` (path, depth
    and root null). Rows whose key or node name is null have status ``unnamed`` and nulls. An empty table gives an
    empty result. Of repeated rows of one node the one with the smallest parent counts.
    """
    links, finished, open_ = _double(nodes, key, node, parent, paths=True)
    named = links.where("k is not null and id is not null").groupBy("k", "id").agg(F.min("p").alias("p"))
    up = finished.select("k", F.col("id").alias("p"), F.col("path").alias("up"), F.lit(False).alias("endless")).unionByName(
        open_.select("k", F.col("id").alias("p"), F.lit(None).cast("array<string>").alias("up"), F.lit(True).alias("endless"))
    )
    path = F.when(F.col("endless"), None).when(F.col("up").isNotNull(), F.concat("up", F.array("id"))).otherwise(F.array("id"))
    status = F.when(F.col("p").isNull(), "root").when(F.col("endless"), "endless").when(F.col("up").isNull(), "orphan").otherwise("child")
    whole = named.join(up, ["k", "p"], "left").select("k", "id", path.alias("path"), status.alias("status"))
    odd = links.where("k is null or id is null").select("k", "id", F.lit(None).cast("array<string>").alias("path"), F.lit("unnamed").alias("status"))
    return whole.unionByName(odd).select(
        F.col("k").alias(key), F.col("id").alias(node), "path", F.when(F.col("path").isNotNull(), F.size("path") - 1).alias("depth"),
        F.get("path", F.lit(0)).alias("root"), "status",
    )


def descendants(tree: DataFrame, key: str, node: str) -> DataFrame:
    """All pairs of ancestor and descendant of a table made by ``hierarchy``: key, node, descendant and distance.

    One row per pair, as the pairs are the result asked for; their number is the sum of all depths.
    """
    return (
        tree.where("depth > 0")
        .select(F.col(key), F.col(node).alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "ancestor"))
        .select(key, F.col("ancestor").alias(node), "descendant", (F.col("depth") - F.col("at")).alias("distance"))
    )
