"""Property graphs as two tables: validation, layers, indexes and canonical walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import Scratch

# Kinds of document nodes by kind of Markdown block.
NODE_KINDS = {
    "heading": "section", "paragraph": "paragraph", "list": "list", "list_item": "list_item", "table": "table", "table_row": "table_row", "table_cell": "table_cell",
    "block_quote": "quote", "code_fence": "code_block", "inline_code": "code_span", "display_math": "equation", "inline_math": "equation", "link": "link", "strong": "strong",
    "emphasis": "emphasis", "html_block": "raw", "thematic_break": "rule", "footnote_definition": "footnote",
}


def document_nodes(blocks: DataFrame) -> DataFrame:
    """graph_id, id, kind, text, ordinal and byte range of the nodes of Markdown blocks; kinds without a name stay."""
    kinds = F.create_map(*[F.lit(x) for p in NODE_KINDS.items() for x in p])
    return blocks.select(F.col("md_doc_id").alias("graph_id"), "id", F.coalesce(kinds[F.col("kind")], "kind").alias("kind"), "text", "ordinal", "byte_start", "byte_end").distinct()


def document_edges(blocks: DataFrame) -> DataFrame:
    """graph_id, source, relation and target: a ``contains`` edge from every parent, a ``references`` edge to every link's destination."""
    inner = blocks.where("parent_id != ''").select(F.col("md_doc_id").alias("graph_id"), F.col("parent_id").alias("source"), F.lit("contains").alias("relation"), F.col("id").alias("target"))
    links = blocks.where("destination is not null").select(F.col("md_doc_id").alias("graph_id"), F.col("id").alias("source"), F.lit("references").alias("relation"), F.col("destination").alias("target"))
    return inner.unionByName(links).distinct()


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, rule, subject and n: empty and repeated node ids, edges to unknown nodes, self-loops and parallel edges.

    nodes: graph_id, id; edges: graph_id, source, target.
    """
    ids = nodes.groupBy("graph_id", "id").agg(F.count("*").alias("n"))
    empty = ids.where("id is null or id = ''").select("graph_id", F.lit("empty_id").alias("rule"), F.lit("").alias("subject"), "n")
    twice = ids.where("n > 1 and id != ''").select("graph_id", F.lit("duplicate_id").alias("rule"), F.col("id").alias("subject"), "n")
    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("id"))
    unknown = ends.join(ids, ["graph_id", "id"], "left_anti").groupBy("graph_id", "id").agg(F.count("*").alias("n")).select("graph_id", F.lit("unknown_endpoint").alias("rule"), F.col("id").alias("subject"), "n")
    loops = edges.where("source = target").groupBy("graph_id", "source").agg(F.count("*").alias("n")).select("graph_id", F.lit("self_loop").alias("rule"), F.col("source").alias("subject"), "n")
    parallel = edges.groupBy("graph_id", "source", "target").agg(F.count("*").alias("n")).where("n > 1").select("graph_id", F.lit("parallel_edge").alias("rule"), F.concat_ws(">", "source", "target").alias("subject"), "n")
    return empty.unionByName(twice).unionByName(unknown).unionByName(loops).unionByName(parallel)


def layers(edges: DataFrame) -> DataFrame:
    """graph_id, id and layer (longest path from a source, null on or below a cycle) of the nodes of directed edges.

    Kahn's rounds: a round settles the nodes whose predecessors are all settled. Each round is a table in the shared
    folder and holds the nodes still open; the rounds number the longest path.
    """
    scratch = Scratch(edges.sparkSession, "layers")
    links = scratch.put(edges.where("source is not null and target is not null").select("graph_id", "source", "target").distinct(), "edges")
    nodes = links.select("graph_id", F.col("source").alias("id")).union(links.select("graph_id", "target")).distinct()
    open_ = scratch.put(nodes, "open0")
    done, k = [], 0
    while True:
        waiting = links.join(open_.withColumnRenamed("id", "source"), ["graph_id", "source"], "left_semi").select("graph_id", F.col("target").alias("id")).distinct()
        marked = open_.join(waiting.withColumn("waits", F.lit(True)), ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("waits", F.lit(False)).alias("waits"))
        step = scratch.put(marked, f"round{k}")
        if step.where("not waits").isEmpty():
            rest = step.select("graph_id", "id", F.lit(None).cast("int").alias("layer"))
            break
        done.append(step.where("not waits").select("graph_id", "id", F.lit(k).alias("layer")))
        open_, k = step.where("waits").select("graph_id", "id"), k + 1
    for d in done:
        rest = rest.unionByName(d)
    return rest


def walk_signatures(steps: DataFrame, walk: str, position: str, label: str) -> DataFrame:
    """walk, length and trace: labels replaced by the order of their first occurrence, so equal shapes get one trace."""
    first = steps.withColumn("_f", F.min(position).over(Window.partitionBy(walk, label)))
    ranked = first.withColumn("_r", F.dense_rank().over(Window.partitionBy(walk).orderBy("_f")) - 1)
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("_r").alias("r"))))
    return ranked.groupBy(walk).agg(F.count("*").alias("length"), F.array_join(F.transform(parts, lambda x: x["r"].cast("string")), ".").alias("trace"))


def heading_paths(blocks: DataFrame, shard: int = 65_536) -> DataFrame:
    """graph_id, id and path: the headings above each block in reading order, an earlier deeper one being closed by a
    later one of its level or above.

    A document is cut into shards of ``shard`` bytes. The last heading of each level is a maximum, so it is looked for in
    the block's own shard and, by way of one row per shard, in the shards before; no task holds a whole document.
    """
    place = F.struct("byte_start", "id", "text")
    rows = blocks.where("byte_start is not null").select("md_doc_id", "id", "kind", "level", "text", "byte_start").dropDuplicates(["md_doc_id", "id"])
    rows = rows.withColumns({"w": F.expr(f"byte_start div {shard}"), "k": F.struct("md_doc_id")})  # a struct is never null, so the window and the join share one shuffle
    last = {n: F.max(F.when((F.col("kind") == "heading") & (F.coalesce("level", F.lit(1)) == n), place)) for n in range(1, 7)}
    inside = Window.partitionBy("k", "w").orderBy("byte_start", "id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("d").orderBy("cw").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy(F.col("k").alias("d"), F.col("w").alias("cw")).agg(*[m.alias(f"c{n}") for n, m in last.items()])
    carry = shards.select("d", "cw", *[F.max(f"c{n}").over(earlier).alias(f"c{n}") for n in last])
    rows = rows.withColumns({f"h{n}": m.over(inside) for n, m in last.items()}).join(carry, (F.col("k") == F.col("d")) & (F.col("w") == F.col("cw")))
    rows = rows.withColumns({f"h{n}": F.greatest(f"h{n}", f"c{n}") for n in last})
    kept = []
    for n in range(1, 7):
        alive = F.col(f"h{n}").isNotNull()
        for u in (F.col(f"h{m}") for m in range(1, n)):
            alive = alive & (u.isNull() | (u < F.col(f"h{n}")))
        kept.append(F.when(alive, F.coalesce(F.col(f"h{n}.text"), F.lit(""))))
    return rows.select(F.col("md_doc_id").alias("graph_id"), "id", F.array_join(F.array_compact(F.array(*kept)), " > ").alias("path"))


def canonical_keys(nodes: DataFrame, graph: str = "graph_id", node: str = "id", parent: str = "parent", ordinal: str = "ordinal", at: str = "byte_start") -> DataFrame:
    """graph, node and key: sorting by key puts the nodes of a graph in canonical order, each behind its parent, siblings by
    ordinal (those without one last), place and id. Nodes on cycles and below them come last, by id.

    The key is the chain of these from the root, so the order is one range sort of any size and no walk over the tree.
    """
    from quillspan.operators.hierarchy import hierarchy

    rows = nodes.select(F.col(graph).alias("g"), F.col(node).alias("n"), F.nullif(F.col(parent), F.lit("")).alias("p"), F.lpad(F.coalesce(F.col(ordinal).cast("string"), F.lit("9999999999")), 10, "0").alias("o"), F.lpad(F.coalesce(F.col(at).cast("string"), F.lit("9999999999999")), 13, "0").alias("a"))
    rows = rows.where("n is not null").groupBy("g", "n").agg(F.min(F.struct("p", "o", "a")).alias("x")).select("g", "n", "x.*")
    own = F.concat_ws("\x1f", "o", "a", "n")
    named = rows.select("g", "n", "p", own.alias("k"))
    up = named.select("g", F.col("n").alias("p"), F.col("k").alias("pk"))
    linked = named.join(up, ["g", "p"], "left").select("g", "n", "k", F.coalesce("pk", "p").alias("pk"))
    tree = hierarchy(linked, "g", "k", "pk")
    key = F.coalesce(F.array_join("path", "\x1e"), F.concat(F.lit("\x7f"), "n"))
    return linked.select("g", "n", "k").join(tree.select("g", "k", "path"), ["g", "k"]).select(F.col("g").alias(graph), F.col("n").alias(node), key.alias("key"))
