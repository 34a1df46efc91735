"""Analysis of directed graphs: strongly connected components, cycle witnesses, shortest paths, order and layers, indexes,
stable identities.

Graphs come as two tables with a graph_id. A graph of up to ``BOUND`` edges is analysed by one task; that bound is checked
by counting first, and graphs above it go through ``components``, whose rounds are joins over all edges.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.session import Scratch

BOUND = 200_000


def tarjan(graph: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, each sorted, in order of their first node; without recursion."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, out = set(), [], []
    for root in sorted(graph):
        if root in index:
            continue
        work = [(root, iter(graph[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, todo = work[-1]
            nxt = next(todo, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    out.append(sorted(members))
            elif nxt not in index:
                index[nxt] = low[nxt] = len(index)
                stack.append(nxt)
                on.add(nxt)
                work.append((nxt, iter(graph[nxt])))
            elif nxt in on:
                low[node] = min(low[node], index[nxt])
    return sorted(out)


def shortest_path(graph: dict[str, list[str]], start: str, end: str, inside: set[str] | None = None) -> list[str] | None:
    """The first shortest path, neighbours being taken in order; None if there is none."""
    came: dict[str, str | None] = {start: None}
    todo = deque([start])
    while todo:
        node = todo.popleft()
        if node == end:
            path = []
            at: str | None = node
            while at is not None:
                path.append(at)
                at = came[at]
            return path[::-1]
        for n in graph.get(node, ()):
            if n not in came and (inside is None or n in inside):
                came[n] = node
                todo.append(n)
    return None


def witness(graph: dict[str, list[str]], members: list[str]) -> list[str] | None:
    """A cycle through the smallest node of a component, shortest first, ending where it begins; None for a single node
    without a loop."""
    first = members[0]
    if first in graph[first]:
        return [first, first]
    if len(members) == 1:
        return None
    inside = set(members)
    ways = [p for n in graph[first] if n in inside and (p := shortest_path(graph, n, first, inside))]
    return [first, *min(ways, key=len)]


def layered(graph: dict[str, list[str]]) -> dict[str, int]:
    """Layer of each node that is neither on a cycle nor behind one: 0 without predecessors, else one above the highest."""
    waits = dict.fromkeys(graph, 0)
    for outs in graph.values():
        for n in outs:
            waits[n] += 1
    layer, now, k = {}, sorted(n for n, w in waits.items() if not w), 0
    while now:
        after = []
        for n in now:
            layer[n] = k
            for m in graph[n]:
                waits[m] -= 1
                if not waits[m]:
                    after.append(m)
        now, k = sorted(after), k + 1
    return layer


ANALYSIS = "id string, component string, size int, cyclic boolean, layer int, position int, cycle array<string>"


def _rows(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    e = edges.where("source is not null and target is not null")
    both = e.select("graph_id", F.col("source").cast("string"), F.col("target").cast("string"))
    if "directed" in edges.columns:
        both = both.unionByName(e.where("not directed and source != target").select("graph_id", F.col("target").cast("string").alias("source"), F.col("source").cast("string").alias("target")))
    if nodes is not None:
        both = both.unionByName(nodes.where("id is not null").select("graph_id", F.col("id").cast("string").alias("source"), F.lit(None).cast("string").alias("target")))
    return both.distinct()


def analyze(edges: DataFrame, nodes: DataFrame | None = None, bound: int = BOUND) -> DataFrame:
    """graph_id and, for each node, its component (named by its smallest node), the component's size, whether it holds a
    cycle, layer and position in the stable topological order (null on and behind cycles) and, for the smallest node of a
    cyclic component, a shortest cycle through it.

    Undirected edges (column directed) count both ways. Ends of edges are nodes even if ``nodes`` does not list them.
    Graphs above ``bound`` edges raise: their components are in ``components``, their layers in ``graph.layers``.
    """
    rows = _rows(nodes, edges)
    large = rows.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("graph_id").first()
    if large is not None:
        raise ValueError(f"graph {large[0]} has more than {bound} edges")
    kind = dict(rows.dtypes)["graph_id"]

    schema = pa.schema([("id", pa.string()), ("component", pa.string()), ("size", pa.int32()), ("cyclic", pa.bool_()), ("layer", pa.int32()), ("position", pa.int32()), ("cycle", pa.list_(pa.string()))])

    def one(pairs: list[tuple[str, str | None]]) -> list[tuple]:
        graph: dict[str, list[str]] = {}
        for a, b in pairs:
            graph.setdefault(a, [])
            if b is not None:
                graph[a].append(b)
                graph.setdefault(b, [])
        for outs in graph.values():
            outs.sort()
        layer = layered(graph)
        place = {n: i for i, n in enumerate(sorted(layer, key=lambda n: (layer[n], n)))}
        out = []
        for members in tarjan(graph):
            cycle = witness(graph, members)
            out += [(n, members[0], len(members), cycle is not None, layer.get(n), place.get(n), cycle if n == members[0] else None) for n in members]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # graphs lie together in a partition, so they are read one after the other, not as a frame each
        key = held = None
        pairs: list[tuple[str, str | None]] = []
        out: list[tuple] = []
        keys: list[pa.Scalar] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in schema]
            batch = pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], kinds), *(pa.array(c, f.type) for c, f in zip(cols, schema))], ["graph_id", *schema.names])
            out.clear()
            keys.clear()
            return batch

        kinds = None
        for batch in batches:
            kinds = batch.column(0).type
            for scalar, k, a, b in zip(batch.column(0), batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if pairs and k != key:
                    found = one(pairs)
                    out += found
                    keys += [held] * len(found)
                    pairs = []
                    if len(out) > 10_000:
                        yield flush()
                key, held = k, scalar
                pairs.append((a, b))
        if pairs:
            found = one(pairs)
            out += found
            keys += [held] * len(found)
        if kinds is not None:
            yield flush()

    return rows.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(run, f"graph_id {kind}, {ANALYSIS}")


def require_acyclic(edges: DataFrame, nodes: DataFrame | None = None) -> None:
    """Raises with up to five cycles if a graph has any."""
    found = analyze(edges, nodes).where("cycle is not null").select("graph_id", "cycle").limit(5).collect()
    if found:
        raise ValueError("cycles: " + "; ".join(f"{r.graph_id}: {' > '.join(r.cycle)}" for r in found))


def components(edges: DataFrame) -> DataFrame:
    """graph_id, id and component (its smallest node) of all nodes on edges, for graphs of any size.

    Nodes without a way in or out among the rest are components of their own and are taken off first, round by round.
    Then every node takes the smallest node that reaches it, until nothing changes; the nodes of a colour from which its
    smallest node is reached backwards are a component and are taken off, and the rest starts again. The state of each
    round is a table in the shared folder; only counts reach the driver.
    """
    scratch = Scratch(edges.sparkSession, "components")
    rest = scratch.put(_rows(None, edges).where("source != target"), "edges")
    every = _rows(None, edges)
    nodes = scratch.put(every.select("graph_id", F.col("source").alias("id")).union(every.select("graph_id", "target")).distinct(), "nodes")
    done: list[DataFrame] = []
    k = 0

    def step(df: DataFrame, name: str) -> DataFrame:
        nonlocal k
        k += 1
        return scratch.put(df, f"{name}{k}")

    while not rest.isEmpty():
        size = rest.count()
        ins, outs = (rest.select("graph_id", F.col(c).alias("id")).distinct() for c in ("target", "source"))
        inner = ins.join(outs, ["graph_id", "id"])
        kept = rest.join(inner.withColumnRenamed("id", "source"), ["graph_id", "source"], "left_semi").join(inner.withColumnRenamed("id", "target"), ["graph_id", "target"], "left_semi").select("graph_id", "source", "target")
        rest = step(kept, "trim")
        if rest.count() < size:
            continue
        colour = step(rest.select("graph_id", F.col("source").alias("id"), F.col("source").alias("c")).union(rest.select("graph_id", "target", "target")).distinct(), "colour")
        while True:
            reach = rest.join(colour.withColumnRenamed("id", "source"), ["graph_id", "source"]).select("graph_id", F.col("target").alias("id"), "c")
            new = step(colour.union(reach).groupBy("graph_id", "id").agg(F.min("c").alias("c")), "colour")
            if new.join(colour.withColumnRenamed("c", "o"), ["graph_id", "id"]).where("c != o").isEmpty():
                break
            colour = new
        same = rest.join(colour.withColumnsRenamed({"id": "source", "c": "cs"}), ["graph_id", "source"]).join(colour.withColumnsRenamed({"id": "target", "c": "ct"}), ["graph_id", "target"]).where("cs = ct").select("graph_id", "source", "target", F.col("cs").alias("c"))
        same = step(same, "same")
        back = front = step(colour.where("id = c").select("graph_id", "id", "c"), "back")
        while not front.isEmpty():
            more = same.join(front.withColumnRenamed("id", "target"), ["graph_id", "target", "c"]).select("graph_id", F.col("source").alias("id"), "c").distinct()
            front = step(more.join(back.select("graph_id", "id"), ["graph_id", "id"], "left_anti").select("graph_id", "id", "c"), "front")
            back = step(back.union(front), "back")
        done.append(back.select("graph_id", "id", F.col("c").alias("component")))
        gone = back.select("graph_id", "id")
        rest = step(rest.join(gone.withColumnRenamed("id", "source"), ["graph_id", "source"], "left_anti").join(gone.withColumnRenamed("id", "target"), ["graph_id", "target"], "left_anti").select("graph_id", "source", "target"), "rest")
    found = nodes.select("graph_id", "id", F.lit(None).cast("string").alias("component")).where(F.lit(False))
    for d in done:
        found = found.unionByName(d)
    # the name of a component is its smallest node
    names = found.groupBy("graph_id", "component").agg(F.min("id").alias("name"))
    named = found.join(names, ["graph_id", "component"]).select("graph_id", "id", F.col("name").alias("component"))
    return nodes.join(named, ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("component", "id").alias("component"))


def indexes(edges: DataFrame) -> DataFrame:
    """graph_id, id, incoming and outgoing (numbers of edges) of every node; an undirected edge counts at both ends, once
    if it is a loop."""
    directed = F.col("directed") if "directed" in edges.columns else F.lit(True)
    both = ~directed & (F.col("source") != F.col("target"))
    ends = F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.when(both, 1).otherwise(0).alias("i")), F.struct(F.col("target").alias("id"), F.when(both, 1).otherwise(0).alias("o"), F.lit(1).alias("i")))
    rows = edges.where("source is not null and target is not null").select("graph_id", F.explode(ends).alias("x"))
    return rows.groupBy("graph_id", F.col("x.id").alias("id")).agg(F.sum("x.i").alias("incoming"), F.sum("x.o").alias("outgoing"))


def reachable(edges: DataFrame, starts: DataFrame, rounds: int = 1000) -> DataFrame:
    """graph_id, start, id and distance of all nodes that starts (graph_id, start) reach; breadth first, a join a round."""
    scratch = Scratch(edges.sparkSession, "reach")
    links = scratch.put(_rows(None, edges).select("graph_id", "source", "target"), "edges")
    seen = front = scratch.put(starts.select("graph_id", F.col("start").cast("string"), F.col("start").cast("string").alias("id"), F.lit(0).alias("distance")).distinct(), "front0")
    for k in range(1, rounds + 1):
        step = front.join(links.withColumnRenamed("source", "id"), ["graph_id", "id"]).select("graph_id", "start", F.col("target").alias("id"), F.lit(k).alias("distance")).distinct()
        front = scratch.put(step.join(seen.select("graph_id", "start", "id"), ["graph_id", "start", "id"], "left_anti"), f"front{k}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def stable_id(namespace: str, domain: str, *parts: Column) -> Column:
    """``namespace:domain:`` and a digest of the parts: the same parts give the same id in every run and on every cluster.
    Nulls differ from empty text."""
    body = F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate((F.lit(domain), *parts))]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{namespace}:{domain}:"), F.sha2(body, 256))


def identified(edges: DataFrame, namespace: str = "doc") -> DataFrame:
    """Edges with an id: their own, or where it is null or empty one made of graph, ends, relation and how many equal edges
    come before (by the order of their other columns)."""
    from pyspark.sql import Window

    own = F.col("id") if "id" in edges.columns else F.lit(None).cast("string")
    rest = [c for c in edges.columns if c not in ("graph_id", "source", "relation", "target", "id")]
    n = F.row_number().over(Window.partitionBy("graph_id", "source", "relation", "target").orderBy(*(rest or ["source"])))
    rows = edges.withColumn("_n", n)
    made = stable_id(namespace, "edge", F.col("graph_id").cast("string"), F.col("source"), F.col("relation"), F.col("target"), (F.col("_n") - 1).cast("string"))
    return rows.withColumn("id", F.coalesce(F.nullif(own, F.lit("")), made)).drop("_n")


def json_depth(value: str) -> Column:
    """How deep JSON text nests: brackets outside of strings, at most open at once. Null for null."""
    bare = F.regexp_replace(value, r'"(?:[^"\\]|\\.)*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["top"], now).alias("top"))

    return F.aggregate(marks, zero, step, lambda s: s["top"])
