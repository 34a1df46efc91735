"""Property graphs as JSON or YAML, and documents with a machine-readable block."""

from __future__ import annotations

import json
import re

from quillspan.formats.base import MAX_DEPTH, ParseError, Tree
from quillspan.formats.prose import front_matter, parse_markdown, physical_lines
from quillspan.formats.structured import canonical, parse_json

# The fields a graph, a node and an edge may have, and must have.
GRAPH_FIELDS = {"schema_version", "id", "nodes", "edges", "attributes", "attrs", "directed"}
NODE_FIELDS = {"id", "labels", "label", "kind", "attributes", "attrs", "name"}
EDGE_FIELDS = {"id", "source", "target", "label", "kind", "directed", "attributes", "attrs"}


def depth(value: object) -> int:
    """How deep a value nests; a scalar has depth 0."""
    level, todo = 0, [value]
    while todo := [c for v in todo if isinstance(v, (dict, list)) for c in ([*v.values()] if isinstance(v, dict) else v) or [None]]:
        level += 1
    return level


def _graph(tree: Tree, value: object) -> Tree:
    if not isinstance(value, dict) or not isinstance(value.get("nodes"), list) or not isinstance(value.get("edges"), list):
        raise ParseError("a graph has lists of nodes and edges")
    for k in sorted(set(value) - GRAPH_FIELDS):
        tree.warn("graph.unknown_field", k)
    for kind, fields, needed in (("node", NODE_FIELDS, ("id",)), ("edge", EDGE_FIELDS, ("source", "target"))):
        for i, item in enumerate(value[kind + "s"]):
            if not isinstance(item, dict) or any(not isinstance(item.get(k), str) for k in needed):
                tree.warn(f"graph.malformed_{kind}", f"{kind} {i}")
                continue
            attrs = item.get("attributes", item.get("attrs")) or {}
            labels = item.get("labels") or [item[k] for k in ("label", "kind") if isinstance(item.get(k), str)]
            node = tree.add(kind, 0, item.get("id"), canonical(attrs), position=i, label=",".join(map(str, labels)) or None, source=item.get("source"), target=item.get("target"), directed=item.get("directed", value.get("directed", True)) if kind == "edge" else None, depth=depth(attrs))
            for k in sorted(set(item) - fields):
                tree.warn("graph.unknown_field", k, parent=node)
            if depth(attrs) > MAX_DEPTH:
                raise ParseError("attributes nest too deeply")
    tree.set(0, nodes=len(value["nodes"]), edges=len(value["edges"]), version=value.get("schema_version"))
    return tree


def parse_graph_json(data: bytes, options: dict) -> Tree:
    found = parse_json(data, {"duplicates": "reject"})
    return _graph(Tree("graph_json", checked=found.rows[0][3]), json.loads(data.decode("utf-8-sig")))


def parse_graph_yaml(data: bytes, options: dict) -> Tree:
    """Aliases are refused, as one node must not stand in two places."""
    import yaml

    text = data.decode("utf-8-sig")
    if any(isinstance(e, yaml.AliasEvent) for e in yaml.parse(text)):
        raise ParseError("aliases are refused")
    return _graph(Tree("graph_yaml"), yaml.safe_load(text))


def parse_projection(data: bytes, options: dict) -> Tree:
    """A Markdown document with front matter and fenced machine blocks of JSON or YAML: its type and identity, fields,
    machine values and references."""
    import yaml

    text = data.decode("utf-8", "replace")
    head = front_matter(physical_lines(text))
    if not head or head[0] != "yaml":
        raise ParseError("no front matter", 0)
    fields = yaml.safe_load(head[1]) or {}
    if not isinstance(fields, dict):
        raise ParseError("front matter is no mapping", 0)
    tree = Tree("ldgr", type=fields.get("type") or fields.get("kind"), id=fields.get("id"))
    for k, v in fields.items():
        tree.add("field", 0, str(k), canonical(v) if isinstance(v, (dict, list)) else v)
    for r in parse_markdown(data, {}).rows:
        if r[2] == "heading":
            tree.add("heading", 0, None, r[4], r[6], r[7], level=r[5].get("level"))
        elif r[2] == "code_fence" and (lang := (r[5].get("language") or "").lower()) in ("json", "yaml", "yml"):
            try:
                value = json.loads(r[4]) if lang == "json" else yaml.safe_load(r[4])
            except (ValueError, yaml.YAMLError) as e:
                tree.warn("ldgr.malformed_block", str(e)[:200], r[6], r[7])
                continue
            node = tree.add("machine_block", 0, (r[5].get("info") or "").split()[-1], canonical(value), r[6], r[7])
            for k, v in value.items() if isinstance(value, dict) else ():
                if k in ("depends_on", "blocks", "refs", "parent", "children"):
                    for ref in v if isinstance(v, list) else [v]:
                        tree.add("reference", node, k, ref if isinstance(ref, str) else canonical(ref))
    for m in re.finditer(r"\[\[([A-Za-z][\w-]*:[\w./-]+)\]\]", text):
        tree.add("reference", 0, "link", m[1])
    return tree


PARSERS = {"graph_json": parse_graph_json, "graph_yaml": parse_graph_yaml, "ldgr": parse_projection}
