"""Segments of documents: atomic units of nodes packed greedily, with heading ancestry and overlap.

Packing depends on all nodes before, so it is a fold. It runs over one shard of a document at a time, the shards being
``SHARD`` bytes of the text: a document below that is packed as a whole, a longer one also ends a segment at each shard,
and no task holds a document of any length. The headings above a shard are carried into it.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.formats.structured import canonical

SHARD = 8 << 20
# Kinds of nodes by the kind of boundary they make, and kinds that stay in one piece.
BOUNDARIES = {
    "document": "document", "section": "section", "heading": "section", "paragraph": "paragraph", "list_item": "list_item", "table_row": "table_row", "row": "table_row", "code_symbol": "code_symbol", "symbol": "code_symbol", "module": "code_symbol", "class": "code_symbol", "function": "code_symbol", "method": "code_symbol",
    "page": "page", "slide": "slide", "sheet": "sheet_range", "email": "message", "message_body": "message", "notebook_cell": "notebook_cell", "cue": "transcript_cue",
}
ATOMIC = {"tables": ("table",), "code": ("code_fence", "code_block", "code_symbol"), "equations": ("display_math", "equation"), "figures": ("figure",)}


@dataclass(frozen=True)
class SegmentOptions:
    """How to pack. unit: bytes, scalars or tokens (words between white space, or what ``tokenizer`` counts).

    overlap: nodes that the next segment repeats, in whole units. include and exclude name kinds; exclude wins, and no
    include takes all. atomic: which groups of ``ATOMIC`` stay in one piece.
    """

    target: int = 1000
    maximum: int = 1500
    unit: str = "bytes"
    overlap: int = 0
    ancestry: bool = True
    preferred: tuple[str, ...] = ("section", "paragraph", "list_item", "table_row", "code_symbol")
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    atomic: tuple[str, ...] = ("tables", "code", "equations", "figures")
    metadata: tuple[str, ...] = ()
    tokenizer: object = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.target <= 0 or self.maximum <= 0 or self.target > self.maximum:
            raise ValueError("0 < target <= maximum is needed")
        if self.unit not in ("bytes", "scalars", "tokens") or self.overlap < 0:
            raise ValueError("unknown unit or negative overlap")

    def size(self, text: str) -> int:
        if self.unit == "bytes":
            return len(text.encode("utf-8", "replace"))
        if self.unit == "scalars":
            return len(text)
        return self.tokenizer(text) if self.tokenizer else len(text.split())


@dataclass
class _Node:
    id: str
    parent: str | None
    kind: str
    text: str
    level: int
    extra: str | None


def _key(node: _Node, by_id: dict[str, _Node], options: SegmentOptions) -> str:
    """The unit of a node: its outermost table, else its nearest code, equation or figure, else itself."""
    line, seen = [], set()
    at: _Node | None = node
    while at and at.id not in seen:
        seen.add(at.id)
        line.append(at)
        at = by_id.get(at.parent) if at.parent else None
    for group in ("tables", "code", "equations", "figures"):
        if group in options.atomic:
            found = [x for x in line if x.kind in ATOMIC[group]]
            if found:
                return f"{group}:{found[-1 if group == 'tables' else 0].id}"
    return f"node:{node.id}"


def pack(nodes: list[_Node], above: list[_Node], options: SegmentOptions) -> list[dict]:
    """The segments of nodes in canonical order; above: the headings open at their beginning.

    A segment closes before a unit that would take it beyond the maximum, and behind one that reaches the target and is
    a preferred boundary. Its size counts ancestry, overlap and content. A unit above the maximum is a segment of its own.
    """
    by_id = {n.id: n for n in [*above, *nodes]}
    taken = [n for n in nodes if n.kind not in options.exclude and (not options.include or n.kind in options.include) and n.text]
    units: dict[str, list[_Node]] = {}
    for n in taken:
        units.setdefault(_key(n, by_id, options), []).append(n)
    listed = list(units.values())
    active: list[_Node] = list(above)
    heads: dict[str, list[_Node]] = {}
    for n in nodes:
        heads[n.id] = list(active)
        if n.kind in ("heading", "section"):
            del active[max(0, n.level - 1) :]
            active.append(n)
    out: list[dict] = []

    def pieces(overlap: list[int], primary: list[int]) -> list[tuple[str, _Node]]:
        inside = {n.id for i in [*overlap, *primary] for n in listed[i]}
        lead = heads[listed[primary[0]][0].id] if options.ancestry else []
        return [*(("ancestry", h) for h in lead if h.id not in inside and h.text), *(("overlap", n) for i in overlap for n in listed[i]), *(("content", n) for i in primary for n in listed[i])]

    def size(overlap: list[int], primary: list[int]) -> int:
        return options.size("".join(n.text for _, n in pieces(overlap, primary)))

    def close(overlap: list[int], primary: list[int]) -> list[int]:
        parts = pieces(overlap, primary)
        text, spans, at = "", [], 0
        for role, n in parts:
            end = at + len(n.text.encode("utf-8", "replace"))
            spans.append((n.id, role, at, end))
            text, at = text + n.text, end
        lead = heads[listed[primary[0]][0].id]
        extra = {n.id: n.extra for role, n in parts if n.extra is not None and role == "content"}
        out.append({
            "segment": len(out), "text": text, "nodes": [n.id for r, n in parts if r == "content"], "overlap": [n.id for r, n in parts if r == "overlap"], "ancestry": [n.id for r, n in parts if r == "ancestry"], "titles": [h.text for h in lead],
            "spans": canonical(spans), "bytes": at, "scalars": len(text), "tokens": options.tokenizer(text) if options.tokenizer else len(text.split()), "metadata": canonical(extra) if extra else None, "sha256": "sha256:" + hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(),
        })
        chosen: list[int] = []
        count = 0
        for i in reversed([*overlap, *primary]) if options.overlap else ():
            chosen.insert(0, i)
            count += len(listed[i])
            if count >= options.overlap:
                break
        return chosen

    overlap: list[int] = []
    primary: list[int] = []
    for i, unit in enumerate(listed):
        if primary and size(overlap, [*primary, i]) > options.maximum:
            overlap, primary = close(overlap, primary), []
        primary.append(i)
        if any(BOUNDARIES.get(n.kind) in options.preferred for n in unit) and size(overlap, primary) >= options.target:
            overlap, primary = close(overlap, primary), []
    if primary:
        close(overlap, primary)
    return out


SCHEMA = "segment int, text string, nodes array<string>, overlap array<string>, ancestry array<string>, titles array<string>, spans string, bytes long, scalars long, tokens long, metadata string, sha256 string"


def segment(nodes: DataFrame, options: SegmentOptions | None = None, document: str = "doc", at: str = "byte_start", shard: int = SHARD) -> DataFrame:
    """document, shard, segment, segment_id and what a segment holds (see ``SCHEMA``), for nodes in order of ``at`` and id.

    nodes: document, id, parent, kind, text, ``at`` and, if there are, level, name, qualified_name and the attributes named
    in options.metadata (as text columns). A node's text is the first of text, name and qualified_name that is not null;
    nodes without any, or an empty one, have no place in a segment. Repeated nodes count once, nodes without a place come
    first. A parent that is no node of the shard ends the ancestry. segment_id is a digest of document, place and text.
    """
    options = options or SegmentOptions()
    cols = set(nodes.columns)
    text = F.nullif(F.coalesce(*[F.col(c) for c in ("text", "name", "qualified_name") if c in cols]), F.lit(""))
    extra = F.to_json(F.struct(*options.metadata)) if options.metadata else F.lit(None).cast("string")
    level = F.coalesce(F.col("level").cast("int"), F.lit(1)) if "level" in cols else F.lit(1)
    rows = nodes.select(F.col(document).alias("d"), F.col("id"), F.col("parent"), "kind", text.alias("t"), level.alias("level"), extra.alias("extra"), F.coalesce(F.col(at).cast("long"), F.lit(-1)).alias("a"))
    rows = rows.where("id is not null").dropDuplicates(["d", "id"]).withColumn("w", F.greatest(F.floor(F.col("a") / shard), F.lit(0)))
    head = F.when(F.col("kind").isin("heading", "section") & F.col("t").isNotNull(), F.struct("a", "id", "t", "level"))
    shards = rows.groupBy("d", "w").agg(*[F.max(F.when(F.col("level") == n, head)).alias(f"h{n}") for n in range(1, 7)])
    earlier = Window.partitionBy("d").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    carry = shards.select(F.col("d").alias("cd"), F.col("w").alias("cw"), F.array_compact(F.array(*[F.max(f"h{n}").over(earlier) for n in range(1, 7)])).alias("above"))
    rows = rows.join(carry, F.col("d").eqNullSafe(F.col("cd")) & (F.col("w") == F.col("cw"))).drop("cd", "cw")
    kind = dict(rows.dtypes)["d"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["a", "id"], kind="stable")
        d, w = frame["d"].iloc[0], frame["w"].iloc[0]
        above: list[_Node] = []
        for h in sorted(frame["above"].iloc[0], key=lambda h: (h["a"], h["id"])):
            del above[max(0, h["level"] - 1) :]
            above.append(_Node(h["id"], None, "heading", h["t"], h["level"], None))
        none = frame.astype(object).where(frame.notna(), None)
        listed = [_Node(*x) for x in zip(none["id"], none["parent"], none["kind"], [t or "" for t in none["t"]], none["level"], none["extra"])]
        found = pd.DataFrame(pack(listed, above, options), columns=[c.split()[0] for c in re.split(r",\s*", SCHEMA)])
        found.insert(0, "w", w)
        found.insert(0, "d", d)
        return found

    out = rows.groupBy("d", "w").applyInPandas(run, f"d {kind}, w long, {SCHEMA}")
    ident = F.concat(F.lit("segment:"), F.sha2(F.concat_ws("\x1f", F.col("d").cast("string"), F.col("w").cast("string"), F.col("segment").cast("string"), "sha256"), 256))
    return out.withColumn("segment_id", ident).withColumnsRenamed({"d": document, "w": "shard"})


def events(segments: DataFrame, document: str = "doc") -> DataFrame:
    """Segments as a stream of events: document, sequence, event (``segment`` or ``terminal``) and segment_id. A document
    ends with one terminal event; within it sequences have no gap."""
    order = Window.partitionBy(document).orderBy("shard", "segment")
    each = segments.select(document, (F.row_number().over(order) - 1).alias("sequence"), F.lit("segment").alias("event"), "segment_id")
    ends = segments.groupBy(document).agg(F.count("*").alias("sequence")).select(document, F.col("sequence").cast("int"), F.lit("terminal").alias("event"), F.lit(None).cast("string").alias("segment_id"))
    return each.unionByName(ends)
