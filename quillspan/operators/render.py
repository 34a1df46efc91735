"""Document graphs as text: Markdown, HTML, LaTeX, plain text and canonical JSON, with a source map and what was lost.

A node's own markup is a column expression; the nodes of a document are then put in order, one behind the other. Documents
are rendered shard by shard of their reading order, so that no task holds a document of any length: a shard is ``SHARD``
bytes of source text, and its text begins where the shards before end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T

FORMATS = ("markdown", "html", "latex", "text", "json")
POLICIES = ("strict", "raw_fallback", "lossy")
SHARD = 8 << 20
# Kinds of nodes that are rendered.
KNOWN = ("heading", "section", "paragraph", "list_item", "code_fence", "code_block", "block_quote", "quote", "table_row", "display_math", "equation", "thematic_break", "rule", "frontmatter")


def _cells(cells: Column, format: str) -> Column:
    escaped = F.transform(cells, {"markdown": lambda c: F.replace(T.escape_markdown(c), F.lit("|"), F.lit("\\|")), "html": lambda c: F.concat(F.lit("<td>"), T.escape_html(c), F.lit("</td>")), "latex": T.escape_latex}.get(format, lambda c: c))
    if format == "markdown":
        return F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))
    if format == "html":
        return F.concat(F.lit("<tr>"), F.array_join(escaped, ""), F.lit("</tr>"))
    return F.array_join(escaped, {"latex": " & "}.get(format, "\t")) if format != "latex" else F.concat(F.array_join(escaped, " & "), F.lit(r" \\"))


def _body(format: str) -> Column:
    """The markup of a node (kind, text, level, cells); null for a kind that is not known."""
    kind, text, level = F.col("kind"), F.coalesce("text", F.lit("")), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))
    head, code, quote, math, rule = kind.isin("heading", "section"), kind.isin("code_fence", "code_block", "frontmatter"), kind.isin("block_quote", "quote"), kind.isin("display_math", "equation"), kind.isin("thematic_break", "rule")
    row = F.when(kind == "table_row", _cells(F.coalesce("cells", F.array().cast("array<string>")), format))
    if format == "markdown":
        plain = T.escape_markdown(text)
        out = F.when(head, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), plain)).when(code, T.inert_code(text)).when(quote, F.regexp_replace(plain, "(?m)^", "> ")).when(kind == "list_item", F.concat(F.lit("- "), plain)).when(math, F.concat(F.lit("$$\n"), text, F.lit("\n$$"))).when(rule, "---")
    elif format == "html":
        plain = T.escape_html(text)
        out = F.when(head, F.concat(F.lit("<h"), level.cast("string"), F.lit(">"), plain, F.lit("</h"), level.cast("string"), F.lit(">"))).when(code, F.concat(F.lit("<pre><code>"), plain, F.lit("</code></pre>"))).when(quote, F.concat(F.lit("<blockquote>"), plain, F.lit("</blockquote>")))
        out = out.when(kind == "list_item", F.concat(F.lit("<li>"), plain, F.lit("</li>"))).when(math, F.concat(F.lit("<pre>"), plain, F.lit("</pre>"))).when(rule, "<hr>")
        plain = F.concat(F.lit("<p>"), plain, F.lit("</p>"))
    elif format == "latex":
        plain = T.escape_latex(text)
        name = F.element_at(F.array(*map(F.lit, ("section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph"))), level)
        out = F.when(head, F.concat(F.lit("\\"), name, F.lit("{"), plain, F.lit("}"))).when(code, F.concat(F.lit("\\begin{verbatim}\n"), F.replace(text, F.lit("\\end{verbatim}"), F.lit("\\end {verbatim}")), F.lit("\n\\end{verbatim}")))
        out = out.when(quote, F.concat(F.lit("\\begin{quote}\n"), plain, F.lit("\n\\end{quote}"))).when(kind == "list_item", F.concat(F.lit("\\item "), plain)).when(math, F.concat(F.lit("\\["), text, F.lit("\\]"))).when(rule, "\\hrule")
    else:
        plain = text
        out = F.when(head | code | quote | math | (kind == "list_item"), text).when(rule, "")
    return F.when(kind == "table_row", row).otherwise(F.when(kind == "paragraph", plain).otherwise(out))


def _json() -> Column:
    """A node as canonical JSON: members in order of their names, none for nulls."""
    return F.to_json(F.struct(F.col("cells").alias("cells"), F.col("id").alias("id"), F.col("kind").alias("kind"), F.col("level").alias("level"), F.col("text").alias("text")))


def pieces(nodes: DataFrame, format: str, policy: str = "raw_fallback") -> DataFrame:
    """doc, id, place, body and loss of each node that is rendered. nodes: doc, id, kind, text, level, cells, place.

    Kinds that are not known are an error (``strict``), stay as inert text with a mark of their kind (``raw_fallback``), or
    are left out and counted as lost (``lossy``).
    """
    if format not in FORMATS or policy not in POLICIES:
        raise ValueError(f"unknown format {format} or policy {policy}")
    rows = nodes.withColumn("known", F.col("kind").isin(*KNOWN) if format != "json" else F.lit(True))
    if policy == "strict":
        odd = rows.where("not known").select("kind").first()
        if odd is not None:
            raise ValueError(f"no rendering for {odd[0]}")
    mark = {"markdown": lambda t: T.inert_code(t), "html": lambda t: F.concat(F.lit("<pre data-raw>"), T.escape_html(t), F.lit("</pre>")), "latex": lambda t: F.concat(F.lit("\\begin{verbatim}\n"), t, F.lit("\n\\end{verbatim}"))}.get(format, lambda t: t)
    raw = mark(F.concat(F.lit("["), "kind", F.lit("] "), F.coalesce("text", F.lit(""))))
    body = _json() if format == "json" else F.coalesce(F.when(F.col("known"), _body(format)), raw if policy == "raw_fallback" else F.lit(None))
    return rows.select("doc", "id", "place", body.alias("body"), F.when(~F.col("known"), F.lit("raw" if policy == "raw_fallback" else "omitted")).alias("loss"))


def render(nodes: DataFrame, format: str, policy: str = "raw_fallback", shard: int = SHARD) -> DataFrame:
    """doc, shard and text of each document, in shards of its places; put one behind the other they are the document."""
    rows = pieces(nodes, format, policy).where("body is not null").withColumn("shard", F.floor(F.coalesce("place", F.lit(0)) / shard))
    parts = F.array_sort(F.collect_list(F.struct("place", "id", "body")))
    sep = ",\n" if format == "json" else "\n\n"
    return rows.groupBy("doc", "shard").agg(F.concat(F.array_join(F.transform(parts, lambda p: p["body"]), sep), F.lit("\n")).alias("text"))


def source_map(nodes: DataFrame, format: str, policy: str = "raw_fallback", shard: int = SHARD) -> DataFrame:
    """doc, shard, id, start and end: the bytes of a shard's text that a node became, its separator included."""
    rows = pieces(nodes, format, policy).where("body is not null").withColumn("shard", F.floor(F.coalesce("place", F.lit(0)) / shard))
    order = Window.partitionBy("doc", "shard").orderBy("place", "id")
    last = F.row_number().over(Window.partitionBy("doc", "shard").orderBy(F.desc("place"), F.desc("id"))) == 1
    size = F.octet_length("body") + F.when(last, 1).otherwise(2)
    rows = rows.withColumn("size", size)
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc", "shard", "id", (end - F.col("size")).alias("start"), end.alias("end"))


def map_problems(mapping: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, shard and problem of maps that do not cover their text: a gap, an overlap, or another end than the text's."""
    order = Window.partitionBy("doc", "shard").orderBy("start", "end")
    was = F.coalesce(F.lag("end").over(order), F.lit(0))
    steps = mapping.withColumn("problem", F.when(F.col("start") > was, "gap").when(F.col("start") < was, "overlap").when(F.col("end") < F.col("start"), "reversed")).where("problem is not null").select("doc", "shard", "problem")
    ends = mapping.groupBy("doc", "shard").agg(F.max("end").alias("end"))
    short = texts.join(ends, ["doc", "shard"], "left").where(F.coalesce("end", F.lit(0)) != F.octet_length("text")).select("doc", "shard", F.lit("end").alias("problem"))
    return steps.unionByName(short)


def losses(nodes: DataFrame, format: str, policy: str = "raw_fallback") -> DataFrame:
    """doc, loss and nodes: what was not rendered as itself."""
    return pieces(nodes, format, policy).where("loss is not null").groupBy("doc", "loss").agg(F.count("*").alias("nodes"))


def transform(nodes: DataFrame, operations: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, source map) after an ordered list of different operations: ``identity`` and ``extract_obligations``, which
    adds a condition, an obligation and a required state for each clause. Map: doc, id, source_id and change
    (``preserved`` or ``derived``). Every input node is kept."""
    if not operations or len(set(operations)) < len(operations) or set(operations) - {"identity", "extract_obligations"}:
        raise ValueError("operations must be known, different and at least one")
    mapping = nodes.select("doc", "id", F.col("id").alias("source_id"), F.lit("preserved").alias("change"))
    if "extract_obligations" in operations:
        rows = nodes.where("kind in ('paragraph', 'text', 'requirement') and text is not null").withColumn("o", T.obligation(F.col("text"))).where("o is not null")
        made = F.array(*[F.struct(F.concat_ws(":", "id", F.lit(k)).alias("new_id"), F.lit(kind).alias("kind"), F.col(f"o.{field}").alias("text")) for k, kind, field in (("condition", "condition", "condition"), ("obligation", "obligation", "action"), ("required-state", "requirement", "action"))])
        derived = rows.select("doc", F.col("id").alias("source_id"), "place", F.explode(made).alias("x"))
        nodes = nodes.unionByName(derived.select("doc", F.col("x.new_id").alias("id"), "x.kind", "x.text", "place"), allowMissingColumns=True)
        mapping = mapping.unionByName(derived.select("doc", F.col("x.new_id").alias("id"), "source_id", F.lit("derived").alias("change")))
    return nodes, mapping


def obligation_edges(nodes: DataFrame) -> DataFrame:
    """doc, source, relation and target: the four edges of each clause found in nodes (doc, id, kind, text)."""
    rows = nodes.where("kind in ('paragraph', 'text', 'requirement') and text is not null").withColumn("o", T.obligation(F.col("text"))).where("o is not null")
    n = lambda k: F.concat_ws(":", "id", F.lit(k))
    edges = F.array(*[F.struct(a.alias("source"), r.alias("relation"), b.alias("target")) for a, r, b in (
        (n("obligation"), F.lit("conditional_on"), n("condition")), (n("obligation"), F.col("o.relation"), n("required-state")), (n("obligation"), F.lit("derived_from"), F.col("id")), (F.col("id"), F.lit("evidence_for"), n("obligation")),
    )])
    return rows.select("doc", F.explode(edges).alias("e")).select("doc", "e.*")


def write(df: DataFrame, path: str, format: str = "json") -> None:
    """A table as files of JSON lines, or its only text column as text."""
    (df.write.mode("overwrite").json if format == "json" else df.write.mode("overwrite").text)(path)
