"""Files that belong together: LaTeX projects, databases with their logs, figures with captions, work graphs and commands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.formats.model_output import candidates
from quillspan.formats.structured import canonical
from quillspan.operators import analysis
from quillspan.operators.schemas import renamed


def includes(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """project, source, target and resolved of the includes of LaTeX files. parsed: project, path and the rows of the LaTeX
    parser; files: project, path. A name without an ending means a .tex file; names are relative to the project's folder
    of the including file or to its top."""
    asked = parsed.where("kind = 'include' and value is not null").select("project", F.col("path").alias("source"), F.regexp_replace("value", r"^\./", "").alias("name"))
    asked = asked.withColumn("name", F.when(F.col("name").rlike(r"\.[A-Za-z]+$"), F.col("name")).otherwise(F.concat("name", F.lit(".tex"))))
    folder = F.regexp_extract("source", r"^(.*/)?[^/]*$", 1)
    tried = asked.select("project", "source", "name", F.posexplode(F.array_distinct(F.array(F.concat(folder, "name"), F.col("name")))).alias("try", "target"))
    there = files.select("project", F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    found = tried.join(there, ["project", "target"], "left")
    best = found.groupBy("project", "source", "name").agg(F.min_by(F.struct("target", "there"), F.struct(F.coalesce("there", F.lit(False)).cast("int") * -1, "try")).alias("b"))
    return best.select("project", "source", "b.target", F.coalesce("b.there", F.lit(False)).alias("resolved"))


def roots(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """project, path, rank and reach of the files that may be the root of a LaTeX project: they have a document class, or, if
    none has, are not included by another. Those not included come first, then those that reach more files."""
    links = includes(parsed, files).where("resolved")
    heads = parsed.where("node = 0").select("project", "path", (F.col("attrs")["root"] == "true").alias("class"))
    inner = links.select("project", F.col("target").alias("path")).distinct().withColumn("included", F.lit(True))
    rows = heads.join(inner, ["project", "path"], "left").fillna(False, ["included"])
    any_ = rows.groupBy("project").agg(F.bool_or("class").alias("any"))
    rows = rows.join(any_, "project").where("class or (not any and not included)")
    edges = links.select(F.col("project").alias("graph_id"), "source", "target")
    seen = analysis.reachable(edges, rows.select(F.col("project").alias("graph_id"), F.col("path").alias("start")))
    reach = seen.groupBy(F.col("graph_id").alias("project"), F.col("start").alias("path")).agg((F.count("*") - 1).alias("reach"))
    from pyspark.sql import Window

    order = Window.partitionBy("project").orderBy("included", F.desc("reach"), "path")
    return rows.join(reach, ["project", "path"], "left").fillna(0, ["reach"]).withColumn("rank", F.row_number().over(order)).select("project", "path", "rank", "reach")


def database_logs(listing: DataFrame) -> DataFrame:
    """Databases of a listing (path, bytes) with a log or journal beside them that was not replayed: what is read from the
    file alone is partial then."""
    sides = listing.where(F.col("path").rlike(r"-(wal|journal)$") & (F.col("bytes") > 0)).select(F.regexp_replace("path", "-(wal|journal)$", "").alias("path"), F.regexp_extract("path", "-(wal|journal)$", 1).alias("log"))
    per = sides.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("log")), ",").alias("logs"))
    return listing.where(F.col("path").rlike(r"\.(sqlite3?|db)$")).join(per, "path", "left").withColumn("status", F.when(F.col("logs").isNotNull(), "partial").otherwise("complete"))


def figure_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, id and figure: figures and the captions that an edge caption_for ties to them, under the figure's id."""
    figures = nodes.where("kind = 'figure'").select("graph_id", F.col("id").alias("figure"))
    tied = edges.where("relation = 'caption_for'").select("graph_id", F.col("source").alias("id"), F.col("target").alias("figure")).join(figures, ["graph_id", "figure"])
    own = tied.select("graph_id", F.col("figure").alias("id"), "figure")
    return own.union(tied.select("graph_id", "id", "figure")).distinct()


def contract_violations(nodes: DataFrame, edges: DataFrame, versions: tuple[str, ...] = ("2",)) -> DataFrame:
    """graph_id, rule and subject of what a document graph must not have: another version, a raw node without its text, a
    range that is reversed, an attribute namespace without a dot, an inferred edge without a rule.

    nodes: graph_id, id, kind, text, byte_start, byte_end and, if there are, schema_version and namespace; edges: graph_id,
    id and, if there are, inferred and rule.
    """
    has = lambda df, c: F.col(c) if c in df.columns else F.lit(None)
    found = F.array_compact(F.array(
        F.when(~F.coalesce(has(nodes, "schema_version").cast("string").isin(*versions), F.lit(True)), "schema_version"), F.when(F.col("kind").isin("raw", "raw_block", "raw_inline") & F.col("text").isNull(), "raw_without_text"),
        F.when(F.col("byte_end") < F.col("byte_start"), "reversed_range"), F.when(has(nodes, "namespace").isNotNull() & ~has(nodes, "namespace").cast("string").rlike(r"^[a-z][\w-]*(\.[\w-]+)+$"), "namespace"),
    ))
    a = nodes.select("graph_id", F.col("id").alias("subject"), F.explode(found).alias("rule"))
    b = edges.where(F.coalesce(has(edges, "inferred").cast("boolean"), F.lit(False)) & has(edges, "rule").isNull()).select("graph_id", F.col("id").alias("subject"), F.lit("inferred_without_rule").alias("rule"))
    return a.unionByName(b).select("graph_id", "rule", "subject")


def migrated(nodes: DataFrame) -> DataFrame:
    """Nodes of version 1 as version 2: an id where there is none, and evidence where it was left out."""
    made = analysis.stable_id("doc", "node", F.col("graph_id").cast("string"), F.col("kind"), F.col("byte_start").cast("string"), F.col("text"))
    evidence = F.coalesce(F.col("evidence"), F.lit("explicit")) if "evidence" in nodes.columns else F.lit("explicit")
    return nodes.withColumns({"id": F.coalesce(F.nullif("id", F.lit("")), made), "evidence": evidence, "schema_version": F.lit("2")})


def work_items(df: DataFrame) -> DataFrame:
    """Rows of a work graph with their fields under their own names, and defaults for what is missing."""
    return renamed(df, {"ident": "id", "key": "id", "title": "name", "summary": "name", "state": "status", "deps": "depends_on", "dependencies": "depends_on"}, {"status": "open"})


def dependency_problems(items: DataFrame) -> DataFrame:
    """problem and subject of a work graph (id, depends_on): repeated ids, unknown dependencies, and cycles."""
    twice = items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("problem"), F.col("id").alias("subject"))
    links = items.select(F.lit(0).alias("graph_id"), F.explode("depends_on").alias("source"), F.col("id").alias("target"))
    unknown = links.join(items.select(F.col("id").alias("source")).distinct(), "source", "left_anti").select(F.lit("unknown_dependency").alias("problem"), F.col("source").alias("subject")).distinct()
    named = analysis.components(links)
    loops = links.where("source = target").select(F.col("source").alias("subject")).union(named.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"))
    return twice.unionByName(unknown).unionByName(loops.distinct().select(F.lit("cycle").alias("problem"), "subject"))


def commands(df: DataFrame, key: str, text: str, accepted: list[str], arguments: list[str]) -> DataFrame:
    """key, command, arguments (JSON) and outcome of answers that must be one call: ``accepted``, ``rejected`` (another
    command, or arguments that are not known), ``ambiguous`` (several calls) or ``none``."""
    known, names = set(accepted), set(arguments)

    @F.pandas_udf("command string, arguments string, outcome string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            calls = []
            for c in candidates(t or ""):
                value = c.value if isinstance(c.value, dict) else {}
                command = c.command or value.get("command") or value.get("name")
                if c.ok and isinstance(command, str) and c.grammar not in ("fenced_code", "open_ai_chat_content"):
                    args = value.get("arguments", {k: v for k, v in value.items() if k not in ("command", "name")})
                    call = (command, canonical(args))
                    if call not in [x[:2] for x in calls]:
                        calls.append((*call, command in known and (not isinstance(args, dict) or set(args) <= names)))
            good = [c for c in calls if c[2]]
            pick = good[0] if len(good) == 1 else calls[0] if len(calls) == 1 else None
            out.append((pick[0], pick[1], "accepted" if pick[2] else "rejected") if pick else (None, None, "ambiguous" if calls else "none"))
        return pd.DataFrame(out, columns=["command", "arguments", "outcome"])

    return df.select(F.col(key), run(F.col(text)).alias("c")).select(key, "c.*")
