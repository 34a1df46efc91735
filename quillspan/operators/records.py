"""Tabular and record operators: selection, cell kinds, widths, JSON facts, aggregate identity and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.session import Scratch


def select_rows(df: DataFrame, order: list[str], start: int, limit: int, columns: list[str]) -> DataFrame:
    """The rows ``start`` (from 0) up to ``start + limit`` in an order, and the columns wanted (none given: all).

    The table is sorted by ranges and written to the shared folder with the number of each range. The counts of ranges
    (one row each) say where a range begins, so a row's place is its place in its range and only ranges that hold wanted
    rows are numbered.
    """
    wanted = columns or df.columns
    ranged = df.select(*dict.fromkeys([*order, *wanted])).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = Scratch(df.sparkSession, "rows").put(ranged, "ranged")
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    at, begins = 0, {}
    for part in sorted(counts):
        if at < start + limit and at + counts[part] > start:
            begins[part] = at
        at += counts[part]
    if not begins:
        return df.select(*wanted).where(F.lit(False))
    first = F.element_at(F.create_map(*[F.lit(x) for p in begins.items() for x in p]), F.col("_part"))
    placed = ranged.where(F.col("_part").isin(*begins)).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + first)
    return placed.where((F.col("_n") >= start) & (F.col("_n") < start + limit)).select(*wanted)


def cell_kinds(df: DataFrame, key: str, cell: str) -> DataFrame:
    """key, value_kind and the number of cells of that kind."""
    return df.groupBy(key, T.value_kind(F.col(cell)).alias("value_kind")).agg(F.count("*").alias("cells"))


def modal_width(rows: DataFrame, key: str, width: str) -> DataFrame:
    """key, the most frequent width (the larger of equals), its rows and the rows of any other width."""
    each = rows.groupBy(key, width).agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.max_by(width, F.struct("n", width)).alias("modal_width"), F.max("n").alias("rows"), (F.sum("n") - F.max("n")).alias("ragged"))


def json_facts(df: DataFrame, group: str, value: str, field: str) -> DataFrame:
    """group, records, records with the field, distinct and extreme values of a numeric field of JSON text."""
    v = F.get_json_object(value, f"$.{field}").try_cast("bigint")
    return df.groupBy(group).agg(F.count("*").alias("records"), F.count(v).alias("present"), F.countDistinct(v).alias("values"), F.min(v).alias("low"), F.max(v).alias("high"))


def time_extent(df: DataFrame, group: str, at: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def participants(df: DataFrame, group: str, name: str) -> DataFrame:
    """group and its distinct names in order, joined by a bar."""
    return df.where(F.col(name).isNotNull()).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(name)), "|").alias("names"))


def aggregate_identity(members: DataFrame, group: str, path: str, text: str) -> DataFrame:
    """group, members, bytes and the identity of the manifest of its members (path, length and hash).

    Only paths and hashes are gathered, never texts, and no task holds the manifest of a group: its entries are put in
    256 leaves by the first byte of the path's hash, each leaf is hashed with its entries in order, and the identity is
    the hash of the digests of the leaves in order.
    """
    rows = members.where(F.col(path).isNotNull()).select(F.col(group).alias("g"), F.col(path).alias("p"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n"), F.coalesce(T.sha256(F.col(text)), F.lit("none")).alias("h")).distinct()
    entry = F.concat_ws(" ", "p", F.col("n").cast("string"), "h")
    leaves = rows.groupBy("g", F.left(F.sha2("p", 256), F.lit(2)).alias("leaf")).agg(F.count("*").alias("members"), F.sum("n").alias("bytes"), T.sha256(F.array_join(F.array_sort(F.collect_list(entry)), "\n")).alias("digest"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("leaf", "digest"))), lambda x: F.concat_ws(" ", x["leaf"], x["digest"]))
    return leaves.groupBy("g").agg(F.sum("members").alias("members"), F.sum("bytes").alias("bytes"), T.sha256(F.array_join(order, "\n")).alias("identity")).withColumnRenamed("g", group)


def verify_citations(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """scope, anchor and status for anchors (scope, anchor, text_hash) against candidates (scope, id, text_hash).

    exact: a candidate of the same id has the text; relocated: one other candidate has it; ambiguous: several have it;
    changed: the id is there with another text; missing: neither. Counts come before any join on the hash, so a hash
    shared by many candidates is joined once.
    """
    same = candidates.groupBy("scope", "id").agg(F.min("text_hash").alias("own_hash")).withColumnRenamed("id", "anchor")
    by_text = candidates.where("text_hash is not null").groupBy("scope", "text_hash").agg(F.count("*").alias("n"))
    rows = anchors.join(same, ["scope", "anchor"], "left").join(by_text, ["scope", "text_hash"], "left")
    status = F.when(F.col("own_hash") == F.col("text_hash"), "exact").when(F.col("n") == 1, "relocated").when(F.col("n") > 1, "ambiguous").when(F.col("own_hash").isNotNull(), "changed").otherwise("missing")
    return rows.select("scope", "anchor", status.alias("status"))


def enclosing(inner: DataFrame, outer: DataFrame, bucket: int = 4096) -> DataFrame:
    """For ranges (doc, id, a, b) the smallest outer range (doc, id, a, b) that holds each and is not the same range.

    A range join without pairs of all ranges: outer ranges are listed in the buckets they touch and an inner range
    looks up the bucket of its start. Ties go to the smallest id; ranges without an outer one have null.
    """
    listed = outer.where("b > a").select("doc", F.col("id").alias("holder"), F.col("a").alias("oa"), F.col("b").alias("ob"), F.explode(F.expr(f"sequence(a div {bucket}, (b - 1) div {bucket})")).alias("w"))
    found = inner.withColumn("w", F.expr(f"a div {bucket}")).join(listed, ["doc", "w"]).where("oa <= a and b <= ob and not (oa = a and ob = b)")
    best = found.groupBy("doc", "id").agg(F.min_by("holder", F.struct((F.col("ob") - F.col("oa")).alias("n"), "holder")).alias("holder"))
    return inner.select("doc", "id").join(best, ["doc", "id"], "left")
