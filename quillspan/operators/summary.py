"""Facts about JSON values: structure, arrays, fields, extents, participants and rows that stand for the rest."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of an array whose own arrays are looked into.
ITEMS = 20
# Names of fields that tell who took part, when and what.
PEOPLE = ("actor", "author", "user", "sender", "from", "speaker", "owner", "assignee", "participant", "name")
TIMES = ("timestamp", "ts", "time", "at", "created_at", "date")


def facts_of(value: object) -> dict[str, int]:
    """Objects, arrays, nulls, booleans, numbers and strings of a value, and its depth (1 for a scalar)."""
    out = dict.fromkeys(("objects", "arrays", "nulls", "booleans", "numbers", "strings", "depth"), 0)
    todo = [(value, 1)]
    while todo:
        v, d = todo.pop()
        out["depth"] = max(out["depth"], d)
        kind = "objects" if isinstance(v, dict) else "arrays" if isinstance(v, list) else "nulls" if v is None else "booleans" if isinstance(v, bool) else "numbers" if isinstance(v, (int, float)) else "strings"
        out[kind] += 1
        todo += [(c, d + 1) for c in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return out


def arrays_of(value: object, path: str = "") -> list[tuple[str, int, dict[str, int]]]:
    """(path, length, members and how many items have them) of every array, also in the first items of arrays."""
    out = []
    if isinstance(value, list):
        present: dict[str, int] = {}
        for item in value:
            for k in item if isinstance(item, dict) else ():
                present[k] = present.get(k, 0) + 1
        out.append((path or "/", len(value), present))
        for item in value[:ITEMS]:
            out += arrays_of(item, path + "/*")
    elif isinstance(value, dict):
        for k, v in value.items():
            out += arrays_of(v, f"{path}/{k}")
    return out


def structure(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and the facts of JSON text; null and damaged text have nulls."""
    names = list(facts_of(None))

    @F.pandas_udf(", ".join(f"{n} int" for n in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append(facts_of(json.loads(t)) if t is not None else dict.fromkeys(names))
            except ValueError:
                rows.append(dict.fromkeys(names))
        return pd.DataFrame(rows, columns=names).astype("Int32")

    return df.select(F.col(key), run(F.col(value)).alias("f")).select(key, "f.*")


def arrays(df: DataFrame, key: str, value: str) -> DataFrame:
    """path, member, arrays, items and present over all rows: how often the items of arrays at a path have a member."""

    @F.pandas_udf("array<struct<path:string,length:int,member:string,present:int>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                found = arrays_of(json.loads(t)) if t is not None else []
            except ValueError:
                found = []
            out.append([{"path": p, "length": n, "member": k, "present": c} for p, n, m in found for k, c in [(None, n), *m.items()]])
        return pd.Series(out)

    rows = df.select(F.col(key), F.explode(run(F.col(value))).alias("a")).select("a.*")
    return rows.groupBy("path", "member").agg(F.count("*").alias("arrays"), F.sum("length").alias("items"), F.sum("present").alias("present"))


def extent(df: DataFrame, group: str, at: str) -> DataFrame:
    """group and the first and last value: by number if all are numbers, else by text."""
    number = F.col(at).try_cast("double")
    all_numbers = F.count_if(F.col(at).isNotNull() & number.isNull()) == 0
    low, high = F.min_by(at, number), F.max_by(at, number)
    return df.groupBy(group).agg(F.when(all_numbers, low).otherwise(F.min(at)).alias("first"), F.when(all_numbers, high).otherwise(F.max(at)).alias("last"))


def people(df: DataFrame, group: str, value: str, declared: str | None = None) -> DataFrame:
    """group and the names found in the usual fields of JSON objects and in a declared list, each once, in order."""
    found = [F.get_json_object(value, f"$.{f}") for f in PEOPLE]
    names = F.array_compact(F.array(*found))
    if declared:
        names = F.concat(names, F.coalesce(F.col(declared), F.array().cast("array<string>")))
    return df.select(F.col(group), F.explode(names).alias("n")).where("n != ''").groupBy(group).agg(F.array_sort(F.collect_set("n")).alias("participants"))


def representatives(df: DataFrame, group: str, order: str, value: str, most: int = 5) -> DataFrame:
    """group, place, id, at and kind of the first rows of each group: a report of ``most`` rows, of which each partition keeps
    no more before the shuffle."""
    pick = lambda names: F.coalesce(*[F.get_json_object(value, f"$.{n}") for n in names])
    row = F.struct(order, pick(("id", "event_id", "uuid")).alias("id"), pick(TIMES).alias("at"), pick(("type", "kind", "event")).alias("kind"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1  # Spark keeps the first rows of each partition only
    return df.select(F.col(group), row.alias("r")).select(group, F.col(f"r.{order}").alias(order), "r.id", "r.at", "r.kind").withColumn("place", place).where(F.col("place") < most).select(group, "place", "id", "at", "kind")


def limited(values: DataFrame, group: str, value: str, most: int = 10) -> DataFrame:
    """group and its first different values in order, joined by commas, with how many more there are."""
    each = values.where(F.col(value).isNotNull()).select(group, value).distinct()
    rank = each.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(value)))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", value)))), lambda x: x[value]), ", ")
    return rank.groupBy(group).agg(shown.alias("listed"), F.greatest(F.max("n") - most, F.lit(0)).alias("more"))
