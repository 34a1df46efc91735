"""Mail threads: links between messages and groups by subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T


def links(messages: DataFrame, key: str = "stable_id", ident: str = "message_id", refs: str = "in_reply_to", order: str = "stable_id") -> DataFrame:
    """key, reference, target and resolved for every reference of every message.

    The first message with an id (by ``order``) is its target. References that name no message stay, unresolved. Null
    and empty references are none. Repeated rows of a message count once.
    """
    rows = messages.select(F.col(key).alias("m"), F.col(ident).alias("id"), F.col(refs).alias("r"), F.col(order).alias("o")).dropDuplicates(["m"])
    first = rows.where("id is not null").groupBy("id").agg(F.min_by("m", F.struct("o", "m")).alias("target")).withColumnRenamed("id", "reference")
    each = rows.select("m", F.explode(F.array_distinct("r")).alias("reference")).where("reference != ''")
    return each.join(first, "reference", "left").select(F.col("m").alias(key), "reference", "target", F.col("target").isNotNull().alias("resolved"))


def thread_links(messages: DataFrame, key: str = "stable_id", ident: str = "message_id", relations: dict[str, str] | None = None, order: str = "stable_id") -> DataFrame:
    """key, relation, reference, target and resolved of every reference, whatever header it stands in.

    relations: relation to the column with its ids, an array; by default the replies' and the references' columns. The
    first message with an id is the target, as in ``links``; a reference that two headers name has a row for each.
    """
    relations = relations or {"in_reply_to": "in_reply_to", "references": "references"}
    out = None
    for relation, column in relations.items():
        if column in messages.columns:
            one = links(messages, key, ident, column, order).withColumn("relation", F.lit(relation))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no column of references")
    return out.select(key, "relation", "reference", "target", "resolved")


def subject_groups(messages: DataFrame, key: str = "stable_id", subject: str = "subject") -> DataFrame:
    """subject_key, messages and the first message of each group of subjects; null and empty subjects form no group."""
    rows = messages.select(F.col(key).alias("m"), T.subject_key(F.col(subject)).alias("subject_key")).where("subject_key != ''").distinct()
    return rows.groupBy("subject_key").agg(F.count("*").alias("messages"), F.min("m").alias("first_id"))
