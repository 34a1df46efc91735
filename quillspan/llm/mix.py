"""Mixing sources to target weights.

Every document gets a hash-random key. The keys are even, so their leading bits split each source into ranges of equal
size without sampling; that range and the order by key inside it are the range sort of a source. There are as many
ranges as keep about ``RANGE_ROWS`` documents in one, whatever the size of the table. Token counts are
added up by source and range, the running sums of these few rows give each range its offset, and a running sum inside
the range gives each document its place. A document is taken if its middle lies before the source's budget, so a
source misses its budget by half a document at most. A source smaller than its budget is used in whole epochs first.

The total of a mix is the largest that its sources can reach within their repeats, unless one is given.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import Scratch

#: Documents in a range of keys, about.
RANGE_ROWS = 10_000
#: Bits of a key: the first 15 hex digits of an MD5 hash.
KEY_BITS = 60


def _budgets(targets: DataFrame, sums: DataFrame, total: float | None) -> DataFrame:
    """A row for each mix and source: share, cap, t (tokens of the source), budget, full epochs and rest."""
    t = targets.select("mix_name", "source", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("cap"))
    t = t.groupBy("mix_name", "source").agg(F.sum("w").alias("w"), F.max("cap").alias("cap"))
    t = t.join(sums.groupBy("source").agg(F.sum("n").alias("t")), "source", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    mix = Window.partitionBy("mix_name")
    usable = (F.col("w") > 0) & (F.col("cap") > 0) & (F.col("t") > 0)
    t = t.withColumn("share", F.col("w") / F.sum("w").over(mix)).withColumn("part", F.when(usable, F.col("w") / F.sum(F.when(usable, F.col("w"))).over(mix)))
    most = F.min(F.col("cap") * F.col("t") / F.col("part")).over(mix)
    t = t.withColumn("budget", F.coalesce(F.col("part") * (F.lit(total) if total is not None else most), F.lit(0.0)))
    t = t.withColumn("budget", F.least("budget", F.col("cap") * F.col("t").cast("double")))
    t = t.withColumn("full", F.when(F.col("t") > 0, F.floor(F.col("budget") / F.col("t"))).otherwise(0))
    return t.withColumn("rest", F.col("budget") - F.col("full") * F.col("t"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents taken, report) for docs (doc_id, source, n_tokens) and targets (mix_name, source, weight, max_repeats).

    Taken: mix_name, source, doc_id, n_tokens and uses (how often, 1 to max_repeats). Documents without tokens or
    without a source add nothing and are never taken. Report: a row for each mix and source with target_share (weights
    need not sum to 1), target_tokens, actual_tokens, actual_share, documents, max_uses and status: ``met``, ``short``
    (a given total exceeds the repeats), ``no_documents`` or ``unused`` (no weight or no repeats). A source without
    documents keeps its target share in the report; the others share the total in proportion to their weights. Rows
    of one mix and source count as one with the sum of their weights and the largest repeats.
    """
    spark = docs.sparkSession
    key = F.conv(F.left(F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit(seed))), F.lit(KEY_BITS // 4)), 16, 10).cast("long")
    sized = docs.where("n_tokens > 0 and source is not null").select("doc_id", "source", F.col("n_tokens").alias("n"), key.alias("key"))
    sized = Scratch(spark, "mix").put(sized, "sized")  # counting tokens is dear and its result is read several times
    bits = max(0, math.ceil(math.log2(max(1, sized.count() / RANGE_ROWS))))
    sized = sized.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    sums = sized.groupBy("source", "range").agg(F.sum("n").alias("n"))
    budgets = _budgets(targets, sums, total)
    offsets = sums.select("source", "range", (F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("run", F.sum("n").over(inside)).join(offsets, ["source", "range"])
    placed = placed.withColumn("middle", F.col("offset") + F.col("run") - F.col("n") / 2)
    uses = F.least(F.col("full") + F.when(F.col("middle") <= F.col("rest"), 1).otherwise(0), "cap").cast("int")
    taken = placed.join(budgets.where("budget > 0"), "source").withColumn("uses", uses).where("uses > 0")
    taken = taken.select("mix_name", "source", "doc_id", F.col("n").alias("n_tokens"), "uses")
    actual = taken.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("got"), F.count("*").alias("documents"), F.max("uses").alias("max_uses"))
    report = budgets.join(actual, ["mix_name", "source"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    wanted = F.col("part") * F.lit(total) if total is not None else F.col("budget")
    status = F.when((F.col("w") <= 0) | (F.col("cap") <= 0), "unused").when(F.col("t") == 0, "no_documents").when(F.col("budget") < wanted * (1 - 1e-9), "short").otherwise("met")
    report = report.select(
        "mix_name", "source", F.col("share").alias("target_share"), F.col("budget").alias("target_tokens"), F.col("got").alias("actual_tokens"),
        (F.col("got") / F.sum("got").over(Window.partitionBy("mix_name"))).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("max_uses", F.lit(0)).alias("max_uses"), status.alias("status"),
    )
    return taken, report
