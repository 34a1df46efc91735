"""Timed cues: overlaps, transcript text and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SHARD_MS = 300_000


def _shard(start: str) -> Column:
    """The time shard of a moment; null for null."""
    return F.floor(F.col(start) / SHARD_MS)


def overlaps(cues: DataFrame, track: str, index: str, start: str, end: str) -> DataFrame:
    """track, index, the cue with the latest end so far (the first one, if several) and the overlap in milliseconds.

    Cues are taken by start, end and index; one overlaps if it starts before the latest end so far. Cues without both
    bounds and repeated cues are left out. The latest end is a maximum: it is taken over the cue's own time shard and,
    by way of one row per shard, over the shards before.
    """
    track_ = F.struct(F.col(track).alias("x")).alias("t")  # a struct is never null, so the window and the join share one shuffle
    rows = cues.select(track_, F.col(index).alias("i"), F.col(start).alias("s"), F.col(end).alias("e")).where("s is not null and e is not null").dropDuplicates(["t", "i"])
    rows = rows.withColumn("w", _shard("s"))
    latest = F.max(F.struct("e", (-F.col("s")).alias("s"), (-F.col("i")).alias("i")))
    before = Window.partitionBy("t", "w").orderBy("s", "e", "i").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("ct").orderBy("cw").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(F.col("t").alias("ct"), F.col("w").alias("cw")).agg(latest.alias("m")).select("ct", "cw", F.max("m").over(earlier).alias("carry"))
    both = rows.withColumn("top", latest.over(before)).join(carry, (F.col("t") == F.col("ct")) & (F.col("w") == F.col("cw")))
    both = both.withColumn("top", F.greatest("top", "carry")).where("s < top.e")
    return both.select(F.col("t.x").alias(track), F.col("i").alias(index), (-F.col("top.i")).alias("other_index"), (F.least("e", "top.e") - F.col("s")).alias("overlap_ms"))


def transcript(cues: DataFrame, track: str, index: str, start: str, speaker: str, text: str) -> DataFrame:
    """track, lines and transcript_sha256, the digest of the ``speaker: text`` lines in order of time.

    A track is hashed in two levels, so that no task holds all of it: the lines of each time shard, then the digests of
    its shards in order, one a line. Cues without a start come first. Repeated cues count once.
    """
    rows = cues.select(F.col(track).alias("t"), F.col(index).alias("i"), F.col(start).alias("s"), F.col(speaker).alias("w"), F.col(text).alias("x")).where("x is not null").dropDuplicates(["t", "i"])
    line = F.when(F.col("w") != "", F.concat("w", F.lit(": "), "x")).otherwise(F.col("x"))
    parts = F.array_sort(F.collect_list(F.struct("s", "i", line.alias("line"))))
    shards = rows.groupBy("t", _shard("s").alias("shard")).agg(F.count("*").alias("n"), parts.alias("p"))
    shards = shards.select("t", "shard", "n", F.sha2(F.array_join(F.transform("p", lambda p: p["line"]), "\n"), 256).alias("digest"))
    order = F.array_sort(F.collect_list(F.struct("shard", "digest")))
    return shards.groupBy("t").agg(F.sum("n").alias("lines"), F.sha2(F.array_join(F.transform(order, lambda p: p["digest"]), "\n"), 256).alias("transcript_sha256")).withColumnRenamed("t", track)


def mean_confidence(cues: DataFrame, track: str, index: str, confidence: str) -> DataFrame:
    """track and the mean confidence, held between 0 and 1 and rounded to 4 places; 0 where none is known."""
    rows = cues.select(F.col(track).alias("t"), F.col(index).alias("i"), F.col(confidence).alias("c")).dropDuplicates(["t", "i"])
    mean = F.sum(F.round(F.col("c") * 1_000_000).cast("bigint")) / F.count("c") / 1_000_000  # whole numbers: any order gives one sum
    mean = F.coalesce(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return rows.groupBy("t").agg((F.floor(mean * 10_000 + 0.5) / 10_000).alias("confidence")).withColumnRenamed("t", track)
