"""Overlapping and gapped intervals: continuous periods and the gaps between them, in two levels.

An entity may own a large share of all rows, so no step gathers an entity. Intervals are clipped into time shards.
An interval that covers whole shards leaves one piece in its first and one in its last shard; the stretch between is
kept as a reach of the first shard, not one piece per shard. Pieces with the same start are merged before they are
shuffled, so a shard of W milliseconds holds at most W pieces. Each shard is merged by itself; then only one row per
shard and entity is put in order to carry the coverage from shard to shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_MS = 300_000


def _islands(df: DataFrame, entity: str, start: str, end: str, shard: int) -> DataFrame:
    """Merged islands of each shard with prev, the end of what is covered before (null for the first of an entity)."""
    # a struct is never null, so windows and joins share one shuffle
    iv = df.select(F.struct(F.col(entity).alias("x")).alias("e"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("t")).where("t > s")
    first, last = F.expr(f"(s - pmod(s, {shard})) div {shard}"), F.expr(f"((t - 1) - pmod(t - 1, {shard})) div {shard}")
    iv = iv.withColumns({"f": first, "l": last})
    head = F.struct(F.col("f").alias("w"), F.col("s").alias("a"), F.least(F.col("t"), (F.col("f") + 1) * shard).alias("b"), F.when(F.col("l") > F.col("f") + 1, F.col("l") * shard).alias("reach"))
    tail = F.struct(F.col("l").alias("w"), (F.col("l") * shard).alias("a"), F.col("t").alias("b"), F.lit(None).cast("long").alias("reach"))
    pieces = iv.select("e", F.explode(F.when(F.col("l") > F.col("f"), F.array(head, tail)).otherwise(F.array(head))).alias("x")).select("e", "x.*")
    pieces = pieces.groupBy("e", "w", "a").agg(F.max("b").alias("b"), F.max("reach").alias("reach"))
    before = Window.partitionBy("e", "w").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("e", "w").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    opened = pieces.withColumn("max_b", F.max("b").over(before)).withColumn("new", F.when(F.col("max_b") >= F.col("a"), 0).otherwise(1))
    local = opened.withColumn("island", F.sum("new").over(upto)).groupBy("e", "w", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("reach").alias("reach"))
    shards = local.groupBy("e", "w").agg(F.max("b").alias("last"), F.max("reach").alias("reach"))
    earlier = Window.partitionBy("e").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    carry = shards.select("e", "w", F.max(F.greatest("last", "reach")).over(earlier).alias("carry")).withColumnsRenamed({"e": "ce", "w": "cw"})
    both = local.join(carry, (F.col("e") == F.col("ce")) & (F.col("w") == F.col("cw")))
    inside = Window.partitionBy("e", "w").orderBy("a")
    return both.select("e", "w", "a", "b", F.greatest(F.lag("b").over(inside), F.col("carry")).alias("prev"))


def gaps(df: DataFrame, entity: str, start: str, end: str, shard: int = SHARD_MS) -> DataFrame:
    """Stretches between the first and last covered moment of an entity that no interval covers.

    Intervals are half open. One that has a null bound or does not end after its start covers nothing. Touching
    intervals leave no gap. Null is an entity of its own. Returns entity, gap_start and gap_end; repeated rows change
    nothing; an empty table gives an empty result.
    """
    found = _islands(df, entity, start, end, shard).where("a > prev")
    return found.select(F.col("e.x").alias(entity), F.col("prev").alias("gap_start"), F.col("a").alias("gap_end"))


def periods(df: DataFrame, entity: str, start: str, end: str, shard: int = SHARD_MS) -> DataFrame:
    """Continuous periods of each entity: entity, period_start and period_end. Same rules as ``gaps``.

    A period ends where the gap behind it starts, or at the last covered moment of the entity. The next gap is looked
    up within the shard and, for the last start of a shard, among one row per later shard.
    """
    islands = _islands(df, entity, start, end, shard)
    inside = Window.partitionBy("e", "w").orderBy("a")
    starts = islands.where("prev is null or a > prev").withColumn("next", F.lead("prev").over(inside))
    shards = islands.groupBy("e", "w").agg(F.max("b").alias("last"), F.min(F.when(F.col("prev").isNull() | (F.col("a") > F.col("prev")), F.struct("a", "prev"))).alias("open"))
    later = Window.partitionBy("e").orderBy("w").rowsBetween(1, Window.unboundedFollowing)
    ends = shards.select(
        F.col("e").alias("ce"), F.col("w").alias("cw"), F.first("open.prev", ignorenulls=True).over(later).alias("after"), F.max("last").over(Window.partitionBy("e")).alias("final"),
    )
    joined = starts.join(ends, (F.col("e") == F.col("ce")) & (F.col("w") == F.col("cw")))
    return joined.select(F.col("e.x").alias(entity), F.col("a").alias("period_start"), F.coalesce("next", "after", "final").alias("period_end"))
