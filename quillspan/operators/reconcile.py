"""Several readings of one thing put together: transcripts, image text, pages read twice, captions and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T


def transcripts(native: DataFrame, attempts: DataFrame) -> DataFrame:
    """media, position, origin, provider, start_ms, end_ms and text: the cues a recording came with, then those of every
    attempt that succeeded, in order; nothing is suppressed. Recordings without such an attempt have none.

    native: media, item, start_ms, end_ms, text; attempts: media, provider, status, item, start_ms, end_ms, text.
    """
    good = attempts.where("status = 'succeeded'")
    first = native.join(good.select("media").distinct(), "media", "left_semi").select("media", F.lit("native").alias("origin"), F.lit(None).cast("string").alias("provider"), "item", "start_ms", "end_ms", "text")
    both = first.unionByName(good.select("media", F.lit("provider").alias("origin"), "provider", "item", "start_ms", "end_ms", "text"))
    order = Window.partitionBy("media").orderBy("origin", "provider", "item")
    return both.withColumn("position", F.row_number().over(order) - 1).drop("item")


def image_texts(native: DataFrame, attempts: DataFrame) -> DataFrame:
    """image, position, origin and text: native entries, then for each successful attempt its whole text, if it is not
    what its regions say together, and its regions. native: image, item, text; attempts: image, provider, status, whole,
    item, text."""
    good = attempts.where("status = 'succeeded'")
    said = good.groupBy("image", "provider", "whole").agg(T.collapsed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda x: x["text"]), " ")).alias("regions"))
    whole = said.where("whole is not null and whole != ''").where(T.collapsed(F.col("whole")) != F.col("regions")).select("image", F.lit("provider").alias("origin"), "provider", F.lit(-1).alias("item"), F.col("whole").alias("text"))
    first = native.select("image", F.lit("native").alias("origin"), F.lit(None).cast("string").alias("provider"), F.col("item").cast("int").alias("item"), "text")
    both = first.unionByName(whole).unionByName(good.where("text is not null").select("image", F.lit("provider").alias("origin"), "provider", F.col("item").cast("int").alias("item"), "text"))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("image").orderBy("origin", "provider", "item")) - 1).drop("item")


def new_regions(native: DataFrame, read: DataFrame, similarity: float = 0.8, overlap: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(regions read that a page does not have already, regions suppressed with the native one they repeat).

    A region repeats a native one of its page if their words are as similar as ``similarity`` (Jaccard) and their boxes
    overlap by ``overlap`` of the smaller area; the most similar one is named. Both: page, id, text, l, t, r, b. Only
    regions that lie in a common cell of a page's 64 x 64 grid meet.
    """
    bounds = native.unionByName(read, allowMissingColumns=True).groupBy("page").agg(F.greatest(F.max("r"), F.lit(1e-9)).alias("pw"), F.greatest(F.max("b"), F.lit(1e-9)).alias("ph"))

    def gridded(df: DataFrame) -> DataFrame:
        at = lambda c, size: F.least(F.lit(63), F.greatest(F.lit(0), F.floor(F.col(c) / F.col(size) * 64)))
        rows = df.join(bounds, "page")
        rows = rows.withColumn("cx", F.explode(F.sequence(at("l", "pw"), F.greatest(at("l", "pw"), at("r", "pw")))))
        return rows.withColumn("cy", F.explode(F.sequence(at("t", "ph"), F.greatest(at("t", "ph"), at("b", "ph"))))).drop("pw", "ph")

    a = gridded(read)
    b = gridded(native).select("page", "cx", "cy", *[F.col(c).alias(f"n_{c}") for c in ("id", "text", "l", "t", "r", "b")])
    pairs = a.join(b, ["page", "cx", "cy"]).drop("cx", "cy").distinct()
    like = F.when(F.trim("text") == F.trim("n_text"), 1.0).otherwise(T.jaccard(T.bag(F.col("text")), T.bag(F.col("n_text"))))
    shared = T.box_overlap(tuple(F.col(c) for c in "ltrb"), tuple(F.col(f"n_{c}") for c in "ltrb"))
    hits = pairs.withColumns({"similarity": like, "overlap": shared}).where((F.col("similarity") >= similarity) & (F.col("overlap") >= overlap))
    best = hits.groupBy("page", "id").agg(F.max_by("n_id", F.struct("similarity", "overlap", F.col("n_id"))).alias("native_id"), F.max("similarity").alias("similarity"))
    return read.join(best.select("page", "id"), ["page", "id"], "left_anti"), best


def nearest_captions(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """Figures (page, id, kind, l, t, r, b) with the caption of their kind that is nearest above or below: within four of
    its heights (10 at least). Of equally near ones the first."""
    c = captions.select("page", "kind", F.col("id").alias("caption"), F.col("t").alias("ct"), F.col("b").alias("cb"))
    gap = F.greatest(F.col("t") - F.col("cb"), F.col("ct") - F.col("b"), F.lit(0.0))
    near = figures.join(c, ["page", "kind"]).withColumn("gap", gap).where(F.col("gap") <= 4 * F.greatest(F.col("cb") - F.col("ct"), F.lit(10.0)))
    best = near.groupBy("page", "id").agg(F.min_by("caption", F.struct("gap", "caption")).alias("caption"))
    return figures.join(best, ["page", "id"], "left")


def reading_order(blocks: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """page, kind, id and position of what a page shows: blocks that belong to no table (column table_id), tables and
    figures, from the top down, then from the left; at one place blocks before tables before figures. All: page, id, x,
    top."""
    free = blocks.where("table_id is null")
    owned = blocks.where("table_id is not null").join(tables.select("page", F.col("id").alias("table_id")), ["page", "table_id"], "left_anti")
    rows = None
    for k, (kind, df) in enumerate((("block", free.unionByName(owned, allowMissingColumns=True)), ("table", tables), ("figure", figures))):
        one = df.select("page", F.lit(k).alias("rank"), F.lit(kind).alias("kind"), "id", "x", "top")
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("top"), "x", "rank", "id")) - 1).select("page", "kind", "id", "position")


def tokens(glyphs: DataFrame, part: float = 0.45) -> DataFrame:
    """page, line, token, text, l and r: glyphs (page, line, l, r, h, char) in order from the left, joined until white
    space or a gap above ``part`` of the glyph's height."""
    order = Window.partitionBy("page", "line").orderBy("l", "r")
    rows = glyphs.withColumn("space", F.col("char").rlike(r"^\s*$")).withColumn("was", F.lag(F.struct("r", "space")).over(order))
    breaks = F.when(F.col("space") | F.col("was.space") | (F.col("l") - F.col("was.r") > part * F.col("h")) | F.col("was").isNull(), 1).otherwise(0)
    rows = rows.withColumn("token", F.sum(breaks).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not space")
    out = rows.groupBy("page", "line", "token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "r", "char"))), lambda x: x["char"]), "").alias("text"), F.min("l").alias("l"), F.max("r").alias("r"))
    return out.withColumn("token", F.row_number().over(Window.partitionBy("page", "line").orderBy("l")) - 1)


def lines(glyphs: DataFrame) -> DataFrame:
    """glyphs (page, l, t, b, ...) with a line each: in order of their middle, a glyph begins a line where it is further
    below the one before than 0.55 of the height and 0.5."""
    middle, height = (F.col("t") + F.col("b")) / 2, F.col("b") - F.col("t")
    order = Window.partitionBy("page").orderBy("_m", "l")
    rows = glyphs.withColumn("_m", middle)
    step = F.when(F.col("_m") - F.lag("_m").over(order) > 0.55 * height + 0.5, 1).otherwise(0)
    return rows.withColumn("_s", step).withColumn("line", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_m", "_s")


def columns(boxes: DataFrame, share: float = 0.35) -> DataFrame:
    """boxes (page, l, r, ...) with a column each: in order of their left edge, a box goes on with the column before if it
    shares ``share`` of the narrower width with what is covered so far."""
    order = Window.partitionBy("page").orderBy("l", "r")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("r").over(before)
    fresh = F.when(reach.isNull() | (F.least(reach, F.col("r")) - F.col("l") < share * (F.col("r") - F.col("l"))), 1).otherwise(0)
    return boxes.withColumn("_n", fresh).withColumn("column", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_n")


def repeated_regions(blocks: DataFrame, pages: DataFrame, top: float = 0.86, bottom: float = 0.14) -> DataFrame:
    """doc, kind (header, footer or page_number), pattern, pages and confidence of what stands in the margins of two pages or
    more. blocks: doc, page, text, y (share of the height, from below); pages: doc, pages (how many it has)."""
    edge = blocks.where((F.col("y") >= top) | (F.col("y") <= bottom)).where(F.col("text").isNotNull())
    kind = F.when(T.is_page_number(F.col("text")), "page_number").when(F.col("y") >= top, "header").otherwise("footer")
    rows = edge.select("doc", "page", kind.alias("kind"), T.digit_mask(F.col("text")).alias("pattern")).distinct()
    found = rows.groupBy("doc", "kind", "pattern").agg(F.count("*").alias("pages")).where("pages >= 2")
    total = pages.groupBy("doc").agg(F.max("pages").alias("all"))
    return found.join(total, "doc", "left").withColumn("confidence", F.round(F.least(F.lit(0.97), 0.72 + 0.25 * F.col("pages") / F.greatest(F.coalesce("all", "pages"), F.lit(1))), 4)).drop("all")
