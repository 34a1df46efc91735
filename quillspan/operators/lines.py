"""Physical lines, line units with byte offsets, greedy segments and lines repeated across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T

TARGET, MAXIMUM = 1000, 1500


#: A physical line with its end, or the rest of a text without one; read alike by Java and RE2.
PHYSICAL = "[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line, byte_start and byte_end of every physical line; LF, CRLF and CR end lines.

    Offsets count UTF-8 bytes of the text as it stands; byte_end is before the line end. A text that ends with a line end
    has no empty line behind it; null and empty texts have no lines. Rows that repeat key and text count once, other rows
    of one key are read each by itself. Lines are shuffled once, and offsets are running sums over them.
    """
    parts = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.posexplode(F.regexp_extract_all(text, F.lit(PHYSICAL), F.lit(0))).alias("line_no", "whole"))
    rows = parts.repartition("k", "h").dropDuplicates(["k", "h", "line_no"])
    upto = Window.partitionBy("k", "h").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("k", "line_no", F.regexp_replace("whole", "[\r\n]+$", "").alias("line"), (F.sum(F.octet_length("whole")).over(upto) - F.octet_length("whole")).alias("byte_start"))
    return rows.select(F.col("k").alias(key), "line_no", "line", "byte_start", (F.col("byte_start") + F.octet_length("line")).alias("byte_end"))


def segments(df: DataFrame, key: str, text: str, target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """key, lines, n_bytes, n_tokens and n_segments: lines packed greedily.

    A segment closes before a line that would take it over ``maximum`` bytes and after one that takes it to ``target``.
    Empty lines are no units. The fold runs over one text's own lines inside the JVM.
    """
    sizes = F.transform(F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: x != ""), lambda x: F.octet_length(x))
    zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("closed"))

    def step(s, n):
        over = (s["size"] > 0) & (s["size"] + n > maximum)
        size = F.when(over, n).otherwise(s["size"] + n)
        closed = s["closed"] + F.when(over, 1).otherwise(0)
        return F.struct(F.when(size >= target, 0).otherwise(size).alias("size"), (closed + F.when(size >= target, 1).otherwise(0)).alias("closed"))

    n = F.aggregate(sizes, zero, step, lambda s: s["closed"] + F.when(s["size"] > 0, 1).otherwise(0))
    return df.where(F.col(text).isNotNull()).select(key, F.size(sizes).alias("lines"), T.n_bytes(F.col(text)).alias("n_bytes"), T.n_tokens(F.col(text)).alias("n_tokens"), n.alias("n_segments"))


def repeated_lines(df: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """Patterns of lines (numbers masked) found in at least ``least`` documents: pattern, documents, occurrences."""
    masked = df.where(F.col(text).isNotNull()).select(F.col(key), F.explode(F.split(text, "[\r\n]+")).alias("line")).select(key, T.digit_mask(F.col("line")).alias("pattern")).where("pattern != ''")
    per = masked.groupBy("pattern", key).agg(F.count("*").alias("n"))
    return per.groupBy("pattern").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences")).where(F.col("documents") >= least)


def newlines(df: DataFrame, key: str, text: str) -> DataFrame:
    """LF, CRLF and CR line ends of every text, whether they are mixed and whether the last line is ended."""
    t = F.col(text)
    crlf, lf, cr = (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\r\n"), F.lit("\n"))), F.regexp_count(t, F.lit("\n")), F.regexp_count(t, F.lit("\r")))
    rows = df.where(t.isNotNull()).select(key, (lf - crlf).alias("lf"), crlf.alias("crlf"), (cr - crlf).alias("cr"), t.rlike(r"[\r\n]$").alias("ended"))
    return rows.withColumn("mixed", (F.col("lf").cast("boolean").cast("int") + F.col("crlf").cast("boolean").cast("int") + F.col("cr").cast("boolean").cast("int")) > 1)


def identical(df: DataFrame, key: str, text: str) -> DataFrame:
    """Classes of identical texts with more than one document: hash, the smallest key and the number of documents."""
    return df.where(F.col(text).isNotNull()).groupBy(T.sha256(F.col(text)).alias("text_hash")).agg(F.min(key).alias("first_id"), F.count("*").alias("documents")).where("documents > 1")
