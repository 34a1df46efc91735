"""File sources that keep what they can't parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Why an input is left out of parsing.
SKIP_REASONS = ("too_large", "hidden", "glob_excluded")


def inventory(spark: SparkSession, path: str, limit: int = 64 << 20, include: str | None = None) -> DataFrame:
    """path, name, length, modified, disposition and skip_reasons of every file below a folder.

    Spark's file sources list no empty files; all others have a row, whatever the reason they are skipped for. Contents are not read. include: a Java regular expression that names must match.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    reasons = F.array_compact(F.array(
        F.when(F.col("length") > limit, "too_large"), F.when(name.startswith("."), "hidden"), F.when(~name.rlike(include), "glob_excluded") if include else F.lit(None).cast("string"),
    ))
    return files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"), F.when(F.size(reasons) > 0, "skipped").otherwise("parsed").alias("disposition"), F.array_join(reasons, ",").alias("skip_reasons"))


def texts(spark: SparkSession, path: str, limit: int = 64 << 20) -> DataFrame:
    """path, text and status of files up to the limit: ``complete``, or ``partial`` where bytes were no UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= limit)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.when(F.is_valid_utf8(F.col("content").cast("string")), "complete").otherwise("partial").alias("status"))


def json_lines(lines: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Parsed records of a column of JSON lines with status ``complete``, ``malformed`` or ``blank``; the text stays.

    Works on batch and streaming tables alike.
    """
    kind = T._parse_datatype_string(schema)
    raw = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(text, raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("_p", parsed)
    status = F.when(F.trim(text) == "", "blank").when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), "malformed").otherwise("complete")
    return rows.select("*", *[F.col(f"_p.{f.name}").alias(f.name) for f in kind.fields], status.alias("status")).drop("_p")


def delimited(lines: DataFrame, columns: list[str], separator: str = ",", text: str = "value") -> DataFrame:
    """Cells of delimited lines as text columns with width and status: ``complete``, or ``ragged`` for another width.

    Quoted cells may hold separators and doubled quotes; a quoted line end needs the CSV reader.
    """
    pattern = '(?:^|{0})(?:"((?:[^"]|"")*)"|([^{0}]*))'.format("\\" + separator)
    cells = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda c: F.replace(F.regexp_replace(c, rf'^\{separator}?"?|"$', ""), F.lit('""'), F.lit('"')))
    rows = lines.withColumn("_c", cells)
    status = F.when(F.size("_c") == len(columns), "complete").otherwise("ragged")
    return rows.select("*", *[F.get("_c", F.lit(i)).alias(c) for i, c in enumerate(columns)], F.size("_c").alias("width"), status.alias("status")).drop("_c")
