"""Containers in containers: members by level until none is a container, and the artifacts found on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.formats.base import parse
from quillspan.functions import text as T
from quillspan.operators import detect as D
from quillspan.session import Scratch

CONTAINERS = ("zip", "tar", "gzip", "bzip2", "xz", "zstd")
MAX_DEPTH = 16
INLINE_BYTES = 4096


def members(df: DataFrame, key: str, content: str, filename: str | None = None, depth: int = MAX_DEPTH) -> DataFrame:
    """key, path (names of the members from the outermost, joined by !), depth, bytes, sha256, parent_sha256, format,
    disposition, reason and content of every member of every container, at any level.

    Each level is a pass over the containers found on the level before and a table in the shared folder, so a lost
    executor repeats one level. Members that are refused or can't be read are kept with their reason and no content.
    Containers deeper than ``depth`` are listed and not opened.
    """
    scratch = Scratch(df.sparkSession, "containers")
    name = F.col(filename) if filename else F.lit(None).cast("string")
    top = df.select(F.col(key).alias("key"), F.coalesce(name, F.lit("")).alias("path"), F.col(content).cast("binary").alias("content"))
    level, found = _typed(top.withColumn("sha256", F.concat(F.lit("sha256:"), F.sha2("content", 256)))), []
    for k in range(1, depth + 1):
        boxes = scratch.put(level.where(F.col("format").isin(*CONTAINERS)).withColumn("at", F.struct("key", "path", "sha256")).select("at", "content", "format"), f"boxes{k}")
        if boxes.isEmpty():
            break
        rows = parse(boxes, "at", "content", F.col("format"), contents=True)
        listed = rows.where("kind = 'member'").select("at", "node", "name", F.col("attrs")["bytes"].cast("long").alias("bytes"), F.col("attrs")["sha256"].alias("sha256"), F.col("attrs")["disposition"].alias("disposition"), F.col("attrs")["reason"].alias("reason"))
        bodies = rows.where("kind = 'content'").select("at", F.col("parent").alias("node"), F.encode("value", "ISO-8859-1").alias("content"))
        one = listed.join(bodies, ["at", "node"], "left").select("at.key", F.concat_ws("!", F.nullif("at.path", F.lit("")), "name").alias("path"), F.lit(k).alias("depth"), "bytes", "sha256", F.col("at.sha256").alias("parent_sha256"), "disposition", "reason", "content")
        level = scratch.put(_typed(one), f"level{k}")
        found.append(level)
    if not found:
        kind = dict(top.dtypes)["key"]
        return df.sparkSession.createDataFrame([], f"key {kind}, path string, depth int, bytes long, sha256 string, parent_sha256 string, disposition string, reason string, content binary, format string").withColumnRenamed("key", key)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("key", key)


def _typed(df: DataFrame) -> DataFrame:
    """The table with the format that the leading bytes say, or that the name says where they say nothing."""
    magic = F.get(D.magic_signals(F.col("content")), F.lit(0))["format"]
    label = F.get(D.label_signals(F.col("path"), F.lit(None).cast("string"), F.lit(None).cast("string")), F.lit(0))["format"]
    return df.withColumn("format", F.coalesce(magic, label))


def artifacts(found: DataFrame, inline: int = INLINE_BYTES) -> DataFrame:
    """sha256, bytes, risk, media, inline (the bytes, up to a size) and uses of the different contents among members: each
    is kept once however often it occurs."""
    rows = found.where("content is not null").select("sha256", F.octet_length("content").alias("bytes"), T.artifact_risk(F.lit(None).cast("string"), F.col("path"), F.col("content")).alias("risk"), "content")
    return rows.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.max("risk").alias("risk"), F.first(F.when(F.octet_length("content") <= inline, F.col("content")), ignorenulls=True).alias("inline"), F.count("*").alias("uses"))


def store(found: DataFrame, path: str) -> None:
    """Writes the different contents to a folder, a table by the first two digits of the digest."""
    once = found.where("content is not null").select("sha256", "content").dropDuplicates(["sha256"])
    once.withColumn("shard", F.substring("sha256", 8, 2)).write.mode("append").partitionBy("shard").parquet(path)


def materialize(found: DataFrame, folder: str, allow: tuple[str, ...] = ("inert", "document")) -> DataFrame:
    """Writes contents as files of a folder all executors share: path and status of each member. Members of a risk that is
    not allowed are refused; names that would meet get the beginning of their digest."""
    from collections.abc import Iterator
    from pathlib import Path

    import pyarrow as pa
    from pyspark.sql import Window

    risk = T.artifact_risk(F.lit(None).cast("string"), F.col("path"), F.col("content"))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/!]*)$", 1), r"[^\w.-]", "_")
    same = F.count("*").over(Window.partitionBy(F.lower("name")))
    rows = found.where("content is not null").select("sha256", "content", "path", risk.alias("risk"), name.alias("name")).dropDuplicates(["sha256", "name"])
    rows = rows.withColumn("name", F.when(same > 1, F.concat(F.substring("sha256", 8, 12), F.lit("-"), "name")).otherwise(F.col("name")))
    ok = F.col("risk").isin(*allow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, file in zip(batch.column(1), batch.column(4).to_pylist()):
                target = Path(folder.removeprefix("file://")) / file
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(target.name + ".part")
                part.write_bytes(body.as_py())
                part.rename(target)  # a task that runs twice leaves the same file
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(4)], ["path", "file"])

    written = rows.where(ok).select("sha256", "content", "path", "risk", "name").mapInArrow(run, "path string, file string").withColumn("status", F.lit("written"))
    return written.unionByName(rows.where(~ok).select("path", F.lit(None).cast("string").alias("file"), F.concat(F.lit("refused_"), "risk").alias("status")))
