"""Inputs of any kind as rows of bytes, repositories with their ignore rules, and ingestion: detect, parse, envelope.

An input is a row (request_id, name, media, hint, content). Files are listed with their lengths first and read only if no
policy skips them, so the bounds and rules are predicates on the listing, and every entry keeps a row with its reasons.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.formats.base import parse, registry
from quillspan.operators import detect as D
from quillspan.session import Scratch

INPUT = "request_id string, name string, media string, hint string, content binary"
# Why an entry of a repository is not parsed.
SKIP_REASONS = ("ignored", "hidden", "glob_excluded", "not_included", "too_large", "empty", "binary", "generated", "lockfile", "vendored", "depth", "symlink", "submodule")


@dataclass(frozen=True)
class Request:
    """One input to ingest: bytes, text, a stream, a path or a member of a compound (bytes with its parent's digest)."""

    request_id: str
    content: bytes | str | object | None = None
    path: str | None = None
    media: str | None = None
    hint: str | None = None
    parent_sha256: str | None = None

    def resolved(self, limit: int) -> tuple:
        """The request as a row; a path ``-`` is standard input. Inputs above the limit are refused."""
        data = self.content
        if data is None and self.path is not None:
            data = sys.stdin.buffer.read(limit + 1) if self.path == "-" else read_bounded(Path(self.path), limit)
        elif hasattr(data, "read"):
            data = data.read(limit + 1)
        if isinstance(data, str):
            data = data.encode()
        if data is not None and len(data) > limit:
            raise ValueError(f"{self.request_id}: more than {limit} bytes")
        return (self.request_id, self.path if self.path != "-" else None, self.media, self.hint, None if data is None else bytearray(data))


def read_bounded(path: Path, limit: int) -> bytes:
    """The bytes of a file, one more than the limit at most."""
    with path.open("rb") as file:
        return file.read(limit + 1)


def inputs(spark: SparkSession, requests: Iterable[Request], limit: int = 64 << 20) -> DataFrame:
    """Requests as a table. Ids must differ. This is for the few inputs of a caller; folders are read by ``files``."""
    rows = [r.resolved(limit) for r in requests]
    twice = sorted({r[0] for r in rows if sum(x[0] == r[0] for x in rows) > 1})
    if twice:
        raise ValueError(f"request ids repeat: {', '.join(twice)}")
    return spark.createDataFrame(rows, INPUT)


def files(spark: SparkSession, path: str, limit: int = 64 << 20) -> DataFrame:
    """Every file below a folder up to the limit as an input; the limit is applied to the listing, before bytes are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= limit)
    return found.select(F.col("path").alias("request_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.lit(None).cast("string").alias("media"), F.lit(None).cast("string").alias("hint"), "content")


def ingest(df: DataFrame, policy: str = "select_highest_ranked", **options: object) -> tuple[DataFrame, DataFrame]:
    """(envelopes, nodes) of a table of inputs.

    Envelopes: request_id, sequence, format, detection, confidence, status (that of the parser, or ``unknown``,
    ``ambiguous``, ``unsupported`` where no parser ran), bytes, sha256, nodes and diagnostics. Nodes: request_id and the
    rows of the parsers. Inputs are detected once, written with their format to the shared folder, and parsed where they
    are. Repeated request ids raise.
    """
    spark = df.sparkSession
    if not df.groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("request ids repeat")
    found = D.detect(df, "request_id", "content", "name", "media", "hint", policy)
    scratch = Scratch(spark, "ingest")
    known = scratch.put(df.join(found, "request_id", "left").select("request_id", "content", F.coalesce(F.when(F.col("status") == "selected", F.col("format"))).alias("parser"), "format", F.coalesce("status", F.lit("unknown")).alias("detection"), "confidence"), "known")
    nodes = scratch.put(parse(known.where("parser is not null"), "request_id", "content", F.col("parser"), **options), "nodes")
    per = nodes.groupBy("request_id").agg(F.max(F.when(F.col("node") == 0, F.col("attrs")["status"])).alias("parsed"), F.count("*").alias("nodes"), F.count_if(F.col("kind") == "diagnostic").alias("diagnostics"))
    head = known.select("request_id", "format", "detection", "confidence", F.octet_length("content").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))
    out = head.join(per, "request_id", "left").withColumn("status", F.coalesce("parsed", "detection")).fillna(0, ["nodes", "diagnostics"])
    return out.drop("parsed"), nodes


def metrics(envelopes: DataFrame) -> DataFrame:
    """format, status, inputs, bytes, nodes and diagnostics: what was done, without any content."""
    return envelopes.groupBy("format", "status").agg(F.count("*").alias("inputs"), F.sum("bytes").alias("bytes"), F.sum("nodes").alias("nodes"), F.sum("diagnostics").alias("diagnostics"))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression for whole paths: * stays within a folder, ** does not, {a,b} and [..] as usual."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_pattern(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def globs(path: Column, patterns: list[str]) -> Column:
    """Whether a path, or for a pattern without a slash its name, matches any glob."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (path if "/" in p else name).rlike(glob_pattern(p.lstrip("/")))
    return hit


@dataclass(frozen=True)
class IgnoreRule:
    """A line of an ignore file: where it stands, its pattern, whether it takes back, is for folders, is tied to its place."""

    base: str
    pattern: str
    negated: bool
    folders: bool

    @staticmethod
    def parse(base: str, line: str) -> IgnoreRule | None:
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\")
        folders = line.endswith("/")
        line = line.rstrip("/")
        tied = "/" in line
        rule = glob_pattern(line.lstrip("/"))[1:-1]
        return IgnoreRule(base, f"^{'' if tied else '(?:.*/)?'}{rule}$", negated, folders)

    def hits(self, path: str, folder: bool) -> bool:
        if self.base and not path.startswith(self.base + "/"):
            return False
        return (folder or not self.folders) and re.match(self.pattern, path[len(self.base) + 1 if self.base else 0 :]) is not None


def ignored(path: str, rules: list[IgnoreRule]) -> bool:
    """Whether the rules, the last that hits deciding, ignore a path or a folder above it."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        verdict = False
        for r in rules:
            if r.hits("/".join(parts[:i]), i < len(parts)):
                verdict = not r.negated
        if verdict:
            return True
    return False


@dataclass(frozen=True)
class RepositoryOptions:
    """What a repository scan reads. Globs are as in ``glob_pattern``; no include takes all."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    limit: int = 8 << 20
    depth: int = 64
    hidden: bool = False
    ignore_files: bool = True
    kinds: tuple[str, ...] = field(default=("generated", "binary"))


def _system(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else "file://" + path if path.startswith("/") else path)


def listing(spark: SparkSession, root: str, depth: int = 64) -> DataFrame:
    """path (below the root, folders end in /), bytes, link and level of every entry below a folder, hidden ones too.

    Folders are listed by the tasks, level by level, a table in the shared folder each; links are listed and not followed.
    Folders deeper than ``depth`` are listed and not entered.
    """
    scratch = Scratch(spark, "listing")
    base = root.removeprefix("file://").rstrip("/") if root.startswith(("file://", "/")) else root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType

        for batch in batches:
            for below, level in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = _system(f"{base}/{below}".rstrip("/"))
                found = system.get_file_info(FileSelector(at, recursive=False))
                names = [below + f.base_name + ("/" if f.type == FileType.Directory else "") for f in found]
                links = [os.path.islink(f.path) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f.size if f.type == FileType.File else None for f in found], pa.int64()), pa.array(links, pa.bool_()), pa.array([level + 1] * len(found), pa.int32())], ["path", "bytes", "link", "level"])

    schema = "path string, bytes long, link boolean, level int"
    front = spark.createDataFrame([("", 0)], "path string, level int")
    found, k = [], 0
    while k <= depth:
        one = scratch.put(front.repartition("path").mapInArrow(run, schema), f"level{k}")
        found.append(one)
        front, k = one.where(F.col("path").endswith("/") & ~F.col("link")).select("path", "level"), k + 1
        if front.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def repository(spark: SparkSession, root: str, options: RepositoryOptions | None = None) -> DataFrame:
    """path (below the root), bytes, kind, disposition, reasons and sha256 of every file and link of a repository.

    disposition: ``parsed`` or ``skipped``; a skipped entry keeps all its reasons and is not read. The rules of ignore files
    hold below the folder they stand in; they are few and small (those above 64 KiB are left out), are read first and
    sent to the tasks.
    """
    o = options or RepositoryOptions()
    base = root.removeprefix("file://").rstrip("/") if root.startswith(("file://", "/")) else root.rstrip("/")
    rows = listing(spark, root, o.depth).where(~F.col("path").endswith("/")).withColumnRenamed("path", "p")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, at = _system(f"{base}/{name}")
                with system.open_input_file(at) as file:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([file.read()], pa.binary())], ["p", "content"])

    rules: list[IgnoreRule] = []
    if o.ignore_files:
        files_ = rows.where(F.col("p").rlike(r"(^|/)\.gitignore$") & (F.col("bytes") <= 65_536) & ~F.col("link")).select("p").mapInArrow(read, "p string, content binary")
        for r in sorted(files_.collect(), key=lambda r: (r.p.count("/"), r.p)):
            rules += [x for line in bytes(r.content).decode("utf-8", "replace").splitlines() if (x := IgnoreRule.parse(r.p.rpartition("/")[0], line))]

    @F.pandas_udf("boolean")
    def hidden_by_rules(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: ignored(p, rules))

    kind = D.file_kind(F.col("p"))
    reasons = F.array_compact(F.array(
        F.when(hidden_by_rules("p") if rules else F.lit(False), "ignored"), F.when(~F.lit(o.hidden) & F.col("p").rlike(r"(^|/)\.[^/]"), "hidden"), F.when(globs(F.col("p"), list(o.exclude)), "glob_excluded"), F.when(F.col("link"), "symlink"), F.when(F.col("bytes") == 0, "empty"),
        F.when(~globs(F.col("p"), list(o.include)) if o.include else F.lit(False), "not_included"), F.when(F.col("bytes") > o.limit, "too_large"), F.when(kind.isin(*o.kinds), kind), F.when(F.size(F.split("p", "/")) > o.depth, "depth"),
    ))
    listed = Scratch(spark, "repository").put(rows.select("p", "bytes", kind.alias("kind"), reasons.alias("reasons")), "listed")
    digest = listed.where(F.size("reasons") == 0).select("p").mapInArrow(read, "p string, content binary").select("p", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))
    out = listed.join(digest, "p", "left")
    return out.select(F.col("p").alias("path"), "bytes", "kind", F.when(F.size("reasons") > 0, "skipped").otherwise("parsed").alias("disposition"), "reasons", "sha256")


def inventory_hashes(listing: DataFrame) -> DataFrame:
    """inventory, source and manifest: digests over all entries, all that are parsed, and the manifests and lockfiles. Each is
    hashed in 256 leaves by path, then over the leaves, so no task holds the listing."""
    entry = F.concat_ws(" ", "path", F.col("bytes").cast("string"), F.coalesce("sha256", F.lit("none")), "disposition")
    kinds = F.array_compact(F.array(F.lit("inventory"), F.when(F.col("disposition") == "parsed", "source"), F.when(F.col("kind").isin("manifest", "lockfile"), "manifest")))
    rows = listing.select(F.explode(kinds).alias("of"), F.left(F.sha2("path", 256), F.lit(2)).alias("leaf"), entry.alias("e"))
    leaves = rows.groupBy("of", "leaf").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("e")), "\n"), 256).alias("h"))
    return leaves.groupBy("of").agg(F.sum("n").alias("entries"), F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "leaf", "h"))), "\n"), 256)).alias("digest"))


def available() -> list[str]:
    """The formats that can be parsed."""
    return sorted(registry())


