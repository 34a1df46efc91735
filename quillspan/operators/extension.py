"""Extension points: parsers and providers of the caller, budgets, the cache of results and what can be done here."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.formats.base import Tree, registry
from quillspan.formats.structured import canonical
from quillspan.operators.detect import FORMATS


@dataclass(frozen=True)
class Descriptor:
    """What a parser reads: format, other names of it, priority (the highest wins) and whether it is the caller's."""

    id: str
    format: str
    aliases: tuple[str, ...] = ()
    priority: int = 0
    available: bool = True
    caller: bool = False


@dataclass
class Parsers:
    """The parsers at hand. A caller's parser needs an id of its own and, for a format that is there, a higher priority."""

    descriptors: dict[str, Descriptor] = field(default_factory=dict)
    functions: dict[str, Callable[[bytes, dict], Tree]] = field(default_factory=dict)

    @staticmethod
    def builtin() -> Parsers:
        out = Parsers()
        for name, function in registry().items():
            out.descriptors[f"builtin.{name}"] = Descriptor(f"builtin.{name}", name, tuple(FORMATS.get(name, ("",))[0].split()))
            out.functions[f"builtin.{name}"] = function
        return out

    def register(self, descriptor: Descriptor, function: Callable[[bytes, dict], Tree]) -> None:
        if descriptor.id in self.descriptors:
            raise ValueError(f"parser {descriptor.id} is there already")
        equal = [d for d in self.descriptors.values() if d.format == descriptor.format and d.priority >= descriptor.priority]
        if equal:
            raise ValueError(f"{descriptor.format} has a parser of the same or a higher priority: {equal[0].id}")
        taken = {a: d.format for d in self.descriptors.values() for a in d.aliases}
        clash = [a for a in descriptor.aliases if taken.get(a, descriptor.format) != descriptor.format]
        if clash:
            raise ValueError(f"aliases belong to another format: {', '.join(clash)}")
        self.descriptors[descriptor.id] = descriptor
        self.functions[descriptor.id] = function

    def select(self, name: str) -> Descriptor | None:
        """The available parser of a format or alias with the highest priority; of equal ones the first by id."""
        found = [d for d in self.descriptors.values() if (d.format == name or name in d.aliases) and d.available]
        return min(found, key=lambda d: (-d.priority, d.id), default=None)

    def table(self, spark: SparkSession) -> DataFrame:
        """The registry as a table: format, alias, parser, priority, available. It has a row for each name, a few hundred."""
        rows = [(d.format, a, d.id, d.priority, d.available) for d in self.descriptors.values() for a in {d.format, *d.aliases}]
        return spark.createDataFrame(rows, "format string, alias string, parser string, priority int, available boolean")

    def resolve(self, df: DataFrame, name: str) -> DataFrame:
        """The table with the parser selected for the format or alias in a column, or null."""
        best = self.table(df.sparkSession).where("available").groupBy("alias").agg(F.min_by("parser", F.struct((-F.col("priority")).alias("p"), "parser")).alias("parser"))
        return df.join(F.broadcast(best), df[name] == best["alias"], "left").drop("alias")

    def parse(self, data: bytes, name: str, options: dict | None = None) -> list[tuple]:
        chosen = self.select(name)
        if chosen is None:
            raise LookupError(f"no parser for {name}")
        return self.functions[chosen.id](data, options or {}).done()


KINDS = ("ocr", "transcription", "decryption", "backend")


@dataclass(frozen=True)
class Provider:
    """A service of the caller: its kind, name, version and, for readings with confidences, the model of these."""

    kind: str
    name: str
    version: str
    call: Callable[[bytes, dict], list[dict]]
    confidence_model: str | None = None


def request_digest(kind: str, content: Column, options: dict) -> Column:
    """The digest by which an answer of a provider can be recorded and found again. Secrets never enter it."""
    shown = {k: v for k, v in options.items() if not _secret(k)}
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", F.lit(kind), F.sha2(content, 256), F.lit(canonical(shown))), 256))


def _secret(name: str) -> bool:
    return any(x in name.lower() for x in ("secret", "token", "password", "key", "credential"))


def execute(df: DataFrame, key: str, content: str, provider: Provider, options: dict | None = None) -> DataFrame:
    """key, digest, status, error and items (JSON) of a provider's answer for every row.

    Providers run in the tasks, one row after the other. A provider that raises gives status ``failed`` with its error, in
    which values of secret options are blanked; items with a confidence need a provider that names the model of it.
    """
    if provider.kind not in KINDS:
        raise ValueError(f"unknown kind of provider {provider.kind}")
    options = options or {}
    hidden = [str(v) for k, v in options.items() if _secret(k) and v]

    @F.pandas_udf("status string, error string, items string")
    def run(contents: pd.Series) -> pd.DataFrame:
        out = []
        for c in contents:
            try:
                items = provider.call(bytes(c), options) if c is not None else None
                if items is not None and any("confidence" in i for i in items) and provider.confidence_model is None:
                    raise ValueError("confidences without a confidence model")
                out.append(("missing" if items is None else "succeeded", None, None if items is None else canonical(items)))
            except Exception as e:  # noqa: BLE001 - a failing provider must not end the job
                text = f"{type(e).__name__}: {e}"
                for h in hidden:
                    text = text.replace(h, "***")
                out.append(("failed", text[:500], None))
        return pd.DataFrame(out, columns=["status", "error", "items"])

    raw = F.col(content).cast("binary")
    return df.select(F.col(key), request_digest(provider.kind, raw, options).alias("digest"), run(raw).alias("r")).select(key, "digest", "r.*")


def replay(df: DataFrame, key: str, content: str, kind: str, recorded: DataFrame, options: dict | None = None) -> DataFrame:
    """The same from recorded answers (digest, status, error, items) instead of a provider; what was not recorded is
    ``not_recorded``. Answers are joined by digest."""
    asked = df.select(F.col(key), request_digest(kind, F.col(content).cast("binary"), options or {}).alias("digest"))
    return asked.join(recorded.dropDuplicates(["digest"]).select("digest", "status", "error", "items"), "digest", "left").select(key, "digest", F.coalesce("status", F.lit("not_recorded")).alias("status"), "error", "items")


@dataclass(frozen=True)
class Budget:
    """Limits of an operation; null is no limit. Sums are over an operation, maxima over its parts."""

    input_bytes: int | None = None
    records: int | None = None
    cells: int | None = None
    nodes: int | None = None
    members: int | None = None
    children: int | None = None
    output_bytes: int | None = None
    depth: int | None = None
    ratio: int | None = None
    memory_bytes: int | None = None
    temporary_bytes: int | None = None
    seconds: int | None = None

    MAXIMA = ("depth", "ratio", "memory_bytes")

    @staticmethod
    def untrusted() -> Budget:
        """For input of unknown origin."""
        return Budget(64 << 20, 1_000_000, 5_000_000, 2_000_000, 100_000, 10_000, 256 << 20, 256, 100, 512 << 20, 1 << 30, 120)

    def usage(self, rows: DataFrame, group: str) -> DataFrame:
        """group, axis, used and limit: sums, or maxima for depth, ratio and memory, of the columns that name an axis."""
        axes = [f.name for f in fields(self) if f.name in rows.columns]
        totals = rows.groupBy(group).agg(*[(F.max(a) if a in self.MAXIMA else F.sum(a)).cast("long").alias(a) for a in axes])
        parts = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("used"), F.lit(getattr(self, a)).cast("long").alias("limit")) for a in axes])
        return totals.select(group, F.explode(parts).alias("x")).select(group, "x.*")

    def exhausted(self, rows: DataFrame, group: str, emitted: str | None = None) -> DataFrame:
        """group, code, used, limit and status of every axis that went over: ``partial`` if something was emitted before
        (column ``emitted`` of the rows), else ``failed``."""
        over = self.usage(rows, group).where("used > limit")
        if emitted:
            any_ = rows.groupBy(F.col(group).alias("_g")).agg(F.sum(emitted).alias("_e"))
            over = over.join(any_, F.col(group).eqNullSafe(F.col("_g")), "left")
        status = F.when(F.col("_e") > 0, "partial").otherwise("failed") if emitted else F.lit("failed")
        return over.select(group, F.concat(F.lit("budget."), "axis", F.lit(".exhausted")).alias("code"), "used", "limit", status.alias("status"))


def cache_key(operation: str, input_sha256: Column, parser: str, schema_version: str, options: dict, providers: list[str] = ()) -> Column:
    """The digest of everything a result depends on; digests of providers count once each, in order."""
    fixed = canonical({"operation": operation, "parser": parser, "schema": schema_version, "options": options, "providers": sorted(set(providers))})
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", F.lit(fixed), input_sha256), 256))


class Cache:
    """Results by key in a folder of the shared file system, kept as tables by the first two digits of the key. What is
    there is not computed again; an entry whose digest does not hold is computed again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        schema = "key string, value string, digest string, shard string"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).where(F.col("digest") == F.sha2("value", 256))

    def load_or_compute(self, df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(key and value of all rows of ``df``, the keys that were computed now). compute: rows to (key, value); only rows
        whose key is not cached reach it."""
        from quillspan.session import Scratch

        scratch = Scratch(self.spark, "cache")
        known = self.load().select("key", "value").dropDuplicates(["key"])
        keys = df.select(F.col(key).alias("key")).distinct()
        hits = scratch.put(keys.join(known, "key"), "hits")
        misses = df.join(hits.select(F.col("key").alias(key)), key, "left_anti").dropDuplicates([key])
        fresh = scratch.put(compute(misses).select("key", "value"), "fresh")
        fresh.select("key", "value", F.sha2("value", 256).alias("digest"), F.substring(F.regexp_replace("key", "^sha256:", ""), 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(self.path)
        return hits.unionByName(fresh), fresh.select("key")


def capabilities(spark: SparkSession, parsers: Parsers | None = None, providers: list[Provider] = ()) -> DataFrame:
    """kind (format, provider, renderer), name and available: what can be read, asked and written here."""
    from quillspan.operators.render import FORMATS as RENDERED

    p = parsers or Parsers.builtin()
    formats = sorted(set(FORMATS) | {d.format for d in p.descriptors.values()})
    rows = [("format", f, p.select(f) is not None) for f in formats] + [("provider", k, any(x.kind == k for x in providers)) for k in KINDS] + [("renderer", r, True) for r in RENDERED]
    return spark.createDataFrame(rows, "kind string, name string, available boolean")


def unsupported(found: DataFrame) -> DataFrame:
    """What is declared and not available."""
    return found.where("not available").select("kind", "name")


def normalized(value: str, removed: list[str] = (), root: str | None = None) -> str:
    """JSON for comparing with a stored expectation: canonical, without the members at some pointers, a root folder being
    written as ``<root>``."""
    tree = json.loads(value)
    for pointer in removed:
        *path, last = [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]
        at = tree
        for t in path:
            at = at[int(t)] if isinstance(at, list) else at.get(t, {})
        if isinstance(at, dict):
            at.pop(last, None)
    text = canonical(tree)
    return text.replace(root, "<root>") if root else text
