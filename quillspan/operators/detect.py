"""Ranked format detection of files: signals of name, media type, hint, leading bytes, packages and text, combined per
format, ranked with their evidence and decided.

Signals are columns over the first bytes and a decoded sample, so they stay in the JVM; only packages are opened in
Python, and only rows that begin like one. The signals of a file are one array, exploded and grouped once.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINIMUM = 0.40
MARGIN = 0.08
NOT_DECISIVE = 0.84
LEAST = 0.10
SAMPLE_BYTES = 256 << 10

# Formats with extensions and media type. Several formats of an extension are all candidates.
FORMATS = {
    "rust": ("rs", "text/x-rust"), "python": ("py pyi", "text/x-python"), "javascript": ("js mjs cjs", "text/javascript"), "typescript": ("ts mts cts", "text/typescript"), "tsx": ("tsx", "text/tsx"), "jsx": ("jsx", "text/jsx"), "go": ("go", "text/x-go"),
    "java": ("java", "text/x-java"), "kotlin": ("kt kts", "text/x-kotlin"), "c": ("c h", "text/x-c"), "cpp": ("cc cpp cxx hpp hh hxx h", "text/x-c++src"), "csharp": ("cs", "text/x-csharp"), "ruby": ("rb rake", "text/x-ruby"), "php": ("php phtml", "text/x-php"),
    "swift": ("swift", "text/x-swift"), "bash": ("sh bash", "text/x-shellscript"), "sql": ("sql", "application/sql"), "css": ("css", "text/css"), "markdown": ("md markdown", "text/markdown"), "r_markdown": ("rmd", "text/x-r-markdown"), "quarto": ("qmd", "text/x-quarto"),
    "restructured_text": ("rst rest", "text/x-rst"), "asciidoc": ("adoc asciidoc asc", "text/asciidoc"), "latex": ("tex latex", "application/x-latex"), "bibtex": ("bib", "application/x-bibtex"), "html": ("html htm", "text/html"), "xml": ("xml xhtml jats nxml", "application/xml"),
    "csv": ("csv", "text/csv"), "tsv": ("tsv", "text/tab-separated-values"), "json": ("json", "application/json"), "jsonl": ("jsonl ndjson", "application/x-ndjson"), "yaml": ("yaml yml", "application/yaml"), "toml": ("toml", "application/toml"), "cbor": ("cbor", "application/cbor"),
    "msgpack": ("msgpack mpk", "application/msgpack"), "protobuf": ("pb protobuf", "application/x-protobuf"), "text": ("txt", "text/plain"), "pdf": ("pdf", "application/pdf"), "zip": ("zip", "application/zip"), "tar": ("tar", "application/x-tar"), "gzip": ("gz tgz", "application/gzip"),
    "bzip2": ("bz2", "application/x-bzip2"), "xz": ("xz", "application/x-xz"), "zstd": ("zst", "application/zstd"), "7z": ("7z", "application/x-7z-compressed"), "docx": ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "pptx": ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"), "xlsx": ("xlsx xlsm", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), "epub": ("epub", "application/epub+zip"), "odt": ("odt", "application/vnd.oasis.opendocument.text"),
    "odp": ("odp", "application/vnd.oasis.opendocument.presentation"), "ods": ("ods", "application/vnd.oasis.opendocument.spreadsheet"), "rtf": ("rtf", "application/rtf"), "eml": ("eml", "message/rfc822"), "mbox": ("mbox", "application/mbox"), "outlook_msg": ("msg", "application/vnd.ms-outlook"),
    "icalendar": ("ics", "text/calendar"), "vcard": ("vcf", "text/vcard"), "ipynb": ("ipynb", "application/x-ipynb+json"), "srt": ("srt", "application/x-subrip"), "webvtt": ("vtt", "text/vtt"), "ttml": ("ttml dfxp", "application/ttml+xml"), "png": ("png", "image/png"),
    "jpeg": ("jpg jpeg", "image/jpeg"), "gif": ("gif", "image/gif"), "tiff": ("tif tiff", "image/tiff"), "webp": ("webp", "image/webp"), "bmp": ("bmp", "image/bmp"), "heif": ("heic heif avif", "image/heif"), "svg": ("svg", "image/svg+xml"), "mp3": ("mp3", "audio/mpeg"), "wav": ("wav", "audio/wav"),
    "flac": ("flac", "audio/flac"), "mp4": ("mp4 m4a m4v", "video/mp4"), "quicktime": ("mov", "video/quicktime"), "matroska": ("mkv webm", "video/x-matroska"), "arrow": ("arrow feather", "application/vnd.apache.arrow.file"), "parquet": ("parquet", "application/vnd.apache.parquet"), "sqlite": ("sqlite db sqlite3", "application/vnd.sqlite3"),
}
# Fixed values: (format, pattern of the hex digits of the first 512 bytes, what it is, weight). The first that fits counts.
MAGIC = (
    ("pdf", "^255044462D", "PDF header", 0.99), ("pdf", "^25504446", "truncated PDF header", 0.88), ("zip", "^504B(?:0304|0506|0708)", "ZIP container", 0.90), ("tar", "^(?:..){257}7573746172", "TAR header", 0.98), ("mp3", "^494433", "ID3 audio", 0.97), ("wav", "^52494646.{8}57415645", "RIFF WAVE", 0.99),
    ("flac", "^664C6143", "FLAC stream", 0.99), ("matroska", "^1A45DFA3.*4282(?:88|84)(?:6D6174726F736B61|7765626D)", "EBML document type", 0.99), ("heif", "^.{8}66747970(?:68656963|68656978|68657663|6D696631|6D736631|61766966|61766973)", "HEIF brand", 0.98), ("quicktime", "^.{8}6674797071742020", "QuickTime brand", 0.99),
    ("mp4", "^.{8}66747970", "MP4 brand", 0.98), ("png", "^89504E470D0A1A0A", "PNG signature", 0.995), ("jpeg", "^FFD8FF", "JPEG start", 0.99), ("gif", "^474946383[79]61", "GIF signature", 0.99), ("tiff", "^(?:49492A00|4D4D002A)", "TIFF signature", 0.99), ("webp", "^52494646.{8}57454250", "RIFF WEBP", 0.99), ("bmp", "^424D", "BMP signature", 0.96),
    ("rtf", "^7B5C727466", "RTF header", 0.98), ("sqlite", "^53514C69746520666F726D6174203300", "SQLite header", 0.99), ("outlook_msg", "^D0CF11E0A1B11AE1", "compound file", 0.90), ("gzip", "^1F8B08", "gzip member", 0.98), ("bzip2", "^425A68[3][1-9]", "bzip2 stream", 0.98), ("xz", "^FD377A585A00", "xz stream", 0.99), ("zstd", "^28B52FFD", "Zstandard frame", 0.99),
    ("7z", "^377ABCAF271C", "7z signature", 0.99), ("parquet", "^50415231", "Parquet head", 0.94), ("arrow", "^4152524F5731", "Arrow file head", 0.94),
)
# Fixed values: (format, what it is, pattern of the sample, weight); read alike in Java and RE2.
SIGNALS = (
    ("html", "document type or root", r"(?i)^\s*(<!doctype html|<html[\s>])", 0.95), ("html", "block elements", r"(?i)<(body|h[1-6]|div|table|ul|li|p)[ >]", 0.45), ("xml", "declaration", r"^\s*<\?xml\s", 0.90), ("svg", "root", r"(?i)^\s*(<\?xml[^>]*>\s*)?<svg[\s>]", 0.94),
    ("ttml", "root", r"^\s*(<\?xml[^>]*>\s*)?<(\w+:)?tt[\s>]", 0.94), ("json", "object or array", r"^\s*(\{\s*(\"[^\"]*\"\s*:|\})|\[)[\s\S]*[\]}]\s*$", 0.60), ("jsonl", "lines of objects", r"^\s*\{[^\n]*\}\s*\n\{[^\n]*\}", 0.82), ("yaml", "document start or keys", r"^(---\s*\n)?([A-Za-z_][\w-]*:([ \t][^\n]*)?\n){2,}", 0.55),
    ("toml", "table or assignments", r"(?m)^\[{1,2}[\w.\"-]+\]{1,2}\s*$", 0.50), ("markdown", "heading", r"(?m)^#{1,6} \S", 0.50), ("markdown", "fence", r"(?m)^```", 0.45), ("markdown", "link", r"\[[^\[\]]+\]\([^()\s]+\)", 0.35), ("markdown", "table rule", r"(?m)^\|:?-{2,}", 0.45),
    ("restructured_text", "directive", r"(?m)^\.\. [\w:-]+::", 0.70), ("asciidoc", "title or block", r"(?m)^(= \S|\[source|\|===$)", 0.60), ("latex", "document class", r"\\documentclass|\\begin\{document\}", 0.92), ("bibtex", "entry", r"(?m)^@(article|book|inproceedings|misc|phdthesis|techreport|online)\s*\{", 0.90),
    ("mbox", "separator", r"^From [^\n]+\n[A-Za-z-]+:", 0.94), ("eml", "headers", r"^(From|To|Subject|Received|Date|Message-ID|MIME-Version|Return-Path): [^\n]*\n([A-Za-z-]+: |\s)", 0.82), ("icalendar", "calendar", r"^\s*BEGIN:VCALENDAR", 0.98), ("vcard", "card", r"^\s*BEGIN:VCARD", 0.98),
    ("webvtt", "header", r"^WEBVTT", 0.98), ("srt", "timing", r"(?m)^[0-9]+\s*\n[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3} --> ", 0.82), ("python", "definitions", r"(?m)^(def|class) \w+[^\n]*:\s*$|^(from [\w.]+ )?import [\w., ]+$", 0.60), ("rust", "items", r"(?m)^\s*(pub )?(fn|struct|impl|enum|trait|mod|use) \w[^\n]*[{;]", 0.60),
    ("javascript", "declarations", r"(?m)^\s*(const|let|var) \w+ = |^\s*(export |async )*function \w+\(", 0.50), ("typescript", "types", r"(?m)^\s*(export )?(interface|type|enum) \w+", 0.55), ("go", "package", r"(?m)^package \w+\s*$", 0.75), ("java", "class", r"(?m)^\s*public (final )?(class|interface|enum) \w+", 0.60),
    ("sql", "statement", r"(?im)^\s*(select\s[\s\S]+\sfrom\s|create table |insert into )", 0.55), ("bash", "shebang", r"^#!.*\b(ba|z|da)?sh\b", 0.88), ("python", "shebang", r"^#!.*\bpython", 0.88),
)
# Names of whole files.
NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "cargo.toml": "toml", "package.json": "json", "readme": "text", "license": "text"}
_SIGNAL = "struct<format:string,kind:string,evidence:string,w:double,decisive:boolean>"


def _signal(format: Column, kind: str, evidence: Column, weight: Column | float, decisive: bool) -> Column:
    return F.struct(format.alias("format"), F.lit(kind).alias("kind"), evidence.alias("evidence"), (F.lit(weight) if isinstance(weight, float) else weight).cast("double").alias("w"), F.lit(decisive).alias("decisive"))


def magic_signals(content: Column | None, head: Column | None = None) -> Column:
    """At most one signal, by the first bytes, or by their hex digits if a column has them already."""
    head = F.hex(F.substring(content, 1, 512)) if head is None else head
    rules = [F.when(head.rlike(p), _signal(F.lit(f), "magic", F.lit(e), w, True)) for f, p, e, w in MAGIC]
    return F.array_compact(F.array(F.coalesce(*rules)))


def text_sample(content: Column) -> Column:
    """The decoded beginning of text; null for bytes that are none (a zero byte, or many controls, without a mark of UTF-16)."""
    head = F.substring(content, 1, SAMPLE_BYTES)
    mark = F.hex(F.substring(content, 1, 3))
    plain = F.make_valid_utf8(F.when(mark == "EFBBBF", F.substring(head, 4, SAMPLE_BYTES)).otherwise(head).cast("string"))

    @F.pandas_udf("string")
    def decoded(heads: pd.Series) -> pd.Series:
        return heads.map(lambda b: None if b is None else bytes(b)[: len(b) // 2 * 2].decode("utf-16", "ignore"))

    wide = decoded(F.when(mark.startswith("FFFE") | mark.startswith("FEFF"), head))
    controls = F.regexp_count(F.left(plain, F.lit(4096)), F.lit(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]"))
    return F.coalesce(wide, F.when((controls == 0) | (controls * 50 < F.length(F.left(plain, F.lit(4096)))) & ~F.contains(plain, F.lit("\x00")), plain))


def first_lines(sample: Column) -> Column:
    """The first eight lines that are not empty, of the first 63, without what their quoted cells hold."""
    lines = F.split(sample, "\r\n|\r|\n", 64)
    lines = F.when(F.size(lines) == 64, F.slice(lines, 1, 63)).otherwise(lines)
    return F.transform(F.slice(F.filter(lines, lambda x: x != ""), 1, 8), lambda x: F.regexp_replace(x, '"[^"]*"', ""))


def delimited(lines: Column, delimiter: str) -> Column:
    """Whether lines as ``first_lines`` gives them are two or more and have the same number of cells, more than one."""
    widths = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))))
    return (F.size(lines) >= 2) & (F.size(F.array_distinct(widths)) == 1) & (F.get(widths, F.lit(0)) > 0)


def text_signals(sample: Column, lines: Column | None = None) -> Column:
    """Signals of structure; text without any is plain. lines: ``first_lines`` of the sample, if a column has them."""
    lines = first_lines(sample) if lines is None else lines
    rules = [F.when(sample.rlike(p), _signal(F.lit(f), "structure", F.lit(e), w, False)) for f, e, p, w in SIGNALS]
    rules += [F.when(delimited(lines, d), _signal(F.lit(f), "structure", F.lit("equal widths"), 0.62, False)) for f, d in (("csv", ","), ("tsv", "\t"))]
    found = F.array_compact(F.array(*rules))
    plain = F.array(_signal(F.lit("text"), "charset", F.lit("decodes as text"), 0.44, False))
    # bound to a variable, the rules run once; named twice in a condition they would run twice
    chosen = F.flatten(F.transform(F.array(found), lambda x: F.when(F.size(x) == 0, plain).otherwise(x)))
    return F.when(sample.isNull(), F.array().cast(f"array<{_SIGNAL}>")).otherwise(chosen)


def label_signals(filename: Column, media: Column, hint: Column) -> Column:
    """Signals of extension, whole name, declared media type and hint; they never decide alone."""
    by_extension: dict[str, list[str]] = {}
    by_media = {}
    for f, (exts, m) in FORMATS.items():
        by_media[m] = f
        for e in exts.split():
            by_extension.setdefault(e, []).append(f)
    name = F.lower(F.regexp_extract(filename, r"([^/\\]*)$", 1))
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    table = F.create_map(*[x for e, fs in by_extension.items() for x in (F.lit(e), F.array(*map(F.lit, fs)))])
    labels = F.coalesce(F.element_at(table, ext), F.array().cast("array<string>"))
    own = F.transform(labels, lambda f: _signal(f, "extension", F.concat(F.lit("."), ext), 0.55, False))
    named = F.element_at(F.create_map(*[F.lit(x) for p in NAMES.items() for x in p]), name)
    kind = F.element_at(F.create_map(*[F.lit(x) for p in by_media.items() for x in p]), F.lower(F.trim(F.split_part(media, F.lit(";"), F.lit(1)))))
    rest = F.array_compact(F.array(
        F.when(named.isNotNull(), _signal(named, "filename", name, 0.60, False)), F.when(kind.isNotNull(), _signal(kind, "media_type", F.lower(media), 0.72, False)), F.when(hint.isin(*FORMATS), _signal(hint, "hint", hint, 0.80, False)),
    ))
    return F.concat(F.coalesce(own, F.array().cast(f"array<{_SIGNAL}>")), rest)


def _package(data: bytes | None) -> list[dict]:
    """What a ZIP package says it is."""
    if data is None:
        return []
    try:
        box = zipfile.ZipFile(io.BytesIO(data))
        names = set(box.namelist())
        kind, why = None, None
        if "mimetype" in names and box.getinfo("mimetype").file_size < 200:
            media = box.read("mimetype").decode("ascii", "replace").strip()
            kind, why = next(((f, "mimetype member") for f, (_, m) in FORMATS.items() if m == media.removesuffix("-template")), (None, None))
        if kind is None and "[Content_Types].xml" in names:
            for part, f in (("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx")):
                if part in names:
                    kind, why = f, "content types and main part"
        return [] if kind is None else [{"format": kind, "kind": "container", "evidence": why, "w": 0.98, "decisive": True}]
    except (zipfile.BadZipFile, KeyError, RuntimeError, NotImplementedError, OSError):
        return []


def package_signals(content: Column) -> Column:
    @F.pandas_udf(f"array<{_SIGNAL}>")
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([_package(c) for c in contents])

    return run(F.when(F.hex(F.substring(content, 1, 4)).rlike("^504B0304"), content))


def _binary(data: bytes | None) -> list[dict]:
    """CBOR and MessagePack: one object or array that takes up all bytes."""
    from quillspan.formats.base import rows_of

    out = []
    for format in ("cbor", "msgpack") if data else ():
        found = rows_of(format, data, {})
        if found[0][5]["status"] == "complete" and found[0][5].get("items") == "1" and found[1][2] in ("object", "array"):
            out.append({"format": format, "kind": "structure", "evidence": "complete value", "w": 0.82, "decisive": False})
    return out


def binary_signals(content: Column, sample: Column) -> Column:
    """Signals of binary values, for bytes that are no text and begin like nothing known."""

    @F.pandas_udf(f"array<{_SIGNAL}>")
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([_binary(c) for c in contents])

    return run(F.when(sample.isNull() & (F.size(magic_signals(content)) == 0) & (F.octet_length(content) <= SAMPLE_BYTES), content))


def signals(df: DataFrame, key: str, content: str, filename: str | None = None, media: str | None = None, hint: str | None = None, packages: bool = True) -> DataFrame:
    """key, format, kind, evidence, w and decisive of every signal of every file. Null content has those of its labels."""
    none = F.lit(None).cast("string")
    labels = label_signals(*(F.col(c) if c else none for c in (filename, media, hint)))
    rows = df.select(F.col(key), F.col(content).cast("binary").alias("_c"), labels.alias("_labels"))
    rows = rows.withColumns({"_head": F.hex(F.substring("_c", 1, 512)), "_sample": text_sample(F.col("_c"))})

    def once(value: Column, rules) -> Column:
        """Rules on a value that is computed once: the optimizer would put its expression into each of them."""
        return F.flatten(F.transform(F.array(value), rules))

    text = once(F.col("_sample"), lambda s: once(first_lines(s), lambda x: text_signals(s, x)))
    parts = [once(F.col("_head"), lambda h: magic_signals(None, h)), text, F.col("_labels")]
    if packages:
        parts += [package_signals(F.col("_c")), binary_signals(F.col("_c"), F.col("_sample"))]
    empty = F.array().cast(f"array<{_SIGNAL}>")
    found = rows.select(key, F.concat(*[F.coalesce(p.cast(f"array<{_SIGNAL}>"), empty) for p in parts]).alias("_all"))
    return found.select(key, F.explode("_all").alias("s")).select(key, "s.*")


def candidates(found: DataFrame, key: str) -> DataFrame:
    """key, format, confidence, decisive, kinds, evidence and rank of every format with a signal.

    Confidences are combined as 1 minus the product of their complements, once for each different evidence. Where a file
    has decisive evidence, formats without any stay at 0.84 at most. Formats below 0.10 are dropped. Ranks follow
    confidence, then the name of the format.
    """
    each = found.groupBy(key, "format", "kind", "evidence").agg(F.max("w").alias("w"), F.bool_or("decisive").alias("decisive"))
    log = F.log(F.greatest(1 - F.col("w"), F.lit(1e-12)))
    per = each.groupBy(key, "format").agg(F.round(1 - F.exp(F.sum(log)) + 1e-9, 4).alias("c"), F.bool_or("decisive").alias("decisive"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "kind", "evidence"))), ", ").alias("evidence"))
    any_decisive = F.max("decisive").over(Window.partitionBy(key))
    per = per.withColumn("confidence", F.when(any_decisive & ~F.col("decisive"), F.least("c", F.lit(NOT_DECISIVE))).otherwise(F.col("c"))).where(F.col("confidence") >= LEAST).drop("c")
    return per.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "format")))


def decide(ranked: DataFrame, key: str, available: list[str], policy: str = "return_ambiguous", minimum: float = MINIMUM, margin: float = MARGIN) -> DataFrame:
    """key, status, format, confidence, rivals and contradiction of each file with candidates.

    status: ``unknown`` (the best is below the minimum), ``ambiguous`` (others are within the margin and the policy picks
    none), ``selected``, or ``unsupported`` (the format has no parser). Policies: return_ambiguous, select_highest_ranked,
    prefer_available (if exactly one of those within the margin has a parser). contradiction: the best has bytes or a
    package as evidence, and some other candidate a label.
    """
    if policy not in ("return_ambiguous", "select_highest_ranked", "prefer_available"):
        raise ValueError(policy)
    top = F.max("confidence").over(Window.partitionBy(key))
    rows = ranked.withColumn("near", (F.col("confidence") >= minimum) & (top - F.col("confidence") <= margin + 1e-9)).withColumn("can", F.col("format").isin(*available))
    best = F.struct("format", "confidence", "kinds", "can")
    labels = F.arrays_overlap("kinds", F.array(F.lit("extension"), F.lit("filename"), F.lit("media_type")))
    per = rows.groupBy(key).agg(
        F.min_by(best, "rank").alias("b"), F.count_if("near").alias("rivals"), F.count_if(F.col("near") & F.col("can")).alias("n_can"), F.min_by(F.when(F.col("near") & F.col("can"), best), F.when(F.col("near") & F.col("can"), F.col("rank"))).alias("p"),
        F.bool_or(labels & (F.col("rank") > 1)).alias("labelled"),
    )
    pick = F.when(F.col("rivals") <= 1, F.col("b"))
    if policy == "select_highest_ranked":
        pick = F.col("b")
    elif policy == "prefer_available":
        pick = F.when(F.col("rivals") <= 1, F.col("b")).when(F.col("n_can") == 1, F.col("p"))
    weak = F.col("b.confidence") < minimum
    per = per.withColumn("pick", F.when(~weak, pick))
    status = F.when(weak, "unknown").when(F.col("pick").isNull(), "ambiguous").when(F.col("pick.can"), "selected").otherwise("unsupported")
    clash = F.arrays_overlap("b.kinds", F.array(F.lit("magic"), F.lit("container"))) & F.col("labelled")
    return per.select(key, status.alias("status"), F.col("pick.format").alias("format"), F.col("pick.confidence").alias("confidence"), "rivals", clash.alias("contradiction"))


def detect(df: DataFrame, key: str, content: str, filename: str | None = None, media: str | None = None, hint: str | None = None, policy: str = "select_highest_ranked") -> DataFrame:
    """The decision for every file: signals, candidates and decision in one; files without any signal have none."""
    from quillspan.formats.base import registry

    return decide(candidates(signals(df, key, content, filename, media, hint), key), key, sorted(registry()), policy)


def file_kind(path: Column) -> Column:
    """source, test, manifest, lockfile, generated, binary, documentation or other, by path and name."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name, ext = F.regexp_extract(p, r"([^/]*)$", 1), F.regexp_extract(p, r"\.([^./]+)$", 1)
    return (
        F.when(name.rlike(r"(\.lock|-lock\.(json|yaml)|^go\.sum|^npm-shrinkwrap\.json)$"), "lockfile")
        .when(name.rlike(r"^(cargo\.toml|package\.json|pyproject\.toml|setup\.(py|cfg)|go\.mod|pom\.xml|build\.gradle(\.kts)?|gemfile|composer\.json|requirements[\w.-]*\.txt|dockerfile|makefile)$"), "manifest")
        .when(p.rlike(r"(^|/)(generated|dist|build|target|node_modules|vendor)/") | name.rlike(r"(\.min\.(js|css)|\.pb\.go|_pb2\.py|\.generated\.\w+|\.g\.\w+)$"), "generated")
        .when(p.rlike(r"(^|/)(tests?|spec|__tests__)/") | name.rlike(r"(^test_.*|.*_test|.*\.(test|spec))\.\w+$"), "test")
        .when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "tar", "7z", "exe", "dll", "so", "dylib", "class", "jar", "wasm", "bin", "mp3", "mp4", "woff", "woff2", "ttf", "parquet", "sqlite"), "binary")
        .when(ext.isin("md", "rst", "adoc", "txt", "tex", "html", "pdf") | name.rlike(r"^(readme|license|changelog|contributing)"), "documentation")
        .when(ext.isin("rs", "py", "js", "jsx", "ts", "tsx", "go", "java", "kt", "c", "cc", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "sh", "sql", "css", "scala"), "source").otherwise("other")
    )
