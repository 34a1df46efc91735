"""Bytes to text: marks, declarations and the choice of an encoding, and what was lost."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks at the beginning (longest first), labels of encodings, and encodings that Spark decodes.
MARKS = (("FFFE0000", "utf-32le", 4), ("0000FEFF", "utf-32be", 4), ("EFBBBF", "utf-8", 3), ("FFFE", "utf-16le", 2), ("FEFF", "utf-16be", 2))
LABELS = {
    "utf8": "utf-8", "utf-8": "utf-8", "unicode-1-1-utf-8": "utf-8", "ascii": "windows-1252", "us-ascii": "windows-1252", "latin1": "windows-1252", "latin-1": "windows-1252", "iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "l1": "windows-1252", "cp1252": "windows-1252", "windows-1252": "windows-1252", "x-cp1252": "windows-1252",
    "iso-8859-2": "iso-8859-2", "latin2": "iso-8859-2", "iso-8859-15": "iso-8859-15", "latin9": "iso-8859-15", "windows-1250": "windows-1250", "cp1250": "windows-1250", "windows-1251": "windows-1251", "cp1251": "windows-1251", "koi8-r": "koi8-r", "utf-16": "utf-16le", "utf-16le": "utf-16le", "utf-16be": "utf-16be", "utf-32le": "utf-32le", "utf-32be": "utf-32be",
    "shift_jis": "shift_jis", "shift-jis": "shift_jis", "sjis": "shift_jis", "gbk": "gbk", "gb2312": "gbk", "gb18030": "gb18030", "big5": "big5", "euc-jp": "euc-jp", "euc-kr": "euc-kr", "macintosh": "macintosh",
}


def mark(content: Column) -> Column:
    """encoding and length of the byte order mark, or null."""
    head = F.hex(F.substring(content, 1, 4))
    return F.coalesce(*[F.when(head.startswith(h), F.struct(F.lit(e).alias("encoding"), F.lit(n).alias("length"))) for h, e, n in MARKS])


def canonical(label: Column) -> Column:
    """The encoding a label stands for, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), F.lower(F.trim(label)))


def _head(content: Column) -> Column:
    return F.decode(F.substring(content, 1, 1024), "ISO-8859-1")


def html_declaration(content: Column) -> Column:
    """The label of a meta element among the first 1,024 bytes, or null."""
    label = F.regexp_extract(_head(content), r"(?i)<meta\s[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", 1)
    return F.nullif(label, F.lit(""))


def xml_declaration(content: Column) -> Column:
    """The label of an XML declaration, or null."""
    label = F.regexp_extract(_head(content), r"^\s*<\?xml\s[^>]*?encoding\s*=\s*[\"']([\w.:-]+)", 1)
    return F.nullif(label, F.lit(""))


def xml_signature(content: Column) -> Column:
    """The encoding shown by how a declaration's first characters lie in the bytes, or null."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "3C003F00", "utf-16le").when(head == "003C003F", "utf-16be").when(head == "3C000000", "utf-32le").when(head == "0000003C", "utf-32be")


def decoded(df: DataFrame, content: str, transport: str | None = None, default: str = "windows-1252") -> DataFrame:
    """Adds encoding, chosen_by, text, replaced (characters that stand for lost bytes), conflict and declared.

    A mark decides, then the transport's label, the XML signature, and a declaration in XML or HTML; without any, bytes
    that are UTF-8 are that, and others the default. declared has all labels found with their source; conflict tells that
    two of them name different encodings. A mark is no part of the text. Unknown labels decide nothing. Null for null.
    """
    c = F.col(content).cast("binary")
    label = F.col(transport) if transport else F.lit(None).cast("string")
    sources = [("mark", mark(c)["encoding"], mark(c)["encoding"]), ("transport", label, canonical(label)), ("xml_signature", xml_signature(c), xml_signature(c)), ("xml", xml_declaration(c), canonical(xml_declaration(c))), ("html", html_declaration(c), canonical(html_declaration(c)))]
    # an 8-bit declaration can't hold in text whose units are wider
    declared = F.array_compact(F.array(*[F.when(raw.isNotNull(), F.struct(F.lit(n).alias("source"), raw.alias("label"), e.alias("encoding"))) for n, raw, e in sources]))
    known = F.filter(declared, lambda d: d["encoding"].isNotNull())
    auto = F.when(F.is_valid_utf8(c.cast("string")), "utf-8").otherwise(default)
    rows = df.withColumns({"declared": declared, "_k": known}).withColumn("encoding", F.coalesce(F.get("_k", F.lit(0))["encoding"], auto))
    rows = rows.withColumn("chosen_by", F.coalesce(F.get("_k", F.lit(0))["source"], F.lit("content"))).withColumn("conflict", F.size(F.array_distinct(F.transform("_k", lambda d: d["encoding"]))) > 1).drop("_k")
    body = F.when(c.isNotNull(), F.expr(f"substring(cast(`{content}` as binary), 1 + {_mark_length(content)})"))
    rows = rows.withColumn("_body", body)

    @F.pandas_udf("string")
    def other(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode(PYTHON.get(e, e), "replace").encode("utf-8", "replace").decode() for b, e in zip(bodies, encodings)], dtype=object)

    # UTF-8 stays in the JVM; other encodings, and only these rows, go through Python's tables
    foreign = other(F.when(F.col("encoding") != "utf-8", F.col("_body")), F.col("encoding"))
    text = F.when(F.col("encoding") == "utf-8", F.make_valid_utf8(F.col("_body").cast("string"))).otherwise(foreign)
    rows = rows.withColumn("text", text).drop("_body")
    return rows.withColumn("replaced", F.regexp_count("text", F.lit("�"))).withColumns({k: F.when(c.isNotNull(), F.col(k)) for k in ("encoding", "chosen_by", "conflict")})


#: Names of encodings in Python where they differ.
PYTHON = {"macintosh": "mac_roman"}


def _mark_length(content: str) -> str:
    """SQL for the bytes of the mark of a column."""
    head = f"hex(substring(cast(`{content}` as binary), 1, 4))"
    return "CASE " + " ".join(f"WHEN startswith({head}, '{h}') THEN {n}" for h, _, n in MARKS) + " ELSE 0 END"


def line_columns(df: DataFrame, text: str, offset: str) -> DataFrame:
    """Adds line and column (from 1, in characters) of a byte offset; lines end at LF alone. Offsets outside the text and
    null texts have null."""
    before = F.expr(f"cast(substring(cast(`{text}` as binary), 1, cast(`{offset}` as int)) as string)")
    inside = (F.col(offset) >= 0) & (F.col(offset) <= F.octet_length(text))
    last = F.substring_index(before, "\n", -1)
    return df.withColumns({"line": F.when(inside, F.regexp_count(before, F.lit("\n")) + 1), "column": F.when(inside, F.char_length(last) + 1)})
