"""Scalar functions that need Python, on Arrow batches: canonical JSON, transfer encodings, entities, dates, repair."""

from __future__ import annotations

import html
import json
import re
from email.utils import parsedate_to_datetime
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.formats.mail import decoded_header, transfer_decoded
from quillspan.formats.model_output import balanced_spans, repair, without_thoughts
from quillspan.formats.structured import canonical
from quillspan.formats.subtitles import ttml_time


def _each(returns: str, function):
    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values], dtype=object)

    return run


def _canonical(text: str) -> str | None:
    try:
        return canonical(json.loads(text))
    except ValueError:
        return None


def canonical_json(text: Column) -> Column:
    """JSON text without white space, keys in order; null for what is no JSON."""
    return _each("string", _canonical)(text)


def json_digest(text: Column) -> Column:
    """``sha256:`` and the digest of the canonical form."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text), 256))


def entities_decoded(text: Column) -> Column:
    """Named and numeric character references as characters."""
    return _each("string", html.unescape)(text)


def header_decoded(text: Column) -> Column:
    """A mail header with its encoded words decoded."""
    return _each("string", decoded_header)(text)


def transfer(content: Column, encoding: Column) -> Column:
    """body (binary) and issue behind a transfer encoding (base64, quoted-printable or none)."""

    @F.pandas_udf("body binary, issue string")
    def run(contents: pd.Series, encodings: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if c is None else transfer_decoded(bytes(c), e or "") for c, e in zip(contents, encodings)]
        return pd.DataFrame(rows, columns=["body", "issue"])

    return run(content.cast("binary"), encoding)


def _date(text: str) -> str | None:
    try:
        return parsedate_to_datetime(text).isoformat()
    except (ValueError, TypeError):
        return None


def mail_date(text: Column) -> Column:
    """A mail date in ISO form with its offset; null for what is none."""
    return _each("string", _date)(text)


def ttml_ms(text: Column, frame_rate: str = "30", tick_rate: str = "1") -> Column:
    """Milliseconds of a TTML time at rational frame and tick rates; null for what is none."""
    return _each("long", lambda t: ttml_time(t, Fraction(frame_rate), Fraction(tick_rate)))(text)


def repaired_json(text: Column) -> Column:
    """json, repairs and ok of damaged JSON. Text that Spark parses as it stands is not repaired and costs no Python."""
    good = F.try_parse_json(text).isNotNull()

    @F.pandas_udf("json string, repairs array<string>, ok boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if t is None else repair(t) for t in texts], columns=["json", "repairs", "ok"])

    fixed = run(F.when(~good, text))
    return F.when(good, F.struct(text.alias("json"), F.array().cast("array<string>").alias("repairs"), F.lit(True).alias("ok"))).when(text.isNotNull(), fixed)


def json_spans(text: Column) -> Column:
    """start and end (characters) of the outermost bracketed stretches of a text."""
    return _each("array<struct<start:int,end:int>>", lambda t: [{"start": a, "end": b} for a, b in balanced_spans(t)])(text)


def thoughts_masked(text: Column) -> Column:
    """Thoughts as spaces of as many bytes, line ends kept."""
    return _each("string", without_thoughts)(text)


def words(pattern: str = r"\S+"):
    """A token counter of words by pattern, as a segment tokenizer."""
    rule = re.compile(pattern)
    return lambda text: sum(1 for _ in rule.finditer(text))


def formula_references(formula: Column) -> Column:
    """The cells and ranges a spreadsheet formula names, each once, in order."""
    from quillspan.formats.office import formula_references as references

    return _each("array<string>", references)(formula)
