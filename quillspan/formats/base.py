"""The rows all parsers return, and the operator that runs a parser on a table of inputs.

A parser is a function ``(data: bytes, options: dict) -> Tree``. It sees one input at a time, so inputs are spread over the
tasks and their rows never meet: no shuffle. Whatever a parser can't read it keeps as a ``diagnostic`` row; an input that
fails as a whole still has its ``document`` row, with status ``failed``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a parsed input: node (counted from 0 in order of appearance; 0 is the document), parent (null for the
#: document), kind, name, value, attrs, and the bytes of the input a node was read from, where they are known.
NODES = "node int, parent int, kind string, name string, value string, attrs map<string,string>, byte_start long, byte_end long"
ROWS_AT_ONCE = 20_000
#: Bytes of an input above which it is not parsed, and depth above which nesting is an error.
MAX_BYTES = 64 << 20
MAX_DEPTH = 256


class ParseError(ValueError):
    """The input can't be read as this format. at: the byte where reading stopped."""

    def __init__(self, message: str, at: int | None = None):
        super().__init__(message)
        self.at = at


class Tree:
    """The nodes of one input."""

    def __init__(self, format: str, /, **attrs: object):
        self.rows: list[tuple] = []
        self.partial = False
        self.root = self.add("document", None, format, **attrs)

    def add(self, kind: str, parent: int | None, name: str | None = None, value: object = None, start: int | None = None, end: int | None = None, /, **attrs: object) -> int:
        node = len(self.rows)
        kept = {k: _text(v) for k, v in attrs.items() if v is not None}
        self.rows.append((node, parent, kind, name, _text(value), kept, start, end))
        return node

    def warn(self, code: str, message: str, start: int | None = None, end: int | None = None, parent: int = 0) -> None:
        """Keeps what could not be read and marks the input as partial."""
        self.partial = True
        self.add("diagnostic", parent, code, message, start, end)

    def set(self, node: int, **attrs: object) -> None:
        self.rows[node][5].update({k: _text(v) for k, v in attrs.items() if v is not None})

    def done(self) -> list[tuple]:
        self.rows[0][5].setdefault("status", "partial" if self.partial else "complete")
        return self.rows


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return str(value)


class Offsets:
    """Character to byte offsets of a text."""

    def __init__(self, text: str):
        self.plain = text.isascii()
        self.at = [0]
        if not self.plain:
            n = 0
            for c in text:
                n += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
                self.at.append(n)

    def __call__(self, i: int) -> int:
        return i if self.plain else self.at[i]


Parser = Callable[[bytes, dict], Tree]


@functools.cache
def registry() -> dict[str, Parser]:
    """All parsers by format."""
    from quillspan.formats import archives, binary, bibliography, code, graphs, mail, media, model_output, office, prose, records, structured, subtitles, tabular, web

    found: dict[str, Parser] = {}
    for module in (tabular, structured, binary, web, prose, bibliography, mail, records, subtitles, office, archives, media, code, graphs, model_output):
        found.update(module.PARSERS)
    return found


def rows_of(format: str, data: bytes | None, options: dict) -> list[tuple]:
    """The rows of one input; never raises for bad input."""
    tree = Tree(format)
    if data is None:
        tree.set(0, status="missing")
        return tree.rows
    if len(data) > options.get("max_bytes", MAX_BYTES):
        tree.set(0, status="failed")
        tree.add("diagnostic", 0, "budget.input_bytes.exhausted", f"{len(data)} bytes")
        return tree.rows
    parser = registry().get(format)
    if parser is None:
        tree.set(0, status="unsupported")
        return tree.rows
    try:
        return parser(data, options).done()
    except ParseError as e:
        tree.add("diagnostic", 0, f"{format}.malformed", str(e), e.at)
    except RecursionError:
        tree.add("diagnostic", 0, "budget.depth.exhausted", "nested too deeply")
    except Exception as e:  # noqa: BLE001 - a damaged input must not end the job
        tree.add("diagnostic", 0, f"{format}.failed", f"{type(e).__name__}: {e}"[:500])
    tree.set(0, status="failed")
    return tree.rows


_ARROW = pa.schema([
    ("node", pa.int32()), ("parent", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("value", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("byte_start", pa.int64()), ("byte_end", pa.int64()),
])


def _clean(text: str | None) -> str | None:
    """Lone surrogates can't leave Python."""
    if text is not None and not text.isascii():
        return text.encode("utf-8", "replace").decode()
    return text


def _batch(keys: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in _ARROW]
    arrays = []
    for field, col in zip(_ARROW, cols):
        if field.name == "attrs":
            col = [[(k, _clean(v)) for k, v in x.items()] for x in col]
        elif field.type == pa.string():
            col = [_clean(x) for x in col]
        arrays.append(pa.array(col, field.type))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *arrays], ["k", *_ARROW.names])


def parse(df: DataFrame, key: str, content: str, format: str | Column, **options: object) -> DataFrame:
    """key and ``NODES`` of every row's content (text or binary), read as ``format`` (a name, or a column of names).

    A null content has a document row with status ``missing``, an unknown format one with ``unsupported``. Repeated rows
    are read each by itself; keys may be null. Inputs above the option ``max_bytes`` fail with a diagnostic.
    """
    name = F.lit(format) if isinstance(format, str) else format
    rows = df.select(F.col(key).alias("k"), name.alias("f"), F.col(content).cast("binary").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            for i, (f, c) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                found = rows_of(f or "", c.as_py(), options)
                out += found
                at += [i] * len(found)
                if len(out) >= ROWS_AT_ONCE:
                    yield _batch(batch.column(0), at, out)
                    at, out = [], []
            yield _batch(batch.column(0), at, out)

    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, {NODES}").withColumnRenamed("k", key)


def statuses(parsed: DataFrame, key: str) -> DataFrame:
    """key, format, status and nodes of each parsed input (for unique keys)."""
    root = F.when(F.col("node") == 0, F.struct("name", F.col("attrs")["status"].alias("status")))
    return parsed.groupBy(key).agg(F.max(root).alias("r"), F.count("*").alias("nodes")).select(key, F.col("r.name").alias("format"), "r.status", "nodes")
