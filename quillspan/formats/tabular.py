"""Delimited text: dialect, a scanner that loses nothing, and candidates for the type of a cell."""

from __future__ import annotations

import re

from quillspan.formats.base import Offsets, Tree

# Delimiters that are tried, in this order, and how many records are looked at.
DELIMITERS = {",": "comma", "\t": "tab", ";": "semicolon", "|": "pipe"}
SAMPLE_RECORDS = 32

_INTEGER = re.compile(r"-?(?:0|[1-9]\d*)\Z")
_DECIMAL = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?\Z")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}\Z")
_DATETIME = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}")


class Record:
    """One record: its cells (text, start, end, quoted), where it lies, how it ends and whether it is malformed."""

    __slots__ = ("cells", "start", "end", "terminator", "bad")

    def __init__(self, start: int):
        self.cells: list[tuple[str, int, int, bool]] = []
        self.start, self.end, self.terminator, self.bad = start, start, "", None


def scan(text: str, delimiter: str, quote: str = '"', escape: str | None = None):
    """Records of a text. A quoted cell may hold delimiters, line ends and doubled quotes. Offsets count characters."""
    at, n = 0, len(text)
    special = re.compile(f"[{re.escape(delimiter)}\r\n]")
    while at < n:
        record = Record(at)
        while True:
            start, quoted = at, at < n and text[at] == quote
            if quoted:
                at += 1
                parts = []
                while True:
                    close = text.find(quote, at)
                    back = text.find(escape, at) if escape else -1
                    if back != -1 and (close == -1 or back < close) and back + 1 < n:
                        parts.append(text[at:back] + text[back + 1])
                        at = back + 2
                        continue
                    if close == -1:
                        parts.append(text[at:])
                        at, record.bad = n, "unterminated quote"
                        break
                    parts.append(text[at:close])
                    at = close + 1
                    if at < n and text[at] == quote:
                        parts.append(quote)
                        at += 1
                        continue
                    break
                m = special.search(text, at)
                stop = m.start() if m else n
                if stop > at:
                    record.bad = record.bad or "text behind a closing quote"
                    parts.append(text[at:stop])
                at, value = stop, "".join(parts)
            else:
                m = special.search(text, at)
                at = m.start() if m else n
                value = text[start:at]
                if quote in value:
                    record.bad = record.bad or "quote in an unquoted cell"
            record.cells.append((value, start, at, quoted))
            if at < n and text[at] == delimiter:
                at += 1
                if at == n:
                    record.cells.append(("", n, n, False))
                    break
                continue
            break
        record.end = at
        if at < n:
            record.terminator = "\r\n" if text.startswith("\r\n", at) else text[at]
            at += len(record.terminator)
        yield record


def dialects(text: str, quote: str = '"') -> list[tuple[int, str, int]]:
    """(score, delimiter, modal width) of each delimiter, best first.

    The score is 1,000 times the share of records with the most frequent width, plus that width, minus 100 for each
    malformed record; it is 0 where that width is 1 or less. Of widths that are equally frequent the larger counts.
    """
    found = []
    for d in DELIMITERS:
        widths: dict[int, int] = {}
        bad = n = 0
        for record in scan(text, d, quote):
            if n == SAMPLE_RECORDS:
                break
            n += 1
            widths[len(record.cells)] = widths.get(len(record.cells), 0) + 1
            bad += record.bad is not None
        width, same = max(widths.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        found.append((0 if width <= 1 else same * 1000 // n + width - 100 * bad, d, width))
    return sorted(found, key=lambda x: (-x[0], x[1]))


def scalars(text: str) -> list[tuple[str, str, float]]:
    """Candidates (kind, normal form, confidence) for the type of a cell, best first; text is always one."""
    t = text.strip()
    low = t.lower()
    if low in ("", "null", "na", "n/a"):
        found = [("null", "", 0.95 if t else 1.0)]
    elif low in ("true", "false"):
        found = [("boolean", low, 0.99)]
    elif _INTEGER.match(t) and -(2**63) <= int(t) < 2**63:
        found = [("integer", t, 0.99)]
    elif _DECIMAL.match(t) and ("." in t or "e" in low):
        found = [("decimal", t, 0.97)]
    elif _DATE.match(t):
        found = [("date", t, 0.95)]
    elif _DATETIME.match(t):
        found = [("date-time", t, 0.95)]
    else:
        found = []
    return [*found, ("text", text, 1.0 if not found else 0.5)]


def parse_delimited(data: bytes, options: dict) -> Tree:
    """Records and cells. Options: delimiter (found if not given), quote, escape, header (True)."""
    text = data.decode("utf-8-sig", "replace")
    quote, escape, header = options.get("quote", '"'), options.get("escape"), options.get("header", True)
    ranked = dialects(text, quote)
    delimiter = options.get("delimiter") or ranked[0][1]
    tree = Tree("csv", delimiter=delimiter, detected=ranked[0][1], score=ranked[0][0])
    names: list[str] = []
    width, rows, ends = None, 0, {"\n": 0, "\r\n": 0, "\r": 0, "": 0}
    byte = Offsets(text)
    for i, record in enumerate(scan(text, delimiter, quote, escape)):
        ends[record.terminator] += 1
        if width is None:
            width = len(record.cells)
        ragged = len(record.cells) != width
        top = header and i == 0
        node = tree.add("header" if top else "record", 0, str(i), None, byte(record.start), byte(record.end), width=len(record.cells), malformed="ragged" if ragged else record.bad)
        if ragged or record.bad:
            tree.warn("csv.ragged" if ragged else "csv.malformed", record.bad or f"{len(record.cells)} cells where the first record has {width}", byte(record.start), byte(record.end), node)
        if top:
            names = [c[0] for c in record.cells]
        rows += not top
        for j, (value, start, end, quoted) in enumerate(record.cells):
            kind, normal, confidence = scalars(value)[0]
            tree.add("cell", node, names[j] if j < len(names) else str(j), value, byte(start), byte(end), column=j, type=kind, normal=normal, confidence=confidence, quoted=quoted)
    kinds = [k for k in ("\n", "\r\n", "\r") if ends[k]]
    tree.set(0, records=rows, width=width, lf=ends["\n"], crlf=ends["\r\n"], cr=ends["\r"], mixed=len(kinds) > 1, last_ended=not ends[""])
    return tree


def parse_tsv(data: bytes, options: dict) -> Tree:
    return parse_delimited(data, {"delimiter": "\t", **options})


PARSERS = {"csv": parse_delimited, "tsv": parse_tsv}
