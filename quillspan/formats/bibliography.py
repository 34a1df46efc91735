"""BibTeX and BibLaTeX entries; inheritance and lookups over many files are joins in ``operators.citations``."""

from __future__ import annotations

import re

from quillspan.formats.base import Offsets, ParseError, Tree

_ENTRY = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")
_FIELD = re.compile(r"\s*([^\s=,{}()\"#]+)\s*=\s*")
_NAME = re.compile(r"\s*([^\s,{}()\"#=]+)\s*")
# Month macros every style knows.
MONTHS = {m: str(i) for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def _balanced(text: str, at: int) -> int:
    """The place behind the brace group that begins at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "\\":
            continue
        if text[i] == "{" and text[i - 1] != "\\":
            depth += 1
        elif text[i] == "}" and text[i - 1] != "\\":
            depth -= 1
            if not depth:
                return i + 1
    raise ParseError("group does not end", at)


def _value(text: str, at: int, strings: dict[str, str], missing: list[str]) -> tuple[str, int]:
    """A value, its parts joined by #, and the place behind it."""
    parts = []
    while True:
        at = re.compile(r"\s*").match(text, at).end()
        c = text[at : at + 1]
        if c == "{":
            end = _balanced(text, at)
            parts.append(text[at + 1 : end - 1])
        elif c == '"':
            depth, end = 0, at + 1
            while end < len(text) and (text[end] != '"' or depth):
                depth += (text[end] == "{") - (text[end] == "}")
                end += 1
            if end >= len(text):
                raise ParseError("quote does not end", at)
            parts.append(text[at + 1 : end])
            end += 1
        elif m := _NAME.match(text, at):
            name, end = m[1], m.end()
            if name.isdigit():
                parts.append(name)
            elif name.lower() in strings or name.lower() in MONTHS:
                parts.append(strings.get(name.lower(), MONTHS.get(name.lower(), "")))
            else:
                missing.append(name)
                parts.append(name)
        else:
            raise ParseError("expected a value", at)
        m = re.compile(r"\s*#").match(text, end)
        if not m:
            return "".join(parts), end
        at = m.end()


def parse_bibliography(data: bytes, options: dict) -> Tree:
    """entry rows (name is the key) with field rows, strings expanded; preamble, string and comment rows; what is between
    entries is no data. A damaged entry is kept with a diagnostic and reading goes on at the next one."""
    text = data.decode("utf-8-sig", "replace")
    tree, byte = Tree("bibtex"), Offsets(text)
    strings: dict[str, str] = {}
    keys: dict[str, int] = {}
    at = 0
    while m := _ENTRY.search(text, at):
        kind, close = m[1].lower(), "}" if m[2] == "{" else ")"
        start = m.start()
        try:
            if kind == "comment":
                at = _balanced(text, m.end() - 1) if m[2] == "{" else m.end()
                tree.add("comment", 0, None, text[m.end() : at - 1], byte(start), byte(at))
                continue
            missing: list[str] = []
            if kind == "preamble":
                value, at = _value(text, m.end(), strings, missing)
                tree.add("preamble", 0, None, value, byte(start), byte(at))
                continue
            if kind == "string":
                f = _FIELD.match(text, m.end())
                if not f:
                    raise ParseError("expected a name", byte(m.end()))
                value, at = _value(text, f.end(), strings, missing)
                strings[f[1].lower()] = value
                tree.add("string", 0, f[1], value, byte(start), byte(at))
                continue
            k = re.compile(r"\s*([^\s,{}()]*)\s*(?=[,})])").match(text, m.end())
            if not k:
                raise ParseError("expected a key", byte(m.end()))
            node = tree.add("entry", 0, k[1], None, byte(start), None, type=kind, occurrence=keys.get(k[1], 0))
            keys[k[1]] = keys.get(k[1], 0) + 1
            at = k.end()
            while True:
                at = re.compile(r"[\s,]*").match(text, at).end()
                if text[at : at + 1] == close:
                    at += 1
                    break
                f = _FIELD.match(text, at)
                if not f:
                    raise ParseError("expected a field", byte(at))
                value, end = _value(text, f.end(), strings, missing)
                tree.add("field", node, f[1].lower(), re.sub(r"\s+", " ", value).strip(), byte(at), byte(end))
                at = end
            tree.rows[node] = (*tree.rows[node][:7], byte(at))
            for name in missing:
                tree.add("diagnostic", node, "bibtex.undefined_string", name)
        except ParseError as e:
            tree.warn("bibtex.malformed", str(e), byte(start))
            at = m.end()
    for key, n in keys.items():
        if n > 1:
            tree.add("duplicate_key", 0, key, n)
    return tree


PARSERS = {"bibtex": parse_bibliography, "biblatex": parse_bibliography}
