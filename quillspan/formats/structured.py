"""Structured values: JSON with its duplicate keys and long numbers, JSON lines, YAML, TOML and XML as a value.

Every value is a node named by its key or index, with its pointer, type and, for scalars, its text as written.
"""

from __future__ import annotations

import datetime
import json
import re

from quillspan.formats.base import MAX_DEPTH, Offsets, ParseError, Tree

_WS = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?P<frac>\.\d+)?(?P<exp>[eE][+-]?\d+)?")


def escape(key: str) -> str:
    """A key as a token of a pointer."""
    return key.replace("~", "~0").replace("/", "~1")


class _Json:
    """A recursive reader of one value that keeps every member and the spelling of every number."""

    def __init__(self, text: str, tree: Tree, offsets: Offsets, policy: str):
        self.text, self.tree, self.byte, self.policy = text, tree, offsets, policy

    def space(self, at: int) -> int:
        return _WS.match(self.text, at).end()

    def fail(self, message: str, at: int) -> ParseError:
        return ParseError(message, self.byte(min(at, len(self.text))))

    def value(self, at: int, parent: int, name: str | None, pointer: str, depth: int, **attrs: object) -> int:
        """Adds the value at ``at`` and returns where it ends."""
        text, tree = self.text, self.tree
        if depth > MAX_DEPTH:
            raise ParseError("nested too deeply", self.byte(at))
        c = text[at : at + 1]
        if c == "{" or c == "[":
            kind, close = ("object", "}") if c == "{" else ("array", "]")
            node = tree.add(kind, parent, name, None, self.byte(at), None, pointer=pointer, **attrs)
            start, at, n, seen = at, self.space(at + 1), 0, {}
            while text[at : at + 1] != close:
                more = {}
                if n:
                    if text[at : at + 1] != ",":
                        raise self.fail(f"expected a comma or {close}", at)
                    at = self.space(at + 1)
                if kind == "object":
                    m = _STRING.match(text, at)
                    if not m:
                        raise self.fail("expected a key", at)
                    key = json.loads(m[0])
                    seen[key] = seen.get(key, 0) + 1
                    if seen[key] > 1:
                        more["duplicate"] = seen[key] - 1
                        if self.policy == "reject":
                            raise self.fail(f"duplicate key {key}", at)
                    at = self.space(m.end())
                    if text[at : at + 1] != ":":
                        raise self.fail("expected a colon", at)
                    at = self.space(at + 1)
                else:
                    key = str(n)
                at = self.space(self.value(at, node, key, f"{pointer}/{escape(key)}", depth + 1, **more))
                n += 1
            tree.rows[node] = (*tree.rows[node][:7], self.byte(at + 1))
            tree.set(node, size=n)
            repeated = [k for k, times in seen.items() if times > 1]
            if repeated:
                tree.add("diagnostic", node, "json.duplicate_key", ", ".join(repeated), self.byte(start))
            return at + 1
        if c == '"':
            m = _STRING.match(text, at)
            if not m:
                raise self.fail("bad string", at)
            tree.add("string", parent, name, json.loads(m[0]), self.byte(at), self.byte(m.end()), pointer=pointer, **attrs)
            return m.end()
        for word, kind in (("true", "boolean"), ("false", "boolean"), ("null", "null")):
            if text.startswith(word, at):
                tree.add(kind, parent, name, None if kind == "null" else word, self.byte(at), self.byte(at + len(word)), pointer=pointer, **attrs)
                return at + len(word)
        m = _NUMBER.match(text, at)
        if not m:
            raise self.fail("expected a value", at)
        kind = "decimal" if m["frac"] or m["exp"] else "integer"
        tree.add(kind, parent, name, m[0], self.byte(at), self.byte(m.end()), pointer=pointer, big=kind == "integer" and not -(2**63) <= int(m[0]) < 2**64 or None, **attrs)
        return m.end()


def parse_json(data: bytes, options: dict) -> Tree:
    """Option duplicates: keep (all members, marked), or reject."""
    text = data.decode("utf-8-sig")
    tree = Tree("json")
    reader = _Json(text, tree, Offsets(text), options.get("duplicates", "keep"))
    end = reader.space(reader.value(reader.space(0), 0, None, "", 0))
    if end < len(text):
        raise ParseError("text behind the value", reader.byte(end))
    return tree


def parse_jsonl(data: bytes, options: dict) -> Tree:
    """Every line is a record; blank lines are skipped, bad ones kept with a diagnostic."""
    tree = Tree("jsonl")
    at = n = 0
    for line in data.split(b"\n"):
        if line.strip():
            text = line.decode("utf-8", "replace").rstrip("\r")
            node, mark = tree.add("record", 0, str(n), None, at, at + len(line)), len(tree.rows)
            try:
                reader = _Json(text, tree, Offsets(text), options.get("duplicates", "keep"))
                end = reader.space(reader.value(reader.space(0), node, None, "", 0))
                if end < len(text):
                    raise ParseError("text behind the value", reader.byte(end))
            except ParseError as e:
                del tree.rows[mark:]
                tree.rows[node] = (*tree.rows[node][:4], text, *tree.rows[node][5:])
                tree.set(node, malformed=True)
                tree.warn("jsonl.malformed", str(e), at + (e.at or 0), at + len(line), node)
            n += 1
        at += len(line) + 1
    tree.set(0, records=n)
    return tree


def parse_yaml(data: bytes, options: dict) -> Tree:
    """All documents; anchors and aliases are named, not expanded, and tags are kept."""
    import yaml

    tree = Tree("yaml")
    ids: dict[int, int] = {}
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    text = data.decode("utf-8-sig")
    byte = Offsets(text)
    names = {"tag:yaml.org,2002:int": "integer", "tag:yaml.org,2002:float": "decimal", "tag:yaml.org,2002:bool": "boolean", "tag:yaml.org,2002:null": "null", "tag:yaml.org,2002:timestamp": "date-time", "tag:yaml.org,2002:str": "string"}

    def add(node, parent: int, name: str | None, pointer: str, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise ParseError("nested too deeply", byte(node.start_mark.index))
        span = (byte(node.start_mark.index), byte(node.end_mark.index))
        if id(node) in ids:
            tree.add("alias", parent, name, str(ids[id(node)]), *span, pointer=pointer, target=ids[id(node)])
            return
        tag = None if node.tag.startswith("tag:yaml.org,2002:") else node.tag
        if isinstance(node, yaml.ScalarNode):
            kind = names.get(node.tag, "string")
            ids[id(node)] = tree.add(kind, parent, name, None if kind == "null" else node.value, *span, pointer=pointer, tag=tag, style=node.style)
            return
        mapping = isinstance(node, yaml.MappingNode)
        here = ids[id(node)] = tree.add("object" if mapping else "array", parent, name, None, *span, pointer=pointer, tag=tag, size=len(node.value))
        seen: dict[str, int] = {}
        for i, child in enumerate(node.value):
            key = child[0].value if mapping and isinstance(child[0], yaml.ScalarNode) else f"?{i}" if mapping else str(i)
            seen[key] = seen.get(key, 0) + 1
            add(child[1] if mapping else child, here, key, f"{pointer}/{escape(key)}", depth + 1)
        if repeated := [k for k, n in seen.items() if n > 1]:
            tree.add("diagnostic", here, "yaml.duplicate_key", ", ".join(repeated))

    try:
        for i, node in enumerate(yaml.compose_all(text, loader)):
            if node is not None:
                add(node, 0, str(i), "", 0)
            tree.set(0, documents=i + 1)
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        tree.warn("yaml.malformed", str(getattr(e, "problem", None) or e), byte(mark.index) if mark else None)
    return tree


def _native(tree: Tree, value: object, parent: int, name: str | None, pointer: str, depth: int = 0) -> None:
    """Adds a Python value."""
    if depth > MAX_DEPTH:
        raise ParseError("nested too deeply")
    if isinstance(value, dict):
        node = tree.add("object", parent, name, pointer=pointer, size=len(value))
        for k, v in value.items():
            _native(tree, v, node, str(k), f"{pointer}/{escape(str(k))}", depth + 1)
    elif isinstance(value, (list, tuple)):
        node = tree.add("array", parent, name, pointer=pointer, size=len(value))
        for i, v in enumerate(value):
            _native(tree, v, node, str(i), f"{pointer}/{i}", depth + 1)
    else:
        kind, text = scalar(value)
        tree.add(kind, parent, name, text, pointer=pointer)


def scalar(value: object) -> tuple[str, str | None]:
    """Kind and text of a scalar."""
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    if isinstance(value, int):
        return "integer", str(value)
    if isinstance(value, float):
        return "decimal", repr(value)
    if isinstance(value, bytes):
        return "bytes", value.hex()
    if isinstance(value, datetime.datetime):
        return "date-time", value.isoformat()
    if isinstance(value, (datetime.date, datetime.time)):
        return "date" if isinstance(value, datetime.date) else "time", value.isoformat()
    return "string", str(value)


def parse_toml(data: bytes, options: dict) -> Tree:
    import tomllib

    tree = Tree("toml")
    try:
        _native(tree, tomllib.loads(data.decode("utf-8-sig").replace("\r\n", "\n")), 0, None, "")
    except tomllib.TOMLDecodeError as e:
        raise ParseError(str(e)) from e
    return tree


def canonical(value: object) -> str:
    """JSON without white space, keys in order of their UTF-8 bytes, arrays as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


PARSERS = {"json": parse_json, "jsonl": parse_jsonl, "yaml": parse_yaml, "toml": parse_toml}
