"""JSON Schema validation, the difference of two schemas, migrations and unknown enum values."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, object))


def _resolve(schema: object, root: dict) -> object:
    for _ in range(32):
        if not (isinstance(schema, dict) and isinstance(schema.get("$ref"), str) and schema["$ref"].startswith("#")):
            break
        target: object = root
        for token in schema["$ref"][1:].split("/")[1:]:
            target = target.get(token.replace("~1", "/").replace("~0", "~"), {}) if isinstance(target, dict) else {}
        schema = target
    return schema


def validate_value(value: object, schema: object, root: dict | None = None, at: str = "") -> list[tuple[str, str, str]]:
    """(pointer, rule, message) of everything in a value that a schema forbids: types, required and unknown members,
    items, enums, constants, lengths, ranges, patterns, combinations and local references."""
    root = schema if root is None and isinstance(schema, dict) else root or {}
    schema = _resolve(schema, root)
    if schema is True or schema == {} or not isinstance(schema, (dict, bool)):
        return []
    if schema is False:
        return [(at, "false", "nothing is allowed here")]
    out: list[tuple[str, str, str]] = []

    def bad(rule: str, message: str) -> None:
        out.append((at, rule, message))

    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        bad("type", f"expected {kinds if isinstance(kinds, str) else ' or '.join(kinds)}")
        return out
    if "enum" in schema and value not in schema["enum"]:
        bad("enum", "value is not listed")
    if "const" in schema and value != schema["const"]:
        bad("const", "value is another")
    if isinstance(value, dict):
        for k in schema.get("required", []):
            if k not in value:
                bad("required", f"{k} is missing")
        known = schema.get("properties", {})
        patterns = schema.get("patternProperties", {})
        for k, v in value.items():
            here = f"{at}/{k.replace('~', '~0').replace('/', '~1')}"
            if k in known:
                out += validate_value(v, known[k], root, here)
            matched = [s for p, s in patterns.items() if re.search(p, k)]
            for s in matched:
                out += validate_value(v, s, root, here)
            if k not in known and not matched and "additionalProperties" in schema:
                if schema["additionalProperties"] is False:
                    out.append((here, "additionalProperties", f"{k} is not known"))
                else:
                    out += validate_value(v, schema["additionalProperties"], root, here)
        for rule, least in (("minProperties", True), ("maxProperties", False)):
            if rule in schema and (len(value) < schema[rule] if least else len(value) > schema[rule]):
                bad(rule, f"{len(value)} members")
    elif isinstance(value, list):
        first = schema.get("prefixItems", [])
        for i, v in enumerate(value):
            rule = first[i] if i < len(first) else schema.get("items", True)
            out += validate_value(v, rule, root, f"{at}/{i}")
        if len(value) < schema.get("minItems", 0):
            bad("minItems", f"{len(value)} items")
        if "maxItems" in schema and len(value) > schema["maxItems"]:
            bad("maxItems", f"{len(value)} items")
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            bad("uniqueItems", "items repeat")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            bad("minLength", f"{len(value)} characters")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            bad("maxLength", f"{len(value)} characters")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            bad("pattern", "text has another form")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        for rule, fails in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b), ("multipleOf", lambda a, b: a % b != 0)):
            if rule in schema and not isinstance(schema[rule], bool) and fails(value, schema[rule]):
                bad(rule, str(value))
    for s in schema.get("allOf", []):
        out += validate_value(value, s, root, at)
    for rule, wanted in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if rule in schema and not wanted(sum(not validate_value(value, s, root, at) for s in schema[rule])):
            bad(rule, "no alternative fits" if rule == "anyOf" else "not exactly one alternative fits")
    if "not" in schema and not validate_value(value, schema["not"], root, at):
        bad("not", "value is excluded")
    if "if" in schema:
        branch = "then" if not validate_value(value, schema["if"], root, at) else "else"
        out += validate_value(value, schema.get(branch, True), root, at)
    return out


def validate(df: DataFrame, key: str, value: str, schema: dict) -> DataFrame:
    """key, pointer, rule and message of each violation of rows of JSON text; text that is no JSON violates ``json``.
    Null values violate nothing."""

    @F.pandas_udf("array<struct<pointer:string,rule:string,message:string>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                found = [] if t is None else validate_value(json.loads(t), schema)
            except ValueError as e:
                found = [("", "json", str(e))]
            out.append([{"pointer": a, "rule": b, "message": c} for a, b, c in found])
        return pd.Series(out)

    return df.select(F.col(key), F.explode(run(F.col(value))).alias("v")).select(key, "v.*")


def differences(previous: dict, current: dict, enums_open: bool = False) -> list[tuple[str, str, bool]]:
    """(pointer, change, whether it breaks readers) from one schema to the next: types, properties, required members,
    enum values and bounds. enums_open: readers accept values they do not know."""
    out: list[tuple[str, str, bool]] = []

    def compare(a: object, b: object, at: str, depth: int) -> None:
        a, b = _resolve(a, previous), _resolve(b, current)
        if depth > 64 or not isinstance(a, dict) or not isinstance(b, dict):
            if a != b:
                out.append((at, "schema_changed", True))
            return
        kinds = [set(x if isinstance(x, list) else [x]) if x is not None else None for x in (a.get("type"), b.get("type"))]
        if kinds[0] != kinds[1]:
            wider = kinds[1] is None or kinds[0] is not None and kinds[0] < kinds[1]
            out.append((at, "type_widened" if wider else "type_changed", not wider))
        p, q = a.get("properties", {}), b.get("properties", {})
        r, s = set(a.get("required", [])), set(b.get("required", []))
        for k in sorted(p.keys() - q.keys()):
            out.append((f"{at}/properties/{k}", "property_removed", True))
        for k in sorted(q.keys() - p.keys()):
            out.append((f"{at}/properties/{k}", "required_property_added" if k in s else "property_added", k in s))
        for k in sorted((s - r) & p.keys()):
            out.append((f"{at}/properties/{k}", "newly_required", True))
        for k in sorted((r - s) & q.keys()):
            out.append((f"{at}/properties/{k}", "no_longer_required", False))
        for k in sorted(p.keys() & q.keys()):
            compare(p[k], q[k], f"{at}/properties/{k}", depth + 1)
        if "enum" in a or "enum" in b:
            x, y = ([json.dumps(v) for v in z.get("enum", [])] for z in (a, b))
            if "enum" not in a or "enum" not in b:
                out.append((at, "enum_added" if "enum" in b else "enum_removed", "enum" in b))
            else:
                out.extend((at, f"enum_value_removed:{v}", True) for v in x if v not in y)
                out.extend((at, f"enum_value_added:{v}", not enums_open) for v in y if v not in x)
        if a.get("additionalProperties", True) is not False and b.get("additionalProperties", True) is False:
            out.append((at, "closed", True))
        if "items" in a and "items" in b:
            compare(a["items"], b["items"], f"{at}/items", depth + 1)
        for rule, tighter in (("minimum", 1), ("minLength", 1), ("minItems", 1), ("maximum", -1), ("maxLength", -1), ("maxItems", -1)):
            if a.get(rule) != b.get(rule):
                breaks = rule in b and (rule not in a or (b[rule] - a[rule]) * tighter > 0)
                out.append((at, f"{rule}_{'tightened' if breaks else 'relaxed'}", breaks))

    compare(previous, current, "", 0)
    return out


def unknown_enum_values(value: object, schema: dict) -> list[tuple[str, str]]:
    """(pointer, value) of strings that an enum of the schema does not list; a reader may keep them."""
    return [(at, json.dumps(_at(value, at))) for at, rule, _ in validate_value(value, schema) if rule == "enum"]


def _at(value: object, pointer: str) -> object:
    for token in pointer.split("/")[1:]:
        token = token.replace("~1", "/").replace("~0", "~")
        value = value[int(token)] if isinstance(value, list) else value[token]
    return value


class Migrations:
    """Registered steps from version to version of a family of values; a value takes the shortest route."""

    def __init__(self) -> None:
        self.steps: dict[str, dict[str, dict[str, Callable]]] = {}

    def register(self, family: str, old: str, new: str, step: Callable) -> None:
        if old == new or new in self.steps.get(family, {}).get(old, {}):
            raise ValueError(f"step {old} to {new} of {family} is there already or goes nowhere")
        self.steps.setdefault(family, {}).setdefault(old, {})[new] = step

    def route(self, family: str, old: str, new: str) -> list[str]:
        """The versions on the shortest route; of equally short ones the first in order of versions."""
        todo, came = deque([old]), {old: None}
        while todo:
            v = todo.popleft()
            if v == new:
                path = [v]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                return path[::-1]
            for w in sorted(self.steps.get(family, {}).get(v, {})):
                if w not in came:
                    came[w] = v
                    todo.append(w)
        raise LookupError(f"no route from {old} to {new} of {family}")

    def migrate(self, family: str, old: str, new: str, value: object) -> object:
        """The value after all steps: JSON values and DataFrames alike."""
        path = self.route(family, old, new)
        for a, b in zip(path, path[1:]):
            value = self.steps[family][a][b](value)
        return value


#: Schemas of what is written here, by name.
CATALOGUE = {
    "node": {"type": "object", "required": ["node", "kind", "attrs"], "properties": {"node": {"type": "integer", "minimum": 0}, "parent": {"type": ["integer", "null"]}, "kind": {"type": "string"}, "name": {"type": ["string", "null"]}, "value": {"type": ["string", "null"]}, "attrs": {"type": "object", "additionalProperties": {"type": "string"}}, "byte_start": {"type": ["integer", "null"]}, "byte_end": {"type": ["integer", "null"]}}},
    "envelope": {"type": "object", "required": ["request_id", "status"], "properties": {"request_id": {"type": "string"}, "format": {"type": ["string", "null"]}, "status": {"enum": ["complete", "partial", "failed", "missing", "unsupported", "unknown", "ambiguous"]}, "bytes": {"type": ["integer", "null"], "minimum": 0}, "sha256": {"type": ["string", "null"], "pattern": "^sha256:[0-9a-f]{64}$"}}},
    "segment": {"type": "object", "required": ["segment", "text", "segment_id"], "properties": {"segment": {"type": "integer", "minimum": 0}, "text": {"type": "string"}, "segment_id": {"type": "string"}, "nodes": {"type": "array", "items": {"type": "string"}}}},
}
EXAMPLES = {
    "node": {"node": 0, "parent": None, "kind": "document", "name": "text", "value": None, "attrs": {"status": "complete"}, "byte_start": None, "byte_end": None}, "envelope": {"request_id": "a", "format": "text", "status": "complete", "bytes": 1, "sha256": "sha256:" + "0" * 64},
    "segment": {"segment": 0, "text": "a", "segment_id": "segment:0", "nodes": ["n"]},
}


def validate_named(name: str, value: object) -> list[tuple[str, str, str]]:
    """What a schema of the catalogue forbids in a value; raises KeyError for an unknown name."""
    return validate_value(value, CATALOGUE[name])


def renamed(df: DataFrame, aliases: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """The table with columns under their own names: the first of a name and its aliases that is not null, then the default."""
    by: dict[str, list[str]] = {}
    for alias, name in aliases.items():
        by.setdefault(name, [name]).append(alias)
    for name, names in by.items():
        have = [F.col(c) for c in names if c in df.columns]
        if have:
            df = df.withColumn(name, F.coalesce(*have))
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df.drop(*[a for a in aliases if a not in by])
