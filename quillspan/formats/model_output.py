"""Answers of language models: candidate values and calls in their text, repair of damaged JSON, choice of a candidate."""

from __future__ import annotations

import json
import re

from quillspan.formats.base import Tree
from quillspan.formats.structured import canonical

# Grammars of candidates and their priority.
PRIORITY = {
    "raw_json": 100, "fenced_json": 95, "json_object_in_text": 90, "open_ai_chat_content": 85, "open_ai_tool_call": 80, "mcp_json_rpc": 80, "fenced_code": 60, "yaml_block": 55, "toml_block": 55, "xml_tool_call": 45, "python_style_command": 20,
}
#: Repairs of one text, and bytes they may change, at most.
MAX_REPAIRS = 32
MAX_CHANGED = 64 << 10

_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S)
_FENCE = re.compile(r"^([ \t]*)(`{3,}|~{3,})[ \t]*([\w+-]*)[^\n]*\n(.*?)(?:^[ \t]*\2[ \t]*$|\Z)", re.S | re.M)
_XML_CALL = re.compile(r"<(?P<tag>tool_call|function_call|invoke|tool)(?P<attrs>\s[^<>]*)?>(?P<body>.*?)</(?P=tag)>", re.S)
_PYTHON = re.compile(r"^[ \t]*(?P<name>[A-Za-z_][\w.]*)\((?P<args>[^()\n]*)\)[ \t]*;?[ \t]*$", re.M)
_LITERALS = {"True": "true", "False": "false", "None": "null"}


def without_thoughts(text: str) -> str:
    """Thoughts as spaces of as many bytes, line ends kept, so that places in the text stay; an open one runs to the end."""
    return _THINK.sub(lambda m: "".join(c if c in "\r\n" else " " * len(c.encode()) for c in m[0]), text)


def balanced_spans(text: str) -> list[tuple[int, int]]:
    """The outermost bracketed stretches, brackets in strings aside. A stretch that never closes is none, and the search
    goes on behind its bracket."""
    found, at = [], 0
    opener = re.compile(r"[\[{]")
    while m := opener.search(text, at):
        stack, quoted, i = [], False, m.start()
        while i < len(text):
            c = text[i]
            if quoted:
                if c == "\\":
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "[{":
                stack.append(c)
            elif c in "]}":
                if "[{"["]}".index(c)] != stack.pop():
                    stack = None
                    break
                if not stack:
                    break
            i += 1
        if stack is not None and not stack and i < len(text):
            found.append((m.start(), i + 1))
            at = i + 1
        else:
            at = m.end()
    return found


def _parts(text: str) -> list[tuple[str, bool]]:
    """The text as stretches outside and inside of double-quoted strings."""
    out, at = [], 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"?', text, re.S):
        out += [(text[at : m.start()], False), (m[0], True)]
        at = m.end()
    return [*out, (text[at:], False)]


def _outside(text: str, change) -> str:
    return "".join(s if quoted else change(s) for s, quoted in _parts(text))


def _premature(text: str) -> str:
    """A brace that closes everything although members follow it."""
    for m in reversed(list(re.finditer(r"\}(?=\s*,\s*\"[^\"]*\"\s*:)", text))):
        bare = _outside(text[: m.end()], lambda s: s)
        level = sum(s.count("{") - s.count("}") for s, q in _parts(bare) if not q)
        if level == 0:
            return text[: m.start()] + text[m.end() :]
    return text


def _openers(text: str) -> str:
    return _outside(text, lambda s: re.sub(r"\{\s*\{", "{", s)) if re.match(r"\s*\{\s*\{", text) else text


def _single_quotes(text: str) -> str:
    return _outside(text, lambda s: re.sub(r"(?<=[\[{,:\s])'((?:[^'\\\n]|\\.)*)'(?=\s*[,:\]}]|\s*\Z)", lambda m: json.dumps(m[1].replace("\\'", "'"), ensure_ascii=False), " " + s)[1:])


def _bare_keys(text: str) -> str:
    return _outside(text, lambda s: re.sub(r"([{,]\s*|^\s*)([A-Za-z_$][\w$-]*)(\s*:)", r'\1"\2"\3', s) if re.search(r"[{,]\s*[A-Za-z_$]", s) else s)


def _backslashes(text: str) -> str:
    return "".join(re.sub(r'\\(?!["\\/bfnrtu])|\\u(?![0-9a-fA-F]{4})', lambda m: "\\" + m[0], s) if quoted else s for s, quoted in _parts(text))


def _inner_quotes(text: str) -> str:
    """A quote that neither opens nor closes a string, by what stands beside it."""
    out, inside = [], False
    for i, c in enumerate(text):
        if c == '"' and (i == 0 or text[i - 1] != "\\"):
            if not inside:
                inside = True
            elif re.match(r"\s*(?:[,:\]}]|\Z)", text[i + 1 :]) or not text[i + 1 :].strip():
                inside = False
            else:
                out.append("\\")
        out.append(c)
    return "".join(out)


def _missing_commas(text: str) -> str:
    return re.sub(r'(["\]}]|\b(?:true|false|null)\b|\d)(\s*\n\s*|\s+)(?="[^"\n]*"\s*:)', r"\1,\2", text)


def _trailing_commas(text: str) -> str:
    return _outside(text, lambda s: re.sub(r",(\s*[\]}])", r"\1", s))


def _close(text: str) -> str:
    stack: list[str] = []
    parts = _parts(text)
    for s, quoted in parts:
        if not quoted:
            for c in s:
                if c in "[{":
                    stack.append("]" if c == "[" else "}")
                elif c in "]}" and stack and stack[-1] == c:
                    stack.pop()
    last = next((s for s, q in reversed(parts) if q), "")
    cut = text.rstrip()
    if parts[-1] == ("", False) and last and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', last, re.S):
        cut += '"'
    cut = re.sub(r",\s*\Z", "", cut)
    if re.search(r":\s*\Z", cut):
        cut += " null"
    return cut + "".join(reversed(stack))


STAGES = (
    ("remove_premature_closing_brace", _premature), ("replace_python_literal", lambda t: _outside(t, lambda s: re.sub(r"\b(True|False|None)\b", lambda m: _LITERALS[m[1]], s))), ("remove_redundant_object_opener", _openers), ("quote_single_quoted_string", _single_quotes),
    ("quote_unquoted_object_key", _bare_keys), ("preserve_backslash_command", _backslashes), ("escape_unescaped_string_quote", _inner_quotes), ("insert_missing_comma", _missing_commas), ("remove_trailing_comma", _trailing_commas), ("close_unterminated_container", _close),
)


def load(text: str) -> object:
    """Strict JSON; raises ValueError."""
    return json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))


def repair(text: str) -> tuple[str, list[str], bool]:
    """(text, repairs made, whether it is JSON now). Repairs are tried in order until the text parses; none that would go
    beyond the bounds is made."""
    text, done, changed = text.strip(), [], 0
    for name, stage in STAGES:
        try:
            load(text)
            return text, done, True
        except (ValueError, RecursionError):
            pass
        new = stage(text)
        if new != text:
            changed += abs(len(new.encode()) - len(text.encode())) or sum(a != b for a, b in zip(new, text))
            if len(done) >= MAX_REPAIRS or changed > MAX_CHANGED:
                return text, done, False
            text = new
            done.append(name)
    try:
        load(text)
        return text, done, True
    except (ValueError, RecursionError):
        return text, done, False


class Candidate:
    __slots__ = ("grammar", "start", "end", "text", "value", "ok", "repairs", "command", "argument")

    def __init__(self, grammar: str, start: int, end: int, text: str, value: object = None, ok: bool = False, repairs: list[str] | None = None, command: str | None = None, argument: str | None = None):
        self.grammar, self.start, self.end, self.text, self.value, self.ok, self.repairs, self.command, self.argument = grammar, start, end, text, value, ok, repairs or [], command, argument

    @property
    def status(self) -> str:
        return "incomplete" if not self.ok else "recovered" if self.repairs else "complete"


def _json(grammar: str, start: int, text: str) -> Candidate:
    lead = len(text) - len(text.lstrip())
    fixed, repairs, ok = repair(text)
    return Candidate(grammar, start + lead, start + len(text.rstrip()), text.strip(), load(fixed) if ok else None, ok, repairs)


def _calls(found: Candidate) -> list[Candidate]:
    """Calls inside a JSON value: chat answers, tool calls and JSON-RPC requests."""
    out, value = [], found.value

    def call(grammar: str, name: object, arguments: object) -> None:
        repairs = list(found.repairs)
        if isinstance(arguments, str):
            fixed, more, ok = repair(arguments)
            arguments = load(fixed) if ok else arguments
            repairs += more
        out.append(Candidate(grammar, found.start, found.end, found.text, arguments, True, repairs, name if isinstance(name, str) else None))

    if isinstance(value, dict):
        for choice in value.get("choices") or [] if isinstance(value.get("choices"), list) else []:
            message = choice.get("message") if isinstance(choice, dict) else None
            if isinstance(message, dict):
                if isinstance(message.get("content"), str):
                    out.append(Candidate("open_ai_chat_content", found.start, found.end, message["content"], message["content"], True))
                value = {**value, "tool_calls": message.get("tool_calls") or value.get("tool_calls")}
        for tool in value.get("tool_calls") or [] if isinstance(value.get("tool_calls"), list) else []:
            function = tool.get("function", tool) if isinstance(tool, dict) else {}
            if isinstance(function, dict) and "name" in function:
                call("open_ai_tool_call", function["name"], function.get("arguments"))
        if value.get("jsonrpc") == "2.0" and isinstance(value.get("method"), str):
            params = value.get("params") or {}
            call("mcp_json_rpc", params.get("name", value["method"]) if isinstance(params, dict) else value["method"], params.get("arguments", params) if isinstance(params, dict) else params)
    return out


def candidates(text: str) -> list[Candidate]:
    """All candidates in order of their place, then of their priority. Places are characters of the text."""
    bare = re.sub(_THINK, lambda m: re.sub(r"[^\r\n]", " ", m[0]), text)
    found: list[Candidate] = []
    whole = bare.strip()
    raw = whole[:1] in ("{", "[")
    if raw:
        at = bare.index(whole[0])
        one = _json("raw_json", at, bare[at:].rstrip())
        raw = one.ok or not balanced_spans(whole)
        if raw:
            found.append(one)
    fenced = []
    for m in _FENCE.finditer(bare) if not raw else ():
        fenced.append(m.span())
        lang, body, at = m[3].lower(), m[4], m.start(4)
        if lang in ("json", "json5", "jsonc") or not lang and body.lstrip()[:1] in ("{", "["):
            found.append(_json("fenced_json", at, body))
        elif lang in ("yaml", "yml"):
            try:
                import yaml

                value, ok = yaml.safe_load(body), True
            except Exception:  # noqa: BLE001 - any failure leaves an incomplete candidate
                value, ok = None, False
            found.append(Candidate("yaml_block", at, at + len(body), body, value, ok and isinstance(value, (dict, list))))
        elif lang == "toml":
            import tomllib

            try:
                found.append(Candidate("toml_block", at, at + len(body), body, tomllib.loads(body), True))
            except tomllib.TOMLDecodeError:
                found.append(Candidate("toml_block", at, at + len(body), body))
        else:
            found.append(Candidate("fenced_code", at, at + len(body), body, body, True, command=lang or None))
    masked = list(bare)
    for a, b in fenced:
        masked[a:b] = " " * (b - a)
    rest = "".join(masked)
    for m in _XML_CALL.finditer(rest) if not raw else ():
        name = re.search(r"name\s*=\s*[\"']([^\"']+)", m["attrs"] or "") or re.search(r"<name>([^<]+)</name>", m["body"])
        params = dict(re.findall(r"<parameter\s+name=[\"']([^\"']+)[\"']>(.*?)</parameter>", m["body"], re.S))
        value, ok = (params, True) if params else (None, False)
        if not params:
            inner = _json("xml_tool_call", m.start("body"), m["body"])
            value, ok = inner.value, inner.ok
        command = name[1] if name else value.get("name") if isinstance(value, dict) and isinstance(value.get("name"), str) else None
        found.append(Candidate("xml_tool_call", m.start(), m.end(), m[0], value.get("arguments", value) if isinstance(value, dict) else value, ok, command=command))
        rest = rest[: m.start()] + " " * len(m[0]) + rest[m.end() :]
    if not raw:
        for a, b in balanced_spans(rest):
            one = _json("json_object_in_text", a, rest[a:b])
            if one.ok and isinstance(one.value, (dict, list)) and (one.value or b - a > 2):
                found.append(one)
        for m in _PYTHON.finditer(rest):
            found.append(Candidate("python_style_command", m.start("name"), m.end("args") + 1, m[0].strip(), m["args"], True, command=m["name"], argument=m["args"].split(",")[0].split("=")[0].strip() or None))
    for one in list(found):
        if one.ok and one.grammar in ("raw_json", "fenced_json", "json_object_in_text"):
            found += _calls(one)
    return sorted(found, key=lambda c: (c.start, -PRIORITY[c.grammar]))


def select(found: list[Candidate], valid: list[bool] | None = None) -> int | None:
    """The index of the candidate to take, or None. With a schema the only valid one; else a single candidate; else the
    only one that is whole; of readings of the same place with the same value the one of highest priority."""

    def best(group: list[int]) -> int | None:
        if len(group) == 1:
            return group[0]
        first = found[group[0]] if group else None
        if first is None or not all(found[i].value == first.value and found[i].start < first.end and first.start < found[i].end for i in group):
            return None
        top = max(PRIORITY[found[i].grammar] for i in group)
        tops = [i for i in group if PRIORITY[found[i].grammar] == top]
        return tops[0] if len(tops) == 1 else None

    if valid is not None and any(valid):
        return best([i for i, ok in enumerate(valid) if ok])
    if len(found) == 1:
        return 0
    return best([i for i, c in enumerate(found) if c.ok])


def parse_model_output(data: bytes, options: dict) -> Tree:
    """candidate rows with grammar, status, repairs and value, and which is selected. Options aliases (command names to
    take for others) and schema (a JSON Schema candidates must meet to be taken)."""
    from quillspan.operators.schemas import validate_value

    text = data.decode("utf-8", "replace")
    tree = Tree("model_output")
    found, aliases, schema = candidates(text), options.get("aliases", {}), options.get("schema")
    valid = None if schema is None else [c.ok and not validate_value(c.value, schema) for c in found]
    chosen = select(found, valid)
    for i, c in enumerate(found):
        node = tree.add(
            "candidate", 0, aliases.get(c.command, c.command), canonical(c.value) if c.ok else None, len(text[: c.start].encode()), len(text[: c.end].encode()), grammar=c.grammar, status=c.status, priority=PRIORITY[c.grammar], selected=i == chosen, repairs=",".join(c.repairs) or None,
            alias_of=c.command if c.command in aliases else None, valid=valid[i] if valid is not None else None, argument=c.argument,
        )
        if not c.ok:
            tree.warn("model_output.incomplete", c.grammar, parent=node)
    tree.set(0, candidates=len(found), selected=chosen, outcome="empty" if not text.strip() else "parsed" if chosen is not None else "ambiguous" if any(c.ok for c in found) else "incomplete" if found else "unparsed")
    return tree


PARSERS = {"model_output": parse_model_output}
