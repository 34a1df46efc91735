"""Source code: symbols, imports, calls, tests and comments. Python is read by its own parser, other languages by the
shape of their declarations; brackets, strings and comments are followed, so ranges end where blocks do."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from typing import NamedTuple

from quillspan.formats.base import Offsets, Tree


class Language(NamedTuple):
    """How a language writes comments, strings, declarations (kind, pattern with a group ``name``) and imports."""

    comments: tuple[str, ...]
    block: tuple[str, str] | None
    quotes: str
    symbols: tuple[tuple[str, str], ...]
    imports: str | None
    test: str | None = None


_C = (("function", r"^[ \t]*(?:[\w:*&<>,\[\]~ ]+[ *&])?(?P<name>~?[A-Za-z_]\w*(?:::\w+)*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:->\s*[\w:<>]+\s*)?\{"), ("struct", r"^[ \t]*(?:typedef\s+)?(?:struct|union)\s+(?P<name>\w+)\s*(?::[^{;]*)?\{"), ("enum", r"^[ \t]*enum\s+(?:class\s+)?(?P<name>\w+)"))
_JS = (
    ("class", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"), ("function", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"),
    ("function", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^=\n]+)?=>"),
    ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[\w$#]+)\s*(?:<[^<>]*>)?\([^(){};]*(?:\([^()]*\)[^(){};]*)*\)\s*(?::\s*[^={;\n]+)?\{"),
)
_TS = (("interface", r"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>[\w$]+)"), ("type", r"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<name>[\w$]+)[^=\n]*="), ("enum", r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)"), ("namespace", r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+(?P<name>[\w$.]+)"))
_JVM = (("class", r"^[ \t]*(?:@\w+\s+)*(?:(?:public|private|protected|internal|static|final|abstract|sealed|data|open|partial|inner)\s+)*(?:class|record|object)\s+(?P<name>\w+)"), ("interface", r"^[ \t]*(?:(?:public|private|protected|internal|sealed|fun|partial)\s+)*interface\s+(?P<name>\w+)"), ("enum", r"^[ \t]*(?:(?:public|private|protected|internal)\s+)*enum\s+(?:class\s+)?(?P<name>\w+)"))
_JMETHOD = (("method", r"^[ \t]+(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|synchronized|override|virtual|async|sealed|extern|unsafe)\s+)+[\w<>\[\],.? ]*?(?P<name>\w+)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:throws\s+[\w., ]+)?(?:\{|=>|;)"),)
LANGUAGES = {
    "rust": Language(("//",), ("/*", "*/"), '"', (
        ("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<name>\w+)"), ("struct", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(?P<name>\w+)"),
        ("enum", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("trait", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"), ("impl", r"^[ \t]*(?:unsafe\s+)?impl\b(?:<[^{;]*?>)?\s*(?P<name>[^{;]+?)\s*(?:where\b[^{]*)?\{"),
        ("module", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"), ("type", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"), ("constant", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z_]\w*)\s*:"), ("macro", r"^[ \t]*macro_rules!\s+(?P<name>\w+)"),
    ), r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<name>[^;]+);", r"#\[(?:\w+::)?test\b[^\]]*\]\s*(?:#\[[^\]]*\]\s*)*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
    "javascript": Language(("//",), ("/*", "*/"), "\"'`", _JS, r"^[ \t]*(?:import\s+(?:[^'\"\n]*\sfrom\s+)?|export\s+[^'\"\n]*\sfrom\s+|(?:const|let|var)\s+[^=\n]+=\s*require\()['\"](?P<name>[^'\"]+)['\"]", r"\b(?:it|test|describe)\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
    "typescript": Language(("//",), ("/*", "*/"), "\"'`", (*_TS, *_JS), r"^[ \t]*(?:import\s+(?:type\s+)?(?:[^'\"\n]*\sfrom\s+)?|export\s+[^'\"\n]*\sfrom\s+)['\"](?P<name>[^'\"]+)['\"]", r"\b(?:it|test|describe)\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
    "go": Language(("//",), ("/*", "*/"), '"`', (("function", r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)"), ("struct", r"^type\s+(?P<name>\w+)\s+struct\b"), ("interface", r"^type\s+(?P<name>\w+)\s+interface\b"), ("type", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)\S")), r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<name>[\w./-]+)\"\s*$", r"^func\s+(Test\w+)\("),
    "java": Language(("//",), ("/*", "*/"), '"', (*_JVM, *_JMETHOD), r"^[ \t]*import\s+(?:static\s+)?(?P<name>[\w.*]+);", r"@Test\b[^{;]*?\bvoid\s+(\w+)"),
    "kotlin": Language(("//",), ("/*", "*/"), '"', (*_JVM, ("function", r"^[ \t]*(?:(?:public|private|protected|internal|override|open|suspend|inline|operator|infix|tailrec|abstract)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>?.]+\.)?(?P<name>\w+)")), r"^[ \t]*import\s+(?P<name>[\w.*]+)", r"@Test\b\s*(?:fun\s+)(\w+)"),
    "c": Language(("//",), ("/*", "*/"), "\"'", _C, r"^[ \t]*#\s*include\s+[<\"](?P<name>[^>\"]+)[>\"]"),
    "cpp": Language(("//",), ("/*", "*/"), "\"'", (("class", r"^[ \t]*(?:template\s*<[^{;]*>\s*)?class\s+(?P<name>\w+)\s*(?:final\s*)?(?::[^{;]*)?\{"), ("namespace", r"^[ \t]*(?:inline\s+)?namespace\s+(?P<name>[\w:]+)"), *_C), r"^[ \t]*#\s*include\s+[<\"](?P<name>[^>\"]+)[>\"]", r"\bTEST(?:_F|_P)?\s*\(\s*(\w+\s*,\s*\w+)"),
    "csharp": Language(("//",), ("/*", "*/"), '"', (("namespace", r"^[ \t]*namespace\s+(?P<name>[\w.]+)"), ("struct", r"^[ \t]*(?:(?:public|private|protected|internal|readonly)\s+)*struct\s+(?P<name>\w+)"), *_JVM, *_JMETHOD), r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?P<name>[\w.]+);", r"\[(?:Fact|Test|TestMethod|Theory)\][^{;]*?\b(\w+)\s*\("),
    "ruby": Language(("#",), None, "\"'", (("class", r"^[ \t]*class\s+(?P<name>[\w:]+)"), ("module", r"^[ \t]*module\s+(?P<name>[\w:]+)"), ("method", r"^[ \t]*def\s+(?P<name>(?:self\.)?[\w?!=]+)")), r"^[ \t]*require(?:_relative)?\s*\(?['\"](?P<name>[^'\"]+)['\"]", r"^\s*(?:it|describe|test)\s+['\"]([^'\"]+)['\"]"),
    "php": Language(("//", "#"), ("/*", "*/"), "\"'", (("class", r"^[ \t]*(?:abstract\s+|final\s+)?class\s+(?P<name>\w+)"), ("interface", r"^[ \t]*interface\s+(?P<name>\w+)"), ("trait", r"^[ \t]*trait\s+(?P<name>\w+)"), ("function", r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<name>\w+)")), r"^[ \t]*(?:use\s+(?P<name>[\w\\]+)[^;(]*;|(?:require|include)(?:_once)?\s*\(?['\"](?P<file>[^'\"]+)['\"])"),
    "swift": Language(("//",), ("/*", "*/"), '"', (("class", r"^[ \t]*(?:(?:public|private|internal|open|final|fileprivate)\s+)*(?:class|actor)\s+(?!func\b|var\b)(?P<name>\w+)"), ("struct", r"^[ \t]*(?:(?:public|private|internal|fileprivate)\s+)*struct\s+(?P<name>\w+)"), ("protocol", r"^[ \t]*(?:public\s+)?protocol\s+(?P<name>\w+)"), ("enum", r"^[ \t]*(?:(?:public|private|indirect)\s+)*enum\s+(?P<name>\w+)"), ("extension", r"^[ \t]*(?:public\s+)?extension\s+(?P<name>[\w.]+)"), ("function", r"^[ \t]*(?:(?:public|private|internal|open|static|class|override|mutating|fileprivate|final)\s+)*func\s+(?P<name>\w+)")), r"^[ \t]*import\s+(?P<name>[\w.]+)", r"\bfunc\s+(test\w+)\("),
    "bash": Language(("#",), None, "\"'", (("function", r"^[ \t]*(?:function\s+(?P<name>[\w:-]+)|(?P<plain>[\w:-]+)\s*\(\))\s*(?:\(\))?\s*\{?"),), r"^[ \t]*(?:source|\.)\s+(?P<name>\S+)"),
    "sql": Language(("--",), ("/*", "*/"), "'", (("table", r"(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`]+)"), ("view", r"(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`]+)"), ("function", r"(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?P<name>[\w.\"`]+)"), ("index", r"(?i)^[ \t]*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`]+)")), None),
    "css": Language((), ("/*", "*/"), "\"'", (("rule", r"^[ \t]*(?P<name>[.#:\w\[*@][^{};]*?)\s*\{"),), r"^[ \t]*@import\s+(?:url\()?['\"]?(?P<name>[^'\");]+)"),
}
_CALL = re.compile(r"(?<![\w.])(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*!?\(")
# Words before a bracket that call nothing.
KEYWORDS = frozenset("if for while switch catch return function fn match sizeof def class elif else when typeof await new throw not and or in is lambda print except with assert del raise yield case do super foreach using lock fixed unless until struct impl".split())


def blanked(text: str, language: Language) -> tuple[str, list[tuple[int, int]], list[int]]:
    """(the text with comments and strings as spaces, the ranges of comments, places of brackets that match nothing)."""
    out, comments, at, n = list(text), [], 0, len(text)
    marks = [re.escape(c) for c in language.comments] + ([re.escape(language.block[0])] if language.block else []) + [re.escape(q) for q in language.quotes]
    finder = re.compile("|".join(marks)) if marks else None
    while finder and (m := finder.search(text, at)):
        mark, start = m[0], m.start()
        if mark in language.comments:
            end = text.find("\n", start)
            end = n if end == -1 else end
            comments.append((start, end))
        elif language.block and mark == language.block[0]:
            end = text.find(language.block[1], start + 2)
            end = n if end == -1 else end + len(language.block[1])
            comments.append((start, end))
        else:
            end = start + 1
            while end < n and text[end] != mark and not (text[end] == "\n" and mark != "`"):
                end += 2 if text[end] == "\\" else 1
            end = min(n, end + 1)
        for i in range(start, min(end, n)):
            if out[i] != "\n":
                out[i] = " "
        at = max(end, start + 1)
    bare = "".join(out)
    stack, bad = [], []
    pairs = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", bare):
        if m[0] in "([{":
            stack.append((m[0], m.start()))
        elif stack and stack[-1][0] == pairs[m[0]]:
            stack.pop()
        else:
            bad.append(m.start())
    return bare, comments, bad + [p for _, p in stack]


def _block_end(bare: str, at: int) -> int:
    """Behind the block that opens after a declaration, or the end of its line or statement."""
    m = re.compile(r"[{;]").search(bare, at)
    if not m or bare.find("\n\n", at, m.start()) != -1 and m[0] == ";":
        end = bare.find("\n", at)
        return len(bare) if end == -1 else end
    if m[0] == ";":
        return m.end()
    depth = 0
    for k in re.compile(r"[{}]").finditer(bare, m.start()):
        depth += 1 if k[0] == "{" else -1
        if not depth:
            return k.end()
    return len(bare)


def _by_shape(name: str, data: bytes, options: dict) -> Tree:
    language, text = LANGUAGES[name], data.decode("utf-8", "replace")
    tree, byte = Tree(name), Offsets(text)
    bare, comments, bad = blanked(text, language)
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern in language.symbols:
        for m in re.finditer(pattern, bare, re.M):
            group = next(g for g in m.groupdict() if m[g])
            if m[group] not in KEYWORDS:
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                end = _block_end(bare, m.end() - 1 if m[0].endswith(("{", ";")) else m.end())
                found.append((start, end, kind, re.sub(r"\s+", " ", m[group]).strip()))
    taken: dict[int, bool] = {}
    nodes: list[tuple[int, int, int, str]] = []
    stack: list[tuple[int, int, str]] = []
    for start, end, kind, symbol in sorted(found, key=lambda x: (x[0], -x[1])):
        if taken.setdefault(start, False):
            continue
        taken[start] = True
        while stack and stack[-1][0] <= start:
            stack.pop()
        qualified = ".".join([*(s[2] for s in stack), symbol])
        node = tree.add("symbol", stack[-1][1] if stack else 0, symbol, None, byte(start), byte(end), type=kind, qualified=qualified, exported=bool(re.match(r"(?:pub\b|export\b|public\b)", text[start:])) or None)
        nodes.append((start, end, node, symbol))
        stack.append((end, node, symbol))
    declared = {s for s, *_ in nodes}

    def holder(at: int) -> int:
        return next((n for s, e, n, _ in reversed(nodes) if s <= at < e), 0)

    if language.imports:
        for m in re.finditer(language.imports, text, re.M):
            if not any(a <= m.start() < b for a, b in comments):
                tree.add("import", holder(m.start()), re.sub(r"\s+", " ", next(g for g in m.groups() if g)), None, byte(m.start()), byte(m.end()))
    for m in _CALL.finditer(bare):
        if m["name"] not in KEYWORDS and not any(s <= m.start() <= s + 160 and bare[s : m.start()].count("\n") == 0 and re.search(r"\b(?:fn|function|func|fun|def)\s*$", bare[s : m.start()]) for s in declared if s <= m.start() < s + 161) and m.start() not in declared:
            tree.add("call", holder(m.start()), m["name"], None, byte(m.start()), byte(m.end() - 1))
    if language.test:
        for m in re.finditer(language.test, text, re.M):
            tree.add("test", holder(m.start(1)), m[1], None, byte(m.start()), byte(m.end()))
    for a, b in comments:
        tree.add("comment", holder(a), None, text[a:b], byte(a), byte(b))
    for at in bad:
        tree.warn(f"{name}.unbalanced_bracket", text[at], byte(at), byte(at + 1))
    return tree


def parse_python(data: bytes, options: dict) -> Tree:
    """Symbols, imports, assignments, returns, calls, branches, tests and comments; damaged code falls back to shapes."""
    text = data.decode("utf-8-sig", "replace")
    tree = Tree("python")
    starts = [0]
    for line in data.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))

    def span(node: ast.AST) -> tuple[int, int]:
        return starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset

    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        tree.warn("python.syntax_error", str(e), starts[min(len(starts) - 1, (getattr(e, "lineno", 1) or 1) - 1)])
        for m in re.finditer(r"^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)", text, re.M):
            tree.add("symbol", 0, m[3], None, len(text[: m.start()].encode()), len(text[: m.end()].encode()), type="function" if m[2] == "def" else "class", qualified=m[3])
        for m in re.finditer(r"^\s*(?:from\s+([\w.]+)\s+)?import\s+([\w., *]+)", text, re.M):
            tree.add("import", 0, m[1] or m[2])
        return tree

    def visit(node: ast.AST, parent: int, path: list[str]) -> None:
        for c in ast.iter_child_nodes(node):
            here = parent
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(c, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                decorators = ",".join(ast.unparse(d) for d in c.decorator_list)
                here = tree.add("symbol", parent, c.name, ast.get_docstring(c), *span(c), type=kind, qualified=".".join([*path, c.name]), decorators=decorators or None, is_async=isinstance(c, ast.AsyncFunctionDef) or None, bases=",".join(ast.unparse(b) for b in c.bases) or None if kind == "class" else None)
                if c.name.startswith("test") and kind != "class" or kind == "class" and c.name.startswith("Test"):
                    tree.add("test", here, c.name, None, *span(c))
                visit(c, here, [*path, c.name])
                continue
            if isinstance(c, ast.Import):
                for a in c.names:
                    tree.add("import", parent, a.name, None, *span(c), alias=a.asname)
            elif isinstance(c, ast.ImportFrom):
                for a in c.names:
                    tree.add("import", parent, "." * c.level + (c.module or ""), a.name, *span(c), alias=a.asname)
            elif isinstance(c, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                for t in c.targets if isinstance(c, ast.Assign) else [c.target]:
                    tree.add("assignment", parent, ast.unparse(t), None, *span(c), annotation=ast.unparse(c.annotation) if isinstance(c, ast.AnnAssign) else None)
            elif isinstance(c, ast.Return):
                tree.add("return", parent, None, ast.unparse(c.value) if c.value else None, *span(c))
            elif isinstance(c, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)):
                tree.add("branch", parent, type(c).__name__.removeprefix("Async").lower(), None, *span(c))
            elif isinstance(c, ast.Call):
                tree.add("call", parent, ast.unparse(c.func), None, *span(c))
            visit(c, here, path)

    visit(module, 0, [])
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                at = starts[t.start[0] - 1] + len(t.line[: t.start[1]].encode())
                tree.add("comment", 0, None, t.string, at, at + len(t.string.encode()))
    except (tokenize.TokenError, IndentationError):
        tree.warn("python.tokens", "comments are not all read")
    return tree


def _named(name: str):
    return lambda data, options: _by_shape(name, data, options)


PARSERS = {"python": parse_python, **{name: _named(name) for name in LANGUAGES}, "jsx": _named("javascript"), "tsx": _named("typescript")}
