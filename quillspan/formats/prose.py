"""Prose: plain text, Markdown with its dialects, reStructuredText, AsciiDoc and LaTeX."""

from __future__ import annotations

import re
from typing import NamedTuple

from quillspan.formats.base import MAX_DEPTH, Offsets, ParseError, Tree

PHYSICAL = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


class Line(NamedTuple):
    """A line without its end, or what a container leaves of it, and where it begins."""

    text: str
    at: int

    def rest(self, n: int) -> Line:
        return Line(self.text[n:], self.at + min(n, len(self.text)))

    @property
    def end(self) -> int:
        return self.at + len(self.text)

    @property
    def blank(self) -> bool:
        return not self.text.strip()


def physical_lines(text: str) -> list[Line]:
    """Lines of a text; LF, CRLF and CR end them, and there is none behind the last line end."""
    return [Line(m[0].rstrip("\r\n"), m.start()) for m in PHYSICAL.finditer(text)]


def parse_text(data: bytes, options: dict) -> Tree:
    """Paragraphs: runs of lines that are not blank, without the end of their last line."""
    text = data.decode(options.get("encoding", "utf-8"), "replace")
    tree, byte = Tree("text", replaced=text.count("\ufffd") or None), Offsets(text)
    block: list[Line] = []
    for line in [*physical_lines(text), Line("", len(text))]:
        if not line.blank:
            block.append(line)
        elif block:
            start, end = block[0].at, block[-1].end
            tree.add("paragraph", 0, None, text[start:end], byte(start), byte(end))
            block = []
    return tree


_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])( +|\t|$)")
_TASK = re.compile(r"\[([ xX])\][ \t]+")
_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
_DEFINITION = re.compile(r" {0,3}\[([^\]^][^\]]*)\]:[ \t]*(\S+)(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^)]*)\)))?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z][\w-]*(?=[\s/>]|$)|/[A-Za-z]|!--|!\[CDATA\[|![A-Z]|\?)")
_MATH = re.compile(r" {0,3}\$\$")
_DIRECTIVE = re.compile(r" {0,3}(:{3,})[ \t]*(.*)$")
_CHUNK = re.compile(r"\{(?P<engine>[A-Za-z][\w.+-]*)(?P<rest>[^}]*)\}")
_CELL = re.compile(r"(?:[^|\\`]|\\.|`[^`]*`|`)*")
_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<ticks>`+)(?P<code>[^`]|[^`].*?[^`])(?P=ticks)(?!`)|(?P<dmath>\$\$(?P<dm>[^$]+)\$\$)|(?P<math>(?<![\w$\\])\$(?P<m>[^\s$](?:[^$\n]*[^\s$])?)\$(?![\w$]))"
    r"|(?P<foot>\[\^(?P<fn>[^\]\s]+)\])|(?P<cite>\[(?P<ck>-?@[^\]]+)\])|(?P<image>!\[(?P<alt>[^\[\]]*)\]\((?P<isrc>[^()\s]*)(?:\s+\"[^\"]*\")?\))"
    r"|(?P<link>\[(?P<lt>(?:[^\[\]]|\[[^\[\]]*\])*)\]\((?P<lurl>(?:[^()\s]|\([^()\s]*\))*)(?:\s+[\"'][^\"']*[\"'])?\))|(?P<ref>\[(?P<rt>[^\[\]]+)\]\[(?P<rk>[^\[\]]*)\])"
    r"|<(?P<auto>(?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>|(?P<html></?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|<!--.*?-->)"
    r"|(?P<strong>(?P<sm>\*\*|__)(?=\S)(?P<st>.+?)(?<=\S)(?P=sm)(?!\w))|(?P<strike>~~(?=\S)(?P<kt>.+?)(?<=\S)~~)|(?P<em>(?<!\w)(?P<emm>[*_])(?=[^\s*_])(?P<et>(?:[^*_]|\*\*.+?\*\*|__.+?__)+?)(?<=\S)(?P=emm)(?!\w))"
    r"|(?P<break>(?: {2,}|\\)(?=\n))",
    re.S,
)


class _Markdown:
    """Reads one Markdown document into a tree. Kinds and texts follow the table ``markdown_nodes``."""

    def __init__(self, text: str, tree: Tree, dialect: str):
        self.text, self.tree, self.byte, self.dialect = text, tree, Offsets(text), dialect

    def add(self, kind: str, parent: int, start: int, end: int, value: str | None = None, name: str | None = None, **attrs: object) -> int:
        return self.tree.add(kind, parent, name, value, self.byte(start), self.byte(end), **attrs)

    def inline(self, text: str, at: int, parent: int, depth: int = 0) -> str:
        """Adds what a run of text holds and returns it as a reader sees it."""
        out, last = [], 0
        for m in _INLINE.finditer(text) if depth < 32 else ():
            out.append(text[last : m.start()])
            last, a, b = m.end(), at + m.start(), at + m.end()
            if m["escape"]:
                out.append(m[0][1])
            elif m["code"] is not None:
                code = m["code"].strip() if m["code"].strip() else m["code"]
                self.add("inline_code", parent, a, b, code)
                out.append(code)
            elif m["dmath"] or m["math"]:
                self.add("display_math" if m["dmath"] else "inline_math", parent, a, b, m["dm"] or m["m"])
                out.append(m["dm"] or m["m"])
            elif m["foot"]:
                self.add("footnote_reference", parent, a, b, None, m["fn"])
            elif m["cite"]:
                for key in re.findall(r"@([\w:./-]*\w)", m["ck"]):
                    self.add("citation", parent, a, b, None, key)
            elif m["image"]:
                self.add("image", parent, a, b, m["alt"], destination=m["isrc"])
                out.append(m["alt"])
            elif m["link"] or m["ref"]:
                shown = m["lt"] if m["link"] else m["rt"]
                node = self.add("link", parent, a, b, None, destination=m["lurl"] if m["link"] else None, reference=None if m["link"] else (m["rk"] or m["rt"]).casefold())
                shown = self.inline(shown, a + 1, node, depth + 1)
                self.tree.rows[node] = (*self.tree.rows[node][:4], shown, *self.tree.rows[node][5:])
                out.append(shown)
            elif m["auto"]:
                self.add("link", parent, a, b, m["auto"], destination=m["auto"])
                out.append(m["auto"])
            elif m["html"]:
                self.add("html_inline", parent, a, b, m[0])
            elif m["break"]:
                self.add("hard_break", parent, a, b)
            else:
                kind, body, group = ("strong", m["st"], "st") if m["strong"] else ("strikethrough", m["kt"], "kt") if m["strike"] else ("emphasis", m["et"], "et")
                node = self.add(kind, parent, a, b)
                body = self.inline(body, at + m.start(group), node, depth + 1)
                self.tree.rows[node] = (*self.tree.rows[node][:4], body, *self.tree.rows[node][5:])
                out.append(body)
        return "".join([*out, text[last:]])

    def leaf(self, kind: str, parent: int, start: int, end: int, at: int, text: str, **attrs: object) -> int:
        node = self.add(kind, parent, start, end, None, **attrs)
        shown = re.sub(r"[ \t]*\n[ \t]*", " ", self.inline(text, at, node))
        self.tree.rows[node] = (*self.tree.rows[node][:4], shown, *self.tree.rows[node][5:])
        return node

    def chunk(self, info: str) -> dict:
        """Metadata of an executable block: engine, label and options; nothing is run."""
        m = _CHUNK.match(info)
        if not m or self.dialect == "common_mark":
            return {}
        found: dict[str, object] = {"engine": m["engine"], "executed": False}
        for i, part in enumerate(p for p in re.split(r",(?=(?:[^\"']*[\"'][^\"']*[\"'])*[^\"']*$)|\s+(?=[\w.]+\s*=)", m["rest"].strip(" ,")) if p and p.strip()):
            key, eq, value = part.strip().partition("=")
            if eq:
                found[f"option.{key.strip()}"] = value.strip().strip("\"'")
            elif i == 0:
                found["label"] = key
        return found

    def table(self, lines: list[Line], i: int, parent: int) -> int:
        """The table that begins at line i; returns the line behind it."""
        stop = i + 2
        while stop < len(lines) and not lines[stop].blank and "|" in lines[stop].text:
            stop += 1
        node = self.add("table", parent, lines[i].at + len(lines[i].text) - len(lines[i].text.lstrip()), lines[stop - 1].end)
        aligns = [("center" if c[0] == c[-1] == ":" and len(c) > 1 else "left" if c[0] == ":" else "right" if c[-1] == ":" else None) for c in (x.strip() for x in lines[i + 1].text.strip().strip("|").split("|")) if c]
        for n, line in enumerate([lines[i], *lines[i + 2 : stop]]):
            row = self.add("table_row", node, line.at + len(line.text) - len(line.text.lstrip()), line.at + len(line.text.rstrip()), header=n == 0)
            at, body = line.at, line.text
            begin = len(body) - len(body.lstrip())
            pos = begin + (body[begin : begin + 1] == "|")
            column = 0
            while pos <= len(body.rstrip()):
                m = _CELL.match(body, pos)
                if m.end() >= len(body.rstrip()) and not m[0].strip() and column:
                    break
                cell = m[0]
                inner = at + pos + len(cell) - len(cell.lstrip())
                self.leaf("table_cell", row, inner, inner + len(cell.strip()), inner, cell.strip(), column=column, align=aligns[column] if column < len(aligns) else None)
                pos, column = m.end() + 1, column + 1
        return stop

    def blocks(self, lines: list[Line], parent: int, depth: int = 0) -> None:
        if depth > MAX_DEPTH:
            raise ParseError("nested too deeply", self.byte(lines[0].at) if lines else 0)
        i = 0
        while i < len(lines):
            line = lines[i]
            text = line.text
            if line.blank:
                i += 1
                continue
            indent = len(text) - len(text.lstrip(" "))
            start = line.at + indent
            if indent >= 4 or text.startswith("\t"):
                stop = i + 1
                while stop < len(lines) and (lines[stop].blank or lines[stop].text.startswith(("    ", "\t"))):
                    stop += 1
                while lines[stop - 1].blank:
                    stop -= 1
                self.add("indented_code", parent, line.at, lines[stop - 1].end, "\n".join(x.text[4:] if x.text.startswith("    ") else x.text.lstrip("\t") for x in lines[i:stop]))
                i = stop
            elif m := _FENCE.match(text):
                mark, stop = m[1], i + 1
                close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
                while stop < len(lines) and not close.match(lines[stop].text):
                    stop += 1
                closed = stop < len(lines)
                body = [x.text[min(indent, len(x.text) - len(x.text.lstrip(" "))) :] for x in lines[i + 1 : stop]]
                info = m[2]
                word = re.match(r"\{?\.?([^\s{},]*)", info)[1]
                node = self.add("code_fence", parent, start, lines[stop if closed else stop - 1].end, "".join(b + "\n" for b in body), language=word or None, info=info or None, closed=closed, **self.chunk(info))
                if self.dialect == "quarto":
                    for b in body:
                        if o := re.match(r"#\|\s*([\w.-]+):\s*(.*)$", b):
                            self.tree.set(node, **{f"option.{o[1]}": o[2]})
                i = stop + closed
            elif m := _MATH.match(text):
                stop = i
                rest = text[m.end() :]
                if "$$" not in rest:
                    stop += 1
                    while stop < len(lines) and "$$" not in lines[stop].text:
                        stop += 1
                stop = min(stop, len(lines) - 1)
                body = "\n".join(x.text for x in lines[i : stop + 1]).strip()
                self.add("display_math", parent, start, lines[stop].end, body.removeprefix("$$").removesuffix("$$").strip())
                i = stop + 1
            elif m := _HEADING.match(text):
                body = m[2] or ""
                self.leaf("heading", parent, start, line.at + len(text.rstrip()), line.at + (m.start(2) if m[2] else len(text)), body, level=len(m[1]))
                i += 1
            elif _BREAK.match(text):
                self.add("thematic_break", parent, start, line.at + len(text.rstrip()))
                i += 1
            elif m := _QUOTE.match(text):
                stop, inner, lazy = i, [], False
                while stop < len(lines):
                    q = _QUOTE.match(lines[stop].text)
                    if q:
                        inner.append(lines[stop].rest(q.end()))
                        lazy = not inner[-1].blank and not _FENCE.match(inner[-1].text)
                    elif lazy and not lines[stop].blank and not self.opens(lines[stop].text):
                        inner.append(lines[stop])
                    else:
                        break
                    stop += 1
                node = self.add("block_quote", parent, start, lines[stop - 1].end)
                self.blocks(inner, node, depth + 1)
                i = stop
            elif _ITEM.match(text):
                i = self.list(lines, i, parent, depth)
            elif m := _FOOTNOTE.match(text):
                stop = i + 1
                while stop < len(lines) and (lines[stop].text.startswith("    ") or not lines[stop].blank and not self.opens(lines[stop].text) and not _FOOTNOTE.match(lines[stop].text)):
                    stop += 1
                body = "\n".join([text[m.end() :], *(x.text.strip() for x in lines[i + 1 : stop])])
                self.leaf("footnote_definition", parent, start, lines[stop - 1].end, line.at + m.end(), body, name=m[1])
                i = stop
            elif m := _DIRECTIVE.match(text):
                stop = i + 1
                while stop < len(lines) and not re.match(rf" {{0,3}}:{{{len(m[1])},}}[ \t]*$", lines[stop].text):
                    stop += 1
                node = self.add("directive_block", parent, start, lines[min(stop, len(lines) - 1)].end, None, m[2].strip() or None)
                self.blocks(lines[i + 1 : stop], node, depth + 1)
                i = stop + 1
            elif _HTML.match(text):
                stop = i + 1
                while stop < len(lines) and not lines[stop].blank:
                    stop += 1
                self.add("html_block", parent, start, lines[stop - 1].end, "\n".join(x.text for x in lines[i:stop]))
                i = stop
            elif m := _DEFINITION.match(text):
                self.add("link_definition", parent, start, line.end, None, m[1].casefold(), destination=m[2].strip("<>"), title=m[3] or m[4] or m[5])
                i += 1
            elif "|" in text and i + 1 < len(lines) and _RULE.match(lines[i + 1].text) and "-" in lines[i + 1].text and lines[i + 1].text.count("|") >= 1:
                i = self.table(lines, i, parent)
            else:
                stop, level = i + 1, None
                while stop < len(lines) and not lines[stop].blank:
                    if s := _SETEXT.match(lines[stop].text):
                        level = 1 if s[1][0] == "=" else 2
                        break
                    if self.opens(lines[stop].text):
                        break
                    if "|" in lines[stop].text and stop + 1 < len(lines) and _RULE.match(lines[stop + 1].text) and "|" in lines[stop + 1].text:
                        break
                    stop += 1
                if level is None and stop < len(lines) and lines[stop].text.startswith(": ") or level is None and stop + 1 < len(lines) and stop < len(lines) and lines[stop].blank and lines[stop + 1].text.startswith(": "):
                    i = self.definitions(lines, i, stop, parent)
                    continue
                first, last = lines[i], lines[stop - 1]
                body = self.text[start : last.at + len(last.text.rstrip())] if all(x.at == lines[i + k].at for k, x in enumerate(lines[i:stop])) and self.joined(lines[i:stop]) else "\n".join(x.text.strip() for x in lines[i:stop])
                end = (lines[stop] if level else last).at + len((lines[stop] if level else last).text.rstrip())
                self.leaf("heading" if level else "paragraph", parent, start, end, first.at + indent, body, **({"level": level} if level else {}))
                i = stop + (level is not None)

    def joined(self, lines: list[Line]) -> bool:
        """Whether lines follow each other in the text without a container's marks between."""
        return all(self.text[a.end : b.at] in ("\n", "\r\n", "\r") for a, b in zip(lines, lines[1:]))

    def opens(self, text: str) -> bool:
        """Whether a line begins a block even within a paragraph."""
        item = _ITEM.match(text)
        return bool(_HEADING.match(text) or _FENCE.match(text) or _BREAK.match(text) or _QUOTE.match(text) or _MATH.match(text) or _DIRECTIVE.match(text) or item and item[3] and (item[2][0] in "-*+" or item[2][:-1] == "1") or re.match(r" {0,3}<(?:/?(?:div|p|table|ul|ol|pre|section|article|details|script|style|h[1-6])\b|!--)", text, re.I))

    def list(self, lines: list[Line], i: int, parent: int, depth: int) -> int:
        first = _ITEM.match(lines[i].text)
        kind = first[2][-1]
        start = lines[i].at + len(first[1])
        node = self.add("list", parent, start, start, ordered=kind in ".)", first=first[2][:-1] if kind in ".)" else None)
        end = start
        while i < len(lines):
            m = _ITEM.match(lines[i].text)
            if not m or m[2][-1] != kind or _BREAK.match(lines[i].text):
                break
            width = len(m[1]) + len(m[2]) + (len(m[3]) if 0 < len(m[3]) <= 4 and m[3] != "\t" else 1)
            inner, stop, blank = [lines[i].rest(width)], i + 1, False
            while stop < len(lines):
                text = lines[stop].text
                if lines[stop].blank:
                    ahead = next((x for x in lines[stop:] if not x.blank), None)
                    if ahead is None or len(ahead.text) - len(ahead.text.lstrip(" ")) < width:
                        break
                    inner.append(lines[stop].rest(len(text)))
                    blank = True
                elif len(text) - len(text.lstrip(" ")) >= width:
                    inner.append(lines[stop].rest(width))
                    blank = False
                elif blank or _ITEM.match(text) or self.opens(text):
                    break
                else:
                    inner.append(lines[stop])
                stop += 1
            while len(inner) > 1 and inner[-1].blank:
                inner.pop()
            end = max(inner[-1].at + len(inner[-1].text.rstrip()), lines[i].at + len(lines[i].text.rstrip()))
            item = self.add("list_item", node, lines[i].at + len(m[1]), end)
            task = _TASK.match(inner[0].text)
            if task:
                self.add("task_list_marker", item, inner[0].at, inner[0].at + 3, checked=task[1] != " ")
                inner[0] = inner[0].rest(task.end())
            mark = len(self.tree.rows)
            self.blocks(inner, item, depth + 1)
            if len(self.tree.rows) > mark and self.tree.rows[mark][2] == "paragraph":
                self.tree.rows[item] = (*self.tree.rows[item][:4], self.tree.rows[mark][4], *self.tree.rows[item][5:])
            i = stop
            while i < len(lines) and lines[i].blank and i + 1 < len(lines) and (lines[i + 1].blank or (n := _ITEM.match(lines[i + 1].text)) and n[2][-1] == kind):
                i += 1
        self.tree.rows[node] = (*self.tree.rows[node][:7], self.byte(end))
        return i

    def definitions(self, lines: list[Line], i: int, stop: int, parent: int) -> int:
        node = self.add("definition_list", parent, lines[i].at, lines[i].end)
        for line in lines[i:stop]:
            self.leaf("definition_term", node, line.at, line.end, line.at, line.text)
        i = stop + lines[stop].blank
        while i < len(lines) and lines[i].text.startswith(": "):
            self.leaf("definition_description", node, lines[i].at, lines[i].end, lines[i].at + 2, lines[i].text[2:])
            i += 1
        self.tree.rows[node] = (*self.tree.rows[node][:7], self.byte(lines[i - 1].end))
        return i


def front_matter(lines: list[Line]) -> tuple[str, str, int] | None:
    """(format, text, lines taken) of the front matter; the text is what lies between the rules."""
    if lines and lines[0].text.rstrip() in ("---", "+++"):
        mark = lines[0].text.rstrip()
        for i, line in enumerate(lines[1:], 1):
            if line.text.rstrip() == mark or mark == "---" and line.text.rstrip() == "...":
                return "yaml" if mark == "---" else "toml", "\n".join(x.text for x in lines[1:i]), i + 1
    return None


def parse_markdown(data: bytes, options: dict, dialect: str = "common_mark") -> Tree:
    """Blocks and inlines with levels, destinations and byte ranges; front matter with its values below it."""
    from quillspan.formats.structured import parse_toml, parse_yaml

    text = data.decode("utf-8", "replace")
    tree = Tree("markdown", dialect=dialect)
    reader, lines, taken = _Markdown(text, tree, dialect), physical_lines(text), 0
    if text.startswith("\ufeff"):
        lines[0] = lines[0].rest(1)
    if found := front_matter(lines):
        kind, body, taken = found
        node = tree.add("frontmatter", 0, kind, body, 0, reader.byte(lines[taken - 1].end))
        try:
            inner = (parse_yaml if kind == "yaml" else parse_toml)(body.encode(), {})
            for row in inner.rows[1:]:
                tree.rows.append((row[0] + node, node if not row[1] else row[1] + node, *row[2:6], None, None))
            tree.partial |= inner.partial
        except ParseError as e:
            tree.warn("markdown.frontmatter_malformed", str(e), parent=node)
    reader.blocks(lines[taken:], 0)
    return tree


_RST_ADORN = re.compile(r"([!-/:-@\[-`{-~])\1*\s*$")
_RST_DIRECTIVE = re.compile(r"(\s*)\.\. (?:\|(?P<sub>[^|]+)\| )?(?P<name>[\w:+.-]+)::\s*(?P<arg>.*)$")
_RST_ROLE = re.compile(r":(?P<role>[\w:+.-]+):`(?P<rt>[^`]+)`|``(?P<lit>[^`]+)``|`(?P<ref>[^`<]+?)(?:\s*<(?P<url>[^<>]+)>)?`(?P<us>__?)|\[(?P<fn>#?\w+|\*)\]_|\*\*(?P<st>[^*]+)\*\*|(?<!\w)\*(?P<em>[^*\s][^*]*)\*|(?<![\w`])(?P<simple>[A-Za-z][\w.-]*)_(?!\w)|\|(?P<subst>[^|\s][^|]*)\|")


def parse_rst(data: bytes, options: dict) -> Tree:
    """Sections by the order of their adornments, directives with options, fields, tables, roles, targets and references.
    Includes are listed and never read."""
    text = data.decode("utf-8", "replace")
    tree, byte, lines = Tree("restructured_text"), Offsets(text), physical_lines(text)
    styles: list[tuple[str, bool]] = []
    open_: list[int] = [0]

    def inline(body: str, at: int, parent: int) -> None:
        for m in _RST_ROLE.finditer(body):
            a, b = byte(min(at + m.start(), len(text))), byte(min(at + m.end(), len(text)))
            if m["role"]:
                tree.add("role", parent, m["role"], m["rt"], a, b)
            elif m["lit"]:
                tree.add("inline_code", parent, None, m["lit"], a, b)
            elif m["ref"] or m["simple"]:
                tree.add("reference", parent, (m["ref"] or m["simple"]).strip().casefold(), m["url"], a, b, anonymous=m["us"] == "__" or None)
            elif m["fn"]:
                tree.add("footnote_reference", parent, m["fn"], None, a, b)
            elif m["st"] or m["em"]:
                tree.add("strong" if m["st"] else "emphasis", parent, None, m["st"] or m["em"], a, b)
            else:
                tree.add("substitution_reference", parent, m["subst"], None, a, b)

    i = 0
    while i < len(lines):
        line = lines[i]
        if line.blank:
            i += 1
            continue
        over = _RST_ADORN.match(line.text) and i + 2 < len(lines) and not lines[i + 1].blank and lines[i + 2].text.rstrip() == line.text.rstrip()
        under = i + 1 < len(lines) and _RST_ADORN.match(lines[i + 1].text) and not line.text.startswith((" ", "\t")) and not _RST_ADORN.match(line.text) and len(lines[i + 1].text.rstrip()) >= len(line.text.rstrip())
        if over or under:
            title, mark = (lines[i + 1], line.text[0]) if over else (line, lines[i + 1].text[0])
            style = (mark, bool(over))
            if style not in styles:
                styles.append(style)
            level = styles.index(style) + 1
            del open_[min(level, len(open_)) :]
            last = lines[i + (2 if over else 1)]
            open_.append(tree.add("section", open_[-1], None, title.text.strip(), byte(line.at), byte(last.end), level=level))
            inline(title.text, title.at, open_[-1])
            i += 3 if over else 2
            continue
        parent = open_[-1]

        def body_of(i: int, indent: int) -> int:
            stop = i + 1
            while stop < len(lines) and (lines[stop].blank or len(lines[stop].text) - len(lines[stop].text.lstrip()) > indent):
                stop += 1
            while lines[stop - 1].blank:
                stop -= 1
            return stop

        indent = len(line.text) - len(line.text.lstrip())
        if m := _RST_DIRECTIVE.match(line.text):
            stop = body_of(i, indent)
            node = tree.add("substitution" if m["sub"] else "directive", parent, m["sub"] or m["name"], m["arg"] or None, byte(line.at), byte(lines[stop - 1].end), directive=m["name"])
            k = i + 1
            while k < stop and (o := re.match(r"\s+:([\w-]+):\s*(.*)$", lines[k].text)):
                tree.set(node, **{f"option.{o[1]}": o[2]})
                k += 1
            if body := "\n".join(x.text.strip() for x in lines[k:stop]).strip():
                tree.add("code_block" if m["name"] in ("code", "code-block", "sourcecode", "parsed-literal") else "equation" if m["name"] == "math" else "content", node, None, body, byte(lines[k].at), byte(lines[stop - 1].end))
            if m["name"] in ("include", "literalinclude"):
                tree.warn("rst.include_not_read", m["arg"], byte(line.at), byte(line.end), node)
            i = stop
        elif m := re.match(r"\s*\.\. _([^:]+|`[^`]+`):\s*(\S*)", line.text):
            tree.add("target", parent, m[1].strip("`").casefold(), m[2] or None, byte(line.at), byte(line.end))
            i += 1
        elif m := re.match(r"\s*\.\. \[(#?\w+|\*)\]\s+(.*)", line.text):
            stop = body_of(i, indent)
            tree.add("footnote_definition" if not m[1][0].isalpha() else "citation_definition", parent, m[1], " ".join([m[2], *(x.text.strip() for x in lines[i + 1 : stop])]).strip(), byte(line.at), byte(lines[stop - 1].end))
            i = stop
        elif line.text.lstrip().startswith(".. ") or line.text.strip() == "..":
            stop = body_of(i, indent)
            tree.add("comment", parent, None, "\n".join(x.text.strip() for x in lines[i:stop])[2:].strip(), byte(line.at), byte(lines[stop - 1].end))
            i = stop
        elif m := re.match(r":([^:\s][^:]*):\s+(.*)$|:([^:\s][^:]*):$", line.text):
            stop = body_of(i, indent)
            tree.add("field", parent, m[1] or m[3], " ".join([m[2] or "", *(x.text.strip() for x in lines[i + 1 : stop])]).strip(), byte(line.at), byte(lines[stop - 1].end))
            i = stop
        elif line.text.startswith(">>> "):
            stop = i
            while stop < len(lines) and not lines[stop].blank:
                stop += 1
            tree.add("doctest", parent, None, "\n".join(x.text for x in lines[i:stop]), byte(line.at), byte(lines[stop - 1].end))
            i = stop
        elif re.match(r"\+[-=+]+\+\s*$", line.text):
            stop = i
            while stop < len(lines) and lines[stop].text[:1] in ("+", "|"):
                stop += 1
            node = tree.add("table", parent, "grid", None, byte(line.at), byte(lines[stop - 1].end))
            row: list[list[str]] = []
            for x in lines[i:stop]:
                if x.text[0] == "|":
                    row.append([c.strip() for c in x.text.strip().strip("|").split("|")])
                elif row:
                    r = tree.add("table_row", node)
                    for j in range(len(row[0])):
                        tree.add("table_cell", r, str(j), " ".join(c[j] for c in row if j < len(c) and c[j]))
                    row = []
            i = stop
        elif re.match(r"=+(?: +=+)+\s*$", line.text):
            stop, rules = i + 1, 1
            while stop < len(lines) and not (lines[stop].blank and rules >= 2):
                rules += bool(re.match(r"=+(?: +=+)*\s*$", lines[stop].text))
                stop += 1
            spans = [m.span() for m in re.finditer("=+", line.text)]
            node = tree.add("table", parent, "simple", None, byte(line.at), byte(lines[stop - 1].end))
            for x in lines[i + 1 : stop]:
                if not x.blank and not x.text.startswith("=="):
                    r = tree.add("table_row", node, None, None, byte(x.at), byte(x.end))
                    for j, (a, b) in enumerate(spans):
                        tree.add("table_cell", r, str(j), x.text[a : b if j + 1 < len(spans) else None].strip())
            i = stop
        elif m := re.match(r"(\s*)([-*+•]|(?:\d+|#|[A-Za-z])[.)])\s+", line.text):
            stop = body_of(i, indent)
            node = tree.add("list_item", parent, m[2], "\n".join([line.text[m.end() :], *(x.text.strip() for x in lines[i + 1 : stop])]).strip(), byte(line.at), byte(lines[stop - 1].end))
            inline(line.text, line.at, node)
            i = stop
        else:
            stop = i
            while stop < len(lines) and not lines[stop].blank:
                stop += 1
            body = text[line.at : lines[stop - 1].end]
            node = tree.add("block_quote" if indent else "paragraph", parent, None, body.strip(), byte(line.at), byte(lines[stop - 1].end))
            inline(body, line.at, node)
            i = stop
            if body.rstrip().endswith("::"):
                while i < len(lines) and lines[i].blank:
                    i += 1
                if i < len(lines) and len(lines[i].text) - len(lines[i].text.lstrip()) > indent:
                    stop = body_of(i, indent)
                    tree.add("literal_block", parent, None, "\n".join(x.text.strip() for x in lines[i:stop]), byte(lines[i].at), byte(lines[stop - 1].end))
                    i = stop
    resolve_targets(tree)
    return tree


def resolve_targets(tree: Tree) -> None:
    """Marks each reference as resolved or not: targets and section titles are anchors."""
    anchors = {r[3] for r in tree.rows if r[2] in ("target", "anchor") and r[3]} | {(r[4] or "").casefold() for r in tree.rows if r[2] == "section"}
    for r in tree.rows:
        if r[2] in ("reference", "xref"):
            tree.set(r[0], resolved=r[4] is not None or r[3] in anchors)


_ADOC_BLOCK = re.compile(r"(?P<mark>-{4,}|\.{4,}|={4,}|\*{4,}|_{4,}|/{4,}|\+{4,}|\|={3,}|--)\s*$")
_ADOC_KINDS = {"-": "listing", ".": "literal", "=": "example", "*": "sidebar", "_": "quote", "/": "comment", "+": "passthrough", "|": "table"}
_ADOC_INLINE = re.compile(r"<<(?P<xref>[^,>]+)(?:,(?P<xt>[^>]*))?>>|(?P<macro>\w+):{1,2}(?P<target>[^\s\[]*)\[(?P<attrs>[^\]]*)\]|`(?P<code>[^`]+)`|(?<!\w)\*(?P<st>[^*\s][^*]*)\*(?!\w)|(?<!\w)_(?P<em>[^_\s][^_]*)_(?!\w)|\{(?P<attr>[\w-]+)\}|(?P<url>https?://[^\s\[\]]+)(?:\[(?P<ut>[^\]]*)\])?")


def parse_asciidoc(data: bytes, options: dict) -> Tree:
    """Headings, attributes, delimited blocks, tables, lists, macros and cross references. Includes are never read."""
    text = data.decode("utf-8", "replace")
    tree, byte, lines = Tree("asciidoc"), Offsets(text), physical_lines(text)
    open_, levels, pending = [0], [0], {}

    def inline(body: str, at: int, parent: int) -> None:
        for m in _ADOC_INLINE.finditer(body):
            a, b = byte(min(at + m.start(), len(text))), byte(min(at + m.end(), len(text)))
            if m["xref"]:
                tree.add("xref", parent, m["xref"].lstrip("#").casefold(), None, a, b, text=m["xt"])
            elif m["macro"]:
                if m["macro"] == "xref":
                    tree.add("xref", parent, m["target"].lstrip("#").casefold(), None, a, b, text=m["attrs"])
                else:
                    tree.add("macro", parent, m["macro"], m["target"], a, b, text=m["attrs"])
            elif m["url"]:
                tree.add("link", parent, None, m["url"], a, b, text=m["ut"])
            elif m["attr"]:
                tree.add("attribute_reference", parent, m["attr"], None, a, b)
            else:
                tree.add("inline_code" if m["code"] else "strong" if m["st"] else "emphasis", parent, None, m["code"] or m["st"] or m["em"], a, b)

    i = 0
    while i < len(lines):
        line = lines[i]
        parent = open_[-1]
        if line.blank:
            i += 1
        elif m := re.match(r"(={1,6}|#{1,6})[ \t]+(.+)$", line.text):
            level = len(m[1])
            while levels[-1] >= level:
                levels.pop()
                open_.pop()
            node = tree.add("section", open_[-1], None, m[2].strip(), byte(line.at), byte(line.end), level=level - 1, **pending)
            inline(m[2], line.at + m.start(2), node)
            open_.append(node)
            levels.append(level)
            pending = {}
            i += 1
        elif m := re.match(r":(!?[\w-]+!?):(?:\s+(.*))?$", line.text):
            tree.add("attribute", parent, m[1], m[2], byte(line.at), byte(line.end))
            i += 1
        elif m := re.match(r"\[\[([^\]]+)\]\]\s*$|\[#([\w-]+)[^\]]*\]\s*$", line.text):
            tree.add("anchor", parent, (m[1] or m[2]).split(",")[0].casefold(), None, byte(line.at), byte(line.end))
            i += 1
        elif m := re.match(r"\[([^\]]*)\]\s*$", line.text):
            pending = {"style": m[1]}
            i += 1
        elif m := re.match(r"\.(\w.*)$", line.text):
            pending["title"] = m[1]
            i += 1
        elif m := _ADOC_BLOCK.match(line.text):
            stop = i + 1
            while stop < len(lines) and lines[stop].text.rstrip() != m["mark"]:
                stop += 1
            last = lines[min(stop, len(lines) - 1)]
            kind = "open" if m["mark"] == "--" else _ADOC_KINDS[m["mark"][0]]
            body = "\n".join(x.text for x in lines[i + 1 : stop])
            node = tree.add(kind, parent, None, None if kind == "table" else body, byte(line.at), byte(last.end), **pending)
            if stop == len(lines):
                tree.warn("asciidoc.unterminated_block", m["mark"], byte(line.at), byte(last.end), node)
            if kind == "table":
                for x in lines[i + 1 : stop]:
                    if not x.blank:
                        row = tree.add("table_row", node, None, None, byte(x.at), byte(x.end))
                        for j, cell in enumerate(x.text.split("|")[1:]):
                            tree.add("table_cell", row, str(j), cell.strip())
            pending = {}
            i = stop + 1
        elif m := re.match(r"include::([^\[]+)\[", line.text):
            tree.warn("asciidoc.include_not_read", m[1], byte(line.at), byte(line.end), tree.add("include", parent, None, m[1], byte(line.at), byte(line.end)))
            i += 1
        elif line.text.startswith("//"):
            tree.add("comment", parent, None, line.text[2:].strip(), byte(line.at), byte(line.end))
            i += 1
        elif m := re.match(r"\s*(\*{1,5}|-|\.{1,5}|\d+\.)\s+(.*)$", line.text):
            node = tree.add("list_item", parent, m[1], m[2], byte(line.at), byte(line.end), depth=len(m[1]) if m[1][0] in "*." else 1, **pending)
            inline(m[2], line.at + m.start(2), node)
            pending = {}
            i += 1
        else:
            stop = i
            while stop < len(lines) and not lines[stop].blank and not (stop > i and _ADOC_BLOCK.match(lines[stop].text)):
                stop += 1
            body = text[line.at : lines[stop - 1].end]
            node = tree.add("paragraph", parent, None, body, byte(line.at), byte(lines[stop - 1].end), **pending)
            inline(body, line.at, node)
            pending = {}
            i = stop
    resolve_targets(tree)
    return tree


_TEX = re.compile(r"(?P<comment>(?<!\\)%[^\n]*)|\\(?P<be>begin|end)\s*\{(?P<env>[^{}]*)\}|\\(?P<cmd>[A-Za-z@]+\*?|.)|(?P<dmath>\$\$)|(?P<math>(?<!\\)\$)|(?P<par>\n[ \t]*\n\s*)", re.S)
# What LaTeX commands are, and environments whose content is verbatim or mathematical.
TEX_LEVELS = {"part": 0, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
TEX_REFERENCES = {"ref", "eqref", "pageref", "autoref", "cref", "Cref", "nameref", "vref"}
TEX_CITES = {"cite", "citep", "citet", "autocite", "parencite", "textcite", "footcite", "nocite"}
TEX_VERBATIM = {"verbatim", "verbatim*", "lstlisting", "minted", "comment"}
TEX_TABLES = {"tabular", "tabularx", "longtable"}
TEX_MATH = {"equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "displaymath", "math"}


def _group(text: str, at: int, open_: str = "{", close: str = "}") -> tuple[str, int] | None:
    """(content, place behind it) of the group that begins at the next mark, white space aside."""
    m = re.compile(r"\s*").match(text, at)
    if text[m.end() : m.end() + 1] != open_:
        return None
    depth, i = 0, m.end()
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == open_:
            depth += 1
        elif c == close:
            depth -= 1
            if not depth:
                return text[m.end() + 1 : i], i + 1
        i += 1
    return None


def parse_latex(data: bytes, options: dict) -> Tree:
    """Sections, environments, formulas, labels, references, citations, graphics, macros and includes, which are never
    read. Option macros: how many times macros without arguments are expanded in titles, at most (16)."""
    text = data.decode("utf-8", "replace")
    tree, byte = Tree("latex", root=re.search(r"(?m)^[^%\n]*\\documentclass\b", text) is not None), Offsets(text)
    open_: list[tuple[str, int]] = [("", 0)]
    sections: list[tuple[int, int]] = []
    macros: dict[str, str] = {}
    at, n, run = 0, len(text), 0

    def expanded(s: str) -> str:
        for _ in range(options.get("macros", 16)):
            t = re.sub(r"\\([A-Za-z]+)(?![A-Za-z])\s?", lambda m: macros.get(m[1], m[0]), s)
            if t == s:
                break
            s = t
        return s

    def parent() -> int:
        return open_[-1][1] or (sections[-1][1] if sections else 0)

    def flush(upto: int) -> None:
        body = text[run:upto]
        if open_[-1][0] not in TEX_TABLES and re.sub(r"(?<!\\)%[^\n]*", "", body).strip():
            a = run + len(body) - len(body.lstrip())
            tree.add("paragraph", parent(), None, body.strip(), byte(a), byte(a + len(body.strip())))

    while m := _TEX.search(text, at):
        at = m.end()
        if m["comment"] is not None:
            tree.add("comment", parent(), None, m[0][1:].strip(), byte(m.start()), byte(m.end()))
        elif m["par"]:
            flush(m.start())
            run = at
        elif m["dmath"] or m["math"]:
            mark = m[0]
            end = text.find(mark, at)
            end = n if end == -1 else end
            tree.add("display_math" if m["dmath"] else "inline_math", parent(), None, text[at:end], byte(m.start()), byte(min(n, end + len(mark))))
            at = min(n, end + len(mark))
        elif m["be"] == "begin":
            flush(m.start())
            env = m["env"].strip()
            if env in TEX_VERBATIM or env in TEX_MATH:
                close = text.find(f"\\end{{{env}}}", at)
                stop = n if close == -1 else close
                body = text[at:stop]
                node = tree.add("code_block" if env in TEX_VERBATIM else "equation", parent(), env, body.strip("\n"), byte(m.start()), byte(min(n, stop + len(env) + 6)))
                for label in re.findall(r"\\label\{([^}]*)\}", body) if env in TEX_MATH else ():
                    tree.add("label", node, label)
                at = min(n, stop + len(env) + 6)
            else:
                open_.append((env, tree.add("environment", parent(), env, None, byte(m.start()), None)))
                while (g := _group(text, at, "[", "]")) or env in ("tabular", "tabularx", "array", "longtable", "minipage") and (g := _group(text, at)):
                    tree.set(open_[-1][1], argument=g[0])
                    at = g[1]
                if env in TEX_TABLES:
                    close = text.find(f"\\end{{{env}}}", at)
                    for row in re.split(r"\\\\(?:\[[^\]]*\])?", text[at : n if close == -1 else close]):
                        row = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", row).strip()
                        if row:
                            r = tree.add("table_row", open_[-1][1])
                            for j, cell in enumerate(re.split(r"(?<!\\)&", row)):
                                tree.add("table_cell", r, str(j), visible_latex(cell))
            run = at
        elif m["be"] == "end":
            flush(m.start())
            i = next((i for i in range(len(open_) - 1, 0, -1) if open_[i][0] == m["env"].strip()), None)
            if i is None:
                tree.warn("latex.unmatched_end", m["env"], byte(m.start()), byte(m.end()))
            else:
                for name, node in open_[i + 1 :]:
                    tree.warn("latex.unclosed_environment", name, parent=node)
                tree.rows[open_[i][1]] = (*tree.rows[open_[i][1]][:7], byte(m.end()))
                del open_[i:]
            run = at
        else:
            cmd = m["cmd"].rstrip("*")
            if cmd in TEX_LEVELS:
                flush(m.start())
                short = _group(text, at, "[", "]")
                g = _group(text, short[1] if short else at)
                if g:
                    level = TEX_LEVELS[cmd]
                    while sections and sections[-1][0] >= level:
                        sections.pop()
                    node = tree.add("section", sections[-1][1] if sections else 0, cmd, visible_latex(expanded(g[0])), byte(m.start()), byte(g[1]), level=level, numbered=not m["cmd"].endswith("*"))
                    sections.append((level, node))
                    at = g[1]
                run = at
            elif cmd in ("newcommand", "renewcommand", "def"):
                name = _group(text, at) or ((k := re.compile(r"\s*\\([A-Za-z]+)").match(text, at)) and (k[1], k.end()))
                count = _group(text, name[1], "[", "]") if name else None
                body = _group(text, count[1] if count else name[1]) if name else None
                if body:
                    macro = name[0].strip().lstrip("\\")
                    tree.add("macro", 0, macro, body[0], byte(m.start()), byte(body[1]), arguments=count[0] if count else 0)
                    if not count:
                        macros[macro] = body[0]
                    at = run = body[1]
            elif cmd in TEX_REFERENCES | TEX_CITES | {"label", "includegraphics", "input", "include", "bibliography", "addbibresource", "usepackage", "documentclass", "caption", "footnote", "title", "author", "date", "href", "url"}:
                option = _group(text, at, "[", "]")
                g = _group(text, option[1] if option else at)
                if g:
                    kind = "reference" if cmd in TEX_REFERENCES else "citation" if cmd in TEX_CITES else "include" if cmd in ("input", "include") else "graphic" if cmd == "includegraphics" else "link" if cmd in ("href", "url") else cmd
                    for key in g[0].split(",") if kind in ("reference", "citation", "usepackage") else [g[0]]:
                        shown = visible_latex(expanded(key)) if kind in ("caption", "footnote", "title", "author", "date") else key.strip()
                        node = tree.add(kind, parent(), None if kind not in ("reference", "citation", "label") else shown, shown, byte(m.start()), byte(g[1]), option=option[0] if option else None)
                        if kind == "include":
                            tree.add("diagnostic", node, "latex.include_not_read", shown)
                    if kind not in ("caption", "footnote"):
                        at = g[1]
    flush(n)
    for name, node in open_[1:]:
        tree.warn("latex.unclosed_environment", name, parent=node)
    labels = {r[3] for r in tree.rows if r[2] == "label"}
    for r in tree.rows:
        if r[2] == "reference":
            tree.set(r[0], resolved=r[3] in labels)
    return tree


def visible_latex(text: str) -> str:
    """What a reader sees of LaTeX text: without comments, commands and braces."""
    s = re.sub(r"(?<!\\)%[^\n]*", "", text)
    s = re.sub(r"\\(?:label|ref|cite\w*|eqref|pageref)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", s)
    s = re.sub(r"\\([%&#_{}$ ])", r"\1", s)
    s = re.sub(r"\\\\", " ", s)
    s = re.sub(r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?\s*", "", s)
    return re.sub(r"\s+", " ", s.replace("{", "").replace("}", "").replace("~", " ")).strip()


PARSERS = {
    "text": parse_text, "markdown": parse_markdown, "r_markdown": lambda d, o: parse_markdown(d, o, "r_markdown"), "quarto": lambda d, o: parse_markdown(d, o, "quarto"), "restructured_text": parse_rst, "asciidoc": parse_asciidoc, "latex": parse_latex,
}
