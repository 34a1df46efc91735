"""HTML and XML: exact tokens, a tree, and what hangs on it (links, metadata, tables, media, sections, active content)."""

from __future__ import annotations

import html
import re

from quillspan.formats.base import MAX_DEPTH, Offsets, ParseError, Tree

# Elements without an end tag, elements whose content is text, block elements that end a paragraph, and
# for elements with an optional end tag the start tags that end them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDED_BY = {
    "p": ENDS_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "p": {"td", "th", "li", "div", "section", "article", "body", "button"}}
URL_ATTRS = ("href", "src", "action", "formaction", "data", "xlink:href", "poster", "background")
SECTIONS = frozenset("article aside footer header main nav section h1 h2 h3 h4 h5 h6".split())
MEDIA = frozenset("img picture source video audio track svg canvas".split())
PLUGINS = frozenset("object embed applet".split())

_NAME = r"[A-Za-z][^\s/>]*"
_ATTR = re.compile(r"""\s*(?P<name>[^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<u>[^\s>]+)))?|\s*/(?!>)""")
_TAG_END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*?>""")
_SCRIPT_URL = re.compile(r"(?:javascript|vbscript|data:text/html|data:image/svg\+xml)", re.I)


def tokens(text: str):
    """(kind, name, value, attributes, start, end) of each token: start_tag, end_tag, text, comment, doctype, instruction
    and cdata. Together they cover the text; a tag that does not end is text."""
    at, n, raw = 0, len(text), None
    while at < n:
        if raw:
            m = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(text, at)
            stop = m.start() if m else n
            if stop > at:
                yield "text", None, text[at:stop], {}, at, stop
            at, raw = stop, None
            continue
        lt = text.find("<", at)
        if lt == -1:
            yield "text", None, text[at:], {}, at, n
            return
        if lt > at:
            yield "text", None, text[at:lt], {}, at, lt
            at = lt
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            end = n if end == -1 else end + 3
            yield "comment", None, text[at + 4 : end].removesuffix("-->"), {}, at, end
        elif text.startswith("<![CDATA[", at):
            end = text.find("]]>", at)
            end = n if end == -1 else end + 3
            yield "cdata", None, text[at + 9 : end].removesuffix("]]>"), {}, at, end
        elif text.startswith("<!", at) or text.startswith("<?", at):
            end = text.find(">", at)
            end = n if end == -1 else end + 1
            yield "doctype" if text[at + 1] == "!" else "instruction", None, text[at + 2 : end].rstrip("?>"), {}, at, end
        else:
            m = re.compile(rf"</?({_NAME})").match(text, at)
            e = _TAG_END.match(text, m.end()) if m else None
            if not e:
                end = at + 1
                yield "text", None, text[at:end], {}, at, end
            else:
                end, closing, name = e.end(), text[at + 1] == "/", m[1].lower()
                attrs: dict[str, str] = {}
                for a in _ATTR.finditer(text, m.end(), end - 1):
                    if a["name"]:
                        attrs.setdefault(a["name"].lower(), html.unescape(next((x for x in (a["d"], a["s"], a["u"]) if x is not None), "")))
                yield "end_tag" if closing else "start_tag", name, None, attrs, at, end
                if not closing and name in RAW and text[end - 2] != "/":
                    raw = name
        at = end


def active_kind(tag: str, attrs: dict[str, str]) -> list[tuple[str, str]]:
    """(kind, what) of the active content of an element: it is listed and never run."""
    found = []
    if tag == "script":
        found.append(("script", attrs.get("src", "inline")))
    if tag == "style":
        found.append(("style", "inline"))
    if tag == "form":
        found.append(("form", attrs.get("action", "")))
    if tag in ("iframe", "frame"):
        found.append(("iframe", attrs.get("src", "")))
    if tag in PLUGINS:
        found.append(("plugin", attrs.get("data") or attrs.get("src", "")))
    if tag == "meta" and attrs.get("http-equiv", "").lower() == "refresh":
        found.append(("refresh", attrs.get("content", "")))
    for name, value in attrs.items():
        if name.startswith("on"):
            found.append(("handler", name))
        elif name in URL_ATTRS and _SCRIPT_URL.match(re.sub(r"[\x00-\x20\x7f]", "", value)):
            found.append(("script_url", name))
        elif name == "style":
            found.append(("style", "attribute"))
    return found


def parse_html(data: bytes, options: dict) -> Tree:
    """Elements, text, comments and, below their element, link, metadata, media, section and active_content rows."""
    text = data.decode(options.get("encoding", "utf-8-sig"), "replace")
    byte, tree = Offsets(text), Tree("html")
    open_: list[tuple[str, int]] = [("", 0)]

    def close(upto: int, end: int) -> None:
        while len(open_) > upto:
            _, node = open_.pop()
            tree.rows[node] = (*tree.rows[node][:7], byte(end))

    for kind, name, value, attrs, start, end in tokens(text):
        parent = open_[-1][1]
        if kind == "start_tag":
            for i in range(len(open_) - 1, 0, -1):
                if name in ENDED_BY.get(open_[i][0], ()):
                    close(i, start)
                    break
                if open_[i][0] in SCOPES.get(name, {"table", "body"}):
                    break
            if len(open_) > MAX_DEPTH:
                raise ParseError("nested too deeply", byte(start))
            parent = open_[-1][1]
            node = tree.add("element", parent, name, None, byte(start), byte(end), **{f"@{k}": v for k, v in attrs.items()})
            for k in URL_ATTRS:
                if attrs.get(k) and name != "form":
                    tree.add("media" if name in MEDIA else "link", node, k, attrs[k], byte(start), byte(end), rel=attrs.get("rel"), alt=attrs.get("alt"))
            if name == "meta" and "content" in attrs:
                tree.add("metadata", node, attrs.get("name") or attrs.get("property") or attrs.get("http-equiv") or attrs.get("itemprop"), attrs["content"], byte(start), byte(end))
            if name in SECTIONS:
                tree.add("section", node, name, None, byte(start), byte(end), level=name[1] if name[0] == "h" and name[1:].isdigit() else None)
            for active, what in active_kind(name, attrs):
                tree.add("active_content", node, active, what, byte(start), byte(end), disposition="inert")
            if name not in VOID and text[end - 2] != "/":
                open_.append((name, node))
        elif kind == "end_tag":
            i = next((i for i in range(len(open_) - 1, 0, -1) if open_[i][0] == name), None)
            if i is None:
                tree.add("diagnostic", parent, "html.stray_end_tag", name, byte(start), byte(end))
            else:
                close(i, end)
        elif kind in ("text", "cdata"):
            if value.strip() or options.get("white_space"):
                raw = open_[-1][0] in ("script", "style")
                tree.add("text", parent, None, value if raw or kind == "cdata" else html.unescape(value), byte(start), byte(end))
        else:
            tree.add(kind, parent, None, value.strip(), byte(start), byte(end))
    close(1, len(text))
    return tree


def parse_tokens(data: bytes, options: dict) -> Tree:
    """The token stream as it stands; the tokens' bytes cover the input."""
    text = data.decode("utf-8", "replace")
    byte, tree = Offsets(text), Tree("html_tokens")
    for kind, name, value, attrs, start, end in tokens(text):
        tree.add(kind, 0, name, value, byte(start), byte(end), **{f"@{k}": v for k, v in attrs.items()})
    return tree


def xml_findings(text: str) -> list[tuple[str, str, int]]:
    """(finding, text, place) of what makes XML unsafe to expand: document types, entities, external references."""
    rules = (("doctype", r"<!DOCTYPE"), ("entity_declaration", r"<!ENTITY\s"), ("parameter_entity", r"<!ENTITY\s+%"), ("external_identifier", r"\b(?:SYSTEM|PUBLIC)\s+[\"']"), ("xinclude", r"<xi:include\b"), ("stylesheet", r"<\?xml-stylesheet"))
    return sorted(((name, m[0], m.start()) for name, rule in rules for m in re.finditer(rule, text)), key=lambda x: (x[2], x[0]))


def xml_tree(data: bytes, tree: Tree, top: int = 0) -> int | None:
    """Adds the elements of an XML document below ``top`` with names as {namespace}name, paths and positions. Entities
    that the document declares are not expanded."""
    from xml.parsers import expat

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.ordered_attributes = False
    stack, paths, counts, root = [top], [""], [{}], None

    def name_of(name: str) -> tuple[str, str | None]:
        space, _, local = name.rpartition("}")
        return local, space or None

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal root
        if len(stack) > MAX_DEPTH:
            raise ParseError("nested too deeply", parser.CurrentByteIndex)
        local, space = name_of(name)
        counts[-1][local] = n = counts[-1].get(local, 0) + 1
        path = f"{paths[-1]}/{local}[{n}]"
        node = tree.add("element", stack[-1], local, None, parser.CurrentByteIndex, None, namespace=space, path=path, **{f"@{name_of(k)[0]}": v for k, v in attrs.items()})
        root = node if root is None else root
        stack.append(node)
        paths.append(path)
        counts.append({})

    def end(name: str) -> None:
        node = stack.pop()
        tree.rows[node] = (*tree.rows[node][:7], parser.CurrentByteIndex)
        paths.pop()
        counts.pop()

    def chars(value: str) -> None:
        if value.strip():
            tree.add("text", stack[-1], None, value, parser.CurrentByteIndex)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.CommentHandler = lambda value: tree.add("comment", stack[-1], None, value, parser.CurrentByteIndex)
    parser.ProcessingInstructionHandler = lambda target, value: tree.add("instruction", stack[-1], target, value, parser.CurrentByteIndex)

    def entity(name, *_):
        tree.warn("xml.entity_declaration", f"entity {name} is not expanded", parser.CurrentByteIndex)

    parser.EntityDeclHandler = entity
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    parser.DefaultHandler = lambda value: tree.add("entity_reference", stack[-1], value[1:-1], None, parser.CurrentByteIndex) if value.startswith("&") else None
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        tree.warn("xml.malformed", expat.errors.messages.get(e.code, str(e)), parser.ErrorByteIndex)
    return root


def parse_xml(data: bytes, options: dict) -> Tree:
    """Elements with namespace and path, and the findings of the security look before parsing."""
    tree = Tree("xml")
    for finding, text, at in xml_findings(data.decode("utf-8", "replace")):
        tree.add("finding", 0, finding, text, at)
    root = xml_tree(data, tree)
    tree.set(0, root=None if root is None else tree.rows[root][3])
    return tree


def parse_jats(data: bytes, options: dict) -> Tree:
    """XML, and a reference row for each id an ``xref`` names: resolved, unresolved or ambiguous."""
    tree = parse_xml(data, options)
    tree.rows[0] = (0, None, "document", "jats", *tree.rows[0][4:])
    ids: dict[str, list[int]] = {}
    for row in tree.rows:
        if row[2] == "element" and "@id" in row[5]:
            ids.setdefault(row[5]["@id"], []).append(row[0])
    for row in [r for r in tree.rows if r[2] == "element" and r[3] == "xref" and r[5].get("@rid")]:
        for rid in row[5]["@rid"].split():
            found = ids.get(rid, [])
            tree.add("reference", row[0], rid, found[0] if found else None, row[6], row[7], status="unresolved" if not found else "resolved" if len(found) == 1 else "ambiguous", type=row[5].get("@ref-type"))
    return tree


PARSERS = {"html": parse_html, "xhtml": parse_html, "html_tokens": parse_tokens, "xml": parse_xml, "jats": parse_jats}
