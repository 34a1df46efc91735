"""Office packages: word processing, presentations and spreadsheets of both families, EPUB, RTF and PDF."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from urllib.parse import unquote
from xml.etree import ElementTree

from quillspan.formats.base import MAX_DEPTH, ParseError, Tree
from quillspan.formats.web import parse_html, xml_findings

#: Bytes that the members of a package may unpack to, and how much more than packed.
MAX_UNPACKED = 512 << 20
MAX_RATIO = 100


class Package:
    """The parts of a ZIP package, read under a bound, with their relationships."""

    def __init__(self, data: bytes, tree: Tree):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ParseError("no ZIP package") from e
        self.tree = tree
        self.names = {i.filename: i for i in self.zip.infolist()}
        if sum(i.file_size for i in self.names.values()) > min(MAX_UNPACKED, max(1 << 20, MAX_RATIO * len(data))):
            raise ParseError("package unpacks to more than its budget")
        if any(i.flag_bits & 1 for i in self.names.values()):
            tree.warn("package.encrypted", "members are encrypted")

    def read(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.names else None

    def xml(self, name: str) -> ElementTree.Element | None:
        """A part as a tree without document types; None if it is missing or damaged."""
        data = self.read(name)
        if data is None:
            return None
        if any(f[0] in ("doctype", "entity_declaration") for f in xml_findings(data[:4096].decode("utf-8", "replace"))):
            self.tree.warn("package.document_type", name)
            return None
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            self.tree.warn("package.malformed_part", f"{name}: {e}")
            return None

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """Relationship id to (target part or address, type, whether it is external)."""
        folder, name = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", name + ".rels"))
        out = {}
        for r in root if root is not None else ():
            external = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            out[r.get("Id", "")] = (target if external else resolve_target(part, target) or target, r.get("Type", "").rsplit("/", 1)[-1], external)
        return out


def resolve_target(source: str | None, target: str) -> str | None:
    """The part a relationship of ``source`` points to; None if it leaves the package."""
    path = unquote(target.split("#")[0]).replace("\\", "/")
    joined = posixpath.normpath(path.lstrip("/") if path.startswith("/") else posixpath.join(posixpath.dirname(source or ""), path))
    return None if joined.startswith("..") or joined == "." else joined


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _find(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        e = next((c for c in e if _local(c) == name), None) if e is not None else None
    return e


def _iter(e: ElementTree.Element | None, *names: str):
    return (c for c in e.iter() if _local(c) in names) if e is not None else ()


def _metadata(package: Package, tree: Tree) -> None:
    for part in ("docProps/core.xml", "docProps/app.xml", "meta.xml"):
        for e in _iter(package.xml(part), "title", "creator", "subject", "keywords", "description", "created", "modified", "creation-date", "date", "Application", "Company", "initial-creator"):
            if e.text:
                tree.add("metadata", 0, _local(e), e.text)


def _active(package: Package, tree: Tree) -> None:
    for name, info in package.names.items():
        if re.search(r"vbaProject\.bin$|activeX/|embeddings/|Basic/|Scripts/", name) and not name.endswith("/"):
            tree.add("quarantined", 0, name, None, bytes=info.file_size, disposition="inert")


def _run_text(e: ElementTree.Element) -> str:
    out = []
    for c in e.iter():
        name = _local(c)
        if name in ("t", "delText") and c.text:
            out.append(c.text)
        elif name == "tab" and not len(c.attrib):
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def parse_docx(data: bytes, options: dict) -> Tree:
    """Headings, paragraphs, list items, tables, links, comments, notes, revisions and pictures."""
    tree = Tree("docx")
    package = Package(data, tree)
    body = _find(package.xml("word/document.xml"), "body")
    if body is None:
        raise ParseError("no main document part")
    _metadata(package, tree)
    _active(package, tree)
    styles = {_attr(s, "styleId"): (_attr(_find(s, "name"), "val") if _find(s, "name") is not None else None) for s in _iter(package.xml("word/styles.xml"), "style")}
    relations = package.relations("word/document.xml")

    def paragraph(p: ElementTree.Element, parent: int) -> None:
        props = _find(p, "pPr")
        style = _find(props, "pStyle")
        name = styles.get(_attr(style, "val"), _attr(style, "val")) if style is not None else None
        level = re.fullmatch(r"(?i)heading\s*(\d)", name or "")
        outline = _find(props, "outlineLvl")
        item = _find(props, "numPr")
        kind = "heading" if level or outline is not None else "list_item" if item is not None else "paragraph"
        depth = _find(item, "ilvl")
        node = tree.add(kind, parent, None, _run_text(p), style=name, level=level[1] if level else int(_attr(outline, "val") or 0) + 1 if outline is not None else _attr(depth, "val") if depth is not None else None)
        for e in _iter(p, "hyperlink", "ins", "del", "commentReference", "footnoteReference", "endnoteReference", "blip", "instrText", "oMath"):
            what = _local(e)
            if what == "hyperlink":
                target = relations.get(_attr(e, "id") or "", (None, None, None))
                tree.add("link", node, _attr(e, "anchor"), target[0], text=_run_text(e), external=target[2])
            elif what in ("ins", "del"):
                tree.add("revision", node, "insertion" if what == "ins" else "deletion", _run_text(e), author=_attr(e, "author"), date=_attr(e, "date"))
            elif what == "blip":
                tree.add("image", node, _attr(e, "embed"), relations.get(_attr(e, "embed") or "", (None,))[0])
            elif what == "instrText":
                tree.add("field", node, None, e.text, executed=False)
            elif what == "oMath":
                tree.add("equation", node, None, "".join(t.text or "" for t in _iter(e, "t")))
            else:
                tree.add("reference", node, what.removesuffix("Reference"), _attr(e, "id"))

    def blocks(e: ElementTree.Element, parent: int, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise ParseError("nested too deeply")
        for c in e:
            what = _local(c)
            if what == "p":
                paragraph(c, parent)
            elif what == "tbl":
                table = tree.add("table", parent)
                for tr in (x for x in c if _local(x) == "tr"):
                    row = tree.add("table_row", table)
                    for j, tc in enumerate(x for x in tr if _local(x) == "tc"):
                        span = _find(tc, "tcPr", "gridSpan")
                        cell = tree.add("table_cell", row, str(j), "\n".join(_run_text(p) for p in tc if _local(p) == "p"), span=_attr(span, "val") if span is not None else None)
                        for inner in (x for x in tc if _local(x) == "tbl"):
                            blocks(tc if inner is None else _wrap(inner), cell, depth + 1)
            elif what in ("sdt", "sdtContent", "customXml", "ins"):
                blocks(c, parent, depth + 1)

    blocks(body, 0, 0)
    for part, kind in (("word/comments.xml", "comment"), ("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
        for e in _iter(package.xml(part), kind):
            if (text := _run_text(e)).strip():
                tree.add(kind, 0, _attr(e, "id"), text, author=_attr(e, "author"))
    for name in sorted(package.names):
        if re.fullmatch(r"word/(?:header|footer)\d*\.xml", name) and (text := _run_text(package.xml(name) or ElementTree.Element("x"))).strip():
            tree.add("header" if "header" in name else "footer", 0, name, text)
    return tree


def _wrap(e: ElementTree.Element) -> ElementTree.Element:
    box = ElementTree.Element("box")
    box.append(e)
    return box


def parse_pptx(data: bytes, options: dict) -> Tree:
    """Slides in order with their shapes, tables, notes and links."""
    tree = Tree("pptx")
    package = Package(data, tree)
    show = package.xml("ppt/presentation.xml")
    if show is None:
        raise ParseError("no presentation part")
    _metadata(package, tree)
    _active(package, tree)
    relations = package.relations("ppt/presentation.xml")
    for i, e in enumerate(_iter(show, "sldId")):
        rid = next((v for k, v in e.attrib.items() if k.endswith("}id")), "")
        part = relations.get(rid, ("",))[0]
        slide, links = package.xml(part), package.relations(part)
        node = tree.add("slide", 0, part, None, number=i + 1, hidden=slide is not None and slide.get("show") == "0" or None)
        layout = next((t for t, kind, _ in links.values() if kind == "slideLayout"), None)
        tree.set(node, layout=layout)
        for z, shape in enumerate(_iter(_find(slide, "cSld", "spTree"), "sp", "pic", "graphicFrame", "cxnSp")):
            props = next(_iter(shape, "cNvPr"), None)
            holder = next(_iter(shape, "ph"), None)
            lines = ["".join(t.text or "" for t in _iter(p, "t")) for p in _iter(_find(shape, "txBody"), "p")]
            kind = {"pic": "image", "graphicFrame": "frame", "cxnSp": "connector"}.get(_local(shape), "shape")
            s = tree.add(kind, node, props.get("name") if props is not None else None, "\n".join(lines) or None, z=z, placeholder=holder.get("type", "body") if holder is not None else None)
            for row in _iter(shape, "tr"):
                r = tree.add("table_row", s)
                for j, tc in enumerate(x for x in row if _local(x) == "tc"):
                    tree.add("table_cell", r, str(j), "".join(t.text or "" for t in _iter(tc, "t")))
            for link in _iter(shape, "hlinkClick", "blip"):
                rid = _attr(link, "id") or _attr(link, "embed") or ""
                tree.add("action" if link.get("action") else "link", s, link.get("action"), links.get(rid, (None,))[0], executed=False)
        for target, kind, _ in links.values():
            if kind == "notesSlide":
                tree.add("notes", node, target, "\n".join("".join(t.text or "" for t in _iter(p, "t")) for p in _iter(package.xml(target), "p")))
    return tree


_CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?([1-9]\d{0,6})\Z")


def cell_address(reference: str) -> tuple[int, int] | None:
    """(row, column) from 0 of an A1 reference."""
    m = _CELL.match(reference)
    if not m:
        return None
    column = 0
    for c in m[1].upper():
        column = column * 26 + ord(c) - 64
    return int(m[2]) - 1, column - 1


def formula_references(formula: str) -> list[str]:
    """The cells and ranges a formula names, without dollar signs, each once and in order of their letters."""
    bare = re.sub(r'"[^"]*"', "", formula)
    return sorted({m[0].replace("$", "").upper() for m in re.finditer(r"(?<![\w.])\$?[A-Za-z]{1,3}\$?[1-9]\d*(?::\$?[A-Za-z]{1,3}\$?[1-9]\d*)?(?![\w(])", bare)})


def parse_xlsx(data: bytes, options: dict) -> Tree:
    """Sheets with cells (name is the address, value as shown), formulas with their stored results, merges, names, tables
    and comments. Formulas are never calculated."""
    tree = Tree("xlsx")
    package = Package(data, tree)
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise ParseError("no workbook part")
    _metadata(package, tree)
    _active(package, tree)
    shared = ["".join(t.text or "" for t in _iter(si, "t") if True) for si in _iter(package.xml("xl/sharedStrings.xml"), "si")]
    styles = package.xml("xl/styles.xml")
    formats = {f.get("numFmtId"): f.get("formatCode") for f in _iter(styles, "numFmt")}
    cell_formats = [x.get("numFmtId") for x in (_find(styles, "cellXfs") if _find(styles, "cellXfs") is not None else ())]
    relations = package.relations("xl/workbook.xml")
    for e in _iter(book, "definedName"):
        tree.add("defined_name", 0, e.get("name"), e.text)
    for sheet in _iter(book, "sheet"):
        rid = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), "")
        part = relations.get(rid, ("",))[0]
        node = tree.add("sheet", 0, sheet.get("name"), None, state=sheet.get("state", "visible"), part=part)
        root = package.xml(part)
        for c in _iter(root, "c"):
            at = cell_address(c.get("r", "")) or (None, None)
            kind, v, f = c.get("t", "n"), _find(c, "v"), _find(c, "f")
            raw = v.text if v is not None else None
            if kind == "s" and raw is not None:
                value, shown = (shared[int(raw)], "string") if raw.isdigit() and int(raw) < len(shared) else (None, "error")
                if shown == "error":
                    tree.warn("xlsx.missing_shared_string", raw, parent=node)
            elif kind == "inlineStr":
                value, shown = "".join(t.text or "" for t in _iter(c, "t")), "string"
            else:
                value, shown = raw, {"b": "boolean", "e": "error", "str": "string", "d": "date"}.get(kind, "number" if raw is not None else "empty")
            style = int(c.get("s", 0))
            number = cell_formats[style] if style < len(cell_formats) else None
            cell = tree.add("cell", node, c.get("r"), value, type=shown, row=at[0], column=at[1], format=formats.get(number, number) if number not in (None, "0") else None)
            if f is not None:
                formula = tree.add("formula", cell, f.get("t"), f.text, calculated=False, range=f.get("ref"))
                for ref in formula_references(f.text or ""):
                    tree.add("reference", formula, ref)
        for e in _iter(root, "mergeCell", "hyperlink"):
            tree.add("merge" if _local(e) == "mergeCell" else "link", node, e.get("ref"), e.get("location"))
        for target, what, _ in package.relations(part).values():
            if what == "table" and (t := package.xml(target)) is not None:
                tree.add("table", node, t.get("displayName"), t.get("ref"))
            elif what == "comments":
                for e in _iter(package.xml(target), "comment"):
                    tree.add("comment", node, e.get("ref"), "".join(t.text or "" for t in _iter(e, "t")))
    return tree


def _odf_text(e: ElementTree.Element) -> str:
    out = [e.text or ""]
    for c in e:
        name = _local(c)
        out.append(" " * int(_attr(c, "c") or 1) if name == "s" else "\t" if name == "tab" else "\n" if name == "line-break" else "" if name in ("annotation", "note") else _odf_text(c))
        out.append(c.tail or "")
    return "".join(out)


def _odf(data: bytes, tree: Tree) -> tuple[Package, ElementTree.Element]:
    package = Package(data, tree)
    body = _find(package.xml("content.xml"), "body")
    if body is None or not len(body):
        raise ParseError("no content part")
    _metadata(package, tree)
    _active(package, tree)
    return package, body[0]


def _odf_blocks(tree: Tree, e: ElementTree.Element, parent: int, depth: int = 0) -> None:
    if depth > MAX_DEPTH:
        raise ParseError("nested too deeply")
    for c in e:
        what = _local(c)
        if what in ("h", "p"):
            node = tree.add("heading" if what == "h" else "paragraph", parent, None, _odf_text(c), level=_attr(c, "outline-level") if what == "h" else None, style=_attr(c, "style-name"))
            for x in _iter(c, "a", "image", "annotation", "note"):
                kind = {"a": "link", "image": "image", "annotation": "comment", "note": "footnote"}[_local(x)]
                tree.add(kind, node, None, _attr(x, "href") if kind in ("link", "image") else "".join(_odf_text(p) for p in _iter(x, "p")))
        elif what == "list":
            node = tree.add("list", parent)
            for item in (x for x in c if _local(x) == "list-item"):
                _odf_blocks(tree, item, tree.add("list_item", node), depth + 1)
        elif what == "table":
            node = tree.add("table", parent, _attr(c, "name"))
            for row in _iter(c, "table-row"):
                r = tree.add("table_row", node)
                for j, cell in enumerate(x for x in row if _local(x) in ("table-cell", "covered-table-cell")):
                    tree.add("table_cell", r, str(j), "\n".join(_odf_text(p) for p in cell if _local(p) == "p"))
        elif what == "tracked-changes":
            for x in _iter(c, "changed-region"):
                kind = next((_local(y) for y in x if _local(y) in ("insertion", "deletion", "format-change")), None)
                tree.add("revision", parent, kind, "".join(_odf_text(p) for p in _iter(x, "p")), author=next((y.text for y in _iter(x, "creator")), None))
        elif what in ("section", "text-box", "frame", "index-body", "table-of-content"):
            _odf_blocks(tree, c, tree.add("section", parent, _attr(c, "name")), depth + 1)


def parse_odt(data: bytes, options: dict) -> Tree:
    tree = Tree("odt")
    _odf_blocks(tree, _odf(data, tree)[1], 0)
    return tree


def parse_odp(data: bytes, options: dict) -> Tree:
    """Slides; shapes in reading order: by their top, then their left edge."""
    tree = Tree("odp")

    def place(e: ElementTree.Element) -> tuple[float, float]:
        return tuple(float(re.sub(r"[a-z%]+$", "", _attr(e, k) or "") or 1e9) for k in ("y", "x"))

    for i, page in enumerate(_iter(_odf(data, tree)[1], "page")):
        node = tree.add("slide", 0, _attr(page, "name"), None, number=i + 1, master=_attr(page, "master-page-name"))
        for shape in sorted((c for c in page if _local(c) in ("frame", "custom-shape", "rect", "g")), key=place):
            s = tree.add("shape", node, _attr(shape, "name"), "\n".join(_odf_text(p) for p in _iter(shape, "p")) or None, role=_attr(shape, "class"))
            for row in _iter(shape, "table-row"):
                r = tree.add("table_row", s)
                for j, cell in enumerate(x for x in row if _local(x) == "table-cell"):
                    tree.add("table_cell", r, str(j), "".join(_odf_text(p) for p in _iter(cell, "p")))
        for notes in (c for c in page if _local(c) == "notes"):
            tree.add("notes", node, None, "\n".join(_odf_text(p) for p in _iter(notes, "p")))
    return tree


def parse_ods(data: bytes, options: dict) -> Tree:
    """Sheets with cells; repeated rows and columns are expanded where they hold something. Option max_cells (1,000,000)."""
    tree, budget = Tree("ods"), options.get("max_cells", 1_000_000)
    _, body = _odf(data, tree)
    for e in _iter(body, "named-range"):
        tree.add("defined_name", 0, _attr(e, "name"), _attr(e, "cell-range-address"))
    for sheet in (c for c in body if _local(c) == "table"):
        node, row = tree.add("sheet", 0, _attr(sheet, "name")), 0
        for tr in _iter(sheet, "table-row"):
            cells, column = [], 0
            for c in (x for x in tr if _local(x) in ("table-cell", "covered-table-cell")):
                n = int(_attr(c, "number-columns-repeated") or 1)
                kind, shown = _attr(c, "value-type"), "\n".join(_odf_text(p) for p in c if _local(p) == "p")
                value = _attr(c, "value") or _attr(c, "date-value") or _attr(c, "time-value") or _attr(c, "boolean-value") or shown
                if kind or shown or _attr(c, "formula"):
                    cells += [(column + k, kind, value, shown, _attr(c, "formula"), _attr(c, "number-columns-spanned")) for k in range(n)]
                column += n
            times = int(_attr(tr, "number-rows-repeated") or 1)
            for k in range(times if cells else 0):
                for column, kind, value, shown, formula, span in cells:
                    budget -= 1
                    if budget < 0:
                        tree.warn("budget.cells.exhausted", "more cells than the budget", parent=node)
                        return tree
                    cell = tree.add("cell", node, f"{row + k},{column}", value, type=kind or "string", row=row + k, column=column, shown=shown if shown != value else None, span=span)
                    if formula:
                        tree.add("formula", cell, None, formula, calculated=False)
            row += times
    return tree


def parse_epub(data: bytes, options: dict) -> Tree:
    """Metadata, manifest, spine in order with the HTML tree of each chapter, and the table of contents."""
    tree = Tree("epub")
    package = Package(data, tree)
    box = package.xml("META-INF/container.xml")
    top = next((e.get("full-path") for e in _iter(box, "rootfile")), None)
    opf = package.xml(top) if top else None
    if opf is None:
        raise ParseError("no package document")
    for e in _find(opf, "metadata") if _find(opf, "metadata") is not None else ():
        tree.add("metadata", 0, _local(e), e.text, property=e.get("property"))
    items = {}
    for e in _iter(_find(opf, "manifest"), "item"):
        part = resolve_target(top, e.get("href", ""))
        items[e.get("id")] = (part, e.get("media-type"))
        tree.add("item", 0, e.get("id"), part, media_type=e.get("media-type"), properties=e.get("properties"), present=part in package.names)
    for i, e in enumerate(_iter(_find(opf, "spine"), "itemref")):
        part = items.get(e.get("idref"), (None, None))[0]
        body = package.read(part) if part else None
        node = tree.add("chapter", 0, part, None, position=i, linear=e.get("linear", "yes"))
        if body is None:
            tree.warn("epub.missing_chapter", str(e.get("idref")), parent=node)
            continue
        for r in parse_html(body, options).rows[1:]:
            tree.rows.append((r[0] + node, r[1] + node, *r[2:]))
    for part, media in items.values():
        root = package.xml(part) if part and (media == "application/x-dtbncx+xml" or part.endswith("nav.xhtml")) else None
        for e in _iter(root, "navPoint"):
            tree.add("navigation", 0, "".join(t.text or "" for t in _iter(_find(e, "navLabel"), "text")), resolve_target(part, next((c.get("src", "") for c in e if _local(c) == "content"), "")))
        for e in _iter(_find(root, "body"), "a") if root is not None and part.endswith(".xhtml") else ():
            tree.add("navigation", 0, "".join(e.itertext()), resolve_target(part, e.get("href", "")))
    return tree


_RTF = re.compile(rb"\\([A-Za-z]+)(-?\d+)? ?|\\'([0-9A-Fa-f]{2})|\\([^A-Za-z])|([{}])|\r?\n|([^\\{}\r\n]+)")
# Destinations that hold no text of the document, code pages and characters of control words.
RTF_SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr listtable listoverridetable generator rsidtbl themedata datastore xmlnstbl latentstyles mmathPr".split())
RTF_CHARS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "cell": "\t", "row": "\n"}


def parse_rtf(data: bytes, options: dict) -> Tree:
    """Paragraphs, table rows, fields, info and what was left out (pictures, objects)."""
    if not data.startswith(b"{\\rtf"):
        raise ParseError("no RTF header", 0)
    tree = Tree("rtf")
    codec, skip_after, out, cells, info = "cp1252", 1, [], [], []
    stack: list[dict] = []
    state = {"skip": None, "uc": 1, "dest": None}
    pending = 0
    style: dict = {}

    def flush() -> None:
        text = "".join(out).strip("\n")
        out.clear()
        if text:
            tree.add("heading" if "outline" in style else "paragraph", 0, None, text, level=style.get("outline"))

    def text(s: str) -> None:
        if state["dest"] == "fldinst":
            tree.add("field", 0, None, s.strip(), executed=False)
        elif state["skip"] == "info" and state["dest"]:
            tree.add("metadata", 0, state["dest"], s)
        elif not state["skip"]:
            out.append(s)

    for m in _RTF.finditer(data):
        if m[5] == b"{":
            if len(stack) > MAX_DEPTH:
                raise ParseError("nested too deeply", m.start())
            stack.append(dict(state))
        elif m[5] == b"}":
            if not stack:
                tree.warn("rtf.unmatched_brace", "}", m.start())
                continue
            state = stack.pop()
        elif m[1]:
            word, n = m[1].decode(), int(m[2]) if m[2] else None
            if word == "ansicpg":
                codec = f"cp{n}"
            elif word == "uc":
                state["uc"] = n or 0
            elif word == "u":
                text(chr(n % 65536))
                pending = state["uc"]
            elif word in RTF_SKIPPED:
                state["skip"] = word
                if word in ("pict", "object"):
                    tree.add("embedded", 0, word, None, m.start())
            elif word == "fldinst" or state["skip"] == "info":
                state["dest"] = word
            elif word == "par":
                flush()
                style = {k: v for k, v in style.items() if k != "outline"}
            elif word == "pard":
                style = {}
            elif word == "outlinelevel":
                style["outline"] = (n or 0) + 1
            elif word == "cell" and not state["skip"]:
                cells.append("".join(out).strip())
                out.clear()
            elif word == "row":
                row = tree.add("table_row", 0)
                for j, c in enumerate(cells):
                    tree.add("table_cell", row, str(j), c)
                cells = []
            elif word in RTF_CHARS:
                text(RTF_CHARS[word])
            elif word == "bin":
                tree.warn("rtf.binary_left_out", str(n), m.start())
        elif m[3]:
            if pending:
                pending -= 1
                continue
            try:
                text(bytes([int(m[3], 16)]).decode(codec, "replace"))
            except LookupError:
                text(bytes([int(m[3], 16)]).decode("cp1252", "replace"))
        elif m[4]:
            if m[4] == b"*":
                state["skip"] = state["skip"] or "*"
            elif m[4] in (b"\\", b"{", b"}"):
                text(m[4].decode())
            elif m[4] == b"~":
                text("\xa0")
        elif m[6]:
            s = m[6].decode(codec if codec != "cp0" else "cp1252", "replace")
            cut = min(pending, len(s))
            pending -= cut
            text(s[cut:])
    flush()
    if stack:
        tree.warn("rtf.unclosed_group", str(len(stack)), len(data))
    return tree


_PDF_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_PDF_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(?:(?P<dict><<)|(?P<end>>>)|(?P<arr>\[)|(?P<close>\])|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<ref>\d+\s+\d+\s+R(?![A-Za-z]))|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|/(?P<name>[^\s()<>\[\]{}/%]*)|(?P<str>\()|(?P<word>[A-Za-z'\"*]+[0-9]*\*?))")


def _pdf_string(data: bytes, at: int) -> tuple[bytes, int]:
    depth, out, i = 1, bytearray(), at
    while i < len(data) and depth:
        c = data[i]
        if c == 0x5C and i + 1 < len(data):
            n = data[i + 1]
            if 0x30 <= n <= 0x37:
                m = re.compile(rb"[0-7]{1,3}").match(data, i + 1)
                out.append(int(m[0], 8) & 255)
                i = m.end()
                continue
            out += {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\b", 0x66: b"\f", 0x0A: b"", 0x0D: b""}.get(n, bytes([n]))
            i += 2
            continue
        depth += (c == 0x28) - (c == 0x29)
        if depth:
            out.append(c)
        i += 1
    return bytes(out), i


def _pdf_value(data: bytes, at: int, depth: int = 0):
    """(value, place behind it): dictionaries, lists, ("ref", n), ("name", s), bytes, numbers and words."""
    m = _PDF_TOKEN.match(data, at)
    if not m or depth > MAX_DEPTH:
        raise ParseError("bad object", at)
    if m["dict"]:
        out, at = {}, m.end()
        while not (e := re.compile(rb"\s*>>").match(data, at)):
            key, at = _pdf_value(data, at, depth + 1)
            value, at = _pdf_value(data, at, depth + 1)
            out[key[1] if isinstance(key, tuple) else str(key)] = value
        return out, e.end()
    if m["arr"]:
        out, at = [], m.end()
        while not (e := re.compile(rb"\s*\]").match(data, at)):
            value, at = _pdf_value(data, at, depth + 1)
            out.append(value)
        return out, e.end()
    if m["ref"]:
        return ("ref", int(m["ref"].split()[0])), m.end()
    if m["num"]:
        return (float(m["num"]) if b"." in m["num"] else int(m["num"])), m.end()
    if m["name"] is not None:
        return ("name", re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m["name"]).decode("latin-1")), m.end()
    if m["hex"]:
        raw = re.sub(rb"\s", b"", m["hex"][1:-1])
        return bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode()), m.end()
    if m["str"]:
        return _pdf_string(data, m.end())
    return ("word", (m["word"] or m["end"] or m["close"]).decode()), m.end()


def _pdf_text(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def parse_pdf(data: bytes, options: dict) -> Tree:
    """Metadata, pages with the text they show, links, form fields and attachments. Fonts with encodings of their own give
    text only as far as their bytes are Latin; such pages say so. Encrypted files have metadata alone."""
    if b"%PDF-" not in data[:1024]:
        raise ParseError("no PDF header", 0)
    tree = Tree("pdf", version=data[data.index(b"%PDF-") + 5 :][:3])
    objects: dict[int, tuple[object, bytes | None]] = {}

    def stream(head: object, body: bytes) -> bytes | None:
        filters = head.get("Filter", []) if isinstance(head, dict) else []
        for f in filters if isinstance(filters, list) else [filters]:
            if f == ("name", "FlateDecode"):
                try:
                    body = zlib.decompressobj().decompress(body, MAX_UNPACKED)
                except zlib.error:
                    return None
            elif f == ("name", "ASCIIHexDecode"):
                body = bytes.fromhex(re.sub(rb"[\s>]", b"", body).decode("latin-1"))
            else:
                return None
        parms = head.get("DecodeParms") if isinstance(head, dict) else None
        if isinstance(parms, dict) and parms.get("Predictor", 1) >= 10:
            width, out, prev = parms.get("Columns", 1), bytearray(), bytearray(parms.get("Columns", 1))
            for k in range(0, len(body), width + 1):
                row = bytearray(body[k + 1 : k + 1 + width])
                if body[k] == 2:
                    row = bytearray((a + b) & 255 for a, b in zip(row, prev))
                out += row
                prev = row
            body = bytes(out)
        return body

    for m in _PDF_OBJECT.finditer(data):
        try:
            value, at = _pdf_value(data, m.end())
        except (ParseError, ValueError):
            tree.warn("pdf.malformed_object", m[1].decode(), m.start())
            continue
        s = re.compile(rb"\s*stream\r?\n").match(data, at)
        body = None
        if s and isinstance(value, dict):
            length = value.get("Length")
            stop = s.end() + length if isinstance(length, int) and data[s.end() + length :][:12].lstrip().startswith(b"endstream") else data.find(b"endstream", s.end())
            body = data[s.end() : stop if stop != -1 else len(data)]
        objects[int(m[1])] = (value, body)
    for value, body in list(objects.values()):
        if isinstance(value, dict) and value.get("Type") == ("name", "ObjStm") and body is not None:
            raw = stream(value, body) or b""
            heads = raw[: value.get("First", 0)].split()
            for k in range(0, len(heads) - 1, 2):
                try:
                    objects.setdefault(int(heads[k]), (_pdf_value(raw, value["First"] + int(heads[k + 1]))[0], None))
                except (ParseError, ValueError, KeyError):
                    tree.warn("pdf.malformed_object", heads[k].decode())

    def resolve(v: object, depth: int = 0) -> object:
        while isinstance(v, tuple) and v[0] == "ref" and depth < 32:
            v, depth = objects.get(v[1], (None, None))[0], depth + 1
        return v

    trailers = [_pdf_value(data, m.end())[0] for m in re.finditer(rb"trailer\s*(?=<<)", data)] + [v for v, _ in objects.values() if isinstance(v, dict) and v.get("Type") == ("name", "XRef")]
    trailer = next((t for t in reversed(trailers) if "Root" in t), {})
    info = resolve(trailer.get("Info"))
    for k, v in (info or {}).items() if isinstance(info, dict) else ():
        if isinstance(resolve(v), bytes):
            tree.add("metadata", 0, k, _pdf_text(resolve(v)))
    if "Encrypt" in trailer:
        tree.warn("pdf.encrypted", "a decryption provider is needed")
        return tree
    root = resolve(trailer.get("Root")) or next((v for v, _ in objects.values() if isinstance(v, dict) and v.get("Type") == ("name", "Catalog")), {})
    pages: list[tuple[dict, dict]] = []

    def walk(v: object, inherited: dict, depth: int, seen: frozenset) -> None:
        key = v[1] if isinstance(v, tuple) else None
        page = resolve(v)
        if not isinstance(page, dict) or depth > MAX_DEPTH or key in seen:
            return
        inherited = inherited | {k: page[k] for k in ("MediaBox", "Resources", "Rotate") if k in page}
        if "Kids" in page:
            for kid in resolve(page["Kids"]) or []:
                walk(kid, inherited, depth + 1, seen | {key})
        else:
            pages.append((page, inherited))

    walk(root.get("Pages") if isinstance(root, dict) else None, {}, 0, frozenset())
    for number, (page, inherited) in enumerate(pages, 1):
        box = resolve(inherited.get("MediaBox")) or []
        node = tree.add("page", 0, str(number), None, media_box=" ".join(map(str, box)) or None, rotate=inherited.get("Rotate"))
        contents = page.get("Contents")
        parts = resolve(contents)
        raw = b"\n".join((stream(*objects[r[1]]) or b"") for r in (parts if isinstance(parts, list) else [contents]) if isinstance(r, tuple) and r[0] == "ref" and r[1] in objects and objects[r[1]][1] is not None)
        for i, line in enumerate(_pdf_lines(raw)):
            tree.add("line", node, str(i), line)
        fonts = resolve((resolve(inherited.get("Resources")) or {}).get("Font")) if isinstance(resolve(inherited.get("Resources")), dict) else None
        if isinstance(fonts, dict) and any(isinstance(resolve(f), dict) and resolve(f).get("Subtype") == ("name", "Type0") for f in fonts.values()):
            tree.add("diagnostic", node, "pdf.font_encoding", "a composite font's text is not mapped")
        for a in resolve(page.get("Annots")) or []:
            a = resolve(a)
            if isinstance(a, dict):
                action = resolve(a.get("A")) or {}
                uri = resolve(action.get("URI")) if isinstance(action, dict) else None
                kind = a.get("Subtype", ("", ""))[1]
                if kind == "Link" and isinstance(uri, bytes):
                    tree.add("link", node, None, _pdf_text(uri))
                elif kind == "Widget":
                    tree.add("form_field", node, _pdf_text(resolve(a.get("T")) or b""), _pdf_text(resolve(a.get("V"))) if isinstance(resolve(a.get("V")), bytes) else None)
                elif isinstance(resolve(a.get("Contents")), bytes):
                    tree.add("annotation", node, kind, _pdf_text(resolve(a["Contents"])))
    for value, body in objects.values():
        if isinstance(value, dict):
            if value.get("Type") == ("name", "Filespec"):
                tree.add("attachment", 0, _pdf_text(resolve(value.get("UF") or value.get("F")) or b""))
            if value.get("S") == ("name", "JavaScript") or "JS" in value:
                tree.add("active_content", 0, "script", None, disposition="inert")
    tree.set(0, pages=len(pages), objects=len(objects))
    return tree


def _pdf_lines(raw: bytes) -> list[str]:
    """The text a content stream shows, a line for each move to another one."""
    out, line, args, at = [], [], [], 0
    while at < len(raw):
        try:
            value, at = _pdf_value(raw, at)
        except ParseError:
            at += 1
            continue
        if not (isinstance(value, tuple) and value[0] == "word"):
            args.append(value)
            continue
        op = value[1]
        if op in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            if op != "Tj" and line:
                out.append("".join(line))
                line = []
            line.append(_pdf_text(args[-1]))
        elif op == "TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                line.append(_pdf_text(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -200 else "")
        elif op in ("Td", "TD", "T*", "Tm", "ET") and line and (op in ("T*", "ET", "Tm") or len(args) > 1 and args[-1] != 0):
            out.append("".join(line))
            line = []
        args = []
    return [x for x in [*out, "".join(line)] if x.strip()]


PARSERS = {
    "docx": parse_docx, "docm": parse_docx, "dotx": parse_docx, "dotm": parse_docx, "pptx": parse_pptx, "pptm": parse_pptx, "potx": parse_pptx, "ppsx": parse_pptx, "xlsx": parse_xlsx, "xlsm": parse_xlsx,
    "odt": parse_odt, "ott": parse_odt, "odp": parse_odp, "otp": parse_odp, "ods": parse_ods, "ots": parse_ods, "epub": parse_epub, "rtf": parse_rtf, "pdf": parse_pdf,
}
