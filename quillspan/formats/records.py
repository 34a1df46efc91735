"""Calendars, contacts, notebooks and project manifests."""

from __future__ import annotations

import json
import re

from quillspan.formats.base import ParseError, Tree
from quillspan.formats.structured import canonical

_UNFOLD = re.compile(r"\r?\n[ \t]")
_PROPERTY = re.compile(r"(?:(?P<group>[\w-]+)\.)?(?P<name>[\w-]+)(?P<params>(?:;[\w-]+(?:=(?:\"[^\"]*\"|[^;:\",]*)(?:,(?:\"[^\"]*\"|[^;:\",]*))*)?)*):(?P<value>.*)$", re.S)
_PARAM = re.compile(r";([\w-]+)(?:=((?:\"[^\"]*\"|[^;:\",]*)(?:,(?:\"[^\"]*\"|[^;:\",]*))*))?")
# Frequencies and parts of a recurrence rule, and the fields of structured contact values.
FREQUENCIES = ("SECONDLY", "MINUTELY", "HOURLY", "DAILY", "WEEKLY", "MONTHLY", "YEARLY")
RULE_PARTS = ("FREQ", "UNTIL", "COUNT", "INTERVAL", "BYSECOND", "BYMINUTE", "BYHOUR", "BYDAY", "BYMONTHDAY", "BYYEARDAY", "BYWEEKNO", "BYMONTH", "BYSETPOS", "WKST")
NAME_FIELDS = ("family", "given", "additional", "prefix", "suffix")
ADDRESS_FIELDS = ("po_box", "extended", "street", "locality", "region", "postal_code", "country")


def unescape(value: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] in "nN" else m[1], value, flags=re.S)


def temporal(value: str, params: dict[str, str]) -> dict[str, object]:
    """What a date or time is: date, utc, zoned (with its zone) or floating, in ISO form; invalid if it is none."""
    m = re.fullmatch(r"(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(Z?))?", value)
    if not m or not (1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31) or m[4] and (int(m[4]) > 23 or int(m[5]) > 59 or int(m[6]) > 60):
        return {"temporal": "invalid"}
    day = f"{m[1]}-{m[2]}-{m[3]}"
    if not m[4]:
        return {"temporal": "date", "iso": day}
    at = f"{day}T{m[4]}:{m[5]}:{m[6]}"
    if m[7]:
        return {"temporal": "utc", "iso": at + "Z"}
    return {"temporal": "zoned", "iso": at, "zone": params["TZID"]} if "TZID" in params else {"temporal": "floating", "iso": at}


def recurrence(value: str) -> dict[str, object]:
    """The parts of a recurrence rule and whether it is valid. It is never expanded."""
    parts: dict[str, str] = {}
    ok = True
    for part in value.split(";"):
        key, eq, x = part.partition("=")
        ok &= bool(eq) and key.upper() in RULE_PARTS and key.upper() not in parts and x != ""
        parts[key.upper()] = x
    ok &= parts.get("FREQ", "").upper() in FREQUENCIES and not ("COUNT" in parts and "UNTIL" in parts)
    ok &= all(parts[k].isdigit() and int(parts[k]) > 0 for k in ("COUNT", "INTERVAL") if k in parts)
    return {"valid": ok, **{f"rule.{k.lower()}": v for k, v in parts.items()}}


def _components(data: bytes, tree: Tree, contact: bool) -> None:
    text = data.decode("utf-8-sig", "replace")
    stack: list[tuple[str, int]] = [("", 0)]
    for line in _UNFOLD.sub("", text).replace("\r\n", "\n").split("\n"):
        if not line.strip():
            continue
        m = _PROPERTY.match(line)
        if not m:
            tree.warn("records.malformed_line", line[:200], parent=stack[-1][1])
            continue
        name, value = m["name"].upper(), m["value"]
        params = {k.upper(): (v or "").replace('"', "") for k, v in _PARAM.findall(m["params"])}
        if name == "BEGIN":
            stack.append((value.strip().upper(), tree.add("component", stack[-1][1], value.strip().lower())))
        elif name == "END":
            if len(stack) > 1 and stack[-1][0] == value.strip().upper():
                stack.pop()
            else:
                tree.warn("records.unmatched_end", value, parent=stack[-1][1])
        else:
            node = tree.add("property", stack[-1][1], name.lower(), unescape(value), group=m["group"], **{f"param.{k.lower()}": v for k, v in params.items()})
            if name in ("DTSTART", "DTEND", "DUE", "DTSTAMP", "CREATED", "LAST-MODIFIED", "RECURRENCE-ID", "COMPLETED", "EXDATE", "RDATE", "TRIGGER") and (name != "TRIGGER" or value[:1].isdigit()):
                for one in value.split(","):
                    tree.add("temporal", node, None, one, **temporal(one, params))
            elif name == "RRULE":
                tree.add("recurrence", node, None, value, **recurrence(value))
            elif contact and name in ("N", "ADR"):
                for field, part in zip(NAME_FIELDS if name == "N" else ADDRESS_FIELDS, re.split(r"(?<!\\);", value)):
                    if part:
                        tree.add("part", node, field, unescape(part))
    for name, node in stack[1:]:
        tree.warn("records.unclosed_component", name, parent=node)


def parse_icalendar(data: bytes, options: dict) -> Tree:
    tree = Tree("icalendar")
    _components(data, tree, False)
    return tree


def parse_vcard(data: bytes, options: dict) -> Tree:
    tree = Tree("vcard")
    _components(data, tree, True)
    return tree


def _joined(value: object) -> str:
    return "".join(map(str, value)) if isinstance(value, list) else str(value or "")


def parse_notebook(data: bytes, options: dict) -> Tree:
    """Cells in order with source, outputs and attachments, of formats 3 and 4. Nothing is run."""
    book = json.loads(data.decode("utf-8-sig"))
    if not isinstance(book, dict) or "cells" not in book and "worksheets" not in book:
        raise ParseError("no notebook")
    tree = Tree("ipynb", nbformat=book.get("nbformat"), nbformat_minor=book.get("nbformat_minor"), language=book.get("metadata", {}).get("kernelspec", {}).get("language") or book.get("metadata", {}).get("language_info", {}).get("name"))
    cells = book.get("cells")
    if cells is None:
        cells = [c for sheet in book["worksheets"] for c in sheet.get("cells", [])]
    for i, cell in enumerate(cells):
        source = _joined(cell.get("source", cell.get("input", "")))
        node = tree.add("cell", 0, cell.get("id") or str(i), source, type=cell.get("cell_type"), execution_count=cell.get("execution_count", cell.get("prompt_number")), executed=False, tags=",".join(cell.get("metadata", {}).get("tags", [])) or None)
        for j, out in enumerate(cell.get("outputs", [])):
            kind = out.get("output_type")
            o = tree.add("output", node, str(j), _joined(out.get("text")) or None, type=kind, stream=out.get("name") or out.get("stream"), ename=out.get("ename"), evalue=out.get("evalue"))
            for media, body in (out.get("data") or {}).items():
                tree.add("data", o, media, body if isinstance(body, str) else _joined(body) if isinstance(body, list) else canonical(body))
        for name, media in (cell.get("attachments") or {}).items():
            for kind, body in media.items():
                tree.add("attachment", node, name, None, media_type=kind, bytes=len(_joined(body)) * 3 // 4)
    tree.set(0, cells=len(cells))
    return tree


# Fixed values: (pattern of the file name, format, role).
MANIFESTS = (
    (r"cargo\.toml", "cargo_toml", "manifest"), (r"cargo\.lock", "cargo_lock", "lockfile"), (r"package\.json", "package_json", "manifest"), (r"package-lock\.json|npm-shrinkwrap\.json", "package_lock", "lockfile"),
    (r"yarn\.lock", "yarn_lock", "lockfile"), (r"pnpm-lock\.yaml", "pnpm_lock", "lockfile"), (r"pyproject\.toml", "pyproject", "manifest"), (r"poetry\.lock", "poetry_lock", "lockfile"), (r"requirements[\w.-]*\.txt", "requirements", "manifest"),
    (r"go\.mod", "go_mod", "manifest"), (r"go\.sum", "go_sum", "lockfile"), (r"gemfile", "gemfile", "manifest"), (r"gemfile\.lock", "gemfile_lock", "lockfile"), (r"composer\.json", "composer", "manifest"), (r"composer\.lock", "composer_lock", "lockfile"),
    (r"pom\.xml", "maven", "manifest"), (r"build\.gradle(?:\.kts)?", "gradle", "manifest"), (r"dockerfile(?:\..*)?|.*\.dockerfile", "dockerfile", "container"), (r"(?:docker-)?compose\.ya?ml", "compose", "container"), (r"\.gitlab-ci\.yml", "gitlab_ci", "ci"),
    (r"makefile", "makefile", "build"),
)


def classify(filename: str, text: str = "") -> tuple[str, str]:
    """(format, role) of a manifest by its name and, for YAML, by what it says."""
    path = filename.lower().replace("\\", "/")
    name = path.rsplit("/", 1)[-1]
    for pattern, format, role in MANIFESTS:
        if re.fullmatch(pattern, name):
            return format, role
    if ".github/workflows/" in path and name.endswith((".yml", ".yaml")):
        return "github_actions", "ci"
    if re.search(r"(?m)^apiVersion:", text) and re.search(r"(?m)^kind:", text):
        return "kubernetes", "deployment"
    return "unknown", "unknown"


def parse_manifest(data: bytes, options: dict) -> Tree:
    """dependency rows (name, version as value, scope) and, for containers and CI, instruction and reference rows. Option
    filename says what the file is."""
    text = data.decode("utf-8-sig", "replace")
    format, role = classify(options.get("filename", ""), text)
    tree = Tree("manifest", format=format, role=role)

    def dependency(name: str, version: object, scope: str, **attrs: object) -> None:
        if isinstance(version, dict):
            attrs |= {k: v for k, v in version.items() if k in ("path", "git", "optional", "workspace", "branch", "rev")}
            version = version.get("version")
        tree.add("dependency", 0, name, version, scope=scope, **attrs)

    if format in ("cargo_toml", "pyproject", "cargo_lock", "poetry_lock"):
        import tomllib

        top = tomllib.loads(text)
        if format.endswith("lock"):
            for p in top.get("package", []):
                dependency(p.get("name"), p.get("version"), "locked", source=p.get("source") if isinstance(p.get("source"), str) else None, checksum=p.get("checksum"))
        elif format == "cargo_toml":
            tree.set(0, name=top.get("package", {}).get("name"), version=top.get("package", {}).get("version"))
            for table, scope in (("dependencies", "runtime"), ("dev-dependencies", "development"), ("build-dependencies", "build")):
                for name, v in top.get(table, {}).items():
                    dependency(name, v, scope)
            for target, body in top.get("target", {}).items():
                for name, v in body.get("dependencies", {}).items():
                    dependency(name, v, "runtime", target=target)
        else:
            project = top.get("project", {})
            tree.set(0, name=project.get("name"), version=project.get("version"))
            groups = [("runtime", project.get("dependencies", [])), *((g, d) for g, d in project.get("optional-dependencies", {}).items()), *(("build", b) for b in [top.get("build-system", {}).get("requires", [])])]
            for scope, items in groups:
                for item in items:
                    m = re.match(r"\s*([\w.-]+)(\[[^\]]*\])?\s*(.*)", item)
                    dependency(m[1], m[3] or None, scope)
            for name, v in top.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
                dependency(name, v, "runtime")
    elif format in ("package_json", "composer", "package_lock", "composer_lock"):
        top = json.loads(text)
        tree.set(0, name=top.get("name"), version=top.get("version"))
        if format == "package_lock":
            for name, v in (top.get("packages") or {}).items():
                if name:
                    dependency(name.rsplit("node_modules/", 1)[-1], v.get("version"), "locked", path=name)
        elif format == "composer_lock":
            for p in [*top.get("packages", []), *top.get("packages-dev", [])]:
                dependency(p.get("name"), p.get("version"), "locked")
        else:
            for table, scope in (("dependencies", "runtime"), ("require", "runtime"), ("devDependencies", "development"), ("require-dev", "development"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
                for name, v in (top.get(table) or {}).items():
                    dependency(name, v, scope)
            for name, v in (top.get("scripts") or {}).items():
                tree.add("script", 0, name, v if isinstance(v, str) else canonical(v), executed=False)
    elif format == "requirements":
        for line in text.splitlines():
            line = line.split(" #")[0].strip()
            if m := re.match(r"([\w.-]+)(?:\[[^\]]*\])?\s*([^;]*)", line):
                if not line.startswith(("#", "-")):
                    dependency(m[1], m[2].strip() or None, "runtime")
    elif format in ("go_mod", "go_sum"):
        for m in re.finditer(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v[\w.+-]+(?:/go\.mod)?)(.*)$", text):
            dependency(m[1], m[2], "locked" if format == "go_sum" else "indirect" if "indirect" in m[3] else "runtime")
    elif format in ("gemfile", "gemfile_lock"):
        for m in re.finditer(r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?" if format == "gemfile" else r"(?m)^ {4}([\w.-]+) \(([^)]+)\)", text):
            dependency(m[1], m[2], "runtime" if format == "gemfile" else "locked")
    elif format == "maven":
        for m in re.finditer(r"<dependency>(.*?)</dependency>", text, re.S):
            f = dict(re.findall(r"<(groupId|artifactId|version|scope)>\s*([^<]*?)\s*</", m[1]))
            dependency(f"{f.get('groupId')}:{f.get('artifactId')}", f.get("version"), f.get("scope", "compile"))
    elif format == "gradle":
        for m in re.finditer(r"(?m)^\s*(\w*[iI]mplementation|api|compileOnly|runtimeOnly|testCompile|compile)\s*\(?\s*['\"]([^:'\"]+:[^:'\"]+)(?::([^'\"]+))?['\"]", text):
            dependency(m[2], m[3], m[1])
    elif format == "dockerfile":
        for i, m in enumerate(re.finditer(r"(?m)^[ \t]*([A-Za-z]+)[ \t]+((?:[^\n\\]|\\\n|\\.)*)", re.sub(r"(?m)^[ \t]*#.*\n", "", text))):
            tree.add("instruction", 0, m[1].upper(), re.sub(r"\\\n\s*", " ", m[2]).strip(), ordinal=i, executed=False)
            if m[1].upper() == "FROM":
                tree.add("reference", 0, "image", m[2].split()[0])
    elif format in ("github_actions", "gitlab_ci", "compose", "kubernetes"):
        for m in re.finditer(r"(?m)^[ \t]*-?[ \t]*(uses|image):[ \t]*[\"']?([^\s\"'#]+)", text):
            tree.add("reference", 0, m[1], m[2])
        for m in re.finditer(r"(?m)^[ \t]*-?[ \t]*run:[ \t]*(?:\|[ \t]*\n)?(.*)$", text):
            tree.add("instruction", 0, "run", m[1].strip(), executed=False)
        for m in re.finditer(r"(?m)^kind:[ \t]*(\S+)", text):
            tree.add("resource", 0, m[1])
    elif format == "makefile":
        for m in re.finditer(r"(?m)^([\w./-]+)\s*:(?!=)([^\n]*)$", text):
            tree.add("target", 0, m[1], m[2].strip())
    elif format in ("yarn_lock", "pnpm_lock"):
        for m in re.finditer(r"(?m)^\"?(@?[^@\s\"]+)@[^\n]*:\n\s+version:? \"?([^\"\n]+)" if format == "yarn_lock" else r"(?m)^  /?(@?[^@\s(]+)@([^:(\s]+)[^:\n]*:", text):
            dependency(m[1], m[2], "locked")
    else:
        tree.warn("manifest.unknown", options.get("filename", ""))
    return tree


PARSERS = {"icalendar": parse_icalendar, "vcard": parse_vcard, "ipynb": parse_notebook, "manifest": parse_manifest}
