"""Subtitles: SRT, WebVTT and TTML cues in milliseconds with speakers."""

from __future__ import annotations

import html
import re
from fractions import Fraction

from quillspan.formats.base import Offsets, Tree
from quillspan.formats.web import xml_tree

_CLOCK = re.compile(r"(?:(\d{2,}):)?([0-5]\d):([0-5]\d)([.,])(\d{3})\Z")
_TIMING = re.compile(r"(\S+)[ \t]+-->[ \t]+(\S+)(?:[ \t]+(.*))?$")


def clock(value: str, separator: str, short: bool) -> int | None:
    """Milliseconds of a strict clock: two or more digits of hours, which only ``short`` clocks may leave out."""
    m = _CLOCK.match(value)
    if not m or m[4] != separator or m[1] is None and not short:
        return None
    return ((int(m[1] or 0) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int(m[5])


def speaker(text: str) -> tuple[str | None, str]:
    """(the upper-case name before a colon on the first line, the text without it)."""
    m = re.match(r"\s*([^:\n]{1,64}):\s+", text)
    if m and len(m[1].encode()) <= 64 and any(c.isalpha() for c in m[1]) and m[1] == m[1].upper():
        return m[1].strip(), text[m.end() :]
    return None, text


def _cue(tree: Tree, name: str | None, text: str, start: int, end: int, span: tuple[int, int], **attrs: object) -> None:
    tree.add("cue", 0, name, text, *span, start_ms=start, end_ms=end, **attrs)
    if end <= start:
        tree.warn("subtitle.empty_interval", f"{start} to {end}", *span)


def parse_srt(data: bytes, options: dict) -> Tree:
    text = data.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")
    tree, byte = Tree("srt"), Offsets(text)
    for m in re.finditer(r"(?:[^\n]+\n?)+", text):
        lines = m[0].rstrip("\n").split("\n")
        at = next((i for i, x in enumerate(lines[:2]) if "-->" in x), None)
        span = (byte(m.start()), byte(m.end()))
        t = _TIMING.match(lines[at].strip()) if at is not None else None
        start, end = (clock(t[1], ",", False), clock(t[2], ",", False)) if t else (None, None)
        if start is None or end is None:
            tree.warn("srt.malformed_cue", m[0][:200], *span)
            continue
        who, body = speaker("\n".join(lines[at + 1 :]))
        _cue(tree, lines[0].strip() if at else None, html.unescape(re.sub(r"</?[A-Za-z][^<>]*>|\{\\[^}]*\}", "", body)), start, end, span, speaker=who, raw="\n".join(lines[at + 1 :]))
    return tree


def parse_vtt(data: bytes, options: dict) -> Tree:
    text = data.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")
    tree, byte = Tree("webvtt"), Offsets(text)
    if not re.match(r"WEBVTT(?:[ \t][^\n]*)?(?:\n|\Z)", text):
        tree.warn("webvtt.no_header", text[:20], 0)
    for m in re.finditer(r"(?:[^\n]+\n?)+", text):
        lines = m[0].rstrip("\n").split("\n")
        span = (byte(m.start()), byte(m.end()))
        if m.start() == 0 and lines[0].startswith("WEBVTT"):
            continue
        head = lines[0].split()[0] if lines[0].split() else ""
        if head in ("NOTE", "STYLE", "REGION") and "-->" not in lines[0]:
            tree.add(head.lower(), 0, None, "\n".join([lines[0][len(head) :].strip(), *lines[1:]]).strip(), *span)
            continue
        at = next((i for i, x in enumerate(lines[:2]) if "-->" in x), None)
        t = _TIMING.match(lines[at].strip()) if at is not None else None
        start, end = (clock(t[1], ".", True), clock(t[2], ".", True)) if t else (None, None)
        if start is None or end is None:
            tree.warn("webvtt.malformed_cue", m[0][:200], *span)
            continue
        raw = "\n".join(lines[at + 1 :])
        voice = re.search(r"<v(?:\.[\w.]+)?\s+([^<>]+)>", raw)
        settings = dict(x.split(":", 1) for x in (t[3] or "").split() if ":" in x)
        _cue(tree, lines[0].strip() if at else None, html.unescape(re.sub(r"<[^<>]*>", "", raw)), start, end, span, speaker=voice[1].strip() if voice else None, raw=raw, **{f"setting.{k}": v for k, v in settings.items()})
    return tree


def ttml_time(value: str, frame_rate: Fraction, tick_rate: Fraction) -> int | None:
    """Milliseconds of a clock (hh:mm:ss, .fraction or :frames) or an offset with a metric, rounded half up."""
    if m := re.fullmatch(r"(\d{2,}):([0-5]\d):([0-5]\d)(?:(\.\d+)|:(\d{2,})(?:\.\d+)?)?", value):
        seconds = Fraction((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3])) + (Fraction(m[4][1:]) / 10 ** (len(m[4]) - 1) if m[4] else 0) + (Fraction(m[5]) / frame_rate if m[5] else 0)
    elif m := re.fullmatch(r"(\d+(?:\.\d+)?)(h|ms|m|s|f|t)", value):
        seconds = Fraction(m[1]) * {"h": Fraction(3600), "m": Fraction(60), "s": Fraction(1), "ms": Fraction(1, 1000), "f": 1 / frame_rate, "t": 1 / tick_rate}[m[2]]
    else:
        return None
    return int(seconds * 1000 + Fraction(1, 2))


def parse_ttml(data: bytes, options: dict) -> Tree:
    """Paragraphs as cues; times of containers are added (par) or follow each other (seq)."""
    source, tree = Tree("xml"), Tree("ttml")
    root = xml_tree(data, source)
    if root is None:
        tree.warn("ttml.malformed", "no root element", 0)
        return tree
    rows = source.rows
    children: dict[int, list[int]] = {}
    for r in rows:
        if r[1] is not None:
            children.setdefault(r[1], []).append(r[0])
    top = rows[root][5]
    frames = Fraction(top.get("@frameRate", "30"))
    if "@frameRateMultiplier" in top:
        a, b = re.split(r"[\s:]+", top["@frameRateMultiplier"].strip())
        frames *= Fraction(int(a), int(b))
    ticks = Fraction(top.get("@tickRate", "1")) if "@tickRate" in top else frames if "@frameRate" in top else Fraction(1)
    agents = {rows[i][5].get("@id"): text_of(rows, children, i).strip() for i in range(len(rows)) if rows[i][3] == "agent"}

    def walk(i: int, begin: int, until: int | None, who: str | None) -> int:
        r = rows[i]
        a = r[5]
        start = begin + (ttml_time(a["@begin"], frames, ticks) or 0 if "@begin" in a else 0)
        end = begin + (ttml_time(a["@end"], frames, ticks) or 0) if "@end" in a else start + (ttml_time(a["@dur"], frames, ticks) or 0) if "@dur" in a else until
        for k in ("@begin", "@end", "@dur"):
            if k in a and ttml_time(a[k], frames, ticks) is None:
                tree.warn("ttml.malformed_time", a[k], r[6])
        who = a.get("@agent", who)
        if r[3] == "p":
            if end is not None:
                _cue(tree, a.get("@id"), text_of(rows, children, i).strip(), start, end, (r[6], r[7]), speaker=agents.get(who, who), region=a.get("@region"))
            return end or start
        at = start
        for c in children.get(i, []):
            if rows[c][2] == "element":
                done = walk(c, at, end, who)
                at = done if a.get("@timeContainer") == "seq" else at
        return end if end is not None else at

    walk(root, 0, None, None)
    return tree


def text_of(rows: list[tuple], children: dict[int, list[int]], i: int) -> str:
    """The text below an element; a br is a line end."""
    r = rows[i]
    if r[2] == "text":
        return re.sub(r"\s+", " ", r[4])
    return "\n" if r[3] == "br" else "".join(text_of(rows, children, c) for c in children.get(i, []))


PARSERS = {"srt": parse_srt, "webvtt": parse_vtt, "ttml": parse_ttml}
