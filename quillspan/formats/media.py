"""Images, sound and video: what their containers say. Nothing is decoded or played."""

from __future__ import annotations

import re
import struct

from quillspan.formats.base import MAX_DEPTH, ParseError, Tree
from quillspan.formats.web import active_kind, xml_tree

# EXIF tags that are named, sizes of their types, ID3 frames, and boxes that hold boxes.
EXIF = {
    0x010E: "description", 0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x011A: "x_resolution", 0x011B: "y_resolution", 0x0131: "software", 0x0132: "modified", 0x013B: "artist", 0x0100: "width", 0x0101: "height", 0x0102: "bits",
    0x0103: "compression", 0x8298: "copyright", 0x829A: "exposure_time", 0x829D: "f_number", 0x8827: "iso", 0x9003: "taken", 0x920A: "focal_length", 0xA002: "pixel_width", 0xA003: "pixel_height", 0x8769: "exif", 0x8825: "gps",
}
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
ID3 = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TRCK": "track", "TYER": "year", "TDRC": "recorded", "TCON": "genre", "COMM": "comment", "TT2": "title", "TP1": "artist", "TAL": "album"}
BOXES = frozenset("moov trak mdia minf stbl udta ilst meta edts dinf moof traf mvex iprp ipco".split())
ILST = {"\xa9nam": "title", "\xa9ART": "artist", "\xa9alb": "album", "\xa9day": "date", "\xa9too": "software", "\xa9cmt": "comment"}
MPEG_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
EBML = {0x1A45DFA3: "EBML", 0x18538067: "Segment", 0x1549A966: "Info", 0x1654AE6B: "Tracks", 0xAE: "TrackEntry", 0x1254C367: "Tags", 0x7373: "Tag", 0x67C8: "SimpleTag", 0xE0: "Video", 0xE1: "Audio"}
EBML_VALUES = {0x4282: ("doc_type", "s"), 0x7BA9: ("title", "s"), 0x4D80: ("muxer", "s"), 0x5741: ("writer", "s"), 0x4489: ("duration", "f"), 0x2AD7B1: ("timestamp_scale", "u"), 0xD7: ("track", "u"), 0x83: ("type", "u"), 0x86: ("codec", "s"), 0x22B59C: ("language", "s"), 0xB0: ("width", "u"), 0xBA: ("height", "u"), 0xB5: ("rate", "f"), 0x9F: ("channels", "u"), 0x45A3: ("tag", "s"), 0x4487: ("text", "s")}


def tiff(tree: Tree, data: bytes, parent: int, base: int = 0) -> None:
    """The directories of a TIFF stream with named tags."""
    order = "<" if data[:2] == b"II" else ">"
    if len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        tree.warn("tiff.malformed", "no TIFF header", base, parent=parent)
        return
    todo, seen = [(struct.unpack(order + "I", data[4:8])[0], "ifd0")], set()
    while todo:
        at, name = todo.pop(0)
        if at in seen or at + 2 > len(data) or len(seen) > 64:
            continue
        seen.add(at)
        node = tree.add("directory", parent, name, None, base + at)
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        for k in range(n):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                tree.warn("tiff.truncated", name, base + at, parent=node)
                break
            tag, kind, count, value = struct.unpack(order + "HHII", entry)
            size = TYPE_SIZES.get(kind, 0) * count
            raw = entry[8 : 8 + size] if size <= 4 else data[value : value + size]
            if tag in (0x8769, 0x8825):
                todo.append((value, EXIF[tag]))
            elif len(raw) == size and size and count <= 4096:
                if kind == 2:
                    shown = raw.split(b"\0")[0].decode("latin-1")
                elif kind in (5, 10):
                    pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
                    shown = " ".join(f"{a}/{b}" for a, b in zip(pairs[::2], pairs[1::2]))
                elif kind in (1, 3, 4, 8, 9):
                    shown = " ".join(map(str, struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 8: 'h', 9: 'i'}[kind] }".replace(" ", ""), raw)))
                else:
                    shown = raw[:64].hex()
                tree.add("tag", node, EXIF.get(tag, f"{tag:#06x}"), shown)
        nxt = data[at + 2 + 12 * n : at + 6 + 12 * n]
        if len(nxt) == 4 and (following := struct.unpack(order + "I", nxt)[0]):
            todo.append((following, f"ifd{len(seen)}"))


def parse_png(data: bytes, options: dict) -> Tree:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ParseError("no PNG header", 0)
    tree, at = Tree("png"), 8
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            tree.warn("png.truncated", kind, at)
            break
        if kind == "IHDR" and n == 13:
            tree.set(0, width=int.from_bytes(body[:4], "big"), height=int.from_bytes(body[4:8], "big"), bits=body[8], color_type=body[9], interlaced=body[12] == 1)
        node = tree.add("chunk", 0, kind, None, at, at + 12 + n)
        if kind == "tEXt" and b"\0" in body:
            k, v = body.split(b"\0", 1)
            tree.add("metadata", node, k.decode("latin-1"), v.decode("latin-1"))
        elif kind == "iTXt" and body.count(b"\0") >= 4:
            k, rest = body.split(b"\0", 1)
            tree.add("metadata", node, k.decode("latin-1"), rest[2:].split(b"\0", 2)[-1].decode("utf-8", "replace") if rest[:1] == b"\0" else None)
        elif kind == "eXIf":
            tiff(tree, body, node, at + 8)
        elif kind == "acTL":
            tree.set(0, frames=int.from_bytes(body[:4], "big"))
        at += 12 + n
        if kind == "IEND":
            break
    return tree


def parse_jpeg(data: bytes, options: dict) -> Tree:
    if data[:3] != b"\xff\xd8\xff":
        raise ParseError("no JPEG header", 0)
    tree, at = Tree("jpeg"), 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        node = tree.add("segment", 0, f"{marker:#04x}", None, at, at + 2 + n)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            tree.set(0, height=int.from_bytes(body[1:3], "big"), width=int.from_bytes(body[3:5], "big"), components=body[5], progressive=marker == 0xC2)
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            tiff(tree, body[6:], node, at + 10)
        elif marker == 0xFE:
            tree.add("metadata", node, "comment", body.decode("utf-8", "replace"))
        if marker == 0xDA:
            break
        at += 2 + n
    if data[-2:] != b"\xff\xd9":
        tree.warn("jpeg.truncated", "no end marker", len(data))
    return tree


def parse_gif(data: bytes, options: dict) -> Tree:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ParseError("no GIF header", 0)
    tree = Tree("gif", version=data[3:6].decode(), width=int.from_bytes(data[6:8], "little"), height=int.from_bytes(data[8:10], "little"))
    at, frames = 13 + (3 << ((data[10] & 7) + 1) if data[10] & 0x80 else 0), 0

    def blocks(at: int) -> tuple[bytes, int]:
        out = b""
        while at < len(data) and data[at]:
            out += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        return out, at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, end = blocks(at + 2)
            if label == 0xFE:
                tree.add("metadata", 0, "comment", body.decode("latin-1"), at, end)
            at = end
        elif data[at] == 0x2C and at + 10 <= len(data):
            x, y, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            _, end = blocks(at + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
            tree.add("frame", 0, str(frames), None, at, end, x=x, y=y, width=w, height=h)
            frames, at = frames + 1, end
        else:
            tree.warn("gif.malformed", "unknown block", at)
            break
    tree.set(0, frames=frames)
    return tree


def parse_bmp(data: bytes, options: dict) -> Tree:
    if data[:2] != b"BM" or len(data) < 26:
        raise ParseError("no BMP header", 0)
    size = int.from_bytes(data[14:18], "little")
    w, h, bits = struct.unpack("<HH2xH", data[18:26]) if size == 12 else struct.unpack("<ii2xH", data[18:30])
    return Tree("bmp", width=w, height=abs(h), bits=bits, top_down=h < 0)


def parse_webp(data: bytes, options: dict) -> Tree:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ParseError("no WebP header", 0)
    tree = Tree("webp")
    for kind, at, body in _riff(data, 12, tree):
        node = tree.add("chunk", 0, kind, None, at, at + 8 + len(body))
        if kind == "VP8X" and len(body) >= 10:
            tree.set(0, width=int.from_bytes(body[4:7], "little") + 1, height=int.from_bytes(body[7:10], "little") + 1, animated=bool(body[0] & 2))
        elif kind == "VP8 " and body[3:6] == b"\x9d\x01\x2a":
            w, h = struct.unpack("<HH", body[6:10])
            tree.set(0, width=w & 0x3FFF, height=h & 0x3FFF)
        elif kind == "VP8L" and body[:1] == b"\x2f":
            n = int.from_bytes(body[1:5], "little")
            tree.set(0, width=(n & 0x3FFF) + 1, height=(n >> 14 & 0x3FFF) + 1)
        elif kind == "EXIF":
            tiff(tree, body[6:] if body[:6] == b"Exif\0\0" else body, node, at + 8)
    return tree


def _riff(data: bytes, at: int, tree: Tree):
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            tree.warn("riff.truncated", data[at : at + 4].decode("latin-1"), at)
        yield data[at : at + 4].decode("latin-1"), at, body
        at += 8 + n + n % 2


def parse_tiff(data: bytes, options: dict) -> Tree:
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ParseError("no TIFF header", 0)
    tree = Tree("tiff")
    tiff(tree, data, 0)
    for r in tree.rows:
        if r[2] == "tag" and r[3] in ("width", "height"):
            tree.rows[0][5].setdefault(r[3], r[4])
    return tree


def parse_svg(data: bytes, options: dict) -> Tree:
    """The elements and, below them, what could run or load something."""
    tree = Tree("svg")
    root = xml_tree(data, tree)
    if root is None or tree.rows[root][3] != "svg":
        raise ParseError("no SVG root", 0)
    top = tree.rows[root][5]
    tree.set(0, width=top.get("@width"), height=top.get("@height"), view_box=top.get("@viewBox"))
    for r in list(tree.rows):
        if r[2] == "element":
            for kind, what in active_kind(r[3], {k[1:]: v for k, v in r[5].items() if k.startswith("@")}):
                tree.add("active_content", r[0], kind, what, r[6], r[7], disposition="inert")
            if r[3] in ("image", "use") and (href := r[5].get("@href")) and not href.startswith(("#", "data:")):
                tree.add("link", r[0], r[3], href, r[6], r[7])
    return tree


def _boxes(tree: Tree, data: bytes, start: int, end: int, parent: int, depth: int = 0) -> None:
    at = start
    while at + 8 <= end:
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
        head = 8
        if n == 1:
            n, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        n = n or end - at
        if n < head or at + n > end or depth > MAX_DEPTH:
            tree.warn("iso_bmff.malformed_box", kind, at, parent=parent)
            return
        body = data[at + head : at + n]
        node = tree.add("box", parent, kind, None, at, at + n)
        if kind == "ftyp":
            tree.set(0, brand=body[:4].decode("latin-1"), brands=" ".join(body[k : k + 4].decode("latin-1") for k in range(8, len(body), 4)))
        elif kind == "mvhd" and len(body) >= 20:
            scale, length = struct.unpack(">II", body[12:20]) if body[0] == 0 else struct.unpack(">IQ", body[20:32])
            tree.set(0, duration_ms=length * 1000 // scale if scale else None)
        elif kind == "hdlr" and len(body) >= 12:
            tree.set(node, handler=body[8:12].decode("latin-1"))
        elif kind == "tkhd" and len(body) >= 84:
            w, h = struct.unpack(">II", body[-8:])
            tree.set(node, track=int.from_bytes(body[12:16] if body[0] == 0 else body[20:24], "big"), width=w >> 16 or None, height=h >> 16 or None)
        elif kind == "stsd" and len(body) >= 16:
            tree.set(node, codec=body[12:16].decode("latin-1"))
        elif kind == "mdhd" and len(body) >= 22:
            code = int.from_bytes(body[20:22] if body[0] == 0 else body[32:34], "big")
            tree.set(node, language="".join(chr((code >> s & 31) + 0x60) for s in (10, 5, 0)))
        elif kind == "ispe" and len(body) >= 12:
            tree.rows[0][5].setdefault("width", str(int.from_bytes(body[4:8], "big")))
            tree.rows[0][5].setdefault("height", str(int.from_bytes(body[8:12], "big")))
        elif kind in ILST and len(body) > 16:
            tree.add("metadata", node, ILST[kind], body[16:].decode("utf-8", "replace"))
        if kind in BOXES:
            _boxes(tree, data, at + head + (4 if kind == "meta" and body[4:8] != b"hdlr" else 0), at + n, node, depth + 1)
        at += n


def _iso(format: str):
    def parse(data: bytes, options: dict) -> Tree:
        if data[4:8] not in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
            raise ParseError("no ISO base media header", 0)
        tree = Tree(format)
        _boxes(tree, data, 0, len(data), 0)
        return tree

    return parse


def parse_mp3(data: bytes, options: dict) -> Tree:
    tree, at = Tree("mp3"), 0
    if data[:3] == b"ID3":
        size = sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
        tree.set(0, id3=f"2.{data[3]}")
        at, end = 10, min(len(data), 10 + size)
        head = 6 if data[3] == 2 else 10
        while at + head <= end and data[at]:
            name = data[at : at + (3 if head == 6 else 4)].decode("latin-1")
            n = int.from_bytes(data[at + 3 : at + 6], "big") if head == 6 else sum((b & 127) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0))) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            body = data[at + head : at + head + n]
            if name[0] == "T" and body:
                tree.add("metadata", 0, ID3.get(name, name), body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").strip("\0"), at, at + head + n)
            else:
                tree.add("frame", 0, name, None, at, at + head + n)
            at += head + n
        at = end
    if data[-128:-125] == b"TAG":
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            tree.add("metadata", 0, name, data[-128:][a:b].split(b"\0")[0].decode("latin-1").strip(), id3="1")
    m = re.compile(rb"\xff[\xe2-\xff]").search(data, at)
    if m and m.start() + 4 <= len(data):
        h = int.from_bytes(data[m.start() : m.start() + 4], "big")
        version, layer, rate, freq = h >> 19 & 3, h >> 17 & 3, h >> 12 & 15, h >> 10 & 3
        if version == 3 and layer == 1 and 0 < rate < 15 and freq < 3:
            tree.set(0, mpeg="1", layer=3, kbps=MPEG_RATES[rate], hertz=(44100, 48000, 32000)[freq], channels=1 if h >> 6 & 3 == 3 else 2)
    elif data[:3] != b"ID3":
        raise ParseError("no MPEG frame", 0)
    return tree


def parse_wav(data: bytes, options: dict) -> Tree:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ParseError("no WAVE header", 0)
    tree, rate = Tree("wav"), 0
    for kind, at, body in _riff(data, 12, tree):
        node = tree.add("chunk", 0, kind, None, at, at + 8 + len(body))
        if kind == "fmt " and len(body) >= 16:
            codec, channels, hertz, rate, _, bits = struct.unpack("<HHIIHH", body[:16])
            tree.set(0, codec=codec, channels=channels, hertz=hertz, bits=bits)
        elif kind == "data" and rate:
            tree.set(0, duration_ms=len(body) * 1000 // rate)
        elif kind == "LIST" and body[:4] == b"INFO":
            for k, _, v in _riff(body, 4, tree):
                tree.add("metadata", node, k, v.split(b"\0")[0].decode("utf-8", "replace"))
    return tree


def parse_flac(data: bytes, options: dict) -> Tree:
    if data[:4] != b"fLaC":
        raise ParseError("no FLAC header", 0)
    tree, at, last = Tree("flac"), 4, False
    while not last and at + 4 <= len(data):
        last, kind, n = data[at] >> 7 == 1, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        node = tree.add("block", 0, str(kind), None, at, at + 4 + n)
        if kind == 0 and len(body) >= 18:
            bits = int.from_bytes(body[10:18], "big")
            hertz, samples = bits >> 44, bits & (1 << 36) - 1
            tree.set(0, hertz=hertz, channels=(bits >> 41 & 7) + 1, bits=(bits >> 36 & 31) + 1, duration_ms=samples * 1000 // hertz if hertz else None)
        elif kind == 4:
            k = 4 + int.from_bytes(body[:4], "little")
            count, k = int.from_bytes(body[k : k + 4], "little"), k + 4
            for _ in range(min(count, 10_000)):
                size = int.from_bytes(body[k : k + 4], "little")
                name, _, value = body[k + 4 : k + 4 + size].decode("utf-8", "replace").partition("=")
                tree.add("metadata", node, name.lower(), value)
                k += 4 + size
        at += 4 + n
    return tree


def parse_matroska(data: bytes, options: dict) -> Tree:
    if data[:4] != b"\x1aE\xdf\xa3":
        raise ParseError("no EBML header", 0)
    tree = Tree("matroska")

    def number(at: int, keep: bool) -> tuple[int, int]:
        if at >= len(data) or not data[at]:
            raise ParseError("bad length", at)
        n = 9 - data[at].bit_length()
        value = data[at] if keep else data[at] & (255 >> n)
        return int.from_bytes(bytes([value]) + data[at + 1 : at + n], "big"), n

    def walk(at: int, end: int, parent: int, depth: int) -> None:
        while at < end:
            ident, a = number(at, True)
            size, b = number(at + a, False)
            start = at + a + b
            stop = end if size == (1 << 7 * b) - 1 else min(end, start + size)
            if ident in EBML and depth < 16:
                walk(start, stop, tree.add("element", parent, EBML[ident], None, at, stop), depth + 1)
            elif ident in EBML_VALUES:
                name, form = EBML_VALUES[ident]
                raw = data[start:stop]
                value = raw.decode("utf-8", "replace") if form == "s" else int.from_bytes(raw, "big") if form == "u" else struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0] if len(raw) in (4, 8) else None
                tree.add("value", parent, name, value, at, stop)
            at = stop

    try:
        walk(0, len(data), 0, 0)
    except ParseError as e:
        tree.warn("matroska.malformed", str(e), e.at)
    return tree


PARSERS = {
    "png": parse_png, "jpeg": parse_jpeg, "gif": parse_gif, "bmp": parse_bmp, "webp": parse_webp, "tiff": parse_tiff, "svg": parse_svg, "heif": _iso("heif"), "mp4": _iso("mp4"), "quicktime": _iso("quicktime"), "mp3": parse_mp3, "wav": parse_wav,
    "flac": parse_flac, "matroska": parse_matroska,
}
