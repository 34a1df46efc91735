"""Archives: members with path, size and digest under a security policy. Nothing is written to disk."""

from __future__ import annotations

import bz2
import hashlib
import io
import lzma
import re
import stat
import tarfile
import unicodedata
import zipfile
import zlib

from quillspan.formats.base import ParseError, Tree

# Limits on the paths of members, and on what an archive may hold and unpack to.
MAX_PATH_BYTES = 4096
MAX_COMPONENTS = 256
MAX_MEMBERS = 100_000
MAX_RATIO = 100
MAX_UNPACKED = 256 << 20


def member_path(path: str) -> tuple[str | None, str | None]:
    """(the path in one form, or None; why it is refused). Absolute paths, drive letters, parent steps and control
    characters are refused; both separators count."""
    if not path or len(path.encode("utf-8", "replace")) > MAX_PATH_BYTES:
        return None, "empty_path" if not path else "path_too_long"
    if any(unicodedata.category(c) == "Cc" for c in path):
        return None, "control_character"
    flat = path.replace("\\", "/")
    if flat.startswith("/") or re.match(r"[A-Za-z]:", flat):
        return None, "absolute_path"
    parts = [p for p in flat.split("/") if p not in ("", ".")]
    if ".." in parts:
        return None, "parent_traversal"
    if len(parts) > MAX_COMPONENTS:
        return None, "too_many_components"
    return ("/".join(parts), None) if parts else (None, "empty_path")


class _Members:
    """Adds members and keeps to the budget."""

    def __init__(self, tree: Tree, packed: int, keep: bool):
        self.tree, self.room, self.keep, self.seen, self.n = tree, min(MAX_UNPACKED, max(1 << 20, MAX_RATIO * packed)), keep, {}, 0

    def add(self, path: str, kind: str, size: int | None, read, **attrs: object) -> None:
        self.n += 1
        if self.n > MAX_MEMBERS:
            raise ParseError("more members than the budget")
        safe, why = member_path(path)
        folded = safe.casefold() if safe else None
        if folded in self.seen and kind == "file":
            why = "path_collision"
        elif folded:
            self.seen[folded] = True
        body = None
        if kind == "file" and why is None and read is not None:
            if (size or 0) > self.room:
                why = "budget_exhausted"
            else:
                try:
                    body = read()
                except (OSError, EOFError, RuntimeError, zlib.error, lzma.LZMAError, zipfile.BadZipFile, NotImplementedError) as e:
                    why = f"unreadable: {e}"[:120]
        if body is not None:
            self.room -= len(body)
        node = self.tree.add("member", 0, safe or path, None, type=kind, bytes=len(body) if body is not None else size, sha256=None if body is None else "sha256:" + hashlib.sha256(body).hexdigest(), disposition="listed" if kind != "file" and why is None else "rejected" if why else "extracted", reason=why, **attrs)
        if why:
            self.tree.warn(f"archive.{why.split(':')[0]}", path, parent=node)
        if body is not None and self.keep:
            self.tree.add("content", node, None, body.decode("latin-1"))


def parse_zip(data: bytes, options: dict) -> Tree:
    tree = Tree("zip")
    members = _Members(tree, len(data), options.get("contents", False))
    try:
        box = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ParseError(str(e)) from e
    for i in box.infolist():
        mode = i.external_attr >> 16
        kind = "directory" if i.is_dir() else "symlink" if stat.S_ISLNK(mode) else "file"
        members.add(i.filename.rstrip("/"), kind, i.file_size, (lambda i=i: box.read(i)) if not i.flag_bits & 1 else None, method=i.compress_type, encrypted=bool(i.flag_bits & 1), packed=i.compress_size)
    tree.set(0, members=members.n, comment=box.comment.decode("utf-8", "replace") or None)
    return tree


def _tar(tree: Tree, data: bytes, packed: int, keep: bool) -> None:
    members = _Members(tree, packed, keep)
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as box:
            for i in box:
                kind = "file" if i.isreg() else "directory" if i.isdir() else "symlink" if i.issym() else "hardlink" if i.islnk() else "device"
                members.add(i.name, kind, i.size, (lambda i=i: box.extractfile(i).read()), target=i.linkname or None, sparse=i.issparse() or None)
    except tarfile.TarError as e:
        tree.warn("tar.malformed", str(e))
    tree.set(0, members=members.n)


def parse_tar(data: bytes, options: dict) -> Tree:
    tree = Tree("tar")
    _tar(tree, data, len(data), options.get("contents", False))
    return tree


def gzip_members(data: bytes) -> list[tuple[str | None, bytes, str | None]]:
    """(name in the header, content, what is wrong) of each member of a gzip file."""
    out, rest, room = [], data, min(MAX_UNPACKED, max(1 << 20, MAX_RATIO * len(data)))
    while rest[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            body = d.decompress(rest, room)
            problem = "budget_exhausted" if d.unconsumed_tail else None if d.eof else "truncated"
        except zlib.error as e:
            body, problem = b"", str(e)
        room = max(1, room - len(body))
        name, at = None, 10 + (2 + int.from_bytes(rest[10:12], "little") if rest[3] & 4 else 0)
        if rest[3] & 8:
            name = rest[at : rest.index(b"\0", at)].decode("latin-1") if b"\0" in rest[at:] else None
        out.append((name, body, problem))
        if problem:
            break
        rest = d.unused_data.lstrip(b"\0")
    return out


def _single(format: str, unpack):
    def parse(data: bytes, options: dict) -> Tree:
        tree = Tree(format)
        try:
            found = unpack(data)
        except (OSError, EOFError, ValueError, lzma.LZMAError) as e:
            raise ParseError(str(e)) from e
        for i, (name, body, problem) in enumerate(found):
            node = tree.add("member", 0, name or options.get("filename", f"member-{i}"), None, type="file", bytes=len(body), sha256="sha256:" + hashlib.sha256(body).hexdigest(), disposition="extracted")
            if problem:
                tree.warn(f"{format}.{'truncated' if problem == 'truncated' else 'malformed'}", problem, parent=node)
            if options.get("contents"):
                tree.add("content", node, None, body.decode("latin-1"))
        tree.set(0, members=len(found))
        if len(found) == 1 and len(found[0][1]) > 262 and found[0][1][257:262] == b"ustar":
            _tar(tree, found[0][1], len(data), options.get("contents", False))
        return tree

    return parse


def _bounded(decompressor, data: bytes) -> list[tuple[None, bytes, str | None]]:
    room = min(MAX_UNPACKED, max(1 << 20, MAX_RATIO * len(data)))
    body = decompressor.decompress(data, room)
    return [(None, body, None if decompressor.eof else "budget_exhausted" if len(body) >= room else "truncated")]


def _zstd(data: bytes) -> list[tuple[None, bytes, str | None]]:
    try:
        import zstandard
    except ImportError as e:  # pragma: no cover
        raise ParseError("no reader for Zstandard here") from e
    room = min(MAX_UNPACKED, max(1 << 20, MAX_RATIO * len(data)))
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as r:
        body = r.read(room + 1)
    return [(None, body[:room], "budget_exhausted" if len(body) > room else None)]


def parse_seven_zip(data: bytes, options: dict) -> Tree:
    """The header alone: the version and where the list of members lies. Members can't be read here."""
    if data[:6] != b"7z\xbc\xaf\x27\x1c" or len(data) < 32:
        raise ParseError("no 7z header", 0)
    tree = Tree("7z", version=f"{data[6]}.{data[7]}", header_offset=32 + int.from_bytes(data[12:20], "little"), header_bytes=int.from_bytes(data[20:28], "little"), header_checked=zlib.crc32(data[12:32]) == int.from_bytes(data[8:12], "little"))
    tree.warn("7z.unsupported", "members are not decoded")
    return tree


PARSERS = {
    "zip": parse_zip, "tar": parse_tar, "gzip": _single("gzip", gzip_members), "bzip2": _single("bzip2", lambda d: _bounded(bz2.BZ2Decompressor(), d)), "xz": _single("xz", lambda d: _bounded(lzma.LZMADecompressor(), d)),
    "zstd": _single("zstd", _zstd), "7z": parse_seven_zip,
}
