"""Mail: messages with headers, MIME parts, attachments and thread evidence; mbox files; TNEF and Outlook containers."""

from __future__ import annotations

import base64
import hashlib
import re
from email import message_from_bytes
from email.header import decode_header
from email.message import Message
from email.policy import compat32
from email.utils import getaddresses, parsedate_to_datetime

from quillspan.formats.base import MAX_DEPTH, ParseError, Tree

_FROM = re.compile(rb"(?m)^From [^\r\n]*\r?\n")
_IDS = re.compile(r"<[^<>]*>")
# Header fields with addresses, and named time zones in minutes.
ADDRESS_FIELDS = ("from", "sender", "reply-to", "to", "cc", "bcc")
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def decoded_header(raw: str) -> str:
    """A header value with its encoded words decoded; what can't be decoded stays."""
    try:
        return "".join(part.decode(charset or "ascii", "replace") if isinstance(part, bytes) else part for part, charset in decode_header(raw))
    except (LookupError, ValueError):
        return raw


def zone_minutes(date: str) -> int | None:
    """Minutes of the offset or the named zone at the end of a date."""
    m = re.search(r"([+-])(\d{2})(\d{2})\s*(?:\([^)]*\))?\s*$", date)
    if m:
        return (int(m[2]) * 60 + int(m[3])) * (-1 if m[1] == "-" else 1)
    words = re.sub(r"\([^)]*\)\s*$", "", date).split()
    return ZONES.get(words[-1].upper()) if words else None


def _headers(tree: Tree, msg: Message, parent: int) -> None:
    for i, (name, raw) in enumerate(msg.items()):
        raw = str(raw)
        value = re.sub(r"\r?\n(?=[ \t])", "", raw)
        low = name.lower()
        node = tree.add("header", parent, low, decoded_header(value), ordinal=i, raw=raw, field=name)
        if low in ADDRESS_FIELDS:
            for shown, address in getaddresses([decoded_header(value)]):
                tree.add("address", node, shown or None, address)
        elif low in ("date", "resent-date"):
            try:
                at = parsedate_to_datetime(value).isoformat()
            except (ValueError, TypeError):
                at = None
            tree.add("date", node, None, at, zone_minutes=zone_minutes(value))
        elif low in ("message-id", "in-reply-to", "references"):
            for x in _IDS.findall(value) or value.split():
                tree.add("message_id", node, low, x)
        elif low in ("authentication-results", "dkim-signature", "received-spf", "arc-authentication-results"):
            tree.add("authentication", node, low, value)


def _part(tree: Tree, msg: Message, parent: int, depth: int) -> None:
    if depth > MAX_DEPTH:
        raise ParseError("nested too deeply")
    kind = msg.get_content_type()
    node = tree.add("part", parent, kind, None, charset=msg.get_content_charset(), encoding=str(msg.get("content-transfer-encoding", "")).lower() or None, disposition=msg.get_content_disposition())
    if kind == "message/rfc822" and msg.is_multipart():
        inner = msg.get_payload(0)
        message = tree.add("message", node)
        _headers(tree, inner, message)
        _part(tree, inner, message, depth + 1)
    elif msg.is_multipart():
        for part in msg.get_payload():
            _part(tree, part, node, depth + 1)
    else:
        body = msg.get_payload(decode=True) or b""
        if msg.get_content_disposition() == "attachment" or msg.get_filename() or not kind.startswith("text/"):
            secure = kind in ("application/pkcs7-mime", "application/x-pkcs7-mime", "application/pgp-encrypted")
            tree.add("attachment", node, msg.get_filename(), None, bytes=len(body), sha256="sha256:" + hashlib.sha256(body).hexdigest(), decryption="provider needed" if secure else None)
            if kind == "application/ms-tnef" or body[:4] == b"\x78\x9f\x3e\x22":
                tnef(tree, body, node)
        else:
            try:
                text = body.decode(msg.get_content_charset() or "utf-8", "replace")
            except LookupError:
                text = body.decode("utf-8", "replace")
                tree.add("diagnostic", node, "mail.unknown_charset", msg.get_content_charset())
            tree.add("body", node, kind, text)
    for defect in msg.defects:
        tree.warn("mail.defect", type(defect).__name__, parent=node)


def tnef(tree: Tree, data: bytes, parent: int) -> None:
    """Lists the attributes of a TNEF stream."""
    at = 6
    while at + 9 <= len(data):
        size = int.from_bytes(data[at + 5 : at + 9], "little")
        if at + 11 + size > len(data):
            tree.warn("tnef.truncated", "attribute ends too early", parent=parent)
            return
        body = data[at + 9 : at + 9 + size]
        checked = sum(body) & 0xFFFF == int.from_bytes(data[at + 9 + size : at + 11 + size], "little")
        tree.add("tnef_attribute", parent, f"{int.from_bytes(data[at + 1 : at + 5], 'little'):#010x}", None, level="message" if data[at] == 1 else "attachment", bytes=size, checksum=checked)
        at += 11 + size


def _message(tree: Tree, data: bytes, parent: int) -> None:
    msg = message_from_bytes(data, policy=compat32)
    _headers(tree, msg, parent)
    _part(tree, msg, parent, 0)


def parse_eml(data: bytes, options: dict) -> Tree:
    tree = Tree("eml")
    _message(tree, data, 0)
    return tree


def messages(data: bytes) -> list[tuple[int, int, bool, bool]]:
    """(start, end of the body, whether a content length gave its end, whether an escaped From was found) of the messages
    of an mbox file, the separator being before the start."""
    found, at = [], 0
    while m := _FROM.search(data, at):
        start = m.end()
        head = re.compile(rb"\r?\n\r?\n").search(data, start)
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", data[start : head.start()]) if head else None
        end = None
        if length and head:
            stop = head.end() + int(length[1])
            if stop <= len(data) and re.match(rb"(?:\r?\n)*(?:From |\Z)", data[stop:]):
                end = stop
        if end is None:
            nxt = _FROM.search(data, start)
            while nxt and not re.search(rb"\r?\n\r?\n\Z|\A\Z", data[start : nxt.start()]):
                nxt = _FROM.search(data, nxt.end())
            end = nxt.start() if nxt else len(data)
            counted = False
        else:
            counted = True
        body = data[head.end() if head else end : end]
        found.append((start, end, counted, re.search(rb"(?m)^>+From ", body) is not None))
        at = end
    return found


def variant(found: list[tuple[int, int, bool, bool]]) -> str:
    """How an mbox file keeps lines that begin with From: mboxcl and mboxcl2 give a content length, mboxrd escapes."""
    counted, escaped = sum(f[2] for f in found), any(f[3] for f in found)
    if not found:
        return "unknown"
    if counted == len(found):
        return "mboxcl" if escaped else "mboxcl2"
    if counted:
        return "mixed"
    return "mboxrd" if escaped else "mboxo"


def parse_mbox(data: bytes, options: dict) -> Tree:
    """message rows in order with headers and parts, the variant of the file, and thread rows: in-reply-to and references
    with the first message of that id."""
    found = messages(data)
    kind = variant(found)
    tree = Tree("mbox", variant=kind, messages=len(found))
    if not found and data.strip():
        raise ParseError("no message separator", 0)
    ids: dict[str, int] = {}
    links: list[tuple[int, str, str]] = []
    for i, (start, end, counted, _) in enumerate(found):
        body = data[start:end]
        if not counted:
            body = re.sub(rb"(?m)^>(>*From )", rb"\1", body) if kind == "mboxrd" else body
            body = re.sub(rb"\r?\n\Z", b"", body)
        node = tree.add("message", 0, str(i), None, start, end, content_length=counted)
        mark = len(tree.rows)
        _message(tree, body, node)
        for r in tree.rows[mark:]:
            if r[2] == "message_id" and tree.rows[r[1]][1] == node:
                if r[3] == "message-id":
                    ids.setdefault(r[4], i)
                else:
                    links.append((node, r[3], r[4]))
    for node, relation, ident in dict.fromkeys(links):
        tree.add("thread", node, relation, ident, target=ids.get(ident), resolved=ident in ids)
    return tree


def _compound(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by path."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ParseError("no compound file header", 0)
    size, mini = 1 << int.from_bytes(data[30:32], "little"), 1 << int.from_bytes(data[32:34], "little")
    n_fat, first_dir, cutoff, first_mini, _, first_difat, n_difat = (int.from_bytes(data[a : a + 4], "little") for a in (44, 48, 56, 60, 64, 68, 72))

    def sector(i: int) -> bytes:
        return data[(i + 1) * size : (i + 2) * size]

    def numbers(raw: bytes) -> list[int]:
        return [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]

    difat, i, seen = numbers(data[76:512]), first_difat, 0
    while i < 0xFFFFFFFC and seen < n_difat:
        more = numbers(sector(i))
        difat += more[:-1]
        i, seen = more[-1], seen + 1
    fat = [x for s in difat[:n_fat] if s < 0xFFFFFFFC for x in numbers(sector(s))]

    def chain(i: int, table: list[int], read) -> bytes:
        out, seen = [], set()
        while i < 0xFFFFFFFC and i < len(table) and i not in seen:
            seen.add(i)
            out.append(read(i))
            i = table[i]
        return b"".join(out)

    directory = chain(first_dir, fat, sector)
    minifat = numbers(chain(first_mini, fat, sector))
    entries = []
    for k in range(0, len(directory), 128):
        e = directory[k : k + 128]
        n = int.from_bytes(e[64:66], "little")
        entries.append((e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], *(int.from_bytes(e[a : a + 4], "little") for a in (68, 72, 76, 116, 120))))
    root = chain(entries[0][5], fat, sector) if entries else b""
    out: dict[str, bytes] = {}

    def walk(i: int, path: str, depth: int) -> None:
        if i >= len(entries) or depth > MAX_DEPTH:
            return
        name, kind, left, right, child, start, length = entries[i]
        walk(left, path, depth + 1)
        if kind == 1:
            walk(child, f"{path}{name}/", depth + 1)
        elif kind == 2:
            out[path + name] = (chain(start, minifat, lambda j: root[j * mini : (j + 1) * mini]) if length < cutoff else chain(start, fat, sector))[:length]
        walk(right, path, depth + 1)

    if entries:
        walk(entries[0][4], "", 0)
    return out


# Property numbers of a message and of its recipients and attachments.
MSG_PROPERTIES = {0x0037: "subject", 0x1000: "body", 0x0C1A: "sender_name", 0x0C1F: "sender_address", 0x0E04: "to", 0x0E03: "cc", 0x1035: "message_id", 0x007D: "transport_headers", 0x3001: "name", 0x3003: "address", 0x3707: "filename", 0x370E: "media_type"}


def parse_msg(data: bytes, options: dict) -> Tree:
    """Outlook messages: text properties of the message, its recipients and attachments."""
    tree = Tree("outlook_msg")
    parents = {"": 0}
    for path, body in sorted(_compound(data).items()):
        folder, _, name = path.rpartition("/")
        if folder not in parents:
            kind = "recipient" if folder.startswith("__recip") else "attachment" if folder.startswith("__attach") else "storage"
            parents[folder] = tree.add(kind, 0, folder)
        m = re.match(r"__substg1\.0_([0-9A-F]{4})([0-9A-F]{4})", name)
        if not m:
            continue
        number, kind = int(m[1], 16), int(m[2], 16)
        if kind in (0x001E, 0x001F):
            tree.add("property", parents[folder], MSG_PROPERTIES.get(number, m[1].lower()), body.decode("utf-16-le" if kind == 0x1F else "cp1252", "replace"))
        else:
            tree.add("property", parents[folder], MSG_PROPERTIES.get(number, m[1].lower()), None, bytes=len(body), sha256="sha256:" + hashlib.sha256(body).hexdigest())
    return tree


def transfer_decoded(data: bytes, encoding: str) -> tuple[bytes, str | None]:
    """(the bytes behind a transfer encoding, what is wrong with it)."""
    kind = encoding.strip().lower()
    if kind == "base64":
        bare = re.sub(rb"[^A-Za-z0-9+/=]", b"", data)
        issue = None if len(bare) == len(re.sub(rb"\s", b"", data)) else "characters outside the alphabet"
        bare = bare.rstrip(b"=")
        if len(bare) % 4 == 1:
            bare, issue = bare[:-1], "incomplete"
        return base64.b64decode(bare + b"=" * (-len(bare) % 4)), issue
    if kind == "quoted-printable":
        issue = "bad escape" if re.search(rb"=(?![0-9A-Fa-f]{2}|[ \t]*\r?\n|[ \t]*\Z)", data) else None
        data = re.sub(rb"[ \t]+(?=\r?\n|\Z)", b"", data)
        data = re.sub(rb"=\r?\n", b"", data)
        return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data), issue
    return data, None if kind in ("", "7bit", "8bit", "binary") else "unknown encoding"


PARSERS = {"eml": parse_eml, "mbox": parse_mbox, "outlook_msg": parse_msg}
