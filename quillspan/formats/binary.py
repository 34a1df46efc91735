"""Binary values: CBOR, MessagePack, protocol buffers, Arrow, Parquet and SQLite."""

from __future__ import annotations

import datetime
import io
import struct

from quillspan.formats.base import MAX_DEPTH, ParseError, Tree
from quillspan.formats.structured import escape, scalar


class _Reader:
    """Reads a byte string from front to back."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ParseError("input ends too early", self.at)
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")


def _cbor(r: _Reader, tree: Tree, parent: int, name: str | None, pointer: str, depth: int = 0, **attrs: object) -> None:
    if depth > MAX_DEPTH:
        raise ParseError("nested too deeply", r.at)
    start = r.at
    first = r.number(1)
    major, info = first >> 5, first & 31
    if info >= 28 and info != 31:
        raise ParseError("reserved length", start)
    open_ = info == 31
    n = info if info < 24 else 0 if open_ else r.number(1 << (info - 24))

    def add(kind: str, value: object = None) -> int:
        return tree.add(kind, parent, name, value, start, r.at, pointer=pointer, **attrs)

    if major == 0:
        add("integer", n)
    elif major == 1:
        add("integer", -1 - n)
    elif major in (2, 3):
        parts = []
        if open_:
            while r.data[r.at : r.at + 1] != b"\xff":
                head = r.number(1)
                if head >> 5 != major or head & 31 > 27:
                    raise ParseError("bad chunk", r.at - 1)
                k = head & 31
                parts.append(r.take(k if k < 24 else r.number(1 << (k - 24))))
            r.take(1)
        else:
            parts.append(r.take(n))
        data = b"".join(parts)
        if major == 2:
            add("bytes", data.hex())
        else:
            try:
                add("string", data.decode())
            except UnicodeDecodeError as e:
                raise ParseError("text is no UTF-8", start) from e
    elif major in (4, 5):
        node, i = add("array" if major == 4 else "object"), 0
        while (r.data[r.at : r.at + 1] != b"\xff") if open_ else i < n:
            key = str(i)
            if major == 5:
                inner = Tree("key")
                _cbor(r, inner, 0, None, "", depth + 1)
                key = inner.rows[1][4] if inner.rows[1][4] is not None else inner.rows[1][2]
            _cbor(r, tree, node, key, f"{pointer}/{escape(key)}", depth + 1)
            i += 1
        if open_:
            r.take(1)
        tree.rows[node] = (*tree.rows[node][:7], r.at)
        tree.set(node, size=i, indefinite=open_ or None)
    elif major == 6:
        if n in (2, 3):
            inner = Tree("big")
            _cbor(r, inner, 0, None, "", depth + 1)
            big = int(inner.rows[1][4] or "0", 16)
            tree.add("integer", parent, name, big if n == 2 else -1 - big, start, r.at, pointer=pointer, tag=n, **attrs)
        else:
            _cbor(r, tree, parent, name, pointer, depth + 1, tag=n)
    elif info in (20, 21):
        add("boolean", info == 21)
    elif info in (22, 23):
        add("null" if info == 22 else "undefined")
    elif info in (25, 26, 27):
        add("decimal", repr(struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], n.to_bytes(1 << (info - 24), "big"))[0]))
    else:
        if open_:
            raise ParseError("break without an open item", start)
        add("simple", n)


def parse_cbor(data: bytes, options: dict) -> Tree:
    """One item or a sequence of items."""
    tree, r, i = Tree("cbor"), _Reader(data), 0
    while r.at < len(data):
        _cbor(r, tree, 0, str(i), "")
        i += 1
    tree.set(0, items=i)
    return tree


def _msgpack(r: _Reader, tree: Tree, parent: int, name: str | None, pointer: str, depth: int = 0) -> None:
    if depth > MAX_DEPTH:
        raise ParseError("nested too deeply", r.at)
    start = r.at
    b = r.number(1)

    def add(kind: str, value: object = None, **attrs: object) -> int:
        return tree.add(kind, parent, name, value, start, r.at, pointer=pointer, **attrs)

    def items(n: int, pairs: bool) -> None:
        node = add("object" if pairs else "array", size=n)
        for i in range(n):
            key = str(i)
            if pairs:
                inner = Tree("key")
                _msgpack(r, inner, 0, None, "", depth + 1)
                key = inner.rows[1][4] if inner.rows[1][4] is not None else inner.rows[1][2]
            _msgpack(r, tree, node, key, f"{pointer}/{escape(key)}", depth + 1)
        tree.rows[node] = (*tree.rows[node][:7], r.at)

    def text(n: int) -> None:
        raw = r.take(n)
        try:
            add("string", raw.decode())
        except UnicodeDecodeError:
            add("bytes", raw.hex(), malformed="text is no UTF-8")

    def ext(n: int) -> None:
        kind = int.from_bytes(r.take(1), "big", signed=True)
        raw = r.take(n)
        if kind == -1 and n in (4, 8, 12):
            if n == 4:
                seconds, nanos = int.from_bytes(raw, "big"), 0
            elif n == 8:
                both = int.from_bytes(raw, "big")
                nanos, seconds = both >> 34, both & ((1 << 34) - 1)
            else:
                nanos, seconds = int.from_bytes(raw[:4], "big"), int.from_bytes(raw[4:], "big", signed=True)
            stamp = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)
            add("date-time", f"{stamp.isoformat()}.{nanos:09d}Z", ext=kind)
        else:
            add("bytes", raw.hex(), ext=kind)

    if b < 0x80:
        add("integer", b)
    elif b < 0x90:
        items(b & 15, True)
    elif b < 0xA0:
        items(b & 15, False)
    elif b < 0xC0:
        text(b & 31)
    elif b >= 0xE0:
        add("integer", b - 256)
    elif b == 0xC0:
        add("null")
    elif b == 0xC1:
        raise ParseError("byte that is never used", start)
    elif b in (0xC2, 0xC3):
        add("boolean", b == 0xC3)
    elif b in (0xC4, 0xC5, 0xC6):
        add("bytes", r.take(r.number(1 << (b - 0xC4))).hex())
    elif b in (0xC7, 0xC8, 0xC9):
        ext(r.number(1 << (b - 0xC7)))
    elif b == 0xCA:
        add("decimal", repr(struct.unpack(">f", r.take(4))[0]))
    elif b == 0xCB:
        add("decimal", repr(struct.unpack(">d", r.take(8))[0]))
    elif b <= 0xCF:
        add("integer", r.number(1 << (b - 0xCC)))
    elif b <= 0xD3:
        add("integer", int.from_bytes(r.take(1 << (b - 0xD0)), "big", signed=True))
    elif b <= 0xD8:
        ext(1 << (b - 0xD4))
    elif b <= 0xDB:
        text(r.number(1 << (b - 0xD9)))
    elif b <= 0xDD:
        items(r.number(2 << (b - 0xDC)), False)
    else:
        items(r.number(2 << (b - 0xDE)), True)


def parse_msgpack(data: bytes, options: dict) -> Tree:
    tree, r, i = Tree("msgpack"), _Reader(data), 0
    while r.at < len(data):
        _msgpack(r, tree, 0, str(i), "")
        i += 1
    tree.set(0, items=i)
    return tree


def _varint(r: _Reader) -> int:
    value = shift = 0
    while True:
        b = r.number(1)
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value & (2**64 - 1)
        if shift > 63:
            raise ParseError("number is too long", r.at)


def parse_protobuf(data: bytes, options: dict) -> Tree:
    """Options descriptor (a serialized FileDescriptorSet) and message (its full name); both are needed, as the wire
    alone does not say what a field is. Unknown fields are kept by number."""
    if "descriptor" not in options or "message" not in options:
        raise ParseError("a descriptor set and a message name are needed")
    try:
        from google.protobuf import descriptor_pb2
    except ImportError as e:  # pragma: no cover
        raise ParseError("no reader for descriptor sets here") from e
    files = descriptor_pb2.FileDescriptorSet.FromString(options["descriptor"])
    messages, enums = {}, {}

    def collect(prefix: str, items, enum_items) -> None:
        for m in items:
            messages[f"{prefix}.{m.name}"] = m
            collect(f"{prefix}.{m.name}", m.nested_type, m.enum_type)
        for e in enum_items:
            enums[f"{prefix}.{e.name}"] = {v.number: v.name for v in e.value}

    for f in files.file:
        collect(f".{f.package}" if f.package else "", f.message_type, f.enum_type)
    top = "." + options["message"].lstrip(".")
    if top not in messages:
        raise ParseError(f"no message {options['message']} in the descriptor set")
    tree = Tree("protobuf", message=options["message"])
    # Field types of the descriptor format.
    double, float_, int64, uint64, int32, fixed64, fixed32, bool_, string, group, message, bytes_, uint32, enum, sfixed32, sfixed64, sint32, sint64 = range(1, 19)
    packed_as = {double: 8, fixed64: 8, sfixed64: 8, float_: 4, fixed32: 4, sfixed32: 4}

    def one(kind: int, r: _Reader, type_name: str) -> tuple[str, object]:
        if kind in packed_as:
            raw = r.take(packed_as[kind])
            form = {double: "<d", float_: "<f", fixed64: "<Q", sfixed64: "<q", fixed32: "<I", sfixed32: "<i"}[kind]
            value = struct.unpack(form, raw)[0]
            return ("decimal", repr(value)) if kind in (double, float_) else ("integer", value)
        n = _varint(r)
        if kind == bool_:
            return "boolean", n != 0
        if kind in (sint32, sint64):
            return "integer", (n >> 1) ^ -(n & 1)
        if kind in (int32, int64, enum) and n >= 1 << 63:
            n -= 1 << 64
        return ("enum", enums.get(type_name, {}).get(n, n)) if kind == enum else ("integer", n)

    def read(body: bytes, base: int, type_name: str, parent: int, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise ParseError("nested too deeply", base)
        fields = {f.number: f for f in messages[type_name].field}
        r = _Reader(body)
        while r.at < len(body):
            start = r.at
            key = _varint(r)
            number, wire = key >> 3, key & 7
            field = fields.get(number)
            if wire == 2:
                raw = r.take(_varint(r))
                span = (base + start, base + r.at)
                if field is None:
                    tree.add("unknown", parent, str(number), raw.hex(), *span, wire=wire)
                elif field.type == message:
                    node = tree.add("object", parent, field.name, None, *span, number=number)
                    read(raw, base + r.at - len(raw), field.type_name, node, depth + 1)
                elif field.type in (string, bytes_):
                    tree.add("string" if field.type == string else "bytes", parent, field.name, raw.decode("utf-8", "replace") if field.type == string else raw.hex(), *span, number=number)
                else:
                    inner = _Reader(raw)
                    while inner.at < len(raw):
                        kind, value = one(field.type, inner, field.type_name)
                        tree.add(kind, parent, field.name, value, *span, number=number, packed=True)
            elif wire in (0, 1, 5):
                if field is None:
                    value = _varint(r) if wire == 0 else int.from_bytes(r.take(8 if wire == 1 else 4), "little")
                    tree.add("unknown", parent, str(number), value, base + start, base + r.at, wire=wire)
                else:
                    kind, value = one(field.type, r, field.type_name)
                    tree.add(kind, parent, field.name, value, base + start, base + r.at, number=number)
            else:
                raise ParseError(f"wire type {wire} is not read", base + start)

    read(data, 0, top, 0, 0)
    return tree


def _selected(options: dict, column: str) -> bool:
    """An empty selection takes all columns; a name takes the column and what is below it."""
    wanted = options.get("columns") or []
    return not wanted or column in wanted or column.split(".")[0] in wanted


def _columnar(tree: Tree, schema, batches, options: dict) -> None:
    """Schema, batches and rows of a columnar file: options columns, row_start, row_limit (1,000,000), batch_start,
    batch_limit."""
    head = tree.add("schema", 0)
    for field in schema:
        tree.add("field", head, field.name, str(field.type), nullable=field.nullable, selected=_selected(options, field.name))
    start, limit = options.get("row_start", 0), options.get("row_limit", 1_000_000)
    first, most = options.get("batch_start", 0), options.get("batch_limit")
    row = 0
    for i, batch in enumerate(batches):
        if i >= first and (most is None or i < first + most):
            node = tree.add("batch", 0, str(i), None, rows=batch.num_rows, first_row=row)
            names = [n for n in batch.schema.names if _selected(options, n)]
            low, high = max(0, start - row), max(0, min(batch.num_rows, start + limit - row))
            for j, values in enumerate(batch.select(names).slice(low, max(0, high - low)).to_pylist(), low):
                line = tree.add("record", node, str(row + j))
                for k, v in values.items():
                    kind, text = scalar(v) if not isinstance(v, (dict, list)) else ("nested", str(v))
                    tree.add(kind, line, k, text)
        row += batch.num_rows
    tree.set(0, rows=row)


def parse_arrow(data: bytes, options: dict) -> Tree:
    """File and stream framing."""
    import pyarrow as pa

    tree = Tree("arrow", framing="file" if data[:6] == b"ARROW1" else "stream")
    if data[:6] == b"ARROW1":
        reader = pa.ipc.open_file(io.BytesIO(data))
        _columnar(tree, reader.schema, (reader.get_batch(i) for i in range(reader.num_record_batches)), options)
    else:
        reader = pa.ipc.open_stream(io.BytesIO(data))
        _columnar(tree, reader.schema, reader, options)
    return tree


def parse_parquet(data: bytes, options: dict) -> Tree:
    """Row groups are the batches."""
    import pyarrow.parquet as pq

    file = pq.ParquetFile(io.BytesIO(data))
    tree = Tree("parquet", row_groups=file.num_row_groups, created_by=file.metadata.created_by)
    names = [n for n in file.schema_arrow.names if _selected(options, n)]

    def groups():
        for i in range(file.num_row_groups):
            t = file.read_row_group(i, columns=names).combine_chunks()
            yield t.to_batches()[0] if t.num_rows else t.slice(0, 0).to_batches(1)[0] if t.to_batches() else t

    _columnar(tree, file.schema_arrow, groups(), options)
    return tree


def parse_sqlite(data: bytes, options: dict) -> Tree:
    """Tables, views, indexes and triggers as declared; rows only of the tables named in the option tables, max_rows
    (1,000) of each. Nothing the file holds is run."""
    import sqlite3

    if not data.startswith(b"SQLite format 3\x00"):
        raise ParseError("no SQLite 3 header", 0)
    tree = Tree("sqlite", page_size=int.from_bytes(data[16:18], "big"), wal=data[18] == 2)
    if data[18] == 2:
        data = data[:18] + b"\x01\x01" + data[20:]  # a copy of the file alone can't open its log
        tree.warn("sqlite.unreplayed_log", "changes in a write-ahead log beside the file are not seen")
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    db.execute("PRAGMA query_only=1")
    db.execute("PRAGMA trusted_schema=0")
    wanted, most = options.get("tables", []), options.get("max_rows", 1000)
    for kind, name, sql in db.execute("SELECT type, name, sql FROM sqlite_schema ORDER BY type, name").fetchall():
        node = tree.add(kind, 0, name, sql)
        if kind == "table":
            quoted = '"' + name.replace('"', '""') + '"'
            columns = [c[1] for c in db.execute(f"PRAGMA table_info({quoted})")]
            for c in columns:
                tree.add("column", node, c)
            if name in wanted:
                rows = db.execute(f"SELECT * FROM {quoted} LIMIT {int(most) + 1}").fetchall()
                for i, row in enumerate(rows[:most]):
                    line = tree.add("record", node, str(i))
                    for c, v in zip(columns, row):
                        tree.add(*((k := scalar(v))[0], line, c, k[1]))
                if len(rows) > most:
                    tree.warn("sqlite.truncated", f"more than {most} rows", parent=node)
    return tree


PARSERS = {"cbor": parse_cbor, "msgpack": parse_msgpack, "protobuf": parse_protobuf, "arrow": parse_arrow, "parquet": parse_parquet, "sqlite": parse_sqlite}
