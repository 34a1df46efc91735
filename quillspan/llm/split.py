"""Splitting long texts at natural boundaries, byte range by byte range.

A text, a row's or a whole file, is read in ranges of bytes with a halo on both sides. A worker sees one range: it counts
the range's characters, notes the lines that may open or close a code block, and keeps the best boundary of each cell of
a few hundred bytes, once for text and once for code. Whether a stretch is code depends on the fences before it, so the
range also says which state it leaves for each state it may be entered in. Ranges are stitched into sections and sections
into texts: prefix sums of lengths give offsets, and the composed states tell which boundaries hold. Sections meet at the
best boundary of the range between them, so the pieces of each section are chosen on its own boundary table and cut out
by offset. No worker needs a whole text to find its pieces, and what is gathered for a text is one short row per section.
"""

from __future__ import annotations

import functools
import marshal
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.session import Scratch

LIMIT = 4000
OVERLAP = 200
#: Bytes of a range, of its halos and of a cell, and ranges of a section.
RANGE = 32_768
HALO = 256
CELL = 200
SECTION = 32
#: Bytes of files that one task reads, at most.
TASK_BYTES = 256 << 20

HEADING, BLOCK, ITEM, LINE, CODE_LINE, SENTENCE, CLAUSE, WORD, ANY = range(8, -1, -1)

_FENCE = re.compile(r" {0,3}(?:(?P<tick>`{3,})(?P<a>[^`\r\n]*)|(?P<tilde>~{3,})(?P<b>[^\r\n]*))(?:[\r\n]|\Z)")
_LINE = re.compile(r"\r\n|\n|\r")
_HEADING = re.compile(r" {0,3}#{1,6}\s|<h[1-6]\b|\\(?:sub)*section\b", re.I)
_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,4}[.)])\s|\s*\||\s*>|<(?:p|li|tr|div|table)\b", re.I)
_SOFT = re.compile(r"(?P<s>[.!?…。！？][\"'”’»)\]]*(?:\s+|(?<=[。！？]))(?=\S))|(?P<c>[,;:—–、；]\s*(?=\S))|(?P<w>\s+(?=\S))")
#: States of a text: outside of code, or in a block opened by so many ticks or tildes (8 and more count as 8).
STATES = ["", *("`" * n for n in range(3, 9)), *("~" * n for n in range(3, 9))]
_STATE = {s: i for i, s in enumerate(STATES)}


class Mark(NamedTuple):
    """A boundary: characters and bytes from the start of its range, and its rank."""

    at: int
    byte: int
    rank: int


class Fence(NamedTuple):
    """A line that may open or close code: its start and end, the state it would open, whether it may close one."""

    start: Mark
    end: Mark
    opens: int
    bare: bool


class Table(NamedTuple):
    """What is known of a range: its length and, before the first and behind each of its fence lines, the best boundaries
    of its cells, once as text and once as code."""

    chars: int
    bytes: int
    fences: list[Fence]
    text: list[list[Mark]]
    code: list[list[Mark]]


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part what belongs together: CR and LF, a letter and its marks."""
    a, b = text[at - 1], text[at]
    return a == "\r" and b == "\n" or unicodedata.combining(b) > 0 or a == "‍" or b in "‍️︎"


def _start(data: bytes, at: int) -> int:
    """The first byte from ``at`` on that begins a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def scan(data: bytes, left: int, size: int, first: bool) -> Table:
    """The boundary table of one range. data: the range with ``left`` bytes of halo before it.

    A range owns the characters that begin in it. Bytes that are no UTF-8 are read as replacement characters.
    """
    low, high = (0 if first else _start(data, left)), _start(data, min(left + size, len(data)))
    head = data[_start(data, 0) : low].decode("utf-8", "replace")
    own = data[low:high].decode("utf-8", "replace")
    text = head + own + data[high:].decode("utf-8", "replace")
    i0, i1 = len(head), len(head) + len(own)
    marks: list[tuple[int, int, int]] = []  # place, rank in text, rank in code
    fences: list[tuple[int, int, int, bool]] = []
    blank = first
    starts = [0, *(m.end() for m in _LINE.finditer(text))]
    for i, at in enumerate(starts):
        stop = starts[i + 1] if i + 1 < len(starts) else len(text)
        if at >= i1:
            break
        empty = text[at:stop].isspace() or at == stop
        if at >= i0 and not empty and (at > 0 or first):
            fence = _FENCE.match(text, at, stop)
            if fence:
                run = fence["tick"] or fence["tilde"]
                fences.append((at, stop, _STATE[run[:8]], not (fence["a"] or fence["b"] or "").strip()))
            elif at > i0 or not first:
                marks.append((at, HEADING if _HEADING.match(text, at, stop) else BLOCK if blank else ITEM if _ITEM.match(text, at, stop) else LINE, CODE_LINE))
        blank = empty
    for m in _SOFT.finditer(text, max(0, i0 - 1), min(len(text), i1 + 1)):
        if i0 <= m.end() < i1:
            rank = SENTENCE if m["s"] is not None else CLAUSE if m["c"] is not None else WORD
            marks.append((m.end(), rank, min(rank, WORD)))
    cell, filled = max(1, CELL * len(own) // max(1, high - low)), set()
    edges = [f[0] for f in fences]
    best: list[list[dict[int, tuple[int, int]]]] = [[{} for _ in range(len(fences) + 1)] for _ in "tc"]
    k = 0
    for mark in sorted(marks):
        at = mark[0]
        while k < len(edges) and edges[k] <= at:
            k += 1
        if 0 < at < len(text) and not _joined(text, at):
            c = (at - i0) // cell
            filled.add(c)
            for case in (0, 1):
                if (value := (mark[case + 1], at)) > best[case][k].get(c, (-1, 0)):
                    best[case][k][c] = value
    for c in range((len(own) + cell - 1) // cell):
        if c not in filled:
            at = min(i0 + (c + 1) * cell, i1) - 1
            while at > i0 + c * cell and (at >= len(text) or _joined(text, at)):
                at -= 1
            if at > 0:
                k = sum(e <= at for e in edges)
                best[0][k][c] = best[1][k][c] = (ANY, at)
    places = sorted({at for case in best for part in case for _, at in part.values()} | {x for f in fences for x in f[:2]})
    byte, sofar, prev = {}, 0, i0
    for at in places:
        sofar += len(text[prev:at].encode("utf-8", "replace"))
        byte[at], prev = sofar, at

    def mark_of(at: int, rank: int) -> Mark:
        return Mark(at - i0, byte[at], rank)

    tables = [[[mark_of(at, rank) for rank, at in (part[c] for c in sorted(part))] for part in case] for case in best]
    return Table(len(own), high - low, [Fence(mark_of(a, -1), mark_of(b, -1), o, bare) for a, b, o, bare in fences], *tables)


def after(state: int, fence: Fence) -> int:
    """The state behind a fence line."""
    if not state:
        return fence.opens
    closing, open_ = STATES[fence.opens], STATES[state]
    return 0 if fence.bare and closing[0] == open_[0] and len(closing) >= len(open_) else state


def stitch(table: Table, state: int, at: int, byte: int) -> tuple[list[tuple[int, int, int]], int]:
    """(boundaries of a range entered in ``state`` as (character, byte, rank) of the whole text, the state it leaves)."""
    cuts = [(at + m.at, byte + m.byte, m.rank) for m in (table.code if state else table.text)[0]]
    for k, fence in enumerate(table.fences, 1):
        was, state = state, after(state, fence)
        cuts.append((at + fence.start.at, byte + fence.start.byte, CODE_LINE if was else BLOCK))
        cuts.append((at + fence.end.at, byte + fence.end.byte, BLOCK if was and not state else CODE_LINE))
        cuts += [(at + m.at, byte + m.byte, m.rank) for m in (table.code if state else table.text)[k]]
    return cuts, state


def choose(cuts: list[tuple[int, int, int]], start: tuple[int, int], end: tuple[int, int], limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, byte of the cut before, byte of the end) of the pieces from one place (character, byte) to another.

    Among the boundaries in the last half of the room the best rank wins, then the last place. Every piece but a text's
    first starts ``overlap`` characters before the end of the one before it and has at most ``limit`` characters.
    """
    out, (done, byte), k = [], start, 0
    while True:
        begin = max(0, done - overlap)
        if end[0] - begin <= limit:
            return [*out, (begin, end[0], byte, end[1])] if end[0] > done else out
        best = None
        while k < len(cuts) and cuts[k][0] <= done:
            k += 1
        i = k
        while i < len(cuts) and cuts[i][0] <= begin + limit:
            at, b, rank = cuts[i]
            value = (at > begin + limit // 2, rank, at, b)
            if best is None or value > best:
                best = value
            i += 1
        if best is None:  # no boundary at all in the room: only text that belongs together
            raise ValueError("the limit must be larger than a cell")
        out.append((begin, best[2], byte, best[3]))
        done, byte = best[2:]


def _composed(tables: list[Table]) -> list[int]:
    """The state a section leaves for each state it may be entered in."""
    fences = [fence for t in tables for fence in t.fences]
    return [functools.reduce(after, fences, state) for state in range(len(STATES))]


def _anchor(table: Table, state: int, at: int, byte: int) -> tuple[int, int]:
    """Where the sections before and from this range on meet: at its best boundary, the first of equals."""
    cuts, _ = stitch(table, state, at, byte)
    a, b, _ = max((c for c in cuts if at <= c[0] < at + table.chars), key=lambda c: (c[2], -c[0]), default=(at, byte, 0))
    return a, b


def _table(blob: bytes) -> Table:
    chars, size, fences, text, code = marshal.loads(blob)
    return Table(chars, size, [Fence(Mark(*a), Mark(*b), o, bare) for a, b, o, bare in fences], *[[[Mark(*m) for m in part] for part in case] for case in (text, code)])


def _rows(tables: list[Table]) -> list[pa.Array]:
    """Arrow columns chars, bytes and table of range tables."""
    blobs = [marshal.dumps((t.chars, t.bytes, [(tuple(f.start), tuple(f.end), f.opens, f.bare) for f in t.fences], *[[[tuple(m) for m in part] for part in case] for case in (t.text, t.code)])) for t in tables]
    return [pa.array([t.chars for t in tables], pa.int64()), pa.array([t.bytes for t in tables], pa.int64()), pa.array(blobs, pa.binary())]


def _offsets(tables: DataFrame, limit: int, overlap: int) -> DataFrame:
    """k, h, piece, start, end, cut and stop (bytes) from range tables (k, h, r, chars, bytes, table); one h for each k."""
    if not 0 <= overlap < limit // 2 or limit < 4 * CELL:
        raise ValueError(f"the overlap must be less than half the limit, and the limit {4 * CELL} or more")
    tables = Scratch(tables.sparkSession, "split").put(tables, "tables")  # small beside the texts, and read for states and for pieces
    tables = tables.groupBy("k", "h", "r").agg(F.first(F.struct("chars", "bytes", "table")).alias("t")).select("k", "h", "r", "t.*")
    shared = F.when((F.col("r") > 0) & (F.col("r") % SECTION == 0), F.array(F.expr(f"r div {SECTION}"), F.expr(f"r div {SECTION} - 1"))).otherwise(F.array(F.expr(f"r div {SECTION}")))
    sections = tables.select("k", "h", F.explode(shared).alias("sec"), "r", "chars", "bytes", "table").groupBy("k", "h", "sec").agg(F.array_sort(F.collect_list(F.struct("r", "chars", "bytes", "table"))).alias("ranges"))

    @F.arrow_udf("array<int>")
    def states(ranges: pa.Array, sec: pa.Array) -> pa.Array:
        rows = zip(ranges.to_pylist(), sec.to_pylist())
        return pa.array([_composed([_table(x["table"]) for x in rs if x["r"] // SECTION == s]) for rs, s in rows], pa.list_(pa.int32()))

    def own(field: str) -> Column:
        return F.aggregate(F.filter("ranges", lambda x: F.floor(x["r"] / SECTION) == F.col("sec")), F.lit(0).cast("long"), lambda n, x: n + x[field])

    summed = sections.select("k", "h", F.struct("sec", own("chars").alias("chars"), own("bytes").alias("bytes"), states("ranges", "sec").alias("states")).alias("s"))
    entry = [("h", pa.int64()), ("sec", pa.int64()), ("state", pa.int32()), ("at", pa.int64()), ("byte", pa.int64())]

    @F.arrow_udf("array<struct<h:long,sec:long,state:int,at:long,byte:long>>")
    def enter(parts: pa.Array) -> pa.Array:
        out = []
        for rows in parts.to_pylist():
            first = min(x["h"] for x in rows)
            state = at = byte = 0
            entered = []
            for x in sorted((x["s"] for x in rows if x["h"] == first), key=lambda s: s["sec"]):
                entered.append({"h": first, "sec": x["sec"], "state": state, "at": at, "byte": byte})
                state, at, byte = x["states"][state], at + x["chars"], byte + x["bytes"]
            out.append(entered)
        return pa.array(out, pa.list_(pa.struct(entry)))

    entered = summed.groupBy("k").agg(F.collect_list(F.struct("h", "s")).alias("parts")).select(F.col("k").alias("ek"), F.explode(enter("parts")).alias("e")).select("ek", F.col("e.h").alias("eh"), F.col("e.sec").alias("esec"), "e.state", "e.at", "e.byte")
    piece = [("start", pa.int64()), ("end", pa.int64()), ("cut", pa.int64()), ("stop", pa.int64())]

    @F.arrow_udf("array<struct<start:long,end:long,cut:long,stop:long>>")
    def pack(ranges: pa.Array, sec: pa.Array, state: pa.Array, at: pa.Array, byte: pa.Array) -> pa.Array:
        out = []
        for rs, s, now, a, b in zip(*(c.to_pylist() for c in (ranges, sec, state, at, byte))):
            start, end, cuts = (0, 0), None, []
            for x in rs:
                table = _table(x["table"])
                if s and x is rs[0]:
                    start = _anchor(table, now, a, b)
                if x["r"] // SECTION > s:
                    end = _anchor(table, now, a, b)
                more, now = stitch(table, now, a, b)
                cuts += more
                a, b = a + table.chars, b + table.bytes
            out.append([dict(zip(("start", "end", "cut", "stop"), p)) for p in choose(sorted(cuts), start, end or (a, b), limit, overlap)])
        return pa.array(out, pa.list_(pa.struct(piece)))

    packed = sections.join(entered, F.col("k").eqNullSafe(F.col("ek")) & (F.col("h") == F.col("eh")) & (F.col("sec") == F.col("esec"))).select("k", "h", "sec", pack("ranges", "sec", "state", "at", "byte").alias("p"))
    packed = packed.withColumn("before", F.sum(F.size("p")).over(Window.partitionBy("k").orderBy("sec")) - F.size("p"))
    return packed.select("k", "h", "before", F.posexplode("p").alias("i", "x")).select("k", "h", (F.col("before") + F.col("i")).cast("int").alias("piece"), "x.start", "x.end", "x.cut", "x.stop")


def _row_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """Range tables of the texts of rows. A row's text is in memory whole; its ranges are slices and never rows of text."""
    rows = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at, no = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = text.encode("utf-8", "replace")
                for r, low in enumerate(range(0, len(data), RANGE)):
                    left = min(HALO, low)
                    found.append(scan(data[low - left : low + RANGE + HALO], left, RANGE, low == 0))
                    at.append(i)
                    no.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), pa.array(no, pa.int64()), *_rows(found)], ["k", "h", "r", "chars", "bytes", "table"])

    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, h long, r long, chars long, bytes long, table binary")


def piece_offsets(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, piece (from 0), start and end (code points) of the pieces of every text longer than the limit.

    Repeated rows of a key count once; of several texts of a key one counts. Null and empty texts and texts within the
    limit are not among them.
    """
    long = df.where(F.length(text) > limit)
    return _offsets(_row_tables(long, key, text), limit, overlap).select(F.col("k").alias(key), "piece", "start", "end")


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, piece, start, end and text of the pieces of every text, in order by piece.

    A text within the limit is one piece; null and empty texts have none. Repeated rows of a key count once.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t != ''").withColumn("h", F.xxhash64("t"))
    short = rows.where(F.length("t") <= limit).groupBy("k").agg(F.min_by("t", "h").alias("t")).select("k", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.length("t").cast("long").alias("end"), "t")
    long = rows.where(F.length("t") > limit)
    cut = _offsets(_row_tables(long, "k", "t"), limit, overlap).groupBy("k", "h").agg(F.collect_list(F.struct("piece", "start", "end")).alias("x")).withColumnsRenamed({"k": "pk", "h": "ph"})
    long = long.dropDuplicates(["k", "h"]).join(cut, F.col("k").eqNullSafe(F.col("pk")) & (F.col("h") == F.col("ph"))).select("k", "t", "x")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, xs = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                at = pa.array([0] * len(xs), pa.int64())
                cols = [pa.array([x[c] for x in xs], kind) for c, kind in (("piece", pa.int32()), ("start", pa.int64()), ("end", pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(at), *cols, pa.array([t[x["start"] : x["end"]] for x in xs], pa.string())], ["k", "piece", "start", "end", "t"])

    long = long.mapInArrow(emit, f"k {dict(rows.dtypes)['k']}, piece int, start long, end long, t string")
    return short.unionByName(long).select(F.col("k").alias(key), "piece", "start", "end", F.col("t").alias("text"))


def _reader(path: str):
    """An open file of any file system that Arrow reads by URI, for reads at an offset."""
    from pyarrow.fs import FileSystem

    system, name = FileSystem.from_uri(path)
    return system.open_input_file(name)


def file_pieces(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, texts: bool = True) -> DataFrame:
    """path, piece, start, end (code points) and, if wanted, text of the pieces of every UTF-8 file below ``path``.

    Files are listed with their lengths and read by byte ranges only, each range by whichever task gets it; the pieces
    are read again by the bytes between two cuts. So a file may be larger than the memory of an executor. Empty files
    have no pieces; a file within the limit is one piece.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select(F.col("path").alias("k"), F.col("length").alias("n"))
    total = files.agg(F.sum("n")).first()[0] or 0
    tasks = max(4 * spark.sparkContext.defaultParallelism, total // TASK_BYTES + 1)  # ranges are small rows, which would else be put into few tasks
    ranges = files.select("k", "n", F.explode(F.expr(f"sequence(0, (n - 1) div {RANGE})")).alias("r")).repartition(tasks, "k", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, r in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                left = min(HALO, r * RANGE)
                with _reader(k) as file:
                    found.append(scan(file.read_at(left + RANGE + HALO, r * RANGE - left), left, RANGE, r == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(found), pa.int64()), batch.column(2).cast(pa.int64()), *_rows(found)], ["k", "h", "r", "chars", "bytes", "table"])

    offsets = _offsets(ranges.mapInArrow(run, "k string, h long, r long, chars long, bytes long, table binary"), limit, overlap)
    if not texts:
        return offsets.select(F.col("k").alias("path"), "piece", "start", "end")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, _, start, end, cut, stop in zip(*(c.to_pylist() for c in batch.columns)):
                low = max(0, cut - 4 * overlap)
                with _reader(k) as file:
                    data = file.read_at(stop - low, low)
                out.append(data[_start(data, 0) :].decode("utf-8", "replace")[start - end :])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.string())], ["path", "piece", "start", "end", "text"])

    return offsets.select("k", "piece", "start", "end", "cut", "stop").mapInArrow(emit, "path string, piece int, start long, end long, text string")
