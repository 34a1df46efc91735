"""Text garbled by decoding with the wrong character encoding.

Characters are mapped back to the bytes they would be in a legacy encoding. An automaton over the structure of UTF-8
finds maximal runs of well-formed multibyte sequences among these bytes, and only these runs are decoded; this is
repeated until nothing is left to decode. Where runs fit several encodings, each is followed to its end and the one that
leaves the shortest text wins, as a right step joins more characters than a wrong one (of equals, the one with the
fewest capitals and controls within words). Runs of UTF-16 units whose bytes read as plain text are found the
same way. A legacy text read in another legacy encoding has no multibyte structure; for it the byte mapping is kept
and the score of character pairs, counted over all rows, decides between the text as it stands and as it would read.
Replacement characters show that text was lost and can't be restored.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings that UTF-8 is mistaken for, and pairs (read as, truly) of legacy encodings.
WRONG = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp1250", "iso8859_2", "iso8859_15", "cp866")
#: Encodings with two bytes a character that UTF-8 is mistaken for.
WRONG_DOUBLE = ("gbk", "cp932", "big5", "euc_kr")
SWAPS = (
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("koi8_r", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"),
)
#: Greek and Cyrillic letters that stand for Latin ones in disguised words; alone they are no sign of a wrong encoding.
_ALIKE = re.compile("[ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοАВЕЅІЈКМНОРСТУХаеорсухѕіј]+\\Z")
_LATIN = re.compile("[A-Za-z]")
#: Gains in log probability: of all words of a text garbled as a whole; of a word that counts in a text garbled in part.
#: All such words together must gain ``WORD_SCORE`` and ``CHANCE_SCORE`` times the logarithm of the number of words, as
#: every word is one more chance for a word to look garbled.
SWAP_SCORE = 4.0
WORD_SCORE = 6.0
CHANCE_SCORE = 1.5
#: Texts with these are left out when pairs are counted: UTF-8 read as a legacy encoding, lost characters.
_NOT_SOUND = "[ÂÃ][\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|â€|├|√[^ ]|Г[^ а-яА-Я]|\ufffd"


_CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]*?[^`\n])\1(?!`)")
#: What a decoded run may hold: letters and signs of scripts in use, not any code point.
_USUAL = re.compile(
    "[\x80-\x9f -ſ̀-ͯΆ-ώЀ-џҐґ‐-”†-…‰‹›⁰-ₜ€№™←-↓∀-⋿①-⓿─-◿☀-➿"
    "　-ヿ一-鿿가-힣\uf900-\ufaff︎️﻿＀-￯\U0001d400-\U0001d7ff\U0001f000-\U0001faff]+\\Z"
)
_TEXT = re.compile(r"[A-Za-z0-9 .,;:!?'\"()\[\]{}<>/_=*#|`~&%$@+\-\r\n\t]")


@functools.cache
def _bytes(codec: str) -> dict[str, int]:
    """Characters to bytes 128-255; bytes a table leaves undefined, and C1 controls, stand for themselves."""
    table = {chr(b): b for b in range(128, 160)} if codec in ("cp1252", "cp1251") else {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if codec == "cp1252":
        for b in range(160, 256):
            table[chr(b)] = b
    return table


@functools.cache
def _automaton(codec: str) -> re.Pattern[str]:
    """Maximal runs of characters whose bytes are well-formed multibyte sequences."""
    table = _bytes(codec)

    def of(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"

    tail = of(0x80, 0xBF)
    two, three, four = of(0xC2, 0xDF) + tail, "", ""
    three = f"{of(0xE0, 0xE0)}{of(0xA0, 0xBF)}{tail}|(?:{of(0xE1, 0xEC)}|{of(0xEE, 0xEF)}){tail}{tail}|{of(0xED, 0xED)}{of(0x80, 0x9F)}{tail}"
    four = f"{of(0xF0, 0xF0)}{of(0x90, 0xBF)}{tail}{tail}|{of(0xF1, 0xF3)}{tail}{tail}{tail}|{of(0xF4, 0xF4)}{of(0x80, 0x8F)}{tail}{tail}"
    return re.compile(f"(?:{two}|{three}|{four})+")


def _decoded(run: str, codec: str) -> str:
    table = _bytes(codec)
    return bytes(table[c] for c in run).decode("utf-8")


def _plausible(out: str, codec: str) -> bool:
    """Whether a decoded run holds characters in use, or such that the same mistake may have made of them before."""
    return all(c in _bytes(codec) or _USUAL.match(c) for c in out)


def _evidence(text: str, codec: str) -> int:
    """How many characters of a text say that it was UTF-8 read as this encoding."""
    points = 0
    for m in _automaton(codec).finditer(text):
        out = _decoded(m[0], codec)
        if _plausible(out, codec) and not _ALIKE.match(m[0]):
            letters = sum(c.isalpha() for c in out)
            points += letters + (len(out) - letters if codec == "cp1252" or 2 * len(m[0]) >= 5 * len(out) else 0)
    return points


_ODD = re.compile("(?<=[a-zà-öø-ÿ])[A-ZÀ-ÖØ-Þ]|[\x80-\x9f\ue000-\uf8ff]")


def _step(text: str, codec: str) -> str:
    def fix(m: re.Match[str]) -> str:
        out = _decoded(m[0], codec)
        return out if _plausible(out, codec) else m[0]

    return _automaton(codec).sub(fix, text)


def chain(sample: str) -> list[str]:
    """The encodings to undo one after the other. Every step shortens the text, so the search ends."""
    known: dict[str, tuple[int, int, list[str]]] = {}

    def best(text: str) -> tuple[int, int, list[str]]:
        if text not in known:
            found = sorted(((-p, i) for i, c in enumerate(WRONG) if (p := _evidence(text, c)) > 0))
            ends = [(*best(_step(text, WRONG[i])), p, i) for p, i in found]
            size, odd, rest, _, i = min(ends, key=lambda e: (e[0], e[1], e[3], e[4]), default=(len(text), len(_ODD.findall(text)), [], 0, -1))
            known[text] = size, odd, [WRONG[i], *rest] if ends else []
        return known[text]

    return best(sample)[2]


def undo(text: str, sample: str | None = None) -> tuple[str, str | None]:
    """The text with runs decoded, and the encoding they were read as last, or None. sample: the part that is judged."""
    codecs = chain(text if sample is None else sample)
    for codec in codecs:
        text = _step(text, codec)
    return text, codecs[0] if codecs else None


_EAST = re.compile("[\u3000-\u9fff\uac00-\ud7a3\uff61-\uff9f]")
_EAST_RUN = re.compile("(?P<before>[A-Za-z]?)(?P<run>[^\x00-\x7f]+)(?P<after>(?=[A-Za-z]))?")


def _double(text: str) -> tuple[str, str | None]:
    """Runs that are well-formed UTF-8 in an encoding with two bytes a character; one sequence alone counts inside a word."""
    kind = None

    def fix(m: re.Match[str]) -> str:
        nonlocal kind
        for codec in WRONG_DOUBLE:
            try:
                out = m["run"].encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            many = [c for c in out if c > "\x7f"]
            if many and _USUAL.match("".join(many)) and out != m["run"] and all(" " <= c for c in out) and (len(many) > 1 or m["before"] or m["after"] is not None):
                kind = kind or codec
                return m["before"] + out
        return m[0]

    return _EAST_RUN.sub(fix, text), kind


_WIDE = re.compile("[Ā-퟿-\U0010ffff]{4,}")


def _unwide(run: str) -> str | None:
    """The bytes of UTF-16 units as text, if nearly all of them are plain text."""
    for order in ("utf-16-le", "utf-16-be"):
        data = run.encode(order, "surrogatepass").decode("latin-1")
        plain = _TEXT.findall(data)
        if len(plain) >= 0.9 * len(data) and sum(c.isalpha() or c == " " for c in plain) >= 0.7 * len(data):
            return data
    return None


def _wide(text: str) -> tuple[str, bool]:
    hit = False

    def fix(m: re.Match[str]) -> str:
        nonlocal hit
        out = _unwide(m[0])
        hit = hit or out is not None
        return m[0] if out is None else out

    return _WIDE.sub(fix, text), hit


@functools.cache
def _swap(read: str, true: str) -> dict[int, str]:
    table = {}
    for c, b in _bytes(read).items():
        try:
            table[ord(c)] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            pass
    return {k: v for k, v in table.items() if chr(k) != v and unicodedata.category(chr(k)) not in ("Zs", "Cf")}


class Mender:
    """Finds and restores garbled text; pairs: log probabilities of two neighbouring characters."""

    def __init__(self, pairs: dict[str, float]):
        self.pairs, self.floor = pairs, pairs.get("", -20.0)
        self.swap_score = functools.lru_cache(maxsize=200_000)(self._swap_score)

    def _score(self, token: str) -> float:
        s = f" {token} "
        return sum(self.pairs.get(s[i : i + 2], self.floor) for i in range(len(s) - 1) if s[i] > "\x7f" or s[i + 1] > "\x7f")

    def _swap_score(self, token: str) -> list[tuple[int, float, str]]:
        """Pairs of encodings that change a token, with the gain in score."""
        out, base = [], self._score(token)
        alike = _ALIKE.match("".join(c for c in token if "\u0370" <= c < "\u0530") or "а") is not None
        for i, (read, true) in enumerate(SWAPS):
            if (alike or not _LATIN.search(token)) and read in ("cp1251", "koi8_r"):
                continue
            fixed = token.translate(_swap(read, true))
            if fixed != token:
                out.append((i, self._score(fixed) - base, fixed))
        return out

    def mend(self, text: str) -> tuple[str | None, str | None]:
        """(kind, restored text): kind is None for sound text, restored is None where nothing can be restored."""
        if text.isascii() and "\x00" not in text:
            return None, None
        quoted: list[str] = []
        bare = _CODE.sub(lambda m: quoted.append(m[0]) or f"\x01{len(quoted) - 1}\x01", text)
        words = bare.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")
        tokens = dict.fromkeys(w for w in words if not w.isascii())
        sample = " ".join(tokens)
        kind, out = None, bare
        if len(re.findall("[^\x00]\x00", bare)) >= 4:
            kind, out = "utf-16", bare.replace("\x00", "")
        elif sample:
            wide, hit = _wide(bare) if _WIDE.search(sample) else (bare, False)
            if hit:
                kind, out = "utf-16", wide
            if kind is None and _EAST.search(sample):
                out, kind = _double(bare)
            fixed, codec = undo(out, sample if out is bare or kind is None else None)
            if codec:
                kind, out = kind or codec, fixed
            if kind is None:
                gains, strong = [0.0] * len(SWAPS), [0.0] * len(SWAPS)
                for token in tokens:
                    for i, gain, _ in self.swap_score(token):
                        gains[i] += gain
                        strong[i] += gain if gain >= WORD_SCORE else 0
                part = WORD_SCORE + CHANCE_SCORE * math.log(len(tokens))
                i = max(range(len(SWAPS)), key=lambda i: max(gains[i], strong[i] - part))
                if gains[i] >= SWAP_SCORE or strong[i] >= part:
                    read, true = SWAPS[i]
                    fixes = {t: fixed for t in tokens for j, gain, fixed in self.swap_score(t) if j == i and gain > 0}
                    kind, out = f"{true} as {read}", re.sub("[^ \t\r\n]+", lambda m: fixes.get(m[0], m[0]), bare)
        if "�" in bare:
            kind, out = kind or "lost", None if kind is None else out
        if kind is None:
            return None, None
        return kind, None if out is None else re.sub("\x01(\\d+)\x01", lambda m: quoted[int(m[1])], out)


def _alphabet() -> str:
    """The characters of all tables, for which pairs are counted."""
    every = {c for codec in {*WRONG, *(x for s in SWAPS for x in s)} for c in _bytes(codec) if ord(c) > 0x9F}
    return "".join(sorted(every))


def character_pairs(df: DataFrame, text: str) -> dict[str, float]:
    """Log probabilities of pairs of neighbours of which one is a character of a legacy table, over all rows.

    The alphabet is fixed (under 700 characters with ASCII), so what reaches the driver is bounded by its square.
    """
    padded = F.concat(F.lit(" "), F.translate(text, "\r\n\t", "   "), F.lit(" ")).alias("t")
    found = df.where(F.col(text).rlike("[^\\x00-\\x7f]") & ~F.col(text).rlike(_NOT_SOUND)).select(padded).select(F.explode(F.regexp_extract_all("t", F.lit("(?=([^\\x00-\\x7f].|.[^\\x00-\\x7f]))"), F.lit(1))).alias("pair"))
    found = found.groupBy("pair").agg(F.count("*").alias("n")).where(F.translate("pair", _alphabet(), "").rlike("^[\\x20-\\x7e]{0,1}$"))
    counts = {r.pair: r.n for r in found.collect()}
    total = sum(counts.values()) + 10_000
    return {p: math.log((n + 0.5) / total) for p, n in counts.items()} | {"": math.log(0.5 / total)}


def mend(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text is garbled, with columns kind and restored.

    kind: the encoding UTF-8 was read as, ``utf-16``, ``X as Y`` for a legacy text in X read as Y, or ``lost``.
    restored: the text with garbled runs decoded; null where only replacement characters are left. Text quoted in
    inline code is left alone and counts for nothing. Null, empty and ASCII texts are sound.
    """
    pairs = character_pairs(df, text)

    @F.pandas_udf("kind string, restored string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mender = Mender(pairs)
        for texts in batches:
            yield pd.DataFrame([mender.mend(t) for t in texts], columns=["kind", "restored"])

    suspect = df.where(F.col(text).rlike("[^\\x00-\\x7f]|\\x00"))
    return suspect.withColumn("_mended", run(F.col(text))).where("_mended.kind is not null").withColumns({"kind": F.col("_mended.kind"), "restored": F.col("_mended.restored")}).drop("_mended")
