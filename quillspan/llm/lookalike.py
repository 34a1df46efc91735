"""One form for text that looks the same.

Ignorable characters are deleted, widths, ligatures, spaces and short hyphens are brought to one form and letters are
decomposed. Each run of letters is then a lattice: a letter may stand for any letter of the same shape in another
script. A Viterbi search takes the path that changes script least and, among those, the one with the best score of
character pairs counted over the whole table. As the lattice depends on the shapes alone, texts that look the same get
the same form, and as no letter belongs to two shapes, texts that look different never do.
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

from quillspan.session import Scratch

# Letters of one shape in Latin, Greek, Cyrillic and Armenian (a dot where a script has none), and letters
# that look like another one of their own script.
SHAPES = """
AΑА. BΒВ. CϹС. EΕЕ. G.Ԍ. HΗН. IΙІ. JͿЈ. KΚК. L..Լ MΜМ. NΝ.. OΟОՕ PΡР. Q.Ԛ. S.ЅՏ TΤТ. U..Ս V.Ѵ. W.Ԝ. XΧХ. YΥ.. ZΖ.. .ΓГ. .ΠП. .ΦФ. Æ.Ӕ.
a.а. cϲс. d.ԁ. e.е. g..ց h.һհ i.і. jϳј. l.ӏ. n..ո oοоօ p.р. q.ԛզ s.ѕ. u..ս vνѵ. w.ԝ. x.х. y.у. .κк. æ.ӕ. ə.ә.
""".split()
SAME = {"ɡ": "g", "Ӏ": "І", "Ɩ": "I"}
SCRIPTS = "LGCA"
SWITCH = 1000.0

_IGNORED = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
_OTHER = re.compile("[^\x21-\x7e ]")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_SHAPE = {c: k for k, shape in enumerate(SHAPES) for c in shape if c != "."}
_LETTERS = [{SCRIPTS[i]: c for i, c in enumerate(shape) if c != "."} for shape in SHAPES]


@functools.lru_cache(maxsize=65536)
def _plain(c: str) -> str:
    """One character without differences of width, ligature, space and short hyphen."""
    if c in "\t " or unicodedata.category(c) == "Zs":
        return " "
    if c in "‐‑﹣－":
        return "-"
    if c in SAME:
        return SAME[c]
    kind, _, code = unicodedata.decomposition(c).partition("> ")
    if kind in ("<wide", "<narrow") or kind == "<compat" and "LIGATURE" in unicodedata.name(c, ""):
        return "".join(_plain(chr(int(x, 16))) for x in code.split())
    return c


@functools.lru_cache(maxsize=65536)
def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return "L" if name.startswith("LATIN") else "G" if name.startswith("GREEK") else "C" if name.startswith("CYRILLIC") else "A" if name.startswith("ARMENIAN") else "-"


def read_word(word: str, pairs: dict[str, float]) -> str:
    """The best reading of a run of letters by Viterbi search. pairs: log probabilities of two letters."""
    floor = pairs.get("", -20.0)
    best: dict[str, tuple[float, str]] = {}
    last = None
    for c in word:
        if unicodedata.combining(c):
            best = {s: (x, text + c) for s, (x, text) in best.items()}
            continue
        shape = _SHAPE.get(c)
        options = {_script(c): c} if shape is None else _LETTERS[shape]
        if last is None:
            best = {s: (-0.001 * SCRIPTS.find(s), letter) for s, letter in options.items()}
        else:
            step = {}
            for s, letter in options.items():
                step[s] = max((x + pairs.get(last[p] + letter, floor) - SWITCH * (p != s), -SCRIPTS.find(p), text + letter) for p, (x, text) in best.items())
            best = {s: (x, text) for s, (x, _, text) in step.items()}
        last = options
    return max((x, -SCRIPTS.find(s), text) for s, (x, text) in best.items())[2]


class Reader:
    """Brings texts to one form; keeps the readings of words it has seen lately."""

    def __init__(self, pairs: dict[str, float]):
        self.word = functools.lru_cache(maxsize=200_000)(lambda w: read_word(w, pairs))

    def text(self, text: str | None) -> str | None:
        if text is None:
            return None
        text = _IGNORED.sub("", text)
        if not text.isascii():
            text = unicodedata.normalize("NFD", _OTHER.sub(lambda m: _plain(m[0]), text))
        else:
            text = text.replace("\t", " ")
        return unicodedata.normalize("NFC", _WORD.sub(lambda m: self.word(m[0]), text))


def letter_pairs(df: DataFrame, text: str) -> dict[str, float]:
    """Log probabilities of pairs of letters that have a shape in several scripts, counted over all rows.

    There are fewer than 130 such letters, so the counts that reach the driver are bounded by 130 x 130.
    """
    letters = "".join(_SHAPE)
    found = df.where(F.col(text).isNotNull()).select(F.explode(F.expr(f"regexp_extract_all({_name(text)}, '(?=([{letters}]{{2}}))', 1)")).alias("pair"))
    counts = {r.pair: r.n for r in found.groupBy("pair").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values()) + len(letters) ** 2
    return {p: math.log((n + 1) / total) for p, n in counts.items()} | {"": math.log(1 / total)}


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def one_form(df: DataFrame, text: str, to: str) -> DataFrame:
    """The table with the one form of a text in column ``to``: null for null, empty for empty and for ignorable
    characters alone. Case, accents, digits, long dashes and the number of spaces stay as they are."""
    pairs = letter_pairs(df, text)

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(pairs)
        for texts in batches:
            yield texts.map(reader.text)

    return df.withColumn(to, form(F.col(text)))


def _spelt(df: DataFrame, key: str, groups: list[str], text: str) -> tuple[DataFrame, list[str]]:
    """(k, groups, form and v of the rows whose group has their form in several spellings, the columns of a class)."""
    rows = df.select(F.col(key).alias("k"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.col(text).alias("v"))
    rows = rows.where(" and ".join(f"{c} is not null" for c in rows.columns))
    by = [*(c for c in rows.columns if c not in ("k", "v")), "form"]
    scratch = Scratch(df.sparkSession, "lookalike")
    formed = scratch.put(one_form(rows, "v", "form"), "formed")
    classes = formed.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low != high").select(*by)
    return scratch.put(formed.join(classes, by, "left_semi").distinct(), "spelt"), by


def same_looking(df: DataFrame, key: str, groups: list[str], text: str) -> DataFrame:
    """Pairs of rows of one group whose texts look the same and differ: key_a < key_b.

    Rows with a null key, group or text have no pairs. Rows that repeat a key count once. Spellings are compared before
    rows: only pairs of different spellings of one form are joined, and rows are put in for them at the end, so copies
    of one spelling never meet.
    """
    spelt, by = _spelt(df, key, groups, text)
    spellings = spelt.select(*by, "v").distinct()
    pairs = spellings.withColumnRenamed("v", "v_a").join(spellings.withColumnRenamed("v", "v_b"), by).where("v_a < v_b")
    first = pairs.join(spelt.withColumnsRenamed({"k": "k_a", "v": "v_a"}), [*by, "v_a"])
    both = first.join(spelt.withColumnsRenamed({"k": "k_b", "v": "v_b"}), [*by, "v_b"]).where("k_a != k_b")
    return both.select(F.least("k_a", "k_b").alias(f"{key}_a"), F.greatest("k_a", "k_b").alias(f"{key}_b")).distinct()


def classes(df: DataFrame, key: str, groups: list[str], text: str) -> DataFrame:
    """One row for each row that has a partner in ``same_looking``: key, class_id (the smallest key of its class) and
    links (rows of the class in another spelling). Its size is that of the table, however many pairs there are."""
    spelt, by = _spelt(df, key, groups, text)
    each = spelt.groupBy(*by, "v").agg(F.count("*").alias("same"), F.min("k").alias("low"))
    whole = each.groupBy(*by).agg(F.sum("same").alias("all"), F.min("low").alias("class_id"))
    links = each.join(whole, by).select(*by, "v", "class_id", (F.col("all") - F.col("same")).alias("links"))
    return spelt.join(links, [*by, "v"]).select(F.col("k").alias(key), "class_id", "links")
