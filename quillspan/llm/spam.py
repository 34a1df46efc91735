"""Keyword-stuffed and link-list pages.

Bagged decision trees judge pages by content and link features. No page is labelled by hand: rules with a wide margin
label the clear ones, in two steps. The first step needs no vocabulary (repeated phrases without function words, bare
links, running sentences) and its labels give, over all pages, the words that spam uses and other pages don't. The
second step measures how much of a page consists of units full of such words or of links that no sentence explains,
and labels the pages far from one half. The trees are fitted on a bounded sample of these. Their votes are smoothed
with the spam rate of the page's host, which moves only pages the trees are unsure of.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.markup import STOP_WORDS
from quillspan.session import Scratch

#: Rows of each weak label the trees are fitted on, at most.
FIT_ROWS = 20_000
#: A word of the spam vocabulary is on this many and on this share of the pages with the first label spam, at least. The
#: share bounds the vocabulary: it has at most as many words as a spam page has different ones, divided by the share.
WORD_PAGES = 5
WORD_SHARE = 0.0005
#: A host with more than this share of all pages is joined by broadcast; there are fewer of them than 1 / HOT_HOST.
HOT_HOST = 0.005
TREES = 25
DEPTH = 6
#: How many votes' worth the host's rate counts, in pages a host must have for half of it.
HOST_PAGES = 20.0
HOST_WEIGHT = 0.5

# Endings of host names that are no endings of file names: generic ones, those of countries, and the
# names reserved for examples.
HOST_ENDINGS = """
com org net info biz io dev app shop store online site xyz club blog news eu de at ch fr be lu es it pt nl uk ie us ca mx ar cl co pe br au nz jp cn in ru ua
se no dk fi cz sk hu ro gr tr za kr tw hk sg id th vn il ae ir edu gov example test invalid
""".split()
_HOST = r"(?=[\w-]++\.\w)[\w-]+(?:\.[\w-]+)*\.(?:" + "|".join(HOST_ENDINGS) + r")\b(?![.-]\w|\()"
_LINK = re.compile(r"<a\s[^<>]*>.*?</a>|!?\[[^\[\]]*\]\([^()\s]*\)|<?https?://[^\s<>\"')\]|]+>?|\bwww\.[^\s<>\"')\]|]+|\b" + _HOST + r"(?:/[^\s<>\"')\]|]*)?", re.I | re.S)
_UNIT = re.compile(r"\n+|(?<=[.!?])\s+(?=[^\W\d_a-z]|[¿¡#*<\[])")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_DOTTED = re.compile(r"(?<![^\W_])(?:[^\W_][.\-_*·]){3,}[^\W_](?![^\W_])")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){4,}[^\W\d_](?!\S)")
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_LEET_WORD = re.compile(r"(?<![\w@$])(?=[\w@$]*[^\W\d_])(?=[\w@$]*[013457@$])[^\W\d_013457@$]*(?:[013457@$]{1,2}[^\W\d_]+)+[013457@$]?(?![\w@$])|(?<![\w@$])[^\W\d_]{2,}[013457@$](?![\w@$.,])")
_CODE = "(){}[];=<>&|+*/\\"
_HASHTAG = re.compile(r"#[^\W\d_]")
_HIDDEN = re.compile("[\xad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_DOTS = re.compile(r"[.\-_*·][^\W_][.\-_*·][^\W_][.\-_*·]")
_SPACES = re.compile(r" \w \w \w ")
_LEETISH = re.compile(r"[013457@$](?:(?=[^\W\d_])|(?<=[^\W\d_].))")
_TLD = re.compile(r"\.(?:" + "|".join(HOST_ENDINGS) + r")\b", re.I)
_ADDRESS = re.compile(r"\]\(.*|<?https?://\S+|\S+\.\S+", re.S)
_SEPARATOR = re.compile(r"[^\S\n][|•·;/~»-][^\S\n]|[,;][^\S\n]")
_TAGGED = re.compile(r"<[^<>]{1,200}>")

PLAIN = (
    "length", "stops", "sentences", "links", "bare_links", "repeats", "distinct", "digits", "code", "hashes", "disguise", "separators", "variety", "top_word", "top_pairs", "unit_words",
)
WORDED = ("vocabulary", "stuffed", "junk")
FEATURES = PLAIN + WORDED


def plain(text: str) -> tuple[str, float]:
    """(the text with disguises undone, the share of characters that were disguised)."""
    s = text
    if not text.isascii():
        s = _HIDDEN.sub("", text)
        if not unicodedata.is_normalized("NFKC", s):
            s = unicodedata.normalize("NFKC", s)
    odd = max(0, len(text) - len(s))

    def join(m: re.Match[str]) -> str:
        nonlocal odd
        odd += len(m[0])
        return re.sub(r"[\s.\-_*·]", "", m[0])

    def leet(w: str) -> str:
        nonlocal odd
        if w.isalpha() or not _LEETISH.search(w) or "/" in w or "." in w[1:-1] or not _LEET_WORD.fullmatch(w.strip(",;:.!?|")):
            return w
        odd += len(w)
        return "".join(_LEET.get(c, c) for c in w)

    if " " in s and _SPACES.search(s) or _DOTS.search(s):
        s = _SPACED.sub(join, _DOTTED.sub(join, s))
    if _LEETISH.search(s):
        s = "\n".join(" ".join(map(leet, line.split(" "))) for line in s.split("\n"))
    return s, min(1.0, odd / max(1, len(text)))


def _linked(s: str) -> bool:
    """Whether a text may hold a link."""
    return "://" in s or "](" in s or "<a" in s or "<A" in s or "www." in s or "." in s and _TLD.search(s) is not None


def features(text: str) -> tuple[tuple[float, ...], str]:
    """The features of a page that need no vocabulary, and its units for those that do.

    A line for each unit: its characters, 1 if its links are bare, the number of words that are told (neither function
    words nor numbers) and these words; the last line has the letters of all words.
    """
    s, disguise = plain(text)
    total = max(1, len(s))
    linked_page = _linked(s)
    numbered = any(map(s.count, "0123456789"))
    words: list[str] = []
    content: list[str] = []
    lines: list[str] = []
    rests: list[str] = []
    known: set[str] = set()
    sentences = links = bare = unit_words = n_stops = 0
    for unit in _UNIT.split(s):
        if not unit or unit.isspace():
            continue
        found = [m[0] for m in _LINK.finditer(unit)] if linked_page and _linked(unit) else ()
        rest, anchors = unit, []
        if found:
            rest = _LINK.sub(" ", unit)
            links += sum(map(len, found))
            for x in found:
                anchors += _WORD.findall(_TAGGED.sub(" ", _ADDRESS.sub(" ", x)).lower())
        uw = _WORD.findall(_TAGGED.sub(" ", rest).lower() if "<" in rest else rest.lower())
        rests.append(rest)
        told = [w for w in uw if w not in STOP_WORDS]
        n = len(uw)
        stops = n - len(told)
        prose = False
        if stops:
            kinds = STOP_WORDS.intersection(uw)
            known |= kinds
            n_stops += stops
            prose = n >= 5 and stops >= 0.2 * n and len(kinds) >= min(5, n / 6)
        unit_words += n
        unexplained = bool(found) and not (prose and n >= 3 * len(found))
        if unexplained:
            bare += len(unit)
        if prose:
            sentences += len(unit)
        if numbered:
            told = [w for w in told if not w.isdigit()]
        lines.append(f"{len(unit)} {int(unexplained)} {len(told)} {' '.join(told)}")
        if anchors:
            words += anchors
            more = [w for w in anchors if w not in STOP_WORDS and not w.isdigit()]
            n_stops += sum(w in STOP_WORDS for w in anchors)
            content += more
            lines.append(f"0 1 {len(more)} {' '.join(more)}")
        words += uw
        content += told
    rest = "\n".join(rests)
    code, seps = sum(map(rest.count, _CODE)), len(_SEPARATOR.findall(rest))
    n, m = max(1, len(words)), max(1, len(content))
    counts = Counter(words)
    thrice = {w for w, k in counts.items() if k > 2}  # only their pairs can come three times
    pairs = Counter([p for p in zip(words, words[1:]) if p[0] in thrice and p[1] in thrice])
    repeats = sum(k for p, k in pairs.items() if k > 2 and not (p[0] in STOP_WORDS and p[1] in STOP_WORDS)) / n
    top_word = top_pairs = 0.0
    if m > 11:
        told = thrice.difference(STOP_WORDS)
        top = max((counts[w] for w in told if not w.isdigit()), default=0) or (2 if len(set(content)) < len(content) else 1)
        top_word = (top - 1) / m
        pairs = Counter([p for p in zip(content, content[1:]) if p[0] in thrice and p[1] in thrice])
        top_pairs = 2 * sum(k for k in sorted(pairs.values())[-3:] if k > 2) / m
    letters = sum(map(len, words))
    lines.append(f"{letters}")
    return (
        math.log1p(total), n_stops / n, sentences / total, links / total, bare / total, repeats, len(counts) / n, sum(map(s.count, "0123456789")) / total, code / total,
        len(_HASHTAG.findall(s)) / n, disguise, seps / n, min(1.0, len(known) / min(12.0, max(2.0, n / 6))), top_word, min(1.0, top_pairs), min(50.0, unit_words / max(1, len(lines) - 1)),
    ), "\n".join(lines)


def worded(lines: str, vocabulary: frozenset[str]) -> tuple[float, float, float]:
    """(share of letters in words of the vocabulary, share of characters in stuffed units, the same with bare links)."""
    *units, letters = lines.split("\n")
    total = stuffed = bare = hits = 0
    for unit in units:
        size, unexplained, told, *words = unit.split(" ")
        spam = [w for w in words if w in vocabulary]
        total += int(size)
        hits += sum(map(len, spam))
        if unexplained == "1":
            bare += int(size)
        elif spam and (len(spam) >= 3 and len(spam) >= 0.45 * int(told) or len(spam) >= 0.6 * int(told)):
            stuffed += int(size)
    total = max(1, total)
    return hits / max(1, int(letters)), stuffed / total, (stuffed + bare) / total


def first_label(f: dict[str, float]) -> int | None:
    """The weak label that needs no vocabulary: 1 spam, 0 honest, None undecided."""
    if f["bare_links"] > 0.7 and f["stops"] < 0.2:
        return 1
    if f["digits"] < 0.08 and f["code"] < 0.04 and (f["top_word"] > 0.2 or f["top_pairs"] > 0.4 or f["hashes"] > 0.5 or f["repeats"] > 0.5 and f["variety"] < 0.5):
        return 1
    if f["sentences"] > 0.6 and f["bare_links"] < 0.1 and f["top_word"] < 0.12 and f["top_pairs"] < 0.2:
        return 0
    if f["digits"] > 0.15 and f["links"] < 0.1 or f["code"] > 0.08 and f["links"] < 0.1:
        return 0
    return None


def vocabulary(pages: DataFrame) -> frozenset[str]:
    """The words that are far more frequent, by documents, among first-label spam than among first-label honest pages.

    pages: columns first (label) and lines (units). Counted over all pages, and no word that counts is left out; what
    reaches the driver is bounded by ``WORD_SHARE``, whatever the number of pages.
    """
    words = F.array_distinct(F.split(F.regexp_replace("lines", r"(?m)^\d+(?: [01] \d+)? ?", ""), "[ \n]+"))
    marked = pages.where("first is not null").select("first", F.explode(words).alias("word")).where("word != ''")
    counts = marked.groupBy("word").agg(F.count_if(F.col("first") == 1).alias("spam"), F.count_if(F.col("first") == 0).alias("honest"))
    total = pages.agg(F.count_if(F.col("first") == 1).alias("spam"), F.count_if(F.col("first") == 0).alias("honest")).first()
    if not total.spam:
        return frozenset()
    rate = F.col("spam") / total.spam / ((F.col("honest") + 0.5) / (total.honest + 1))
    return frozenset(r.word for r in counts.where((F.col("spam") >= max(WORD_PAGES, WORD_SHARE * total.spam)) & (rate >= 5)).select("word").collect())


def judge(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """key, features, vote (share of trees), host_rate, score and spam (boolean) of every page.

    Null and blank texts are honest with score 0 and null features. Pages without a host are judged by their own vote.
    Every row is judged, copies under other keys too. If a table is too plain for weak labels of both kinds, the share
    of junk units decides.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "spam")
    pages = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(host).alias("h"))
    full = pages.where(F.col("t").rlike(r"\S"))

    @F.pandas_udf(", ".join(f"{f} double" for f in PLAIN) + ", first int, lines string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(*f, first_label(dict(zip(PLAIN, f))), lines) for f, lines in map(features, texts)]
            yield pd.DataFrame(rows, columns=[*PLAIN, "first", "lines"]).astype({"first": "Int64"})

    units = scratch.put(full.select("k", "h", read("t").alias("f")).select("k", "h", "f.*"), "units")
    words = vocabulary(units)

    @F.pandas_udf(", ".join(f"{f} double" for f in WORDED))
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lines in batches:
            yield pd.DataFrame([worded(x, words) for x in lines], columns=list(WORDED))

    table = scratch.put(units.withColumn("w", weigh("lines")).select("k", "h", *PLAIN, "first", "w.*"), "features")
    scratch.drop("units")
    full_junk, clean = F.col("junk") > 0.65, (F.col("junk") < 0.25) & (F.col("vocabulary") < 0.35)
    label = F.when(full_junk | (F.col("first") == 1), 1.0).when(clean & F.coalesce(F.col("first") == 0, F.col("top_word") < 0.15), 0.0)
    marked = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table.withColumn("label", label))
    sizes = {r.label: r.n for r in marked.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) == 2:
        share = F.when(F.col("label") == 1, min(1.0, FIT_ROWS / sizes[1.0])).otherwise(min(1.0, FIT_ROWS / sizes[0.0]))
        sample = scratch.put(marked.where("label is not null").where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < share * 1_000_000).select("label", "x"), "sample")
        forest = RandomForestClassifier(featuresCol="x", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=7).fit(sample)
        voted = forest.transform(marked).withColumn("vote", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    else:
        voted = marked.withColumn("vote", F.col("junk")).drop("x")
    voted = scratch.put(voted.drop("label"), "votes")
    hosts = scratch.put(voted.where("h is not null").groupBy("h").agg(F.sum("vote").alias("sum"), F.count("*").alias("n")), "hosts")
    hot = hosts.where(F.col("n") > HOT_HOST * max(1, voted.count()))
    near = voted.join(F.broadcast(hot), "h", "left")  # fewer than 1 / HOT_HOST rows
    near = scratch.put(near, "near")
    cold = near.where("n is null and h is not null").drop("sum", "n").join(hosts, "h")
    voted = near.where("n is not null or h is null").unionByName(cold)
    rate = F.when(F.col("n") > 1, (F.col("sum") - F.col("vote")) / (F.col("n") - 1)).alias("host_rate")
    voted = voted.select("k", *FEATURES, "vote", rate, F.col("n").alias("host_pages"))
    unsure = 4 * F.col("vote") * (1 - F.col("vote")) * HOST_WEIGHT * F.col("host_pages") / (F.col("host_pages") + HOST_PAGES)
    score = F.when(F.col("host_rate").isNull(), F.col("vote")).otherwise(F.col("vote") + unsure * (F.col("host_rate") - 0.5) * F.when(F.col("host_rate") > 0.5, 1.0).otherwise(0.2))
    voted = voted.withColumn("score", score)
    blank = pages.where(~F.coalesce(F.col("t").rlike(r"\S"), F.lit(False))).select("k", F.lit(0.0).alias("vote"), F.lit(0.0).alias("score"))
    return voted.unionByName(blank, allowMissingColumns=True).withColumn("spam", F.col("score") > 0.5).withColumnRenamed("k", key)
