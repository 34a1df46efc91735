"""Speech transcripts into clean speaker turns.

A sweep along the start times takes the segments of a recording in order; its state, the person speaking and the last
words said, is carried from time shard to time shard, so that no task holds a whole recording. Times, labels, sound
notes and hesitation sounds are cut from the text; what a rolling caption repeats is removed where the end of one
segment is the beginning of the next, and a segment that only repeats is dropped unless its person is another. A turn
ends where the person changes and at a pause longer than a quantile of the recording's own pauses; ``cause`` tells which.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import Scratch

SHARD_MS = 300_000
MIN_PAUSE_MS = 1_500
#: The quantile of a recording's pauses above which a pause ends a turn.
PAUSE = 0.95

_TIME = re.compile(r"(?:\[\s*{0}\s*\]|\(\s*{0}\s*\)|<\s*{0}\s*>|(?<![\w.:]){0}(?![\w:]))(?:\s*-->)?(?:\s+[-–—](?=\s|$))?".format(r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"))
_NOTE = re.compile(r"\[[^\[\]]*\]|\([^()\d]{1,40}\)|\{[^{}]*\}|\*[^*\n]{1,40}\*|<[^<>]*>|♪[^♪]*♪|[♪♫]+")
#: Sounds of hesitation; German "er" is a word.
_HESITATION = re.compile(r"(?<![\w'’-])(?:u+h+m*|u+m+|e+r+m+|e+r+|e+h+m*|e+m+|m{2,}|h+m+|h+u+m+|ä+h+m*|ö+h+m*|e+u+h+|h+e+u+h*|a+h+m+)(?![\w'’])(?:\.{2,}|…|-(?=\s|$)|,)?", re.I)
_GERMAN_ER = re.compile(r"(?<![\w'’-])er(?![\w'’])", re.I)
_NUMBER = re.compile(r"(?:speaker|spk|s|sprecher|locuteur|hablante|person)[\s_.#-]*0*(\d+)\Z")
_NAME = r"[^\W\d_][\w.’'-]*"
_LABEL = re.compile(
    rf"\s*(?:>>+|[-–—](?=\s))?\s*(?:<v(?:\.[\w.]+)?\s+(?P<v>[^<>]+)>|\[(?P<b>[^\[\]]+)\](?:\s*[:–—-](?=\s|$))?|(?P<n>{_NAME}(?:,?\s+{_NAME}|[ _-]\d+){{0,3}}(?:\s*\([^()]*\))?)\s*(?::(?!\d)|\s[-–—])(?=\s|$))"
)
_SPOKEN = re.compile(r"[^\W_]")
#: A label has one of these behind or around it, a sound note one of those.
_MARK = re.compile("[:<\\[–—-]")
_NOTED = re.compile("[\\[({*<♪♫]")
_DASH = re.compile(r"^\s*(?:>>+|[-–—](?=\s))")
_SPACED = re.compile(r"\s+([,.;:!?…])")
_LEADING = re.compile(r"^[\s,.;:…-]+(?=\w)")


def label_key(label: str | None) -> str | None:
    """A speaker label in one spelling: ``#3`` for a number, else its words in lower case; None if nothing is left."""
    if label is None:
        return None
    s = unicodedata.normalize("NFC", label).casefold()
    s = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", s).strip(" \t:>-–—<")
    if m := _NUMBER.match(s):
        return "#" + m[1]
    words = [w for w in re.split(r"[\s.,_]+", s) if w and w not in ("dr", "mr", "mrs", "ms", "prof", "herr", "frau", "mme", "sr", "sra")]
    return " ".join(words) if any(_SPOKEN.search(w) for w in words) else None


def name_keys(name: str | None, number: int | None) -> list[str]:
    """All keys a label for this person may have."""
    keys = [] if number is None else [f"#{int(number)}"]
    words = (label_key(name) or "").split()
    if words:
        first, last = words[0], words[-1]
        keys += [" ".join(words), first, last]
        if len(words) > 1:
            keys += [f"{last} {' '.join(words[:-1])}", f"{first[0]} {last}", f"{first} {last[0]}"]
    return list(dict.fromkeys(keys))


def labelled(text: str | None) -> tuple[str | None, str, str | None]:
    """(key of a label at the beginning or None, the text without times, the text behind the label)."""
    s = text or ""
    if ":" in s:
        s = _TIME.sub(" ", s)
    m = _LABEL.match(s) if _MARK.search(s) else None
    key = label_key(m["v"] or m["b"] or m["n"]) if m else None
    return key, s, s[m.end() :] if key else None


def spoken(s: str, german: bool) -> str:
    """Text without sound notes and hesitations."""
    if _NOTED.search(s):
        s = _NOTE.sub(" ", s)
    if german and "er" in s.lower():
        s = _HESITATION.sub(" ", _GERMAN_ER.sub("\x00", s)).replace("\x00", "er")
    else:
        s = _HESITATION.sub(" ", s)
    s = _SPACED.sub(r"\1", " ".join(_DASH.sub(" ", s).split()))
    s = _LEADING.sub("", s)
    return s if _SPOKEN.search(s) else ""


def overlap(before: str, after: str) -> int:
    """Words of ``after`` that repeat the end of ``before``: the longest suffix that is a prefix, of two words or more."""
    a, b = (re.sub("[.,;:!?…]", "", x).casefold().split(" ") if x else [] for x in (before, after))
    fail, k = [0] * len(b), 0
    for i in range(1, len(b)):
        while k and b[i] != b[k]:
            k = fail[k - 1]
        k += b[i] == b[k]
        fail[i] = k
    k = 0
    for w in a[-len(b) :] if b else []:
        while k and (k == len(b) or b[k] != w):
            k = fail[k - 1]
        k += k < len(b) and b[k] == w
    return k if k >= 2 else 0


def _people(speakers: DataFrame, recording: str, number: str, name: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def keys(names: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([name_keys(a, None if pd.isna(b) else int(b)) for a, b in zip(names, numbers)])

    rows = speakers.select(F.col(recording).alias("rec"), F.col(number).alias("no"), F.explode(keys(F.col(name), F.col(number))).alias("key")).distinct()
    return rows.groupBy("rec", "key").agg(F.min("no").alias("person"), F.count("*").alias("n")).where("n = 1").drop("n")


def segments(df: DataFrame, speakers: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """The segments in which something is said, in clean text with their person, as a table in the shared folder.

    df: recording_id, segment_index, start_ms, end_ms, speaker, text; speakers: recording_id, speaker_no, full_name;
    languages: recording_id, language. Returns rec, i, s, e, w (shard), person and said. Repeated segments count once.
    A segment without a start comes before all others. A label that fits two people of a recording names neither.
    """
    rows = df.select("recording_id", "segment_index", "start_ms", "end_ms", "speaker", "text").dropDuplicates(["recording_id", "segment_index"])
    if languages is not None:
        rows = rows.join(languages.groupBy("recording_id").agg(F.min("language").alias("language")), "recording_id", "left")
    else:
        rows = rows.withColumn("language", F.lit(None).cast("string"))

    @F.pandas_udf("by_speaker string, by_text string, said string, bare string")
    def parse(speaker: pd.Series, text: pd.Series, language: pd.Series) -> pd.DataFrame:
        out = []
        for who, t, lang in zip(speaker, text, language):
            key, whole, rest = labelled(t)
            out.append((label_key(who), key, spoken(whole, lang == "de"), None if rest is None else spoken(rest, lang == "de")))
        return pd.DataFrame(out, columns=["by_speaker", "by_text", "said", "bare"])

    parsed = rows.select(F.col("recording_id").alias("rec"), F.col("segment_index").alias("i"), F.coalesce("start_ms", F.lit(-(2**60))).alias("s"), F.col("end_ms").alias("e"), parse("speaker", "text", "language").alias("p")).select("rec", "i", "s", "e", "p.*")
    people = _people(speakers, "recording_id", "speaker_no", "full_name")
    one = people.select("rec", F.col("key").alias("by_speaker"), F.col("person").alias("person_speaker"))
    two = people.select("rec", F.col("key").alias("by_text"), F.col("person").alias("person_text"))
    known = parsed.join(one, ["rec", "by_speaker"], "left").join(two, ["rec", "by_text"], "left")
    said = F.when(F.col("person_text").isNotNull(), F.col("bare")).otherwise(F.col("said"))
    known = known.select("rec", "i", "s", "e", F.expr(f"(s - pmod(s, {SHARD_MS})) div {SHARD_MS}").alias("w"), F.coalesce("person_speaker", "person_text").alias("person"), said.alias("said"))
    return Scratch(df.sparkSession, "turns").put(known.where("said != ''"), "said")  # parsing is dear and its result is read twice


def _swept(rows: DataFrame, pause: float) -> DataFrame:
    """The segments that say something new or by someone else, with who (the person going on), fresh (the words not
    said before) and cause: ``first``, ``person`` or ``pause`` where a turn opens, else null."""
    rows = rows.withColumn("rec", F.struct("rec"))  # a struct is never null, so windows and joins share one shuffle
    inside = Window.partitionBy("rec", "w").orderBy("s", "i")
    upto, prior = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy("rec", "w").agg(
        F.max(F.when(F.col("person").isNotNull(), F.struct("s", "i", "person"))).alias("p"), F.max(F.struct("s", "i", "said")).alias("t"), F.max(F.coalesce("e", "s")).alias("e"),
    )
    over = Window.partitionBy("rec").orderBy("w")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = shards.select(
        F.col("rec").alias("crec"), F.col("w").alias("cw"), F.last("p.person", ignorenulls=True).over(earlier).alias("c_person"),
        F.lag("t.said").over(over).alias("c_said"), F.max("e").over(earlier).alias("c_end"), (F.row_number().over(over) == 1).alias("c_first"),
    )
    rows = rows.join(carry, (F.col("rec") == F.col("crec")) & (F.col("w") == F.col("cw"))).drop("crec", "cw")
    rows = rows.withColumns({
        "who": F.coalesce(F.last("person", ignorenulls=True).over(upto), "c_person"),
        "was": F.coalesce(F.last("person", ignorenulls=True).over(prior), "c_person"),
        "head": (F.row_number().over(inside) == 1) & F.col("c_first"),
        "before": F.coalesce(F.lag("said").over(inside), "c_said"),
        "gap": F.col("s") - F.greatest(F.max(F.coalesce("e", "s")).over(prior), F.col("c_end")),
    })

    @F.pandas_udf("string")
    def unsaid(said: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else " ".join(a.split(" ")[overlap(b, a) :]) for a, b in zip(said, before)])

    def words(text: str) -> Column:
        return F.lower(F.regexp_replace(text, "[.,;:!?…]", ""))

    # only where the first two words were said before is there an overlap to look for
    again = F.contains(words("before"), F.substring_index(words("said"), " ", 2)) & F.contains(F.col("said"), F.lit(" "))
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False)))
    rows = rows.withColumn("fresh", F.coalesce(unsaid(F.when(F.col("again"), F.col("said")), F.when(F.col("again"), F.col("before"))), "said"))
    rows = rows.where(F.col("head") | ~F.col("who").eqNullSafe(F.col("was")) | (F.col("fresh") != "")).drop("again", "before", "said", "c_said")
    limits = rows.where("gap > 0").groupBy(F.col("rec").alias("lrec")).agg(F.greatest(F.percentile_approx("gap", pause), F.lit(MIN_PAUSE_MS)).alias("limit"))
    rows = rows.join(limits, F.col("rec") == F.col("lrec"), "left")
    cause = F.when(F.col("head"), "first").when(~F.col("who").eqNullSafe(F.col("was")), "person").when(F.col("gap") > F.col("limit"), "pause")
    return rows.withColumn("cause", cause).select("rec.rec", "w", "s", "i", "e", "who", "fresh", "cause")


def openings(df: DataFrame, speakers: DataFrame, languages: DataFrame | None = None, pause: float = PAUSE) -> DataFrame:
    """recording_id, segment_index and cause of the segments that open a turn.

    cause: ``first`` of the recording, ``person`` (another than before) or ``pause`` (longer than the quantile ``pause``
    of the recording's own pauses, and than ``MIN_PAUSE_MS``).
    """
    rows = _swept(segments(df, speakers, languages), pause)
    return rows.where("cause is not null").select(F.col("rec").alias("recording_id"), F.col("i").alias("segment_index"), "cause")


def turns(df: DataFrame, speakers: DataFrame, languages: DataFrame | None = None, pause: float | None = PAUSE) -> DataFrame:
    """Clean turns: recording_id, segment_index (of the opening), part, turn_start_ms, cause, speaker_no, part_end_ms,
    segments and text.

    A turn has one row for each time shard in which it says something, parts being counted from 0 in order of time, so
    that no task gathers a turn of any length. speaker_no is null until a recording first names someone. The order of
    turns is that of turn_start_ms. pause None: turns end at another person alone.
    """
    rows = _swept(segments(df, speakers, languages), PAUSE if pause is None else pause)
    opens = F.col("cause").isNotNull() if pause is not None else F.col("cause").isin("first", "person")
    inside = Window.partitionBy("rec", "w").orderBy("s", "i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("o", F.when(opens, F.struct("s", "i", "cause")))
    rows = Scratch(df.sparkSession, "turns").put(rows, "opened").withColumn("rec", F.struct("rec"))  # read for the carried openings and for the parts
    shards = rows.groupBy("rec", "w").agg(F.max("o").alias("o"))
    earlier = Window.partitionBy("rec").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    carry = shards.select(F.col("rec").alias("crec"), F.col("w").alias("cw"), F.max("o").over(earlier).alias("c_o"))
    rows = rows.join(carry, (F.col("rec") == F.col("crec")) & (F.col("w") == F.col("cw")))
    rows = rows.withColumn("turn", F.coalesce(F.max("o").over(inside), "c_o"))
    parts: Column = F.array_sort(F.collect_list(F.struct("s", "i", "fresh")))
    out = rows.groupBy("rec", "turn", "w").agg(F.max(F.struct("s", "who")).getField("who").alias("speaker_no"), F.max(F.coalesce("e", "s")).alias("end"), F.count("*").alias("segments"), parts.alias("parts"))
    text = F.array_join(F.filter(F.transform("parts", lambda p: p["fresh"]), lambda x: x != ""), " ")
    part = F.row_number().over(Window.partitionBy("rec", "turn").orderBy("w")) - 1
    start, end = (F.when(F.col(c) > -(2**60), F.col(c)) for c in ("turn.s", "end"))
    return out.select(F.col("rec.rec").alias("recording_id"), F.col("turn.i").alias("segment_index"), part.alias("part"), start.alias("turn_start_ms"), F.col("turn.cause").alias("cause"), "speaker_no", end.alias("part_end_ms"), "segments", text.alias("text"))
