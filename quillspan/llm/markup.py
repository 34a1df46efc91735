"""Markup residue in text blocks and documents: clean text that keeps headings, lists, code and formulas.

Blocks are labelled in two passes. The first looks at length, stop-word density, link density and marks of a block and
decides the clear ones; the second lets the undecided short ones take the label of the nearest decided neighbour in
their document. For clean text the labels are good (content) and bad (navigation, link lists, remains of layout). For
residue they are marked and clean: a block whose marks the grammar knows is marked, one without any character of markup
and one of running text is clean, and a short block with characters that may be content or half a mark goes with its
neighbours. Only blocks labelled marked are checked exactly, undecided ones for marks that were cut in two.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import Scratch

TEXT_KINDS = ("heading", "paragraph", "list_item", "table_cell")
#: Blocks with running text of their own, whose labels count for their neighbours.
FLOW_KINDS = (*TEXT_KINDS, "html_block", "footnote_definition")
#: Code and formulas, which stay as they are.
KEPT_KINDS = ("code_fence", "inline_code", "inline_math", "display_math")
MAX_LINK_DENSITY = 0.2
SHORT = 70
LONG = 200
#: Bytes of a document whose blocks are put in order by one task.
SHARD = 65_536
STOP_LOW = 0.30
STOP_HIGH = 0.32

# Frequent function words of the corpus languages.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can do does for from had has have he her his how if in into is it its may more most no
not of on one only or other our out over she should so some such than that the their them then there these they this to under until up was we were
what when where which while who will with without would you your
aber alle als am an auch auf aus bei bis da damit das dass dem den der des die diese doch durch ein eine einem einen einer er es für hat ich ihr im in
ist ja kann kein keine mehr mit muss nach nicht noch nur oder ob ohne sich sie sind so über um und uns unter vom von vor war was weil wenn wer wie
wird wir wo zu zum zur
au aux avec ce ces cette comme contre dans de des donc du elle en encore est et été être il ils je la le les leur lors mais même ne nous on ont ou où par
pas plus pour qu que qui sa sans se ses si son sont sous sur tous tout un une vous
al algo antes aunque como con cual cuando de del desde donde el ella en entre era es esta este hasta hay la las le lo los más me mi muy ni no nos
o otra otro para pero por porque que quien se según si sin sobre son su sus también tan un una unos y ya
""".split())  # fmt: skip
# Names of HTML elements and of the tags wikis add.
TAGS = frozenset("""
a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col
colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6
head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee math menu meta meter nav nobr noframes noscript object
ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup
svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xmp
ref references nowiki noinclude includeonly onlyinclude gallery syntaxhighlight poem
""".split())  # fmt: skip
VOID_TAGS = frozenset("br hr img wbr input meta link ref references".split())
# LaTeX commands that take no braces.
BARE_COMMANDS = "item|bf|it|em|rm|sf|tt|sc|sl|par|noindent|indent|newline|linebreak|newpage|clearpage|pagebreak|hline|centering|raggedright|maketitle|tableofcontents|LaTeX|TeX|ldots|dots|quad|qquad|smallskip|medskip|bigskip|hfill|vfill|small|large|Large|huge|footnotesize|tiny"

_ATTRS = r"""(?P<attrs>(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+))?)*)"""
_TAG = re.compile(rf"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*){_ATTRS}\s*(?P<self>/?)>")
_CUT_TAG = re.compile(r"""<(?P<name>/?[A-Za-z][A-Za-z0-9]*)(?P<rest>(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"<>\s]*"?|'[^'<>\s]*'?|[^\s"'<>]*))+|\s*/?\Z|\s+[A-Za-z-]*\Z)""")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*(?:>|\Z)|<!\[CDATA\[|\]\]>|<\?xml[^>]*(?:>|\Z)", re.S | re.I)
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_TEMPLATE = re.compile(r"\{\{(?!\s*\})([^{}]*)\}\}|\{\{[A-Za-z][^{}]*\Z")
_WIKI_LINK = re.compile(r"!?\[\[(?=[^\[\]]*[^\W\d])([^\[\]]+)\]\]|\[\[(?=[^\W\d])[^\[\]]*\Z")
_IMAGE = re.compile(r"!\[([^\[\]]*)\](?:\([^()\s]*(?:\s+[\"'][^\"']*[\"'])?\)?|\[[^\[\]]*\])")
_LINK = re.compile(r"(?<!\w)\[([^\[\]]+)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)?(?:\s+[\"'][^\"']*[\"'])?(?:\)|\Z)")
_REF_LINK = re.compile(r"(?<!\w)\[((?=[^\[\]]*[^\W\d])[^\[\]]+)\]\[[\w .-]*\]|(?<![\w\[\]])\[([^\[\]]+)\]\[\d{1,2}\](?!\[)")
_FOOTNOTE = re.compile(r"\[\^\d{1,3}\]:?")
_QUOTES = re.compile(r"(?<!')('{5}|'{3}|'{2})(?!')(?=\S)(.+?)(?<=\S)\1(?!')", re.S)
_WIKI_HEAD = re.compile(r"(?:(?<=\n)|(?<=\A)|(?<=[.!?…:;] ))(={2,6})[ \t]+(?=\S)(.+?)[ \t]+\1(?!=)|(?<!\S)(={3,6})(?!\S)", re.S)
_HASHES = re.compile(r"(?:(?<=\A)|(?<=\n))#(?=\s+\S)[ \t]*|(?<!\S)#{2,6}(?=\s)[ \t]*")
_STARS = re.compile(r"(?<![\w*\\])(\*{1,3})(?![\s*])((?:(?!\*\*?\w+ and )[^\n])+?)(?<![\s*\\])\1(?![\w*])")
_UNDER = re.compile(r"(?<![\w\\])(_{1,3})(?![\s_])([^\n]+?)(?<![\s_\\])\1(?!\w)")
_TILDES = re.compile(r"(?<!~)~~(?![\s~])(.+?)(?<!\s)~~(?!~)", re.S)
_TICKS = re.compile(r"(?<!`)(`+)(?!`)([^`\n]+)\1(?!`)")
_COMMAND = re.compile(r"~?\\(?P<name>[A-Za-z]+)\*?(?:\[[^\[\]]*\])?\{(?P<arg>[^{}]*)(?:\}|(?=\Z)|(?=[^{}]*\Z))|(?<![\w:\\/])\\(?:" + BARE_COMMANDS + r")(?![A-Za-z\\])[ \t]*")
_GROUP = re.compile(r"\{\\[A-Za-z]+[ \t]+([^{}]*)\}?")
_MATH = re.compile(r"(?<![\w$\\])\${1,2}(?=\S)[^$\s]*[\\^_{][^$\n]*?(?<=\S)\${1,2}(?![\w$])|\\[(\[][^\n]*?\\[)\]]")
_ROW = re.compile(r"\A\s*\|.*\|\s*\Z|\|\s*:?-{3,}:?\s*\|")
_BBCODE = re.compile(r"\[/(?:b|i|u|url|quote|code|img)\]", re.I)
#: A text without any of these holds no markup.
TRIGGER = (
    r"<[A-Za-z/!?]|&#?[A-Za-z0-9]+;|\{\{|\{\\|\[\[|\]\(|\]\[|\[\^|\[/|''|==|##|(?:^|\n)#\s|\\[A-Za-z(\[]|`|~~|\$|\||(?<![\w*])\*+[^\s*]|(?<!\w)_+[^\s_]"
)

#: A text may hold half a mark only if it has one of these.
HALVES = r"\*\*|~~|\]|\}\}|\\[a-z]|>|&|'''|==|`"

#: Each mark that ``strip`` knows has one of these; a text without any of them is returned at once.
_MAY = re.compile(r"<[A-Za-z/!?]|&[#A-Za-z]|\{[{\\]|\[[\[^/]|\][(\[]|\]\]>|''|==|#\s|\\[A-Za-z(\[]|`|~~|\$|\||\*(?<![\w*\\]\*)|_(?<!\w_)")

#: Halves of marks, as they are left where text was cut; in content they are rare, but not unheard of.
_HALF = re.compile(
    r"(?<![\w*])\*{2,3}(?=\w)(?!\w+(?:\W|\Z))|(?<=[^\s*])\*{2,3}(?=\s|[.,;:!?]?\Z)|~~(?=\w)|(?<=\w)~~|\A[^\[\]]*\](?:\([^()\s]+\)|\[\w*\])|\A[^\[\]]*\]\](?!\])|\A[^{}]*\}\}"
    r"|\\(?:text(?:bf|it|tt|sc)|emph|section|subsection|cite|ref|label|begin|end|footnote|url|href)\{?\Z|\A[^<>]*(?:[\"']|\w)\s*/?>(?=\s|\w)|&(?:amp|lt|gt|nbsp|quot|#\d+)\Z"
    r"|'''(?=\w)|(?<=\w)'''|\A={2,6}[ \t]+\w|(?<=\w)[ \t]+={2,6}\Z|`{1,3}(?=\w+\Z)"
)

_DROPPED = frozenset("label ref cite pageref eqref citep citet begin end bibliography bibliographystyle input include usepackage documentclass vspace hspace index".split())


def _strip_tags(text: str) -> tuple[str, int]:
    closing = {m["name"].lower() for m in _TAG.finditer(text) if m["close"]}
    hits = 0

    def tag(m: re.Match[str]) -> str:
        nonlocal hits
        name = m["name"].lower()
        if name not in TAGS:
            return m[0]
        attrs = m["attrs"].strip()
        if attrs and "=" not in attrs and name not in VOID_TAGS:
            return m[0]  # "x<b and c>d"
        generic = m.start() > 0 and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")
        if generic and not (attrs or m["self"] or m["close"] or name in VOID_TAGS or name in closing):
            return m[0]  # a type parameter
        hits += 1
        return "\n" if name in ("br", "p", "div", "li", "tr") and not m["close"] and m.start() > 0 else ""

    text = _TAG.sub(tag, text)
    m = _CUT_TAG.search(text)
    if m and m["name"].lstrip("/").lower() in TAGS and (m["rest"].strip() or m["name"][0] == "/" or not (m.start() and text[m.start() - 1].isalnum())):
        hits += 1
        text = text[: m.start()] + text[m.end() :]
    return text, hits


def strip(text: str) -> tuple[str, int]:
    """(text without markup, number of marks found). Code and formulas are not expected in it."""
    if not _MAY.search(text):
        return text, 0
    hits = 0

    def sub(pattern: re.Pattern[str], to: str | object, s: str) -> str:
        nonlocal hits
        s, n = pattern.subn(to, s)
        hits += n
        return s

    def entity(m: re.Match[str]) -> str:
        nonlocal hits
        if m[0][1] != "#" and m[0][1:] not in html5:
            return m[0]
        hits += 1
        return html.unescape(m[0])

    def command(m: re.Match[str]) -> str:
        return "" if m["name"] is None or m["name"] in _DROPPED else m["arg"]

    s = sub(_COMMENT, "", text)
    s = sub(_AUTOLINK, r"\1", s)
    s, n = _strip_tags(s)
    hits += n
    s = _ENTITY.sub(entity, s)
    s = sub(_TEMPLATE, "", s)
    s = sub(_WIKI_LINK, lambda m: (m[1] or "").rsplit("|", 1)[-1], s)
    s = sub(_IMAGE, r"\1", s)
    s = sub(_LINK, r"\1", s)
    s = sub(_REF_LINK, lambda m: m[1] or m[2], s)
    s = sub(_FOOTNOTE, "", s)
    s = sub(_QUOTES, r"\2", s)
    s = sub(_WIKI_HEAD, lambda m: m[2] or "", s)
    s = sub(_HASHES, "", s)
    s = sub(_MATH, lambda m: m[0].strip("$"), s)
    s = sub(_GROUP, r"\1", s)
    s = sub(_COMMAND, command, s)
    s = sub(_TICKS, r"\2", s)
    s = sub(_TILDES, r"\1", s)
    s = sub(_STARS, r"\2", s)
    s = sub(_UNDER, r"\2", s)
    s = sub(_ROW, lambda m: m[0].strip().strip("|"), s)
    s = sub(_BBCODE, "", s)
    if not hits:
        return text, 0
    return re.sub(r"[ \t]+([,.;:!?])(?=\s|\Z)", r"\1", re.sub(r"[ \t]{2,}", " ", s)).strip(), hits


_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})(.*)$")
_KEPT = re.compile(r"(?<!`)(`+)(?!`)[^`\n]+\1(?!`)|(?<![\w$\\])\$\$.+?\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*[\\^_{][^$\n]*?(?<=\S)\$(?![\w$])|\\\(.+?\\\)|\\\[.+?\\\]", re.S)


def clean_document(text: str | None) -> str | None:
    """Plain text of a document: headings, list markers, table cells, code blocks, inline code and formulas stay.

    Front matter stays as it is, code is copied, everything else loses its marks. Null for null.
    """
    if text is None:
        return None
    out: list[str] = []
    block: list[str] = []

    def flush() -> None:
        if not block:
            return
        kept: list[str] = []
        s = "\n".join(block)
        if "`" in s or "$" in s or "\\" in s:
            s = _KEPT.sub(lambda m: kept.append(m[0]) or f"\x02{len(kept) - 1}\x02", s)
        block.clear()
        for line in s.split("\n"):
            if not kept and "---" not in line and not _MAY.search(line):
                out.append(line.rstrip())
                continue
            m = re.match(r"(\s*(?:>\s?)*\s*(?:[-*+•]\s+(?:\[[ xX]\]\s+)?|\d{1,4}[.)]\s+|#{1,6}\s+)?)(.*)", line, re.S)
            if "---" in line and re.fullmatch(r"\s*\|?[\s:|-]*-{3,}[\s:|-]*\|?\s*", line):
                continue  # rules and the line under a table's head
            body = m[2]
            if body.startswith("|"):
                body = " | ".join(c.strip() for c in body.strip().strip("|").split("|"))
            body = strip(body)[0]
            out.append((m[1] + re.sub("\x02(\\d+)\x02", lambda k: kept[int(k[1])], body)).rstrip())

    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    fence, at = "", 0
    if lines and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        at = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---") + 1
        out += lines[:at]
    for line in lines[at:]:
        m = _FENCE.match(line)
        if fence:
            out.append(line)
            if m and m[2][0] == fence[0] and len(m[2]) >= len(fence) and not m[3].strip():
                fence = ""
        elif m:
            flush()
            out.append(line)
            fence = m[2]
        else:
            block.append(line)
    flush()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out))


def _first_pass(text: str, marks: int, plain: str) -> str:
    words = plain.split()
    length = len(plain)
    if not words:
        return "bad"
    links = sum(len(m[0]) for m in re.finditer(r"https?://\S+|www\.\S+", text)) / max(1, len(text)) if "http" in text or "www." in text else 0
    if links > MAX_LINK_DENSITY:
        return "bad"
    if length < SHORT:
        return "bad" if marks > 2 * len(words) else "short"
    stops = sum(w.strip(".,;:!?()\"'").casefold() in STOP_WORDS for w in words) / len(words)
    if stops >= STOP_HIGH:
        return "good" if length > LONG else "near"
    return "near" if stops >= STOP_LOW else "good" if length > LONG and stops >= 0.15 else "bad"


def blocks(df: DataFrame, text: str) -> DataFrame:
    """Adds plain (text without markup), marks (how many were found) and first (label of the first pass).

    Null and empty text has null or empty plain, no marks and label ``bad``. Rows stay as they are otherwise.
    """

    @F.pandas_udf("plain string, marks int, first string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                plain, marks = strip(t)
                rows.append((plain, marks, _first_pass(t, marks, plain)))
            yield pd.DataFrame(rows, columns=["plain", "marks", "first"])

    x = F.when(F.col(text) != "", run(F.when(F.col(text) != "", F.col(text)).otherwise(" ")))
    return df.withColumn("_b", x).withColumns({"plain": F.coalesce("_b.plain", F.col(text)), "marks": F.coalesce("_b.marks", F.lit(0)), "first": F.coalesce("_b.first", F.lit("bad"))}).drop("_b")


def neighbours(df: DataFrame, document: str, at: str, tie: str, label: str, to: str, shard: int = SHARD, once: bool = False) -> DataFrame:
    """The table with column ``to``: the label, or where it is null that of the nearest row that has one, by places ``at``
    in the same document; of two equally near ones the one before. Null if the document has no label at all.

    A document is cut into shards of ``shard`` places. A row looks in its own shard and, by way of one row per shard, at
    the nearest labels in the shards before and behind; no task holds a whole document. Rows without a place come first.
    once: of rows with the same place and tie one is kept, without another shuffle.
    """
    rows = df.withColumns({"_k": F.struct(F.col(document).alias("x")), "_a": F.coalesce(F.col(at).cast("long"), F.lit(-1)), "_w": F.coalesce(F.floor(F.col(at) / shard), F.lit(-1))})
    own = F.when(F.col(label).isNotNull(), F.struct(F.col(label).alias("l"), F.col("_a").alias("a")))
    order = F.when(own.isNotNull(), F.struct("_a", tie))
    inside = Window.partitionBy("_k", "_w").orderBy("_a", tie)  # a struct is never null, so windows and the join share one shuffle
    rows = rows.withColumns({
        "_up": F.last(own, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_down": F.first(own, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
    })
    shards = rows.groupBy(F.col("_k").alias("_d"), F.col("_w").alias("_cw")).agg(F.max_by(own, order).alias("top"), F.min_by(own, order).alias("low"))
    over = Window.partitionBy("_d").orderBy("_cw")
    carry = shards.select(
        "_d", "_cw", F.last("top", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_cu"), F.first("low", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_cd"),
    )
    rows = rows.join(carry, (F.col("_k") == F.col("_d")) & (F.col("_w") == F.col("_cw")))
    up, down = F.coalesce("_up", "_cu"), F.coalesce("_down", "_cd")
    nearest = F.when(down.isNull() | (F.col("_a") - up["a"] <= down["a"] - F.col("_a")), up["l"]).otherwise(down["l"])
    rows = rows.dropDuplicates(["_k", "_w", "_a", tie]) if once else rows
    return rows.withColumn(to, F.coalesce(F.col(label), nearest)).drop("_k", "_a", "_w", "_up", "_down", "_d", "_cw", "_cu", "_cd")


def _judged(text: str) -> tuple[str | None, bool]:
    """The first pass for residue: (marked, clean or None for undecided, whether there is half a mark)."""
    plain, marks = strip(text)
    if marks:
        return "marked", False
    links = sum(len(m[0]) for m in re.finditer(r"https?://\S+|www\.\S+", text)) if "http" in text or "www." in text else 0
    half = _HALF.search(text) is not None
    if len(text) >= SHORT and links <= MAX_LINK_DENSITY * len(text):
        words = plain.split()
        stops = sum(w.strip(".,;:!?()\"'").casefold() in STOP_WORDS for w in words) / max(1, len(words))
        if stops >= STOP_LOW:
            return "clean", half
    return None, half


def residue(df: DataFrame, document: str, node: str, at: str, text: str) -> DataFrame:
    """document and node of the blocks whose text still holds markup; ``at`` is a block's place in its document.

    Null and empty texts hold none. Repeated rows of a node count once.
    """

    @F.pandas_udf("label string, half boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, False) if t is None else _judged(t) for t in texts], columns=["label", "half"])

    suspect = F.coalesce(F.col(text).rlike(TRIGGER) | F.col(text).rlike(HALVES), F.lit(False))
    rows = df.withColumn("_s", suspect).withColumn("_j", judge(F.when(F.col("_s"), F.col(text))))
    rows = rows.select(F.col(document), F.col(node), F.col(at), F.when(F.col("_s"), F.col("_j.label")).otherwise("clean").alias("first"), F.col("_j.half").alias("half"))
    rows = rows.groupBy(document, node).agg(F.max(F.struct("first", "half", at)).alias("x")).select(document, node, "x.*")  # marked is the larger label
    found = neighbours(rows, document, at, node, "first", "label")
    return found.where("label = 'marked' and (first is not null or half)").select(document, node)


def _second(rows: DataFrame, document: str, at: str, tie: str, counts: Column | None) -> DataFrame:
    """Column label (good or bad) for rows with first: decided ones keep theirs, others take a neighbour's. Repeated rows of
    a place and tie count once."""
    sure = F.when(F.col("first").isin("good", "bad"), F.col("first"))
    counted = sure if counts is None else F.when(counts, sure)
    rows = Scratch(rows.sparkSession, "markup").put(rows.withColumn("_c", counted), "blocks")  # cleaning is dear and its result is read twice
    rows = neighbours(rows, document, at, tie, "_c", "_l", once=True)
    return rows.withColumn("label", F.coalesce(sure, "_l", F.when(F.col("first") == "near", "good").otherwise("bad"))).drop("_c", "_l")


def labelled(df: DataFrame, document: str, at: str, tie: str, text: str, counts: Column | None = None) -> DataFrame:
    """``blocks`` and column label (good or bad) after the second pass over the blocks of each document in order.

    Rows for which ``counts`` is false are labelled, but are no neighbours to others.
    """
    return _second(blocks(df, text), document, at, tie, counts)


def nodes(df: DataFrame, document: str, at: str, tie: str, columns: list[str] | None = None) -> DataFrame:
    """Adds plain (clean text), plain_raw (clean raw), marks and label to nodes of all kinds (kind, text and raw).

    Code and formulas stay as they are and are good. Nodes without a text of their own have null plain; their marks and
    label are those of raw. Labels of neighbours come from ``FLOW_KINDS`` alone, as other nodes lie inside or around these.
    columns: the columns of the table that are kept, all if none are named; texts that nobody reads again are not moved.
    """
    kept, own = F.col("kind").isin(*KEPT_KINDS), F.col("text").isNotNull()
    rows = documents(df.withColumn("_r", F.when(~kept, F.col("raw"))), "_r", "_clean")
    judged = F.when(~kept & (own | (F.col("_clean") != "")), F.coalesce("text", "raw"))
    rows = blocks(rows.withColumn("_j", judged), "_j")
    rows = rows.withColumns({"plain": F.when(kept, F.col("text")).when(own, F.col("plain")), "plain_raw": F.when(kept, F.col("raw")).otherwise(F.col("_clean"))})
    wanted = list(dict.fromkeys([*(columns or df.columns), document, at, tie, "kind"]))
    rows = _second(rows.select(*wanted, "plain", "plain_raw", "marks", "first"), document, at, tie, F.col("kind").isin(*FLOW_KINDS))
    return rows.withColumn("label", F.when(kept, "good").otherwise(F.col("label"))).select(*(columns or df.columns), "plain", "plain_raw", "marks", "label")


def documents(df: DataFrame, text: str, to: str) -> DataFrame:
    """The table with the plain text of whole documents in column ``to``."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(clean_document)

    return df.withColumn(to, run(F.col(text)))
