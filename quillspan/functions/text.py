"""Scalar text functions as columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, in a form Java and RE2 both read.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
OBLIGATION = r"(?i)^(if|when|unless) ([^,]*),(.*)$"
# Modal verbs in the order in which they are looked for.
MODALS = ("must not", "shall not", "should not", "must", "shall", "should", "may")


def sha256(text: Column) -> Column:
    """``sha256:`` and the hex digest of the UTF-8 bytes; null for null."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, SPACE + "+", " "), "^ | $", "")


def normalized_hash(text: Column) -> Column:
    return sha256(collapsed(text))


def excerpt(text: Column, most: int) -> Column:
    """At most ``most`` characters; a cut text ends with an ellipsis, which counts as one."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 1)), F.lit("…")))


def n_bytes(text: Column) -> Column:
    return F.octet_length(text)


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0)))


def digit_mask(text: Column) -> Column:
    """Lower case, digits as ``#``, white space collapsed: lines that differ in numbers alone get one pattern."""
    return F.regexp_replace(collapsed(F.lower(text)), "[0-9]+", "#")


def is_page_number(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"^[\s(\[–-]+|[\s)\]–-]+$", "")
    return (F.octet_length(bare) <= 12) & bare.rlike(r"^([0-9]+|[ivxlcdm]+|page [0-9ivxlcdm]+|p\. ?[0-9]+)$")


def subject_key(subject: Column) -> Column:
    """A subject without reply and forward marks, collapsed and in lower case."""
    return F.lower(collapsed(F.regexp_replace(F.trim(subject), r"(?i)^((re|fw|fwd)[ ]*:[ ]*)+", "")))


def message_ids(value: Column) -> Column:
    """All <...> tokens of a header value, else its words."""
    marked = F.regexp_extract_all(value, F.lit("<[^<>]*>"), F.lit(0))
    return F.when(F.size(marked) > 0, marked).otherwise(F.regexp_extract_all(value, F.lit(r"[^ \t\r\n]+"), F.lit(0)))


def bag(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of words as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice(a: Column, b: Column) -> Column:
    """Of two bags of words: twice the shared occurrences over all."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2 * shared / total)


def safe_link(link: Column) -> Column:
    """A link that can run code becomes ``#blocked-active-uri``; parentheses of others are escaped."""
    bare = F.lower(F.regexp_replace(link, r"[\x00-\x20\x7f]", ""))
    bad = bare.rlike(r"^(javascript:|vbscript:|file:|data:text/html|data:image/svg\+xml)")
    return F.when(bad, F.lit("#blocked-active-uri")).otherwise(F.replace(F.replace(link, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def pointer(key: Column) -> Column:
    """A key as a token of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def without_thoughts(text: Column) -> Column:
    """<think> blocks replaced by spaces of the same length, line ends kept; an open one runs to the end."""
    parts = F.split(text, r"(?=<think>)|(?<=</think>)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<think>"), F.regexp_replace(p, r"[^\r\n]", " ")).otherwise(p)), "")


def clock_ms(text: Column) -> Column:
    """Milliseconds of hh:mm:ss,mmm or hh:mm:ss.mmm (hours may be missing); null for anything else."""
    m = r"^(?:(\d{2,}):)?([0-5]\d):([0-5]\d)[.,](\d{3})$"
    part = [F.regexp_extract(text, m, i) for i in range(1, 5)]
    hours = F.when(part[0] == "", F.lit(0)).otherwise(part[0].try_cast("bigint"))
    return F.when(text.rlike(m), ((hours * 60 + part[1].try_cast("bigint")) * 60 + part[2].try_cast("bigint")) * 1000 + part[3].try_cast("bigint"))


def zone_minutes(date: Column) -> Column:
    """Minutes of a +hhmm offset or a named zone at the end of a mail date; null if there is none."""
    sign = F.regexp_extract(date, r"([+-])\d{4}(?: \([^)]*\))?$", 1)
    hours, minutes = (F.regexp_extract(date, r"[+-](\d{2})(\d{2})(?: \([^)]*\))?$", i).try_cast("int") for i in (1, 2))
    name = F.regexp_extract(date, r"\b(UT|UTC|GMT|EST|EDT|CST|CDT|MST|MDT|PST|PDT)$", 1)
    named = F.element_at(F.create_map(*[F.lit(x) for p in (("UT", 0), ("UTC", 0), ("GMT", 0), ("EST", -300), ("EDT", -240), ("CST", -360), ("CDT", -300), ("MST", -420), ("MDT", -360), ("PST", -480), ("PDT", -420)) for x in p]), name)
    return F.when(sign != "", (hours * 60 + minutes) * F.when(sign == "-", -1).otherwise(1)).when(name != "", named)


def cell_label(row: Column, column: Column) -> Column:
    """The A1 label of a cell, rows and columns counted from 0. Seven letters name every column of an INT, fourteen of a BIGINT."""
    n = column.cast("long") + 1
    first = [sum(26**j for j in range(1, i + 1)) for i in range(14)]  # columns with fewer letters
    digits = [F.when(n > first[i], F.char(65 + F.pmod(F.floor((n - first[i] - 1) / 26**i).cast("long"), F.lit(26)))).otherwise("") for i in reversed(range(14))]
    return F.concat(*digits, (row + 1).cast("string"))


def value_kind(cell: Column) -> Column:
    """null, boolean, integer, decimal, date, date-time or text, by the shape of a cell."""
    t = F.trim(cell)
    return (
        F.when(t.isNull() | F.lower(t).isin("", "null", "na", "n/a"), "null").when(F.lower(t).isin("true", "false"), "boolean")
        .when(t.rlike(r"^-?(0|[1-9][0-9]{0,17})$"), "integer").when(t.rlike(r"^-?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$"), "decimal")
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date").when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}"), "date-time").otherwise("text")
    )


def speaker_prefix(text: Column) -> Column:
    """The upper-case name before a colon on the first line of a cue, or null."""
    name = F.regexp_extract(text, r"^\s*([^:\n]{1,64}):\s", 1)
    return F.when((name != "") & name.rlike(r"\p{L}") & (name == F.upper(name)), F.trim(name))


def obligation(sentence: Column) -> Column:
    """trigger, condition, subject, modality, polarity, action and relation of a conditional obligation, or null.

    The text must begin with if, when or unless; what stands before the first comma is the condition. The first modal of
    ``MODALS`` that the rest holds anywhere decides; what is before it is the subject (null if nothing is), what is
    behind it, without final periods, the action. Without a condition or an action there is no obligation.
    """
    s = collapsed(sentence)
    part = [F.regexp_extract(s, OBLIGATION, i) for i in (1, 2, 3)]
    rest = F.trim(part[2])
    modal = F.coalesce(*[F.when(F.contains(F.lower(rest), F.lit(m)), F.lit(m)) for m in MODALS])
    at = F.instr(F.lower(rest), modal)
    subject = F.trim(F.regexp_replace(F.trim(F.substring(rest, F.lit(1), at - 1)), ",+$", ""))
    action = F.regexp_replace(F.trim(F.substring(rest, at + F.length(modal), F.length(rest))), r"\.+$", "")
    polarity = F.when(modal == "may", "permission").when(modal.endswith(" not"), "prohibition").otherwise("positive")
    relation = F.when(modal == "may", "allows").when(modal.endswith(" not"), "forbids").otherwise("requires")
    return F.when(s.rlike(OBLIGATION) & modal.isNotNull() & (F.trim(part[1]) != "") & (action != ""), F.struct(
        F.lower(part[0]).alias("trigger"), F.trim(part[1]).alias("condition"), F.when(subject != "", subject).alias("subject"), F.replace(modal, F.lit(" "), F.lit("_")).alias("modality"),
        polarity.alias("polarity"), action.alias("action"), relation.alias("relation"),
    ))


def cell_place(reference: Column) -> Column:
    """row and column (from 0) of an A1 reference, dollar signs aside; null for anything else."""
    m = r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$"
    letters = F.split(F.upper(F.regexp_extract(reference, m, 1)), "")
    column = F.aggregate(letters, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1
    return F.when(reference.rlike(m), F.struct((F.regexp_extract(reference, m, 2).try_cast("int") - 1).alias("row"), column.alias("column")))


def citation_label(kind: Column, start: Column, end: Column, name: Column) -> Column:
    """What a locator is called: lines, pages, slides and the like with a number or a range, cells with their sheet, times
    as a clock, anything else by its name."""
    span = F.when(end.isNull() | (end == start), start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    titles = {"line": "line", "page": "page", "slide": "slide", "byte": "bytes", "record": "record", "row": "row", "member": "member", "paragraph": "paragraph", "section": "section", "column": "column", "frame": "frame", "message": "message"}
    clock = F.format_string("%02d:%02d:%02d.%03d", F.floor(start / 3600000), F.floor(start / 60000) % 60, F.floor(start / 1000) % 60, start % 1000)
    numbered = F.concat_ws(" ", F.element_at(F.create_map(*[F.lit(x) for p in titles.items() for x in p]), kind), span)
    return F.when(kind == "cell", F.concat_ws("!", name, cell_label(start, end))).when(kind == "time", clock).when(kind.isin(*titles) & start.isNotNull(), numbered).otherwise(name)


def association_key(text: Column) -> Column:
    """Letters and digits in lower case, anything between as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def caption_kind(text: Column) -> Column:
    """figure or table, by how a caption begins; else null."""
    return F.when(text.rlike(r"(?i)^\s*(figure|fig\.?)\s*[0-9ivxlc]+"), "figure").when(text.rlike(r"(?i)^\s*(table|tab\.)\s*[0-9ivxlc]+"), "table")


def list_marker(text: Column) -> Column:
    """marker and ordered of a list line, or null: a bullet, or a number, Roman number or letter with a point, bracket or
    colon, before white space."""
    first = F.regexp_extract(text, r"^\s*(\S+)(?:\s|$)", 1)
    bullet = first.isin("-", "*", "+", "•", "‣", "◦", "▪")
    number = first.rlike(r"^\(?(?:[0-9]+|[ivxlcdmIVXLCDM]{1,4}|[A-Za-z])[.):]$")
    return F.when(bullet | number, F.struct(first.alias("marker"), number.alias("ordered")))


def visible_latex(text: Column) -> Column:
    """LaTeX text without comments, commands and braces."""
    s = F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")
    s = F.regexp_replace(s, r"\\(?:label|ref|cite\w*|eqref|pageref)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "")
    s = F.regexp_replace(s, r"\\([%&#_{}$ ])", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"\\\\", " "), r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?\s*", "")
    return collapsed(F.regexp_replace(s, r"[{}~]", " "))


def escape_markdown(text: Column) -> Column:
    """Text that Markdown shows as it is."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>()#+!|~-])", r"\\$1")


def inert_code(text: Column) -> Column:
    """Text as a fenced block, the fence being longer than any run of ticks in it."""
    longest = F.array_max(F.concat(F.array(F.lit(2)), F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda x: F.length(x))))
    fence = F.repeat(F.lit("`"), longest + 1)
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)


def escape_latex(text: Column) -> Column:
    s = F.replace(text, F.lit("\\"), F.lit("\x00"))
    s = F.regexp_replace(s, r"([&%$#_{}])", r"\\$1")
    for a, b in (("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"), ("\x00", r"\textbackslash{}")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def percent_decoded(text: Column) -> Column:
    """%xx decoded as UTF-8; a plus stays a plus, and text with a damaged escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def member_path(path: Column) -> Column:
    """path and reason: an archive member's path in one form, or why it is refused (absolute, parent steps, control
    characters, too long or too deep)."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(flat, "/"), lambda p: ~p.isin("", "."))
    reason = (
        F.when(F.coalesce(path, F.lit("")) == "", "empty_path").when(F.octet_length(path) > 4096, "path_too_long").when(path.rlike(r"[\x00-\x1f\x7f-\x9f]"), "control_character").when(flat.rlike(r"^(/|[A-Za-z]:)"), "absolute_path")
        .when(F.array_contains(parts, ".."), "parent_traversal").when(F.size(parts) > 256, "too_many_components").when(F.size(parts) == 0, "empty_path")
    )
    return F.struct(F.when(reason.isNull(), F.array_join(parts, "/")).alias("path"), reason.alias("reason"))


def ical_temporal(value: Column, zone: Column) -> Column:
    """kind (date, utc, zoned, floating or invalid), iso and zone of a calendar value."""
    m = r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(Z?))?$"
    g = [F.regexp_extract(value, m, i) for i in range(8)]
    day, time = F.concat_ws("-", *g[1:4]), F.concat_ws(":", *g[4:7])
    good = value.rlike(m) & F.try_to_date(day, "yyyy-MM-dd").isNotNull() & ((g[4] == "") | (g[4] <= "23") & (g[5] <= "59") & (g[6] <= "60"))
    kind = F.when(~good | value.isNull(), "invalid").when(g[4] == "", "date").when(g[7] == "Z", "utc").when(zone.isNotNull(), "zoned").otherwise("floating")
    iso = F.when(good, F.when(g[4] == "", day).otherwise(F.concat(day, F.lit("T"), time, g[7])))
    return F.struct(kind.alias("kind"), iso.alias("iso"), F.when(kind == "zoned", zone).alias("zone"))


def recurrence(rule: Column) -> Column:
    """The parts of a recurrence rule as a map and whether it is valid; it is never expanded."""
    names = r"(?:FREQ|UNTIL|COUNT|INTERVAL|BYSECOND|BYMINUTE|BYHOUR|BYDAY|BYMONTHDAY|BYYEARDAY|BYWEEKNO|BYMONTH|BYSETPOS|WKST)"
    pieces = F.split(rule, ";")
    keys = F.transform(pieces, lambda p: F.upper(F.split_part(p, F.lit("="), F.lit(1))))
    shape = F.forall(pieces, lambda p: p.rlike(rf"(?i)^{names}=.+$")) & (F.size(F.array_distinct(keys)) == F.size(keys))
    ok = shape & rule.rlike(r"(?i)(^|;)FREQ=(SECONDLY|MINUTELY|HOURLY|DAILY|WEEKLY|MONTHLY|YEARLY)(;|$)") & ~(F.array_contains(keys, "COUNT") & F.array_contains(keys, "UNTIL")) & ~rule.rlike(r"(?i)(^|;)(COUNT|INTERVAL)=(0+|[^0-9;]+)(;|$)")
    return F.struct(F.when(shape, F.map_from_entries(F.transform(pieces, lambda p: F.struct(F.upper(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.split_part(p, F.lit("="), F.lit(2)).alias("v"))))).alias("parts"), ok.alias("valid"))


def box_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Shared area of two boxes (left, top, right, bottom) over the area of the smaller one; null if one has no area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    areas = [(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)]
    return F.when((areas[0] > 0) & (areas[1] > 0), w * h / F.least(*areas))


def locator_problem(kind: Column, start: Column, end: Column, size: Column) -> Column:
    """Why a locator is invalid, or null: unknown kind, no start, below its base (pages, lines and slides count from 1),
    reversed, or beyond the size of what it points into."""
    from_one = kind.isin("line", "page", "slide", "column")
    known = from_one | kind.isin("byte", "record", "row", "cell", "time", "member", "frame", "message", "paragraph", "section")
    return F.when(~F.coalesce(known, F.lit(False)), "unknown_kind").when(start.isNull(), "no_start").when((from_one & (start < 1)) | (start < 0), "below_base").when(end < start, "reversed").when(size.isNotNull() & (F.coalesce(end, start) > size), "out_of_range")


def artifact_risk(media: Column, filename: Column, content: Column) -> Column:
    """inert, document, active, archive or executable: the highest that the leading bytes, the media type or the file's
    extension suggest."""
    ranks = ("inert", "document", "active", "archive", "executable")
    head = F.hex(F.substring(content, 1, 8))
    name, kind = F.lower(filename), F.lower(media)
    found = F.array(
        F.when(head.rlike("^(4D5A|7F454C46|CAFEBABE|FEEDFACE|FEEDFACF|CFFAEDFE|0061736D|2321)"), 4).when(head.rlike("^(504B0304|1F8B|377ABCAF|425A68|FD377A58)"), 3).when(head.rlike("^(25504446|D0CF11E0)"), 1).otherwise(0),
        F.when(kind.rlike("(x-msdownload|x-executable|x-sh$|x-msdos|java-archive|wasm)"), 4).when(kind.rlike("(zip|x-tar|gzip|x-7z|x-bzip2)"), 3).when(kind.rlike("(javascript|html|svg|macroenabled)"), 2).when(kind.rlike("(pdf|msword|officedocument|opendocument|rtf)"), 1).otherwise(0),
        F.when(name.rlike(r"\.(exe|dll|so|dylib|com|bat|cmd|ps1|sh|jar|msi|scr|vbs|wasm|class)$"), 4).when(name.rlike(r"\.(zip|tar|gz|tgz|7z|bz2|xz|rar)$"), 3).when(name.rlike(r"\.(js|mjs|html?|svg|docm|xlsm|pptm|dotm)$"), 2).when(name.rlike(r"\.(pdf|docx?|xlsx?|pptx?|od[tsp]|rtf)$"), 1).otherwise(0),
    )
    return F.element_at(F.array(*map(F.lit, ranks)), F.array_max(found) + 1)
