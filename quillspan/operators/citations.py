"""Bibliographies and citations as joins: keys, duplicate keys, inherited fields, anchors and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.session import Scratch

MAX_DEPTH = 32


def resolve_keys(citations: DataFrame, entries: DataFrame) -> DataFrame:
    """The citations (scope, key) with status ``missing``, ``resolved`` or ``ambiguous``, and the entry that was resolved.

    entries: scope, key, entry. Entries are counted by key before the join, so a key with many entries is joined once.
    """
    by = entries.groupBy("scope", "key").agg(F.count("*").alias("n"), F.min("entry").alias("entry"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return citations.join(by, ["scope", "key"], "left").withColumn("status", status).withColumn("entry", F.when(F.col("n") == 1, F.col("entry"))).drop("n")


def duplicate_keys(entries: DataFrame) -> DataFrame:
    """scope, key and how many entries have it, where there are two or more."""
    return entries.groupBy("scope", "key").agg(F.count("*").alias("entries")).where("entries > 1")


def inherit(entries: DataFrame, fields: DataFrame, depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(effective fields, status) of entries that inherit from others.

    entries: scope, key, parents (array of keys, nearest first: cross reference, then data entries). fields: scope, key,
    name, value. An entry's own fields win, then those of the nearest ancestor. Effective: scope, key, name, value, origin
    (the key it comes from) and distance. status: scope, key and ``complete``, ``unresolved`` (an ancestor is missing),
    ``ambiguous`` (two entries have an ancestor's key), ``cycle`` or ``depth`` (more than ``depth`` levels).
    Each round is one join of the open ends with all entries and a table in the shared folder.
    """
    scratch = Scratch(entries.sparkSession, "inherit")
    known = scratch.put(entries.groupBy("scope", "key").agg(F.count("*").alias("n"), F.first("parents").alias("parents")), "entries")
    links = known.select("scope", "key", F.posexplode_outer("parents").alias("place", "parent")).where("parent != ''")
    front = scratch.put(links.select("scope", "key", F.col("parent").alias("at"), F.lit(1).alias("distance"), F.array("key").alias("seen"), F.array(F.col("place")).alias("way")), "front1")
    ends: list[DataFrame] = []
    bad: list[DataFrame] = []
    for k in range(1, depth + 2):
        cyclic = F.array_contains("seen", F.col("at"))
        bad.append(front.where(cyclic).select("scope", "key", F.lit("cycle").alias("status")))
        on = front.where(~cyclic).join(known.select("scope", F.col("key").alias("at"), "n", F.col("parents").alias("up")), ["scope", "at"], "left")
        bad.append(on.where("n is null").select("scope", "key", F.lit("unresolved").alias("status")))
        bad.append(on.where("n > 1").select("scope", "key", F.lit("ambiguous").alias("status")))
        good = on.where("n = 1")
        if k > depth:
            bad.append(good.select("scope", "key", F.lit("depth").alias("status")))
            break
        ends.append(good.select("scope", "key", F.col("at").alias("origin"), "distance", "way"))
        step = good.select("scope", "key", F.posexplode("up").alias("place", "parent"), (F.col("distance") + 1).alias("distance"), F.array_append("seen", F.col("at")).alias("seen"), "way")
        front = scratch.put(step.where("parent != ''").select("scope", "key", F.col("parent").alias("at"), "distance", "seen", F.array_append("way", F.col("place")).alias("way")), f"front{k + 1}")
        if front.isEmpty():
            break
    own = known.select("scope", "key", F.col("key").alias("origin"), F.lit(0).alias("distance"), F.array().cast("array<int>").alias("way"))
    for e in ends:
        own = own.unionByName(e)
    named = own.join(fields.select("scope", F.col("key").alias("origin"), "name", "value").where("name not in ('crossref', 'xdata')"), ["scope", "origin"])
    first = F.min(F.struct("distance", "way", "origin", "value"))
    effective = named.groupBy("scope", "key", "name").agg(first.alias("x")).select("scope", "key", "name", "x.value", "x.origin", "x.distance")
    wrong = bad[0]
    for b in bad[1:]:
        wrong = wrong.unionByName(b)
    order = F.create_map(*[F.lit(x) for p in (("cycle", 0), ("ambiguous", 1), ("unresolved", 2), ("depth", 3)) for x in p])
    worst = wrong.groupBy("scope", "key").agg(F.min_by("status", order[F.col("status")]).alias("status"))
    status = known.select("scope", "key").join(worst, ["scope", "key"], "left").select("scope", "key", F.coalesce("status", F.lit("complete")).alias("status"))
    return effective, status


def anchors(nodes: DataFrame, source_hash: Column | None = None) -> DataFrame:
    """One anchor for each node with text: scope, target_kind, target_id, locator (its byte range), text_hash, excerpt and
    source_hash."""
    where = F.when(F.col("byte_start").isNotNull(), F.concat_ws("-", F.col("byte_start").cast("string"), F.col("byte_end").cast("string")))
    return nodes.where("text is not null and id is not null").select(
        "scope", F.lit("node").alias("target_kind"), F.col("id").alias("target_id"), where.alias("locator"), T.normalized_hash(F.col("text")).alias("text_hash"), T.excerpt(F.col("text"), 160).alias("excerpt"), (source_hash if source_hash is not None else F.lit(None).cast("string")).alias("source_hash"),
    )


def verify(anchors: DataFrame, versions: DataFrame, candidates: DataFrame, budget: int = 100_000) -> DataFrame:
    """The anchors' scope, target_id, status and found: the candidate an anchor was verified or relocated to.

    versions: scope, source_hash and, if it may not be checked at all, verifiable (false). candidates: scope, target_kind,
    target_id, locator, text_hash. The first that holds decides: ``unverifiable`` (no such version, or more candidates
    than the budget), ``exact`` (the source is the same, or the node is and has the text), ``changed`` (the node has
    another text and none has the old one), ``relocated`` (by locator with the text, or one other node has it),
    ``ambiguous`` (several have), ``missing``. Candidates are counted by scope and by text before they are joined.
    """
    of = anchors.withColumn("_a", F.monotonically_increasing_id())
    of = Scratch(anchors.sparkSession, "verify").put(of, "anchors")
    v = versions.groupBy("scope").agg(F.max("source_hash").alias("v_hash"), F.max("verifiable").alias("ok") if "verifiable" in versions.columns else F.lit(True).alias("ok"))
    n = candidates.groupBy("scope").agg(F.count("*").alias("n_all"))
    node = candidates.groupBy("scope", "target_kind", "target_id").agg(F.max("text_hash").alias("own_hash"))
    place = candidates.where("locator is not null and text_hash is not null").groupBy("scope", "target_kind", "locator", "text_hash").agg(F.count("*").alias("n_place"), F.min("target_id").alias("at_place"))
    text = candidates.where("text_hash is not null").groupBy("scope", "target_kind", "text_hash").agg(F.count("*").alias("n_text"), F.min("target_id").alias("with_text"))
    rows = of.join(v, "scope", "left").join(n, "scope", "left").join(node, ["scope", "target_kind", "target_id"], "left").join(place, ["scope", "target_kind", "locator", "text_hash"], "left").join(text, ["scope", "target_kind", "text_hash"], "left")
    same_source = F.coalesce(F.col("source_hash") == F.col("v_hash"), F.lit(False))
    status = (
        F.when(F.col("v_hash").isNull() & F.col("ok").isNull() | ~F.coalesce("ok", F.lit(True)) | (F.coalesce("n_all", F.lit(0)) > budget), "unverifiable").when(same_source, "exact").when(F.col("own_hash") == F.col("text_hash"), "exact")
        .when(F.col("n_place") == 1, "relocated").when(F.col("n_place") > 1, "ambiguous").when(F.col("n_text") == 1, "relocated").when(F.col("n_text") > 1, "ambiguous").when(F.col("own_hash").isNotNull(), "changed").otherwise("missing")
    )
    rows = rows.withColumn("status", status)
    found = F.when(F.col("status") == "exact", F.col("target_id")).when(F.col("status") == "relocated", F.coalesce(F.when(F.col("n_place") == 1, F.col("at_place")), "with_text"))
    return rows.select("scope", "target_id", "status", found.alias("found"))


def references(links: DataFrame, targets: DataFrame) -> DataFrame:
    """links (scope, source, name) with the anchors they name (targets: scope, name, target): resolved, unresolved or
    ambiguous, with the first target."""
    by = targets.groupBy("scope", "name").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return links.join(by, ["scope", "name"], "left").select("scope", "source", "name", "target", status.alias("status"))


def associate(sources: DataFrame, targets: DataFrame, least: float = 0.8, group: str = "scope") -> DataFrame:
    """scope, source, target, score and status of text blocks paired with the blocks they became.

    Blocks with the same words pair first, by their order. Of the rest only pairs meet that share one of their rarest
    words, as many as a pair above the threshold must have at least one of (prefix filter over word occurrences, which
    loses no pair). Scores are bag-Dice; the best pair of both of its blocks is ``matched``, equal bests are ``ambiguous``,
    blocks without a pair above ``least`` are ``unmatched``. sources and targets: scope, id, text.
    """
    def normal(df: DataFrame, name: str) -> DataFrame:
        words = F.array_compact(F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != ""))
        return df.select(F.col(group).alias("g"), F.col("id").cast("string").alias(name), words.alias(f"{name}_w")).where(F.size(f"{name}_w") > 0)

    a, b = normal(sources, "a"), normal(targets, "b")
    order = lambda x: F.row_number().over(Window.partitionBy("g", f"{x}_h").orderBy(x))
    ah, bh = (df.withColumn(f"{x}_h", F.sha2(F.array_join(f"{x}_w", " "), 256)).withColumn("n", order(x)) for df, x in ((a, "a"), (b, "b")))
    exact = ah.join(bh.withColumnRenamed("b_h", "a_h"), ["g", "a_h", "n"]).select("g", "a", "b", F.lit(1.0).alias("score"), F.lit("matched").alias("status"))
    scratch = Scratch(sources.sparkSession, "associate")
    exact = scratch.put(exact, "exact")
    a = scratch.put(a.join(exact.select("g", "a"), ["g", "a"], "left_anti"), "a")
    b = scratch.put(b.join(exact.select("g", "b"), ["g", "b"], "left_anti"), "b")
    # a pair above the threshold shares an occurrence among the first (1 - t / (2 - t)) part of each side's, rarest first
    def occurrences(df: DataFrame, name: str) -> DataFrame:
        each = df.select("g", name, F.size(f"{name}_w").alias("size"), F.posexplode(f"{name}_w").alias("at", "word"))
        k = F.row_number().over(Window.partitionBy("g", name, "word").orderBy("at"))
        return each.select("g", name, "size", F.concat_ws("#", "word", k.cast("string")).alias("w"))

    rare = occurrences(b, "b").groupBy("g", "w").agg(F.count("*").alias("df"))
    keep = 1 - least / (2 - least)

    def prefix(df: DataFrame, name: str) -> DataFrame:
        each = occurrences(df, name).join(rare, ["g", "w"], "left")
        place = F.row_number().over(Window.partitionBy("g", name).orderBy(F.coalesce("df", F.lit(0)), "w"))
        return each.withColumn("p", place).where(F.col("p") <= F.floor(F.col("size") * keep + 1e-9) + 1).select("g", "w", name)

    pairs = prefix(a, "a").join(prefix(b, "b"), ["g", "w"]).select("g", "a", "b").distinct().join(a, ["g", "a"]).join(b, ["g", "b"])
    scored = pairs.select("g", "a", "b", T.dice(F.col("a_w"), F.col("b_w")).alias("score")).where(F.col("score") >= least)
    best = scored.withColumns({"ra": F.rank().over(Window.partitionBy("g", "a").orderBy(F.desc("score"))), "rb": F.rank().over(Window.partitionBy("g", "b").orderBy(F.desc("score")))}).where("ra = 1 and rb = 1")
    best = best.withColumn("n", F.greatest(F.count("*").over(Window.partitionBy("g", "a")), F.count("*").over(Window.partitionBy("g", "b"))))
    near = scratch.put(best.select("g", "a", "b", "score", F.when(F.col("n") > 1, "ambiguous").otherwise("matched").alias("status")), "near")
    rest = a.join(near.select("g", "a"), ["g", "a"], "left_anti").select("g", "a", F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("score"), F.lit("unmatched").alias("status"))
    return exact.unionByName(near).unionByName(rest).withColumnsRenamed({"g": group, "a": "source", "b": "target"})
