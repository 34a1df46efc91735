"""Queries of the language-model data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import lookalike, markup, mix, mojibake, spam, split, tokens, turns
from quillspan.session import Scratch, table


def _headers(spark: SparkSession, d: str) -> DataFrame:
    threads = table(spark, d, "mail_messages").select("stable_id", "thread_id").distinct()
    return table(spark, d, "email_headers").select("header_id", "stable_id", "normalized_name", F.coalesce("decoded_value", "unfolded_value").alias("value")).join(threads, "stable_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(_headers(spark, d), "header_id", ["thread_id", "normalized_name"], "value")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.classes(_headers(spark, d), "header_id", ["thread_id", "normalized_name"], "value")


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    headers = table(spark, d, "email_headers").select("header_id", F.coalesce("decoded_value", "unfolded_value").alias("value"))
    return lookalike.one_form(headers, "value", "form").select("header_id", "form").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "markdown_nodes").where(F.col("kind").isin(*markup.TEXT_KINDS))
    return markup.residue(blocks, "md_doc_id", "id", "byte_start", "text")


def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "markdown_nodes").select("md_doc_id", "id", "kind", "text", "raw", "byte_start")
    return markup.nodes(nodes, "md_doc_id", "byte_start", "id", ["md_doc_id", "id", "kind"])


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "markdown_documents").select("md_doc_id", "decoded_text").dropDuplicates(["md_doc_id"])
    return markup.documents(docs, "decoded_text", "plain").select("md_doc_id", "plain")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split.piece_offsets(table(spark, d, "markdown_documents"), "md_doc_id", "decoded_text").where("piece = 1").select("md_doc_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(table(spark, d, "markdown_documents"), "md_doc_id", "decoded_text")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """All texts as lines of large files, which are split by byte ranges: characters of the files, characters that the
    pieces cover once their overlaps are taken off, and pieces above the limit."""
    path = f"{Scratch(spark, 'split').root}/files"
    table(spark, d, "markdown_documents").where("decoded_text is not null").select("decoded_text").write.text(path)
    found = split.file_pieces(spark, path, texts=False)
    each = found.groupBy("path").agg(F.max("end").alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("pieces"), F.count_if(F.col("end") - F.col("start") > split.LIMIT).alias("above"))
    return each.agg(F.sum("n").alias("characters"), F.sum(F.col("covered") - split.OVERLAP * (F.col("pieces") - 1)).alias("covered"), F.sum("above").alias("above_limit"))


def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    """For every document the characters its pieces cover, the overlaps taken off, and pieces above the limit."""
    found = split.pieces(table(spark, d, "markdown_documents"), "md_doc_id", "decoded_text")
    each = found.groupBy("md_doc_id").agg(F.sum(F.length("text") - F.when(F.col("piece") > 0, split.OVERLAP).otherwise(0)).alias("covered"), F.count_if(F.length("text") > split.LIMIT).alias("above_limit"))
    return each


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The openings of the operator's turns except those at pauses, which are no cases by definition."""
    found = turns.openings(table(spark, d, "transcript_segments"), table(spark, d, "recording_speakers"), table(spark, d, "recordings"))
    return found.where("cause in ('first', 'person')").select("recording_id", "segment_index")


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns that end at another person and at a pause above the 95 % quantile of the recording's own pauses."""
    return turns.turns(table(spark, d, "transcript_segments"), table(spark, d, "recording_speakers"), table(spark, d, "recordings"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "markdown_documents").select(F.lit("markdown_documents").alias("record_table"), F.col("md_doc_id").alias("record_id"), F.col("decoded_text").alias("text"))
    headers = table(spark, d, "email_headers").select(F.lit("email_headers").alias("record_table"), F.col("header_id").alias("record_id"), F.col("decoded_value").alias("text"))
    return mojibake.mend(documents.unionByName(headers), "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("record_table", "record_id").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("record_table", "record_id", "kind", "restored").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return mix.mix(tokens.count_tokens(docs, "text", "n_tokens"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_words(spark: SparkSession, d: str) -> DataFrame:
    """The mixes with sizes in words between white space, which SQL can count, too."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.size(F.regexp_extract_all("text", F.lit("[^ \\t\\r\\n]+"), F.lit(0))).cast("long").alias("n_tokens"))
    return mix.mix(docs, table(spark, d, "mix_targets"))[0]


def p9_word_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.size(F.regexp_extract_all("text", F.lit("[^ \\t\\r\\n]+"), F.lit(0))).cast("long").alias("n_tokens"))
    report = mix.mix(docs, table(spark, d, "mix_targets"))[1]
    return report.select("mix_name", "source", F.round("target_share", 9).alias("target_share"), F.round("target_tokens", 3).alias("target_tokens"), "actual_tokens", F.round("actual_share", 9).alias("actual_share"), "documents", "max_uses", "status")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spam.judge(table(spark, d, "documents"), "doc_id", "text", "site")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("spam").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", "vote", "host_rate", "score", "spam")


QUERIES = {
    "p1_found": p1_found, "p1_classes": p1_classes, "p1_forms": p1_forms, "p2_found": p2_found, "p2_blocks": p2_blocks, "p2_documents": p2_documents, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_files": p3_files, "p3_cover": p3_cover, "p6_found": p6_found, "p6_turns": p6_turns, "p7_found": p7_found, "p7_restored": p7_restored,
    "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_words": p9_words, "p9_word_shares": p9_word_shares, "p10_found": p10_found, "p10_scores": p10_scores,
}
_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS n, md5(doc_id || ' 0')[:15] AS key FROM documents WHERE source IS NOT NULL),
s AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n / 2 AS middle, sum(n) OVER (PARTITION BY source) AS t FROM d WHERE n > 0),
w AS (SELECT mix_name, source, sum(greatest(coalesce(weight, 0), 0)) AS w, max(greatest(coalesce(max_repeats, 0), 0)) AS cap FROM mix_targets GROUP BY 1, 2),
x AS (SELECT w.*, coalesce(z.t, 0) AS t, w / sum(w) OVER (PARTITION BY mix_name) AS share FROM w LEFT JOIN (SELECT source, max(t) AS t FROM s GROUP BY 1) z USING (source)),
y AS (SELECT *, CASE WHEN w > 0 AND cap > 0 AND t > 0 THEN w / sum(CASE WHEN w > 0 AND cap > 0 AND t > 0 THEN w END) OVER (PARTITION BY mix_name) END AS part FROM x),
b AS (SELECT *, least(coalesce(part * min(cap * t / part) OVER (PARTITION BY mix_name), 0), cap * t) AS budget FROM y),
u AS (SELECT mix_name, source, doc_id, n, least(floor(budget / b.t) + CASE WHEN middle <= budget - floor(budget / b.t) * b.t THEN 1 ELSE 0 END, cap) AS uses FROM b JOIN s USING (source) WHERE budget > 0),
v AS (SELECT mix_name, source, doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(uses AS INTEGER) AS uses FROM u WHERE uses > 0)
"""
SQL = {
    "p3_found": "SELECT DISTINCT md_doc_id FROM markdown_documents WHERE length(decoded_text) > 4000",
    "p3_files": "SELECT sum(length(decoded_text) + 1)::BIGINT AS characters, sum(length(decoded_text) + 1)::BIGINT AS covered, 0::BIGINT AS above_limit FROM markdown_documents",
    "p3_cover": "SELECT md_doc_id, any_value(length(decoded_text)) AS covered, 0 AS above_limit FROM markdown_documents WHERE decoded_text <> '' GROUP BY 1",
    "p9_words": _MIX + "SELECT * FROM v",
    "p9_word_shares": _MIX
    + """, g AS (SELECT mix_name, source, CAST(sum(n_tokens * uses) AS BIGINT) AS got, count(*) AS documents, max(uses) AS m FROM v GROUP BY 1, 2)
SELECT mix_name, source, round(share, 9) AS target_share, round(CAST(budget AS DOUBLE), 3) AS target_tokens, coalesce(got, 0) AS actual_tokens, round(coalesce(got, 0) / sum(coalesce(got, 0)) OVER (PARTITION BY mix_name), 9) AS actual_share,
coalesce(documents, 0) AS documents, coalesce(m, 0) AS max_uses, CASE WHEN w <= 0 OR cap <= 0 THEN 'unused' WHEN t = 0 THEN 'no_documents' ELSE 'met' END AS status FROM b LEFT JOIN g USING (mix_name, source)""",
}
