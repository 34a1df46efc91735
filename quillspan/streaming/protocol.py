"""Streams of events with one terminal each: checks, collection into a batch, and parsers that see a text in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspan.formats.base import parse
from quillspan.formats.model_output import candidates
from quillspan.formats.structured import canonical
from quillspan.operators import detect as D

#: Bytes of an answer that a stream keeps.
MAX_BUFFER = 128 << 20


def problems(events: DataFrame) -> DataFrame:
    """stream and problem of streams that break the protocol: items numbered from 0 without a gap, then exactly one terminal
    that says how many there were, and ``complete`` only if no item is partial.

    events: stream, event (``item`` or ``terminal``), sequence, status (of an item: ``complete`` or ``partial``; of a
    terminal: ``complete``, ``partial``, ``failed`` or ``cancelled``) and emitted (of a terminal).
    """
    item, end = F.col("event") == "item", F.col("event") == "terminal"
    per = events.groupBy("stream").agg(
        F.count_if(item).alias("n"), F.count_if(end).alias("ends"), F.countDistinct(F.when(item, F.col("sequence"))).alias("different"), F.min(F.when(item, F.col("sequence"))).alias("low"), F.max(F.when(item, F.col("sequence"))).alias("high"), F.max(F.when(end, F.col("sequence"))).alias("end_at"),
        F.max(F.when(end, F.col("emitted"))).alias("emitted"), F.max(F.when(end, F.col("status"))).alias("status"), F.bool_or(item & (F.col("status") == "partial")).alias("partial"),
    )
    found = F.array_compact(F.array(
        F.when(F.col("ends") == 0, "missing_terminal"), F.when(F.col("ends") > 1, "several_terminals"), F.when((F.col("n") > 0) & ((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("different") != F.col("n"))), "sequence_gap"),
        F.when(F.col("end_at") < F.coalesce("high", F.lit(-1)), "event_after_terminal"), F.when((F.col("ends") == 1) & (F.col("emitted") != F.col("n")), "count_mismatch"), F.when((F.col("status") == "complete") & F.col("partial"), "complete_with_partial"),
    ))
    return per.select("stream", F.explode(found).alias("problem"))


def collect_batch(events: DataFrame) -> DataFrame:
    """The items of a stream that keeps the protocol, with the terminal's status; raises for one that does not."""
    bad = problems(events).first()
    if bad is not None:
        raise ValueError(f"stream {bad.stream}: {bad.problem}")
    ends = events.where("event = 'terminal'").select("stream", F.col("status").alias("outcome"))
    return events.where("event = 'item'").join(ends, "stream")


def emitted(items: DataFrame, stream: str, order: list[str], status: str | None = None) -> DataFrame:
    """Rows as a stream's events in an order, with one terminal each."""
    state = F.col(status) if status else F.lit("complete")
    each = items.select(F.col(stream).alias("stream"), F.lit("item").alias("event"), (F.row_number().over(Window.partitionBy(stream).orderBy(*order)) - 1).cast("long").alias("sequence"), state.alias("status"), F.lit(None).cast("long").alias("emitted"))
    ends = each.groupBy("stream").agg(F.count("*").alias("n"), F.bool_or(F.col("status") != "complete").alias("odd"))
    return each.unionByName(ends.select("stream", F.lit("terminal").alias("event"), F.col("n").alias("sequence"), F.when(F.col("odd"), "partial").otherwise("complete").alias("status"), F.col("n").alias("emitted")))


def within_budget(events: DataFrame, limit: int) -> DataFrame:
    """The events of streams up to ``limit`` items; a stream with more ends there with a ``partial`` terminal."""
    kept = events.where((F.col("event") == "item") & (F.col("sequence") < limit))
    over = events.where(F.col("event") == "terminal").select("stream", F.lit("terminal").alias("event"), F.least("emitted", F.lit(limit)).alias("sequence"), F.when(F.col("emitted") > limit, "partial").otherwise(F.col("status")).alias("status"), F.least("emitted", F.lit(limit)).alias("emitted"))
    return kept.unionByName(over)


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Files of a folder as they arrive: path, name and content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")


def record_stream(spark: SparkSession, path: str, format: str, files_per_batch: int = 100, **options: object) -> DataFrame:
    """The rows of files of one format as they arrive: delimited records, mail folders and any other parser's."""
    return parse(file_stream(spark, path, files_per_batch), "path", "content", format, **options)


def ingest_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The rows of files of any format as they arrive, read as what their bytes, or else their names, say they are."""
    found = file_stream(spark, path, files_per_batch)
    text = F.lit(None).cast("string")
    by_bytes = F.get(D.magic_signals(F.col("content")), F.lit(0))["format"]
    by_name = F.get(D.label_signals(F.col("name"), text, text), F.lit(0))["format"]
    by_text = F.get(D.text_signals(D.text_sample(F.col("content"))), F.lit(0))["format"]
    return parse(found.withColumn("format", F.coalesce(by_bytes, by_name, by_text, F.lit("text"))), "path", "content", F.col("format"))


EVENTS = "stream string, sequence long, event string, candidate string, grammar string, status string, value string"


def answer_events(chunks: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Events of answers that arrive in chunks (stream, position, chunk, last), on batch and streaming tables alike.

    A candidate is ``started`` and ``updated`` when it is first whole, ``updated`` when its value changes, and each answer
    ends with ``finished`` for what the whole text holds and one ``terminal``. Chunks of an answer are put in order; what
    comes before its predecessors waits. With ``timeout_ms``, answers
    that say nothing more for so long end as partial (a query with it runs until it is stopped).
    """
    streaming = chunks.isStreaming
    state = "text string, next long, waiting map<long,string>, seen map<string,string>, sequence long, last long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        text, nxt, waiting, seen, n, last = store.get if store.exists else ("", 0, {}, {}, 0, -1)
        waiting, seen, out = dict(waiting or {}), dict(seen or {}), []

        def event(kind: str, ident: str | None = None, grammar: str | None = None, status: str | None = None, value: str | None = None) -> None:
            nonlocal n
            out.append((key[0], n, kind, ident, grammar, status, value))
            n += 1

        def look(final: bool) -> None:
            found = candidates(text)
            for c in found:
                ident = f"{c.grammar}@{len(text[: c.start].encode())}"
                value = canonical(c.value) if c.ok else None
                whole = c.ok and not c.repairs and (final or c.end < len(text.rstrip()) or c.grammar in ("raw_json", "fenced_json"))
                if whole and seen.get(ident) != value:
                    if ident not in seen:
                        event("started", ident, c.grammar, c.status)
                    event("updated", ident, c.grammar, c.status, value)
                    seen[ident] = value
                if final:
                    event("finished", ident, c.grammar, c.status, value)

        if store.hasTimedOut:
            look(True)
            event("terminal", status="partial")
            store.remove()
        else:
            for frame in frames:
                for p, chunk, end in zip(frame["position"], frame["chunk"], frame["last"]):
                    if int(p) >= nxt:
                        waiting[int(p)] = chunk or ""
                    if end:
                        last = int(p)
            while nxt in waiting:
                text, nxt = text + waiting.pop(nxt), nxt + 1
            if len(text.encode()) > MAX_BUFFER:
                event("terminal", status="failed")
                store.remove()
            elif 0 <= last < nxt:
                look(True)
                event("terminal", status="complete")
                store.remove()
            else:
                look(False)
                store.update((text, nxt, waiting, seen, n, last))
                if timeout_ms:
                    store.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    if not streaming:
        return _batch_answers(chunks, run)
    return chunks.groupBy("stream").applyInPandasWithState(run, EVENTS, state, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


class _Once:
    """The state of a group that is seen once."""

    exists = hasTimedOut = False

    def update(self, value: tuple) -> None:
        self.value = value

    def remove(self) -> None:
        self.value = None


def _batch_answers(chunks: DataFrame, run) -> DataFrame:
    def once(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(run(key, iter([frame.sort_values("position")]), _Once())))

    return chunks.groupBy("stream").applyInPandas(once, EVENTS)
