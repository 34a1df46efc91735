"""Encoding a corpus with a public byte-level BPE tokenizer by forced-boundary splitting.

A pair of bytes that stands side by side in no token of the vocabulary can never be joined by a merge, so a position
between two such bytes is a certain cut. A cut must also leave the splitting pattern's matches alone; that holds at a
character border whose left character is no white space (white space looks ahead) and whose right one is no apostrophe
(it may begin a contraction). Every text is cut at all such positions, the fragments are encoded by themselves and
their ids are joined; as most fragments are words, a worker remembers the ids of those it has seen. A text longer than
``BLOCK_BYTES`` is first cut, at certain cuts too, into blocks that are spread over the tasks. The table of byte pairs
is derived from the vocabulary file when a worker starts.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts above this size are encoded by several tasks.
BLOCK_BYTES = 1 << 20
#: Fragments whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 500_000

# Fixed value: the pattern published with the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the code points the pattern takes as white space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Encoder:
    """Encodes texts with a rank file, fragment by fragment."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[bytes, list[int]] = {}
        self.never = np.ones((256, 256), bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                self.never[a, b] = False
        last = sorted({chr(c).encode()[-1] for c in SPACES} | {0x1C, 0x1D, 0x1E, 0x1F})
        self.never[last, :] = False  # the byte may end white space
        self.never[:, 0x80:0xC0] = False  # inside a character
        self.never[:, ord("'")] = False

    def cuts(self, data: bytes) -> np.ndarray:
        """All certain cuts of a text's bytes, in order."""
        b = np.frombuffer(data, np.uint8)
        return np.flatnonzero(self.never[b[:-1], b[1:]]) + 1

    def fragments(self, data: bytes) -> list[bytes]:
        """The text's bytes between all certain cuts."""
        at = [0, *self.cuts(data).tolist(), len(data)] if data else []
        return [data[a:b] for a, b in zip(at, at[1:])]

    def blocks(self, data: bytes, size: int = BLOCK_BYTES) -> list[bytes]:
        """The text's bytes in blocks that end at the first certain cut after ``size`` bytes."""
        cuts, out, at = self.cuts(data), [], 0
        while at < len(data):
            k = np.searchsorted(cuts, at + size)
            end = int(cuts[k]) if k < len(cuts) else len(data)
            out.append(data[at:end])
            at = end
        return out

    def encode_bytes(self, data: bytes) -> list[int]:
        seen, ids = self.seen, []
        for part in self.fragments(data):
            known = seen.get(part)
            if known is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                known = seen[part] = self.bpe.encode_ordinary(part.decode())
            ids += known
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; none for an empty and for a null text."""
        return self.encode_bytes((text or "").encode("utf-8", "replace"))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _ids(texts: pa.Array, bpe: Encoder) -> pa.ListArray:
    ids = [bpe.encode(t) for t in texts.to_pylist()]
    offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(offsets[-1]))))


def encode(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}", block: int = BLOCK_BYTES) -> DataFrame:
    """key and ids of every row. An empty and a null text have an empty list. Rows with the same text are encoded each by
    itself; a null key is kept. Nothing is shuffled but the blocks of texts above ``block`` bytes."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids(batch.column(1), bpe)], ["k", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for row in range(batch.num_rows):
                parts = [b.decode() for b in bpe.blocks(batch.column(2)[row].as_py().encode("utf-8", "replace"), block)]
                at = pa.array(np.zeros(len(parts), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1).take(at), batch.column(1).slice(row, 1).take(at), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["k", "h", "part", "t"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _ids(batch.column(4), bpe)], ["k", "h", "part", "n", "ids"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    small = rows.where(F.coalesce(F.octet_length("t") <= block, F.lit(True))).mapInArrow(whole, f"k {kind}, ids array<int>")
    long = rows.where(F.octet_length("t") > block).select("k", F.xxhash64("t").alias("h"), "t")
    blocks = long.mapInArrow(cut, f"k {kind}, h long, part int, t string").groupBy("k", "h", "part").agg(F.count("*").alias("n"), F.first("t").alias("t"))
    joined = blocks.select("k", "h", "part", "n", "t").mapInArrow(parts, f"k {kind}, h long, part int, n long, ids array<int>").groupBy("k", "h").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p"))
    again = joined.select("k", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("n")))).select("k", "ids")
    return small.unionByName(again).select(F.col("k").alias(key), "ids")


def count_tokens(df: DataFrame, text: str, to: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """The table with the number of tokens of a text in column ``to`` (0 for an empty and a null text)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        bpe = encoder(path)
        return texts.map(lambda t: len(bpe.encode(t)))

    return df.withColumn(to, count(F.col(text)))
