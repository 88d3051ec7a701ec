"""Packing by binary decomposition: no sequence holds two documents.

A document is its ids with one closing id behind them. It is cut into as many
pieces of the longest length as it fills, then into one piece for each binary
digit of what is left, longest first. Every piece is a sequence by itself, of a
power of two, so nothing is padded, and sequences of one length form a bucket.

Sequences are numbered without gaps, the longest bucket first; within a bucket by
input partition and place there.

Defined cases: a null or empty text has the closing id alone; a null doc_id stays
null; repeated rows are documents of their own; texts of any length are encoded
in stretches; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomespark.llm import tokens
from tomespark.llm.common import stash

LONGEST = 1024
CLOSING = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"


def decomposition(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths that ``n`` ids are cut into; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def _pieces(longest: int, closing: int, tokenizer: str | None):
    end = closing.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = tokens.encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encoder.ids(text.as_py() or "") + end)
                n, at = len(ids) // 4, 0
                for length in decomposition(n, longest):
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    rows.append((doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, part, nth))
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return run


def pack(docs: DataFrame, longest: int = LONGEST, closing: int = CLOSING, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its place ``nth`` in the bucket of its length.

    ``tokenizer`` is the file of a public tokenizer, which every machine has.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stash(named.mapInArrow(_pieces(longest, closing, tokenizer), PIECES), "binary-pieces")
    # A row for each bucket of each partition: no more than twice as many as there are digits and tasks.
    filled = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    buckets = filled.groupBy("length").agg(F.sum("n").alias("size"))
    before = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("length", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip")).join(buckets, "length")
    nth = F.col("skip") + F.col("nth")
    return pieces.join(starts, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + nth).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), nth.alias("nth")
    )
