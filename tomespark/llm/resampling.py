"""Importance resampling towards a target: documents whose word runs look like the target's are drawn more often.

Features are all runs of 1 to ``longest`` consecutive words, hashed into buckets
by the CRC of their bytes. One scan of a document keeps a ring of running CRC
states, one for each of the last ``longest`` starts; a word extends every state
by a space and its own bytes, opens a new one, and each state is a feature. A
text is never joined into runs, and a word's bytes are read ``longest`` times.

The counts of all buckets are summed in Spark, and their gains, a list as long as
there are buckets, go to every task. A document's weight is the floored mean of
its gains; Gumbel noise from a hash of its id makes the draw one without
replacement. Ranks come from one range sort: rows keep their place in their
range, and the ranges' counts give what goes before.

Defined cases: a null or empty text has no words, no features and weight 0. A
null doc_id has no noise: score and rank are null, and it does not count among
the documents drawn from. Equal scores go to the smaller doc_id, and rows that
repeat are each drawn, in input order. Long texts are scanned in segments that
end between words. Empty tables give no rows or no counts, and the smoothing
keeps every gain finite. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomespark.llm.common import stash

BUCKETS, LONGEST = 10_000, 2
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
SEGMENT_BYTES = 1 << 20

#: Bytes as features see them: A-Z in lower case, all other ASCII but digits and letters blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def segments(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists of about SEGMENT_BYTES."""
    at = 0
    while len(raw) - at > SEGMENT_BYTES:
        end = raw.rfind(b" ", at, at + SEGMENT_BYTES) if b" " in raw[at : at + SEGMENT_BYTES] else raw.find(b" ", at + SEGMENT_BYTES)
        if end < 0:
            break
        yield raw[at:end].split()
        at = end + 1
    yield raw[at:].split()


def scan(text: str | None, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """For each segment of a text: how many words it has, and the buckets of the features that end in it."""
    crc, ring = zlib.crc32, []
    for words in segments((text or "").encode().translate(_BYTES)):
        out = []
        for word in words:
            more = b" " + word
            ring = [crc(more, state) for state in ring]
            ring.append(crc(word))
            out += ring
            if len(ring) == longest:
                del ring[0]
        yield len(words), np.array(out, np.int64) % buckets


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket is met in ``text``. A task sends a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in scan(text.as_py(), longest, buckets):
                    counts += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["bucket", "n"])

    held = texts.select(F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """For every bucket 1000 times the log of how much more of the target than of the documents falls into it, floored.

    Only the counts of the buckets come to the driver, and there are ``buckets`` of them at any size.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, texts in ((s, docs), (t, target)):
        for row in bucket_counts(texts, longest, buckets).collect():
            counts[row["bucket"]] = row["n"]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """Gumbel noise times 1000, floored, from a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_words = n_features = total = 0
                for n, found in scan(text.as_py(), longest, len(gain)):
                    n_words, n_features, total = n_words + n, n_features + len(found), total + int(gain[found].sum())
                weight = total // n_features if n_features else 0
                rows.append((doc_id, n_words, n_features, weight, None if doc_id is None else weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, SCORED)


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` as of scored() with ``rank``, from 1 for the best; null where a row is not drawn.

    The range sort deals equal scores by id and input order, so no range is bound to one of them.
    """
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    allowed = rows.where(may)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = allowed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The id is the number of the range, shifted, and the place in it.
    placed = stash(dealt.withColumn("place", F.monotonically_increasing_id()), "ranked").withColumn("part", F.shiftright("place", 33))
    before, skip = 0, {}
    for row in sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each range
        skip[row["part"]], before = before, before + row["n"]
    drawn = percent * before // 100
    pairs = [F.lit(x).cast("long") for pair in (skip or {0: 0}).items() for x in pair]
    rank = F.try_element_at(F.create_map(*pairs), F.col("part")) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    nothing = F.lit(None).cast("long")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranks = placed.select(*columns, F.when(rank <= drawn, rank).otherwise(nothing).alias("rank"))
    return ranks.unionByName(rows.where(~may | F.col("score").isNull()).select(*columns, nothing.alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document with its weight towards the texts of ``target``, its score, and its rank if it is among the ``percent`` drawn."""
    return ranked(scored(docs, gains(docs, target, longest, buckets), longest, seed), percent, least_words)


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose ids resample() draws."""
    picked = resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(picked, F.col("doc_id").cast("long") == F.col("_drawn"), "left_semi")
