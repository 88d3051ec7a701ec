"""Best-fit packing into sequences of several permitted lengths.

Documents are encoded to token lengths; those longer than the largest capacity
are cut into pieces of that capacity and a rest. Pieces are dealt by a hash into
shards of about SHARD_PIECES, so that no copies or lengths pile up in a task,
and each shard is packed on its own: longest piece first, into the open bin with
the least room that holds it. When none does, a bin is opened. For each
permitted capacity the bin is filled on trial, again and again with the longest
piece left that fits; the fill is costed at the capacity to which it would be
downsized, and the capacity with the least cost a token is opened with its fill.
So all capacities compete for the same pieces, bin by bin. Since a large bin
also ties up short pieces that later ones could use, the shard is packed with
several RELUCTANCES to step to a larger capacity, and the cheapest plan stays.

A closing pass takes ever fewer of the bins that cost most a token, packs their
pieces anew in the same way, and keeps what is cheaper. Last, every bin shrinks
to the smallest capacity that holds its contents. A bin of capacity c costs
c + c * c / QUADRATIC, the linear and the attention part of a training step.

Packing shards apart costs at most a few part-filled bins a shard.

Defined cases: a null or empty text has no tokens: one row with 0 tokens and no
bin. Very long texts are encoded whole and become many pieces. A null ``doc_id``
is kept. Repeated rows are packed each: rows with equal id and length are
numbered before they are dealt, so any number of them spreads over all shards.
Ties between bins go to the bin opened first, between capacities to the smaller
one, between pieces to the smaller id. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomespark.llm import tokens
from tomespark.llm.common import stash
from tomespark.llm.token_counts import with_lengths

CAPACITIES = (1024, 2048, 4096, 8192)
SHARD_PIECES = 4096
#: Rows of one id and length are numbered in stretches of so many.
COPIES = 65536
#: Steps to a larger capacity must gain so much a token; the cheapest of the plans stays.
RELUCTANCES = (0.0, 0.02, 0.08)
QUADRATIC = 32768
OUT = "doc_id long, piece long, start long, n_tokens long, bin_id long, capacity long, offset long"


def cost(capacity: int | np.ndarray) -> float | np.ndarray:
    return capacity + capacity * capacity / QUADRATIC


def fitted(contents: np.ndarray, capacities: tuple[int, ...]) -> np.ndarray:
    """The smallest capacity that holds each bin."""
    sizes = np.array(sorted(capacities))
    return sizes[np.searchsorted(sizes, contents)]


def _filled(shorter: list[int], room: int) -> tuple[list[int], int]:
    """Places in a rising list of the pieces that fill ``room``, longest first, and the room left."""
    took, end = [], len(shorter)
    while room and (end := bisect_right(shorter, room, 0, end)):
        end -= 1
        took.append(end)
        room -= shorter[end]
    return took, room


def best_fit(lengths: list[int], capacities: tuple[int, ...], reluctance: float = 0.0) -> list[int]:
    """The bin of each length of a descending list. ``reluctance``: the gain a token that each step to a larger capacity must bring."""
    sizes = sorted(capacities)
    left, names = lengths[::-1], list(range(len(lengths) - 1, -1, -1))
    open_bins: list[tuple[int, int]] = []
    bins, made = [0] * len(lengths), 0
    while left:
        length, name = left.pop(), names.pop()
        at = bisect_left(open_bins, (length, -1))
        if at < len(open_bins):
            room, which = open_bins.pop(at)
            room -= length
        else:
            best = None
            for step, size in enumerate(sizes[bisect_left(sizes, length) :]):
                took, room = _filled(left, size - length)
                fill = size - room
                down = sizes[bisect_left(sizes, fill)]
                rate = cost(down) / fill * (1 + reluctance) ** step
                if best is None or rate < best[0]:
                    best = rate, took, down - fill
            _, took, room = best
            which, made = made, made + 1
            for k in took:
                bins[names.pop(k)] = which
                del left[k]
        bins[name] = which
        if room:
            insort(open_bins, (room, which))
    return bins


def plan(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece of a descending list, and the capacity of each bin."""
    worth = np.array(lengths, np.int64)
    first = (_costed(np.array(best_fit(lengths, capacities, r), np.int64), worth, capacities) for r in RELUCTANCES)
    bins, sizes, price = min(first, key=lambda x: x[2].sum())
    again = len(price)
    while again >= 2:
        poor = np.argsort(-price / np.bincount(bins, weights=worth), kind="stable")[:again]
        taken = np.isin(bins, poor)
        for r in RELUCTANCES:
            anew = bins.copy()
            anew[taken] = len(price) + np.array(best_fit(worth[taken].tolist(), capacities, r))
            found = _costed(anew, worth, capacities)
            if found[2].sum() < price.sum() - 1e-6:
                bins, sizes, price = found
                again = min(again, len(price))
                break
        else:
            again = again * 3 // 4
    return bins, sizes


def _costed(bins: np.ndarray, lengths: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins numbered without gaps, their capacities and costs."""
    bins = np.unique(bins, return_inverse=True)[1]
    sizes = fitted(np.bincount(bins, weights=lengths).astype(np.int64), capacities)
    return bins, sizes, cost(sizes)


def _pack(capacities: tuple[int, ...]):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = shard.column("n_tokens").to_numpy()
        bins, sizes = plan(lengths.tolist(), capacities)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate(([True], np.diff(bins[order]) != 0))
        offset = np.empty_like(lengths)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        number = (shard.column("shard")[0].as_py() << 32) + bins
        cols = [shard.column(c) for c in ("doc_id", "piece", "start", "n_tokens")]
        return pa.table([*cols, pa.array(number), pa.array(sizes[bins]), pa.array(offset)], names=["doc_id", "piece", "start", "n_tokens", "bin_id", "capacity", "offset"])

    return run


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, vocabulary: str = tokens.VOCABULARY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row per piece: doc_id, piece, start, n_tokens, bin_id, capacity, and the piece's offset in its bin."""
    largest = max(capacities)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lengths = stash(with_lengths(named, ["doc_id"], vocabulary), "lengths")
    count = F.greatest(F.ceil(F.col("n_tokens") / largest), F.lit(1))
    pieces = lengths.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    start = F.col("piece") * largest
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(largest)).cast("long").alias("n_tokens"))
    full = pieces.where("n_tokens > 0").groupBy("doc_id", "piece", "start", "n_tokens").agg(F.count("*").alias("rows"))
    full = stash(full, "pieces")
    n_shards = max(1, -(-(full.agg(F.sum("rows")).first()[0] or 0) // shard_pieces))
    key = ["doc_id", "piece", "start", "n_tokens"]
    few = full.where(F.col("rows") <= COPIES).select(*key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"))
    stretches = full.where(F.col("rows") > COPIES).select(*key, "rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(COPIES).cast("long"))).alias("from"))
    many = stretches.repartition(*key, "from").select(*key, F.explode(F.sequence(F.col("from"), F.least(F.col("rows"), F.col("from") + COPIES - 1))).alias("copy"))
    numbered = few.unionByName(many)
    full = numbered.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "copy"), F.lit(n_shards)).cast("long")).drop("copy")
    packed = full.groupBy("shard").applyInArrow(_pack(tuple(capacities)), OUT)
    nothing = F.lit(None).cast("long")
    empty = pieces.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", nothing.alias("bin_id"), nothing.alias("capacity"), nothing.alias("offset"))
    return packed.unionByName(empty)
