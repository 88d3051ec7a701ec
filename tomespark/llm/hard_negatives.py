"""Hard negatives by a pivot table: rows of other labels that score nearly as high as an anchor's own.

Scores are integer inner products. Every vector gets one more component that
brings all to the largest norm, and every anchor a zero; then the score falls as
the Euclidean distance grows, and the triangle inequality holds. The distances
of every row to a few pivots are stored with it. For an anchor a, a row x and any
pivot p, |d(a,p) - d(x,p)| <= d(a,x) <= d(a,p) + d(x,p), which brackets the score
from both sides. Only rows whose bracket reaches what is asked for are multiplied
out, in integers.

Rows are dealt into groups by their nearest pivot and a hash, at most GROUP_ROWS
or so in each, however many lie near one pivot; anchors into groups of
ANCHOR_ROWS. A group of rows meets a group of anchors in one task, which cuts the
rows into blocks by their distance and leaves out whole blocks by their bracket.
A task sends an anchor's best few, and those of all tasks are ranked together.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component, take no part; nor do rows so long that a score might not
fit in 64 bits (the sum of (|256 x| + 1)^2 reaches 2^63). Shorter vectors are
filled up with zeros. Of rows with one id the least by label and vector counts,
once. Ties go to the smaller id. Labels may be few, many or all equal; an empty
table gives no rows. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomespark.llm.common import stash

#: Pivots, and the rows with the smallest hash of their id that they are chosen from.
PIVOTS, SAMPLE = 8, 512
GROUP_ROWS, ANCHOR_ROWS = 16_384, 4096
#: Rows and anchors that are bracketed at once.
BLOCK, CHUNK = 2048, 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256.0

_NONE = np.empty(0, np.int64)


def prepared(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with whole numbers for components."""
    x = F.transform(F.col("embedding"), lambda c: F.lit(SCALE) * c.cast("double"))
    held = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label").cast("long") if label is None else label).alias("label"), x.alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + (F.abs(c) + 1) * (F.abs(c) + 1))
    whole = held.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(finite).where(norm < float(2**63))
    return whole.select("vec_id", "label", F.transform("x", lambda c: F.floor(c).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of equal width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else _NONE
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), flat.dtype if len(flat) else np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


class Pivots:
    """A few rows, far from each other, and the distances to them in the augmented space."""

    def __init__(self, vectors: np.ndarray, radius2: float, count: int = PIVOTS) -> None:
        self.radius2 = radius2
        self.width = vectors.shape[1]
        full = np.column_stack([vectors, self._more(vectors)])
        picked = full[:1]
        gap = np.full(len(full), np.inf)
        while len(picked) < min(count, len(full)):
            gap = np.minimum(gap, ((full - picked[-1]) ** 2).sum(axis=1))
            picked = np.vstack([picked, full[gap.argmax()]])
        self.points = picked

    def _more(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.radius2 - (vectors * vectors).sum(axis=1), 0.0))

    def distances(self, vectors: np.ndarray, anchors: bool = False) -> np.ndarray:
        """To every pivot, of rows or of anchors, whose further component is zero."""
        vectors = vectors.astype(np.float64)
        more = np.zeros(len(vectors)) if anchors else self._more(vectors)
        return np.column_stack([np.sqrt(((vectors - p[:-1]) ** 2).sum(axis=1) + (more - p[-1]) ** 2) for p in self.points])


def chosen_pivots(rows: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> Pivots | None:
    """Pivots from a sample of ``sample`` rows; None for an empty table. The widths and norms of all rows are read."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    width, radius2 = rows.agg(F.max(F.size("v")), F.max(square)).first()
    if width is None:
        return None
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    vectors = np.zeros((len(few), width))
    for i, row in enumerate(few):
        vectors[i, : len(row["v"])] = row["v"]
    return Pivots(vectors, radius2, count)


def pivot_table(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """(vec_id, label, v, d, cell): distances to all pivots, and the nearest one. One row per vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pivots.distances(_matrix(batch.column("v"), pivots.width))
            offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(d.ravel())), pa.array(d.argmin(axis=1))], names=["vec_id", "label", "v", "d", "cell"])

    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    return one.mapInArrow(run, "vec_id long, label long, v array<long>, d array<double>, cell long")


def _best(scores: np.ndarray, ids: np.ndarray, k: int, nothing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, id, score) of at least the k best of every line, ties at the end included."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), nothing)
    line, at = np.nonzero((scores >= least[:, None]) & (scores > nothing))
    return line, ids[at], scores[line, at]


class _Kept:
    """The best ``k`` of every line so far."""

    def __init__(self, lines: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least  # a score below ``least`` of its line is of no use
        self.line, self.ids, self.scores = _NONE, _NONE, least[:0]
        self.lines = lines

    def add(self, line: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(line):
            return
        line, ids, scores = (np.concatenate(x) for x in ((self.line, line), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, line))
        line, ids, scores = line[order], ids[order], scores[order]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        keep = place < self.k
        self.line, self.ids, self.scores, place = line[keep], ids[keep], scores[keep], place[keep]
        full = place == self.k - 1
        self.least = self.least.copy()
        self.least[self.line[full]] = self.scores[full]


class _Side:
    """Rows or anchors of one task."""

    def __init__(self, part: pa.Table, pivots: Pivots, exact: type) -> None:
        self.ids, self.labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
        self.v = _matrix(part.column("v"), pivots.width).astype(exact)

    def take(self, at: np.ndarray) -> _Side:
        out = object.__new__(_Side)
        out.__dict__ = {k: x[at] for k, x in self.__dict__.items()}
        return out


def _blocks(rows: pa.Table, pivots: Pivots, exact: type) -> Iterator[_Side]:
    """Rows in blocks of like distances to their nearest pivot."""
    side = _Side(rows, pivots, exact)
    side.d = _matrix(rows.column("d"), len(pivots.points))
    order = np.argsort(side.d[:, rows.column("cell")[0].as_py()], kind="stable")
    for at in range(0, len(order), BLOCK):
        yield side.take(order[at : at + BLOCK])


def _chunks(anchors: pa.Table, pivots: Pivots, exact: type) -> Iterator[_Side]:
    """Anchors with their distances, and with what makes a score of a squared distance."""
    side = _Side(anchors, pivots, exact)
    side.d = pivots.distances(side.v, anchors=True)
    v = side.v.astype(np.float64)
    side.c = (v * v).sum(axis=1) + pivots.radius2
    side.row = np.arange(len(side.ids))
    for at in range(0, len(side.ids), CHUNK):
        yield side.take(np.arange(at, min(at + CHUNK, len(side.ids))))


def _survivors(a: _Side, x: _Side, least: np.ndarray, most: np.ndarray, slack: float) -> np.ndarray | None:
    """Which rows may score from ``least`` to ``most`` with each anchor, by the triangle inequality; None for no row at all."""
    apart = np.maximum(a.d - x.d.max(axis=0), x.d.min(axis=0) - a.d).max(axis=1)
    open_ = (a.c - np.maximum(apart, 0) ** 2) / 2 + slack >= least
    if not open_.any():
        return None
    out = np.zeros((len(a.ids), len(x.ids)), bool)
    near = np.zeros((int(open_.sum()), len(x.ids)))
    far = np.full_like(near, np.inf)
    for k in range(a.d.shape[1]):
        np.maximum(near, np.abs(a.d[open_, k, None] - x.d[None, :, k]), out=near)
        np.minimum(far, a.d[open_, k, None] + x.d[None, :, k], out=far)
    c = a.c[open_, None]
    out[open_] = ((c - near**2) / 2 + slack >= least[open_, None]) & ((c - far**2) / 2 - slack <= most[open_, None])
    return out


def _scores(a: _Side, x: _Side, may: np.ndarray, nothing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, rows, scores) of what survives; ``nothing`` where it does not."""
    lines, at = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    exact = a.v[lines] @ x.v[at].T
    return lines, at, np.where(may[np.ix_(lines, at)], exact, nothing)


def _number(pivots: Pivots) -> tuple[type, object]:
    """What scores are computed in: doubles hold them exactly below 2^53, 64-bit integers always (partial sums may wrap, sums do not)."""
    return (np.float64, -np.inf) if pivots.radius2 < 2**52 else (np.int64, np.iinfo(np.int64).min)


def _table(names: list[str], *columns: np.ndarray) -> pa.Table:
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=names)


def _positives(pivots: Pivots, k: int):
    exact, nothing = _number(pivots)
    slack = 1e-9 * pivots.radius2 + 1e-3
    names = ["anchor_id", "vec_id", "score"]

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _table(names, _NONE, _NONE, _NONE)
        out, blocks = [], list(_blocks(rows, pivots, exact))
        for a in _chunks(anchors, pivots, exact):
            kept = _Kept(len(a.ids), k, np.full(len(a.ids), nothing))
            for x in blocks:
                may = _survivors(a, x, kept.least, np.full(len(a.ids), np.inf), slack)
                if may is None:
                    continue
                may &= (a.labels[:, None] == x.labels[None, :]) & (a.ids[:, None] != x.ids[None, :])
                lines, at, scores = _scores(a, x, may, nothing)
                if len(at):
                    line, ids, found = _best(scores, x.ids[at], k, nothing)
                    kept.add(lines[line], ids, found)
            out.append(_table(names, a.ids[kept.line], kept.ids, kept.scores))
        return pa.concat_tables(out)

    return run


def _negatives(pivots: Pivots, k: int, low: int, high: int):
    exact, nothing = _number(pivots)
    slack = 1e-9 * pivots.radius2 + 1e-3
    names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [_table(names, *[_NONE] * 5)]
        if not rows.num_rows or not anchors.num_rows:
            return out[0]
        blocks, asked = list(_blocks(rows, pivots, exact)), anchors.column("positives").to_pylist()
        for a in _chunks(anchors, pivots, exact):
            owner, ids, own, least, most = [], [], [], [], []
            for i, row in enumerate(a.row.tolist()):
                for p in asked[row]:
                    a_least, a_most = -(-low * p["score"] // 100), high * p["score"] // 100
                    if a_least <= a_most:  # with a negative score nothing can lie between
                        owner.append(i), ids.append(p["vec_id"]), own.append(p["score"]), least.append(a_least), most.append(a_most)
            if not owner:
                continue
            owner, ids, own = np.array(owner), np.array(ids, np.int64), np.array(own, np.int64)
            least, most = np.array(least, exact), np.array(most, exact)
            kept = _Kept(len(owner), k, least)
            widest = np.full(len(a.ids), nothing)
            np.maximum.at(widest, owner, most)
            for x in blocks:
                lowest = np.full(len(a.ids), np.inf)
                np.minimum.at(lowest, owner, kept.least.astype(np.float64))
                may = _survivors(a, x, lowest, widest.astype(np.float64), slack)
                if may is None:
                    continue
                may &= a.labels[:, None] != x.labels[None, :]
                lines, at, scores = _scores(a, x, may, nothing)
                if not len(at):
                    continue
                where = np.full(len(a.ids), -1)
                where[lines] = np.arange(len(lines))
                slots = np.flatnonzero(where[owner] >= 0)
                windowed = scores[where[owner[slots]]]
                windowed = np.where((windowed >= kept.least[slots, None]) & (windowed <= most[slots, None]), windowed, nothing)
                line, found, score = _best(windowed, x.ids[at], k, nothing)
                kept.add(slots[line], found, score)
            out.append(_table(names, a.ids[owner[kept.line]], ids[kept.line], own[kept.line], kept.ids, kept.scores))
        return pa.concat_tables(out)

    return run


def _first(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The ``k`` best of each key, ranked; a key has at most k rows of every task."""
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame, every: int = 100, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS, group_rows: int = GROUP_ROWS, anchor_rows: int = ANCHOR_ROWS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. A negative has
    another label than the anchor and from ``low`` to ``high`` hundredths of the
    positive's score.
    """
    spark = embeddings.sparkSession
    rows = prepared(embeddings, label)
    points = chosen_pivots(rows, pivots)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if points is None:
        return spark.createDataFrame([], out)
    table = stash(pivot_table(rows, points), "pivots")
    sizes = dict(table.groupBy("cell").agg(F.count("*")).collect())  # a row for each pivot
    before, groups = 0, []
    for cell, n in sorted(sizes.items()):
        salts = -(-n // group_rows)
        groups += [F.lit(cell).cast("long"), F.struct(F.lit(before).alias("first"), F.lit(salts).alias("salts"))]
        before += salts
    is_anchor = F.col("vec_id") % every == 0
    parts = max(1, -(-table.where(is_anchor).count() // anchor_rows))
    group = F.element_at(F.create_map(*groups), F.col("cell"))
    placed = table.select("*", (group["first"] + F.pmod(F.xxhash64("vec_id"), group["salts"])).alias("g"))
    dealt = placed.select("vec_id", "label", "v", "d", "cell", "g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    part = F.pmod(F.xxhash64(F.lit("anchor"), "vec_id"), F.lit(parts)).cast("int").alias("part")

    def meet(anchors: DataFrame, work, schema: str) -> DataFrame:
        asked = anchors.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(before - 1).cast("long"))).alias("g"))
        both = dealt.withColumn("g", F.col("g").cast("long")).groupBy("g", "part").cogroup(asked.groupBy("g", "part"))
        return both.applyInArrow(work, schema)

    anchors = stash(table.where(is_anchor).select("vec_id", "label", "v", part), "anchors")
    near = meet(anchors, _positives(points, positives), "anchor_id long, vec_id long, score long")
    own = _first(near, ["anchor_id"], positives).groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    own = stash(own, "positives")
    with_own = anchors.join(own, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    hard = meet(with_own, _negatives(points, negatives, low, high), "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    ranked = _first(hard, ["anchor_id", "positive_id", "positive_score"], negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
