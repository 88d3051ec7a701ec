"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of SHINGLE-word shingles, and two are linked when their
Jaccard similarity is at least THRESHOLD.

1. Documents with the same word sequence are one text; links are found between
   different texts and every copy gets them (copies also link to each other).
   Grouping combines before the shuffle, so a huge group of copies is harmless.
2. Each text gets BANDS * ROWS MinHash values. Texts that agree on all values of
   a band meet in a bucket; a pair at the threshold is missed with probability
   (1 - THRESHOLD**ROWS)**BANDS, one in 300 000 here, and pairs above it far less.
3. In a bucket, signatures are compared a few values at a time. After each step
   a pair is dropped when the posterior probability that its similarity reaches
   the threshold, given the matches so far and a uniform prior, is below
   TOLERANCE. What survives is kept as a spanning forest, never as all pairs,
   and its connected components are the clusters to verify.
4. In a cluster, each pair meets exactly once. It passes the same pruning again,
   and the rest is verified exactly on the shingle sets. A task counts each
   text's links and gives a spanning forest of the links that it saw.
5. Components of the verified links are the classes; a class is named by the
   smallest doc_id in it.

Buckets and clusters are split into blocks of about BLOCK texts and BLOCK_WORDS
words, and every pair of blocks is a group of its own, so no task ever holds more
than two blocks. Copies of a text that is in a great part of all rows are joined
to their class by broadcast.

Defined cases: a text of one to four words is one shingle, its whole word
sequence. Texts without words link to nothing, not even each other. Very long
texts are read whole, in segments. A similarity of exactly THRESHOLD (a tie) is a
link; of equal ids the text with the smaller hash names a class. A row with a
null ``doc_id`` takes part and comes back with a null id; a class of such rows
only is named by a negative number. Repeated rows are copies of each other. Rows
of one doc_id with different texts are judged one by one. An empty table gives no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomespark.llm.common import cut, free_name, join_counted, row_key, stash
from tomespark.llm.components import components
from tomespark.llm.hashing import mix, sequence_hashes, windows_of, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
#: A pair goes when its posterior chance of reaching the threshold is lower.
TOLERANCE = 1e-6
#: MinHash values compared between two looks at the posterior.
STEP = 16
BLOCK = 1024
BLOCK_WORDS = 1 << 20
_TILE = 512
#: Groups up to this size are compared pair by pair, many groups at a time.
_FEW = 24

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_ODD, _SHIFT = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def _raw(text: pa.Scalar) -> bytes:
    buffer = text.as_buffer() if text.is_valid else None
    return buffer.to_pybytes() if buffer is not None else b""


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included."""
    return windows_of(words, min(size, max(len(words), 1)))


def signature(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """MinHash values of 16 bits; the ``rows`` values of a band make one of ``bands`` 64-bit numbers."""
    n = bands * rows
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(shingles), 1024):
        x = shingles[part : part + 1024]
        np.minimum(low, (x[None, :] * _ODD[:n, None] + _SHIFT[:n, None]).min(axis=1), out=low)
    # The low bits of a minimum are not uniform by themselves: scramble before cutting down.
    return (mix(low) >> np.uint64(48)).astype(np.uint16).view(np.uint64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of the word sequence, its length and its signature."""
    for batch in batches:
        one, two, n_words, sigs = [], [], [], []
        for text in batch.column("text"):
            words = word_hashes(_raw(text))
            n = len(words)
            n_words.append(n)
            if not n:
                one.append(0), two.append(0), sigs.append(b"")
                continue
            high, low = sequence_hashes(words)
            one.append(high), two.append(low)
            sigs.append(signature(shingle_hashes(words)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(n_words, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "row_key", "one", "two", "n_words", "sig"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, bucket, text) for every band of every text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.int64)
        ids = np.repeat(np.asarray(batch.column("node")), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(sigs), pa.array(ids)], ["band", "bucket", "node"])


def least_matches(seen: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among ``seen`` values that leave a pair a posterior chance of at least ``tolerance``.

    With a uniform prior the similarity has a Beta(m + 1, seen - m + 1)
    posterior, whose upper tail is a binomial sum: P(S >= t) = P(Bin(seen + 1, t) <= m).
    """
    below = 0.0
    for m in range(seen + 1):
        below += math.comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if below >= tolerance:
            return m
    return seen + 1


def surviving(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For all pairs of signatures (rows of 16-bit values), whether the pair outlives every look."""
    n = a.shape[1]
    matches = np.zeros((len(a), len(b)), np.int16)
    alive = np.ones((len(a), len(b)), bool)
    for start in range(0, n, STEP):
        end = min(start + STEP, n)
        need = least_matches(end, threshold, tolerance)
        share = alive.mean()
        if share == 0:
            break
        if share < 0.1:  # few are left: compare those alone
            i, j = np.nonzero(alive)
            matches[i, j] += (a[i, start:end] == b[j, start:end]).sum(axis=1, dtype=np.int16)
            alive[i, j] = matches[i, j] >= need
        else:
            for k in range(start, end):
                matches += a[:, k, None] == b[None, :, k]
            alive &= matches >= need
    return alive


class Forest:
    """Union-find over numbers; ``edges`` is a spanning forest of the pairs joined so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (over := up.get(top, top)) != top:
            top = over
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))

    def join_matrix(self, linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """Join the pairs of a matrix, one pair for each two trees that it connects."""
        i, j = np.nonzero(linked)
        if not len(i):
            return
        roots_r = np.array([self.root(x) for x in rows.tolist()])[i]
        roots_c = np.array([self.root(x) for x in cols.tolist()])[j]
        apart = np.flatnonzero(roots_r != roots_c)
        seen: set[tuple[int, int]] = set()
        for k, a, b in zip(apart.tolist(), roots_r[apart].tolist(), roots_c[apart].tolist()):
            if (a, b) not in seen:
                seen.add((a, b))
                self.join(int(rows[i[k]]), int(cols[j[k]]))

    def one_tree(self, nodes: np.ndarray) -> bool:
        listed = nodes.tolist()
        first = self.root(listed[0])
        return all(self.root(x) == first for x in listed)


def _tiles(blocks: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Tiles of the pairs that meet in a group: all pairs of its one block, or those between its two."""
    n = len(blocks)
    edge = int(np.searchsorted(blocks, blocks[0], "right"))
    left, right = (range(n), range(n)) if edge == n else (range(edge), range(edge, n))
    for i in range(left.start, left.stop, _TILE):
        for j in range(right.start, right.stop, _TILE):
            if edge < n or j >= i:
                yield slice(i, min(i + _TILE, left.stop)), slice(j, min(j + _TILE, right.stop))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a partition sorted by ``keys``: a table and where its groups begin, the end included.

    Of a pair of blocks one may be empty; such groups hold no pair and are cut to nothing by ``_lone``.
    """
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in keys:
            v = table.column(key).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        at = starts(table)
        if len(at) > 1:  # the last group may go on in the next batch
            yield table.slice(0, at[-1]), at
            held = table.slice(at[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(starts(table), table.num_rows)


def _lone(table: pa.Table, at: np.ndarray) -> np.ndarray:
    """Which groups are a pair of two blocks of which one is empty."""
    bi, bj, block = (table.column(c).to_numpy() for c in ("bi", "bj", "block"))
    return (bi[at[:-1]] != bj[at[:-1]]) & (block[at[:-1]] == block[at[1:] - 1])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Signatures as rows of 16-bit values."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _pairs_of(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions within each of many small groups."""
    left, right = [], []
    for n in np.unique(size):
        i, j = np.triu_indices(n, 1)
        at = begin[size == n][:, None]
        left.append((at + i).ravel()), right.append((at + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _candidates(threshold: float):
    """A spanning forest of the pairs in a partition's buckets that outlive the pruning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table, at in _groups(batches, ["band", "bucket", "bi", "bj"]):
            sigs, nodes, blocks = _matrix(table.column("sig")), table.column("node").to_numpy(), table.column("block").to_numpy()
            size = np.where(_lone(table, at), 0, np.diff(at))
            few = (size <= _FEW) & (size > 1)
            one_block = blocks[at[:-1]] == blocks[at[1:] - 1]
            if (few & one_block).any():
                i, j = _pairs_of(at[:-1][few & one_block], size[few & one_block])
                for part in range(0, len(i), 200_000):
                    a, b = i[part : part + 200_000], j[part : part + 200_000]
                    ok = surviving_pairs(sigs, a, b, threshold)
                    for x, y in zip(nodes[a[ok]].tolist(), nodes[b[ok]].tolist()):
                        forest.join(x, y)
            for g in np.flatnonzero(~(few & one_block) & (size > 1)):
                own = slice(at[g], at[g + 1])
                for r, c in _tiles(blocks[own]):
                    rows, cols = nodes[own][r], nodes[own][c]
                    if forest.one_tree(np.concatenate((rows, cols))):
                        continue
                    alive = surviving(sigs[own][r], sigs[own][c], threshold)
                    forest.join_matrix(np.triu(alive, 1) if r == c else alive, rows, cols)
        pairs = np.array(forest.edges, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def surviving_pairs(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Positions in the pair list (``a``, ``b``) of the pairs that outlive every look."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int16)
    for start in range(0, sigs.shape[1], STEP):
        end = min(start + STEP, sigs.shape[1])
        matches += (sigs[a[left], start:end] == sigs[b[left], start:end]).sum(axis=1, dtype=np.int16)
        stay = matches >= least_matches(end, threshold, tolerance)
        left, matches = left[stay], matches[stay]
    return left


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, through products of 0-1 matrices in slices of columns."""
    out = np.zeros((len(a), len(b)), np.float64)
    allowed = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    if not len(allowed):
        return out
    spots = []
    for sets in (a, b):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(allowed, values), len(allowed) - 1)
        ok = allowed[at] == values
        spots.append((owner[ok], at[ok]))
    for start in range(0, len(allowed), 2048):
        wide = min(2048, len(allowed) - start)
        halves = []
        for (owner, at), n in zip(spots, (len(a), len(b))):
            m = np.zeros((n, wide), np.float32)
            inside = (at >= start) & (at < start + wide)
            m[owner[inside], at[inside] - start] = 1
            halves.append(m)
        out += halves[0] @ halves[1].T
    return out


def _verified(threshold: float):
    """Links of each text of a partition's clusters, and a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _groups(batches, ["cluster", "bi", "bj"]):
            forest = Forest()
            told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            all_nodes = table.column("node").to_numpy()
            all_copies, all_blocks = table.column("copies").to_numpy(), table.column("block").to_numpy()
            all_sigs = _matrix(table.column("sig"))
            for begin, end, lone in zip(at[:-1].tolist(), at[1:].tolist(), _lone(table, at).tolist()):
                if lone:
                    continue
                # A row that the table repeats comes more than once under the same node.
                keep = begin + np.flatnonzero(np.append(True, np.diff(all_nodes[begin:end]) != 0))
                nodes, copies, sigs = all_nodes[keep], all_copies[keep], all_sigs[keep]
                if len(keep) < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").take(pa.array(keep)).to_pylist()]
                sizes = np.array([len(x) for x in sets])
                links, texts = np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64)
                for r, c in _tiles(all_blocks[keep]):
                    alive = surviving(sigs[r], sigs[c], threshold)
                    if r == c:
                        alive = np.triu(alive, 1)
                    rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                    if not len(rows):
                        continue
                    both = _common([sets[r.start + i] for i in rows], [sets[c.start + j] for j in cols])
                    whole = sizes[r][rows][:, None] + sizes[c][cols][None, :] - both
                    ok = np.zeros(alive.shape, bool)
                    ok[np.ix_(rows, cols)] = both >= threshold * whole - 1e-6  # ties at the threshold count
                    ok &= alive
                    links[r] += ok @ copies[c]
                    texts[r] += ok.sum(axis=1)
                    links[c] += copies[r] @ ok
                    texts[c] += ok.sum(axis=0)
                    forest.join_matrix(ok, nodes[r], nodes[c])
                some = np.flatnonzero(texts)
                told.append((nodes[some], links[some], texts[some]))
            pairs = np.array(forest.edges, np.int64).reshape(-1, 2)
            nothing = np.zeros(len(pairs), np.int64)
            nodes, links, texts = (np.concatenate(x) for x in zip(*told)) if told else (nothing[:0],) * 3
            cols = np.concatenate((nodes, pairs[:, 0])), np.concatenate((nodes, pairs[:, 1])), np.concatenate((links, nothing)), np.concatenate((texts, nothing))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["a", "b", "links", "texts"])

    return run


def _blocked(members: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Members of groups of ``size`` texts and ``words`` words, dealt over blocks and repeated for each pair of blocks (``bi`` <= ``bj``).

    Each pair of blocks comes together in one partition, sorted by group, block and node.
    """
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    dealt = members.withColumn("_n", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    paired = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rest = [c for c in members.columns if c not in (*keys, "size", "words")]
    out = paired.select(*keys, F.least("block", "_o").alias("bi"), F.greatest("block", "_o").alias("bj"), "block", *rest)
    return out.repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj", "block", "node")


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(word_hashes(_raw(x)))).tobytes() for x in batch.column("text")]
        names = ["node", "cluster", "size", "words", "copies", "sig"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])


def link(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links (linked documents, copies included) and n_texts (linked different texts), a row per row."""
    return _linked(docs, threshold, block).drop("row_key", "stays")


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each class, once; texts without words stay."""
    rest = _linked(docs, threshold, block).where("NOT stays").select("row_key").distinct()
    key = free_name(docs, "key")
    gone = free_name(docs.withColumn(key, F.lit(None)), "gone")
    once = docs.withColumn(key, row_key("doc_id", "text")).join(rest.toDF(gone), F.col(key) == F.col(gone), "left_anti")
    return once.dropDuplicates([key]).drop(key)


def _linked(docs: DataFrame, threshold: float, block: int) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row_key"), F.col("text").cast("string").alias("text"))
    signed = stash(named.mapInArrow(_signed, "doc_id long, row_key struct<a:long,b:long>, one long, two long, n_words long, sig binary"), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    texts = signed.where("n_words > 0").groupBy("one", "two", "n_words").agg(first, F.count("*").alias("copies"), F.first("sig").alias("sig"))
    # A text is known by its smallest doc_id; without one, or if another text has it too, by a negative number.
    rank = F.row_number().over(Window.partitionBy("first.doc_id", F.when(F.col("first.none"), F.col("one"))).orderBy("one", "two"))
    own = F.when((rank == 1) & ~F.col("first.none"), F.col("first.doc_id")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("one", "two"), 1))
    texts = stash(texts.select("one", "two", "n_words", F.col("first.doc_id").alias("first_id"), F.col("first.row_key").alias("row_key"), own.alias("node"), "copies", "sig"), "texts")

    buckets = texts.select("node", "sig").mapInArrow(_banded, "band int, bucket long, node long")
    shared = stash(buckets.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met = join_counted(buckets, shared.withColumn("n_rows", F.col("size")), ["band", "bucket"]).withColumn("words", F.lit(0)).join(texts.select("node", "sig"), "node")
    candidates = stash(_blocked(met, ["band", "bucket"], block).mapInArrow(_candidates(threshold), "a long, b long"), "candidates")

    clusters = components(candidates)
    held = clusters.join(texts.select("node", "row_key", "copies", "n_words", "sig"), "node").withColumnRenamed("class", "cluster")
    held = stash(held, "members")
    sizes = cut(held.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n_words").alias("words")).withColumn("n_rows", F.col("size")))
    members = join_counted(held, sizes, ["cluster"])
    whole = named.select("row_key", "text").join(members, "row_key")
    sets = whole.select("node", "cluster", "size", "words", "copies", "sig", "text").mapInArrow(_with_sets, "node long, cluster long, size long, words long, copies long, sig binary, shingles binary")
    found = stash(_blocked(sets, ["cluster"], block).mapInArrow(_verified(threshold), "a long, b long, links long, texts long"), "links")

    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"), F.sum("texts").alias("n_texts"))
    labels = components(found.where("a <> b").select("a", "b"))
    labelled = texts.select("one", "two", "n_words", "node", "first_id", "row_key", "copies").join(counts, "node", "left").join(labels, "node", "left")
    labelled = labelled.withColumn("class", F.coalesce("class", "node"))
    head = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node", F.col("row_key").alias("key"))).alias("head")
    names = labelled.groupBy("class").agg(head)
    named_texts = labelled.join(names, "class").select("one", "two", "n_words", F.coalesce("head.first_id", "class").alias("class_id"), F.col("head.key").alias("head_key"), "copies", "links", "n_texts")
    known = stash(named_texts, "classes")
    keys = ["one", "two", "n_words"]
    rows = signed.select("doc_id", "row_key", *keys)
    out = join_counted(rows.where("n_words > 0"), known.withColumn("n_rows", F.col("copies")), keys)
    nothing = F.lit(None).cast("long")
    bare = rows.where("n_words = 0").select(*(F.col(c) if c in rows.columns else (F.col("row_key") if c == "head_key" else nothing).alias(c) for c in out.columns))
    zero = F.lit(0).cast("long")
    return out.unionByName(bare).select(
        "row_key",
        (F.col("row_key") == F.col("head_key")).alias("stays"),
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("links", zero) + F.coalesce(F.col("copies") - 1, zero)).alias("n_links"),
        F.coalesce("n_texts", zero).alias("n_texts"),
    )
