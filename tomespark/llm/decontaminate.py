"""Benchmark decontamination by spaced seeds.

Texts are words: runs of letters and digits, lower-cased. Each mask of MASKS
looks at some of the words that follow a position and ignores the others, so a
seed still hits when an ignored word was substituted. Seeds of the benchmark and
of the documents are hashed and joined; a hit proposes to lay an item along a
document at one offset. At every proposed offset words are compared one by one,
and the pair counts when some stretch of OVERLAP words of the item (all of a
shorter one) has at least IDENTITY of its words in place.

The masks together hit every stretch of 20 words with up to four substitutions,
and every item of SHORTEST to 19 words with as many as IDENTITY allows, wherever
those are. An item of fewer words is too short to ignore any: its mask looks at
all of it, so it must occur word for word. Documents get such masks only for the
lengths that the benchmark has.

All steps are DataFrame operations. Words are cut into chunks of CHUNK positions
before seeds are made, so a text takes time in proportion to its length.
Document seeds are made, hashed and probed in one stage; only hits leave it. The
benchmark's seeds are broadcast when counted to be at most BROADCAST_SEEDS, and
else joined by a shuffle with SALTS copies of each, as one seed may be in a third
of all texts. Hits are made distinct with map-side combination and gathered per
document and stretch of SPAN offsets; texts are joined to these once, and only
the words under each offset are cut out and compared.

Defined cases: null and empty texts and items match nothing. Very long texts are
searched whole. A null ``doc_id`` or ``item_id`` is carried as null. Repeated
rows, of documents or items, give one pair. Of several stretches of one pair the
one with the most equal words is stated, of equally good ones (a tie) the first.
An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomespark.llm.common import cut, row_key, stash, without_rows

#: Offsets of the words that a mask looks at.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 8), (0, 1, 3, 6, 7))
OVERLAP = 20
IDENTITY = 0.8
#: Items of fewer words must occur word for word.
SHORTEST = 8
BROADCAST_SEEDS = 1_000_000
SALTS = 16
CHUNK = 64
SPAN = 8192


def word_array(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(held: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """``keep``, position ``p`` and hash ``h`` of every seed of the word hashes ``w``. A mask is named by its offsets."""
    reach = max(m[-1] for m in masks)
    # A row per position carries its chunk only, never the whole text.
    chunks = F.expr(f"transform(sequence(0, size(w) - 1, {CHUNK}), s -> struct(s, slice(w, s + 1, {CHUNK + reach}) AS c))")
    cut_up = held.select(*keep, F.explode(F.when(F.size("w") > 0, chunks)).alias("k")).select(*keep, "k.s", "k.c")
    at = cut_up.select(*keep, "s", "c", F.explode(F.sequence(F.lit(0), F.least(F.size("c"), F.lit(CHUNK)) - 1)).alias("o"))
    hashes = []
    for mask in masks:
        looked = [F.get("c", F.col("o") + k) for k in mask]
        hashes.append(F.when(F.col("o") + mask[-1] < F.size("c"), F.xxhash64(F.lit(str(mask)), *looked)))
    return at.select(*keep, (F.col("s") + F.col("o")).alias("p"), F.explode(F.array(*hashes)).alias("h")).where("h IS NOT NULL")


def _joined(rows: DataFrame, few: DataFrame, key: str, small: bool) -> DataFrame:
    """Join ``few`` to ``rows``: by broadcast where it was counted to be small, else by a shuffle with salted keys."""
    if small:
        return rows.join(F.broadcast(few), key)
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(copies, [key, "salt"]).drop("salt")


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, identity: float = IDENTITY, masks: tuple[tuple[int, ...], ...] = MASKS, shortest: int = SHORTEST, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(row_key, doc_id, item_id, n_overlap, n_same, start): the best stretch of each document and item that overlap.

    ``row_key`` is the document's key over doc_id and text; ``start`` counts its words from 0.
    """
    texts = docs.select(row_key("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_array(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    # Items of the same words are laid along documents once.
    worded = cut(items.groupBy("iw").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("ids")).withColumn("item_key", row_key("iw")))
    sizes = [r[0] for r in worded.select(F.size("iw")).where(F.size("iw") < shortest).distinct().collect()]  # at most shortest - 1 numbers
    whole = [tuple(range(n)) for n in sorted(sizes)]
    long_seeds = _seeds(worded.where(F.size("iw") >= shortest).select("item_key", F.size("iw").alias("n"), F.col("iw").alias("w")), ["item_key", "n"], list(masks))
    short = worded.where(F.size("iw") < shortest).select("item_key", F.size("iw").alias("n"), F.col("iw").alias("w"))
    probes = long_seeds
    for mask in whole:
        probes = probes.unionByName(_seeds(short.where(F.col("n") == len(mask)), ["item_key", "n"], [mask]))
    probes = cut(probes.withColumnRenamed("p", "q"))
    small = probes.count() <= broadcast_seeds
    seeds = _seeds(texts.select("row_key", word_array(F.col("text")).alias("w")), ["row_key"], [*masks, *whole])
    hits = _joined(seeds, probes, "h", small)
    offsets = hits.select("row_key", "item_key", "n", (F.col("p") - F.col("q")).alias("at")).distinct()
    gathered = stash(offsets.groupBy("row_key", F.floor(F.col("at") / SPAN).alias("span")).agg(F.collect_list(F.struct("item_key", "n", "at")).alias("offsets")), "offsets")

    laid = gathered.join(texts, "row_key").select("row_key", "doc_id", "offsets", word_array(F.col("text")).alias("w"))
    # The words under an offset; an item may hang over either end.
    under = "slice(w, greatest(o.at, 0) + 1, greatest(least(o.n + least(o.at, 0), size(w) - greatest(o.at, 0)), 0))"
    pieces = F.expr(f"transform(offsets, o -> struct(o.item_key AS item_key, o.at AS at, {under} AS piece))")
    cut_out = laid.select("row_key", "doc_id", F.explode(pieces).alias("c")).select("row_key", "doc_id", "c.item_key", "c.at", "c.piece")
    compared = _joined(cut_out, worded.select("item_key", "iw"), "item_key", small)
    same = F.expr("transform(iw, (x, i) -> IF(i + least(at, 0) >= 0 AND i + least(at, 0) < size(piece), IF(piece[greatest(i + least(at, 0), 0)] = x, 1, 0), 0))")
    compared = compared.select("row_key", "doc_id", "item_key", "at", F.least(F.size("iw"), F.lit(overlap)).alias("n_overlap"), same.alias("e"))
    # The least number of equal words in a stretch is whole; a short item's is all of it.
    needed = F.when(F.col("t.n_overlap") < shortest, F.col("t.n_overlap").cast("double")).otherwise(identity * F.col("t.n_overlap") - 1e-9)
    stretch = "transform(sequence(0, size(e) - n_overlap), s -> struct(aggregate(slice(e, s + 1, n_overlap), 0, (a, b) -> a + b) AS n_same, -s AS back))"
    best = compared.select("row_key", "doc_id", "item_key", "at", "n_overlap", F.array_max(F.expr(stretch)).alias("b"))
    top = F.max(F.struct(F.col("b.n_same").alias("n_same"), "n_overlap", (F.col("b.back") - F.col("at")).alias("back"))).alias("t")
    # The test follows the aggregation: before it, it would be moved into the join with all that it is computed from.
    found = best.groupBy("row_key", "doc_id", "item_key").agg(top).where(F.col("t.n_same") >= needed)
    named = _joined(found, worded.select("item_key", "ids"), "item_key", small).select("row_key", "doc_id", "t", F.explode("ids").alias("id"))
    return named.select("row_key", "doc_id", F.nullif("id", F.lit("")).cast("long").alias("item_id"), F.col("t.n_overlap").cast("long").alias("n_overlap"), F.col("t.n_same").cast("long").alias("n_same"), (-F.col("t.back")).cast("long").alias("start"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no stretch of an item."""
    return without_rows(docs, leaks(docs, benchmark).select("row_key").distinct(), "doc_id", "text")
