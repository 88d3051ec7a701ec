"""Token counts: the exact histogram of document lengths, with its suffix sums.

Documents are encoded where they lie; only their lengths move on. Spark counts
documents per length (combined before the shuffle). Suffix sums run in two
steps, so that no task sees all lengths: lengths fall into blocks, block totals
(at most the longest length over BLOCK of them) are summed from the end, and the
lengths of one block are summed within it.

With the sums of a length L, any context limit is answered exactly. For a limit
C take the row of the smallest length >= C: ``docs_from`` documents are at least
that long, ``tokens_from`` is what they hold, and all documents together keep
``total_tokens - tokens_from + C * docs_from`` tokens when cut at C.

Defined cases: a null or empty text has no tokens and counts as length 0.
Repeated rows count repeatedly; an empty table gives no rows. Only ``text`` is
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomespark.llm import tokens
from tomespark.llm.common import cut

BLOCK = 1024


def with_lengths(docs: DataFrame, keep: list[str], vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """The columns ``keep`` of ``docs`` and n_tokens, the encoded length of ``text``."""
    held = docs.select(*(c for c in keep if c != "text"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = tokens.count_batch(batch.column("text"), vocabulary)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lengths], [*keep, "n_tokens"])

    types = dict(held.dtypes)
    return held.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_tokens long"]))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """From (n_tokens, n_docs) the sums over all documents of at least each length."""
    placed = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / block).alias("_b"))
    held = F.col("n_tokens") * F.col("n_docs")
    # One row for each block of lengths: their number is the longest length over the block size.
    totals = placed.groupBy("_b").agg(F.sum("n_docs").alias("_docs"), F.sum(held).alias("_tokens"))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nothing = F.lit(0).cast("long")
    later = totals.select(
        "_b",
        F.coalesce(F.sum("_docs").over(after), nothing).alias("_docs_after"),
        F.coalesce(F.sum("_tokens").over(after), nothing).alias("_tokens_after"),
        F.sum("_docs").over(whole).alias("total_docs"),
        F.sum("_tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(later, "_b").select(
        "n_tokens",
        "n_docs",
        (F.col("_docs_after") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("_tokens_after") + F.sum(held).over(inside)).alias("tokens_from"),
        "total_docs",
        "total_tokens",
    )


def length_table(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, block: int = BLOCK) -> DataFrame:
    """One row per encoded length, with its suffix sums, share of documents up to it and truncated total."""
    # Both the blocks' totals and the sums within them read the histogram: kept, so that texts are encoded once.
    histogram = cut(with_lengths(docs, [], vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    sums = suffix_sums(histogram, block)
    longer = F.col("docs_from") - F.col("n_docs")
    return sums.withColumns(
        {
            "docs_up_to": F.col("total_docs") - longer,
            "quantile": (F.col("total_docs") - longer) / F.col("total_docs"),
            "docs_truncated": longer,
            "tokens_kept": F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from"),
        }
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For every context limit: documents cut, tokens kept and tokens lost, exactly. ``limits`` are few and the caller's own."""
    ask = lambda c, f: [f(F.when(F.col("n_tokens") >= limit, F.col(c))).alias(f"{c}_{k}") for k, limit in enumerate(limits)]
    longer = [F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)).alias(f"cut_{k}") for k, limit in enumerate(limits)]
    one = sums.agg(F.first("total_docs").alias("total_docs"), F.first("total_tokens").alias("total_tokens"), *ask("docs_from", F.max), *ask("tokens_from", F.max), *longer)

    def answer(k: int, limit: int) -> Column:
        kept = F.col("total_tokens") - F.coalesce(F.col(f"tokens_from_{k}"), F.lit(0)) + limit * F.coalesce(F.col(f"docs_from_{k}"), F.lit(0))
        return F.struct(F.lit(limit).cast("long").alias("limit"), F.col(f"cut_{k}").alias("docs_truncated"), kept.alias("tokens_kept"), (F.col("total_tokens") - kept).alias("tokens_lost"))

    return one.where("total_docs IS NOT NULL").select(F.inline(F.array(*(answer(k, c) for k, c in enumerate(limits)))))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of documents does not exceed, exactly."""
    up_to = F.col("total_docs") - F.col("docs_from") + F.col("n_docs")
    one = sums.agg(*(F.min(F.when(up_to >= F.ceil(F.col("total_docs") * share), F.col("n_tokens"))).alias(f"q{k}") for k, share in enumerate(shares)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(share).alias("share"), F.col(f"q{k}").alias("n_tokens")) for k, share in enumerate(shares)))))
