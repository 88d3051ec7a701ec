"""Bodies of posts as blocks: paragraphs, passages that keep their lines, folded quotes, and the signature.

A body is a column of line rows, and what a line belongs to is told by windows
over its own post: the signature begins at the last mark in the last lines; quoted
lines, with single blank ones between them, make a quote; other lines make a
passage up to the next blank or quote. A passage of short lines, of indented ones,
or with columns of blanks, keeps its lines; others are set as one paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How far from the end a signature may begin, and what makes a passage keep its lines.
SIGNATURE_LINES, SHORT_LINE, LEAST_SHORT = 12, 50, 3
_COLUMNS = r"\S {3,}\S"
_BLANKS = " \t\r\n\x0b\x0c"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def lines_of(posts: DataFrame) -> DataFrame:
    """(target, n, line, part): the lines of posts (target, body), each in the text (0), or the signature (1); the mark itself is left out."""
    body = F.rtrim(F.coalesce("body", F.lit("")), F.lit("\n "))
    # Trailing blanks are trimmed, and the blank of a mark with them.
    split = posts.select("target", F.split(body, "\n").alias("l"))
    places = F.transform("l", lambda x, i: F.when(x.isin("-- ", "--") & (i >= F.size("l") - SIGNATURE_LINES), i))
    marked = split.withColumn("mark", F.array_max(F.array_compact(places)))
    rows = marked.select("target", "mark", F.posexplode("l").alias("n", "line"))
    return rows.where("mark IS NULL OR n <> mark").select("target", "n", "line", F.when(F.col("n") > F.col("mark"), 1).otherwise(0).alias("part"))


def keeps_lines(short: Column, indented: Column, spaced: Column, n: Column) -> Column:
    """Whether a passage of ``n`` lines is set line by line."""
    return F.when(n < 2, (indented > 0) | (spaced > 0)).otherwise(((short == n) & (n >= LEAST_SHORT)) | (indented * 2 > n) | (spaced * 3 > n))


def body_blocks(posts: DataFrame) -> DataFrame:
    """(target, block_no, kind, lines, text): the blocks of posts (target, body); kind is paragraph, pre, quote or signature, and empty for a post without a word."""
    rows = lines_of(posts)
    order = Window.partitionBy("target", "part").orderBy("n")
    quoted = F.ltrim(F.col("line")).startswith(">")
    blank = _bare(F.col("line")) == ""
    seen = rows.withColumns({"q": quoted & (F.col("part") == 0), "b": blank & (F.col("part") == 0)})
    between = F.col("b") & F.coalesce(F.lag("q").over(order), F.lit(False)) & F.coalesce(F.lead("q").over(order), F.lit(False))
    kinds = seen.withColumn("kind", F.when(F.col("part") == 1, "signature").when(F.col("q") | between, "quote").when(F.col("b"), "blank").otherwise("text"))
    new = F.when(F.lag("kind").over(order) == F.col("kind"), 0).otherwise(1)
    groups = kinds.withColumn("g", new).withColumn("g", F.sum("g").over(order)).where("kind <> 'blank'")
    edge = F.rtrim("line", F.lit(" \t"))
    kept = F.when(F.col("kind") == "text", edge).when(F.col("kind") == "quote", _bare(F.ltrim(_bare(F.col("line")), F.lit(">")))).otherwise(F.col("line"))
    indented = F.col("line").startswith("  ") | (F.col("line").startswith("\t"))
    blocks = groups.groupBy("target", "part", "g", "kind").agg(
        F.array_sort(F.collect_list(F.struct("n", kept.alias("text")))).alias("t"),
        F.count("*").alias("lines"),
        F.count_if(F.char_length(edge) < SHORT_LINE).alias("short"),
        F.count_if(indented).alias("indented"),
        F.count_if(F.col("line").startswith("  ")).alias("deep"),
        F.count_if(edge.rlike(_COLUMNS)).alias("spaced"),
    )
    text = F.transform("t", lambda x: x["text"])
    # A single line is set by itself when blanks, not a tab, indent it.
    pre = keeps_lines(F.col("short"), F.when(F.col("lines") < 2, F.col("deep")).otherwise(F.col("indented")), F.col("spaced"), F.col("lines"))
    kind = F.when(F.col("kind") != "text", F.col("kind")).when(pre, "pre").otherwise("paragraph")
    laid = blocks.withColumn("kind", kind)
    joined = F.when(F.col("kind") == "paragraph", F.array_join(F.transform(text, _bare), " ")).when(F.col("kind") == "pre", F.array_join(text, "\n")).otherwise(_bare(F.array_join(text, "\n")))
    laid = laid.withColumn("text", joined).where((F.col("kind") != "signature") | (F.col("text") != ""))
    numbered = laid.withColumn("block_no", F.row_number().over(Window.partitionBy("target").orderBy("part", "g")) - 1).select("target", "block_no", "kind", "lines", "text")
    nothing = posts.select("target").join(numbered.select("target"), "target", "left_anti").select("target", F.lit(0).alias("block_no"), F.lit("empty").alias("kind"), F.lit(0).cast("long").alias("lines"), F.lit("(empty post)").alias("text"))
    return numbered.unionByName(nothing)


def quoted_share(blocks: DataFrame) -> DataFrame:
    """(target, quoted, own): lines of each post that it quotes and that are its own, without the signature."""
    return blocks.groupBy("target").agg(F.sum(F.when(F.col("kind") == "quote", F.col("lines")).otherwise(0)).alias("quoted"), F.sum(F.when(F.col("kind").isin("paragraph", "pre"), F.col("lines")).otherwise(0)).alias("own"))
