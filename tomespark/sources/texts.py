"""Plain formats as block rows: text, gemtext, gopher menus, Markdown with front matter, reading queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomespark.functions.text import collapse_space


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("target", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")).alias("n", "line"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(target, block_no, kind, text): paragraphs of plain text, cut at blank lines; a first one that begins with # is a heading."""
    parts = docs.select("target", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), r"\n[ \t]*\n")).alias("block_no", "p"))
    title = (F.col("block_no") == 0) & F.col("p").startswith("# ")
    text = collapse_space(F.when(title, F.substring(F.col("p"), F.lit(3), F.char_length("p"))).otherwise(F.col("p")))
    return parts.select("target", "block_no", F.when(title, "heading").otherwise("paragraph").alias("kind"), text.alias("text")).where("text <> ''")


def gemtext(docs: DataFrame) -> DataFrame:
    """(target, block_no, kind, level, text, href) of gemtext lines; lines between ``` marks are one preformatted block."""
    order = Window.partitionBy("target").orderBy("n")
    mark = F.col("line").startswith("```")
    toggled = _lines(docs).withColumn("_t", F.sum(F.when(mark, 1).otherwise(0)).over(order))
    inside = (F.col("_t") % 2 == 1) & ~mark
    pre = toggled.where(inside).groupBy("target", "_t").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    pre = pre.select("target", "n", F.lit("pre").alias("kind"), F.lit(0).alias("level"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), F.lit("").alias("href"))
    line = F.col("line")
    heads = F.char_length(F.regexp_extract(line, "^(#{1,3})", 1))
    kind = F.when(line.startswith("=>"), "link").when(heads > 0, "heading").when(line.startswith("* "), "item").when(line.startswith(">"), "quote").otherwise("paragraph")
    href = F.regexp_extract(line, r"^=>\s*(\S+)", 1)
    label = F.trim(F.regexp_replace(line, r"^=>\s*\S+", ""))
    text = F.when(line.startswith("=>"), F.coalesce(F.nullif(label, F.lit("")), href)).otherwise(F.trim(F.regexp_replace(line, r"^(#{1,3}|\* |>)", "")))
    rest = toggled.where(~inside & ~mark).select("target", "n", kind.alias("kind"), heads.alias("level"), text.alias("text"), href.alias("href")).where("text <> ''")
    return pre.unionByName(rest).withColumnRenamed("n", "block_no")


def gopher_menu(menus: DataFrame) -> DataFrame:
    """(target, n, type, label, href) of gopher menus; the end mark and lines without a type are left out."""
    rows = _lines(menus).where("line <> '.' AND line <> ''")
    f = F.split("line", "\t")
    kind, selector, host = F.substring("line", 1, 1), F.coalesce(F.get(f, F.lit(1)), F.lit("")), F.coalesce(F.get(f, F.lit(2)), F.lit(""))
    port = F.coalesce(F.get(f, F.lit(3)), F.lit("70"))
    href = F.when(kind == "i", "").when(selector.startswith("URL:"), F.substring(selector, F.lit(5), F.char_length(selector))).otherwise(F.concat(F.lit("gopher://"), host, F.when(port != "70", F.concat(F.lit(":"), port)).otherwise(""), F.lit("/"), kind, selector))
    return rows.select("target", "n", kind.alias("type"), F.expr("substring(split(line, '\t')[0], 2)").alias("label"), href.alias("href"))


def front_matter(notes: DataFrame) -> DataFrame:
    """(target, meta, body): key and value pairs of a Markdown note's front matter in order, and what follows it."""
    held = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    pairs = F.transform(F.filter(F.split(held, "\n"), lambda l: l.rlike(r"^[\w-]+\s*:")), lambda l: F.struct(F.regexp_extract(l, r"^([\w-]+)", 1).alias("key"), F.trim(F.regexp_replace(F.regexp_replace(l, r"^[\w-]+\s*:", ""), '^\\s*"(.*)"\\s*$', "$1")).alias("value")))
    return notes.select("target", pairs.alias("meta"), F.regexp_replace("text", r"(?s)^---\n.*?\n---(?:\n|$)", "").alias("body"))


def queue_entries(notes: DataFrame) -> DataFrame:
    """(target, n, section, done, title, url, catalog) of reading-queue lines: ``- [x] [title](url) · catalog`` below ``## section``."""
    order = Window.partitionBy("target").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    rows = _lines(notes).withColumn("section", F.coalesce(F.last(F.when(line.startswith("## "), F.trim(F.regexp_replace(line, "^## ", ""))), ignorenulls=True).over(order), F.lit("")))
    form = r"^- \[([ xX])\] \[((?:[^\]\\]|\\.)*)\]\(<?([^)>]*)>?\)(?: · (.*))?$"
    part = lambda k: F.regexp_extract("line", form, k)
    return rows.where(line.rlike(form)).select("target", "n", "section", (part(1) != " ").alias("done"), F.regexp_replace(part(2), r"\\(.)", "$1").alias("title"), part(3).alias("url"), part(4).alias("catalog"))
