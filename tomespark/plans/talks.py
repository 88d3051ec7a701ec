"""Queries over conversations: threads, kill files, series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomespark.functions import text as fn
from tomespark.operators import threads
from tomespark.operators import posts as posts_
from tomespark.plans.inputs import posts, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Turn n refers to n - 2 and n - 1, and every fifth turn to a lost post only: that one goes to the first turn, which has its subject.
_PARENTS = """p AS (SELECT conv_id, turn AS num, text, role,
 CASE WHEN turn = 0 OR turn NOT IN (SELECT turn FROM conversations) THEN NULL
      WHEN turn % 5 = 4 THEN (SELECT min(r.turn) FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn = 0)
      ELSE (SELECT max(r.turn) FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn IN (c.turn - 1, c.turn - 2)) END AS parent
 FROM conversations c)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_PARENTS} SELECT conv_id, num, parent FROM p")
def thread_parents(spark, sf):
    return threads.parents(posts(spark, sf), "conv_id")


_WALK = f"""WITH RECURSIVE {_PARENTS}, walk AS (
  SELECT conv_id, num, num AS root, 0 AS depth, CAST(num AS VARCHAR) AS path FROM p WHERE parent IS NULL
  UNION ALL SELECT p.conv_id, p.num, w.root, w.depth + 1, w.path || '/' || p.num FROM walk w JOIN p ON p.conv_id = w.conv_id AND p.parent = w.num)"""


@query(f"{_WALK} SELECT conv_id, num, root, least(depth, 8) AS depth, path FROM walk")
def thread_walk(spark, sf):
    return threads.threads(spark, posts(spark, sf), "conv_id").withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


@query(f"{_WALK} SELECT conv_id, root, count(*) AS posts, max(num) AS last, max(least(depth, 8)) AS depth FROM walk GROUP BY conv_id, root")
def thread_activity(spark, sf):
    p = posts(spark, sf)
    return threads.activity(threads.threads(spark, p, "conv_id"), p, "conv_id")


@query("SELECT conv_id, turn AS num FROM conversations WHERE NOT contains(lower(role), 'system') AND NOT contains(lower(coalesce(text, '')), 'the')")
def without_killed(spark, sf):
    return threads.without_killed(posts(spark, sf), ["SYSTEM", " the ", ""], ["sender", "body"]).select("conv_id", "num")


@query("""WITH t AS (SELECT conv_id, turn, 'A Tale (Final), Part ' || CASE turn % 4 WHEN 0 THEN 'iv' WHEN 1 THEN '1' WHEN 2 THEN 'II' ELSE '3' END || ': more' AS title FROM conversations)
SELECT conv_id, turn, 'a tale' AS series, CASE turn % 4 WHEN 0 THEN 4 ELSE turn % 4 END AS part FROM t""")
def series_of_titles(spark, sf):
    number = F.get(F.array(*map(F.lit, ("iv", "1", "II", "3"))), (F.col("turn") % 4).cast("int"))
    title = F.concat(F.lit("A Tale (Final), Part "), number, F.lit(": more"))
    return table(spark, sf, "conversations").select("conv_id", "turn", fn.series_key(title).alias("series"), fn.part_number(title).alias("part"))


@query("""WITH parts AS (SELECT conv_id, turn AS id, CASE WHEN conv_id % 2 = 0 THEN 100 - turn ELSE 7 END AS part, turn AS posted FROM conversations),
s AS (SELECT conv_id, count(DISTINCT part) = count(*) AND min(part) > 0 AS by_number FROM parts GROUP BY conv_id)
SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN by_number THEN part END, posted, id) AS place FROM parts JOIN s USING (conv_id)""")
def ordered_parts(spark, sf):
    part = F.when(F.col("conv_id") % 2 == 0, 100 - F.col("turn")).otherwise(7)
    parts = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("id"), part.alias("part"), F.col("turn").alias("posted"))
    return threads.ordered_parts(parts, "conv_id").select("conv_id", "id", "place")


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo' ELSE 'cy' END AS poster FROM conversations""")
def poster_names(spark, sf):
    sender = F.get(F.array(F.lit('"Ann Lee" <ann@a.example>'), F.lit("bo@b.example (Bo)"), F.lit("cy@c.example")), (F.col("turn") % 3).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", fn.poster_name(sender).alias("poster"))


_SPACE = "' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)"
_BODIES = """bodies AS (SELECT conv_id || '-' || turn AS target, turn, '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || text || CASE WHEN turn % 2 = 0 THEN chr(10) || '-- ' || chr(10) || role ELSE '' END AS body FROM conversations)"""
_BLOCKS = f"""{_BODIES}, split AS (SELECT target, string_split(rtrim(coalesce(body, ''), chr(10) || ' '), chr(10)) AS l FROM bodies),
marked AS (SELECT target, l, list_max(list_filter(range(1, len(l) + 1), lambda i: l[i] IN ('-- ', '--') AND i > len(l) - 12)) AS mark FROM split),
rows AS (SELECT target, n, l[n] AS line, CASE WHEN n > mark THEN 1 ELSE 0 END AS part FROM marked, unnest(range(1, len(l) + 1)) u(n) WHERE mark IS NULL OR n <> mark),
seen AS (SELECT *, part = 0 AND starts_with(ltrim(line, ' '), '>') AS q, part = 0 AND trim(line, {_SPACE}) = '' AS b FROM rows),
kinds AS (SELECT *, CASE WHEN part = 1 THEN 'signature' WHEN q OR (b AND coalesce(lag(q) OVER w, false) AND coalesce(lead(q) OVER w, false)) THEN 'quote' WHEN b THEN 'blank' ELSE 'text' END AS kind FROM seen WINDOW w AS (PARTITION BY target, part ORDER BY n)),
new AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY target, part ORDER BY n) = kind THEN 0 ELSE 1 END AS new FROM kinds),
groups AS (SELECT *, sum(new) OVER (PARTITION BY target, part ORDER BY n) AS g, rtrim(line, ' ' || chr(9)) AS edge FROM new),
made AS (SELECT target, part, g, kind, count(*) AS lines, count(*) FILTER (WHERE length(edge) < 50) AS short, count(*) FILTER (WHERE starts_with(line, '  ')) AS deep, count(*) FILTER (WHERE starts_with(line, '  ') OR starts_with(line, chr(9))) AS indented,
 count(*) FILTER (WHERE regexp_matches(edge, '\\S {{3,}}\\S')) AS spaced, string_agg(edge, chr(10) ORDER BY n) AS kept, string_agg(trim(line, {_SPACE}), ' ' ORDER BY n) AS set, string_agg(line, chr(10) ORDER BY n) AS whole,
 string_agg(trim(ltrim(trim(line, {_SPACE}), '>'), {_SPACE}), chr(10) ORDER BY n) AS quoted FROM groups WHERE kind <> 'blank' GROUP BY 1, 2, 3, 4),
laid AS (SELECT target, part, g, lines, CASE WHEN kind <> 'text' THEN kind WHEN CASE WHEN lines < 2 THEN deep > 0 OR spaced > 0 ELSE (short = lines AND lines >= 3) OR indented * 2 > lines OR spaced * 3 > lines END THEN 'pre' ELSE 'paragraph' END AS kind, kept, set, whole, quoted FROM made),
told AS (SELECT target, part, g, kind, lines, CASE kind WHEN 'paragraph' THEN set WHEN 'pre' THEN kept WHEN 'quote' THEN trim(quoted, {_SPACE}) ELSE trim(whole, {_SPACE}) END AS text FROM laid),
numbered AS (SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY part, g) - 1 AS INTEGER) AS block_no, kind, lines, text FROM told WHERE kind <> 'signature' OR text <> ''),
blocks AS (SELECT * FROM numbered UNION ALL SELECT target, 0, 'empty', 0, '(empty post)' FROM bodies WHERE target NOT IN (SELECT target FROM numbered))"""


def _bodies(spark, sf):
    """Turns as posts that quote themselves; every second has a signature."""
    quoted = F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"), "text")
    signed = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n-- \n"), "role")).otherwise("")
    return table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("target"), F.concat(quoted, signed).alias("body"))


@query(f"WITH {_BLOCKS} SELECT target, block_no, kind, lines, text FROM blocks")
def post_blocks(spark, sf):
    return posts_.body_blocks(_bodies(spark, sf))


@query(f"WITH {_BLOCKS} SELECT target, CAST(sum(CASE WHEN kind = 'quote' THEN lines ELSE 0 END) AS BIGINT) AS quoted, CAST(sum(CASE WHEN kind IN ('paragraph', 'pre') THEN lines ELSE 0 END) AS BIGINT) AS own FROM blocks GROUP BY target")
def quoted_share(spark, sf):
    return posts_.quoted_share(posts_.body_blocks(_bodies(spark, sf)))
