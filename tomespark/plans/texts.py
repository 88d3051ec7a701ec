"""Queries over texts: search, vocabulary, judging and mending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomespark.functions import text as fn
from tomespark.operators import index, pieces, quality, repair, search
from tomespark.plans.inputs import TEXTS, dealt, parted, table, texts
from tomespark.sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_FOLD = f"translate(lower(translate(coalesce({{0}}, ''), 'İ', 'i')), '{fn.FOLD_FROM}', '{fn.FOLD_TO.replace(chr(39), chr(39) * 2)}')"
_TOKENS = "list_filter(string_split_regex({0}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_COLUMNS = f"""cols AS (
  SELECT target, 0 AS col, {_TOKENS.format(_FOLD.format('title'))} AS ts FROM texts
  UNION ALL SELECT target, 1, {_TOKENS.format(_FOLD.format('text'))} FROM texts
), postings AS (SELECT target, col, p - 1 AS pos, ts[p] AS term FROM cols, unnest(range(1, len(ts) + 1)) AS u(p))"""
_POSTINGS = f"{TEXTS}, {_COLUMNS}"
# The documents after some were put again and some were deleted.
_CHANGED = f"""{TEXTS.replace("texts AS", "source AS", 1)}, texts AS (
  SELECT target, kind, title, CASE WHEN updated % 10 = 0 THEN title || ' then an ereau ' || kind ELSE text END AS text, updated FROM source WHERE updated % 7 <> 3
), {_COLUMNS}"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place(spark, sf: str, name: str) -> str:
    """A folder in the shared one for what is made of ``documents``; its name changes when the files do."""
    d = table(spark, sf, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    files = d.agg(F.coalesce(F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)")), F.lit(0))).first()[0]
    return f"{shared.folder(spark)}/{name}-{files}"


def _index(spark, sf: str, name: str, make) -> index.Index:
    found = index.Index(spark, _place(spark, sf, f"index-{name}-{index.LAYOUT}"))
    if not found.complete():
        make(found)
        found.done()
    return found


def stored_index(spark, sf: str) -> index.Index:
    return _index(spark, sf, "texts", lambda i: i.build(texts(spark, sf)))


def changed_index(spark, sf: str) -> index.Index:
    """An index of which every tenth document was put again with another text, and every seventh deleted, in deltas."""

    def make(i: index.Index) -> None:
        docs = texts(spark, sf)
        i.build(docs)
        i.put(docs.where(F.col("updated") % 10 == 0).withColumn("text", F.concat("title", F.lit(" then an ereau "), "kind")))
        i.delete(docs.where(F.col("updated") % 7 == 3))

    return _index(spark, sf, "changed", make)


@query(f"WITH {_POSTINGS} SELECT term, count(DISTINCT target) AS df FROM postings GROUP BY term")
def document_frequency(spark, sf):
    return search.document_frequency(search.postings(texts(spark, sf)))


def _search_sql(terms: list[str], extra: str = "", postings: str = _POSTINGS) -> str:
    """The ranking in SQL; each term is a SQL condition on postings, or a phrase of two words."""
    hits = " UNION ALL ".join(f"SELECT target, {k} AS q, sum(CASE WHEN col = 0 THEN 5.0 ELSE 1.0 END) AS tf FROM postings p WHERE {t} GROUP BY target" for k, t in enumerate(terms))
    return f"""WITH {postings}, hits AS ({hits}), df AS (SELECT q, count(*) AS df FROM hits GROUP BY q),
size AS (SELECT target, count(*) AS len FROM postings GROUP BY target), corpus AS (SELECT count(*) AS n, avg(len) AS mean FROM size),
ranked AS (SELECT target, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS terms
 FROM hits JOIN df USING (q) JOIN size USING (target), corpus GROUP BY target)
SELECT target, kind, title, round(score, 6) AS score FROM ranked JOIN texts USING (target) WHERE terms = {len(terms)} {extra}"""


@query(_search_sql(["term LIKE 'then%'", "term = 'an'"]))
def search_words(spark, sf):
    return stored_index(spark, sf).search("Then an").withColumn("score", F.round("score", 6))


@query(_search_sql(["term = 'and' AND EXISTS (SELECT 1 FROM postings n WHERE n.target = p.target AND n.col = p.col AND n.pos = p.pos + 1 AND n.term = 'attion')"]))
def search_phrase(spark, sf):
    return stored_index(spark, sf).search('"and attion"').withColumn("score", F.round("score", 6))


@query(_search_sql(["term LIKE 'ereau%'"], "ORDER BY score DESC, updated DESC, target LIMIT 30"))
def search_page(spark, sf):
    return stored_index(spark, sf).search("éreau", limit=30).withColumn("score", F.round("score", 6))


@query(_search_sql(["term LIKE 'then%'", "term = 'an' AND EXISTS (SELECT 1 FROM postings n WHERE n.target = p.target AND n.col = p.col AND n.pos = p.pos + 1 AND n.term = 'ereau')"], postings=_CHANGED))
def search_changed(spark, sf):
    """A word and a phrase, in an index with deltas."""
    return changed_index(spark, sf).search('then "an ereau"').withColumn("score", F.round("score", 6))


@query(f"WITH {_CHANGED} SELECT term, count(DISTINCT target) AS df FROM postings WHERE term IN ('then', 'ereau', 'an', 'attion') GROUP BY term")
def changed_frequencies(spark, sf):
    """Frequencies of asked words, of which only the partitions are read."""
    return changed_index(spark, sf).document_frequency(["then", "ereau", "an", "attion", "nowhere"])


@query(f"WITH {_CHANGED} SELECT left(target, 1) AS prefix, count(*) AS documents FROM texts GROUP BY 1")
def changed_counts(spark, sf):
    return changed_index(spark, sf).documents().groupBy(F.left("target", F.lit(1)).alias("prefix")).agg(F.count("*").alias("documents"))


@query(f"WITH {_CHANGED} SELECT target, count(*) AS n, count(DISTINCT term) AS terms, sum(pos) AS places FROM postings GROUP BY target")
def changed_postings(spark, sf):
    """Every posting of an index with deltas, by document."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, p: s + p)
    n = F.size("title") + F.size("body")
    return changed_index(spark, sf).postings().groupBy("target").agg(F.sum(n).alias("n"), F.count_distinct("term").alias("terms"), F.sum(total(F.col("title")) + total(F.col("body"))).alias("places"))


@query(f"""WITH {_POSTINGS} SELECT target, count(*) AS n, count(DISTINCT term) AS terms FROM (
 SELECT target, term FROM postings UNION ALL SELECT target, term FROM postings WHERE false) GROUP BY target""")
def reindexed_documents(spark, sf):
    docs = parted(texts(spark, sf))
    index = search.reindexed(search.postings(docs), docs.where(F.col("updated") % 10 == 0))
    return index.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"))


@query(f"""WITH {TEXTS}, w AS (SELECT target, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM texts)
SELECT word, count(DISTINCT target) AS docs, count(*) AS count FROM w WHERE length(word) >= 3 GROUP BY word HAVING count(DISTINCT target) >= 6 AND count(*) >= 10""")
def vocabulary(spark, sf):
    return search.vocabulary(dealt(texts(spark, sf).select("target", "text")))


_RARE = f"""{TEXTS}, runs AS (SELECT target, unnest(regexp_extract_all({_FOLD.format('text')}, '\\p{{L}}+')) AS word FROM texts),
tf AS (SELECT target, word, count(*) AS tf FROM runs WHERE length(word) BETWEEN 5 AND 24 GROUP BY 1, 2),
used AS (SELECT * FROM tf QUALIFY row_number() OVER (PARTITION BY target ORDER BY tf DESC, word) <= 400),
total AS (SELECT count(*) AS total FROM texts),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
scored AS (SELECT target, word, tf, round((1 + ln(CAST(tf AS DOUBLE))) * ln((total + 1) / df), 9) AS score FROM used JOIN df USING (word), total WHERE df >= 2 AND df <= greatest(3, total // 50) AND total >= 20),
rare AS (SELECT target, word, score FROM scored QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, tf DESC, word) <= 10)"""


@query(f"WITH {_RARE} SELECT target, word, round(score, 6) AS score FROM rare")
def rare_words(spark, sf):
    return search.rare_words(texts(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""WITH {_RARE}, shared AS (SELECT r.target, o.target AS kin, count(DISTINCT word) AS shared FROM rare r JOIN (SELECT DISTINCT target, word FROM runs) o USING (word) WHERE r.target <> o.target GROUP BY 1, 2 HAVING count(DISTINCT word) >= 2)
SELECT target, kin, shared FROM shared QUALIFY row_number() OVER (PARTITION BY target ORDER BY shared DESC, kin) = 1""")
def kin(spark, sf):
    return search.kin(texts(spark, sf))


@query(f"""WITH {TEXTS}, d AS (SELECT target, lower(coalesce(title, '')) AS title, {_FOLD.format("title")} AS t, {_FOLD.format("regexp_replace(text, '^[^' || chr(10) || ']*' || chr(10) || '?', '')")} AS b, updated FROM texts),
runs AS (SELECT target, unnest(regexp_extract_all(t, '\\p{{L}}+')) AS word, 5.0 AS w FROM d UNION ALL SELECT target, unnest(regexp_extract_all(b, '\\p{{L}}+')), 1.0 FROM d),
sizes AS (SELECT target, len(regexp_extract_all(t, '\\p{{L}}+')) + len(regexp_extract_all(b, '\\p{{L}}+')) AS len FROM d),
corpus AS (SELECT count(*) AS total, avg(len) AS avg FROM sizes),
counted AS (SELECT target, word, count(*) AS n, sum(w) AS tf FROM runs WHERE length(word) BETWEEN 5 AND 24 GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM counted GROUP BY word),
used AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY target ORDER BY n DESC, word) <= 400),
scored AS (SELECT target, word, n, round((1 + ln(CAST(n AS DOUBLE))) * ln((total + 1) / df), 9) AS score FROM used JOIN df USING (word), corpus WHERE df >= 2 AND df <= greatest(3, total // 50) AND total >= 20),
rare AS (SELECT target, word FROM scored QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, n DESC, word) <= 10),
pairs AS (SELECT r.target, c.target AS kin, greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg)) AS part
 FROM rare r JOIN counted c USING (word) JOIN df USING (word) JOIN sizes z ON z.target = c.target JOIN d a ON a.target = r.target JOIN d k ON k.target = c.target, corpus
 WHERE r.target <> c.target AND k.updated < a.updated AND a.title <> k.title),
shared AS (SELECT target, kin, count(*) AS shared, round(sum(part), 9) AS score FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT target, kin, shared FROM shared QUALIFY row_number() OVER (PARTITION BY target ORDER BY shared DESC, score DESC, kin) = 1""")
def read_kin(spark, sf):
    """Documents are read in the order of their numbers, and each is asked for when it is read."""
    docs = texts(spark, sf).select("target", "title", F.regexp_replace("text", r"^[^\n]*\n?", "").alias("text"), "updated")
    return search.read_kin(docs.select("target", "title", "text"), docs.select("target", F.col("updated").alias("last")), docs.select("target", F.col("updated").alias("before")))


@query(f"""WITH {TEXTS} SELECT target, {_FOLD.format("title")} AS folded, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS spaced,
 trim(substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 32), '-') AS slug,
 regexp_replace(title, '([\\\\`*_\\[\\]<>])', '\\\\\\1', 'g') AS escaped,
 CASE WHEN length(title) > 40 THEN rtrim(substr(title, 1, 39)) || '…' ELSE title END AS clipped FROM texts""")
def title_functions(spark, sf):
    t = F.col("title")
    return texts(spark, sf).select("target", fn.fold(t).alias("folded"), fn.collapse_space(t).alias("spaced"), fn.slug(t).alias("slug"), fn.markdown_escape(t).alias("escaped"), fn.clip(t, 40).alias("clipped"))


@query("""SELECT p_partkey, regexp_replace('Re: AW: Re[2]: ' || p_name, '^((re|aw|sv|antw)\\s*(\\[\\d+\\])?\\s*:\\s*)+', '', 'i').trim().lower() AS subject,
 CASE WHEN p_size * 40000 >= 1048576 THEN printf('%.1f', p_size * 40000 / 1048576.0) || ' MB' WHEN p_size * 40000 >= 1024 THEN CAST(p_size * 40000 // 1024 AS VARCHAR) || ' KB' ELSE CAST(p_size * 40000 AS VARCHAR) || ' B' END AS size,
 p_size AS back FROM part""")
def subject_and_size(spark, sf):
    size = (F.col("p_size") * 40000).cast("long")
    back = fn.roman_value(fn.roman_numeral(F.col("p_size")))
    return table(spark, sf, "part").select("p_partkey", fn.base_subject(F.concat(F.lit("Re: AW: Re[2]: "), "p_name")).alias("subject"), fn.human_size(size).alias("size"), back.alias("back"))


@query(f"""WITH {TEXTS}, l AS (SELECT target, pos - 1 AS n, trim(regexp_replace(string_split(text, chr(10))[pos], '\\s+', ' ', 'g')) AS t FROM texts, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(pos)),
b AS (SELECT target, n, t, len(string_split(t, ' ')) AS w FROM l WHERE t <> '')
SELECT target, sum(w) AS prose, count(*) AS paras, sum(CASE WHEN w >= 30 THEN w ELSE 0 END) AS long_words, count(*) FILTER (WHERE w >= 8) AS starts,
 arg_min(t, n) FILTER (WHERE w >= 8) AS "first", arg_max(t, n) FILTER (WHERE w >= 30) AS "last" FROM b GROUP BY target""")
def page_measures(spark, sf):
    found = quality.measures(quality.plain_blocks(texts(spark, sf)))
    return found.select("target", "prose", "paras", "long_words", "starts", "first", "last")


def stored_vocabulary(spark, sf: str):
    """The vocabulary of ``documents``, made once and read from the shared folder then."""
    return shared.kept(spark, _place(spark, sf, "vocabulary"), lambda: search.vocabulary(dealt(texts(spark, sf).select("target", "text"))))


_WORD = repair.WORD.replace("'", "''")
_KNOWN = """v AS (SELECT word FROM (SELECT target, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM texts) WHERE length(word) >= 3 GROUP BY word HAVING count(DISTINCT target) >= 6 AND count(*) >= 10)"""
_BAR = "CASE kind " + " ".join(f"WHEN '{shelf}' THEN {bar}" for shelf, bar in quality.SHELF_BARS.items()) + f" ELSE {quality.DEFAULT_BAR} END"
_FORMAL = f"kind NOT IN ({', '.join(map(repr, quality.INFORMAL))})"
_OPENED = """regexp_replace({0}, '^(?:[\\s"“‘''(*_—–]|\\[[^\\]]{{0,20}}\\]|\\d+\\s)+', '')"""
_VERDICTS = f"""{TEXTS}, {_KNOWN}, l AS (SELECT target, pos - 1 AS n, trim(regexp_replace(string_split(text, chr(10))[pos], '\\s+', ' ', 'g')) AS t FROM texts, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(pos)),
i AS (SELECT *, n - row_number() OVER (PARTITION BY target ORDER BY n) AS island FROM l WHERE t <> ''),
b AS (SELECT target, n, t, len(string_split(t, ' ')) AS w, {_OPENED.format("t")} AS opened, count(*) OVER (PARTITION BY target, island) >= {quality.STANZA} AS set FROM i),
m AS (SELECT target, sum(w) AS words, sum(CASE WHEN w >= 30 THEN w ELSE 0 END) AS long_words, count(*) FILTER (WHERE w >= 8) AS starts, count(*) FILTER (WHERE w >= 8 AND regexp_matches(opened, '^\\p{{Ll}}')) AS lower_starts,
 coalesce(arg_min(t, n) FILTER (WHERE w >= 8), '') AS f, arg_min(opened, n) FILTER (WHERE w >= 8) AS o, rtrim(arg_max(t, n) FILTER (WHERE w >= 30), ' *' || chr(9)) AS e,
 count(*) FILTER (WHERE set) AS set_lines, coalesce(sum(w) FILTER (WHERE set), 0) AS set_words FROM b GROUP BY target),
k AS (SELECT target, count(v.word) AS known, count(*) AS every FROM (SELECT target, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')) AS word FROM texts) w LEFT JOIN v USING (word) GROUP BY target),
j AS (SELECT target, kind, coalesce(title, '') AS title, coalesce(words, 0) AS words, coalesce(long_words, 0) AS long_words, coalesce(starts, 0) AS starts, coalesce(lower_starts, 0) AS lower_starts, coalesce(f, '') AS f, o, e,
 CASE WHEN every >= {quality.CLEAN_WORDS} THEN known / every END AS clean, coalesce(set_lines >= {quality.VERSE_LINES} AND set_words * 2 >= words AND set_words <= {quality.VERSE_LINE} * set_lines, false) AS verse
 FROM texts LEFT JOIN m USING (target) LEFT JOIN k USING (target)),
verdicts AS (SELECT target, words, verse, CASE WHEN words > 0 THEN long_words / words ELSE 0.0 END AS long_share, array_to_string(list_filter([
 CASE WHEN words < 300 AND regexp_matches(lower(title || ' ' || f), '{"|".join(quality.ERROR_WORDS)}') THEN 'error page' END,
 CASE WHEN NOT verse AND words < {_BAR} THEN 'short' END,
 CASE WHEN NOT verse AND words >= 50 AND long_words / words < 0.2 THEN 'fragments' END,
 CASE WHEN NOT verse AND len(list_filter(string_split_regex(title, '\\s*(?:[-|–—]|--)\\s+'), lambda p: regexp_matches(p, '{quality.NOT_WHOLE.replace("'", "''")}'))) > 0 THEN 'title' END,
 CASE WHEN {_FORMAL} AND NOT verse AND NOT (starts >= 3 AND lower_starts * 2 > starts) AND o <> '' AND regexp_matches(o, '^[\\p{{Ll}},;.)\\-]') THEN 'starts mid-text' END,
 CASE WHEN {_FORMAL} AND NOT verse AND words < 3000 AND e <> '' AND NOT regexp_matches(e, '[.!?…:]["''”’)\\]]*$') AND regexp_matches(e, '[\\p{{Ll}},\\-]$') THEN 'ends mid-text' END,
 CASE WHEN {_FORMAL} AND words >= 400 AND clean >= 0.5 AND clean < 0.7 THEN 'garbled' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM j)"""


@query(f"WITH {_VERDICTS} SELECT target, words, long_share, verse, reasons FROM verdicts")
def text_verdicts(spark, sf):
    """The whole rule over every document, one without words included."""
    docs = dealt(texts(spark, sf))
    # Every line is prose, and no word goes over a line's end, so the words of a text are those of its blocks.
    prose = docs.select("target", F.lit("paragraph").alias("kind"), F.lit(False).alias("in_list"), "text")
    measured = quality.with_clean(quality.measures(quality.plain_blocks(docs)), prose, stored_vocabulary(spark, sf))
    rows = docs.select("target", "kind", F.coalesce("title", F.lit("")).alias("title")).join(measured, "target", "left").fillna(0, [c for c in measured.columns if c not in ("target", "first", "last", "clean")])
    found = quality.verdicts(rows, F.col("kind"), F.col("title"))
    return found.select("target", "words", "long_share", "verse", F.array_join("reasons", ", ").alias("reasons"))


@query(f"WITH {_VERDICTS} SELECT target, words, long_share, reasons FROM verdicts")
def judge(spark, sf):
    return text_verdicts(spark, sf).drop("verse")


_MAY_MEND = "octet_length(encode(word)) >= 3 AND NOT regexp_matches(word, '[''’]') AND (word = lower(word) OR (regexp_matches(word, '^\\p{Lu}\\p{Ll}*$') AND octet_length(encode(word)) > 1))"
_MENDS = f"""{_KNOWN}, unknown AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM texts) WHERE {_MAY_MEND}
 AND lower(word) NOT IN (SELECT word FROM v)),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in repair.CONFUSED)}) t(a, b)),
spelt AS (SELECT DISTINCT word, substr(word, 1, p - 1) || b || substr(word, p + length(a)) AS other FROM unknown, rules, unnest(range(1, length(word) + 1)) u(p) WHERE substr(word, p, length(a)) = a),
mended AS (SELECT word, min(other) AS mended FROM spelt WHERE other IN (SELECT word FROM v) GROUP BY word HAVING count(*) = 1),
tails AS (SELECT unnest({repair.TAILS}) AS tail), heads AS (SELECT word, left(word, length(word) - length(tail)) AS head, tail FROM unknown, tails WHERE ends_with(word, tail) AND octet_length(encode(word)) >= 5),
split AS (SELECT word, min(head || ' ' || tail) AS split FROM heads WHERE octet_length(encode(head)) >= 4 AND head IN (SELECT word FROM v) GROUP BY word HAVING count(*) = 1),
mends AS (SELECT word, split, mended FROM split FULL JOIN mended USING (word))"""


@query(f"WITH {TEXTS}, {_MENDS} SELECT word, split, mended FROM mends")
def word_mends(spark, sf):
    """Unknown words that one confused place, or one lost blank, explains."""
    return repair.word_mends(dealt(texts(spark, sf)), stored_vocabulary(spark, sf))


@query(f"""WITH {TEXTS}, {_MENDS}, cut AS (SELECT target, string_split_regex(text, '{_WORD}') AS gaps, regexp_extract_all(text, '{_WORD}') AS words FROM texts WHERE text IS NOT NULL),
each AS (SELECT target, i, gaps[i] AS gap, words[i] AS word, rtrim(gaps[i], ' "“‘''(') AS bare FROM cut, unnest(range(1, len(gaps) + 1)) u(i)),
done AS (SELECT target, i, gap, CASE WHEN word IS NULL THEN '' WHEN mends.word IS NULL OR NOT ({_MAY_MEND.replace("word", "each.word")}) THEN each.word
 WHEN each.word = lower(each.word) THEN coalesce(split, mended, each.word)
 WHEN CASE WHEN bare = '' THEN i = 1 ELSE right(bare, 1) IN ('.', '!', '?', ':', chr(10)) END THEN coalesce(upper(left(mended, 1)) || substr(mended, 2), each.word) ELSE each.word END AS word
 FROM each LEFT JOIN mends ON mends.word = lower(each.word))
SELECT target, string_agg(gap || word, '' ORDER BY i) AS text FROM done GROUP BY target UNION ALL SELECT target, text FROM texts WHERE text IS NULL""".replace("WHEN word IS NULL THEN ''", "WHEN each.word IS NULL THEN ''"))
def repaired_texts(spark, sf):
    return repair.with_repaired_words(dealt(texts(spark, sf).select("target", "text")), stored_vocabulary(spark, sf))


@query(f"""WITH {TEXTS}, {_KNOWN}, cut AS (SELECT target, string_split_regex(text, '\\p{{L}}+-\\s+\\p{{Ll}}+') AS gaps, regexp_extract_all(text, '\\p{{L}}+-\\s+\\p{{Ll}}+') AS pairs FROM texts WHERE text IS NOT NULL),
each AS (SELECT target, i, gaps[i] AS gap, coalesce(pairs[i], '') AS pair, regexp_extract(pairs[i], '^(\\p{{L}}+)-', 1) AS l, regexp_extract(pairs[i], '(\\p{{Ll}}+)$', 1) AS r FROM cut, unnest(range(1, len(gaps) + 1)) u(i))
SELECT target, string_agg(gap || CASE WHEN pair = '' THEN '' WHEN lower(l) || r IN (SELECT word FROM v) THEN l || r WHEN r IN ({", ".join(f"'{w}'" for w in repair.HYPHEN_KEEPS)}) THEN pair
 WHEN lower(l) IN (SELECT word FROM v) AND r IN (SELECT word FROM v) THEN l || '-' || r ELSE l || r END, '' ORDER BY i) AS text FROM each GROUP BY target UNION ALL SELECT target, text FROM texts WHERE text IS NULL""")
def joined_lines(spark, sf):
    """Words that the end of a line broke, joined by the vocabulary."""
    return repair.with_joined_lines(texts(spark, sf).select("target", "text"), stored_vocabulary(spark, sf))


@query(f"""WITH {TEXTS}, {_KNOWN}, lines AS (SELECT target, pos - 1 AS n, list_filter(string_split_regex(string_split(text, chr(10))[pos], '\\s+'), lambda t: t <> '') AS ts FROM texts, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(pos)),
tokens AS (SELECT target, n, i, ts[i] AS token, trim(ts[i], '{repair.TOKEN_EDGES.replace("'", "''")}') AS bare FROM lines, unnest(range(1, len(ts) + 1)) u(i)),
runs AS (SELECT bare, unnest(regexp_extract_all(bare, '{_WORD}')) AS run FROM (SELECT DISTINCT bare FROM tokens)),
kinds AS (SELECT bare, max(CASE WHEN lower(run) IN (SELECT word FROM v) OR regexp_matches(run, '^[A-Z]$') THEN 0 WHEN regexp_matches(run, '^\\p{{Lu}}\\p{{Ll}}*$') AND octet_length(encode(run)) > 1 THEN 1 ELSE 2 END) AS kind FROM runs GROUP BY bare),
classes AS (SELECT target, n, i, token, CASE WHEN bare = '' THEN 0 WHEN regexp_matches(bare, '{repair.NO_TEXT}') THEN 2 WHEN regexp_matches(bare, '[0-9]') THEN 0 ELSE coalesce(kind, 2) END AS class FROM tokens LEFT JOIN kinds USING (bare)),
numbered AS (SELECT *, sum(CASE WHEN class = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY target, n ORDER BY i) AS run FROM classes),
cuts AS (SELECT *, class > 0 AND count(*) FILTER (WHERE class > 0) OVER w >= 3 AND max(class) OVER w = 2 AS cut FROM numbered WINDOW w AS (PARTITION BY target, n, run)),
starts AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY target, n ORDER BY i), false) AS start FROM cuts),
parts AS (SELECT *, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY target, n ORDER BY i) AS p FROM starts)
SELECT target, n, CAST(dense_rank() OVER (PARTITION BY target, n ORDER BY p) - 1 AS INTEGER) AS part, string_agg(token, ' ' ORDER BY i) AS text FROM parts WHERE NOT cut GROUP BY target, n, p""")
def split_noise(spark, sf):
    """Lines cut where the print was noise."""
    lines = dealt(texts(spark, sf)).select("target", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return repair.split_junk(lines, stored_vocabulary(spark, sf))


@query()
def scanned_paragraphs(spark, sf):
    """Ten documents are a work, and each a page of it."""
    pages = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 10).alias("target"), F.col("doc_id").alias("page"), "text")
    return repair.scan_paragraphs(dealt(pages), stored_vocabulary(spark, sf), quality.mended_marks)


@query(f"""WITH {TEXTS}, w AS (SELECT target, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')) AS word FROM texts),
v AS (SELECT word FROM (SELECT target, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM texts) WHERE length(word) >= 3 GROUP BY word HAVING count(DISTINCT target) >= 6 AND count(*) >= 10)
SELECT target, count(v.word) AS known, count(*) - count(v.word) AS unknown, round(count(v.word) / count(*), 9) AS clean FROM w LEFT JOIN v USING (word) GROUP BY target""")
def cleanliness(spark, sf):
    return quality.cleanliness(dealt(texts(spark, sf).select("target", "text")), stored_vocabulary(spark, sf)).withColumn("clean", F.round("clean", 9))


@query(f"""WITH {TEXTS}, l AS (SELECT target, pos AS n, string_split(text, chr(10))[pos] AS text FROM texts, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(pos)),
m AS (SELECT *, CASE WHEN lag(text) OVER w IS NOT NULL AND NOT regexp_matches(rtrim(lag(text) OVER w), '[.!?…:]["''”’)\\]]*$') AND regexp_matches(text, '^\\p{{Ll}}') THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY target ORDER BY n)),
p AS (SELECT *, sum(new) OVER (PARTITION BY target ORDER BY n) AS paragraph FROM m)
SELECT target, paragraph, string_agg(text, ' ' ORDER BY n) AS text FROM p GROUP BY target, paragraph""")
def joined_paragraphs(spark, sf):
    lines = texts(spark, sf).select("target", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return quality.joined_paragraphs(lines)


@query(f"""WITH {TEXTS}, w AS (SELECT target, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS ws FROM texts)
SELECT target, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: x IN ({", ".join("'" + w + "'" for w in quality.AD_WORDS)}))) / len(ws) ELSE 0.0 END AS share FROM w""")
def advertising_share(spark, sf):
    return texts(spark, sf).select("target", quality.ad_share(F.col("text")).alias("share"))


@query(f"""WITH {TEXTS}, w AS (SELECT target, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^[\\p{{P}}\\p{{S}}]+', ''), '[\\p{{P}}\\p{{S}}]+$', '')) AS ws FROM texts),
m AS (SELECT target, len(ws) AS n, len(list_filter(ws, lambda x: regexp_matches(x, '^[\\p{{L}}''’-]+$') AND len(regexp_extract_all(x, '\\p{{L}}')) BETWEEN 1 AND 14)) AS plain,
 len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in quality.SMALL_WORDS)}))) AS small, array_to_string(ws, '') AS j FROM w),
c AS (SELECT *, len(regexp_extract_all(j, '\\p{{L}}')) AS letters, len(regexp_extract_all(j, '[fF]')) AS f, len(regexp_extract_all(j, '\\p{{Nd}}')) AS digits, length(j) AS total FROM m)
SELECT target, n >= 40 AND plain >= 0.8 * n AND letters >= 3 * n AND letters <= 9 * n AND letters * 10 >= total * 9 AND small >= 0.33 * n AND f <= 0.043 * greatest(letters, 1) AND digits <= 0.02 * greatest(total, 1) AS readable FROM c""")
def readable_texts(spark, sf):
    return texts(spark, sf).select("target", quality.readable(F.col("text")).alias("readable"))


@query()
def mended_texts(spark, sf):
    return dealt(texts(spark, sf).select("target", "text")).select("target", quality.mended_marks(F.col("text")).alias("text"))


@query(f"""WITH {TEXTS}, s AS (SELECT target, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ts FROM texts),
t AS (SELECT target, i - 1 AS n, ts[i] AS token FROM s, unnest(range(1, len(ts) + 1)) u(i)),
c AS (SELECT *, CASE WHEN regexp_matches(token, '^["''“‘(]*\\p{{L}}[\\p{{L}}''’-]*[.,;:!?"''”’)]*$') THEN 'clean' WHEN len(regexp_extract_all(token, '\\p{{L}}')) * 2 >= length(token) OR regexp_matches(token, '^[\\d.,;:!?()''"-]+$') THEN 'grey' ELSE 'junk' END AS class FROM t),
r AS (SELECT *, sum(CASE WHEN class = 'clean' THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY n) AS run FROM c)
SELECT target, min(n) AS start, count(*) AS size FROM r WHERE class <> 'clean' GROUP BY target, run HAVING count(*) >= 3 AND count(*) FILTER (WHERE class = 'junk') >= 1""")
def junk_runs(spark, sf):
    return quality.junk_runs(texts(spark, sf))


@query(f"""WITH {TEXTS}, p AS (SELECT target, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM texts),
f AS (SELECT target, plain, {_FOLD.format("plain")} AS folded FROM p),
g AS (SELECT target, plain, CASE WHEN regexp_matches(folded, '(?:^|[^\\p{{L}}\\p{{N}}])then') THEN length(regexp_extract(folded, '^(.*?(?:^|[^\\p{{L}}\\p{{N}}]))then', 1)) + 1 ELSE 0 END AS at FROM f),
h AS (SELECT *, CASE WHEN at > 61 THEN at - 60 ELSE 1 END AS start FROM g)
SELECT target, CASE WHEN at > 0 THEN CASE WHEN start > 1 THEN '…' ELSE '' END || substr(plain, start, at - start) || '**' || substr(plain, at, 4) || '**' || substr(plain, at + 4, greatest(156 - (at - start), 0)) || CASE WHEN length(plain) > start + 159 THEN '…' ELSE '' END
 ELSE substr(plain, 1, 160) || CASE WHEN length(plain) > 160 THEN '…' ELSE '' END END AS snippet FROM h""".replace(" at ", " place ").replace("(at ", "(place ").replace(" at,", " place,").replace("AS at", "AS place"))
def snippets(spark, sf):
    return texts(spark, sf).select("target", search.snippet(F.col("text"), "then").alias("snippet"))


@query("""WITH l AS (SELECT doc_id // 10 AS book, doc_id AS page, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT *, regexp_replace(lower(trim(ls[1])), '\\d+', '#', 'g') AS h, regexp_replace(lower(trim(ls[-1])), '\\d+', '#', 'g') AS f, count(*) OVER (PARTITION BY book) AS pages FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY book, h) AS nh, count(*) OVER (PARTITION BY book, f) AS nf FROM e),
d AS (SELECT *, (pages >= 4 AND nh * 10 >= pages * 2) OR h = '#' AS dh, (pages >= 4 AND nf * 10 >= pages * 2) OR f = '#' AS df FROM c)
SELECT book, page, array_to_string(ls[CASE WHEN dh THEN 2 ELSE 1 END : CASE WHEN df THEN len(ls) - 1 ELSE len(ls) END], chr(10)) AS text FROM d""")
def without_running_heads(spark, sf):
    pages = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 10).alias("book"), F.col("doc_id").alias("page"), F.split("text", "\n").alias("lines"))
    return quality.without_running_heads(pages, share=0.2).select("book", "page", F.array_join("lines", "\n").alias("text"))


_NUMBER = pieces.NOT_PIECE.replace("'", "''"), pieces.CHAPTER.replace("'", "''"), pieces.SERIAL.replace("'", "''")


@query(f"""WITH d AS (SELECT doc_id // 10 AS target, 'd' || doc_id AS id, upper(left(source, 1)) || lower(substr(source, 2)) || ' ' || doc_id AS title, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, len(list_filter(string_split_regex(title || ' ' || text, '\\s+'), lambda x: x <> '')) AS words FROM d)
SELECT target, id, title, words FROM w WHERE words BETWEEN 700 AND 25000 AND NOT regexp_matches(title, '{_NUMBER[0]}') AND NOT regexp_matches(title, '{_NUMBER[1]}') AND NOT regexp_matches(title || ' ' || text, '{_NUMBER[2]}')""")
def book_stories(spark, sf):
    """Ten documents are a book of stories, with its contents before them."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 10).alias("target"), "doc_id", F.concat_ws(" ", F.upper("source"), "doc_id").alias("title"), escaped.alias("text"))
    books = d.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("doc_id", "title", "text"))).alias("l"))
    part = lambda f: F.array_join(F.transform("l", f), "\n")
    contents = part(lambda x: F.concat(F.lit("<li><a href='#d"), x["doc_id"].cast("string"), F.lit("'>"), x["title"], F.lit("</a></li>")))
    bodies = part(lambda x: F.concat(F.lit("<h2 id='d"), x["doc_id"].cast("string"), F.lit("'>"), x["title"], F.lit("</h2><p>"), x["text"], F.lit("</p>")))
    return pieces.stories(books.select("target", F.concat(contents, F.lit("\n"), bodies).alias("html"))).select("target", "id", "title", "words")


_MARKED = """lines AS (SELECT doc_id, pos - 1 AS n, string_split(text, chr(10))[pos] AS t, len(string_split(text, chr(10))) - 1 AS last FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(pos))"""


@query(f"""WITH {_MARKED} SELECT doc_id AS target, n AS block_no, t AS text FROM lines
WHERE (doc_id % 2 <> 0 OR n < last) AND (doc_id % 3 <> 0 OR n > 1 OR last < 1 OR (doc_id % 2 = 0 AND last = 1))""")
def unwrapped_books(spark, sf):
    """Documents as books: those divisible by two end on a mark, those divisible by three start on one in their second line."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("target"), F.size(F.split("text", "\n")).alias("many"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    mark = F.when((F.col("target") % 2 == 0) & (F.col("block_no") == F.col("many") - 1), "*** END OF THE PROJECT GUTENBERG EBOOK").when((F.col("target") % 3 == 0) & (F.col("block_no") == 1), "*** START OF THE PROJECT GUTENBERG EBOOK")
    return pieces.unwrapped(lines.select("target", "block_no", F.coalesce(mark, "text").alias("text")))
