"""Quality rules: base counts, then robust multivariate outliers.

Every statistic and the whole estimation are DataFrame operations. Texts are
read once; what follows works on a few numbers a document.

The verdict: documents that pass the base rule are vectors of FEATURES. For each
language and source a minimum-covariance-determinant estimate is found by
concentration steps: take the SUBSET share of documents nearest to the present
centre, re-estimate, repeat until no determinant falls any further. A step is one
aggregation. Squared distances fall into LEVELS fine classes, Spark sums counts,
values and products per group and class (so a group of any size is combined
before the shuffle), and running sums over a group's classes give the moments of
its nearest documents. Steps run from three starts (medians with median absolute
deviations, and the full and the diagonal covariance of all rows); the smallest
determinant wins. A last step re-estimates from all documents within the REWEIGHT
quantile. Both estimates carry the factor that makes them consistent for normal
data. A document goes when its Mahalanobis distance exceeds the square root of
the 1 - TAIL quantile of the chi-square law.

Features are fixed-point integers and their sums are decimals, so estimates do
not depend on the order of rows or on how they are partitioned. A variance gets
FLOORS squared added, as most texts have no symbols or repeats at all, and an
estimate without spread would reject every text that has one. Groups with fewer
than MIN_GROUP documents take the estimate of their language, and languages with
fewer that of all documents; those are fitted only where a group needs them.

Defined cases: a null or empty text has no words and fails the base rule. Very
long texts are counted whole; their three-word windows are compared word by
word, not by hash alone. Null languages and sources are groups of their own.
Documents at equal distances (ties) are in a subset together. Repeated rows
count repeatedly, and each gets the verdict. Where no document passes the base
rule none is judged; an empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomespark.llm.common import cut, row_key, stash, without_rows, words_column

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "length")
#: Added spread of each feature, in the units of the feature (natural logarithms).
FLOORS = (0.1, 0.4, 1.0, 1.0, 1.0)
SUBSET = 0.75
#: Documents within this quantile make the final estimate.
REWEIGHT = 0.975
#: The share of documents of a normal group that may lie beyond the cutoff.
TAIL = 1e-4
#: Steps go on while some determinant falls by more than this share.
SETTLED = 1e-4
MIN_GROUP = 30
LEVELS = 512
#: Above so many groups their estimates are joined by a shuffle on salted keys, else broadcast.
BROADCAST_GROUPS = 10_000
SALTS = 32
UNIT = 65536
#: How many low bits of a window's number hold its place.
PLACE_BITS = "CAST(ceil(log2(size(w) + 2)) AS INT)"
#: The columns whose values make a row's key.
KEY = ("doc_id", "text", "lang", "source")
#: Classes of a feature in which medians are found, for each unit.
CLASSES = 256
_P = range(len(FEATURES))
_PAIRS = [(i, j) for i in _P for j in range(i + 1)]


def chi_square(x: float, degrees: int) -> float:
    """The distribution function of the chi-square law."""
    a, x = degrees / 2, x / 2
    term = total = 1 / a
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= x / (a + k)
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def quantile(share: float, degrees: int) -> float:
    """The value that ``share`` of the chi-square law lies below."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return low


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows is too small by."""
    return 1.0 if share >= 1 else share / chi_square(quantile(share, len(FEATURES)), len(FEATURES) + 2)


def text_counts(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, lang, source and the counts of the base rule, a row per row of ``docs``."""
    held = docs.select(row_key(*KEY).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut_up = held.select("row_key", "doc_id", "lang", "source", (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("ls"), words_column(F.col("t")).alias("w"))
    sized = cut_up.select("row_key", "doc_id", "lang", "source", "n_symbols", (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"), "w", F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"), F.expr(PLACE_BITS).alias("bits"))
    hashes = F.expr("IF(n_words < 3, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, CAST(n_words AS INT) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))")
    # Where some hash repeats, each window becomes one number: its hash above, its place in the low bits; sorting brings equal windows together.
    windows = F.expr("IF(size(array_distinct(h)) = size(h), CAST(array() AS ARRAY<BIGINT>), sort_array(transform(h, (x, i) -> shiftleft(x, bits) | CAST(i AS BIGINT))))")
    kept = ["row_key", "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    same = "shiftright({0}[i - 1], bits) = shiftright(x, bits)"
    following = "i + 1 < size(s) AND shiftright(s[i + 1], bits) = shiftright(x, bits)"
    alike = F.expr(f"filter(s, (x, i) -> (i > 0 AND {same.format('s')}) OR ({following}))")
    found = sized.select(*kept, "bits", "w", hashes.alias("h")).select(*kept, "bits", "w", windows.alias("s")).select(*kept, "bits", "w", alike.alias("r"))
    # Neighbours of one number are compared word by word. Where all agree, numbers stand for windows; where not, windows are sorted as words.
    place = "CAST({} & (shiftleft(1L, bits) - 1L) AS INT)"
    unequal = " OR ".join(f"w[{place.format('r[i - 1]')} + {k}] <> w[{place.format('x')} + {k}]" for k in range(3))
    collides = F.expr(f"exists(transform(r, (x, i) -> i > 0 AND {same.format('r')} AND ({unequal})), c -> c)")
    by_number = F.expr("sort_array(transform(r, x -> x & (shiftleft(1L, bits) - 1L)))")
    triples = "sort_array(transform(sequence(0, CAST(n_words AS INT) - 3), i -> struct(w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, CAST(i AS BIGINT) AS p)))"
    equal = "(g.t[i {0}].a = x.a AND g.t[i {0}].b = x.b AND g.t[i {0}].c = x.c)"
    by_words = F.expr(
        f"flatten(transform(array(struct({triples} AS t)), g -> sort_array(transform(filter(g.t, (x, i) -> (i > 0 AND {equal.format('- 1')})"
        f" OR (i + 1 < size(g.t) AND {equal.format('+ 1')})), x -> x.p))))"
    )
    places = F.when(collides, by_words).otherwise(by_number)
    covered = F.expr("aggregate(transform(p, (x, i) -> IF(i + 1 < size(p), least(3L, p[i + 1] - x), 3L)), 0L, (a, b) -> a + b)")
    counted = found.select(*kept, places.alias("p")).select(*kept, covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _features() -> list[Column]:
    """The vector of a document, as fixed-point integers; nulls where it has no words."""
    share = lambda c: F.log1p(F.try_divide(100.0 * F.col(c), F.col("n_words")))
    values = [F.log(F.try_divide("word_chars", "n_words")), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words"), F.log(F.col("n_words").cast("double"))]
    return [F.round(v * UNIT).cast("long").alias(f"x{i}") for i, v in zip(_P, values)]


def _key(*parts: Column | None) -> Column:
    """A group's name; null values and levels that are pooled have marks of their own."""
    return F.concat_ws("\x01", *(F.lit("*") if p is None else F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts))


def _sums() -> list[Column]:
    first = [F.sum(F.col(f"x{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in _P]
    second = [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).alias(f"q{i}{j}") for i, j in _PAIRS]
    return [F.count("*").alias("n"), *first, *second]


def _estimate(sums: DataFrame, keep: list[str], diagonal: str, factor: float) -> DataFrame:
    """Centres m*, and the Cholesky factor l* of each covariance, times ``factor`` and with the floors added."""
    rules = [f"s{i} / CAST(n AS DOUBLE) / {UNIT} AS m{i}" for i in _P]
    for i, j in _PAIRS:
        cov = f"{factor!r}D * (q{i}{j} / CAST(n AS DOUBLE) / {UNIT} / {UNIT} - m{i} * m{j})"
        less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        if i == j:  # the floors keep the matrix positive definite; the bound only guards against rounding
            rules.append(f"sqrt(greatest(greatest({cov}, 0D) + {FLOORS[i] ** 2}D{less}, 1e-9D)) AS l{i}{j}")
        else:
            rules.append(f"(IF({diagonal}, 0D, {cov}){less}) / l{j}{j} AS l{i}{j}")
    det = " * ".join(f"l{i}{i}" for i in _P)
    # Each rule may use the names of those before it.
    return sums.selectExpr(*keep, "n", *rules, f"{det} AS det").select(*keep, "n", *(f"m{i}" for i in _P), *(f"l{i}{j}" for i, j in _PAIRS), "det")


def _medians(values: DataFrame) -> DataFrame:
    """(g, i, at): the median of each feature ``i`` of a group, from counts of classes (g, i, c)."""
    counts = values.groupBy("g", "i", "c").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("g", "i").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.select("g", "i", "c", F.sum("n").over(so_far).alias("upto"), F.sum("n").over(Window.partitionBy("g", "i")).alias("all"))
    return running.where(2 * F.col("upto") >= F.col("all")).groupBy("g", "i").agg(F.min("c").alias("at"))


def _median_start(rows: DataFrame) -> DataFrame:
    """An estimate of each group from medians and median absolute deviations, without correlations."""
    classes = rows.select("g", F.posexplode(F.array(*(F.floor(F.col(f"x{i}") * CLASSES / UNIT) for i in _P))).alias("i", "c"))
    centre = cut(_medians(classes))
    around = centre.groupBy("g").pivot("i", list(_P)).agg(F.first("at"))
    around = around.select("g", *(F.col(str(i)).alias(f"c{i}") for i in _P))
    apart = _with_group(rows, around, "g").select("g", F.posexplode(F.array(*(F.abs(F.floor(F.col(f"x{i}") * CLASSES / UNIT) - F.col(f"c{i}")) for i in _P))).alias("i", "c"))
    spread = _medians(apart).withColumnRenamed("at", "mad")
    wide = centre.join(spread, ["g", "i"]).groupBy("g").pivot("i", list(_P)).agg(F.first("at").alias("at"), F.first("mad").alias("mad"))
    # 1.4826: what makes the median deviation of normal data its standard deviation.
    centres = [(F.col(f"{i}_at") / float(CLASSES)).alias(f"m{i}") for i in _P]
    factors = [(F.sqrt(F.pow(1.4826 * F.col(f"{i}_mad") / float(CLASSES), 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _PAIRS]
    return wide.select("g", F.lit(2).alias("start"), *centres, *factors)


def _with_distance(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and d2, the squared distance, through the factor: solve L y = x - m, then sum the squares of y."""
    rules = [f"(x{i} / {float(UNIT)}D - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} AS y{i}" for i in _P]
    return rows.selectExpr(*keep, *rules, " + ".join(f"y{i} * y{i}" for i in _P) + " AS d2").select(*keep, "d2")


def _with_group(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Join the values of groups to rows; one group may hold most rows, so it never rests on a plain shuffle."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def fit(rows: DataFrame, subset: float = SUBSET, reweight: float = REWEIGHT) -> DataFrame:
    """The estimate of each group ``g`` of ``rows`` (g, x0, x1, ...), with its number of rows ``size``."""
    values = [*(f"m{i}" for i in _P), *(f"l{i}{j}" for i, j in _PAIRS)]
    xs = [f"x{i}" for i in _P]
    totals = cut(rows.groupBy("g").agg(*_sums()))
    sizes = totals.select("g", F.col("n").alias("size"))
    start = _estimate(totals.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))), ["g", "start"], "start = 1", 1.0)
    present = cut(start.select("g", "start", *values).unionByName(_median_start(rows)).join(sizes, "g"))
    level = F.least(F.floor(16 * F.log2(1 + 16 * F.col("d2"))), F.lit(LEVELS - 1)).cast("int")
    names = ["n", *(f"s{i}" for i in _P), *(f"q{i}{j}" for i, j in _PAIRS)]
    order = Window.partitionBy("g", "start").orderBy("level")
    factor = consistency(subset)
    present, tried = present.withColumn("was", F.lit(None).cast("double")), None
    while True:
        near = _with_group(rows, present, "g")
        levels = _with_distance(near, ["g", "start", "size", "was", *xs]).withColumn("level", level).groupBy("g", "start", "size", "was", "level").agg(*_sums())
        running = levels.select("g", "start", "size", "was", "level", *(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in names))
        reached = running.where(F.col("n") >= F.ceil(F.col("size") * subset)).withColumn("first", F.row_number().over(order)).where("first = 1")
        found = cut(_estimate(reached, ["g", "start", "size", "was"], "false", factor).drop("n"))
        tried = found if tried is None else tried.unionByName(found)
        present = found.where(F.col("was").isNull() | (F.col("det") < F.col("was") * (1 - SETTLED))).drop("was").withColumnRenamed("det", "was")
        if not present.limit(1).count():  # only those that still fall take another step
            break
    chosen = tried.withColumn("first", F.row_number().over(Window.partitionBy("g").orderBy("det", "start"))).where("first = 1").select("g", "size", *values)
    within = _with_distance(_with_group(rows, chosen, "g"), ["g", "size", *xs]).where(F.col("d2") <= quantile(reweight, len(FEATURES)))
    return _estimate(within.groupBy("g", "size").agg(*_sums()), ["g", "size"], "false", consistency(reweight)).select("g", "size", *values)


def _usable(stats: DataFrame, min_group: int) -> DataFrame:
    """(own, g): the group whose estimate judges the documents of each language and source."""
    counts = cut(stats.groupBy("own", "language", "everything").agg(F.count("*").alias("n")))
    in_language = counts.groupBy("language").agg(F.sum("n").alias("of_language"))
    level = F.when(F.col("n") >= min_group, F.col("own")).when(F.col("of_language") >= min_group, F.col("language")).otherwise(F.col("everything"))
    return cut(counts.join(in_language, "language").select("own", level.alias("g")))


def judge(docs: DataFrame, tail: float = TAIL, subset: float = SUBSET, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts, base_failed, robust distance and kept, one row per row of ``docs``; ``row_key`` is its key over KEY."""
    stats = text_counts(docs)
    own, language, everything = _key(F.col("lang"), F.col("source")), _key(F.col("lang"), None), _key(None, None)
    stats = stash(stats.select("*", *_features(), own.alias("own"), language.alias("language"), everything.alias("everything")), "counts")
    passing = stats.where("NOT base_failed")
    usable = _usable(passing, min_group)
    levels = passing.select(F.explode(F.array("own", "language", "everything")).alias("g"), *(f"x{i}" for i in _P))
    rows = _with_group(levels, usable.select("g").distinct(), "g")
    chosen = cut(fit(rows, subset).join(usable, "g").drop("g", "size"))
    kept = ["row_key", "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = _with_distance(_with_group(passing, chosen, "own"), kept).withColumn("distance", F.sqrt("d2"))
    passed = passed.select(*kept, "distance", (F.col("distance") <= math.sqrt(quantile(1 - tail, len(FEATURES)))).alias("kept"))
    failed = stats.where("base_failed").select(*kept, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return passed.unionByName(failed)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return without_rows(docs, judge(docs).where("NOT kept").select("row_key").distinct(), *KEY)
