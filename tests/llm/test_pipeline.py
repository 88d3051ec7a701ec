"""Every stage of the corpus pipeline, and the whole, over a small corpus with planted cases."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tomespark.llm import queries

from .test_dedup import brute_links, line_key
from .test_texts import brute_leaks, brute_counts, lengths_of


def made(n, seed):
    draw = random.Random(seed)
    return [f"term{draw.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, " ".join(made(30, 800 + k))) for k in range(5)]
    rows = [(k, "\n".join(" ".join(made(15, 40 * k + j)) for j in range(8)) + ("\nShare this page" if k < 30 else "")) for k in range(120)]
    rows += [(200 + k, rows[k][1].replace("term7", "changed", 1)) for k in range(6)] + [(210, rows[50][1]), (211, rows[50][1])]
    rows += [(300 + k, " ".join(made(60, 70 + k) + items[k][1].split() + made(60, 90 + k))) for k in range(5)]
    rows += [(400, "too short"), (401, None), (402, ""), (403, "a b c " * 60)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages_against_brute_force(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    held = dict(rows)

    def read(df, k):
        df.write.parquet(f"{folder}/stage{k}")
        back = spark.read.parquet(f"{folder}/stage{k}")
        return back, {r["doc_id"]: r["text"] for r in back.collect()}

    docs, got = read(corpus_pipeline.quality(spark, docs, folder), 0)
    held = {d: t for d, t in held.items() if not brute_counts(t)[-1]}
    assert got == held and docs.columns == columns

    docs, got = read(corpus_pipeline.lines(spark, docs, folder), 1)
    seen = {}
    for d, t in held.items():
        for key in {line_key(x) for x in t.split("\n")}:
            seen.setdefault(key, set()).add(d)
    gone = {k for k, v in seen.items() if k and len(v) >= 10}
    held = {d: "\n".join(x for x in t.split("\n") if line_key(x) not in gone) for d, t in held.items()}
    assert got == held and "share this page" in gone and docs.columns == columns
    assert {r["doc_id"]: r["n_chars"] for r in docs.collect()} == {d: len(t) for d, t in held.items()}

    docs, got = read(corpus_pipeline.near_duplicates(spark, docs, folder), 2)
    stay = {c if links else d for d, c, links in brute_links(list(held.items()))}
    held = {d: t for d, t in held.items() if d in stay}
    assert got == held and 200 not in held and docs.columns == columns

    docs, got = read(corpus_pipeline.decontamination(spark, docs, folder), 3)
    leaked = {d for d, _ in brute_leaks(list(held.items()), items)}
    held = {d: t for d, t in held.items() if d not in leaked}
    assert leaked == {300, 301, 302, 303, 304} and got == held and docs.columns == columns

    packed = corpus_pipeline.pack(spark, docs, folder).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(lengths_of(list(held.items())))
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))


def test_every_operator_has_a_query():
    names = entry.queries()
    assert {int(x[2:].split("_")[0]) for x in names if x.startswith("op") and x[2].isdigit()} == set(range(1, 14))
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(names)
    assert [x for x, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
