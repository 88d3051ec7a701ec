"""The stored index: put, replace, delete, merge, and reads of only what a query needs."""

import random
import re

import pytest

from tomespark.operators import index as index_module
from tomespark.operators import search
from tomespark.operators.index import Index

DOCS = "target string, kind string, title string, text string, updated long"


@pytest.fixture
def make(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "BUCKETS", 6)  # fewer folders to write

    def docs(*rows):
        return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], DOCS)

    return docs, Index(spark, f"file://{tmp_path}/index")


def found(index, q, **options):
    return [r["target"] for r in index.search(q, **options).collect()]


def test_put_replace_delete_and_counts(make):
    docs, index = make
    index.build(docs(("a:1", "web", "The statue", "moves when nobody looks"), ("a:2", "book", "Dracula", "he stood like a statue"), ("b:1", "feed", "Göbekli", "Kafatası kültü ve statue")))
    assert found(index, "statue")[0] == "a:1" and sorted(found(index, "statue")) == ["a:1", "a:2", "b:1"]
    assert found(index, "kafatasi") == ["b:1"] and found(index, '"moves when"') == ["a:1"] and found(index, '"when moves"') == []
    assert sorted(found(index, "stat")) == ["a:1", "a:2", "b:1"] and found(index, "statue", kind="book") == ["a:2"]
    assert (index.count(), index.count("a:"), index.count("b:"), index.count("c")) == (3, 2, 1, 0)
    index.put(docs(("a:2", "book", "Dracula", "now without that word"), ("a:3", "web", "New", "statue statue")))
    assert sorted(found(index, "statue")) == ["a:1", "a:3", "b:1"] and found(index, "without word") == ["a:2"] and index.count() == 4
    index.put(docs(("a:2", "book", "Dracula", "a statue again")))
    assert sorted(found(index, "statue")) == ["a:1", "a:2", "a:3", "b:1"] and found(index, "without") == []
    index.delete_prefix("a:1")
    assert sorted(found(index, "statue")) == ["a:2", "a:3", "b:1"]
    before = index.search("statue").collect()
    frequencies = sorted(map(tuple, index.document_frequency(["statue", "dracula", "moves"]).collect()))
    assert frequencies == [("dracula", 1), ("statue", 3)]
    index.merge()
    assert index.generations()[1] == [] and index.search("statue").collect() == before
    assert sorted(map(tuple, index.document_frequency(["statue", "dracula", "moves"]).collect())) == frequencies
    index.drop_old()
    assert index.search("statue").collect() == before and index.count("a:") == 2
    index.put(docs(("a:1", "web", "Back", "statue")))
    assert "a:1" in found(index, "statue")
    index.clear()
    assert found(index, "statue") == [] and index.count() == 0


def test_hostile_queries_and_empty_index(make):
    docs, index = make
    assert found(index, "near") == []
    index.build(docs(("a", "web", "A", "near the end and more"), ("b", "web", None, None)))
    for q in ['"', 'near"the', "*", "-", "NEAR(", "title:x", '"unbalanced', "^ ~ ( )", "...", "'", "\\"]:
        found(index, q)
    assert found(index, "AND near") == ["a"] and found(index, "near", limit=1, offset=1) == []


def test_unfinished_generations_are_not_seen(make, tmp_path):
    docs, index = make
    index.build(docs(("a", "web", "A", "first")))
    (tmp_path / "index" / "00000002.writing" / "documents").mkdir(parents=True)
    assert found(index, "first") == ["a"]
    index.put(docs(("b", "web", "B", "first")))
    assert sorted(found(index, "first")) == ["a", "b"]


def test_a_query_reads_its_own_partitions(make):
    docs, index = make
    index.build(docs(*((str(i), "web", "t", f"word{i} other{i}") for i in range(200))))
    plan = index.search("other7").select("target", "score")._jdf.queryExecution().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert any("bucket" in a and "StringStartsWith(term,other7)" in b for a, b in filters)
    parts = {x["bucket"] for x in index.postings().select("bucket").distinct().collect()}
    assert len(parts) > 2 and max(parts) < 6


def test_ranks_as_search_over_texts(spark, make):
    docs, index = make
    r = random.Random(1)
    rows = [(str(i), "web", " ".join(r.choices("alpha beta gamma".split(), k=3)), " ".join(r.choices("alpha beta gamma delta alphabet be".split(), k=r.randrange(30)))) for i in range(80)]
    held = docs(*rows)
    index.build(held.limit(0))
    index.put(held.where("updated < 50"))
    index.put(held.where("updated >= 30"))
    near = lambda found: [(x["target"], round(x["score"], 9)) for x in found.collect()]
    for q in ["alpha", "alph beta", '"beta gamma" be', '"alpha alpha"', "delta gamma alpha"]:
        assert near(index.search(q)) == near(search.search(held, search.postings(held), q))


def test_a_task_holds_few_positions(monkeypatch):
    """However many documents a batch has, rows go on after a bounded number of positions."""
    import pyarrow as pa

    monkeypatch.setattr(index_module, "PLACES", 50)
    bodies = [[f"w{n}", "and"] * 10 for n in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{n}" for n in range(40)]), pa.array([["title"]] * 40), pa.array(bodies)], names=["target", "title", "body"])
    out = list(index_module._placed(iter([batch])))
    assert len(out) == 14 and all(sum(map(len, b["body"].to_pylist())) <= 70 for b in out)
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) == 120 and [r["body"] for r in rows if r["term"] == "w7"] == [list(range(0, 20, 2))]
