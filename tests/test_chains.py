"""Chains of next links and shuffle bags."""

import random
from collections import Counter

from tomespark.operators import bags, chains

LINKS = "id long, next long"


def walked(links):
    """Every chain, walked page by page."""
    following = {}
    for i, n in links:
        if i is not None:
            known = [x for x in (following.get(i), n) if x is not None]
            following[i] = min(known) if known else None
    before = {}
    for i, n in sorted(following.items()):
        if n is not None and n != i and n in following:
            before.setdefault(n, i)
    after = {b: a for a, b in before.items()}
    out = set()
    for head in (i for i in following if i not in before):
        place, at = 1, head
        while at is not None:
            out.add((at, head, place, False))
            place, at = place + 1, after.get(at)
    for i in sorted(set(following) - {x[0] for x in out}):
        if i not in {x[0] for x in out}:
            place, at = 1, i
            while (at, i, place, True) not in out and (place == 1 or at != i):
                out.add((at, i, place, True))
                place, at = place + 1, after[at]
    return out


def test_chains_equal_a_walk(spark):
    r = random.Random(4)
    links = [(i, r.choice([None, i, *range(90)])) for i in range(80)]
    ring = list(range(200, 237))
    r.shuffle(ring)
    links += list(zip(ring, ring[1:] + ring[:1]))
    long_ = list(range(1000, 1333))
    r.shuffle(long_)
    links += list(zip(long_, long_[1:])) + [(long_[-1], None), (500, 501), (501, 500), (600, 600), (None, 3), (5, 7), (5, 7)]
    got = chains.chained(spark.createDataFrame(links, LINKS))
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == walked(links)
    sizes = {x["head"]: (x["cycle"], x["pages"], x["last"]) for x in chains.chain_sizes(got).collect()}
    assert sizes[long_[0]] == (False, 333, long_[-1]) and sizes[200][:2] == (True, 37) and sizes[500] == (True, 2, 501)
    more = chains.continued(got, spark.createDataFrame([(long_[3],), (long_[329],)], "id long"))
    assert [x["id"] for x in more.orderBy("place").collect()] == long_[330:]


def test_long_chains_are_shortened_before_they_are_ranked(spark):
    """Paths, forks and rings in every order, shortened until doubling has almost nothing to do; moved pages grow as the pages do."""
    r = random.Random(8)
    up, mixed, ring, pair = list(range(100)), list(range(200, 420)), list(range(500, 590)), [700, 701]
    r.shuffle(mixed), r.shuffle(ring)
    zigzag = [x for k in range(40) for x in (800 + k, 1000 - k)]
    links = [x for c in (up, mixed, zigzag) for x in zip(c, [*c[1:], None])] + [x for c in (ring, pair) for x in zip(c, c[1:] + c[:1])]
    links += [(i, r.choice(mixed)) for i in range(1100, 1140)]
    rows = [tuple(x) for x in chains.chained(spark.createDataFrame(links, LINKS), few=4).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == walked(links)
    every = spark.range(4000).selectExpr("id", "nullif(id - 1, -1) AS back", "CAST(id > 0 AS LONG) AS reach")
    short, gone = chains._shortened(every, 100)
    assert short.count() <= 100 and short.count() + sum(x.count() for x in gone) == 4000
    assert len(gone) <= 14 and gone[0].count() > 1100


def test_chains_of_nothing(spark):
    assert chains.chained(spark.createDataFrame([], LINKS)).collect() == []
    assert [tuple(x) for x in chains.chained(spark.createDataFrame([(1, None)], LINKS)).collect()] == [(1, 1, 1, False)]


WEIGHTS = {"big": 3, "a": 1, "b": 2, "c": 1, "d": 2}


def test_bags_of_many_users(spark):
    users = bags.new_users(spark.range(100_000).withColumnRenamed("id", "user"))
    rows = bags.draw(users, WEIGHTS, 27, seed=3).collect()
    assert len(rows) == 100_000
    for x in rows:
        d = x["drawn"]
        assert all(a != b for a, b in zip(d, d[1:]))
        for k in range(3):
            assert Counter(d[9 * k : 9 * k + 9]) == WEIGHTS
        assert (x["bag"], x["bags"], x["last"]) == ([], 3, d[-1])
    assert len({tuple(x["drawn"][:5]) for x in rows}) > 50  # orders differ
    assert sum(x["drawn"][0] == "big" for x in rows) < 40_000


def test_draws_go_on_from_their_state(spark):
    users = bags.new_users(spark.range(50).withColumnRenamed("id", "user"))
    at_once = {x["user"]: x["drawn"] for x in bags.draw(users, WEIGHTS, 20, seed=3).collect()}
    step = bags.draw(users, WEIGHTS, 7, seed=3)
    first = {x["user"]: x["drawn"] for x in step.collect()}
    rest = {x["user"]: x["drawn"] for x in bags.draw(step.drop("drawn"), WEIGHTS, 13, seed=3).collect()}
    assert {u: first[u] + rest[u] for u in first} == at_once
    gone = bags.draw(step.drop("drawn"), {"a": 1, "b": 2}, 30, seed=3).collect()
    assert all(set(x["drawn"]) == {"a", "b"} for x in gone)
    assert all(x["drawn"] == [] for x in bags.draw(users, {}, 5).collect())
    assert all(x["drawn"] == ["only"] * 5 for x in bags.draw(users, {"only": 2}, 5).collect())


def test_repeats_are_moved_apart():
    r = random.Random(5)
    for _ in range(500):
        bag = list("aaabbcde")
        r.shuffle(bag)
        out = bags.spread(bag)
        assert sorted(out) == sorted(bag) and all(x != y for x, y in zip(out, out[1:]))
    assert bags.spread(["a", "a"]) == ["a", "a"] and bags.not_first(["a", "a"], "a") == ["a", "a"]
    assert bags.not_first(["a", "b", "a"], "a")[0] == "b"


def test_sections(spark):
    none = bags.new_users(spark.range(200).withColumnRenamed("id", "user"))
    pool = list("abcdef")
    first = bags.sections(none, pool, 4, ["a"], seed=1)
    for x in first.collect():
        assert len(set(x["drawn"])) == 4 and "a" not in x["drawn"] and sorted(x["drawn"] + x["bag"]) == pool
    for x in bags.sections(first.select("user", "bag", "bags"), pool, 9, ["a"], seed=1).collect():
        assert sorted(x["drawn"]) == list("bcdef") and x["bags"] == 2
    assert all(x["drawn"] == [] for x in bags.sections(none, pool, 3, pool).collect())
