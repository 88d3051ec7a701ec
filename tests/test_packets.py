"""Packets of many users and days against a plain program."""

import hashlib
import random
from collections import defaultdict
from datetime import date, timedelta

from tomespark.operators import bags, packets

SHOWN = "user long, target string, feed string, shelf string, at date"


def hashed(*names):
    return hashlib.md5("|".join(map(str, names)).encode()).hexdigest()


def chosen(items, shown, day, places, seed):
    """One user's periodicals, shelf by shelf and feed by feed."""
    lately = [x for x in shown if day - timedelta(days=30) < x[4] <= day]
    gone = {x[1] for x in lately}
    feeds = defaultdict(list)
    for user, target, feed, shelf, published, title in items:
        if title and target not in gone:
            feeds[shelf, feed].append((published, target, user))
    last = lambda k, name: max((x[4] for x in lately if x[k] == name), default=date.min)
    if not feeds:
        return []
    user = next(iter(feeds.values()))[0][2]
    shelves = sorted({s for s, _ in feeds}, key=lambda s: (last(3, s), hashed(seed, user, s)))
    out, used = [], set()
    for _ in range(2):
        for shelf in shelves:
            left = sorted((f for s, f in feeds if s == shelf and f not in used), key=lambda f: (last(2, f), hashed(seed, user, f)))
            if len(out) < places and left:
                newest = sorted(sorted(feeds[shelf, left[0]], key=lambda x: x[1]), key=lambda x: x[0], reverse=True)[:3]
                out.append((newest[int(hashed(seed, user, left[0])[:8], 16) % len(newest)][1], left[0], shelf))
                used.add(left[0])
    return out


def test_packets_of_several_days(spark):
    r = random.Random(7)
    days = [date(2024, 3, 1) + timedelta(days=k) for k in (0, 1, 2, 40)]
    items = []
    for user in range(30):
        for n in range(r.choice([0, 3, 12, 60])):
            feed = f"f{r.randrange(8)}"
            items.append((user, f"i{user}-{n}", feed, f"s{int(feed[1:]) // 2 if user % 3 else 0}", r.randrange(50), r.choice(["title", "title", ""])))
    pools = [(k, n, f"{k}{n}") for k in "abcdef" for n in range(4 if k == "a" else 30)]
    queue = [(u, n, f"q{u}-{n}", n < 2) for u in range(0, 30, 2) for n in range(r.choice([1, 4]))]
    item_rows = spark.createDataFrame(items, "user long, target string, feed string, shelf string, published long, title string").cache()
    pool_rows = spark.createDataFrame(pools, "kind string, nth long, target string")
    queue_rows = spark.createDataFrame(queue, "user long, n int, target string, done boolean")
    shown, state, memory = spark.createDataFrame([], SHOWN), bags.new_users(spark.range(30).withColumnRenamed("id", "user")), defaultdict(list)
    for day in days:
        drawn = bags.sections(state, list("abcdef"), 4, seed=1)
        rows = packets.packets(item_rows, drawn, pool_rows, queue_rows, shown, day, seed=5).collect()
        kinds = {x["user"]: x["drawn"] for x in drawn.collect()}
        mine = defaultdict(list)
        for x in sorted(rows, key=lambda x: x["place"]):
            mine[x["user"]].append(x)
        for user in range(30):
            want = [("periodical", *x) for x in chosen([i for i in items if i[0] == user], memory[user], day, 3, 5)]
            gone = {x[1] for x in memory[user] if day - timedelta(days=30) < x[4] <= day}
            for kind in kinds[user]:
                pool = [t for k, _, t in pools if k == kind]
                tries = [pool[int(hashed(5, user, kind, day.isoformat(), n)[:8], 16) % len(pool)] for n in range(3)]
                want += [(kind, t, None, None) for t in [t for t in tries if t not in gone][:1]]
            want += [("queue", t, None, None) for t in [t for u, n, t, done in queue if u == user and not done][:1]]
            assert [(x["kind"], x["target"], x["feed"], x["shelf"]) for x in mine[user]] == want
            assert [x["place"] for x in mine[user]] == [*range(1, len(want) + 1)]
            assert len({x["target"] for x in mine[user]}) == len(want) and not gone & {x["target"] for x in mine[user] if x["kind"] != "queue"}
            memory[user] += [(user, t, f, s, day) for k, t, f, s in want if k != "queue"]
        packet = spark.createDataFrame([tuple(x) for x in rows], "user long, place int, kind string, target string, feed string, shelf string")
        kept = packets.remembered(shown, packet, day).collect()
        shown = spark.createDataFrame([tuple(x) for x in kept], SHOWN)
        state = spark.createDataFrame([tuple(x) for x in drawn.select("user", "bag", "bags").collect()], "user long, bag array<string>, bags long")
    assert all(x["at"] > days[-1] - timedelta(days=30) for x in kept)


def test_bags_keep_other_columns_and_are_counted_where_they_lie(spark):
    from tomespark.operators import bags

    weights = {"a": 2, "b": 1}
    first = bags.draw(bags.new_users(spark.range(40).withColumnRenamed("id", "user")), weights, 4, seed=3)
    again = bags.draw(first.withColumnRenamed("drawn", "before"), weights, 2, seed=3)
    together = {r["user"]: r["drawn"] for r in bags.draw(bags.new_users(spark.range(40).withColumnRenamed("id", "user")), weights, 6, seed=3).collect()}
    assert {r["user"]: r["before"] + r["drawn"] for r in again.collect()} == together
    counted = bags.counts(again)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert {(r["user"], r["family"]): r["n"] for r in counted.collect()} == {(r["user"], f): r["drawn"].count(f) for r in again.collect() for f in set(r["drawn"])}
