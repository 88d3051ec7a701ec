"""Streams with state of their own, against the same rows in one batch."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from tomespark.operators import history
from tomespark.streaming import memory

LOG = "target string, pos long, seen_at timestamp, title string, kind string, forget boolean, under boolean"
T0 = datetime(2024, 1, 1)


@pytest.fixture
def streamed(spark, tmp_path):
    spark.conf.set(*memory.STATE_STORE)

    def run(rows, schema, work, mode, batches=4):
        """The rows that ``work`` gives, batch by batch; file k of the input is batch k."""
        size = -(-len(rows) // batches)
        for k in range(batches):
            part = spark.createDataFrame(rows[k * size : (k + 1) * size], schema)
            part.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{k}")
        out = []
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
        query = work(source).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend((n, *r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return out

    yield run
    spark.conf.unset(memory.STATE_STORE[0])


def test_history_of_a_shuffled_stream_equals_the_batch(spark, streamed):
    r = random.Random(1)
    rows = []
    for pos in range(240):
        target = f"t{r.randrange(12)}"
        forget = r.random() < 0.06
        rows.append((target, pos, T0 + timedelta(hours=3 * pos), None if forget else f"title {pos}", "web", forget, False))
    rows.append(("lone", 900, T0, None, None, True, False))
    r.shuffle(rows)  # tombstones come before and after what they wipe
    got = {}
    for _, target, first, last, opens, title, kind in sorted(streamed(rows, LOG, lambda s: memory.running_history(s, horizon_days=365), "update")):
        got[target] = (first, last, opens, title, kind)
    batch = history.history(history.without_forgotten(spark.createDataFrame(rows, LOG))).collect()
    want = {x["target"]: (x["first"], x["last"], x["opens"], x["title"], x["kind"]) for x in batch}
    assert {t: x for t, x in got.items() if x[2]} == want
    assert all(got[t][2] == 0 for t in set(got) - set(want)) and "lone" in got


def test_old_visits_are_folded(spark, streamed):
    rows = [("a", k, T0 + timedelta(days=k), f"t{k}", "web", False, False) for k in range(100)]
    got = sorted(streamed(rows, LOG, lambda s: memory.running_history(s, horizon_days=10), "update"))
    assert got[-1][1:] == ("a", T0, T0 + timedelta(days=99), 100, "t99", "web")


def test_things_shown_lately_are_not_fresh(spark, streamed):
    schema = "user string, target string, seen_at timestamp"
    rows = [("u", f"x{k}", T0 + timedelta(minutes=k)) for k in range(310)]
    rows += [("u", "x0", T0 + timedelta(minutes=400)), ("u", "x300", T0 + timedelta(minutes=401)), ("v", "x300", T0 + timedelta(minutes=402)), ("u", "x300", T0 + timedelta(days=40))]
    got = {(x[1], x[2], x[4]): x[3] for x in streamed(rows, schema, memory.shown_lately, "append", batches=3)}
    assert len(got) == len(rows)
    for user, target, at in rows[:310]:
        assert got[user, target, at]
    assert [got[x] for x in rows[310:]] == [True, False, True, True]


def test_one_value_a_day(spark, streamed):
    schema = "key string, seen_at timestamp, value string"
    rows = [("m", T0, "other")] + [("k", T0 + timedelta(hours=h), f"v{h}") for h in range(0, 72, 5)]
    got = {(x[1], x[2]): x[3] for x in streamed(rows, schema, memory.once_a_day, "append", batches=3)}
    assert got == {("k", T0 + timedelta(hours=h)): f"v{min(g for g in range(0, 72, 5) if g // 24 == h // 24)}" for h in range(0, 72, 5)} | {("m", T0): "other"}
