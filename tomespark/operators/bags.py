"""Shuffle bags: families dealt to many users in rounds by weight.

A bag holds every family as often as it weighs, dealt in rounds: all families
once, then those worth a second place, and so on, each round in an order of its
own. Equal names are moved apart, and the first of a bag is not the last of the
one before. All orders come from a hash of seed, user, bag and place, so a draw
can be repeated, and users are drawn for where their rows lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _order(names: list[str], *key: object) -> list[str]:
    """An order of ``names`` that depends on the key only."""
    return sorted(names, key=lambda n: hashlib.blake2b("\x1f".join(map(str, (*key, n))).encode(), digest_size=8).digest())


def _apart(bag: list[str], i: int) -> bool:
    return (i == 0 or bag[i] != bag[i - 1]) and (i + 1 == len(bag) or bag[i] != bag[i + 1])


def spread(bag: list[str]) -> list[str]:
    """The bag with equal names apart, where that can be: a name that meets itself goes to the nearest place later, then earlier, where it is alone."""
    out: list[str] = []
    held: list[str] = []
    for name in bag:
        # What was held back comes first as soon as it may.
        for waiting in list(held):
            if not out or out[-1] != waiting:
                out.append(waiting)
                held.remove(waiting)
        (held if out and out[-1] == name else out).append(name)
    for waiting in held:
        places = [i for i in range(len(out) + 1) if (i == 0 or out[i - 1] != waiting) and (i == len(out) or out[i] != waiting)]
        out.insert(places[-1] if places else len(out), waiting)
    return out


def not_first(bag: list[str], last: str | None) -> list[str]:
    """The bag with something else than ``last`` in front, if it holds anything else; equal names stay apart if they can."""
    if len(bag) < 2 or bag[0] != last:
        return bag
    others = [i for i in range(1, len(bag)) if bag[i] != last]
    for i in others:
        swapped = list(bag)
        swapped[0], swapped[i] = bag[i], bag[0]
        if _apart(swapped, 0) and _apart(swapped, i):
            return swapped
    if others:
        bag = list(bag)
        bag[0], bag[others[0]] = bag[others[0]], bag[0]
    return bag


def fresh(weights: dict[str, int], *key: object) -> list[str]:
    """A new bag."""
    rounds = max((max(w, 1) for w in weights.values()), default=0)
    dealt = [n for r in range(1, rounds + 1) for n in _order([n for n, w in weights.items() if max(w, 1) >= r], *key, r)]
    return spread(dealt)


def _drawn(user: object, bag: list[str], bags: int, last: str | None, weights: dict[str, int], n: int, seed: int) -> tuple[list[str], list[str], int, str | None]:
    bag, out = [x for x in bag if x in weights], []
    while weights and len(out) < n:
        # Where only the last name is left, the next bag joins this one.
        if not bag or all(x == last for x in bag):
            bag, bags = bag + fresh(weights, seed, user, bags), bags + 1
        bag = not_first(bag, last)
        last = bag.pop(0)
        out.append(last)
    return out, bag, bags, last


def draw(states: DataFrame, weights: dict[str, int], n: int, seed: int = 0) -> DataFrame:
    """(user, drawn, bag, bags, last, ...): the next ``n`` families of every user, and the state after them.

    ``states`` has a row per user: what is left of the bag, how many bags were
    begun, and the last name drawn; nulls stand for a user who has drawn nothing.
    A family that is gone leaves the bag; no family draws nothing. Other columns
    stay, so that what was drawn before need not be joined again.
    """
    kinds = dict(states.dtypes)
    more = [c for c in states.columns if c not in ("user", "drawn", "bag", "bags", "last")]
    named = dict(sorted(weights.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_drawn(user, bag or [], bags or 0, last, named, n, seed) for user, bag, bags, last in zip(*(c.to_pylist() for c in batch.columns[:4]))]
            lists = pa.list_(pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((lists, lists, pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[4:]], names=["user", "drawn", "bag", "bags", "last", *more])

    held = states.select("user", F.col("bag").cast("array<string>"), F.col("bags").cast("long"), F.col("last").cast("string"), *more)
    return held.mapInArrow(run, ", ".join([f"user {kinds['user']}, drawn array<string>, bag array<string>, bags long, last string", *(f"`{c}` {kinds[c]}" for c in more)]))


def counts(drawn: DataFrame) -> DataFrame:
    """(user, family, n): how often each family is among what a user has drawn (user, drawn), counted where it lies."""
    times = F.transform(F.array_distinct("drawn"), lambda f: F.struct(f.alias("family"), F.size(F.filter("drawn", lambda x: x == f)).cast("long").alias("n")))
    return drawn.select("user", F.explode(times).alias("x")).select("user", "x.family", "x.n")


def new_users(users: DataFrame) -> DataFrame:
    """States of users (user) who have drawn nothing."""
    return users.select("user", F.array().cast("array<string>").alias("bag"), F.lit(0).cast("long").alias("bags"), F.lit(None).cast("string").alias("last"))


def sections(states: DataFrame, pool: list[str], n: int, exclude: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(user, drawn, bag, bags): up to ``n`` different kinds from each user's bag, none of ``exclude``, which stay in the bag; it is refilled when it runs out."""
    kind = dict(states.dtypes)["user"]
    allowed = [k for k in pool if k not in (exclude or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for user, bag, bags in zip(*(c.to_pylist() for c in batch.columns)):
                bag, bags, out = [k for k in bag or [] if k in pool], bags or 0, []
                while len(out) < min(n, len(allowed)):
                    at = next((i for i, k in enumerate(bag) if k in allowed and k not in out), None)
                    if at is None:
                        bag, bags = bag + _order(pool, seed, user, bags), bags + 1
                    else:
                        out.append(bag.pop(at))
                rows.append((out, bag, bags))
            lists = pa.list_(pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((lists, lists, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["user", "drawn", "bag", "bags"])

    held = states.select("user", F.col("bag").cast("array<string>"), F.col("bags").cast("long"))
    return held.mapInArrow(run, f"user {kind}, drawn array<string>, bag array<string>, bags long")
