"""Draws that can be repeated: every choice is a hash of a seed and a row's key."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) for each key."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def weighted_order(rows: DataFrame, key: str, weight: str, seed: int) -> DataFrame:
    """``rank``: a random order without replacement in which weights are chances to come first."""
    draw = -F.log(uniform(seed, F.col(key))) / F.col(weight)
    ranked = rows.where(F.col(weight) > 0).withColumn("draw", draw)
    return ranked.orderBy("draw", key)


def one_per_kind(rows: DataFrame, kind: str, key: str, seed: int, k: int = 1) -> DataFrame:
    """k rows of each kind at random. Later ranks are dropped before the shuffle."""
    order = Window.partitionBy(kind).orderBy(uniform(seed, F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


@dataclass(frozen=True)
class Dice:
    """NdM with what is kept of it, added or taken away."""

    sign: int
    count: int
    sides: int
    keep: int
    high: bool


_TERM = re.compile(r"([+-]?)\s*(?:(\d*)d(\d+)(?:k([hl])(\d+))?|(\d+))", re.I)


def parse_dice(text: str) -> list[Dice]:
    """2d6+1, 4d6kh3, d20 - 2. At most 100 dice of 2 to 1000 sides; constants have 0 sides."""
    at, out = 0, []
    plain = text.replace(" ", "")
    while at < len(plain):
        m = _TERM.match(plain, at)
        if not m or m.end() == at or (out and not m[1]):
            raise ValueError(f"not a throw of dice: {text!r}")
        sign = -1 if m[1] == "-" else 1
        if m[6]:
            out.append(Dice(sign, int(m[6]), 0, 0, True))
        else:
            count, sides = int(m[2] or 1), int(m[3])
            keep = int(m[5]) if m[5] else count
            if not 1 <= count <= 100 or not 2 <= sides <= 1000 or not 1 <= keep <= count:
                raise ValueError(f"dice out of range: {text!r}")
            out.append(Dice(sign, count, sides, keep, (m[4] or "h").lower() == "h"))
        at = m.end()
    if not out:
        raise ValueError("no dice")
    return out


def rolled(text: str, seed: int, *key: Column) -> Column:
    """The total of a throw for each key."""
    total = F.lit(0).cast("long")
    for n, d in enumerate(parse_dice(text)):
        if not d.sides:
            total = total + d.sign * d.count
            continue
        rolls = F.transform(F.sequence(F.lit(1), F.lit(d.count)), lambda i: 1 + F.pmod(F.xxhash64(F.lit(seed), F.lit(n), i, *key), F.lit(d.sides)))  # noqa: B023
        kept = F.slice(F.sort_array(rolls, not d.high), 1, d.keep)
        total = total + d.sign * F.aggregate(kept, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return total


def oracle(roll: Column, chance: int) -> Column:
    """yes or no on a hundred-sided die, with a twist on 100 and multiples of 11."""
    answer = F.when(roll <= chance, "yes").otherwise("no")
    return F.concat(answer, F.when((roll == 100) | ((roll % 11 == 0) & (roll >= 11)), " twist").otherwise(""))


def hexagram_lines(seed: int, *key: Column) -> Column:
    """Six lines of three coins each: 6, 7, 8 or 9, from the bottom."""
    coin = lambda line, c: 2 + F.pmod(F.xxhash64(F.lit(seed), line, F.lit(c), *key), F.lit(2))
    return F.transform(F.sequence(F.lit(1), F.lit(6)), lambda line: coin(line, 1) + coin(line, 2) + coin(line, 3))


def changed_lines(lines: Column) -> Column:
    """Moving lines (6 and 9) turned into their opposites."""
    return F.transform(lines, lambda x: F.when(x == 6, 7).when(x == 9, 8).otherwise(x))
