"""Blocks of posts: literal bodies, and random ones against a walk over their lines."""

import random
import re

from tomespark.operators import posts


def walked(body):
    lines = (body or "").rstrip("\n ").split("\n")
    signature = []
    for i in range(len(lines) - 1, max(len(lines) - 13, -1), -1):
        if lines[i] in ("-- ", "--"):
            signature, lines = lines[i + 1 :], lines[:i]
            break
    out, held = [], []
    quote = lambda x: x.lstrip(" ").startswith(">")

    def flush():
        if not held:
            return
        n = len(held)
        spaced = sum(bool(re.search(r"\S {3,}\S", x)) for x in held)
        if n < 2:
            pre = held[0].startswith("  ") or spaced
        else:
            pre = (all(len(x) < 50 for x in held) and n >= 3) or sum(x.startswith(("  ", "\t")) for x in held) * 2 > n or spaced * 3 > n
        out.append(("pre", n, "\n".join(held)) if pre else ("paragraph", n, " ".join(x.strip() for x in held)))
        held.clear()

    i = 0
    while i < len(lines):
        if quote(lines[i]):
            flush()
            run = []
            while i < len(lines) and (quote(lines[i]) or (not lines[i].strip() and i + 1 < len(lines) and quote(lines[i + 1]))):
                run.append(lines[i].strip().lstrip(">").strip())
                i += 1
            out.append(("quote", len(run), "\n".join(run).strip()))
            continue
        if lines[i].strip():
            held.append(lines[i].rstrip(" \t"))
        else:
            flush()
        i += 1
    flush()
    if "\n".join(signature).strip():
        out.append(("signature", len(signature), "\n".join(signature).strip()))
    return out or [("empty", 0, "(empty post)")]


def test_blocks_equal_a_walk(spark):
    r = random.Random(3)
    kinds = ["", "", "> said", ">> more", "  > set in", "a plain line of a post that is rather longer than fifty letters are", "short", "  indented", "\ttab", "col   umns   of", "--", "-- ", " ", "x "]
    bodies = ["\n".join(r.choice(kinds) for _ in range(r.randrange(22))) for _ in range(400)] + [None, "", "\n\n", "-- \nme", ">"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "target int, body string")
    got = {}
    for x in posts.body_blocks(rows).orderBy("target", "block_no").collect():
        got.setdefault(x["target"], []).append((x["kind"], x["lines"], x["text"]))
    for k, body in enumerate(bodies):
        assert got[k] == walked(body), (body, got[k])


def test_a_post(spark):
    body = "Jo wrote:\n> one\n>\n> two\n\n> three\n\nI think that this is right, and that there is\nnothing to be said against it at all in this.\n\nRoses are\nred, violets\nare blue\n-- \nJo\nhttp://jo"
    rows = spark.createDataFrame([(1, body)], "target int, body string")
    blocks = posts.body_blocks(rows)
    assert [(x["kind"], x["text"]) for x in blocks.orderBy("block_no").collect()] == [
        ("paragraph", "Jo wrote:"),
        ("quote", "one\n\ntwo\n\nthree"),
        ("paragraph", "I think that this is right, and that there is nothing to be said against it at all in this."),
        ("pre", "Roses are\nred, violets\nare blue"),
        ("signature", "Jo\nhttp://jo"),
    ]
    assert [tuple(x) for x in posts.quoted_share(blocks).collect()] == [(1, 5, 6)]
