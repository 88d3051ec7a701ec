"""Hard negatives, importance resampling and binary packing against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tomespark.llm import binary_packing, hard_negatives, queries, resampling, tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
VECTORS = "vec_id long, embedding array<double>, label int, v string, d int, cell int, g int, part int, score string, x int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "v", 1, 2, 3, 4, "s", 5) for r in rows], VECTORS)


def mined(rows, every, positives=5, negatives=10):
    """Every pair, in plain integers."""
    held = {}
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(c is None or not math.isfinite(c) for c in vector):
            continue
        row = (label, [math.floor(256 * c) for c in vector])
        held[vec_id] = min(held.get(vec_id, row), row)
    out = set()
    for a, (label, v) in held.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in held.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            hard = [(n, i) for n, i, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out |= {(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(hard, 1)}
    return out


def test_hard_negatives_equal_brute_force(spark):
    r = random.Random(3)
    centres = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + r.uniform(-0.3, 0.3) for c in r.choice(centres)], r.randrange(3)) for i in range(600)]
    rows += [(i, rows[7][1], r.randrange(3)) for i in range(600, 800)]  # ties
    rows += [(i, [0.0] * 6, 1) for i in range(800, 810)]
    rows += [(3, [9.0] * 6, 7), (3, [9.0] * 6, 7), rows[20], rows[20]]  # repeated ids
    rows += [(900, None, 1), (905, [1.0] * 6, None), (None, [1.0] * 6, 1), (910, [1.0, None], 1), (915, [float("nan")] * 6, 1), (920, [float("inf")] * 6, 1)]
    rows += [(925, [0.9], 1), (930, [], 2)]  # shorter vectors
    got = hard_negatives.mine(vectors(spark, rows), every=5, group_rows=64, anchor_rows=40).collect()
    assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == mined(rows, 5)


def test_hard_negatives_of_large_components_are_exact(spark):
    r = random.Random(4)
    rows = [(i, [float(r.randrange(-(10**6), 10**6)) for _ in range(3)], r.randrange(2)) for i in range(60)]
    rows.append((100, [1e30, 0.0, 0.0], 0))
    got = {tuple(x) for x in hard_negatives.mine(vectors(spark, rows), every=4).collect()}
    assert got == mined(rows[:-1], 4)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(vectors(spark, []), every=1).collect() == []
    assert hard_negatives.mine(vectors(spark, [(1, [1.0], 1)]), every=100).collect() == []
    assert hard_negatives.mine(vectors(spark, [(0, [1.0], 1), (1, [1.0], 1)]), every=100).collect() == []


def test_brackets_hold_and_prune():
    r = np.random.default_rng(0)
    rows = np.concatenate([r.normal(c, 4, (300, 8)) for c in (-200, 0, 200)]).round()
    points = hard_negatives.Pivots(rows[::50], float((rows * rows).sum(axis=1).max()))
    a, x = object.__new__(hard_negatives._Side), object.__new__(hard_negatives._Side)
    a.ids, a.d = np.arange(30), points.distances(rows[:30], anchors=True)
    a.c = (rows[:30] ** 2).sum(axis=1) + points.radius2
    x.ids, x.d = np.arange(900), points.distances(rows)
    exact = rows[:30] @ rows.T
    for low, high in ((-np.inf, np.inf), (1000.0, 1e5), (3e5, 4e5)):
        may = hard_negatives._survivors(a, x, np.full(30, low), np.full(30, high), 1e-3)
        assert may[(exact >= low) & (exact <= high)].all()
    assert may.sum() < 0.5 * may.size


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in lower).split(" ")


def resampled(docs, target, percent, least):
    def buckets(text):
        ws = [w for w in words_of(text) if w]
        return len(ws), [zlib.crc32(x.encode()) % 10000 for x in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text)[1])
    for text in target:
        t.update(buckets(text)[1])
    all_s, all_t = sum(s.values()) + 10000.0, sum(t.values()) + 10000.0
    rows = []
    for doc_id, text in docs:
        n, found = buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in found) // len(found) if found else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, n, len(found), weight, score, None])
    may = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(may[: percent * len(may) // 100], 1):
        r[5] = rank
    return rows


def test_resampling_equals_brute_force(spark, make_docs):
    r = random.Random(5)
    vocabulary = ["Alpha", "beta", "Ünï", "漢字", "x9", "don't", "e-mail", "tail.", "\x00z", "ſ", "K"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "  ", "\n", "\t", ",", "　"]) for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(200)] + [(300, None), (301, ""), (302, " .,;"), (None, text(40))]
    docs += [(303, text(60))] * 3  # rows that repeat
    target = [text(30) for _ in range(10)] + [None, ""]
    held = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(make_docs(docs), held, percent=30).collect()
    want = resampled(docs, target, 30, 20)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    picked = [x["doc_id"] for x in resampling.drawn(make_docs(docs), held, percent=30).collect()]
    assert Counter(picked) == Counter(d for d, _ in docs if d is not None and any(w[0] == d and w[5] for w in want))


def test_resampling_of_nothing_and_of_longer_runs(spark, make_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(make_docs([]), none).collect() == []
    assert [tuple(x)[2:4] for x in resampling.resample(make_docs([(1, "a b c")]), none, longest=3).collect()] == [(6, math.floor(1000 * math.log(10006 / 20000)))]
    (n, found), = resampling.scan("a b c", longest=3)
    assert n == 3 and sorted(found) == sorted(zlib.crc32(x) % 10000 for x in (b"a", b"b", b"c", b"a b", b"b c", b"a b c"))


def test_segments_cut_between_words(monkeypatch):
    monkeypatch.setattr(resampling, "SEGMENT_BYTES", 7)
    text = "ab cde f" + "g" * 30 + " h  ij k" * 9
    found = [b for _, part in resampling.scan(text) for b in part]
    ws = text.split()
    assert sorted(found) == sorted(zlib.crc32(x.encode()) % 10000 for x in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])


def test_buckets_have_no_favourite_among_ties(spark, make_docs):
    rows = resampling.resample(make_docs([(i, "word " * 20) for i in range(40)]), spark.createDataFrame([("word",)], "text string"), percent=50).collect()
    assert len({x["weight"] for x in rows}) == 1
    order = sorted(rows, key=lambda x: (-x["score"], x["doc_id"]))
    assert [x["rank"] for x in order] == [*range(1, 21)] + [None] * 20


TEXTS = ["", None, "a", "Hello there,  world.\n\n It's 12 o'clock" * 40, "x" * 3000, " 　\x85 \t", "é漢字🙂 " * 700, "now <|endoftext|>  then <|endoftext|>", "word " * 1023, "word " * 1024]


def test_pieces_make_the_document_again(spark, make_docs):
    docs = list(enumerate(TEXTS)) + [(3, TEXTS[3])] * 2 + [(None, "tail")]
    rows = binary_packing.pack(make_docs(docs)).collect()
    ids = {i: TOKENIZER.encode(t or "", add_special_tokens=False).ids + [0] for i, t in docs}
    copies, met = Counter(i for i, _ in docs), defaultdict(list)
    for x in rows:
        part = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert len(part) == x["length"] and x["length"] & (x["length"] - 1) == 0 and x["length"] <= 1024
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == x["ids_crc32"]
        assert x["doc_tokens"] == len(ids[x["doc_id"]]) and x["offset"] == 0
        met[x["doc_id"]] += range(x["start"], x["start"] + x["length"])
    assert {i: sorted(m) for i, m in met.items()} == {i: sorted([*range(len(ids[i]))] * n) for i, n in copies.items()}
    order = sorted(rows, key=lambda x: x["sequence_id"])
    assert [x["sequence_id"] for x in order] == [*range(len(rows))]
    lengths = [x["length"] for x in order]
    assert lengths == sorted(lengths, reverse=True)


def test_shorter_sequences_and_no_rows(spark, make_docs):
    assert binary_packing.pack(make_docs([])).collect() == []
    assert sorted(x["length"] for x in binary_packing.pack(make_docs([(1, "a b c d e f")]), longest=4).collect()) == [1, 2, 4]
    assert [binary_packing.decomposition(n) for n in (1, 1023, 1024, 2050)] == [[1], [512, 256, 128, 64, 32, 16, 8, 4, 2, 1], [1024], [1024, 1024, 2]]
    with pytest.raises(ValueError):
        binary_packing.pack(make_docs([]), longest=1000)


def test_ids_of_parts_are_those_of_the_whole(monkeypatch):
    monkeypatch.setattr(tokens, "PART_CHARS", 5)
    r, encoder = random.Random(6), tokens.encoder()
    for _ in range(2000):
        text = "".join(r.choice("ab  \n\t.,'s1　\x85​\xa0é漢\x1c") for _ in range(r.randrange(40)))
        assert encoder.ids(text) == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_query_of_binary_packing_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op13_binary_packing"](spark, sf).collect()
    want = set()
    for i, text in docs.items():
        ids, at = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0], 0
        for length in binary_packing.decomposition(len(ids)):
            want.add((i, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()), len(ids)))
            at += length
    assert len(rows) == len(want) and {tuple(x)[:5] for x in rows} == want
    assert sorted(x["sequence_id"] for x in rows) == [*range(len(rows))]
