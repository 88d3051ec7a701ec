"""Line dedup, substring dedup and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tomespark.llm import common, line_dedup, ngram_join, substring_dedup
from tomespark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made(n, seed, pool=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(pool)}" for _ in range(n)]


def brute_substrings(rows, window=50):
    first = {}
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def substring_rows():
    passage, other = made(70, 1), made(120, 2)
    long = made(6000, 3)
    rows = [(k, " ".join(made(30 + 7 * k, 100 + k) + (passage if k % 2 else []) + made(20, 200 + k))) for k in range(14)]
    rows += [(20, " ".join(long)), (21, "\t".join(long[500:3000])), (22, "x " * 400), (23, "x " * 55), (24, " ".join(other * 3)), (25, " ".join(other[:60] + made(5, 9) + other[40:]))]
    rows += [(26, None), (27, ""), (28, " \n "), (None, " ".join(passage)), (30, " ".join(passage)), (30, " ".join(passage)), (31, "é\x0bñ " * 60), (32, "ü" * 600 + " " + " ".join(passage)), (-5, " ".join(made(49, 5)))]
    return rows


def test_substrings(make_docs):
    rows = substring_rows()
    got = substring_dedup.cut_repeats(make_docs(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows)


def test_removed_intervals_are_maximal(make_docs):
    rows = substring_rows()
    for r in substring_dedup.cut_repeats(make_docs(rows)).collect():
        ends = [(x["start"], x["end"]) for x in r["removed"]]
        assert sum(b - a for a, b in ends) == r["n_removed"]
        assert all(b < c for (_, b), (c, _) in zip(ends, ends[1:]))


def test_substrings_of_nothing(make_docs):
    assert substring_dedup.cut_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("window,anchor", [(50, 16), (8, 3)])
def test_equal_windows_have_equal_anchors(window, anchor):
    import numpy as np

    passage = np.arange(1000, 1000 + window + 5, dtype=np.uint64)
    a = np.concatenate((np.arange(40, dtype=np.uint64), passage, np.arange(60, 90, dtype=np.uint64)))
    b = np.concatenate((np.arange(500, 517, dtype=np.uint64), passage))
    owner = lambda h, at: next((k, at - f) for k, _, f, n in zip(*substring_dedup.runs_of(h, window, anchor)) if f <= at < f + n)
    for k in range(6):
        assert owner(a, 40 + k)[0] == owner(b, 17 + k)[0]


def test_segments_and_pieces_change_no_hash(monkeypatch):
    from tomespark.llm import hashing

    texts = [t or "" for _, t, *_ in substring_rows()] + ["x" * 3000 + " y " + "é" * 900, "  " * 200, " a\tb" * 300]
    whole = [(hashing.word_hashes(t.encode()).tolist(), [x.tolist() for x in hashing.word_bounds(t.encode())]) for t in texts]
    monkeypatch.setattr(hashing, "BLOCK_BYTES", 600)
    assert all(b"".join(hashing.pieces(t.encode())) == t.encode() for t in texts)
    assert [(hashing.word_hashes(t.encode()).tolist(), [x.tolist() for x in hashing.word_bounds(t.encode())]) for t in texts] == whole
    hashes = hashing.word_hashes(" ".join(made(400, 3)).encode())
    anchor_of = lambda: {f + k: a for a, _, f, n in zip(*substring_dedup.runs_of(hashes, 50, 16)) for k in range(n)}
    before = anchor_of()
    monkeypatch.setattr(substring_dedup, "SEGMENT", 37)
    assert anchor_of() == before and len(before) == 351


def test_hot_keys_are_joined_apart(make_docs, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = substring_rows()
    got = substring_dedup.cut_repeats(make_docs(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows)


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_lines(rows, least):
    seen = defaultdict(set)
    for n, (_, text, *_) in enumerate(rows):
        for line in (text or "").split("\n"):
            seen[line_key(line)].add(n)
    gone = {k for k, v in seen.items() if k and len(v) >= least}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in gone]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def line_rows():
    rows = [(k, f"Read More \n own line {k}\n\tÉTÉ\r\n" + ("twice\ntwice\n" if k < 9 else "TWICE\n")) for k in range(10)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "read more"), (None, "READ MORE\nx"), (24, "x" * 100_000 + "\n" + "y\n" * 20_000), (25, "a\nb"), (25, "a\nb"), (26, "ı\nİ"), (27, "read more")]
    return rows


def test_lines(make_docs):
    rows = line_rows()
    for least in (2, 10, 11, 100):
        got = line_dedup.drop_repeated_lines(make_docs(rows), least).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute_lines(rows, least)


def test_lines_count_documents_by_id(make_docs):
    docs = make_docs([(1, "one\nboth")] * 10 + [(k, "both\nfew") for k in (2, 2, 3)] + [(None, "both\nnone")] * 5)
    got = line_dedup.drop_repeated_lines(docs, 3, by_id=True).select("doc_id", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "one")] * 10 + [(2, "few")] * 2 + [(3, "few")] + [(None, "none")] * 5, key=str)
    assert sorted(r["text"] for r in line_dedup.with_kept_lines(docs, 3, by_id=True).collect()) == sorted(["one"] * 10 + ["few"] * 3 + ["none"] * 5)


def test_kept_lines_keep_the_columns(make_docs):
    docs = make_docs(line_rows())
    got = line_dedup.with_kept_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert {r["marked"] for r in got.collect()} == {1}
    assert line_dedup.with_kept_lines(make_docs([])).count() == 0


def brute_links(rows, threshold=0.8):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, least.get(root(i)), links[i]) for i, (doc, *_) in enumerate(rows)), key=str)


def near_rows():
    draw = random.Random(4)
    rows = []
    for group in range(8):
        base = made(60 + 40 * group, 300 + group)
        for copy in range(6):
            w = list(base)
            for _ in range(draw.randrange(0, 5)):
                w[draw.randrange(len(w))] = f"new{draw.randrange(999)}"
            rows.append((100 * group + copy, " ".join(w)))
    rows += [(1000 + k, " ".join(made(80, 900 + k))) for k in range(30)]
    same = " ".join(made(90, 77))
    rows += [(2000 + k, same.replace(" ", " \n" if k % 2 else " ")) for k in range(40)]
    tie = made(13, 55)  # 9 shingles; 10 words on, 8 of 10 are shared
    rows += [(3000, " ".join(tie)), (3001, " ".join(tie[:-1])), (3002, "one two"), (3003, "one two"), (3004, "one"), (3005, None), (3006, ""), (3007, " ")]
    rows += [(3100, " ".join(made(9000, 78))), (3101, " ".join(made(9000, 78) + ["end"])), (3200, same), (3200, same)]
    return rows


@pytest.mark.parametrize("block", [4096, 5])
def test_links(make_docs, block):
    rows = near_rows()
    got = ngram_join.link(make_docs(rows), block=block).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows)


def test_links_with_hot_keys_and_small_blocks_of_words(make_docs, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_WORDS", 300)
    rows = near_rows()
    got = ngram_join.link(make_docs(rows)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows)


def test_lines_with_hot_keys(make_docs, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = line_rows()
    got = line_dedup.drop_repeated_lines(make_docs(rows)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows, 10)


def test_one_stays_of_each_class(make_docs):
    rows = near_rows()
    docs = make_docs(rows)
    kept = ngram_join.one_per_class(docs)
    assert kept.columns == docs.columns
    want = sorted({c if links else d for d, c, links in brute_links(rows)})
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_null_ids_link(make_docs):
    same = " ".join(made(30, 5))
    rows = ngram_join.link(make_docs([(None, same), (None, same), (7, " ".join(made(30, 6))), (None, None)])).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in rows) == [("7", 0), ("None", 0), ("None", 1), ("None", 1)]
    pair = {r["class_id"] for r in rows if r["n_links"]}
    assert len(pair) == 1 and pair.pop() < 0
    assert ngram_join.link(make_docs([])).count() == 0


def test_pruning_by_posterior():
    assert ngram_join.least_matches(16, 0.8, 1e-6) < 16 * 0.8
    assert ngram_join.least_matches(96, 0.8, 1e-6) > ngram_join.least_matches(16, 0.8, 1e-6)
    assert ngram_join.least_matches(16, 0.8, 1e-12) <= ngram_join.least_matches(16, 0.8, 1e-2)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r["node"]: r["class"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = spark.createDataFrame([(7, k) for k in range(10, 60)] + [(k, 60) for k in range(70, 90)] + [(59, 60)] + [(200, 201)], "a long, b long")
    got = {r["node"]: r["class"] for r in components(edges).collect()}
    assert got == {k: 7 for k in [7, *range(10, 61), *range(70, 90)]} | {200: 200, 201: 200}
