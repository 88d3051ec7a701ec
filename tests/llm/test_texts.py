"""Token counts, packing, quality rules, decontamination and license scans."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tomespark.llm import decontaminate, license_scan, packing, quality_rules, token_counts
from tomespark.llm.tokens import counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made(n, seed, pool=3000):
    draw = random.Random(seed)
    return [f"word{draw.randrange(pool)}" for _ in range(n)]


ODD = [None, "", " ", "\n\n", "a", "Zoë's naïve café — 12,345.67! next", "日本語のテキスト", "  lead and trail  ", "x" * 5000, "tab\tand\r\nbreak", " 　wide  ", "don't I'll we've", "🙂🙂 ok"]


def test_counts_equal_the_tokenizer():
    c = counter()
    for text in [*ODD, " ".join(made(500, 1)), "".join(random.Random(3).choices(" \n\t.,'aé1  ", k=3000))]:
        assert c.count(text) == len(c.encoding.encode_ordinary(text or ""))


def lengths_of(rows):
    return [len(counter().encoding.encode_ordinary(t or "")) for _, t, *_ in rows]


def test_histogram(make_docs):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(50 + k, " ".join(made(3 + k * k, k))) for k in range(40)] + [(7, "twin"), (7, "twin")]
    lengths = lengths_of(rows)
    table = token_counts.length_table(make_docs(rows), block=16)
    got = table.collect()
    assert {r["n_tokens"]: r["n_docs"] for r in got} == Counter(lengths)
    for r in got:
        n = r["n_tokens"]
        assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["docs_up_to"] == sum(x <= n for x in lengths) and r["tokens_kept"] == sum(min(x, n) for x in lengths)
        assert r["docs_truncated"] == sum(x > n for x in lengths) and r["total_tokens"] == sum(lengths)
    limits = [1, 5, 100, 10**6]
    for r in token_counts.truncated_totals(table, limits).collect():
        assert r["tokens_kept"] == sum(min(x, r["limit"]) for x in lengths) and r["docs_truncated"] == sum(x > r["limit"] for x in lengths)
    for r in token_counts.quantiles(table, [0.1, 0.5, 0.99, 1.0]).collect():
        assert r["n_tokens"] == min(x for x in lengths if sum(y <= x for y in lengths) >= r["share"] * len(lengths) - 1e-9)


def test_histogram_of_nothing(make_docs):
    table = token_counts.length_table(make_docs([]))
    assert table.count() == 0 and token_counts.truncated_totals(table, [10]).count() == 0


def test_packing_is_whole(make_docs):
    rows = [(k, " ".join(made(5 + 37 * k, k))) for k in range(60)] + [(100, None), (101, ""), (102, " ".join(made(9000, 8))), (103, "same"), (103, "same"), (None, "lost id")]
    got = [r.asDict() for r in packing.pack(make_docs(rows), shard_pieces=25).collect()]
    whole = Counter()
    for (doc, *_), n in zip(rows, lengths_of(rows)):
        whole[doc] += n
    placed = Counter()
    for r in got:
        placed[r["doc_id"]] += r["n_tokens"]
    assert placed == whole
    assert sum(r["bin_id"] is None for r in got) == 2
    bins = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["offset"])
        at = 0
        for r in held:
            assert r["offset"] == at
            at += r["n_tokens"]
        assert {r["capacity"] for r in held} == {min(c for c in packing.CAPACITIES if c >= at)}


def fixed_plan(lengths, only):
    """Best fit with one capacity to open (the next that holds a longer piece), then downsized: what it costs."""
    contents, open_bins = [], []
    for n in lengths:
        fits = [k for k, room in enumerate(open_bins) if room >= n]
        if fits:
            k = min(fits, key=lambda k: open_bins[k])
        else:
            k = len(contents)
            contents.append(0)
            open_bins.append(min(c for c in packing.CAPACITIES if c >= max(only, n)))
        contents[k] += n
        open_bins[k] -= n
    return sum(packing.cost(min(c for c in packing.CAPACITIES if c >= n)) for n in contents)


def joint_cost(lengths):
    bins, sizes = packing.plan(lengths)
    contents = Counter()
    for b, n in zip(bins.tolist(), lengths):
        contents[b] += n
    assert set(contents) == set(range(len(sizes))) and all(sizes[b] == min(c for c in packing.CAPACITIES if c >= n) for b, n in contents.items())
    return sum(packing.cost(int(c)) for c in sizes)


def test_the_joint_plan_beats_each_fixed_one():
    """No shard is dearer than under the best fixed plan, and all together are cheaper than under each."""
    sums = Counter()
    for seed in range(12):
        draw = random.Random(seed)
        shapes = (lambda: draw.choice([draw.randrange(1, 8193), draw.randrange(1, 900), 1024]), lambda: min(8192, 1 + int(draw.lognormvariate(6.4, 0.9))), lambda: draw.choice([700, 1100, 2100]) + draw.randrange(9))
        lengths = sorted((shapes[seed % 3]() for _ in range(600)), reverse=True)
        cost, fixed = joint_cost(lengths), {c: fixed_plan(lengths, c) for c in packing.CAPACITIES}
        assert cost <= min(fixed.values())
        sums["joint"] += cost
        for c, x in fixed.items():
            sums[c] += x
    assert all(sums["joint"] < sums[c] for c in packing.CAPACITIES)


def test_the_joint_plan_on_the_documents():
    parquet = pytest.importorskip("pyarrow.parquet")
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not __import__("os").path.exists(folder):
        pytest.skip("no test data")
    lengths = []
    for text in parquet.read_table(folder, columns=["text"]).column("text").to_pylist():
        n = counter().count(text)
        lengths += [8192] * (n // 8192) + [n % 8192] * (n % 8192 > 0)
    lengths.sort(reverse=True)
    assert all(joint_cost(lengths) <= fixed_plan(lengths, c) for c in packing.CAPACITIES)


def test_best_fit_against_all_plans():
    """Few pieces: no plan of all is cheaper by more than a fifth."""

    def all_plans(pieces):
        if not pieces:
            yield []
            return
        head, *rest = pieces
        for plan in all_plans(rest):
            for k in range(len(plan)):
                yield [*plan[:k], plan[k] + head, *plan[k + 1 :]]
            yield [*plan, head]

    capacities = (4, 8, 16)
    for seed in range(25):
        pieces = sorted((random.Random(seed * 7 + k).randrange(1, 17) for k in range(7)), reverse=True)
        price = lambda plan: sum(packing.cost(min(c for c in capacities if c >= n)) for n in plan)
        best = min(price(p) for p in all_plans(pieces) if max(p) <= 16)
        _, sizes = packing.plan(pieces, capacities)
        assert sum(packing.cost(int(c)) for c in sizes) <= 1.2 * best


def test_copies_spread_over_shards(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    rows = [(None, "same words here")] * 60 + [(1, "other text of some words")] * 5
    got = packing.pack(make_docs(rows), shard_pieces=8).collect()
    assert Counter(r["doc_id"] for r in got) == {None: 60, 1: 5}
    shards = Counter(r["bin_id"] >> 32 for r in got)
    assert len(shards) >= 6 and max(shards.values()) < 25


def test_packing_nothing(make_docs):
    assert packing.pack(make_docs([])).count() == 0


def brute_counts(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def quality_docs():
    rows = [(k, "\n".join(" ".join(made(12, 50 * k + j)) for j in range(6 + k % 5)), "en" if k % 3 else "fr", f"s{k % 2}") for k in range(200)]
    rows += [(500 + k, " ".join("".join(random.Random(k * 99 + j).choices("%$#*&ab", k=40)) for j in range(80)), "en", "s1") for k in range(4)]
    rows += [(600, None), (601, ""), (602, "a b c " * 40), (603, "same line here\n" * 30, None, None), (604, "é ü " * 3), (605, "🙂 " * 70, "xx", "yy"), (606, "x\ty\x0bz\r\n" * 2), (None, " ".join(made(70, 9)))]
    return rows + [rows[0], (3, rows[3][1], "fr", "s1")]


def test_base_counts(make_docs):
    rows = quality_docs()
    got = quality_rules.judge(make_docs(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *brute_counts(t)) for d, t, *_ in rows), key=str)


def test_windows_of_one_number_are_compared_by_words(make_docs, monkeypatch):
    """With two bits of hash left nearly all windows share a number, and still only equal words count."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", "62")
    rows = quality_docs()
    got = quality_rules.text_counts(make_docs(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *brute_counts(t)) for d, t, *_ in rows), key=str)


def test_chi_square():
    """Against sums over fine steps of the density."""
    import math

    for k in (5, 7):
        density = lambda x: x ** (k / 2 - 1) * math.exp(-x / 2) / (2 ** (k / 2) * math.gamma(k / 2))  # noqa: E731, B023
        total = 0.0
        for i in range(30_000):
            total += density((i + 0.5) / 1000) / 1000
            if i % 4999 == 0:
                assert abs(quality_rules.chi_square((i + 1) / 1000, k) - total) < 1e-5
    assert abs(quality_rules.chi_square(quality_rules.quantile(0.975, 5), 5) - 0.975) < 1e-9
    assert 1.3 < quality_rules.consistency(0.75) < 1.5 and quality_rules.consistency(1.0) == 1.0


def test_outliers_go_and_clean_documents_stay(make_docs):
    rows = quality_docs()
    got = {r["doc_id"]: r for r in quality_rules.judge(make_docs(rows)).collect()}
    assert all(got[k]["kept"] for k in range(200))
    assert not any(got[500 + k]["kept"] for k in range(4))
    assert not got[600]["kept"] and not got[602]["kept"]
    docs = make_docs(rows)
    kept = quality_rules.kept_rows(docs)
    assert kept.columns == docs.columns and not {500, 600, 602} & {r["doc_id"] for r in kept.collect()}


def test_estimate_against_numpy(make_docs, spark):
    """One group, a third of it far off: concentration over exact ranks, from the same starts, ends at the same verdicts."""
    np = pytest.importorskip("numpy")
    rows = [(k, "\n".join(" ".join(made(10, 70 * k + j)) for j in range(6 + k % 9))) for k in range(120)] + [(900 + k, "$%#& " * 30 + " ".join(made(90, k))) for k in range(40)]
    got = {r["doc_id"]: r for r in quality_rules.judge(make_docs(rows)).where("NOT base_failed").collect()}
    ids = sorted(got)

    def vector(r):
        n = r["n_words"]
        return [np.log(r["word_chars"] / n), *(np.log1p(100 * r[c] / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")), np.log(n)]

    x = np.array([vector(got[k]) for k in ids])
    floor = np.diag(np.square(quality_rules.FLOORS))
    h = int(np.ceil(quality_rules.SUBSET * len(x)))

    def squares(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def estimate(rows, factor):
        return x[rows].mean(axis=0), factor * np.cov(x[rows].T, bias=True) + floor

    middle = np.median(x, axis=0)
    starts = [(middle, np.diag((1.4826 * np.median(np.abs(x - middle), axis=0)) ** 2) + floor), estimate(np.arange(len(x)), 1.0)]
    starts.append((starts[1][0], np.diag(np.diag(starts[1][1]))))
    best = None
    for now in starts:
        for _ in range(50):
            now = estimate(np.argsort(squares(*now), kind="stable")[:h], quality_rules.consistency(quality_rules.SUBSET))
        if best is None or np.linalg.det(now[1]) < np.linalg.det(best[1]):
            best = now
    within = np.flatnonzero(squares(*best) <= quality_rules.quantile(quality_rules.REWEIGHT, 5))
    d2 = squares(*estimate(within, quality_rules.consistency(quality_rules.REWEIGHT)))
    assert [bool(v <= quality_rules.quantile(1 - quality_rules.TAIL, 5)) for v in d2] == [got[k]["kept"] for k in ids]
    assert {k for k in ids if not got[k]["kept"]} == {900 + k for k in range(40)}
    assert all(abs(np.sqrt(v) - got[k]["distance"]) < 0.1 + 0.05 * np.sqrt(v) for v, k in zip(d2, ids))


def test_small_groups_are_judged_with_their_language(make_docs):
    rows = [(k, " ".join(made(80, k)), "en", f"s{k // 40}") for k in range(120)] + [(500, " ".join(made(80, 500)), "en", "rare"), (501, "%$# " * 80 + " ".join(made(100, 501)), "en", "rare")]
    rows += [(600, " ".join(made(80, 600)), "xx", None), (601, "%$# " * 80 + " ".join(made(100, 601)), None, None)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(make_docs(rows)).collect()}
    assert {k for k, v in got.items() if not v} == {501, 601}


def test_no_document_passes_the_base_rule(make_docs):
    assert [r["kept"] for r in quality_rules.judge(make_docs([(1, "a"), (2, None)])).collect()] == [False, False]
    assert quality_rules.judge(make_docs([])).count() == 0


def plain(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def brute_leaks(docs, items, overlap=20, identity=0.8, shortest=8):
    found = {}
    for doc, text, *_ in docs:
        w = plain(text)
        for item, other in items:
            v = plain(other)
            if not v:
                continue
            size = min(overlap, len(v))
            need = identity * size if len(v) >= shortest else size
            best = None
            for at in range(-len(v) + 1, len(w)):
                e = [0 <= at + i < len(w) and w[at + i] == x for i, x in enumerate(v)]
                for s in range(len(v) - size + 1):
                    same = sum(e[s : s + size])
                    if same >= need - 1e-9 and (best is None or (same, -(at + s)) > best):
                        best = same, -(at + s)
            if best:
                found[doc, item] = size, best[0], -best[1]
    return found


def leak_rows():
    items = [(k, " ".join(made(16 + 4 * k, 700 + k)).capitalize() + ".") for k in range(8)] + [(50, "too short to seed"), (51, None), (52, ""), (53, "one two three four five six seven"), (54, "lonely"), (55, "Too short, to seed!"), (None, "an item without id")]
    draw = random.Random(5)
    docs = [(k, " ".join(made(60, k))) for k in range(20)]
    for k in range(8):
        w = items[k][1].lower().rstrip(".").split()
        for changes in (0, 2, 4, 9):
            v = list(w)
            for i in draw.sample(range(len(v)), changes):
                v[i] = f"other{i}"
            docs.append((100 + 10 * k + changes, " ".join(made(30, k + 500) + v + made(30, k + 600)).upper()))
    docs += [(310, " ".join(made(30, 91)) + " too short to seed " + " ".join(made(900, 92)) + " one two three four five six seven"), (311, "one two three four other six seven"), (312, "lonely"), (313, "it is an item without id")]
    docs += [(314, " ".join(made(5000, 93) + items[5][1].lower().rstrip(".").split()[:-2])), (315, (items[4][1].rstrip(".") + " ") * 40)]
    docs += [(300, None), (301, ""), (302, items[6][1][:200]), (303, "; ".join(items[7][1].split()) * 2), (None, items[3][1]), (304, items[2][1]), (304, items[2][1])]
    return docs, items


def test_leaks(make_docs, spark):
    docs, items = leak_rows()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1)).withColumn("iw", F.lit(1))
    got = decontaminate.leaks(make_docs(docs), bench).collect()
    assert sorted(map(tuple, decontaminate.leaks(make_docs(docs), bench, broadcast_seeds=0).collect()), key=str) == sorted(map(tuple, got), key=str)
    want = brute_leaks(docs, items)
    found = {(r["doc_id"], r["item_id"]): (r["n_overlap"], r["n_same"], r["start"]) for r in got}
    assert found == want
    clean = decontaminate.without_leaks(make_docs(docs), bench)
    leaked = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, *_ in docs if d not in leaked)


def test_masks_hit_every_stretch_with_four_substitutions():
    from itertools import combinations

    for gone in combinations(range(20), 4):
        bad = set(gone)
        assert any(all(p + o not in bad for o in m) for m in decontaminate.MASKS for p in range(20 - m[-1]))


def test_masks_hit_every_short_item():
    from itertools import combinations

    for size in range(decontaminate.SHORTEST, 21):
        for gone in combinations(range(size), size // 5):
            assert any(all(p + o not in gone for o in m) for m in decontaminate.MASKS for p in range(size - m[-1])), (size, gone)


def test_leaks_of_nothing(make_docs, spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(make_docs([(1, "a b c d e f g h i j k l")]), empty).count() == 0
    assert decontaminate.leaks(make_docs([]), spark.createDataFrame([(1, " ".join(made(20, 1)))], "item_id long, text string")).count() == 0


def test_increasing_against_brute_force():
    from itertools import combinations

    for seed in range(40):
        v = random.Random(seed).sample(range(9), 9)
        got = [v[i] for i in license_scan.increasing(v)]
        assert got == sorted(set(got))
        assert len(got) == max(n for n in range(1, 10) for c in combinations(v, n) if list(c) == sorted(c))


def test_alignment_is_ordered_and_true():
    for seed in range(30):
        a, b = made(40, seed, 25), made(60, seed + 100, 25)
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert license_scan.align(a, a) == [(i, i) for i in range(40)]


def test_licenses(make_docs):
    draw = random.Random(2)
    text = license_scan.catalogue()
    worn = [w if draw.random() > 0.1 else "thing" for w in text["mit"].split()]
    rows = [(1, text["mit"]), (2, " ".join(made(333, 4) + text["isc"].upper().split() + made(50, 5))), (3, " ".join(worn)), (4, " ".join(made(900, 6)))]
    rows += [(5, None), (6, ""), (7, text["mit"] + "\n" + " ".join(made(400, 7)) + "\n" + text["mit"]), (8, " ".join(sorted(text["mit"].split()))), (None, text["gpl-3.0-header"]), (9, text["isc"]), (9, text["isc"])]
    rows += [(10, "x " + text["mit"] + "\n" + text["mit"]), (11, text["gpl-3.0"]), (12, "a " * 50 + text["apache-2.0"] + " b" * 50)]
    got = Counter((r["doc_id"], r["license"]) for r in license_scan.scan(make_docs(rows)).collect())
    want = {(1, "mit"): 1, (2, "isc"): 1, (3, "mit"): 1, (7, "mit"): 2, (None, "gpl-3.0-header"): 1, (9, "isc"): 2, (10, "mit"): 2, (11, "gpl-3.0"): 1, (12, "apache-2.0"): 1}
    # The long texts end with the notice that they tell authors to use.
    assert {k: n for k, n in got.items() if k[1] in ("mit", "isc", "gpl-3.0", "apache-2.0") or k[0] is None} == want
    assert got[11, "gpl-3.0-header"] == 1 and got[12, "apache-2.0-header"] == 1
    assert license_scan.scan(make_docs([])).count() == 0


def scanned(make_docs, lines):
    """The licenses and passages of each line."""
    out = {k: [] for k in range(len(lines))}
    for r in license_scan.scan(make_docs(list(enumerate(lines)))).collect():
        out[r["doc_id"]].append((r["license"], r["end"] - r["start"]))
    return out


def test_licenses_that_differ_in_a_name(make_docs):
    lines = {
        "Released under the GPL License.": [],
        "released under the new License of the town": [],
        "Distributed under the MIT License.": ["mit-notice"],
        "Licensed under CC BY-SA 4.0.": [],
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc-4.0-notice"],
        "This work is licensed under the GNU General Public License, version 2.": [],
        "This work is licensed under the GNU Lesser General Public License, version 3.": [],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0-notice"],
        "Licensed under the Mozilla Public License, Version 2.0.": [],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": [],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["cc-by-sa-4.0-notice"],
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["cc-by-4.0-notice"],
        "This work is licensed under a Creative Commons Attribution 3.0 International License.": [],
    }
    got = scanned(make_docs, list(lines))
    assert {line: [name for name, _ in got[k]] for k, line in enumerate(lines)} == lines


def test_every_template_is_itself_alone(make_docs):
    """All templates against all, whole and with a twelfth of the words of the long ones worn."""
    every = license_scan.catalogue()
    draw = random.Random(9)
    wear = lambda t: " ".join(w if draw.random() > 0.08 else "thing" for w in t.split())
    worn = {k: wear(t) for k, t in every.items() if len(license_scan.words_of(t)) > license_scan.NAMED_WORDS or k in ("mit", "isc")}
    got = scanned(make_docs, [*every.values(), *worn.values()])
    for k, name in enumerate([*every, *worn]):
        size = len(license_scan.words_of(every[name]))
        assert [x for x, n in got[k] if n > 0.7 * size] == [name], name
        # What lies within a text is a notice or header of the same license.
        assert all(x.split("-")[0] == name.split("-")[0] for x, _ in got[k]), (name, got[k])


def test_licenses_at_every_place(make_docs):
    """Wherever a template stands, the span found is where it was put."""
    t = license_scan.catalogue()["isc"]
    n = len(license_scan.words_of(t))
    rows = [(k, " ".join(made(k, k) + [t] + made(40, k + 1))) for k in range(0, 120, 7)]
    got = {r["doc_id"]: (r["start"], r["end"], r["coverage"]) for r in license_scan.scan(make_docs(rows)).where("license = 'isc'").collect()}
    assert got == {k: (k, k + n, 1.0) for k, _ in rows}


def test_no_window_cuts_a_passage():
    """Wherever a notice stands, all of it is found."""
    for name in ("mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "isc"):
        template = license_scan.templates_of({name: license_scan.catalogue()[name]})[0]
        n = len(template.words)
        for place in range(0, 4 * n, 1 if n < 20 else 13):
            assert license_scan.matches(["other"] * place + template.words, template) == [(place, place + n, n)]


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_scan_against_brute_force():
    """Planted passages, worn, with stray template words about them or side by side: found where they were put, and nothing else.

    The brute force is the longest common subsequence of the template and a stretch of text. Where a template
    repeats words, patience alignment may fall short of it: one in fifty passages at most.
    """
    planted = found = 0
    for seed in range(200):
        draw = random.Random(seed)
        words = [f"t{draw.randrange(22 if seed % 2 else 60)}" for _ in range(30)]
        template = license_scan.templates_of({"x": " ".join(words)})[0]
        text, want = [], []
        for _ in range(draw.randrange(4)):
            if draw.random() < 0.6:
                text += [f"n{draw.randrange(900)}" if draw.random() > 0.06 else draw.choice(words) for _ in range(draw.randrange(1, 90))]
            worn = [w if draw.random() > 0.08 else f"n{draw.randrange(900)}" for w in words]
            if common(words, worn) >= 24:
                want.append((len(text), len(text) + 30))
            text += worn
        text += [f"n{draw.randrange(900)}" for _ in range(draw.randrange(40))]
        got = license_scan.matches(text, template)
        for first, end, n in got:
            assert 24 <= n <= common(words, text[first:end]) and any(min(end, b) - max(first, a) >= 24 for a, b in want)
        planted += len(want)
        found += len(got)
        # Left unmatched, no stretch covers the template, save for the passages that were missed.
        masked = list(text)
        for first, end, _ in got:
            masked[first:end] = ["-"] * (end - first)
        dense = [i for i in range(0, len(masked), 10) if common(words, masked[i : i + 40]) >= 24]
        assert not dense or len(got) < len(want)
    assert 0.98 * planted <= found <= planted
