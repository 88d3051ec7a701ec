"""WARC round trips and main text extraction."""

import base64
import gzip
import hashlib
import html.parser
import io
import os
import random
import re
import uuid
from collections import Counter

import pytest

from tomespark.llm import html_extract, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload int, refers_to string")


def archive_rows():
    draw = random.Random(1)
    big = "".join(draw.choices("abcdefgh é\n", k=3000))
    rows = [(k, f"http://a.example/{k}?q=1%0A&r=é", f"<p>page {k}</p>" * (k + 1)) for k in range(30)]
    rows += [(100 + k, "http://b.example/", big) for k in range(12)] + [(200, None, None), (201, "u\r\nx", ""), (202, "u", "x" * 999), (203, "u", "x" * 999), (204, "u", "é" * 500), (205, "u", "é" * 500)]
    return rows + [(300, "long", "<p>" + "z y " * 400_000), (None, "lost", big), (111, "http://b.example/", big), (310, "u", "WARC/1.1\r\n\r\n" * 200)]


def brute_records(rows):
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    top = {}
    for p, b in raw:
        if p is not None and len(b) >= 1000:
            top[b] = max(top.get(b, p), p)
    out = []
    for p, b in raw:
        to = top.get(b)
        again = to is not None and p != to
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archived(spark):
    folder = warc.archive_folder(spark)
    warc.archive_pages(pages(spark, archive_rows()), folder)
    return folder


def test_records_come_back(spark, archived):
    rows = archive_rows()
    got = warc.read_archives(spark, archived).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_records(rows)
    texts = {(p, u): (h or "").encode() for p, u, h in rows}
    for r in got:
        assert (r["page_id"], r["url"]) in texts
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == texts[r["page_id"], r["url"]]


def files(folder):
    path = folder.removeprefix("file://")
    return [os.path.join(path, x) for x in sorted(os.listdir(path)) if x.endswith(".warc.gz")]


def test_a_gzip_member_holds_one_record(archived):
    for name in files(archived):
        raw = open(name, "rb").read()
        heads = raw.count(b"\x1f\x8b\x08")
        plain = gzip.decompress(raw)
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and heads >= 1
        records = list(warc.read_archive(io.BytesIO(raw), name, True))
        assert all(len(r) == 7 for r in records)


def test_damage_is_an_error():
    made = warc.record(1, "u", b"payload " * 50, None) + warc.record(2, "u", b"other", None)
    assert len(list(warc.read_archive(io.BytesIO(made), "x", True))) == 2
    text = gzip.decompress(warc.record(1, "u", b"payload", None))
    for bad in (text.replace(b"payload", b"payl0ad"), text.replace(b"Content-Length: 7", b"Content-Length: 8"), text[:-3], text[:60], text + b"more"):
        with pytest.raises(ValueError, match="x: .* at byte 0"):
            list(warc.read_archive(io.BytesIO(gzip.compress(bad)), "x", True))
    with pytest.raises(Exception):
        list(warc.read_archive(io.BytesIO(made[:-4]), "x", True))


def test_records_are_whole():
    text = gzip.decompress(warc.record(1, "u", b"payload", None, "2026-01-02T03:04:05Z")).decode()
    for field in ("WARC/1.1", "WARC-Type: response", "WARC-Record-ID: <urn:page:1>", "WARC-Date: 2026-01-02T03:04:05Z", "WARC-Target-URI: u", "Content-Type: application/http", "Content-Length: "):
        assert field in text
    head = gzip.decompress(warc.info("a.warc.gz", "2026-01-02T03:04:05Z")).decode()
    assert "WARC-Type: warcinfo" in head and "WARC-Filename: a.warc.gz" in head


def test_archives_of_other_writers():
    """No digests, other digests, other kinds of records, no HTTP message, chunks of a transfer, percent signs in addresses."""

    def made(lines, body):
        return gzip.compress("\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nbody"
    hexed = hashlib.sha256(b"body").hexdigest()
    raw = made(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"software: x\r\n")
    raw += made(["WARC-Type: request", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n")
    raw += made(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: <http://a/%25?q=%0A>", "Content-Type: application/http; msgtype=response"], http)
    raw += made(["WARC-Type: response", "WARC-Payload-Digest: sha256:" + hexed, "WARC-Block-Digest: md5:" + hashlib.md5(http).hexdigest(), "Content-Type: application/http"], http)
    raw += made(["WARC-Type: resource", "Content-Type: text/plain", "WARC-Payload-Digest: blake3:xyz"], b"plain text\r\n\r\nmore")
    raw += made(["WARC-Type: response", "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + "A" * 32], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n")
    raw += made(["WARC-Type: revisit", "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"body").hexdigest()], b"HTTP/1.1 304 Not Modified\r\n\r\n")
    got = list(warc.read_archive(io.BytesIO(raw), "x", True))
    assert [(r[2], r[6]) for r in got] == [("response", b"body"), ("response", b"body"), ("resource", b"plain text\r\n\r\nmore"), ("response", b"4\r\nbody\r\n0\r\n\r\n"), ("revisit", None)]
    assert got[0][1] == "http://a/%25?q=%0A" and got[0][0] is None and got[4][5] == hashlib.sha1(b"body").hexdigest()
    for bad in (made(["WARC-Type: response", "WARC-Payload-Digest: sha256:" + "0" * 64, "Content-Type: application/http"], http), gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n"), gzip.compress(b"WARC/1.0\r\n" + b"x" * (3 << 20)), made(["WARC-Type: response", "Content-Type: application/http"], b"HTTP/1.1 200 OK\r\nx: " + b"x" * (3 << 20))):
        with pytest.raises(ValueError, match="x: .* at byte 0"):
            list(warc.read_archive(io.BytesIO(bad), "x", True))


def test_jobs_in_one_folder_and_overwriting(spark):
    folder = warc.archive_folder(spark)
    warc.register(spark)
    frame = lambda ids: spark.createDataFrame([(k, "u", bytearray(b"x"), None) for k in ids], "page_id long, url string, payload binary, refers_to long")
    frame(range(3)).write.format("warc").mode("append").save(folder)
    path = folder.removeprefix("file://")
    os.makedirs(f"{path}/_waiting-other")  # another job's
    frame(range(3, 6)).write.format("warc").mode("append").save(folder)
    assert sorted(r["page_id"] for r in warc.read_archives(spark, folder).collect()) == list(range(6))
    assert [x for x in os.listdir(path) if x.startswith("_waiting")] == ["_waiting-other"]
    frame([9]).write.format("warc").mode("overwrite").save(folder)
    assert [r["page_id"] for r in warc.read_archives(spark, folder).collect()] == [9]


def test_digests_are_stated():
    text = gzip.decompress(warc.record(9, "u", b"body", None))
    assert b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()) in text


def test_archives_of_nothing(spark):
    folder = f"{warc.archive_folder(spark)}-{uuid.uuid4().hex}"
    warc.archive_pages(pages(spark, []), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_archives_are_of_bounded_size(spark):
    folder = warc.archive_folder(spark)
    warc.register(spark)
    df = spark.createDataFrame([(k, "u", bytearray(os.urandom(2000)), None) for k in range(50)], "page_id long, url string, payload binary, refers_to long").coalesce(1)
    df.write.format("warc").option("archiveBytes", 10_000).mode("append").save(folder)
    assert len(files(folder)) >= 9 and warc.read_archives(spark, folder).count() == 50


ARTICLE = "The whole of the story is that it was for the people who had to be there with all of their own and that they were in it from the first to the last of its days."

CASES = {
    "empty": (None, ""),
    "plain": (f"<article><h1>Title</h1><p>{ARTICLE}</p></article>", f"Title\n{ARTICLE}"),
    "chrome": (f"<nav><a href=x>Home</a></nav><header>Site</header><main><p>{ARTICLE}<p>Short end.</main><aside>{ARTICLE}</aside><footer>© all</footer>", f"{ARTICLE}\nShort end."),
    "entities": ("<article><p>A &amp; B&nbsp;&eacute; &#8212; &#x41;&lt;p&gt;</p></article>", "A & B é — A<p>"),
    "space": ("<article><p>one\n\t two <b>three</b>\n<br>four</p></article>", "one two three four"),
    "scripts": ("<article><script>var a='</p><p>no';</script><style>p{}</style><p>yes</p><noscript>no</noscript></article>", "yes"),
    "comments": (f"<article><p>{ARTICLE}</p></article><div class='comments'><p>{ARTICLE} said a reader</p></div>", ARTICLE),
    "marked": (f"<div class='post'><p>{ARTICLE}</p><div class='ad'>Buy it now</div><div id='newsletter'><form>mail <input></form></div></div>", ARTICLE),
    "bare": (f"<body><p>{ARTICLE} {ARTICLE}</p><p>Between the two.</p><p>{ARTICLE} {ARTICLE}</p><p><a href=x>More of the site</a></p></body>", f"{ARTICLE} {ARTICLE}\nBetween the two.\n{ARTICLE} {ARTICLE}"),
    "alone on its page": (f"<body><p>{ARTICLE}</p><p><a href=x>More of the site</a></p></body>", ARTICLE),
    "unclosed": ("<article><p>a <b>b<p>c<ul><li>d<li>e</ul>f", "a b\nc\nd\ne\nf"),
    "less-than": ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    "note": ("<article><!-- <p>no</p> --><p>yes</p></article><!-- open", "yes"),
    "table": ("<article><table><tr><td>one<td>two<tr><td>three</table></article>", "one\ntwo\nthree"),
    "cut": ("<article><p>yes</p><p cla", "yes"),
}


MORE = f"{ARTICLE} {ARTICLE}"
CASES |= {
    "misleading names": (f"<body><div id='related-work'><p>{MORE}</p></div><div class='comment-policy'><p>{MORE} © A. Writer</p></div></body>", f"{MORE}\n{MORE} © A. Writer"),
    "a mark of rights is no rule": (f"<body><div><p>{MORE}</p><p>© by them: {MORE}</p></div></body>", f"{MORE}\n© by them: {MORE}"),
    "long comments": (f"<article><p>Short.</p></article><div class='post-comments'><p>{MORE}</p><p>{MORE}</p></div>", "Short."),
    "long footer and sidebar": (f"<div><h2>Head</h2><p>{MORE}</p></div><aside><p>{MORE}</p></aside><footer><p>{MORE}</p></footer>", f"Head\n{MORE}"),
    "the only prose has a name": (f"<div class='widget'><p>{MORE}</p></div>", MORE),
    "form around it all": (f"<form><nav><a href=x>Menu</a></nav><article><p>Yes.</p></article><p>{MORE}</p></form>", "Yes."),
    "links in an article": ("<article><p>One.</p><p><a href=x>All of this is a link</a></p><ul><li><a href=x>Menu</a></li></ul><p>Two.</p></article>", "One.\nAll of this is a link\nTwo."),
    "hidden": (f"<article><p>Yes.</p><p style='display: none'>no</p><p hidden>no</p><p>a <span aria-hidden=true>no</span> b</p></article>", "Yes.\na\nb"),
    "no stop words known": (f"<html lang=xx><body><p>{'zuk lam ' * 30}</p><p>{'zuk lam ' * 10}</p><p><a>{'zuk lam ' * 30}</a></p></body></html>", f"{('zuk lam ' * 30).strip()}\n{('zuk lam ' * 10).strip()}"),
    "few stop words": (f"<html lang=en><body><p>{MORE}</p><p>{'zuk lam ' * 30}</p></body></html>", MORE),
}


class Cutter(html.parser.HTMLParser):
    """Blocks of a well-formed page: text, length of its links, path of elements."""

    def __init__(self, page):
        super().__init__()
        self.path, self.blocks, self.held, self.language = [], [], [], ""
        self.feed(page)
        self.end()

    def end(self):
        text = " ".join("".join(t for t, _ in self.held).split())
        if text:
            linked = " ".join("".join(t for t, a in self.held if a).split())
            self.blocks.append((text, len(linked), list(self.path)))
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self.end()
        if tag == "html":
            self.language = dict(attrs)["lang"]
        self.path.append((tag, dict(attrs).get("class", ""), len(self.blocks), self.getpos()))

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.end()
        self.path.pop()

    def handle_data(self, data):
        self.held.append((data, any(x[0] == "a" for x in self.path)))


def brute_text(page):
    """The two passes again, block by block, looking each neighbour up afresh."""
    cut = Cutter(page)
    stops = set(html_extract.STOP_WORDS[cut.language].split())
    rows = []
    for text, linked, path in cut.blocks:
        tags = [x[0] for x in path]
        names = [x[1] for x in path]
        aside = "tag" if {"nav", "aside", "footer"} & set(tags) else "name" if {"ad", "user-comments", "sidebar-left"} & set(names) else ""
        inside = "article" in tags or "post-body" in names
        doubt = "comment-policy" in names
        marks = [x for x in path if x[0] in ("nav", "aside", "footer", "article") or x[1]]
        # Of nested marks, the innermost that adds something makes the region.
        home, known = (), set()
        for x in marks:
            adds = {"tag"} if x[0] in ("nav", "aside", "footer") else {"text"} if x[0] == "article" or x[1] == "post-body" else {"doubt"} if x[1] == "comment-policy" else {"name"}
            if adds == {"name"} and "tag" in known:
                adds = set()
            if not adds <= known:
                home = x[3]
            known |= adds
        words = re.findall(r"[^\W\d_]+", text.lower())
        share = sum(w in stops for w in words) / len(words) if words else 0
        if linked > (0.8 if inside else 0.2) * len(text) or (linked and len(text) < 70 and not inside):
            kind = "linked"
        elif len(text) < 70:
            kind = "short"
        elif share < 0.15:
            kind = "poor" if share >= 0.01 else "none"
        else:
            kind = "good" if share >= 0.2 and len(text) > 200 else "near"
        plain = "good" if 5 * linked <= len(text) and share >= 0.2 and len(text) > 200 else ""
        rows.append((text, aside, inside, doubt, home, bool({"p", "h2"} & set(tags[-2:])), "h2" in tags[-3:], kind, plain))
    believe = any(r[2] or (r[8] and not r[1]) for r in rows)
    rows = [r for r in rows if not r[1] or (r[1] == "name" and not believe)]
    first = []
    for _, _, inside, doubt, _, prose, heading, kind, _ in rows:
        if kind == "linked":
            first.append("open" if inside and prose else "bad")
        elif kind in ("poor", "none"):
            first.append("open" if inside or (prose and kind == "poor") else "bad")
        elif kind == "near":
            first.append("open" if doubt and not inside else "near")
        else:
            first.append("open" if kind == "short" else kind)

    def look(labels, i, step):
        j = i + step
        while 0 <= j < len(rows):
            if rows[j][4] == rows[i][4] and labels[j] in ("good", "bad"):
                return labels[j]
            j += step

    def passes(first):
        second = list(first)
        for i, label in enumerate(first):
            if label != "open":
                continue
            _, _, inside, _, _, prose, heading, _, _ = rows[i]
            b, a = look(first, i, -1), look(first, i, 1)
            j = i - 1 if b == "bad" else i + 1
            near = 0 <= j < len(rows) and first[j] == "near" and rows[j][4] == rows[i][4]
            if inside:
                b, a = b or "good", a or "good"
            if b and a:
                second[i] = b if a == b else a if heading else "good" if inside or prose or near else "bad"
            elif b or a:
                second[i] = (b or a) if prose else "bad"
        return ["good" if x == "near" and (rows[i][2] or (look(second, i, -1), look(second, i, 1)) != ("bad", "bad")) else "bad" if x == "near" else x for i, x in enumerate(second)]

    last = passes(first)
    if "good" not in last:
        last = passes(["good" if x == "near" and r[5] else x for r, x in zip(rows, first)])
    if "good" not in last:
        last = ["good" if x != "bad" and r[5] else "bad" for r, x in zip(rows, first)]
    return "\n".join(r[0] for r, x in zip(rows, last) if x == "good")


def drawn_page(seed):
    draw = random.Random(seed)
    stops, others = html_extract.STOP_WORDS["en"].split(), ["zuk", "lamor", "penti", "orglat"]

    def words(n, share):
        return " ".join(draw.choice(stops if draw.random() < share else others) for _ in range(n))

    def block():
        text = words(draw.choice([2, 6, 14, 25, 60, 90]), draw.choice([0.05, 0.17, 0.5]))
        if draw.random() < 0.25:
            text += f" <a>{words(draw.choice([1, 4, 30]), 0.3)}</a>" if draw.random() < 0.7 else f"<b>{words(2, 0.5)}</b>"
        tag = draw.choice(["p", "p", "p", "h2", "li"])
        return f"<ul><li>{text}</li></ul>" if tag == "li" else f"<{tag}>{text}</{tag}>"

    def part(depth):
        body = "".join(part(depth + 1) if depth < 3 and draw.random() < 0.3 else block() for _ in range(draw.randrange(1, 5)))
        head = draw.choice(["div", "div", "article", "nav", "aside", "footer", 'div class="ad"', 'div class="user-comments"', 'div class="sidebar-left"', 'div class="comment-policy"', 'div class="post-body"'])
        return f"<{head}>{body}</{head.split()[0]}>"

    return '<html lang="en"><body>' + "".join(part(0) for _ in range(draw.randrange(1, 5))) + "</body></html>"


def test_extraction_against_brute_force():
    texts = [(html_extract.main_text(page), brute_text(page)) for page in map(drawn_page, range(1500))]
    assert all(got == want for got, want in texts)
    assert sum(bool(want) for _, want in texts) > 500


def test_the_measures_decide_without_any_mark():
    """Pages of one long text between menus and notices, in plain divisions only."""
    for seed in range(20):
        draw = random.Random(seed)
        menu = "".join(f"<div><a href=x>{w}</a></div>" for w in ("Home", "News", "About us"))
        body = [" ".join(draw.choices(ARTICLE.split(), k=draw.randrange(50, 90))) for _ in range(6)]
        body.insert(3, "A short line.")
        page = f"<body><div>{menu}</div><div>" + "".join(f"<p>{x}</p>" for x in body) + f"</div><div>Sign up</div><div>{menu}</div></body>"
        assert html_extract.main_text(page) == "\n".join(body)


LONG = "The story of the town is one that all of the people in it know and tell to their children, and it has been told for as long as there have been people in the town to tell it to the ones who come after them."
PARAGRAPH = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<article><header class="entry-header"><h1>Title</h1></header>{PARAGRAPH}</article>', f"Title\n{LONG}"),
        (f'<div class="post"><div class="post-header"><h1>Title</h1></div>{PARAGRAPH}</div>', f"Title\n{LONG}"),
        (f'<div class="story"><div class="story-header"><h2>Title</h2></div>{PARAGRAPH}</div>', f"Title\n{LONG}"),
        (f'<div id="content"><header class="post-header"><h1>Title</h1></header>{PARAGRAPH}</div>', f"Title\n{LONG}"),
        (f"<header><h1>Site</h1></header><article>{PARAGRAPH}</article>", LONG),
        (f"<article><div><a href=x>Home</a> <a href=y>News</a> <a href=z>About</a></div>{PARAGRAPH}</article>", LONG),
        (f"<article><h1><a href=x>Title</a></h1>{PARAGRAPH}<p>It is told <a href=y>here</a>.</p></article>", f"Title\n{LONG}\nIt is told here."),
        (f'<article>{PARAGRAPH}<section class="responses">{PARAGRAPH}</section></article>', LONG),
        (f'<div id="content"><h1>T</h1>{PARAGRAPH}<p>Short tail.</p></div>', f"T\n{LONG}\nShort tail."),
        ('<div id="content"><h1>T</h1><p>One short.</p><p>Two short.</p></div><div class="footer">x y z</div>', "T\nOne short.\nTwo short."),
        (f"<div><ul><li><a href=a>Home</a></li></ul>{PARAGRAPH}<div>All rights</div></div>", LONG),
    ],
)
def test_measures_and_marks(page, want):
    assert html_extract.main_text(page) == want


def test_the_measures_alone_find_the_text_of_the_given_pages(spark):
    """Every mark taken out of the pages: almost all of the text is found, and little else."""
    rows = [r["html"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    both = found = wanted = differ = 0
    for page in rows:
        bare = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section|form)\b", r"<\1div", page)
        bare = re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", bare)
        got, want = (Counter(html_extract.main_text(x).split("\n")) for x in (bare, page))
        both += sum(len(k) * n for k, n in (got & want).items())
        found += sum(len(k) * n for k, n in got.items())
        wanted += sum(len(k) * n for k, n in want.items())
        blocks, language = html_extract.blocks_of(bare)
        html_extract.classify(blocks, language)
        differ += sum(b.label == "bad" for b in blocks)  # mark-up alone would tell nothing apart here
    assert both >= 0.97 * wanted and both >= 0.98 * found and differ > 1000


@pytest.mark.parametrize("name", CASES)
def test_extraction(name):
    page, want = CASES[name]
    assert html_extract.main_text(page) == want


def test_extracted_rows(spark):
    rows = [(k, f"u{k}", page) for k, (page, _) in enumerate(CASES.values())] + [(None, None, "<p>"), (3, "u3", CASES["entities"][0])]
    got = html_extract.extract(pages(spark, rows)).collect()
    want = [(k, f"u{k}", text, len(text)) for k, (_, text) in enumerate(CASES.values())] + [(None, None, "", 0), (3, "u3", CASES["entities"][1], len(CASES["entities"][1]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_long_pages_take_time_in_proportion():
    page = "<div><p>a b" * 20_000 + "<" * 2000 + "&amp" * 5000 + "<a href='" + "x" * 50_000
    assert html_extract.main_text(page) is not None
