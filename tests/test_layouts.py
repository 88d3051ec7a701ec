"""Result lists: literal pages, and lists of a host learned over its pages."""

import random

from pyspark.sql import functions as F

from tomespark.operators import layouts

PAGES = "target string, host string, url string, html string"
MENU = '<nav><ul class="menu">' + "".join(f'<li class="item"><a href="/section/{i}">Sec {i}</a></li>' for i in range(12)) + "</ul></nav>"
BASE = "https://books.example.org/search/?q=dracula"
SHAPES = {
    "ul": MENU + '<div class="main"><ul class="results"><li class="book"><a href="/book/1">Dracula</a> by Bram Stoker, 1897<li class="book"><a href="/book/2">Dracula\'s Guest</a> by Bram Stoker</li>'
    '<li class="book"><a href="/book/3">The Jewel of Seven Stars</a> by Bram Stoker</li><li class="book"><a href="javascript:void(0)">xyz</a></li></ul></div>',
    "table": '<table class="res"><tr><th>Title</th><th>Author</th></tr><tr><td><a href="book.php?id=11">Dracula</a></td><td>Stoker, Bram</td></tr>'
    '<tr><td><a href="book.php?id=12">Carmilla</a></td><td>Le Fanu</td></tr><tr><td><a href="book.php?id=13">The Vampyre</a></td><td>Polidori</td></tr></table>',
    "cards": '<div class="grid"><div class="card"><h3><a href="//books.example.org/b/a">Dracula</a></h3><p>Gothic novel</p><a href="/b/a#reviews">12 reviews of this book</a></div>'
    '<div class="card"><h3><a href="/b/b">Varney the Vampire</a></h3><p>Penny dreadful</p></div><div class="card"><h3><a href="/b/c">Uncle Silas</a></h3><p>Mystery</p></div></div>',
}


def whole(body):
    return f"<html><body>{body}</body></html>"


def test_shapes(spark):
    rows = [(k, k, BASE.replace("books", f"{k}.books"), whole(v)) for k, v in SHAPES.items()]
    rows = [(k, f"{k}.books.example.org", u, h.replace("//books", f"//{k}.books")) for k, _, u, h in rows]
    pages = spark.createDataFrame(rows, PAGES)
    fit = layouts.scored(layouts.lists(pages)).cache()
    found = layouts.results(pages, layouts.learned(fit)).orderBy("target", "n").collect()
    first = {x["target"]: (x["title"], x["url"]) for x in found if x["n"] == 0}
    assert first == {
        "ul": ("Dracula", "https://ul.books.example.org/book/1"),
        "table": ("Dracula", "https://table.books.example.org/search/book.php?id=11"),
        "cards": ("Dracula", "https://cards.books.example.org/b/a"),
    }
    assert [x["target"] for x in found].count("ul") == 3 and "Bram Stoker" in next(x["extra"] for x in found if x["target"] == "ul")
    own = {x["target"]: x["own_item"] for x in layouts.own_layouts(fit).collect()}
    assert own == {"ul": "li.book", "table": "tr", "cards": "div.card"}


def test_lists_before_long_menus_and_menus_where_there_is_nothing_else(spark):
    menu = "<header><ul class=menu>" + "".join(f"<li><a href=/topics/{i}>Browse the collection of gothic topic {i}</a></li>" for i in range(15)) + "</ul></header>"
    found = '<ol class="found"><li><a href="/b/1">Dracula</a> Stoker</li><li><a href="/b/2">Carmilla</a> Le Fanu</li><li><a href="/b/3">The Vampyre</a> Polidori</li></ol>'
    pages = spark.createDataFrame([("a", "s.example", "https://s.example/q", whole(menu + found)), ("b", "t.example", "https://t.example/q", whole(menu)), ("c", "u.example", None, None)], PAGES)
    got = {x["host"]: x["item"] for x in layouts.learned(layouts.scored(layouts.lists(pages))).collect()}
    assert got == {"s.example": "li", "t.example": "li"}
    rows = layouts.results(pages, layouts.learned(layouts.scored(layouts.lists(pages)))).collect()
    assert [x["title"] for x in rows if x["target"] == "a"] == ["Dracula", "Carmilla", "The Vampyre"]
    assert sum(x["target"] == "b" for x in rows) == 15 and not any(x["target"] == "c" for x in rows)


def test_a_page_is_read_by_its_own_list_where_the_layout_finds_nothing(spark):
    page = whole('<ol class="hits"><li><a href="/x/1">One book</a></li><li><a href="/x/2">Two book</a></li><li><a href="/x/3">Three book</a></li></ol>')
    pages = spark.createDataFrame([("a", "s.example", "https://s.example/q", page)], PAGES)
    old = spark.createDataFrame([("s.example", "div.gone", "li.old")], "host string, parent string, item string")
    own = layouts.own_layouts(layouts.scored(layouts.lists(pages)))
    assert layouts.results(pages, old).count() == 0
    assert [x["title"] for x in layouts.results(pages, old, own).orderBy("n").collect()] == ["One book", "Two book", "Three book"]


def test_layouts_of_hosts_equal_what_pages_were_made_of(spark):
    """Pages of several hosts, each with a layout of its own, some with fewer results than a list needs."""
    r = random.Random(8)
    rows, want = [], {}
    for h in range(6):
        host, item, box = f"h{h}.example", r.choice(["li", "div", "article"]), f"box{h}"
        for p in range(8):
            target = f"{host}/{p}"
            titles = [f"Title number {r.randrange(1000)} of {target}" for _ in range(r.choice([1, 2, 5, 9]) if p else 6)]
            body = "".join(f'<{item} class="hit"><a href="/b/{n}{p}">{t}</a> more words about it</{item}>' for n, t in enumerate(titles))
            noise = "".join(f"<p>{'word ' * r.randrange(3, 30)}</p>" for _ in range(4))
            rows.append((target, host, f"https://{host}/s?p={p}", whole(MENU + noise + f'<div class="{box}">{body}</div>')))
            want[target] = titles
    pages = spark.createDataFrame(rows, PAGES)
    fit = layouts.scored(layouts.lists(pages))
    learned = {x["host"]: x["parent"] for x in layouts.learned(fit).collect()}
    assert learned == {f"h{h}.example": f"html > body > div.box{h}" for h in range(6)}
    got = {}
    for x in layouts.results(pages, layouts.learned(fit)).orderBy("target", "n").collect():
        got.setdefault(x["target"], []).append(x["title"])
    assert got == want


def test_scores_are_those_of_the_rule(spark):
    pages = spark.createDataFrame([("a", "s.example", "https://s.example/q", whole(SHAPES["table"]))], PAGES)
    row = layouts.scored(layouts.lists(pages)).where(F.col("item") == "tr").first()
    texts = ["Dracula Stoker, Bram", "Carmilla Le Fanu", "The Vampyre Polidori"]
    chars = sum(len(t) - 1 for t in texts)  # cells stand without a blank between them
    assert (row["members"], row["results"], row["hrefs"], row["chars"]) == (4, 3, 3, chars) and row["score"] == chars * 1.5
