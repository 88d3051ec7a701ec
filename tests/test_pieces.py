"""Stories inside a page, and books without their wrapping."""

from tomespark.operators import pieces

PROSE = "The old man walked down to the shore and looked at the sea for a long time, as he did every morning of his life, and then he went home again to his house."


def paragraphs(n, what):
    return "".join(f"<p>{what} {i}. {PROSE}</p>\n" for i in range(n))


def issue():
    return (
        """<html><head><title>An issue</title></head><body><h1>Astounding Tales</h1><h2>CONTENTS</h2><table>
<tr><td><a href="#Depths">INTO THE OCEAN'S DEPTHS</a></td><td><a href="#Page_151">151</a></td></tr>
<tr><td><a href='#Madness'>MURDER  MADNESS</a></td><td><a href="#Page_166">166</a></td></tr>
<tr><td><a href="#Jest">The Jovian Jest</a></td></tr><tr><td><a href=#Readers>THE READERS' CORNER</a></td></tr>
<tr><td><a href="#Last"><i>The</i> Last &amp; Best</a> <a href="#nowhere">Nowhere</a> <a href="#Chap">Chapter II</a></td></tr></table>
<h2><a id="Depths"></a>Into the Ocean's Depths</h2><h3><i>By Someone</i></h3><h4 id="Chap">CHAPTER I</h4>
<p> read the telegram.<a id="Page_151"></a> Then I folded it.<a href="#Footnote_1">[1]</a></p>"""
        + paragraphs(20, "Depths")
        + "<h4>CHAPTER II</h4>"
        + paragraphs(20, "Depths again")
        + '<h2><a id="Madness"></a>Murder Madness</h2><h4>BEGINNING A FOUR-PART NOVEL</h4><a id="Page_166"></a>'
        + paragraphs(30, "Madness")
        + '<h2><a name="Jest"></a>The Jovian Jest</h2>'
        + paragraphs(2, "Jest")
        + '<h2 id="Readers">The Readers\' Corner</h2>'
        + paragraphs(30, "Letter")
        + '<a id="Last"></a> <div> <h3>The Last</h3></div>'
        + paragraphs(25, "Last")
        + '<p><a id="Footnote_1"></a>A note.<a href="#Depths">back</a></p>*** END OF THE PROJECT GUTENBERG EBOOK ***'
        + paragraphs(900, "The licence")
    )


def test_whole_stories_of_an_issue(spark):
    pages = spark.createDataFrame([(1, issue()), (2, None), (3, "<p>no headings <a href='#x'>x</a>")], "target int, html string")
    rows = pieces.stories(pages).orderBy("begin").collect()
    per = len(f"Depths 1. {PROSE}".split())
    assert [(x["target"], x["id"], x["title"]) for x in rows] == [(1, "Depths", "Into the Ocean's Depths"), (1, "Last", "The Last & Best")]
    assert rows[0]["words"] == 4 + 2 + 2 + 4 + 5 + 40 * per + 20 + 2 - 1 and rows[0]["end"] is not None  # title, byline, chapters, telegram, note; "Depths again" is two words
    assert rows[1]["words"] == 2 + 25 * per + 3 and rows[1]["end"] is None
    assert pieces.stories(pages, most=2000).count() == 2 and pieces.stories(pages, least=1000).count() == 1


def test_wrapping_is_taken_off(spark):
    start, end = "*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** END OF THIS PROJECT GUTENBERG EBOOK X ***"
    books = {
        1: ["header", start, "one", "[Illustration]", "two", " [Illustration] ", end, "licence", start],
        2: ["plain", "[Illustration]", None],
        3: ["one", end, "licence"],
        4: ["head", start, "one", None],
    }
    rows = [(k, n, t) for k, b in books.items() for n, t in enumerate(b)]
    got = {k: [] for k in books}
    for x in pieces.unwrapped(spark.createDataFrame(rows, "target int, block_no int, text string")).orderBy("target", "block_no").collect():
        got[x["target"]].append(x["text"])
    assert got == {1: ["one", "two"], 2: books[2], 3: ["one"], 4: ["one", None]}
