"""Feeds and subscription lists, parsed by Spark's own XML and JSON functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomespark.functions import dates

_RSS = "channel struct<title: string, item: array<struct<title: string, link: string, guid: string, pubDate: string, description: string, author: string>>>"
_ATOM = "title string, entry array<struct<title: string, id: string, link: array<struct<_href: string, _rel: string>>, published: string, updated: string, summary: string, content: string>>"
_JSON = "title string, items array<struct<id: string, url: string, title: string, date_published: string, date_modified: string, summary: string, content_html: string, content_text: string>>"
_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
#: Date forms of feeds; the first that parses counts.
_FORMS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd")


def feed_date(s: Column) -> Column:
    bare = F.regexp_replace(F.trim(s), r"^[A-Za-z]{3,9},\s*", "")  # the day of the week says nothing new
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(form)) for form in _FORMS))


def feed_items(feeds: DataFrame, now: datetime) -> DataFrame:
    """(feed_id, guid, title, link, published, summary, content) of captured feeds (feed_id, body): RSS, Atom or JSON.

    What is none of these gives no items. Items without an id are known by their
    link; times follow ``dates.published``.
    """
    start = F.substring(F.regexp_replace("body", r"^\s*(<\?xml[^>]*>|<!--.*?-->|\s)*", ""), 1, 300)
    kind = F.when(F.col("body").rlike(r"^\s*\{"), "json").when(start.rlike(r"^<(\w+:)?feed\b"), "atom").when(start.rlike(r"^<(rss|rdf:RDF)\b"), "rss")
    marked = feeds.select("feed_id", "body", kind.alias("_kind"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    # A guid with attributes is a struct to an XML schema: its text is enough.
    plain = F.regexp_replace("body", r"<guid\b[^>]*>", "<guid>")
    rss = marked.where("_kind = 'rss'").select("feed_id", F.explode(F.from_xml(plain, _RSS, _XML)["channel"]["item"]).alias("i"))
    rss = rss.select("feed_id", text(F.col("i.guid")).alias("guid"), text(F.col("i.title")).alias("title"), text(F.col("i.link")).alias("link"), feed_date(F.col("i.pubDate")).alias("_p"), F.lit(None).cast("timestamp").alias("_u"), text(F.col("i.description")).alias("summary"), F.lit("").alias("content"))
    bare = F.regexp_replace("body", r"<(title|summary|content)\b[^>]*[^/>]>", "<$1>")
    atom = marked.where("_kind = 'atom'").select("feed_id", F.explode(F.from_xml(bare, _ATOM, _XML)["entry"]).alias("i"))
    own = F.filter("i.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    atom = atom.select("feed_id", text(F.col("i.id")).alias("guid"), text(F.col("i.title")).alias("title"), text(F.get(own, F.lit(0))["_href"]).alias("link"), feed_date(F.col("i.published")).alias("_p"), feed_date(F.col("i.updated")).alias("_u"), text(F.col("i.summary")).alias("summary"), text(F.col("i.content")).alias("content"))
    js = marked.where("_kind = 'json'").select("feed_id", F.explode(F.from_json("body", _JSON)["items"]).alias("i"))
    js = js.select("feed_id", text(F.col("i.id")).alias("guid"), text(F.col("i.title")).alias("title"), text(F.col("i.url")).alias("link"), feed_date(F.col("i.date_published")).alias("_p"), feed_date(F.col("i.date_modified")).alias("_u"), text(F.col("i.summary")).alias("summary"), text(F.coalesce("i.content_html", "i.content_text")).alias("content"))
    every = rss.unionByName(atom).unionByName(js)
    key = F.when(F.col("guid") == "", F.col("link")).otherwise(F.col("guid"))
    return every.select("feed_id", key.alias("guid"), "title", "link", dates.published(F.col("_p"), F.col("_u"), now).alias("published"), "summary", "content").where("guid <> ''")


_OPML_TAGS = r"""(?si)<outline\b(?:[^>"']|"[^"]*"|'[^']*')*>|</outline\s*>"""


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, without character references; null where it has none."""
    found = F.regexp_extract(tag, rf"""(?si)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    value = F.substring(found, 2, F.char_length(found) - 2)
    for mark, name_of in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("'", "&#39;"), ("&", "&amp;")):
        value = F.replace(value, F.lit(name_of), F.lit(mark))
    return F.when(found != "", value)


def opml_feeds(lists: DataFrame) -> DataFrame:
    """(list, title, url, site, shelf) of OPML texts (list, body): the innermost folder names the shelf, however deep folders nest."""
    tags = F.regexp_extract_all(F.regexp_replace("body", r"(?s)<!--.*?-->", ""), F.lit(_OPML_TAGS), 0)
    # The folders open at each tag: an opening tag adds its name, a closing one takes the last away.
    name = lambda t: F.coalesce(_attribute(t, "title"), _attribute(t, "text"), F.lit(""))
    none = F.array().cast("array<string>")
    row = lambda t, open_: F.struct(name(t).alias("title"), _attribute(t, "xmlUrl").alias("url"), F.coalesce(_attribute(t, "htmlUrl"), F.lit("")).alias("site"), F.coalesce(F.try_element_at(open_, F.lit(-1)), F.lit("")).alias("shelf"))
    start = F.struct(none.alias("open"), F.array().cast("array<struct<title:string,url:string,site:string,shelf:string>>").alias("rows"))

    def step(held: Column, t: Column) -> Column:
        closing, alone = t.startswith("</"), t.rlike(r"/\s*>$")
        around = held["open"]
        opened = F.when(closing, F.slice(around, F.lit(1), F.greatest(F.size(around) - 1, F.lit(0)))).when(alone, around).otherwise(F.array_append(around, name(t)))
        rows = F.when(closing | _attribute(t, "xmlUrl").isNull(), held["rows"]).otherwise(F.array_append(held["rows"], row(t, around)))
        return F.struct(opened.alias("open"), rows.alias("rows"))

    found = F.aggregate(tags, start, step, lambda held: held["rows"])
    return lists.select("list", F.explode(found).alias("r")).select("list", "r.title", "r.url", "r.site", "r.shelf")


def to_opml(feeds: DataFrame, state: DataFrame) -> DataFrame:
    """(shelf, outline): an OPML folder for each shelf. The address that last worked goes before the first listed; feeds without one are left out."""
    worked = state.select("id", F.nullif(F.col("url"), F.lit("")).alias("_worked"))
    address = F.coalesce("_worked", F.get("url", F.lit(0)))
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    rows = feeds.join(worked, "id", "left").withColumn("_a", address).where("_a IS NOT NULL AND _a <> ''")
    line = F.concat(F.lit('<outline type="rss" text="'), escaped(F.col("name")), F.lit('" xmlUrl="'), escaped(F.col("_a")), F.lit('"/>'))
    held = rows.groupBy("shelf").agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("_l"))
    return held.select("shelf", F.concat(F.lit('<outline text="'), escaped(F.col("shelf")), F.lit('">'), F.array_join(F.transform("_l", lambda x: x["line"]), ""), F.lit("</outline>")).alias("outline"))
