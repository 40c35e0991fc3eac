"""Web pages to records: JSON-LD, blocks of HTML, images and links."""

from __future__ import annotations

import datetime as dt
import json
import re
import urllib.parse
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vocab
from ..functions.dates import find_dates

# What counts as a container of one event, and what is no content.
SKIPPED = {"script", "style", "nav", "header", "footer", "aside"}
BLOCK_CLASSES = {"event", "events", "tribe-events-calendar-list__event", "event-item", "post", "eventitem", "em-item"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAX_BLOCKS, MAX_IMAGES, MIN_BLOCK_CHARS = 40, 40, 25

NODE = "struct<title:string,start:string,end:string,location:string,image:string,description:string,url:string>"
IMAGE = "struct<src:string,alt:string,class:string,width:int,height:int>"
BLOCK = f"struct<text:string,heading:string,link:string,images:array<{IMAGE}>,whole:boolean>"


def _walk(node) -> Iterator[dict]:
    todo = [node]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            yield x
            todo[:0] = x.values()
        elif isinstance(x, list):
            todo[:0] = x


def _text(x) -> str | None:
    if isinstance(x, list):
        x = x[0] if x else None
    if isinstance(x, dict):
        x = x.get("@value") or x.get("name")
    return str(x).strip() or None if isinstance(x, (str, int, float)) else None


def _place(x) -> str | None:
    if isinstance(x, list):
        x = x[0] if x else None
    if not isinstance(x, dict):
        return _text(x)
    address = x.get("address")
    parts = [x.get("name")] + ([address.get("addressLocality"), address.get("addressRegion")] if isinstance(address, dict) else [address])
    return ", ".join(p for p in map(_text, parts) if p) or None


def _image(x) -> str | None:
    if isinstance(x, list):
        x = x[0] if x else None
    return (x.get("url") if isinstance(x, dict) else x) or None


def jsonld_events(html: str | None) -> list[tuple]:
    """The event nodes of all ld+json scripts, however deep; scripts that don't parse are skipped."""
    out = []
    for raw in re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html or ""):
        try:
            data = json.loads(raw.strip())
        except ValueError:
            continue
        for node in _walk(data):
            kinds = node.get("@type")
            if any("event" in str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])):
                out.append((_text(node.get("name")), _text(node.get("startDate")), _text(node.get("endDate")), _place(node.get("location")), _image(node.get("image")), _text(node.get("description")), _text(node.get("url"))))
    return out


class _Blocks(HTMLParser):
    """Collects the text, first heading, first link and images of event containers, or of the whole page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict | None]] = []
        self.page, self.blocks, self.skip = self._new(), [], 0

    @staticmethod
    def _new() -> dict:
        return {"text": [], "heading": [], "in_heading": 0, "had_heading": False, "link": None, "images": []}

    def _open(self) -> list[dict]:
        return [self.page, *[b for _, b in self.stack if b is not None]]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in VOID:
            if tag == "img" and not self.skip:
                size = [int(m[0]) if (m := re.match(r"\d+", a.get(k, ""))) else 0 for k in ("width", "height")]
                for b in self._open():
                    b["images"].append((a.get("src") or a.get("data-src") or a.get("data-lazy-src") or "", a.get("alt", ""), a.get("class", ""), *size))
            return
        block = None
        if tag in SKIPPED:
            self.skip += 1
        elif not self.skip:
            if tag == "article" or BLOCK_CLASSES & set(a.get("class", "").split()):
                block = self._new()
                self.blocks.append(block)
            for b in self._open() + ([block] if block else []):
                if tag in ("h1", "h2", "h3", "h4") and not b["had_heading"]:
                    b["in_heading"] += 1
                if tag == "a" and a.get("href") and b["link"] is None:
                    b["link"] = a["href"]
        self.stack.append((tag, block))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, _ = self.stack[-1]
            if t in SKIPPED:
                self.skip = max(0, self.skip - 1)
            elif t in ("h1", "h2", "h3", "h4") and not self.skip:
                for b in self._open():
                    if b["in_heading"]:
                        b["in_heading"], b["had_heading"] = 0, True
            self.stack.pop()
            if t == tag:
                break

    def handle_data(self, data):
        if self.skip or not data.strip():
            return
        for b in self._open():
            b["text"].append(data.strip())
            if b["in_heading"]:
                b["heading"].append(data.strip())


def html_blocks(html: str | None) -> list[tuple]:
    """(text, heading, link, images, whole) of each event container of a page; of the page itself if it has none."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    whole = not parser.blocks
    return [("\n".join(b["text"]), " ".join(b["heading"]) or None, b["link"], b["images"][:MAX_IMAGES], whole) for b in (parser.blocks or [parser.page])[:MAX_BLOCKS]]


def _per_page(function, kind: str) -> Column:
    @F.pandas_udf(f"array<{kind}>")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([function(p) for p in batch], dtype=object)

    return run


def _arrays(function, fields: list[str], kind: str):
    return _per_page(lambda p: [dict(zip(fields, x, strict=True)) for x in function(p)], kind)


def parse_jsonld(html: Column) -> Column:
    """array<struct> of a page's event nodes."""
    return _arrays(jsonld_events, ["title", "start", "end", "location", "image", "description", "url"], NODE)(html)


def whole_page(html: str | None) -> list[tuple]:
    """As html_blocks, of the page itself, whatever containers it has."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    b = parser.page
    return [("\n".join(b["text"]), " ".join(b["heading"]) or None, b["link"], b["images"][:MAX_IMAGES], True)]


def parse_page(html: Column) -> Column:
    return parse_blocks(html, whole_page)


def parse_blocks(html: Column, find=html_blocks) -> Column:
    image = lambda i: dict(zip(("src", "alt", "class", "width", "height"), i, strict=True))
    blocks = lambda p: [(t, h, l, [image(i) for i in images], w) for t, h, l, images, w in find(p)]
    return _arrays(blocks, ["text", "heading", "link", "images", "whole"], BLOCK)(html)


def url_join(base: Column, link: Column) -> Column:
    """The address of a link on a page; null for no link or one that can't be parsed."""

    def join(b: str | None, x: str | None) -> str | None:
        try:
            return urllib.parse.urljoin(b or "", x) if x else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bases, links in pairs:
            yield pd.Series([join(b, x) for b, x in zip(bases, links, strict=True)], dtype=object)

    return run(base, link)


def best_image(images: Column) -> Column:
    """The src of the likeliest flyer: hinted by its name 3, upright 2; logos, small images and other kinds of file are out; the first of the best."""
    name = lambda i: F.lower(F.regexp_replace(i.src, r"[?#].*$", ""))
    fits = lambda i: (
        ~F.startswith(i.src, F.lit("data:")) & name(i).rlike(r"\.(jpe?g|png|gif|webp)$") & ~name(i).rlike("logo|icon|avatar|banner|header|sprite|spacer")
        & ~((i.width > 0) & (i.height > 0) & ((i.width < 200) | (i.height < 200)))
    )
    points = lambda i: (
        F.when(F.concat_ws(" ", name(i), F.lower(i.alt), F.lower(i["class"])).rlike("flyer|poster|tournament|event|" + T.any_of(vocab.current().strong)), 3).otherwise(0)
        + F.when((i.width > 0) & (i.height >= i.width), 2).otherwise(0)
    )
    ranked = F.transform(F.filter(images, fits), lambda i, at: F.struct(points(i).alias("p"), (-at).alias("at"), i.src.alias("src")))
    return F.array_max(ranked).src


def link_points(label: Column) -> Column:
    return (
        F.when(label.rlike(T.any_of(vocab.current().strong)), 5).otherwise(0)
        + F.when(label.rlike(r"\bevents?\b|calendar|tournament|powwow|pow.wow"), 3).otherwise(0)
        + F.when(label.rlike("news|announce|upcoming|community"), 1).otherwise(0)
        - F.when(label.rlike(r"login|cart|privacy|terms|careers|jobs|\.pdf$"), 5).otherwise(0)
    )


def promising_links(pages: DataFrame, k: int = 20, least: int = 3) -> DataFrame:
    """pages: page_id, url, html. The k best links of each page to its own host: page_id, link, points, rank. Ties go by place on the page."""
    anchor = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
    hrefs, labels = (F.regexp_extract_all("html", F.lit(anchor), F.lit(g)) for g in (1, 2))
    rows = pages.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("pos", "a"))
    rows = rows.withColumn("link", F.regexp_replace(url_join(F.col("url"), F.col("a.href")), "#.*$", ""))
    host = lambda c: F.regexp_extract(c, "^https?://([^/?#]*)", 1)
    rows = rows.where((host("link") != "") & (host("link") == host("url")))
    first = Window.partitionBy("page_id", "link").orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rows = rows.withColumn("points", link_points(F.lower(F.concat_ws(" ", T.strip_html(F.col("a.label")), "link")))).where(F.col("points") >= least)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("points"), "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("page_id", "link", "points", "rank")


def from_jsonld(pages: DataFrame, least: int = 5) -> DataFrame:
    """pages: url, html, site_location, site_tribe, hint. Pages without the marker never reach the parser."""
    rows = pages.where(F.contains("html", F.lit("ld+json"))).withColumn("n", F.explode(parse_jsonld(F.col("html"))))
    rows = rows.withColumns({"title": F.coalesce("n.title", F.lit("")), "details": F.col("n.description")})
    rows = rows.where(T.topic_tenths(F.concat_ws(" ", "title", "details"), F.col("hint")) >= least)
    return rows.select(
        "title", T.iso_prefix_date(F.col("n.start")).alias("start_date"), T.iso_prefix_date(F.col("n.end")).alias("end_date"), F.coalesce("n.location", "site_location").alias("location"),
        F.coalesce(T.find_tribe(F.concat_ws(" ", "title", "details", "hint")), "site_tribe").alias("tribe"), "details", F.col("n.image").alias("flyer_url"),
        F.coalesce("n.url", "url").alias("source_url"), F.lit("structured").alias("extraction"), F.col("details").alias("raw_text"),
    )


def from_html(pages: DataFrame, as_of: dt.date, least: int = 5) -> DataFrame:
    """As from_jsonld, of blocks that have a date or an image. A page none of whose text is on topic is dropped before it is parsed."""
    rows = pages.where(T.topic_tenths(F.regexp_replace("html", "<[^>]+>", " "), F.col("hint")) >= least)
    rows = rows.withColumn("b", F.explode(parse_blocks(F.col("html")))).withColumn("text", F.col("b.text"))
    rows = rows.where((F.length("text") >= MIN_BLOCK_CHARS) & (T.topic_tenths(F.col("text"), F.col("hint")) >= least))
    rows = rows.withColumns({"d": find_dates(F.col("text"), as_of), "flyer_url": url_join(F.col("url"), best_image(F.col("b.images")))})
    rows = rows.where("d.start IS NOT NULL OR flyer_url IS NOT NULL").withColumn("to", url_join(F.col("url"), F.col("b.link")))
    bare = lambda c: F.rtrim(c, F.lit("/"))
    own = ~F.col("b.whole") & F.col("to").isNotNull() & (bare(F.col("to")) != bare(F.col("url"))) & F.col("to").rlike(r"^https?://[^/]+/+[^/?#]")
    return rows.select(
        F.coalesce("b.heading", T.guess_title(F.col("text"))).alias("title"), F.col("d.start").alias("start_date"), F.col("d.end").alias("end_date"),
        F.coalesce(T.find_location(F.col("text")), "site_location").alias("location"), F.coalesce(T.find_tribe(F.col("text")), "site_tribe").alias("tribe"),
        F.coalesce(T.find_contact(F.col("text")), T.snippet(F.col("text"))).alias("details"), "flyer_url", F.when(own, F.col("to")).otherwise(F.col("url")).alias("source_url"),
        F.lit("structured").alias("extraction"), F.substr("text", F.lit(1), F.lit(3000)).alias("raw_text"), F.col("d.warnings").alias("warnings"),
    )


def scan_sites(sites: DataFrame, fetched: DataFrame, as_of: dt.date, k: int = 25, least: int = 5) -> DataFrame:
    """sites: url, html, site_location, site_tribe, hint, follow (null: yes); fetched: url, html of linked pages. The records of each site's page and of its k best links, one level deep.

    A linked page goes by the fields of the site that links to it; one that wasn't fetched gives nothing.
    """
    site = ("site_location", "site_tribe", "hint")
    front = sites.where("html != ''").withColumn("page_id", F.col("url"))
    links = promising_links(front.where(F.coalesce("follow", F.lit(True))), k).select(F.col("page_id").alias("_site"), F.col("link").alias("url"))
    pages = fetched.where("html != ''").groupBy("url").agg(F.min("html").alias("html"))
    deeper = links.join(pages, "url").join(sites.select(F.col("url").alias("_site"), *site), "_site")
    every = front.select("url", "html", *site).unionByName(deeper.select("url", "html", *site))
    return from_jsonld(every, least).withColumn("confidence", F.lit(85)).unionByName(from_html(every, as_of, least).withColumn("confidence", F.when(F.col("start_date").isNotNull(), 60).otherwise(30)), allowMissingColumns=True)


#: The confidence, in hundredths, above which nothing goes that a search found.
SEARCH_CAP = 80


def from_search_pages(pages: DataFrame, as_of: dt.date, least: int = 5) -> DataFrame:
    """pages: url (distinct), html, snippet. The structured events of each page, or, where there are none, the page as a whole if it is on topic and has a date or an image."""
    none = F.lit(None).cast("string")
    rows = pages.where("html != ''").withColumns({"site_location": none, "site_tribe": none, "hint": none})
    # the parser runs once: a page's events stay beside it
    rows = rows.withColumn("_nodes", F.when(F.contains("html", F.lit("ld+json")), F.col("html"))).withColumn("_nodes", F.when(F.col("_nodes").isNotNull(), parse_jsonld(F.col("_nodes"))))
    on_topic = F.filter("_nodes", lambda n: T.topic_tenths(F.concat_ws(" ", n.title, n.description)) >= least)
    rows = rows.withColumn("_nodes", F.coalesce(on_topic, F.array().cast(f"array<{NODE}>")))
    n = lambda f: F.col(f"n.{f}")
    structured = rows.withColumn("n", F.explode("_nodes")).select(
        F.coalesce(n("title"), F.lit("")).alias("title"), T.iso_prefix_date(n("start")).alias("start_date"), T.iso_prefix_date(n("end")).alias("end_date"), n("location").alias("location"),
        T.find_tribe(F.concat_ws(" ", n("title"), n("description"))).alias("tribe"), n("description").alias("details"), n("image").alias("flyer_url"), F.coalesce(n("url"), "url").alias("source_url"),
        F.lit("structured").alias("extraction"), F.lit(SEARCH_CAP).alias("confidence"), n("description").alias("raw_text"), F.array().cast("array<string>").alias("warnings"),
    )
    whole = rows.where((F.size("_nodes") == 0) & (T.topic_tenths(F.regexp_replace("html", "<[^>]+>", " ")) >= least))  # before the page is parsed
    whole = whole.withColumn("_page", F.try_element_at(parse_page(F.col("html")), F.lit(1))).withColumn("text", F.col("_page.text")).where(T.topic_tenths(F.col("text")) >= least)
    whole = whole.withColumn("d", find_dates(F.col("text"), as_of))
    whole = whole.withColumn("flyer_url", url_join(F.col("url"), best_image(F.col("_page.images")))).where("d.start IS NOT NULL OR flyer_url IS NOT NULL")
    heading = F.nullif(T.strip_html(F.regexp_extract("html", r"(?is)<h[12]\b[^>]*>(.*?)</h[12]>", 1)), F.lit(""))
    return structured.unionByName(whole.select(
        F.coalesce(heading, T.guess_title(F.col("text")), F.substr("snippet", F.lit(1), F.lit(80))).alias("title"), F.col("d.start").alias("start_date"), F.col("d.end").alias("end_date"),
        T.find_location(F.col("text")).alias("location"), T.find_tribe(F.col("text")).alias("tribe"), T.find_contact(F.col("text")).alias("details"), "flyer_url", F.col("url").alias("source_url"),
        F.lit("structured").alias("extraction"), F.when(F.col("d.start").isNotNull(), 50).otherwise(25).alias("confidence"), F.substr("text", F.lit(1), F.lit(3000)).alias("raw_text"), F.col("d.warnings").alias("warnings"),
    ))
