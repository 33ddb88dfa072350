"""HTML pages to records, and the crawl frontier.

Pages are parsed with the standard library's parser in Arrow batches: there is
no built-in HTML function. One fetch of the summary page serves summaries and
synopsis.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import RECORD

# The selectors' names and the texts for what isn't found.
HOST = "https://www.imdb.com"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LABEL = "ipc-metadata-list-item__label"
CONTENT_ITEM = "ipc-metadata-list-item__list-content-item"
CREDIT = "title-pc-principal-credit"
RECORD_FIELDS = [f.strip().split(" ", 1)[0] for f in RECORD.replace("array<array<string>>", "a").replace("array<string>", "a").split(",")]


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def walk(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            e = todo.pop()
            if e is not self:
                yield e
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                todo.extend(reversed(e.children))
        return "".join(out)

    def strings(self) -> list[str]:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e.strip())
            else:
                todo.extend(reversed(e.children))
        return [x for x in out if x]

    def find_all(self, tags: str = "", classes: str = "", **attributes: str | Callable[[str], bool]) -> Iterator[Element]:
        """Descendants with one of the tags, the class (or, with a blank, the exact class text) and the attributes."""
        names = tags.split()
        for e in self.walk():
            if names and e.tag not in names:
                continue
            own = e.attributes.get("class", "")
            if classes and classes not in own.split() and classes != own:
                continue
            for k, want in attributes.items():
                have = e.attributes.get(k.replace("_", "-"))
                if not (want(have) if callable(want) and have is not None else have == want):
                    break
            else:
                yield e

    def find(self, *a: str, **k: str | Callable[[str], bool]) -> Element | None:
        return next(self.find_all(*a, **k), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def document(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _texts(found: Iterator[Element]) -> list[str]:
    return [t for t in (e.text().strip() for e in found) if t]


def title(d: Element) -> str | None:
    tag = d.find("h1")
    return tag.text().strip() if tag else None


def first_page_summary(d: Element) -> str:
    tag = d.find("span", data_testid="plot-xl")
    return tag.text().strip() if tag else "Summary not found."


def principal_names(d: Element, label: str) -> list[str]:
    """People of the credit blocks with exactly this label, each once, sorted."""
    names: set[str] = set()
    for block in d.find_all("li", data_testid=CREDIT):
        for tag in ("span", "a"):
            head = block.find(tag, LABEL)
            if head and head.text().strip() == label:
                names.update(_texts(block.find_all("a", CONTENT_ITEM)))
    return sorted(names)


def related_links(d: Element) -> list[str]:
    section = d.find("section", data_testid="MoreLikeThis")
    return [HOST + a.attributes["href"] for a in section.find_all("a", "ipc-lockup-overlay ipc-focusable") if a.attributes.get("href")] if section else []


def genres(d: Element) -> list[str]:
    box = d.find("div", "ipc-chip-list__scroller")
    return _texts(box.find_all("span", "ipc-chip__text")) if box else []


def _linked_data(d: Element, *names: str, inside: str = "") -> str | None:
    """The first of the names that a page's JSON-LD has."""
    for script in d.find_all("script", type="application/ld+json"):
        try:
            data = json.loads(script.text().strip())
        except ValueError:
            continue
        for item in data if isinstance(data, list) else [data]:
            if inside:
                item = item.get(inside) if isinstance(item, dict) else None
            value = next((item[n] for n in names if item.get(n)), item.get(names[-1])) if isinstance(item, dict) else None
            if value is not None and (inside or value) and str(value):
                return str(value)
    return None


def rating(d: Element) -> str:
    bar = d.find(data_testid="hero-rating-bar__aggregate-rating__score")
    shown = "".join(bar.strings()) if bar and bar.tag == "div" else ""
    if shown:
        return shown.split("/")[0]
    old = d.find(itemprop="ratingValue")
    if old and old.text().strip():
        return old.text().strip()
    return _linked_data(d, "ratingValue", "ratingvalue", inside="aggregateRating") or "Rating not found."


def mpaa(d: Element) -> str:
    for row in d.find_all("li", "ipc-metadata-list__item"):
        head = row.find("span a", LABEL)
        if head and "".join(head.strings()) in ("Certificate", "Certification"):
            value = row.find("a", CONTENT_ITEM) or row.find("span", CONTENT_ITEM)
            if value and value.strings():
                return "".join(value.strings())
    link = d.find("a", href=lambda h: "parentalguide/certificates" in h)
    if link and link.strings():
        return "".join(link.strings())
    return _linked_data(d, "contentRating", "contentrating") or "MPAA rating not found."


def release_year(d: Element) -> str:
    tag = d.find("a", href=lambda h: "releaseinfo" in h)
    return tag.text().strip() if tag else "Release year not found."


def languages(d: Element) -> list[str]:
    row = d.find("li", data_testid="title-details-languages")
    return (_texts(row.find_all("a", CONTENT_ITEM)) if row else []) or ["Languages not found."]


def countries(d: Element) -> list[str]:
    return _texts(d.find_all("a", href=lambda h: "country_of_origin" in h)) or ["No countries of origin found."]


def box_office(d: Element, name: str, label: str) -> str:
    row = d.find("li", data_testid=name)
    if row is None:
        return f"{label} tag not found."
    value = row.find("span", CONTENT_ITEM)
    return value.text().strip() if value else f"{label} not found."


def summaries(d: Element) -> list[str]:
    section = d.find("div", data_testid="sub-section-summaries")
    inner = (li.find("div", "ipc-html-content-inner-div") for li in section.find_all("li")) if section else ()
    return [e.text().strip() for e in inner if e and e.text()]


def synopsis(d: Element) -> list[str]:
    return [e.text().strip() for e in d.find_all("div", data_testid="sub-section-synopsis") if e.text()]


def reviews(d: Element) -> list[list[str]]:
    box, out = d.find("div", "lister-list"), []
    for item in box.find_all("div", "lister-item") if box else ():
        text, score = item.find("div", "text show-more__control"), item.find("span", "rating-other-user-rating")
        inner = score.find("span") if score else None
        out.append([text.text().strip() if text else "", inner.text().strip() if inner else "N/A"])
    return out


def record(html: str | None, summary_html: str | None = None, reviews_html: str | None = None) -> dict:
    """A record without its id, from a title page and its two sub-pages."""
    d, s, r = document(html), document(summary_html), document(reviews_html)
    return {
        "title": title(d), "first_page_summary": first_page_summary(d), "release_year": release_year(d), "mpaa": mpaa(d),
        "budget": box_office(d, "title-boxoffice-budget", "Budget"), "gross_worldwide": box_office(d, "title-boxoffice-cumulativeworldwidegross", "Gross worldwide"),
        "rating": rating(d), "directors": principal_names(d, "Director"), "writers": principal_names(d, "Writers"), "stars": principal_names(d, "Stars"),
        "related_links": related_links(d), "genres": genres(d), "languages": languages(d), "countries_of_origin": countries(d),
        "summaries": summaries(s), "synopsis": synopsis(s), "reviews": reviews(r),
    }


def title_id(url: Column) -> Column:
    """The segment after the first one that is `title`, or null."""
    parts = F.split(url, "/")
    at = F.array_position(parts, "title")
    return F.when(at > 0, F.get(parts, at))


def sub_page(url: Column, name: str) -> Column:
    """The address of a title's `plotsummary` or `reviews` page; null without an id."""
    own = title_id(url)
    return F.when(own.isNotNull() & (own != ""), F.concat(F.lit(f"{HOST}/title/"), own, F.lit(f"/{name}")))


def records(pages: DataFrame) -> DataFrame:
    """Records of pages(url, html[, summary_html, reviews_html])."""
    extra = [F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in ("summary_html", "reviews_html")]
    names = [f for f in RECORD_FIELDS if f != "id"]
    kind = ", ".join(x for x in RECORD.split(", ") if not x.startswith("id "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [record(*(c.as_py() for c in x)) for x in zip(*batch.columns[1:], strict=True)]
            kinds = {"reviews": pa.list_(pa.list_(pa.string()))} | {n: pa.list_(pa.string()) for n in names if f"{n} array<string>" in kind}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names)], names=["id", *names])

    return pages.select(title_id(F.col("url")).alias("id"), "html", *extra).mapInArrow(run, "id string, " + kind)


def seeds(chart: DataFrame) -> DataFrame:
    """frontier(url, id) of chart pages(html): the linked titles, each once, in order of page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for html in batch.column(0).to_pylist():
                for row in document(html).find_all("li", "ipc-metadata-list-summary-item"):
                    link = row.find("a", href=lambda h: True)
                    parts = link.attributes["href"].split("/") if link else []
                    if len(parts) > 2 and parts[2]:
                        found.append(parts[2])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["id"])

    ids = chart.select("html").mapInArrow(run, "id string").dropDuplicates(["id"])
    return ids.select(F.concat(F.lit(f"{HOST}/title/"), "id", F.lit("/")).alias("url"), "id")


def next_frontier(extracted: DataFrame, seen: DataFrame) -> DataFrame:
    """(url, id) of related links whose id isn't in seen(id), each id once."""
    links = extracted.select(F.explode("related_links").alias("url")).withColumn("id", title_id(F.col("url"))).where("id is not null and id <> ''")
    return links.groupBy("id").agg(F.min("url").alias("url")).join(seen, "id", "left_anti").select("url", "id")


def crawl(spark: SparkSession, fetch: Callable[[DataFrame], DataFrame], frontier: DataFrame, threshold: int, checkpoint: Callable[[DataFrame, int], DataFrame], seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of the titles reached from the frontier(url, id), until `threshold` pages were asked for, and the frontier that is left.

    fetch turns frontier(url, id) into pages(url, html, ...): pages that can't be
    had are left out, but count. checkpoint(df, round) writes a round's table and
    gives it back, so that no round's lineage reaches into the one before. seen(id)
    are the titles of an earlier crawl, those of its frontier among them.
    """
    out, asked, turn = None, 0, 0
    left = checkpoint(frontier.select("url", "id"), turn)
    seen = checkpoint((left.select("id") if seen is None else seen.select("id").unionByName(left.select("id"))).distinct(), turn + 1)
    turn += 2
    while asked < threshold:
        taken = checkpoint(left.orderBy("id").limit(threshold - asked), turn)
        n = taken.count()
        if not n:
            break
        got = checkpoint(records(fetch(taken)), turn + 1)
        out = got if out is None else out.unionByName(got)
        found = checkpoint(next_frontier(got, seen), turn + 2)
        left = checkpoint(left.join(taken.select("id"), "id", "left_anti").select("url", "id").unionByName(found), turn + 3)
        seen = checkpoint(seen.unionByName(found.select("id")), turn + 4)
        asked, turn = asked + n, turn + 5
    return out if out is not None else spark.createDataFrame([], RECORD), left


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links, n_paragraphs of any pages, by patterns: no parser and no Python."""
    clean = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    heading = F.regexp_extract(clean, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return pages.select(
        "page_id",
        F.trim(F.regexp_replace(heading, "<[^>]*>", "")).alias("title"),
        F.size(F.regexp_extract_all(clean, F.lit(r"(?i)<a\s[^>]*href="), F.lit(0))).cast("bigint").alias("n_links"),
        F.size(F.regexp_extract_all(clean, F.lit(r"(?i)<p\b"), F.lit(0))).cast("bigint").alias("n_paragraphs"),
    )
