"""Parsers of stored pages: cards from text snapshots, facts and bodies of detail pages, refinement links, pages as a data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Work types that end a chain of refinements.
WORK_TYPES = ("full-time", "part-time", "contract-temp", "casual-vacation")
LEAST_BODY = 80


def cards_from_text(titles: Column, blocks: Column) -> Column:
    """Cards of a page from its links' titles and its text blocks: as many of both, and each block opens with its title; else an error."""
    same = (F.size(titles) == F.size(blocks)) & F.forall(F.zip_with(titles, blocks, lambda t, b: F.startswith(F.lower(F.trim(b)), F.lower(F.trim(t)))), lambda ok: F.coalesce(ok, F.lit(False)))
    cards = F.zip_with(titles, blocks, lambda t, b: F.struct(F.trim(t).alias("title"), F.filter(F.transform(F.split(b, "\n"), F.trim), lambda x: x != "").alias("lines")))
    kind = "array<struct<title:string,lines:array<string>>>"
    return F.when(F.coalesce(same, F.lit(False)), cards.cast(kind)).otherwise(F.raise_error(F.lit("titles and blocks of a page differ")).cast(kind))


def detail_facts(payload: Column, paths: dict[str, list[str]]) -> Column:
    """Fields of a detail page's JSON, each from the first of its paths that has a value; ``terminal`` where the page says that the advert is gone."""
    pick = lambda ps: F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in ps])
    return F.struct(*[pick(ps).alias(name) for name, ps in paths.items()])


def lines_of(text: Column) -> Column:
    """Lines with white space collapsed; blank ones are left out."""
    flat = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.filter(flat, lambda x: x != "")


def body_text(lines: Column, start: str, stops: tuple[str, ...], within: int = 80, least: int = LEAST_BODY) -> Column:
    """The body between a start line, looked for in the first lines, and the first stop line; null if there is no start or too little text."""
    opened = F.array_position(F.transform(F.slice(lines, 1, within), F.lower), start)
    rest = F.slice(lines, F.greatest(opened, F.lit(0)).cast("int") + 1, F.greatest(F.size(lines), F.lit(1)))
    closed = F.array_min(F.transform(F.array(*[F.lit(s) for s in stops]), lambda s: F.nullif(F.array_position(F.transform(rest, F.lower), s), F.lit(0))))
    body = F.array_join(F.slice(rest, 1, F.coalesce(closed - 1, F.size(rest)).cast("int")), "\n")
    return F.when((opened > 0) & (F.length(body) >= least), body)


def without_match_box(lines: Column, head: str, more: str, within: int = 18, prose: int = 55) -> Column:
    """Lines after a profile box that opens a body: past its ``+n more`` line, else from the first line that reads like prose."""
    numbered = F.transform(F.slice(lines, 2, within - 1), lambda x, i: F.when(x.rlike(more), i + 2))
    last = F.array_min(numbered)
    prosaic = F.array_min(F.transform(F.slice(lines, 2, within - 4), lambda x, i: F.when((F.length(x) >= prose) | x.rlike(r"[.!?]$"), i + 2)))
    cut = F.when(last.isNotNull(), last + 1).otherwise(F.coalesce(prosaic, F.lit(2)))
    boxed = F.lower(F.get(lines, F.lit(0))) == head
    return F.when(F.coalesce(boxed, F.lit(False)), F.slice(lines, cut, F.size(lines))).otherwise(lines)


def header_facts(lines: Column, kinds: dict[str, str]) -> Column:
    """Facts of a page's header: for each name the first line that looks like it."""
    first = lambda pattern: F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0))
    return F.struct(*[first(pattern).alias(name) for name, pattern in kinds.items()])


def refinement_links(links: Column, level: str, slug: str, current: Column) -> Column:
    """Children of a listing by the shape of their paths: classification, subclassification, work type; each URL once, in order.

    ``links`` is an array of structs (href, label).
    """
    path_of = lambda c: F.regexp_replace(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    here = path_of(current)
    parts = lambda c: F.split(F.lower(path_of(c)), "/")  # noqa: E731  "", "jobs-in-x", ..., "in-slug"
    end = f"in-{slug.lower()}"

    def fits(link: Column) -> Column:
        p = parts(link["href"])
        if level == "state":
            return (F.size(p) == 3) & F.get(p, F.lit(1)).startswith("jobs-in-") & (F.get(p, F.lit(2)) == end)
        if level == "classification":
            own = F.get(F.split(F.lower(here), "/"), F.lit(1))
            return (F.size(p) == 4) & (F.get(p, F.lit(1)) == own) & (F.get(p, F.lit(3)) == end) & ~F.endswith(F.lower(here), F.concat(F.lit("/"), F.get(p, F.lit(2))))
        return F.startswith(path_of(link["href"]), F.concat(here, F.lit("/"))) & F.get(p, F.size(p) - 1).isin(*WORK_TYPES)

    child = {"state": "classification", "classification": "subclassification", "subclassification": "work_type"}[level]
    kept = F.filter(links, lambda x: (F.trim(x["href"]) != "") & (F.trim(x["label"]) != "") & F.coalesce(fits(x), F.lit(False)))
    first = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, 1, i), lambda y: y["href"] == x["href"]))
    return F.transform(first, lambda x: F.struct(F.lit(child).alias("level"), F.trim(F.regexp_replace(x["label"], r"\s+", " ")).alias("label"), x["href"].alias("url")))


def links_of(html: Column) -> Column:
    """(href, label) of a page's links, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=\"?([^\"\s>]+)\"?[^>]*>(.*?)</a>"), F.lit(0))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"(?i)href=\"?([^\"\s>]+)", 1).alias("href"), F.trim(F.regexp_replace(a, r"(?s)<[^>]*>", " ")).alias("label")))


class PageRange(InputPartition):
    def __init__(self, number: int):
        self.number = number


class ListingReader(DataSourceReader):
    """Rows of listing pages: one input partition for each page, ids that a page repeats once, the first winning."""

    def __init__(self, options: dict):
        self.pages, self.size, self.total = (int(options[k]) for k in ("pages", "size", "total"))
        self.repeat = int(options.get("repeat", 1))

    def partitions(self) -> list[InputPartition]:
        return [PageRange(i) for i in range(self.pages)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        seen = set()
        for place in range(self.size):
            row = (partition.number * self.size + place) // self.repeat
            if row < self.total and row not in seen:
                seen.add(row)
                yield (partition.number, place + 1, row)


class ListingSource(DataSource):
    """A paged listing as a data source: a stand-in for a site, whose pages are fetched where they are read.

    Options: ``pages``, ``size`` (rows of a page), ``total`` (rows that there are) and ``repeat`` (how often in a row a page shows each).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "page int, place int, id long"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))
