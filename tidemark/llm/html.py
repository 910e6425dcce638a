"""Main text of web pages by the container paths that the pages of a host agree on.

Each page is read into blocks of text and the containers that hold them. Containers are scored by their
text outside of navigation, adverts, forms and the like, and by depth only where they hold the same; the best one votes, with its
generalised path of tags and classes, for its host. Votes are summed in Spark, and every page is extracted
again with its host's winning path; a page without that path uses its own best container.

Elements whose tag, role or attributes say that they are no article are left out. A class or id only counts
as evidence: all of its words must speak of boilerplate, and an element that holds most of a page's text is
left out for its class only where an article or main element outside of it holds text.

Text is never dropped for its length. The votes carry paths, not texts, so pages are read twice: to keep
what the first reading found would mean to write all texts out and read them again. The winners are counted
and broadcast to the pages where they are few; otherwise both are joined by host and salt, so that a hot
host is split.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, slices, staged

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|iframe|title|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements that hold no article text, those without content, those that end a block, and words of boilerplate classes.
DROPPED = frozenset("nav header footer aside form button menu dialog head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article blockquote body center dd div main section td".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies "
    "disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pagination paywall popup promo "
    "promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget".split()
)
#: Words of names that speak of readers' comments.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: Words that may stand beside those of boilerplate in a name without changing its sense.
NEUTRAL = frozenset("area bar block bottom box container inner item items left link links list nav outer overlay panel right section slot top unit wrap wrapper".split())
#: An element of the first kind ends an open one of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SPACE = re.compile(r"\s+")
#: Hosts whose winning paths may be broadcast (about 100 bytes each); beyond, pages are joined by host and salt.
BROADCAST_HOSTS, SALTS = 100_000, 64


def speaks_of_boilerplate(name: str) -> bool:
    """Whether all words of a class or an id are boilerplate or neutral, and one at least is boilerplate."""
    if name in BOILERPLATE:
        return True
    words = {w for w in re.split(r"[-_\d]+", name) if w}
    return not words.isdisjoint(BOILERPLATE) and words <= BOILERPLATE | NEUTRAL


class Page:
    """Nodes (parent, path, dropped) and blocks (node, text, characters of link text) of a page."""

    def __init__(self, html: str):
        self.parents, self.paths, self.dropped, self.tags = [-1], [""], [False], [""]
        self.suspects: dict[int, bool] = {}  # nodes that their class or id speaks against, and whether as comments
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html)
        self._judge()

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open elements and the node each belongs to
        text: list[str] = []
        linked, links = 0, 0

        def flush() -> None:
            nonlocal linked
            if text:
                joined = _SPACE.sub(" ", "".join(text)).strip()
                if joined:
                    self.blocks.append((stack[-1][1], joined, linked))
                text.clear()
            linked = 0

        def close(to: int) -> None:
            nonlocal links
            links -= sum(t == "a" for t, _ in stack[to:])
            del stack[to:]

        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                text.append(unescape(html[at : m.start()]))
                linked += (m.start() - at) * (links > 0)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                text.append(" ") if m["raw"] else None
                continue
            tag = tag.lower()
            block = tag in BLOCKS
            if block:
                flush()
            if m["end"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if not block and any(t in BLOCKS for t, _ in stack[i + 1 :]):
                            break
                        close(i)
                        break
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    text.append(" ")
                continue
            if block:
                ended = CLOSES.get(tag, ()) or ("p",)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ended or stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in CONTAINERS or stack[i][0] in ("table", "ul", "ol", "dl"):
                        break
            node = stack[-1][1]
            marks = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(m["attrs"])} if m["attrs"] else {}
            named = marks.get("class", "").lower().split()
            away = tag in DROPPED or "hidden" in marks or marks.get("aria-hidden") == "true" or marks.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog")
            suspect = not away and tag not in ("html", "body", "article", "main") and any(map(speaks_of_boilerplate, {*named, marks.get("id", "").lower()}))
            if block or away or suspect:
                kind = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in named})])
                self.parents.append(node)
                self.paths.append(f"{self.paths[node]}/{kind}")
                self.dropped.append(away or self.dropped[node])
                self.tags.append(tag)
                node = len(self.parents) - 1
                if suspect:
                    words = re.split(r"[-_\d\s]+", f"{marks.get('class', '')} {marks.get('id', '')}".lower())
                    self.suspects[node] = not COMMENTS.isdisjoint(words)
            stack.append((tag, node))
            links += tag == "a"
        if at < len(html):
            text.append(unescape(html[at:]))
        flush()

    def _judge(self) -> None:
        """Drop the suspects and all in them, but for those that hold most of the text.

        Such a one goes, too, where an article or main element outside of it holds text, or where its name
        speaks of readers' comments and anything else on the page holds text.
        """
        if not self.suspects:
            return
        own, ended = [0] * len(self.parents), list(range(len(self.parents)))  # characters in a node, and the last node in it
        for node, text, _ in self.blocks:
            own[node] += 0 if self.dropped[node] else len(text)
        for node in range(len(own) - 1, 0, -1):
            own[self.parents[node]] += own[node]
            ended[self.parents[node]] = max(ended[self.parents[node]], ended[node])
        for node in range(1, len(own)):
            if node in self.suspects and not self.dropped[node]:
                if 2 * own[node] <= own[0]:
                    self.dropped[node] = True
                elif self.suspects[node]:
                    self.dropped[node] = own[0] > own[node]
                else:  # at most one for each level of depth
                    self.dropped[node] = any(
                        self.tags[n] in ("article", "main") and own[n] and not node <= n <= ended[node] and not n <= node <= ended[n] and self._stands(n) for n in range(1, len(own))
                    )
            self.dropped[node] = self.dropped[node] or self.dropped[self.parents[node]]

    def _stands(self, node: int) -> bool:
        while node > 0:
            if node in self.suspects or self.dropped[node]:
                return False
            node = self.parents[node]
        return True

    def best(self) -> int:
        """The container with the most kept text, by a bonus for meaning; the deepest of those that hold the same."""
        own = [0] * len(self.parents)
        for node, text, linked in self.blocks:
            if not self.dropped[node]:
                own[node] += max(0, len(text) - linked)
        for node in range(len(own) - 1, 0, -1):
            own[self.parents[node]] += own[node]
        depth = [0] * len(own)
        found, top = 0, (-1, 0)
        for node in range(1, len(own)):
            depth[node] = depth[self.parents[node]] + 1
            if self.tags[node] in CONTAINERS and not self.dropped[node] and own[0]:
                score = (own[node] * (3 if self.tags[node] in ("article", "main") else 2), depth[node])
                if score > top:
                    found, top = node, score
        return found

    def text(self, path: str | None) -> str:
        """The blocks inside the elements of a path, or inside the page's own best container if there is none."""
        inside = [False] * len(self.parents)
        roots = {i for i, p in enumerate(self.paths) if p == path and not self.dropped[i]} if path else set()
        roots = roots or {self.best()}
        for node in range(len(inside)):
            inside[node] = node in roots or (node > 0 and inside[self.parents[node]])
        return "\n".join(t for node, t, _ in self.blocks if inside[node] and not self.dropped[node])


def _hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))


def host_paths(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The winning path of each host, by pages that voted for it; ties go to the greater path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            votes: dict[tuple[str, str], int] = defaultdict(int)
            for batch in slices(whole, "html"):
                for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    page = Page(html or "")
                    if node := page.best():
                        votes[host, page.paths[node]] += 1
            keys = list(votes)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64())], ["host", "path", "votes"])

    votes = in_batches(_hosted(pages, id_col, url_col, html_col).select("host", "html")).mapInArrow(run, "host string, path string, votes long")
    return votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")).groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page. Null and empty pages give an empty text; pages without a host form one group.

    Repeated rows are extracted each for itself; other columns are not read.
    """
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                found = [Page(h or "").text(p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    paths = staged(host_paths(pages, id_col, url_col, html_col), "host_paths")
    hosted = _hosted(pages, id_col, url_col, html_col)
    if paths.count() <= BROADCAST_HOSTS:
        joined = hosted.join(F.broadcast(paths), "host", "left")
    else:  # a host's pages are dealt over SALTS tasks
        spread = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "path")
    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
