"""Main text of web pages by site template removal.

Every element subtree outside a page's article, and every box inside it, gets a hash of its tag, classes and content.
Spark counts on how many different pages of a host each subtree stands; those on many are the site's template and are
deleted. Inside the article the limit is higher, and paragraphs, headings and single lines stay, so that prose that is
printed several times does. Elements whose tag, role or class says that they are no article text go as well, on hosts with
too few pages to show a template and inside articles. What is left of the article is its text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, slices
from tidemark.llm.url_filters import host_of

#: A subtree is template if it stands on so many different pages of a host, and on such a share of them.
MIN_PAGES, MIN_SHARE = 4, 0.01
#: A box inside an article needs this share: prose that a host prints several times stands on few of its pages.
BOX_SHARE = 0.3
#: Template subtrees are broadcast up to so many (8 bytes each); beyond it they are joined.
BROADCAST = 2_000_000

#: HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
BOX = frozenset("address center details div dl figure hgroup ol section table ul".split())
CLOSES_P = BLOCK - frozenset("body html head title td th tr tbody thead tfoot caption option optgroup button legend".split())
SCOPE = frozenset("table td th caption button object template html".split())
CLOSED_BY_OWN = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist")),
}
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED_TAGS = frozenset(
    "nav footer aside form script style noscript iframe template svg annotation annotation-xml object embed canvas audio video button "
    "select option input textarea label fieldset dialog menu head title search xmp noembed noframes".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog status menu menubar toolbar tablist".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads adv advert adverts advertisement advertising sponsor "
    "sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup "
    "modal overlay share sharing social comment comments disqus replies reply respond pagination pager related recommended widget "
    "toolbar masthead skip".split()
)
#: Words that may stand beside a dropped word in a class: they name a part of a page, not a subject.
PART_WORDS = frozenset(
    "area article articles aside banner bar block body bottom box button buttons card cards center col column content container count entry "
    "feed fixed footer form grid group head header holder icon icons id inline inner item items js layout left link links list main message "
    "mobile module outer page panel post posts primary reader right row section secondary site slot small story stories sticky "
    "text title to top unit user wide wrap wrapper".split()
)
#: Beside the dropped words: classes of articles, or of what holds them, that are another page's.
TEASER_WORDS = DROPPED_WORDS | frozenset("teaser teasers".split())
ARTICLE_ROLES = frozenset(("article", "main"))

#: At a "<": a tag with closed quotes, or else all up to the next ">".
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
COMMENT_END = re.compile("--!?>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+|\d+")


class Tree:
    """A page's elements in page order: tag, attributes, parent, and content (texts and element numbers). Element 0 holds the page."""

    def __init__(self, html: str) -> None:
        self.tags, self.attrs, self.parents, self.content = ["#page"], [{}], [0], [[]]
        open_, places, at, end = [0], {}, 0, len(html)  # places: where the open elements of a tag lie in open_
        closed, marked_up = html.rfind(">"), html.rfind("]]>")

        def close(place: int) -> None:
            while len(open_) > place:
                places[self.tags[open_.pop()]].pop()

        def last(tags) -> int:
            """The innermost open element of these tags, -1 if there is none."""
            return max((places[t][-1] for t in tags if places.get(t)), default=-1)

        def plain(begin: int, stop: int) -> None:
            if stop > begin:
                self.content[open_[-1]].append(html[begin:stop])

        begin = 0
        while at < end:
            at = html.find("<", at)
            if at < 0:
                break
            if html.startswith("<!--", at):
                plain(begin, at)
                stop = COMMENT_END.search(html, at + 4)
                begin = at = stop.end() if stop else end
                continue
            if html.startswith("<![CDATA[", at) and at + 9 <= marked_up:
                plain(begin, at)
                stop = html.find("]]>", at + 9)
                if stop > at + 9:
                    self.content[open_[-1]].append(entities.escape(html[at + 9 : stop]))
                begin = at = stop + 3
                continue
            if at > closed:  # no tag ends any more
                at += 1
                continue
            if html.startswith(("<!", "<?"), at):
                plain(begin, at)
                begin = at = html.find(">", at) + 1
                continue
            m = TAG.match(html, at) or LOOSE_TAG.match(html, at)
            if m is None:
                at += 1
                continue
            plain(begin, at)
            begin = at = m.end()
            slash, tag, attrs = m[1], m[2].lower(), m[3]
            if slash:
                place = last((tag,))
                if place > 0 and (tag in SCOPE or tag in ("body", "tr", "tbody", "thead", "tfoot") or place > last(SCOPE)):
                    close(place)
                continue
            if tag in CLOSES_P and (place := last(("p",))) > last(SCOPE):
                close(place)
            if tag in CLOSED_BY_OWN:
                same, stops = CLOSED_BY_OWN[tag]
                if (place := last(same.split())) > last(stops):
                    close(place)
            n = len(self.tags)
            self.tags.append(tag)
            self.attrs.append({a.lower(): entities.unescape(x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(attrs)} if attrs.strip(" /") else {})
            self.parents.append(open_[-1])
            self.content.append([])
            self.content[open_[-1]].append(n)
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(html, at)
                if tag in ("title", "textarea"):
                    self.content[n].append(html[at : stop.start()])
                begin = at = max(stop.end(), at)
            elif tag not in VOID and not attrs.endswith("/") or tag in BLOCK and tag not in VOID:
                places.setdefault(tag, []).append(len(open_))
                open_.append(n)
        plain(begin, end)

    def dropped(self, n: int) -> bool:
        """Whether tag, role or class say that the element is no article text."""
        tag, attrs = self.tags[n], self.attrs[n]
        if tag in DROPPED_TAGS:
            return True
        if not attrs or tag in ("html", "body", "#page", "article", "main"):
            return False
        if "hidden" in attrs or attrs.get("role", "").lower() in DROPPED_ROLES:
            return True
        return self._named(n, DROPPED_WORDS)

    def _named(self, n: int, words: frozenset[str]) -> bool:
        """Whether a class or the id consists of one of the words and words for parts of pages: cookie-notice, but not social-policy or notice-board."""
        attrs = self.attrs[n]
        for name in (attrs.get("class") or "").split() + [attrs.get("id") or ""]:
            found = WORDS.findall(name.lower())
            if not words.isdisjoint(found) and all(x in words or x in PART_WORDS or x.isdigit() or len(x) == 1 for x in found):
                return True
        return False

    def sizes(self, removed: set[int] | frozenset[int] = frozenset()) -> list[int]:
        """Characters of text below each element, without the removed ones."""
        out = [0] * len(self.tags)
        for n in range(len(self.tags) - 1, -1, -1):
            out[n] = 0 if n in removed else out[n] + sum(len(x.strip()) for x in self.content[n] if isinstance(x, str))
            if n:
                out[self.parents[n]] += out[n]
        return out

    def article(self, removed: set[int] | frozenset[int] = frozenset()) -> int:
        """The outermost article, held by no dropped element, with the most text left; without one, such a main element; else the whole page."""
        found = self._found(DROPPED_WORDS)
        size = self.sizes(removed)
        return max(found, key=lambda n: (size[n], -n), default=0)

    def articles(self, removed: set[int] | frozenset[int] = frozenset()) -> list[int]:
        """All outermost articles in page order but those that they or their holders mark as teasers, comments and the like; if all are marked, the longest."""
        found = [n for n in self._found(TEASER_WORDS) if not self._marked(n, TEASER_WORDS)]
        return found or [self.article(removed)]

    def _marked(self, n: int, words: frozenset[str]) -> bool:
        attrs = self.attrs[n]
        return "hidden" in attrs or attrs.get("role", "").lower() in DROPPED_ROLES or self._named(n, words)

    def _found(self, words: frozenset[str]) -> list[int]:
        """Outermost articles that no dropped element holds and none marked by words; without one, outermost main elements."""
        gone = [False] * len(self.tags)
        found: dict[str, list[int]] = {"article": [], "main": []}
        inside = {"article": [False] * len(self.tags), "main": [False] * len(self.tags)}
        for n in range(1, len(self.tags)):
            up = self.parents[n]
            tag, role = self.tags[n], self.attrs[n].get("role")
            kind = "article" if "article" in (tag, role) or self.attrs[n].get("itemprop") == "articleBody" else "main" if "main" in (tag, role) else ""
            teaser = words is TEASER_WORDS and not kind and tag not in ("html", "body") and self._marked(n, words)
            gone[n] = gone[up] or self.dropped(n) or teaser
            for k in found:
                inside[k][n] = inside[k][up] or kind == k
            if kind and not gone[n] and not inside[kind][up]:
                found[kind].append(n)
        return found["article"] or found["main"]

    def hashes(self) -> list[bytes]:
        """Of each element's subtree: its tag, classes, texts and parts, in order."""
        out = [b""] * len(self.tags)
        for n in range(len(self.tags) - 1, -1, -1):
            h = hashlib.blake2b(f"{self.tags[n]} {self.attrs[n].get('class', '')}\0".encode("utf-8", "surrogatepass"), digest_size=8)
            for x in self.content[n]:
                h.update(out[x] if isinstance(x, int) else " ".join(x.split()).encode("utf-8", "surrogatepass"))
            out[n] = h.digest()
        return out

    def lines(self) -> list[int]:
        """How many blocks below each element, itself included, have text of their own or of inline elements; a link that is no licence counts as one more."""
        out, own = [0] * len(self.tags), [False] * len(self.tags)
        for n in range(len(self.tags) - 1, -1, -1):
            own[n] = own[n] or any(isinstance(x, str) and x.strip() for x in self.content[n])
            up = self.parents[n]
            if self.tags[n] in BLOCK:
                out[n] += own[n]
            elif own[n]:
                own[up] = True
                out[n] += self.tags[n] == "a" and "license" not in self.attrs[n].get("rel", "").lower()
            if n:
                out[up] += out[n]
        return out

    def subtrees(self, host: bytes, every: bool = False) -> list[tuple[int, int]]:
        """(number, element) of each block outside the article that has text, and of each box inside it with more than a line; the number is the same for equal subtrees of a host, even outside and odd inside.

        Of several articles, all but the longest count as blocks outside as well: a teaser recurs as a whole.
        """
        roots, hashes, size, lines = self.articles() if every else [self.article()], self.hashes(), self.sizes(), self.lines()
        longest, holds, within = max(roots, key=lambda n: (size[n], -n)), set(), [False] * len(self.tags)
        for n in roots:
            within[n] = n > 0
            n = n if n == longest else self.parents[n]
            while n and n not in holds:
                holds.add(n)
                n = self.parents[n]
        out, root = [], set(roots)
        for n in range(1, len(self.tags)):
            within[n] = within[n] or within[self.parents[n]]
            if n in holds or not size[n]:
                continue
            boxed = within[n] and n not in root
            if self.tags[n] in BOX and lines[n] > 1 if boxed else self.tags[n] in BLOCK and self.tags[n] not in ("html", "body", "head", "title"):
                number = int.from_bytes(hashlib.blake2b(host + hashes[n], digest_size=8).digest(), "little", signed=True)
                out.append((number | 1 if boxed else number & ~1, n))
        return out

    def text(self, removed: set[int], every: bool = False) -> str:
        """The article's blocks, one a line; with every, those of all articles."""
        roots, blocks, now = self.articles(removed) if every else [self.article(removed)], [], []
        root = set(roots)
        stack: list = [("open", n) for n in reversed(roots)]

        def flush() -> None:
            if line := " ".join(entities.unescape("".join(now)).split()):
                blocks.append(line)
            now.clear()

        while stack:
            what, n = stack.pop()
            if what == "text":
                now.append(n)
            elif what == "flush":
                flush()
            elif n not in removed and (n in root or not (self.dropped(n) or (0 in root and self.tags[n] == "header"))):
                block = self.tags[n] in BLOCK
                if block:
                    flush()
                    stack.append(("flush", 0))
                elif self.tags[n] == "br":
                    now.append("\n")
                stack += [("text", x) if isinstance(x, str) else ("open", x) for x in reversed(self.content[n])]
        flush()
        return "\n".join(blocks)


def _signed(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def template_counts(rows: DataFrame, every: bool = False) -> DataFrame:
    """rows (host, html): for each subtree of a host, on how many different pages it stands: host number, subtree number, pages.

    A page's own row has the host's number as its subtree. Copies of a page count once. The counting is keyed by subtree
    and page, so a hot host is dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hosts, trees, pages = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = host.encode("utf-8", "surrogatepass")
                own, page = _signed(key), _signed(html.encode("utf-8", "surrogatepass"))
                found = {own, *(x for x, _ in Tree(html).subtrees(key, every))}
                hosts += [own] * len(found)
                trees += found
                pages += [page] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, trees, pages)], ["host", "tree", "page"])

    return rows.mapInArrow(run, "host long, tree long, page long").distinct().groupBy("host", "tree").agg(F.count("*").alias("pages"))


def template_subtrees(rows: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, box_share: float = BOX_SHARE, every: bool = False) -> DataFrame:
    """Numbers of the subtrees that recur across many pages of their host."""
    share = F.when(F.col("tree") % 2 == 0, min_share).otherwise(max(min_share, box_share))
    counts = durable(template_counts(rows, every).where((F.col("pages") >= min_pages) | (F.col("host") == F.col("tree"))), "subtrees")
    hosts = counts.where("host = tree").select("host", F.col("pages").alias("all"))
    return counts.where("host != tree").join(hosts, "host").where((F.col("pages") >= min_pages) & (F.col("pages") >= share * F.col("all"))).select("tree")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, box_share: float = BOX_SHARE, broadcast_rows: int = BROADCAST, every: bool = False) -> DataFrame:
    """id, url, text, n_chars of each page; of a page with several articles the longest, with every all that aren't marked or template.

    A null html has the empty text; a null url belongs to the host "". Null and repeated ids and repeated rows give a row
    each; of equally long articles the first counts as the longest; an empty table gives none; other columns are not read.
    Pages are read whole, one at a time.
    """
    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col), F.col(url_col), host_of(F.col(url_col)).alias("_host"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    template = durable(template_subtrees(rows.select("_host", "_html"), min_pages=min_pages, min_share=min_share, box_share=box_share, every=every), "template")
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long"
    small = template.count() <= broadcast_rows
    known = template.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in template.collect()], np.int64))) if small else None
    if not small:  # too many to broadcast: each page gets the numbers of its own, by a join
        own = _page_subtrees(rows, every).join(template, "tree").groupBy("page").agg(F.collect_set("tree").alias("_trees"))
        rows = rows.withColumn("page", _page_key()).join(own, "page", "left").drop("page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            listed = batch.column(4).to_pylist() if not small else [None] * len(batch)
            for host, html, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), listed, strict=True):
                tree = Tree(html)
                found = tree.subtrees(host.encode("utf-8", "surrogatepass"), every)
                if small:
                    at = np.searchsorted(known.value, np.array([x for x, _ in found], np.int64)) if len(known.value) and found else []
                    removed = {n for (x, n), k in zip(found, at, strict=False) if k < len(known.value) and known.value[k] == x}
                else:
                    listed_here = set(own or ())
                    removed = {n for x, n in found if x in listed_here}
                texts.append(tree.text(removed, every))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def _page_key() -> Column:
    return F.sha2(F.concat_ws("\n", "_host", "_html"), 256)


def _page_subtrees(rows: DataFrame, every: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pages, trees = [], []
            for page, host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = {x for x, _ in Tree(html).subtrees(host.encode("utf-8", "surrogatepass"), every)}
                pages += [page] * len(found)
                trees += found
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.string()), pa.array(trees, pa.int64())], ["page", "tree"])

    return rows.select(_page_key().alias("page"), "_host", "_html").mapInArrow(run, "page string, tree long").distinct()
