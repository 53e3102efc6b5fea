"""Main text of web pages, with the site's template removed.

Each page is read into a light element tree. The hash of every container element's
subtree goes to Spark, which counts on how many pages of its host it stands; a
subtree that stands on many of them is template and is deleted, before the article
is looked for in what is left. The article, without elements that by name, class or
id are not part of it, is the page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from observatory.llm.filters import bitmap
from observatory.shared import cut

#: A subtree is template if it stands on at least so many pages of its host, and on log2 of the host's pages: chance
#: repeats grow with a host, but far less than it.
LEAST_PAGES = 5
#: Up to so many template hashes are broadcast (8 bytes each); beyond, pages get theirs by a join.
BROADCAST_HASHES = 1_000_000

_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
_REST = re.compile(r"""(?:[^'">]+|"[^"]*"|'[^']*')*+>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s/])([^\s=/]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "svg", "math")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that a subtree is hashed for.
_CONTAINER = frozenset("aside div dl fieldset figure footer form header main menu nav ol p section table ul".split())
_DROPPED = frozenset("aside audio button canvas dialog embed fieldset footer form head header iframe input menu nav noscript object script select style svg template textarea title video".split())
_HINTS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_BODIES = frozenset("article articlebody content entry post story".split())
#: A class such as no-sidebar says nothing of the element itself.
_NEGATIONS = frozenset("has no with without".split())
#: An open element that the start of another one closes.
_ENDS = {t: frozenset(x.split()) for t, x in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
_SCOPES = frozenset("ul ol dl table select article section main body html div td".split())
_CELL_SCOPES = _SCOPES - {"td"}
_P = frozenset(("p",))
_CLOSES_P = _BLOCK - frozenset("body br caption dd dt head html legend li option summary tbody td tfoot th thead title tr".split()) | {"li", "dd", "dt", "td", "tr"}


class Page:
    """Elements in document order: tag, attributes, parent, the range of events inside; events are texts and element starts."""

    def __init__(self, source: str) -> None:
        self.tag, self.attributes, self.parent = ["#root"], [""], [-1]
        self.first, self.stop = [0], [0]
        #: (element, text) for text; (element, None) where an element of its own block begins or ends.
        self.events: list[tuple[int, str | None]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str) -> int:
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.parent.append(self._stack[-1])
        self.first.append(len(self.events))
        self.stop.append(-1)
        return len(self.tag) - 1

    def _push(self, element: int) -> None:
        self._at[self.tag[element]].append(len(self._stack))
        self._stack.append(element)

    def _pop(self) -> None:
        element = self._stack.pop()
        self._at[self.tag[element]].pop()
        self.stop[element] = len(self.events)
        if self.tag[element] in _BLOCK:
            self.events.append((self._stack[-1] if self._stack else 0, None))

    def _innermost(self, tags: frozenset[str]) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=0)

    def _close(self, tags: frozenset[str], scopes: frozenset[str]) -> None:
        """Ends the innermost open element of ``tags`` unless one of ``scopes`` stands in between."""
        at = self._innermost(tags)
        if at and at >= self._innermost(scopes):
            while len(self._stack) > at:
                self._pop()

    def _read(self, source: str) -> None:
        """One pass; a tag that never ends as quotes have it makes this one and all behind it end at the next ``>``."""
        self._stack: list[int] = []
        self._at: dict[str, list[int]] = defaultdict(list)
        self._push(0)
        at, quotes = 0, True
        while True:
            found = _START.search(source, at)
            text = source[at : found.start() if found else len(source)]
            if text:
                self.events.append((self._stack[-1], text))
            if not found:
                break
            tag = found[2]
            if tag is None:
                mark = "-->" if found[0] == "<!--" else ">"
                end = source.find(mark, found.end())
                at = end + len(mark) if end >= 0 else len(source)
                continue
            rest = _REST.match(source, found.end()) if quotes else None
            if rest is None:
                quotes = False
                end = source.find(">", found.end()) + 1
                if not end:
                    self.events.append((self._stack[-1], source[found.start() :]))
                    break
            else:
                end = rest.end()
            attributes, at, tag = source[found.end() : end - 1], end, tag.lower()
            if found[1]:
                if tag not in _VOID:
                    self._close(frozenset((tag,)), frozenset() if tag in ("body", "html", "article", "main", "table", "div", "section") else frozenset(("article", "main")) - {tag})
                continue
            if tag in _CLOSES_P:
                self._close(_P, _SCOPES)
            if tag in _ENDS:
                self._close(_ENDS[tag], _CELL_SCOPES if tag in ("td", "th", "tr") else _SCOPES)
            if tag in _BLOCK:
                self.events.append((self._stack[-1], None))
            element = self._open(tag, attributes)
            if tag in _VOID or (attributes.endswith("/") and tag in ("svg", "math")):
                self.stop[element] = len(self.events)
            elif tag in _RAW:
                close = _RAW[tag].search(source, at)
                self.events.append((element, source[at : close.start() if close else len(source)]))
                self.stop[element] = len(self.events)
                at = close.end() if close else len(source)
            else:
                self._push(element)
        while self._stack:
            self._pop()

    def words(self, element: int) -> tuple[set[str], str]:
        """(words of class and id, role)."""
        out: set[str] = set()
        role = ""
        if self.attributes[element]:
            for name, value in _ATTRIBUTE.findall(self.attributes[element]):
                value = value.strip("\"'").lower()
                if name.lower() in ("class", "id", "itemprop"):
                    for x in value.split():
                        parts = set(re.split(r"[^a-z]+", x))
                        if not parts & _NEGATIONS:
                            out |= parts
                elif name.lower() == "role":
                    role = value
        return out, role

    def facts(self) -> None:
        """Fills size (text lengths inside), dropped (named as no part of an article) and hashes of containers."""
        n = len(self.tag)
        self.size, self.dropped, self.named, self.hashes = [0] * n, [False] * n, [set()] * n, [0] * n
        parts: list[list[str]] = [[] for _ in range(n)]
        for element, text in self.events:
            if text is not None:
                clean = " ".join(text.split())
                self.size[element] += len(clean)
                parts[element].append(clean)
        for i in range(1, n):
            words, role = self.words(i)
            self.named[i] = words
            structural = self.tag[i] in ("html", "body", "main", "article")
            self.dropped[i] = self.tag[i] in _DROPPED or (bool(words & _HINTS or role in _ROLES) and (not structural or (self.tag[i] == "article" and bool(words & {"comment", "comments", "related", "promo", "sponsored", "ad"}))))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.size[p] += self.size[i] if not self.dropped[i] else 0
            own = f"<{self.tag[i]} {' '.join(sorted(self.named[i]))}>{' '.join(parts[i])}"
            parts[p].append(own + "</>" if len(own) < 64 else f"#{xxhash.xxh3_64_hexdigest(own)}")
            if self.tag[i] in _CONTAINER:
                self.hashes[i] = xxhash.xxh3_64_intdigest(own)

    def root(self, gone: list[bool]) -> int:
        """The article: the largest <article> that isn't gone, else <main>, else an element named as content, else the page."""
        n = len(self.tag)
        size = [0] * n
        for element, text in self.events:
            if text is not None and not gone[element]:
                size[element] += len(text.strip())
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        for wanted in (lambda i: self.tag[i] == "article", lambda i: self.tag[i] == "main" or "role" in self.attributes[i] and self.words(i)[1] == "main", lambda i: bool(self.named[i] & _BODIES) and self.tag[i] in ("div", "section", "td")):
            found = [i for i in range(1, n) if not gone[i] and size[i] and wanted(i)]
            if found:
                return max(found, key=lambda i: (size[i], -i))
        return 0

    def _gone(self, template: set[int]) -> list[bool]:
        gone = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            gone[i] = self.dropped[i] or i in template or gone[self.parent[i]]
        return gone

    def marked(self, template: frozenset[int] | set[int], host: bytes) -> set[int]:
        """The elements that counts take out, whatever they are called."""
        marked = {i for i in range(1, len(self.tag)) if self.hashes[i] and template and key(host, self.hashes[i]) in template}
        # what is most of a page is its article, and so are paragraphs within one, whatever other pages repeat
        return {i for i in marked if 2 * self.size[i] < self.size[0] and not (self.tag[i] == "p" and self._in_article(i))}

    def shares(self, template: frozenset[int] | set[int], host: bytes) -> tuple[int, int, int, int]:
        """Characters of the page's visible text that counts take out, that names take out of the rest, that lie outside the article, and that stay."""
        marked = self.marked(template, host)
        counted, named = [False] * len(self.tag), [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            counted[i] = i in marked or counted[self.parent[i]]
            named[i] = self.dropped[i] or named[self.parent[i]]
        hidden = [t in _RAW for t in self.tag]
        root = self.root([a or b for a, b in zip(counted, named)])
        low, high = (self.first[root], self.stop[root]) if root else (0, len(self.events))
        out = [0, 0, 0, 0]
        for at, (element, text) in enumerate(self.events):
            if text is not None and not hidden[element]:
                out[0 if counted[element] else 1 if named[element] else 3 if low <= at < high else 2] += len(" ".join(text.split()))
        return tuple(out)

    def text(self, template: frozenset[int] | set[int], host: bytes) -> str:
        """Without the subtrees in ``template``, which go first; names decide on what is left, and the article is looked for in the rest."""
        marked = self.marked(template, host)
        out = self._joined(marked)
        return out if out or not marked else self._joined(set())

    def _in_article(self, i: int) -> bool:
        while i > 0:
            i = self.parent[i]
            if self.tag[i] in ("article", "main") or self.named[i] & _BODIES:
                return True
        return False

    def _joined(self, template: set[int]) -> str:
        gone = self._gone(template)
        root = self.root(gone)
        blocks: list[str] = []
        run: list[str] = []
        stop = self.stop[root] if root else len(self.events)
        for element, text in self.events[self.first[root] : stop]:
            if text is None:
                if run:
                    blocks.append("".join(run))
                    run = []
            elif not gone[element]:
                run.append(entities.unescape(text) if "&" in text else text)
        blocks.append("".join(run))
        return " ".join(" ".join(blocks).split())


def key(host: bytes, subtree: int) -> int:
    x = xxhash.xxh3_64_intdigest(host + subtree.to_bytes(8, "little"))
    return x - (1 << 64) if x >= 1 << 63 else x


def host_of(url: str | None) -> bytes:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/", 1)[0].split("?", 1)[0].rpartition("@")[2].encode("utf-8", "surrogatepass")


def _parsed(source: str | None) -> Page:
    page = Page(source or "")
    page.facts()
    return page


def _subtrees(pages: DataFrame) -> DataFrame:
    """Rows (host, subtree, text) of each page's distinct container subtrees, and (host, null, text) once a page.

    ``pages`` is (url, html); text is a hash of the page's text as it is with no
    templates known, so that copies of a page can count as one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, keys, texts = [], [], []
            for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                host = host_of(url)
                page = _parsed(source)
                found = {key(host, h) for h in page.hashes if h}
                hosts += [key(host, 0)] * (len(found) + 1)
                keys += [None, *found]
                texts += [key(page.text(frozenset(), host).encode("utf-8", "surrogatepass"), 0)] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (hosts, keys, texts)], names=["host", "subtree", "text"])

    return pages.mapInArrow(run, "host long, subtree long, text long")


def template_subtrees(df: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """Rows (subtree): hashes, of host and subtree, of the subtrees that many pages of their host hold.

    Pages of one host with the same text count as one: what copies of an article share is no template.
    """
    counted = _subtrees(df.select(url_col, html_col)).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    pages = counted.where("subtree is null").select("host", F.col("n").alias("pages"))
    often = counted.where(F.col("subtree").isNotNull() & (F.col("n") >= least_pages))
    return often.join(pages, "host").where(F.col("n") >= F.log2("pages")).select("subtree").distinct()


def removal_shares(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (counted, named, outside, kept): characters of visible text that each rule takes out of all pages, counts before names.

    ``outside`` is what lies outside the article that is found. For looking at; the
    template hashes are collected.
    """
    found = frozenset(r[0] for r in template_subtrees(df, url_col, html_col).collect())
    shared = df.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_parsed(h).shares(shared.value, host_of(u)) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["counted", "named", "outside", "kept"])

    sums = df.select(url_col, html_col).mapInArrow(run, "counted long, named long, outside long, kept long")
    return sums.agg(*(F.sum(c).alias(c) for c in ("counted", "named", "outside", "kept")))


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """Rows (id_col, url_col, text, n_chars): the main text of each page.

    Character references are decoded, white space within and between blocks is one
    space, the ends are trimmed. A null or empty page has the empty text; null urls
    are one host. Rows keep their number; equal rows give equal rows; other columns
    are ignored. An empty table gives no rows. A page takes time in proportion to its
    length, however its tags nest.
    """
    spark = df.sparkSession
    template = cut(template_subtrees(df, url_col, html_col), "templates")
    types = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars long"
    pages = df.select(id_col, url_col, html_col)
    names = [id_col, url_col, "text", "n_chars"]

    def done(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    if template.count() <= broadcast_hashes:
        found = np.array([r[0] for r in template.collect()], dtype=np.int64)
        shared = spark.sparkContext.broadcast(found.tobytes())

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = frozenset(np.frombuffer(shared.value, np.int64).tolist())
            for b in batches:
                yield done(b, [_parsed(h).text(known, host_of(u)) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())])

        return pages.mapInArrow(run, types)

    may_be = bitmap(template, "subtree")
    page = F.xxhash64(id_col, url_col, html_col)

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys = [], []
            for u, h, p in zip(*(c.to_pylist() for c in b.columns)):
                host = host_of(u)
                own = np.array([key(host, x) for x in set(_parsed(h).hashes) if x], dtype=np.int64)
                own = own[may_be(own)].tolist() if len(own) else []
                rows += [p] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.int64())], names=["page", "subtree"])

    own = pages.select(url_col, html_col, page.alias("page")).mapInArrow(hits, "page long, subtree long").join(template, "subtree").groupBy("page").agg(F.collect_set("subtree").alias("template"))

    def run_joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield done(b, [_parsed(h).text(frozenset(k or ()), host_of(u)) for u, h, k in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))])

    return pages.withColumn("page", page).join(own, "page", "left").select(id_col, url_col, html_col, "template").mapInArrow(run_joined, types)
