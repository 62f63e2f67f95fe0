"""Main text of stored web pages, with what a site repeats on its pages removed.

Every element subtree is hashed; Spark counts on how many different pages of a
host each hash occurs, and subtrees that many pages of a host share are deleted.
Paragraph-like elements of an article are never counted as templates, since sites
repeat passages of text as well. What remains is cut down by the meaning of the
markup: the article, without menus, forms and the like.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.llm.rows import map_rows
from contactmill.session import cut_lineage

# Kinds of HTML elements, and the words by which pages name their parts.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead table ul ol dl figcaption".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
DROPPED = frozenset("nav footer aside form menu dialog button select head object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED = re.compile(
    r"(ad|ads|advert\w*|sponsor\w*|promo|sidebar|menu|nav|navbar|navigation|header|footer|cookies?|notice|banner|"
    r"comments?|share|social|related|breadcrumbs?|newsletter|subscribe|popup|modal)([-_].*)?"
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
CLOSES = {  # a start tag of the key ends an open element of these names
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def unwanted(name: str, attributes: str, in_article: bool) -> bool:
    """Whether markup says that an element is no main text. A header within an article is its heading."""
    if name in DROPPED or (name == "header" and not in_article):
        return True
    for key, *values in ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        words = "".join(values).lower().split()
        if key.lower() == "role" and ROLES.intersection(words) or key.lower() != "role" and any(map(NAMED.fullmatch, words)):
            return True
    return False


class Page:
    """The blocks of text of one page, each with the innermost element it lies in.

    ``elements[i]`` is [name, hash, whether markup drops it, whether it is paragraph-like text of an article, index
    of the element around it or -1]; an element comes after those around it. ``blocks`` are (text, index of the element
    or -1). Reading takes time in proportion to the page, however deep its elements lie.
    """

    def __init__(self, source: str | None):
        self.elements: list[list] = []
        self.blocks: list[tuple[str, int]] = []
        self._open: list[tuple[int, object]] = []  # element, the running hash of what it holds
        self._names: Counter = Counter()  # of the open elements
        self._text: list[str] = []
        self._articles = 0
        self._read(source or "")

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            self._text.clear()
            if text:
                self.blocks.append((text, self._open[-1][0] if self._open else -1))
                if self._open:
                    octets = text.encode("utf-8", "replace")
                    self._open[-1][1].update(b"text %d " % len(octets) + octets)

    def _start(self, name: str, attributes: str) -> None:
        for ended in CLOSES.get(name, ()):
            self._end(ended, until=("ul", "ol", "dl", "table"))
        if name in BLOCK:
            self._end("p", until=("article", "main", "td", "th", "div"))
        self._articles += name in ("article", "main")
        drop = unwanted(name, attributes, self._articles > 0)
        textual = self._articles > 0 and (name in TEXTUAL or name in ("article", "main"))
        self.elements.append([name, None, drop, textual, self._open[-1][0] if self._open else -1])
        self._open.append((len(self.elements) - 1, hashlib.blake2b(f"<{name}>".encode("utf-8", "replace"), digest_size=8)))
        self._names[name] += 1

    def _end(self, name: str, until: tuple = ()) -> None:
        if not self._names[name]:
            return
        for at in range(len(self._open) - 1, -1, -1):
            inner = self.elements[self._open[at][0]][0]
            if inner == name:
                while len(self._open) > at:
                    self._close()
                return
            if inner in until:
                return

    def _close(self) -> None:
        i, held = self._open.pop()
        element = self.elements[i]
        self._names[element[0]] -= 1
        self._articles -= element[0] in ("article", "main")
        digest = held.digest()
        if self._open:
            self._open[-1][1].update(b"element " + digest)
        if not element[3]:
            element[1] = int.from_bytes(digest, "little", signed=True)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            tag = TAG.search(source, at)
            if tag is None:
                self._text.append(source[at:])
                break
            self._text.append(source[at:tag.start()])
            at = tag.end()
            name = (tag[2] or tag[5] or "").lower()
            closing, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
            if not name:
                continue
            if name in RAW:
                self._text.append(" ")
                if not closing and not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else size
            elif name in VOID:
                self._text.append(" ")
                if name == "hr":
                    self._flush()
            elif closing:
                if name in BLOCK or self._names[name]:
                    self._flush()
                    self._end(name)
            elif name in BLOCK or unwanted(name, attributes, self._articles > 0):
                self._flush()
                self._start(name, attributes)
        self._flush()
        while self._open:
            self._close()

    def subtrees(self) -> list[int]:
        return sorted({e[1] for e in self.elements if e[1] is not None and e[0] not in ("html", "body")})

    def main_text(self, templates: frozenset = frozenset()) -> str:
        """The blocks of the article (or of main, or of the page) that are neither dropped nor templates."""
        dropped, scopes = [], []
        for name, subtree, drop, _, around in self.elements:
            outer = scopes[around] if around >= 0 else frozenset()
            dropped.append((around >= 0 and dropped[around]) or drop or (subtree in templates and name not in ("html", "body")))
            scopes.append(outer | {name} if name in ("article", "main") and name not in outer else outer)
        left = [b for b in self.blocks if b[1] < 0 or not dropped[b[1]]]
        for scope in ("article", "main"):
            inside = [b for b in left if b[1] >= 0 and scope in scopes[b[1]]]
            if inside:
                left = inside
                break
        return "\n".join(text for text, _ in left)


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def extract_main_text(raw_sources: DataFrame, min_pages: int = 10, min_share: float = 0.1) -> DataFrame:
    """Main text of every page: ``id, source_url, text``, one row per row of ``id, source_url, raw_text``.

    ``raw_text`` is the whole HTML. An element subtree (names and text, no
    attributes) is a template of a host if it is on at least ``min_pages``
    pages with different main texts, and on ``min_share`` of the host's. Copies of one
    page count once, so that an article published many times is no template.
    The text is that of ``article``, else ``main``, else the page; markup-named
    menus, adverts, forms and comments go. White space within a block becomes one space; blocks are
    joined by a line break. A null or empty page, or one without text,
    gives an empty text; pages without a valid URL share one host; repeated
    rows give repeated rows; other columns are ignored.
    """
    pages = raw_sources.select("id", "source_url", "raw_text")
    pages = pages.withColumn("page", F.xxhash64("id", "source_url", "raw_text"))

    def hashed():
        def subtrees(page, url, source):
            parsed = Page(source)
            main = hashlib.blake2b(parsed.main_text().encode("utf-8", "replace"), digest_size=8).digest()
            return page, host(url), int.from_bytes(main, "little", signed=True), parsed.subtrees()
        return subtrees

    found = cut_lineage(map_rows(
        pages.select("page", "source_url", "raw_text"), hashed, "page long, host string, main long, subtrees array<long>"
    ))
    parts = found.select("page", "host", "main", F.explode("subtrees").alias("subtree"))
    spread = (
        parts.groupBy("host", "subtree", "main").agg(F.lit(1).alias("one"))
        .groupBy("host", "subtree").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    sizes = (
        found.groupBy("host", "main").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    )
    templates = (
        spread.join(sizes, "host").where(F.col("n") >= min_share * F.col("pages")).select("host", "subtree")
    )
    hits = parts.join(templates, ["host", "subtree"]).groupBy("page").agg(F.collect_set("subtree").alias("templates"))

    def cleaned():
        return lambda i, url, source, templates: (i, url, Page(source).main_text(frozenset(templates or ())))

    marked = pages.join(hits, "page", "left").select("id", "source_url", "raw_text", "templates")
    return map_rows(marked, cleaned, "id long, source_url string, text string")
