"""Main text of HTML pages by composite text density.

A forgiving parser builds the node tree (implied end tags, void and raw-text elements). Elements that are boilerplate by
their tag, role or class are cut first: a class or id counts if each of its words names boilerplate or a mere container of
it, and one does name boilerplate, so ``cookie-notice`` is cut and ``related-work`` is not; only blocks outside of code are
judged by it. A form that holds most of a page's text is a wrapper and stays. For every node left, the composite density
weighs its characters per tag by its share of link text; the node whose children have the largest sum of densities is the
core of the content. The least density on its path to the body is the threshold: on that path, neighbouring subtrees that
are as dense belong to the content as well, and so do plain blocks (paragraphs, headings, lists, tables) that are not
mostly links. Where the path leads through an article, the rest of the article is content too, and where it leads through
a main element, all in it that is not mostly links.

Defined results: null or empty html, or a page of boilerplate only, gives an empty text; html without tags is its own text;
repeated rows give repeated, equal rows; other columns are not read. Pages of any length are parsed in one pass of linear
cost without recursion. The work is per row, so a lost executor costs only its tasks.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import slices

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend".split())
#: An opening tag ends an open element of these names, looked for up to the given borders.
IMPLIED = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"), "option": ("option", "select")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}

CUT_TAGS = frozenset("head title script style noscript template nav footer aside button select textarea input iframe svg canvas object audio video dialog menu xmp noembed noframes".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
#: Words of classes and ids that name boilerplate, and words that say no more than that something is a part of a page.
CUT_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion sidebar
sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter
subscribe subscription signup comment comments disqus respond replies reply share sharing social related recommended recommendations widget widgets toolbar
pagination pager login signin skip copyright disclaimer""".split())
PLAIN_WORDS = frozenset("""a area articles banner bar block body bottom box btn button buttons col column container content count div element entry footer form
global google group head holder icon icons id image img inline inner item items label layout left link links list main media message module more outer panel
posts post primary read reader region right row secondary section site slot social stories story text thread title to top unit user users visitor web wrap wrapper""".split())
HEADERS = frozenset("header site-header page-header main-header global-header top-header".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
KEPT_TAGS = frozenset("html body article main h1 h2 h3 h4 h5 h6 pre".split())
#: An article by such a name is a reader's comment wherever it stands; any other that is not within one is kept.
COMMENT = re.compile("comment|repl(?:y|ies)", re.IGNORECASE)
#: Blocks that are content beside the core unless they are mostly links.
SIMPLE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure address details".split())


#: Two words written as one are told apart up to this many letters, more than any two of the words above have.
COMPOUND = 40


@lru_cache(1 << 14)
def cut_word(word: str) -> bool:
    """True for a word that names boilerplate, alone or written together with one that does or names a container."""
    if word in CUT_WORDS:
        return True
    halves = [(word[:k], word[k:]) for k in range(1, len(word))] if len(word) <= COMPOUND else []
    known = [(a, b) for a, b in halves if (a in CUT_WORDS or a in PLAIN_WORDS) and (b in CUT_WORDS or b in PLAIN_WORDS)]
    return any(w in CUT_WORDS and len(w) > 2 for pair in known for w in pair)


def names_boilerplate(token: str) -> bool:
    """True for a class or id all of whose words name boilerplate or a container, and one the former."""
    words = [w.lower() for w in WORDS.findall(token) if not w.isdigit()]
    return any(map(cut_word, words)) and all(w in PLAIN_WORDS or cut_word(w) for w in words)


class Tree:
    """Nodes in page order as parallel lists; ``pieces`` holds (node, text) in page order, text None for a boundary.

    ``stack`` has the open nodes and ``open`` the places in it of each name, so that no tag costs more than it closes.
    """

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.cut = ["#root"], [-1], [False]
        self.pieces: list[tuple[int, str | None]] = []
        self.stack, self.open, self.blocks = [0], {}, [0]
        quotes, at, end = True, 0, len(page)
        while at < end:
            mark = page.find("<", at)
            if mark < 0:
                break
            if mark > at:
                self._text(page[at:mark])
            at = mark
            follows = page[at + 1 : at + 2]
            if follows in "!?" and follows:
                at = self._declaration(page, at)
                continue
            closing = follows == "/"
            name = NAME.match(page, at + 1 + closing)
            if not name:
                self._text("<")
                at += 1
                continue
            # The end of the tag: the next > outside of quotes. Once a page turns out to end within quotes, none count.
            stop, k = -1, name.end()
            while quotes and stop < 0:
                m = STOP.search(page, k)
                if not m:
                    quotes = False
                elif m[0] == ">":
                    stop = m.start()
                else:
                    k = page.find(m[0], m.end()) + 1
                    quotes = k > 0
            if stop < 0:
                stop = page.find(">", name.end())
            if stop < 0:
                self._text(page[at:])
                at = end
                break
            tag, attrs, at = name[0].lower(), page[name.end() : stop], stop + 1
            if closing:
                self._close(tag)
                continue
            self._open(tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = close.start() if close else end
        if at < end:
            self._text(page[at:])
        self._judge_forms()

    def _text(self, text: str) -> None:
        self.pieces.append((self.stack[-1], entities.unescape(text)))

    def _declaration(self, page: str, at: int) -> int:
        """A comment, CDATA section, doctype or processing instruction; what does not end goes on to the page's end."""
        if page.startswith("<!--", at):
            m = COMMENT_END.search(page, at + 4)
            return m.end() if m else len(page)
        if page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at)
            self.pieces.append((self.stack[-1], page[at + 9 : stop if stop >= 0 else len(page)]))
            return stop + 3 if stop >= 0 else len(page)
        stop = page.find(">", at)
        return stop + 1 if stop >= 0 else len(page)

    def _last(self, names) -> int:
        """The place in the stack of the last open element of these names, 0 for none."""
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def _cut_stack(self, depth: int) -> None:
        for k in range(len(self.stack) - 1, depth - 1, -1):
            name = self.tag[self.stack.pop()]
            self.open[name].pop()
            if self.blocks[-1] == k:
                self.blocks.pop()

    def _open(self, name: str, attrs: str) -> None:
        if name in CLOSES_P:
            self._pop(("p",), ("button", "td", "th", "caption", "object", "article", "section", "div", "table"))
        if name in IMPLIED:
            self._pop(*IMPLIED[name])
        node, above = len(self.tag), self.stack[-1]
        self.tag.append(name)
        self.parent.append(above)
        self.cut.append(self.cut[above] or self._boilerplate(name, attrs))
        if name in BLOCK or name == "br":
            self.pieces.append((above, " " if name == "br" else None))
        if name not in VOID:
            self.open.setdefault(name, []).append(len(self.stack))
            if name in BLOCK:
                self.blocks.append(len(self.stack))
            self.stack.append(node)

    def _pop(self, names, borders) -> None:
        depth = self._last(names)
        if depth and depth > self._last(borders):
            self._cut_stack(depth)
            self.pieces.append((self.stack[-1], None))

    def _close(self, name: str) -> None:
        depth = self._last((name,))
        # An inline element does not end the block that it stands in.
        if depth and (name in BLOCK or depth > self.blocks[-1]):
            self._cut_stack(depth)
        if name in BLOCK:
            self.pieces.append((self.stack[-1], None))

    def _boilerplate(self, name: str, attrs: str) -> bool:
        if name in CUT_TAGS:
            return True
        article = self._last(("article", "main"))
        if name == "header" and not article and not self._last(("section",)):
            return True
        if not attrs.strip():
            return False
        for m in ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return name not in KEPT_TAGS
            if name == "article" and key in ("class", "id") and any(COMMENT.search(t) and names_boilerplate(t) for t in value.split()):
                return True
            if name == "form" or name in KEPT_TAGS and not (name == "article" and article):
                continue
            if key == "role" and value.lower() in CUT_ROLES:
                return True
            if key in ("class", "id") and (name in BLOCK or name == "ins") and not self._last(("pre", "code")):
                if any(names_boilerplate(t) or not article and t.lower() in HEADERS for t in value.split()):
                    return True
        return False

    def _judge_forms(self) -> None:
        """Cuts the forms but those that hold at least half of what is not cut."""
        if "form" not in self.tag:
            return
        chars = [0] * len(self.tag)
        for node, text in self.pieces:
            if text and not self.cut[node]:
                chars[node] += len(" ".join(text.split()))
        for node in range(len(self.tag) - 1, 0, -1):
            chars[self.parent[node]] += chars[node]
        for node in range(1, len(self.tag)):
            self.cut[node] = self.cut[node] or self.cut[self.parent[node]] or self.tag[node] == "form" and 2 * chars[node] < chars[0]


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Characters per tag, weighed by how little of them is link text; ``ratio`` is the body's share of link text."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + ratio * chars + math.e)
    value = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * math.log(max(value, 1.0)) / math.log(max(base, 1.0 + 1e-9))


def content_nodes(tree: Tree) -> list[int]:
    """The nodes whose subtrees are the content, in page order, none within another: the core, and what goes with it."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.pieces:
        if text and not tree.cut[node]:
            chars[node] += len(" ".join(text.split()))
    for node in range(n - 1, 0, -1):
        if not tree.cut[node]:
            above = tree.parent[node]
            if tree.tag[node] == "a":
                link_chars[node], link_tags[node] = chars[node], link_tags[node] + 1
            chars[above] += chars[node]
            tags[above] += tags[node] + 1
            link_chars[above] += link_chars[node]
            link_tags[above] += link_tags[node]
    if not chars[0]:
        return []
    body = next((k for k in range(n) if tree.tag[k] == "body"), 0)
    body = body if chars[body] == chars[0] else 0
    ratio = link_chars[body] / max(1, chars[body])
    density = [0.0 if tree.cut[k] else composite_density(chars[k], tags[k], link_chars[k], link_tags[k], ratio) for k in range(n)]
    sums = [0.0] * n
    for node in range(1, n):
        sums[tree.parent[node]] += density[node]
    best = max(range(n), key=lambda k: (sums[k], -k))
    if not sums[best]:
        return [body]
    path = [best]
    while path[-1] not in (body, 0):
        path.append(tree.parent[path[-1]])
    threshold = min(density[k] for k in path)
    article = next((k for k in reversed(path) if tree.tag[k] == "article"), None)
    if article is not None:
        return [article]
    children: dict[int, list[int]] = {}
    for node in range(1, n):
        if not tree.cut[node]:
            children.setdefault(tree.parent[node], []).append(node)
    main = max((i for i, k in enumerate(path) if tree.tag[k] == "main"), default=-1)
    out, chosen = [best], best
    for i, above in enumerate(path[1:], 1):
        for k in children.get(above, []):
            if k != chosen and 3 * link_chars[k] <= chars[k] and (i <= main or density[k] >= threshold or tree.tag[k] in SIMPLE) and chars[k]:
                out.append(k)
        chosen = above
    return sorted(out)


def extract(page: str | None) -> str:
    """The main text of a page: its blocks in page order, one to a line."""
    if not page:
        return ""
    tree = Tree(page)
    wanted = set(content_nodes(tree))
    keep = [False] * len(tree.tag)
    for node in range(len(tree.tag)):
        keep[node] = not tree.cut[node] and (node in wanted or node > 0 and keep[tree.parent[node]])
    blocks: list[str] = []
    current: list[str] = []
    for node, text in tree.pieces:
        if text is None:
            if current:
                blocks.append(" ".join("".join(current).split()))
                current = []
        elif keep[node]:
            current.append(text)
    blocks.append(" ".join("".join(current).split()))
    return "\n".join(b for b in blocks if b)


SCHEMA = "text string, n_chars long"


def extract_column(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Pages are handed on in slices, so that no column of one batch outgrows what Arrow can index.
            for start, stop in slices(batch.column(2).to_pylist(), 16_000_000):
                texts = [extract(x.as_py()) for x in batch.column(2).slice(start, stop - start)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias(key), F.col(url).cast("string").alias(url), F.col(page).cast("string").alias(page)).mapInArrow(run, f"`{key}` long, `{url}` string, {SCHEMA}")
