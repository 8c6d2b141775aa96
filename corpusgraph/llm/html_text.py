"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks; each belongs to the path of tags from the root to it. Per path: characters of text and
marks of punctuation, each per block, are fused into one score. A path's score is averaged with the scores of the paths beside
it and beside its ancestors below the body, so that headings and short paragraphs of a text stay. A factor from 0.5 to 1.5 is
the share of the page's text that lies in the same ``article`` or ``main``, elsewhere the mean share of the parts around it
(text straight below the body is a part of its own); link text lowers a block's score by up to half. The scores are smoothed
over the page in block order, and on every page the paths whose blocks under one element reach the threshold in the mean (the
standard deviation, held between half the mean and the mean) are content, together with the lists, tables, captions and short lines
of the parts that hold such text. Parts that are never article text by their tag, role or a whole word of their class or
id (menus, forms, adverts, comments ...) are left out before; parts whose names only contain such a word keep a tenth of
their score, and names of paragraphs, headings and the like don't count so.

Edge cases: null and empty pages, and pages without text, give an empty text; unclosed and stray tags are tolerated; a raw
element (svg, iframe ...) that is closed at once or never holds nothing, but an unclosed script or style runs to the end;
repeated rows are each extracted; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import flat

#: A tag; every place can be taken in one way only, and a ``<`` outside quotes ends the attempt, so a failed one isn't repeated.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
RAW = frozenset("script style title textarea noscript iframe template noembed noframes xmp svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUT_TAGS = frozenset("head nav footer aside form button select menu dialog input label fieldset legend option datalist object".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|sidebar\w*|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|cookies?\w*|consent|gdpr|notices?|notification|newsletter|"
    r"subscri\w*|signup|popup|modal|overlay|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|disqus\w*|repl(?:y|ies)|widgets?|toolbar|pagination|pager|copyright|legal|login|"
    r"search\w*|skip|hidden|noprint)(?:$|[\s_-])",
    re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOLDERS = frozenset(("html", "body", "article", "main"))
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body table ul ol dl article section div main td th".split())
#: Elements that hold text rather than parts of a page: their names say little.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote span em strong b i u a code cite q small caption figcaption summary".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold parts: text straight in one is a part of its own. Of those in _WHOLE, what they hold is one whole.
_HOLDING = frozenset("html body article main section div".split())
_WHOLE = frozenset("article main section blockquote figure details ul ol dl table thead tbody tfoot tr pre li dd td th".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。、！？]")
#: What a block's score is multiplied by where the name of a part around it only contains such a word (as in ``menu-review``).
NAMED = 0.1


def _judge(tag: str, attributes: str) -> tuple[bool, bool]:
    """(never article text, named like a part that isn't)."""
    if tag in OUT_TAGS:
        return True, False
    if not attributes or tag in HOLDERS:
        return False, False
    like = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.strip().lower() in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True, False
        if name in ("class", "id") and OUT_NAMES.search(value):
            if any(OUT_NAMES.fullmatch(x) for x in value.split()):
                return True, False
            like = like or tag not in _LEAF
    return False, like


class Page:
    """A page's blocks and the tree of paths that they lie on.

    ``parent`` and ``tag`` describe the nodes of the tree, the root first and every node after its parent; ``around`` and ``path``
    give the elements of the page in the same way: the element around each, and the node of its path. A block is (node, text,
    share of link text, whether a part around it is named like one that isn't article text, element). The open elements are a stack; what
    is asked of it is kept as counts and as places by tag, so that a page takes time and memory in proportion to its length,
    however deep it nests.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.blocks = [-1], [""], []
        self.around, self.path = [-1], [0]
        self._child: dict[tuple[int, str], int] = {}
        self._stack: list[list] = []  # tag, node, never article text, named like such, a link, still open, element
        self._places: dict[str, list[int]] = {}
        self._count = [0, 0, 0]  # open elements that are never article text, are named like such, are links
        self._text: list[str] = []
        self._linked = 0
        self._read(page)

    def _open(self, tag: str, attributes: str) -> None:
        node, element = (self._stack[-1][1], self._stack[-1][6]) if self._stack else (0, 0)
        if tag in BLOCK:
            key = (node, tag)
            node = self._child.get(key, 0)
            if not node:
                node = self._child[key] = len(self.parent)
                self.parent.append(key[0])
                self.tag.append(tag)
            self.around.append(element)
            self.path.append(node)
            element = len(self.path) - 1
        entry = [tag, node, *_judge(tag, attributes), tag == "a" and "href" in attributes.lower(), True, element]
        self._places.setdefault(tag, []).append(len(self._stack))
        self._stack.append(entry)
        for k in range(3):
            self._count[k] += entry[2 + k]

    def _shut(self, entry: list) -> None:
        entry[5] = False
        self._places[entry[0]].pop()
        for k in range(3):
            self._count[k] -= entry[2 + k]

    def _cut(self, depth: int) -> None:
        """Closes all elements from a depth on."""
        while len(self._stack) > depth:
            entry = self._stack.pop()
            if entry[5]:
                self._shut(entry)

    def _last(self, tag: str) -> int:
        places = self._places.get(tag)
        return places[-1] if places else -1

    def _flush(self) -> None:
        if self._text:
            s = " ".join(html.unescape("".join(self._text)).split())
            if s and not self._count[0]:
                node, element = (self._stack[-1][1], self._stack[-1][6]) if self._stack else (0, 0)
                inside = self._last("article") >= 0 or self._last("main") >= 0
                if not self._places.get("header") or inside and self.tag[node] in _HEADINGS:
                    self.blocks.append((node, s, self._linked / len(s), self._count[1] > 0, element))
            self._text.clear()
        self._linked = 0

    def _add(self, raw: str) -> None:
        if raw:
            self._text.append(raw)
            if self._count[2]:
                self._linked += len(raw.strip())

    def _read(self, page: str) -> None:
        at, n, unclosed, last = 0, len(page), set(), page.rfind(">")
        look = 0
        while at < n:
            lt = page.find("<", max(at, look))
            if lt < 0:
                self._add(page[at:])
                break
            if page.startswith("<!--", lt):
                self._add(page[at:lt])
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if lt < last and page[lt + 1] in "!?":
                self._add(page[at:lt])
                at = page.find(">", lt) + 1
                continue
            m = TAG.match(page, lt) if lt < last else None
            if m is None:
                look = lt + 1  # text
                continue
            self._add(page[at:lt])
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK:
                    if self._last(tag) >= 0:
                        self._flush()
                        self._cut(self._last(tag))
                elif self._last(tag) > max((self._last(t) for t in self._places if t in BLOCK), default=-1):
                    self._shut(self._stack[self._last(tag)])
                    while self._stack and not self._stack[-1][5]:
                        self._stack.pop()
                continue
            if tag in RAW:
                if tag in BLOCK:
                    self._flush()
                else:
                    self._text.append(" ")
                if not m[3].endswith("/") and tag not in unclosed:
                    end = _END[tag].search(page, at)
                    if end:
                        at = end.end()
                    elif tag in ("script", "style"):
                        at = n
                    else:  # without an end it holds nothing
                        unclosed.add(tag)
                continue
            if tag in BLOCK:
                self._flush()
                closing = {"p"} | CLOSED_BY.get(tag, set())
                scope = max((self._last(t) for t in _SCOPE - closing), default=-1)
                within = [places[k] for t in closing if (places := self._places.get(t)) and (k := bisect_right(places, scope)) < len(places)]
                if within:
                    self._cut(min(within))
            elif tag == "br":
                self._text.append("\n")
            if tag not in VOID and not m[3].endswith("/"):
                self._open(tag, m[3])
        self._flush()


_END = {tag: re.compile(rf"</{tag}\b[^<>]*+>", re.IGNORECASE) for tag in RAW}


def fused(page: Page) -> dict[int, float]:
    """The score of each node that blocks lie on: ratios of its path, averaged along the paths, times the share of its part."""
    n = len(page.parent)
    chars, marks, count = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, s, *_ in page.blocks:
        chars[node] += len(s)
        marks[node] += len(_PUNCTUATION.findall(s))
        count[node] += 1
    some = np.maximum(count, 1)
    ratio = np.log1p(chars / some) * np.log1p(1 + marks / some)
    parent, total = page.parent, chars.sum()
    # per node: characters of the paths right below it and these times their ratio; characters of all paths below it
    beside, beside_ratio, under = np.zeros(n), np.zeros(n), chars.copy()
    for x in range(n - 1, 0, -1):
        if count[x]:
            beside[parent[x]] += chars[x]
            beside_ratio[parent[x]] += chars[x] * ratio[x]
        under[parent[x]] += under[x]
    under -= chars  # a path isn't a part of itself
    # per node, over the parts from the outermost to the node: mean of what is beside, shares and number of parts, first holder
    up: list[float | None] = [None] * n
    shares, parts, holder, top = [0.0] * n, [0] * n, [-1] * n, [True] * n
    for x in range(n):
        if x:
            y, t = parent[x], page.tag[x]
            up[x], shares[x], parts[x], holder[x] = up[y], shares[y], parts[y], holder[y]
            top[x] = top[y] and t in ("html", "body")
            if t not in ("html", "body"):
                shares[x] += under[x] / total
                parts[x] += 1
                if holder[x] < 0 and t in ("article", "main"):
                    holder[x] = x
        if beside[x] and not top[x]:
            here = beside_ratio[x] / beside[x]
            up[x] = here if up[x] is None else (up[x] + here) / 2
    out = {}
    for x in np.flatnonzero(count).tolist():
        y = max(parent[x], 0)
        near = ratio[x] if up[y] is None else (ratio[x] + up[y]) / 2
        share = under[holder[y]] / total if holder[y] >= 0 else shares[y] / parts[y] if parts[y] else beside[y] / total
        out[x] = near * (0.5 + share)
    return out


def _gathered(found: Page, groups: dict[tuple, list[int]], kept: set[tuple]) -> set[tuple]:
    """The groups that go with kept ones: lists, tables, captions and short lines of a part whose text is content.

    From the group outwards, the first part decides that has kept text: straight in it, or, where it is an article, a list, a table or
    the like, in most of what it holds. Past such a part, and past a ``div`` into the body, nothing is taken along.
    """
    n = len(found.path)
    direct, held, under = [0] * n, [0] * n, [0] * n
    for key, members in groups.items():
        size = sum(len(found.blocks[k][1]) for k in members)
        under[key[0]] += size
        if key in kept:
            direct[key[0]] += size
            held[key[0]] += size
    for x in range(n - 1, 0, -1):
        under[found.around[x]] += under[x]
        held[found.around[x]] += held[x]
    more = set()
    for key, members in groups.items():
        links = sum(found.blocks[k][2] * len(found.blocks[k][1]) for k in members) / sum(len(found.blocks[k][1]) for k in members)
        if key in kept or key[2] or links >= 0.8:
            continue
        x, plain = key[0], True
        while x > 0:
            tag = found.tag[found.path[x]]
            if tag in ("html", "body"):
                if plain and direct[x] and links < 0.5 and tag == "body" and (key[0] != x or found.tag[key[1]] in _LEAF):
                    more.add(key)
                break
            if direct[x] or held[x] and tag in _WHOLE and 2 * held[x] >= under[x]:
                more.add(key)
                break
            if held[x] and tag not in _WHOLE:
                break
            plain = plain and tag in _WHOLE
            x = found.around[x]
    return more


def content(page: str | None, width: float = 1.0) -> str:
    """The main text: the blocks of selected paths, one line each.

    The paths below one element stay or go together: what decides is the mean of their smoothed scores, weighted by text.
    """
    found = Page(page or "")
    if not found.blocks:
        return ""
    score = fused(found)
    raw = np.array([score[node] * (1 - min(links, 1) / 2) * (NAMED if named else 1) for node, _, links, named, _ in found.blocks])
    reach = np.arange(-2, 3)
    kernel = np.exp(-(reach**2) / (2 * width**2))
    weight = np.convolve(np.ones(len(raw)), kernel, "full")[2:-2]
    smooth = (np.convolve(raw, kernel, "full")[2:-2] / weight + raw) / 2
    threshold = min(raw.mean(), max(raw.std(), 0.5 * raw.mean())) - 1e-9
    groups: dict[tuple, list[int]] = {}
    for k, (node, _, _, named, element) in enumerate(found.blocks):
        own = found.path[element] == node and found.tag[node] not in _HOLDING
        groups.setdefault((found.around[element] if own and element else element, node, named), []).append(k)
    sizes = np.array([len(b[1]) for b in found.blocks])
    kept = {key for key, m in groups.items() if (smooth[m] * sizes[m]).sum() >= threshold * sizes[m].sum()}
    kept |= _gathered(found, groups, kept)
    chosen = sorted(k for key in kept for k in groups[key])
    return "\n".join(found.blocks[k][1] for k in chosen)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: (id, the columns in ``keep``, text). No shuffle."""
    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"), F.struct(*[F.col(c) for c in keep]).alias("rest") if keep else F.lit(True).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.tidy(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([content(x.as_py()) for x in batch.column(1)], pa.string())], names=["id", "rest", "text"])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, rest {source.schema['rest'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_col), *(["rest.*"] if keep else []), "text")
