"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text, each under its root-to-leaf path of block
tags and classes (inline tags leave no trace in a path). For every path the unlinked text
per node and the punctuation per node are gathered. Both ratios are smoothed over the nodes in page
order, so that a short block between long ones rises and a lone one falls, and multiplied (fused).
Paths of at least THRESHOLD of the best score are content, and their nodes are the content nodes.

The article is found from the content nodes: they vote, by their text, for the smallest
element that holds most of it. If that lies in an article or main element, the outermost of these is
the article. Otherwise it is the outermost element around the vote without boilerplate in it
or, if further out, the one that holds all content nodes. In the article or main element, and in the voted
element, all blocks are kept but for boilerplate: no heading, list or linked paragraph is lost for its length or its
links. Elsewhere only content nodes, headings and paragraphs are, and of linked blocks those that stand alone.

Boilerplate has no score. It is told by tags (menus, forms and the like) and by the first or last word of a class, id or
role, but never against the text: an element that holds the article (an article, main or h1 element, for the weaker words also most
of the page's unlinked text) is no boilerplate, whatever its tag or class says, and "no-", "has-"
and "with-" take the meaning from the word after them. Headers inside an article or main element are its own.

Nulls and odd input: a null or empty page gives the empty string, and so does
a page without content paths. Unclosed tags, comments and scripts end with the page.
Whole pages are processed, each by itself, in time that follows their length at any depth of tags; repeated
rows give equal results, extra columns are not looked at, and an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.session import bounded_batches

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|xmp|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that never hold an article, tags that may, and those that hold one only by its elements.
NEVER = frozenset("head button select option template".split())
SECTIONS = frozenset("nav footer aside menu dialog noscript iframe object canvas".split())
WEAK_SECTIONS = frozenset("header form fieldset".split())
#: Words of classes, ids and roles, and weaker ones.
WORDS = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies complementary disqus footer menu nav navbar navigation "
    "newsletter pagination related replies reply respond sidebar sponsor sponsored subscribe".split()
)
WEAK_WORDS = frozenset("banner header login masthead modal notice notices notification popup promo promoted search share sharing signup social toolbar widget widgets".split())
#: Words that take the meaning from the word after them, and from the word before them.
TURNING = frozenset("after before has have hide is no non not show with without".split())
TURNED = frozenset("closed disabled hidden none off".split())
#: Elements that an opening tag of the key closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")
SPACES = re.compile(r"\s+")
THRESHOLD = 0.1
#: Share of the content nodes' text that the article's element holds at least, and of a page's text that a holder does.
MAJORITY, MOST = 0.8, 0.5
#: Weights of a node and its neighbours in page order.
SMOOTH = (0.1, 0.8, 0.1)
LINKS = 0.5
#: Elements whose own text is that of an article even where its path's score is low.
PROSE = frozenset("p blockquote pre figcaption h1 h2 h3 h4 h5 h6".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr pre blockquote".split())


def _suspicion(names: list[str]) -> int:
    """2 if a name begins or ends with one of WORDS, 1 for WEAK_WORDS, else 0."""
    found = 0
    for name in names:
        said = [x.lower() for x in WORD.findall(name)]
        left = [x for k, x in enumerate(said) if not (k and said[k - 1] in TURNING)]
        if left and left[-1] not in TURNED:
            for x in (left[0], left[-1]):
                found = max(found, 2 * (x in WORDS) or x in WEAK_WORDS)
    return found


class Page:
    """Elements in page order with their parents, and blocks of text; element 0 is the page itself."""

    def __init__(self, page: str):
        self.parent, self.tag, self.suspicion, self.path, self.upto = [-1], [""], [0], [0], [0]
        self.texts: list[str] = []
        self.node: list[int] = []
        self.linked: list[float] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _read(self, page: str) -> None:
        stack, places = [0], {}  # open elements, and for each tag its places in the stack
        parts: list[str] = []
        block, in_link, link_depth = [0.0], False, 0

        def end() -> None:
            text = SPACES.sub(" ", "".join(parts)).strip()
            if text:
                self.texts.append(text)
                self.node.append(stack[-1])
                self.linked.append(min(1.0, block[0] / len(text)))
            parts.clear()
            block[0] = 0.0

        def say(raw: str) -> None:
            if raw:
                text = html.unescape(raw)
                parts.append(text)
                if in_link:
                    block[0] += len(text.strip())

        def cut(depth: int) -> None:
            """Closes the elements from this place in the stack on."""
            while len(stack) > depth:
                n = stack.pop()
                self.upto[n] = len(self.tag)
                places[self.tag[n]].pop()

        def close(tags: frozenset | set, stop: frozenset | set) -> None:
            at = max((places[t][-1] for t in tags if places.get(t)), default=-1)
            if at > max((places[t][-1] for t in stop if t not in tags and places.get(t)), default=-1):
                cut(at)

        at = 0
        for m in TOKEN.finditer(page):
            say(page[at : m.start()])
            at = m.end()
            tag = (m[3] or m[6] or "").lower()
            if not tag:
                continue
            closing, attributes = (m[2] or m[5]) == "/", m[4] or m[7] or ""
            if tag == "a":
                in_link, link_depth = not closing, len(stack)
            if tag == "br":
                say(" ")
            if tag in INLINE or tag == "br":
                continue
            end()
            if closing:
                if places.get(tag):
                    cut(places[tag][-1])
                in_link = in_link and len(stack) >= link_depth
                continue
            if tag in CLOSE_P:
                close({"p"}, frozenset(("table", "td", "th", "button")))
            if tag in CLOSES:
                close(CLOSES[tag], frozenset(("table", "ul", "ol", "dl")))
            if tag in VOID or attributes.rstrip().endswith("/") and tag not in CLOSE_P:
                continue
            values = [(x[1].lower(), x[2] or x[3] or x[4] or "") for x in ATTRIBUTE.finditer(attributes)]
            if ("role", "main") in values:
                tag = "main"
            names = [y for _, v in values for y in v.split()]
            label = tag + "".join(sorted("." + y for k, v in values if k == "class" for y in v.split()))
            n, up = len(self.tag), stack[-1]
            self.parent.append(up)
            self.tag.append(tag)
            self.suspicion.append(0 if tag in ("html", "body", "main") else _suspicion(names))
            self.path.append(self._paths.setdefault((self.path[up], label), len(self._paths) + 1))
            self.upto.append(0)
            places.setdefault(tag, []).append(len(stack))
            stack.append(n)
        say(page[at:])
        end()
        cut(1)
        self.upto[0] = len(self.tag)

    def within(self, block: int, node: int) -> bool:
        return node <= self.node[block] < self.upto[node]

    def sums(self, weight: list[float]) -> list[float]:
        """Of a weight of each block, the sum under each element."""
        out = [0.0] * len(self.tag)
        for n, w in zip(self.node, weight, strict=True):
            out[n] += w
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out

    def boilerplate(self) -> list[bool]:
        """For each element, whether it is boilerplate or inside such."""
        size = len(self.tag)
        text = self.sums([len(t) * (1 - k) for t, k in zip(self.texts, self.linked, strict=True)])
        articles, heads = [False] * size, [False] * size  # what an element holds below it
        for n in range(size - 1, 0, -1):
            up = self.parent[n]
            articles[up] |= articles[n] or self.tag[n] == "main" or self.tag[n] == "article" and not self.suspicion[n]
            heads[up] |= heads[n] or self.tag[n] == "h1"
        bad, inside = [False] * size, [False] * size
        for n in range(1, size):
            up, tag = self.parent[n], self.tag[n]
            inside[n] = inside[up] or tag in ("article", "main") and self.suspicion[n] < 2
            weak = tag in WEAK_SECTIONS or self.suspicion[n] == 1
            strong = tag in SECTIONS or self.suspicion[n] == 2
            if tag == "header" and inside[up]:
                weak = self.suspicion[n] == 1
            most = text[n] >= MOST * text[0] > 0
            # a page's header may hold its name as h1, so that an h1 alone makes no article of it
            holds = articles[n] or (heads[n] if strong else most) or weak and not strong and tag != "header" and heads[n]
            bad[n] = bad[up] or tag in NEVER or (weak or strong) and not holds
        return bad


def path_scores(page: Page, bad: list[bool]) -> dict[int, float]:
    """Smoothed and fused ratios of each path."""
    paths: dict[int, list[float]] = {}
    keys = [page.path[n] for n in page.node]
    for key, n, text, linked in zip(keys, page.node, page.texts, page.linked, strict=True):
        x = paths.setdefault(key, [0, 0, 0])
        x[2] += 1
        if not bad[n]:
            x[0] += len(text) * (1 - linked)
            x[1] += len(PUNCTUATION.findall(text)) * (1 - linked)

    def smooth(v: list[float]) -> list[float]:
        w = [v[:1] + v[:-1], v, v[1:] + v[-1:]]
        return [sum(c * x[i] for c, x in zip(SMOOTH, w, strict=True)) for i in range(len(v))]

    text, marks = (smooth([paths[k][i] / paths[k][2] for k in keys]) for i in (0, 1))
    out = dict.fromkeys(paths, 0.0)
    for k, t, m in zip(keys, text, marks, strict=True):
        if paths[k][0]:
            out[k] += t * (1 + m) / paths[k][2]
    return out


def main_text(page: str | None) -> str:
    p = Page(page or "")
    if not p.texts:
        return ""
    bad = p.boilerplate()
    scores = path_scores(p, bad)
    best = max(scores.values())
    if best <= 0:
        return ""
    good = [not bad[n] for n in p.node]
    content = [g and scores[p.path[n]] >= THRESHOLD * best for g, n in zip(good, p.node, strict=True)]
    votes = p.sums([len(t) * c for t, c in zip(p.texts, content, strict=True)])
    chain = [0]
    for n in range(1, len(p.tag)):  # page order: each element's parent comes before it
        if p.parent[n] == chain[-1] and votes[n] >= MAJORITY * votes[0] and p.tag[n] not in LEAVES:
            chain.append(n)
    voted, top = chain[-1], _article(p, chain, bad, votes)
    whole = top if p.tag[top] in ("article", "main") else voted if p.tag[voted] not in ("", "html", "body") else -1
    own = [k for k, g in enumerate(good) if g and p.within(k, top)]
    kept = []
    for i, k in enumerate(own):
        tag = p.tag[p.node[k]]
        if whole >= 0 and p.within(k, whole):
            kept.append(p.texts[k])
        elif p.linked[k] <= LINKS:
            if content[k] or tag in PROSE or whole < 0:
                kept.append(p.texts[k])
        else:
            beside = own[max(i - 1, 0) : i] + own[i + 1 : i + 2]
            alone = not any(p.path[p.node[x]] == p.path[p.node[k]] and p.linked[x] > LINKS for x in beside)
            if alone and tag in PROSE:
                kept.append(p.texts[k])
    return "\n".join(kept)


def _article(p: Page, chain: list[int], bad: list[bool], votes: list[float]) -> int:
    """The element that is the article, of those that hold the voted one."""
    named = [n for n in chain if p.tag[n] in ("article", "main")]
    if named:
        return named[0]
    unclean = p.sums([float(bad[n]) for n in p.node])
    clean = next((n for n in chain if not unclean[n]), chain[-1])
    common = max(n for n in chain if votes[n] == votes[0])
    return min(clean, common)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points, of every page; nothing is shuffled."""
    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
