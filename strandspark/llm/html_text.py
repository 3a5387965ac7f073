"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with the path of block-level elements that
leads to it. Per path, text length and punctuation are averaged over its blocks;
both series are smoothed in page order and fused into one score with the path's
share of the page's text and the part of it that is not linked; the paths over a
threshold of the page's own spread are chosen: their blocks are the content nodes.

Headings, list items and short paragraphs seldom reach the threshold by
themselves, so the region of the content nodes is read as well: the articles (or
main elements) that hold most of them, else the smallest element around them all,
widened as long as that adds no linked text. Blocks of the region that lie beside the
content nodes' own parts only stay if they are running text or headings.

Names are a prior: class and id words of page furniture (reader comments too) multiply a
path's score by ``PRIOR``, and by nothing where some block outside is text, however
short the article and many the comments; so a text under such a name stays only where it
outweighs all else by far and nothing else reads like a text. A name counts only if all its words are about furniture or layout
(``social-share``, not ``social-policy``). Elements that mean furniture (menus,
footers, page headers, sidebars, dialogs) and hidden ones are not read, unless
a page holds nothing else; then only paths of whole sentences count.

Defined results: a null or empty html, or a page without main text, gives an empty
text; malformed markup is read as browsers do where that is simple (implied ends,
unclosed elements, a tag cut off by the end); very long and very deep pages are
read whole, in time linear in their length; repeated rows are extracted each; an
empty table gives an empty result; other columns are not looked at. One pass, no
shuffle; memory is bounded by one page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.texts import map_texts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|</?[a-zA-Z][^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
CLASS = re.compile(r"\bclass\s*=\s*(\"[^\"]*\S[^\"]*\"|'[^']*\S[^']*'|[^\s\"'>]+)", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture".split()
)
RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
#: Elements without text of their own, and elements that are page furniture.
SILENT = frozenset("button select template object applet svg canvas audio video head datalist map".split())
FURNITURE = frozenset("nav header footer aside menu dialog".split())
CONTAINERS = frozenset(("article", "main"))
#: Elements whose start closes an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Elements of running text; any other element is a wrapper around some.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address".split())
CELLS = frozenset(("td", "th"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Element: the open elements that its start ends, and the elements that shield them.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored promo promotion sidebar nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe "
    "subscription signup signin login register social share sharing related recommended recommendations comment comments commentlist disqus reply replies respond "
    "discussion reviews widget toolbar pagination pager copyright disclaimer skip".split()
)
#: Words that go with them without naming a subject.
PLAIN = frozenset(
    "area article articles bar blk block body bottom box btn button buttons card cards col column container content cta desktop fixed form global group holder icon icons id "
    "inner item items layer left line link links list main mobile module new outer page panel post posts primary reader readers region right row secondary section site slot "
    "small sticky text the thread title to top unit user users wrap wrapper zone view list section author count input field".split()
)
#: Words that make a name a statement about the layout (``with-sidebar``).
LAYOUT = frozenset("has have with no without hide show is".split())
PRIOR = 0.02
#: From this length on, with a sentence mark and few links, a block is text (of furniture alone: on a path's average).
SENTENCE = 80

#: What an element's start says about it: nothing; furniture by its name; the header of an
#: article, whose headings are its own; not to be read.
CLEAR, NAMED, TITLE, UNREAD = range(4)
#: Words that make a header the header of an article.
OWN_HEADER = frozenset("article content entry post story".split())


def furniture_name(value: str) -> bool:
    """Some class or id in ``value`` is about page furniture and nothing else."""
    for name in value.split():
        w = [x.lower() for x in WORDS.findall(name)]
        if not NOISE.isdisjoint(w) and LAYOUT.isdisjoint(w) and all(x in NOISE or x in PLAIN or len(x) == 1 for x in w):
            return True
    return False


def label_of(tag: str, attributes: str, inside: bool) -> int:
    """What an element's own start says; ``inside``: it is in an article or main element."""
    if tag in SILENT or tag in FURNITURE and not (inside and tag in ("header", "footer")):
        return UNREAD
    out = TITLE if tag == "header" else NAMED if tag in ("footer", "form") else CLEAR
    if not attributes:
        return out
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            if out == CLEAR and tag not in ("html", "body", "main") and furniture_name(value):
                w = {x.lower() for x in WORDS.findall(value)}
                out = TITLE if "header" in w and (inside or not w.isdisjoint(OWN_HEADER)) else NAMED
        elif name == "role" and value.lower() in ROLES:
            return NAMED if inside else UNREAD
        elif name == "hidden" and m[2] is None and not attributes[m.start() - 1 : m.start()].strip() or name == "aria-hidden" and value.lower() == "true":
            return UNREAD
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return UNREAD
    return out


@dataclass
class Page:
    """Elements (by order of their starts) and text blocks of a page."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    #: The last element inside each element, and its path.
    last: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    #: Elements of a furniture name around each element, itself included.
    named: list[int] = field(default_factory=list)
    #: The innermost element that its text is wrapped in, and the article or main element around it.
    wrapper: list[int] = field(default_factory=list)
    article: list[int] = field(default_factory=list)
    #: (element, text, linked characters)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def parse(page: str, unread: int = UNREAD) -> Page:
    """``unread`` = NAMED reads furniture elements too, as elements of such a name."""
    out = Page()
    paths: dict[tuple[int, str], int] = {}
    labels: list[int] = []  # of each element, from itself or what is around it
    stack: list[int] = []
    where: dict[str, list[int]] = defaultdict(list)  # tag: its places on the stack
    buffer: list[str] = []
    linked, link = 0, -1  # characters in links; height of the stack where the open link began

    def push(tag: str, kind: str, label: int) -> None:
        i, up = len(out.tag), stack[-1] if stack else -1
        over, named, outer = (labels[up], out.named[up], out.article[up]) if stack else (CLEAR, 0, -1)
        if over == TITLE and tag in HEADINGS and label == CLEAR:
            over, named = CLEAR, named - 1
        if tag in CONTAINERS and label == CLEAR and named <= len(where["form"]) and (where["form"] or where["header"]):
            over, named = CLEAR, 0  # only a form, or a header that never ends, is around it
        out.tag.append(tag)
        out.parent.append(up)
        out.last.append(i)
        out.path.append(paths.setdefault((out.path[up] if stack else -1, kind), len(paths)))
        out.named.append(named + (label in (NAMED, TITLE)))
        labels.append(max(label, over))
        starts = tag in CONTAINERS and not out.named[i] and (outer < 0 or tag == "article" and out.tag[outer] == "main")
        out.article.append(i if starts else outer)
        out.wrapper.append(i if up < 0 or tag not in FLOW or tag in CELLS else out.wrapper[up])
        where[tag].append(len(stack))
        stack.append(i)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                if not stack:
                    push("body", "body", CLEAR)
                out.blocks.append((stack[-1], text, linked))
            buffer.clear()
        linked = 0

    def close(height: int) -> None:
        nonlocal link
        flush()
        for i in stack[height:]:
            out.last[i] = len(out.tag) - 1
            where[out.tag[i]].pop()
        del stack[height:]
        if link > height:
            link = -1

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and (not stack or labels[stack[-1]] != UNREAD):
            text = page[at:end]
            if "&" in text:
                text = html.unescape(text)
            buffer.append(text)
            if link >= 0:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = (m[1] or m[4]) == "/"
        if tag in RAW:
            if not closing:
                at = x.end() if (x := RAW[tag].search(page, at)) else n
            continue
        attributes = "" if closing else m[3] or m[6] or ""
        if tag == "br":
            buffer.append(" ")
        if tag == "a":
            link = -1 if closing else len(stack)
        if tag in INLINE:
            if closing:
                if where[tag] and where[tag][-1] == len(stack) - 1:
                    close(len(stack) - 1)
            elif attributes and tag not in ("a", "img", "wbr") and (label := min(label_of(tag, attributes, False), unread)):
                flush()
                push(tag, tag, label)
            continue
        if closing:
            if where[tag]:
                close(where[tag][-1])
            else:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if tag in CLOSES_P and where["p"]:
            close(where["p"][-1])
        if tag in IMPLIED:
            ends, shields = IMPLIED[tag]
            k = max(where[t][-1] if where[t] else -1 for t in ends)
            if k > max(where[t][-1] if where[t] else -1 for t in shields):
                close(k)
        if attributes.rstrip().endswith("/") and tag in ("path", "use", "circle", "rect"):
            continue
        kind = f"{tag}.{x[1].strip(chr(34) + chr(39)).split()[0]}" if "class" in attributes and (x := CLASS.search(attributes)) else tag
        push(tag, kind, min(label_of(tag, attributes, bool(stack) and out.article[stack[-1]] >= 0), unread))
    flush()
    for i in stack:
        out.last[i] = len(out.tag) - 1
    return out


def smooth(x: np.ndarray, sigma: float = 0.5) -> np.ndarray:
    r = min(3, len(x) - 1)
    if r < 1:
        return x
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(x, r, mode="edge"), w / w.sum(), "valid")


def path_scores(p: Page) -> tuple[np.ndarray, np.ndarray, float]:
    """(path of each block, score of each path, threshold) of a page with blocks."""
    path = np.unique([p.path[i] for i, _, _ in p.blocks], return_inverse=True)[1]
    n = np.bincount(path)
    mean = lambda v: np.bincount(path, v) / n
    size = np.array([len(t) for _, t, _ in p.blocks], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t, _ in p.blocks], float)
    links = np.minimum(size, [x for _, _, x in p.blocks])
    named = np.array([p.named[i] for i, _, _ in p.blocks])
    clear = named == named.min()
    text = clear & (size >= SENTENCE) & (marks > 0) & (2 * links < size)
    prior = np.where(clear, 1.0, 0.0 if text.any() else PRIOR)
    length, punctuation = smooth(mean(size)[path]), smooth(mean(marks)[path])
    share = np.bincount(path, size) / size.sum()
    fused = length * (1 + punctuation) * ((1 - mean(links) / mean(size)) * share)[path] * prior
    score = mean(fused)
    return path, score, min(float(np.std(fused)), float(score.max()))


def _region(p: Page, chosen: list[int], clear: int) -> int:
    """The smallest element around the content nodes, or one around it that adds no links."""
    around = [out if p.tag[i] not in CELLS or p.parent[i] < 0 else p.wrapper[p.parent[i]] for i in (p.blocks[k][0] for k in chosen) for out in (p.wrapper[i],)]
    top, first, last = around[0], min(around), max(around)
    while p.parent[top] >= 0 and not (top <= first and last <= p.last[top]):
        top = p.parent[top]
    blocks = sorted((i, len(text), links) for i, text, links in p.blocks)
    starts = [i for i, _, _ in blocks]
    at = lambda i: bisect_right(starts, i)
    while (up := p.parent[top]) >= 0 and p.tag[up] not in ("body", "html"):
        beside = [x for x in (*blocks[at(up - 1) : at(top - 1)], *blocks[at(p.last[top]) : at(p.last[up])]) if p.named[x[0]] <= clear]
        if beside and 10 * sum(x[2] for x in beside) >= 3 * sum(x[1] for x in beside):
            break
        top = up
    return top


def kept_blocks(p: Page, is_content: np.ndarray) -> np.ndarray:
    """The content nodes and what belongs to them (see the module)."""
    chosen = np.flatnonzero(is_content).tolist()
    clear = min(p.named[p.blocks[k][0]] for k in chosen)
    size = lambda some: sum(len(p.blocks[k][1]) for k in some)
    held = [k for k in chosen if p.article[p.blocks[k][0]] >= 0]
    if held and 2 * size(held) >= size(chosen):
        articles = {p.article[p.blocks[k][0]] for k in held}
        keep = np.array([p.article[i] in articles and (is_content[k] or p.named[i] <= clear) for k, (i, _, _) in enumerate(p.blocks)])
    else:
        top = _region(p, chosen, clear)
        children = [i for i in range(top + 1, p.last[top] + 1) if p.parent[i] == top]
        part = lambda i: children[c - 1] if (c := bisect_right(children, i)) and i <= p.last[children[c - 1]] else top
        parts = {x for k in chosen if (x := part(p.blocks[k][0])) != top}

        def stays(k: int, i: int, text: str, links: int) -> bool:
            if is_content[k] or not top <= i <= p.last[top] or p.named[i] > clear:
                return bool(is_content[k])
            return (x := part(i)) in parts or 2 * links < len(text) and (x == top or p.tag[x] in FLOW)

        keep = np.array([stays(k, *b) for k, b in enumerate(p.blocks)])
    # a title right before the text, if the text has none itself
    k = int(keep.argmax())
    if p.tag[p.blocks[k][0]] not in HEADINGS:
        while (k := k - 1) >= 0 and p.named[i := p.blocks[k][0]] <= clear and p.tag[i] in HEADINGS and p.blocks[k][2] < len(p.blocks[k][1]):
            keep[k] = True
    return keep


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by two line feeds."""
    if not page:
        return ""
    p = parse(page)
    alone = not p.blocks
    if alone:
        p = parse(page, NAMED)
    if not p.blocks:
        return ""
    path, score, least = path_scores(p)
    good = score >= least
    if alone:  # only furniture: sentences, or nothing
        n = np.bincount(path)
        good &= (np.bincount(path, [len(t) for _, t, _ in p.blocks]) >= SENTENCE * n) & (np.bincount(path, [len(PUNCTUATION.findall(t)) for _, t, _ in p.blocks]) >= n)
    if not good.any():
        return ""
    return "\n\n".join(text for (_, text, _), k in zip(p.blocks, kept_blocks(p, good[path])) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def run(c: dict[str, list]) -> pa.RecordBatch:
        texts = [main_text(h) for h in c["html"]]
        return pa.RecordBatch.from_arrays([pa.array(c["page_id"], pa.int64()), pa.array(c["url"], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_texts(own, run, "page_id long, url string, text string, n_chars long", 64)
