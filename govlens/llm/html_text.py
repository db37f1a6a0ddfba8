"""Main text of web pages by tag-path ratios.

Text is gathered in blocks, each under its root-to-leaf tag path. Per path and page: characters and punctuation marks per
block, not counting text in links. Both ratios are smoothed over neighbouring paths in page order, fused by multiplication,
and held against a threshold drawn from their spread. The element shared by all paths above it is the container, or the
article element around it where one is marked; its blocks are the content, but for paths that are mostly links (where no
article is marked) and for what is set apart.

Set apart are elements whose tag, role or name says navigation, advert, form, notice and the like, that are hidden, or that hold
reader comments. A name is a whole class or id; one that denies or mentions (no-comments, with-sidebar) or that names a part
of the article (post-header) says nothing. Inside an article every word of a name must speak of something apart (related-posts,
not related-work), and headings and code are never set apart by name. Names never outweigh an article, main or body tag, and
an element that holds most of the page's running text is never set apart (where articles are marked, most of theirs), unless
it holds navigation or comments. Comments are told by their name, or by structure: a name that may be one (discussion, thread)
with an author or a time inside, or three and more children alike that each have one, behind the page's heading or article.

A page costs time in proportion to its length: tag paths are nodes of a tree, marks another, and open elements are counted.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import arrow_bounds, by_bytes

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
#: A tag whose quotes mean nothing; for pages on which this many tags have a quote that never ends.
_PLAIN_TAG, BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"), 50
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no markup of the page: the parser skips to their end, whatever stands before the >.
_RAW = {"script", "style", "noscript", "textarea", "iframe", "noframes", "title", "xmp"}
#: Embedded languages, where a slash before the > does close the element.
_FOREIGN = {"svg", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Elements that are never part of the main text.
_APART = {"nav", "footer", "menu", "head", "template", "object", "canvas", "select", "button"}
#: Elements that aren't, unless they hold most of the page's text.
_ASIDE = {"aside", "form", "dialog", "fieldset"}
_APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: Elements that no name sets apart.
_BODY = {"html", "body", "main", "article"}
#: Words of class and id names that mark what is not the article.
_APART_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs cookie cookies consent copyright footer "
    "alert alerts gdpr header login masthead modal newsletter notice notices notification pager pagination popup promo promoted promotion related "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
_HARD_NAMES = set("comment comments commentlist disqus replies reply respond menu menus nav navbar navigation".split())
#: Words beside them that turn them into a mention, and the parts of a page whose headers are its own.
_MENTIONS = set("no not non without with has have hide enable enabled disable disabled".split())
_OWN, _HEADERS = set("article body content entry main post story".split()), {"header", "banner", "masthead", "notice"}
#: Words that say nothing beside the words above.
_FILLERS = set("area articles bar block box btn button buttons center col column container content ctn icon icons inner item items left link links list module outer panel posts right row section site slot stories text top bottom unit wrap wrapper zone".split())
#: Elements that no name sets apart.
_UNNAMED = {"h1", "h2", "h3", "h4", "h5", "h6", "code", "pre", "kbd", "samp", "var", "em", "strong", "blockquote", "dfn"}
#: Words for a place that may hold reader comments, and those for their authors and times.
_THREADS = set("discussion discussions feedback thread threads responses response reactions reviews".split())
_BYLINES = set("author authors byline commenter date datetime posted poster published timestamp user username when".split())
_HIDDEN = re.compile(r"(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements that end an open paragraph's reach, that a following one of their kind closes, and that hold those.
_BARRIERS = {"td", "th", "button", "article", "section"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = set(_SAME) | {"ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "select"}
#: An element with this part of the page's running text is not set apart.
MOST = 0.7
NONE, SOFT, HARD = 0, 1, 2


def _words(name: str) -> set[str]:
    return {w for w in re.split("[^a-z0-9]+", _CAMEL.sub(" ", name).lower()) if w}


def _name_says(name: str, in_article: bool = False) -> int:
    """What one class or id says of its element."""
    words = _words(name)
    if not words.isdisjoint(_MENTIONS):
        return NONE
    known = _APART_NAMES | _HARD_NAMES
    if in_article and not all(w in known or w in _FILLERS or w in _OWN or w.isdigit() for w in words):
        return NONE
    if not words.isdisjoint(_HARD_NAMES):
        return HARD
    found = words & _APART_NAMES
    return SOFT if found and not (found <= _HEADERS and words & _OWN) else NONE


def attributes_of(text: str) -> dict[str, str]:
    """The attributes of a tag, names in lower case; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        value = a or b or c
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def _marked(tag: str, text: str, in_article: bool) -> tuple[str, int, bool, bool]:
    """The element's name in a path, whether it is set apart, may hold comments, and is an author or time."""
    name, apart = tag, HARD if tag in _APART else SOFT if tag in _ASIDE else NONE
    thread, byline = False, tag == "time"
    if text:
        attributes = attributes_of(text)
        own = attributes.get("class", "")
        if own:
            name += "." + ".".join(own.lower().split())
        if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
            apart = HARD
        if attributes.get("role", "").strip().lower() in _APART_ROLES:
            apart = max(apart, SOFT)
        names = [*own.split(), *attributes.get("id", "").split()]
        if tag not in _BODY and tag not in _UNNAMED:
            apart = max([apart, *(_name_says(n, in_article) for n in names)])
        if names:
            words = set().union(*map(_words, names))
            thread, byline = not words.isdisjoint(_THREADS), byline or not words.isdisjoint(_BYLINES)
    return name, NONE if tag in ("html", "body") else apart, thread, byline


class Paths:
    """Tag paths as nodes of a tree, each made after its parent; node 0 is the empty path."""

    def __init__(self):
        self.parent, self.article = [0], [False]
        self.node: dict[tuple[int, str], int] = {}

    def below(self, parent: int, name: str) -> int:
        found = self.node.get((parent, name))
        if found is None:
            found = self.node[parent, name] = len(self.parent)
            self.parent.append(parent)
            self.article.append(self.article[parent] or name.split(".", 1)[0] in ("article", "main"))
        return found

    def summed(self, own: dict[int, float]) -> list[float]:
        """The sum of each node's own value and those of all below it."""
        out = [0.0] * len(self.parent)
        for node, value in own.items():
            out[node] += value
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out

    def depths(self) -> list[int]:
        out = [0] * len(self.parent)
        for node in range(1, len(out)):
            out[node] = out[self.parent[node]] + 1
        return out


class _Open:
    """An open element."""

    __slots__ = ("tag", "node", "mark", "thread", "byline", "kinds")

    def __init__(self, tag: str, node: int, mark: int, thread: bool, byline: bool):
        self.tag, self.node, self.mark, self.thread, self.byline = tag, node, mark, thread, byline
        self.kinds: dict[int, int] = {}  # children with an author or time inside, by their path


def blocks_of(page: str) -> tuple[Paths, list[tuple[int, str, int, bool]]]:
    """The page's tag paths, and its blocks in order: (path, text, characters in links, set apart)."""
    paths = Paths()
    out: list[tuple[int, str, int, int]] = []
    marks: list[tuple[int, int]] = [(0, NONE)]  # (the mark around it, how it is set apart); 0 is none
    stack: list[_Open] = []
    tags: dict[str, int] = {}
    reach: list[int] = []  # places in the stack of paragraphs and of what ends their reach
    scopes: list[int] = []  # places of what closes itself, and of what holds those
    parts: list[str] = []
    linked = in_link = depth = headed = 0
    muted: tuple[str, int] | None = None  # an inline element set apart, and how many elements were open before it

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1].node if stack else 0, text, linked, stack[-1].mark if stack else 0))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal muted, headed
        flush()
        while len(stack) > k:
            last = stack.pop()
            tags[last.tag] -= 1
            if last.tag in ("h1", "article"):
                headed = 1
            if reach and reach[-1] == len(stack):
                reach.pop()
            if scopes and scopes[-1] == len(stack):
                scopes.pop()
            thread = last.byline and last.thread or headed and last.tag not in _BODY and max(last.kinds.values(), default=0) >= 3
            if thread:
                marks[last.mark] = (marks[last.mark][0], HARD)
            if stack and last.byline:
                stack[-1].byline = True
                stack[-1].kinds[last.node] = stack[-1].kinds.get(last.node, 0) + 1
        if muted and len(stack) < muted[1]:
            muted = None

    position, end, last_close, broken = 0, len(page), page.rfind(">"), 0
    while position < end:
        at = page.find("<", position)
        found = None
        if at < 0:
            at = end
        if at > position and not muted:
            text = page[position:at]
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text)
        if at == end:
            break
        after = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            position = close + 3 if close >= 0 else end
            continue
        if after in ("!", "?") and after:
            close = page.find(">", at)
            position = close + 1 if close >= 0 else end
            continue
        if at < last_close and (after == "/" or after.isalpha()):
            found = (_TAG if broken < BROKEN else _PLAIN_TAG).match(page, at)
            broken += found is None and after.isalpha()
        if found is None:
            if not muted:
                parts.append("<")
                linked += in_link
            position = at + 1
            continue
        position = found.end()
        tag = found[2].lower()
        if found[1]:
            if tag == "a":
                in_link = 0
            if muted and tag == muted[0]:
                depth -= 1
                if not depth:
                    muted = None
            elif tag == "p" and not tags.get("p"):
                flush()
            elif tag not in _INLINE and tags.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in _RAW or tag in _FOREIGN:
            if tag in _FOREIGN and found[3].endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, position)
            position = close.end() if close else end
            continue
        in_article = bool(tags.get("article") or tags.get("main"))
        if tag == "a":
            in_link = 1
        if tag in _INLINE:
            if muted:
                depth += tag == muted[0]
            elif found[3] or tag == "time":
                _, apart, _, byline = _marked(tag, found[3], in_article)
                if apart:
                    muted, depth = (tag, len(stack)), 1
                elif byline and stack:
                    stack[-1].byline = True
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if tag in _CLOSES_P and reach and stack[reach[-1]].tag == "p":
            pop_to(reach[-1])
        if tag in _SAME and scopes:
            at = len(scopes) - 1
            while tag == "tr" and at > 0 and stack[scopes[at]].tag in ("td", "th"):
                at -= 1
            if stack[scopes[at]].tag in _SAME[tag]:
                pop_to(scopes[at])
        flush()
        name, apart, thread, byline = _marked(tag, found[3], bool(tags.get("article") or tags.get("main")))
        if tag == "header" and not (tags.get("article") or tags.get("main")):
            apart = max(apart, SOFT)
        around = stack[-1].mark if stack else 0
        marks.append((around, apart))  # every element has a mark, so that what its end tells can still set it apart
        element = _Open(tag, paths.below(stack[-1].node if stack else 0, name), len(marks) - 1, thread, byline)
        if tag == "p" or tag in _BARRIERS:
            reach.append(len(stack))
        if tag in _SCOPES:
            scopes.append(len(stack))
        tags[tag] = tags.get(tag, 0) + 1
        stack.append(element)
    pop_to(0)
    return paths, _decided(paths, out, marks)


def _decided(paths: Paths, blocks: list[tuple[int, str, int, int]], marks: list[tuple[int, int]]) -> list[tuple[int, str, int, bool]]:
    """The blocks with a flag: in an element that is set apart and doesn't hold most of the page's running text."""
    hard = [False] * len(marks)
    for m in range(1, len(marks)):
        hard[m] = marks[m][1] == HARD or hard[marks[m][0]]
    held, marked = [0] * len(marks), [0] * len(marks)  # running text in an element, and that of it in an article
    for path, text, linked, m in blocks:
        if not hard[m]:
            n = max(0, len(text) - linked)
            held[m] += n
            marked[m] += n if paths.article[path] else 0
    for m in range(len(marks) - 1, 0, -1):
        held[marks[m][0]] += held[m]
        marked[marks[m][0]] += marked[m]
    apart = hard
    for m in range(1, len(marks)):
        most = held[m] and held[m] >= MOST * held[0] and marked[m] >= MOST * marked[0]
        apart[m] = apart[m] or apart[marks[m][0]] or (marks[m][1] == SOFT and not most)
    return [(path, text, linked, apart[m]) for path, text, linked, m in blocks]


#: Paths through an element that names the article count so many times.
ARTICLE_WEIGHT = 8


def path_scores(paths: Paths, blocks: list[tuple[int, str, int, bool]]) -> tuple[dict[int, float], float]:
    """Of each tag path in page order its fused ratios, and the threshold."""
    sums: dict[int, list[float]] = {}
    for path, text, linked, _ in blocks:
        own = sums.setdefault(path, [0, 0, 0])
        own[0] += max(0, len(text) - linked)
        own[1] += len(_PUNCTUATION.findall(text))
        own[2] += 1
    length = [chars / n for chars, _, n in sums.values()]
    marks = [(marks + 1) / n for _, marks, n in sums.values()]

    def smooth(x: list[float]) -> list[float]:
        return [(0.25 * x[max(0, i - 1)] + 0.5 * v + 0.25 * x[min(len(x) - 1, i + 1)]) if len(x) > 1 else v for i, v in enumerate(x)]

    fused = {p: a * b * (ARTICLE_WEIGHT if paths.article[p] else 1) for p, a, b in zip(sums, smooth(length), smooth(marks))}
    mean = sum(fused.values()) / len(fused)
    spread = (sum((f - mean) ** 2 for f in fused.values()) / len(fused)) ** 0.5
    return fused, min(max(fused.values()), max(0.5 * spread, 0.25 * mean))


def content_container(paths: Paths, blocks: list[tuple[int, str, int, bool]]) -> int:
    """The path of the element that holds the main text."""
    fused, bar = path_scores(paths, blocks)
    chosen = [p for p, score in fused.items() if score >= bar]
    held = dict.fromkeys(chosen, 0)
    for path, text, linked, _ in blocks:
        if path in held:
            held[path] += max(0, len(text) - linked)
    own = {p: (held[p] + 1) * (ARTICLE_WEIGHT if paths.article[p] else 1) for p in chosen}
    whole, depths, parent = paths.summed(own), paths.depths(), paths.parent
    total = sum(own.values())
    main = max((n for n in range(len(whole)) if whole[n] - own.get(n, 0) >= 0.75 * total), key=lambda n: (depths[n], -n), default=0)

    def articles(node: int) -> tuple[int, int]:
        """The outermost and the innermost article or main element at or above a node; -1 if there is none."""
        outer = inner = -1
        while node and paths.article[node]:
            if not paths.article[parent[node]] or names[node] in ("article", "main"):
                inner = node if inner < 0 and names[node] in ("article", "main") else inner
                outer = node
            node = parent[node]
        return outer, inner

    names = [""] * len(parent)
    for (_, name), node in paths.node.items():
        names[node] = name.split(".", 1)[0]
    article = articles(main)[0]
    inside = [n == article for n in range(len(parent))]
    if article >= 0:
        for n in range(1, len(parent)):
            inside[n] = inside[n] or inside[parent[n]]
    ends: dict[int, float] = {}
    for p in chosen:
        if article < 0 or inside[parent[p]]:
            ends[parent[p]] = ends.get(parent[p], 0) + 1
    below, n_ends = paths.summed(ends), sum(ends.values())
    shared = max((n for n in range(len(below)) if below[n] == n_ends), key=lambda n: depths[n], default=0) if n_ends else 0
    inner = articles(shared)[1]
    return inner if inner >= 0 else shared


def _link_paths(blocks: list[tuple[int, str, int, bool]]) -> set[int]:
    """Paths whose text is mostly that of links."""
    sums: dict[int, list[int]] = {}
    for path, text, linked, _ in blocks:
        own = sums.setdefault(path, [0, 0])
        own[0] += len(text)
        own[1] += linked
    return {path for path, (n, linked) in sums.items() if 2 * linked > n}


def main_text(page: str | None) -> str:
    """The main text of one page: its blocks, one empty line between them; empty if there is none."""
    if not page:
        return ""
    paths, blocks = blocks_of(page)
    blocks = [b for b in blocks if not b[3]]
    if not blocks:
        return ""
    root = content_container(paths, blocks)
    inside = [n == root for n in range(len(paths.parent))]
    for n in range(1, len(inside)):
        inside[n] = inside[n] or inside[paths.parent[n]]
    links = set() if paths.article[root] else _link_paths(blocks)
    return "\n\n".join(text for path, text, _, _ in blocks if inside[path] and path not in links)


def extract_text(pages: DataFrame, html_column: str = "html", key: str = "page_id", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per page: key, the kept columns, text and n_chars (code points).

    A null, empty or text-free page gives the empty text. Equal pages give equal rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    arrow_bounds(pages.sparkSession)
    names = [key, *keep]
    rows = pages.select(*names, F.col(html_column).cast("string").alias("html"))
    schema = ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names), "text string, n_chars long"])
    return rows.mapInArrow(run, schema)
