"""Block trees of web pages, and their alignment by simple tree matching."""

import html
import re
from dataclasses import dataclass, field

import numpy as np

#: Elements that do not start a block of their own: their text belongs to the block around.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark"
    " q s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = set("script style noscript template textarea title iframe object svg math canvas select".split())
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
HOLDS = set("ul ol dl table tbody thead section article main div nav aside body html".split())
#: What is around an article, by element, role and whole names in class and id.
CHROME = set("nav footer aside form button menu dialog".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation"
    " menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice"
    " alert popup modal overlay newsletter subscribe signup login search comment comments disqus"
    " reply replies related share sharing social widget pagination pager toolbar skip copyright".split()
)
HEADINGS = set("header banner topbar".split())
#: Words that make names of parts of a page together with those above, as in site-footer.
NEUTRAL = set(
    "site page main global top bottom left right primary secondary user post posts article blog box"
    " bar block body list item items links link section area wrapper wrap container content inner"
    " outer holder panel group row col text form buttons button message banner header widget title"
    " note unit slot zone thread feed more icon icons".split()
)
#: An element with this share of a page's text is no menu or advert, whatever its name.
MOST = 0.8
DEEPEST = 200

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


@dataclass
class Page:
    """Nodes in page order: depth and element; blocks: node, text, link characters, chrome."""

    depths: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    chrome: list[bool] = field(default_factory=list)
    block_nodes: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)


def _is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is around the article; ``inside`` the article, headings are not."""
    if tag in CHROME or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if "display:none" in found.get("style", "").replace(" ", ""):
        return True
    if found.get("role") in CHROME_ROLES:
        return True
    return any(_names_chrome(n, inside) for n in f"{found.get('class', '')} {found.get('id', '')}".split())


def _names_chrome(name: str, inside: bool) -> bool:
    """Whether a name in class or id tells of a part around the article, as a whole.

    All its words must: ``site-footer`` and ``comment-list`` do, ``no-sidebar``,
    ``has-comments`` and ``search-algorithms`` do not.
    """
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    telling = CHROME_WORDS if inside else CHROME_WORDS | HEADINGS
    return any(w in telling for w in words) and all(w in telling or w in NEUTRAL for w in words)


def _judge(page: Page, parents: list[int], labelled: list[bool]) -> None:
    """Sets what is chrome: labelled elements and what is in them.

    Labels are not believed of an element that holds the article: the article or main
    element of most text, if that is as much as all that no label takes; else, where there
    is none, any element with MOST of the text.
    """
    chars = [0] * len(parents)
    for node, text in zip(page.block_nodes, page.texts, strict=True):
        chars[node] += len(text)
    own = chars[:]
    for node in range(len(parents) - 1, 0, -1):  # children come after their parents
        chars[parents[node]] += chars[node]

    def spread(exempt: set[int]) -> list[bool]:
        chrome = [False] * len(parents)
        for node in range(1, len(parents)):
            chrome[node] = chrome[parents[node]] or (labelled[node] and node not in exempt)
        return chrome

    chrome = spread(set())
    articles = [n for n, tag in enumerate(page.tags) if tag in ("article", "main") and not labelled[n]]
    holder = max(articles, key=lambda n: (chars[n], -n), default=None)
    if holder is not None:
        # an article that is chrome by what is around it, against the text that is not
        outside = sum(n for n, c in zip(own, chrome, strict=True) if not c)
        if chrome[holder] and chars[holder] >= outside:
            exempt = set()
            while holder >= 0:
                exempt.add(holder)
                holder = parents[holder]
            chrome = spread(exempt)
    else:
        chrome = spread({n for n, c in enumerate(chars) if c >= MOST * chars[0] > 0})
    page.chrome[:] = chrome


def parse(source: str) -> Page:
    """The block tree of a page, however its elements are closed.

    Text is decoded and its white space made single blanks; blocks without text have no
    entry. Nodes deeper than DEEPEST stand at that depth.
    """
    page = Page()
    # open blocks: tag, node, inside an article
    stack: list[tuple[str, int, bool]] = [("", -1, False)]
    parents: list[int] = []
    labelled: list[bool] = []
    parts: list[str] = []
    linked, in_link = 0, False
    # an inline element that is left out: its tag, how many of that tag are open, the block
    muted, level, muted_in = "", 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and stack[-1][1] >= 0:
                page.block_nodes.append(stack[-1][1])
                page.texts.append(text)
                page.links.append(linked)
            parts.clear()
            linked = 0

    def add(tag: str, label: bool, inside: bool) -> None:
        page.depths.append(min(len(stack), DEEPEST))
        page.tags.append(tag)
        page.chrome.append(False)
        parents.append(stack[-1][1])
        labelled.append(label)
        stack.append((tag, len(page.tags) - 1, inside))

    add("page", False, False)
    at = 0
    for token in _TOKEN.finditer(source):
        if token.start() < at:
            continue
        if token.start() > at:
            text = source[at : token.start()]
            if not muted:
                parts.append(text)
                if in_link:
                    linked += len(text)
        at = token.end()
        closing, tag, attributes = token.group(1, 2, 3)
        if tag is None:
            closing, tag, attributes = token.group(4, 5, 6)
            if tag is None:
                continue
        tag = tag.lower()
        if tag in SKIPPED and not closing:
            end = re.compile(f"</{tag}\\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = not closing
            if tag in VOID:
                continue
            if muted:
                level += (tag == muted) * (-1 if closing else 1)
                muted = muted if level else ""
            elif not closing and attributes and _is_chrome(tag, attributes, stack[-1][2]):
                muted, level, muted_in = tag, 1, len(stack)
            continue
        flush()
        if closing:
            if any(tag == entry[0] for entry in stack[2:]):
                while stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
            if len(stack) < muted_in:
                muted = ""  # its block has ended
            in_link = False
            continue
        if stack[-1][0] == "p":
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, 1, -1):
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in HOLDS:
                    break
        if len(stack) < muted_in:
            muted = ""
        inside = stack[-1][2]
        if tag not in VOID:
            add(tag, bool(muted) or (tag != "body" and _is_chrome(tag, attributes, inside)), inside or tag in ("article", "main"))
    if at < len(source) and not muted:
        parts.append(source[at:])
    flush()
    _judge(page, parents, labelled)
    return page


class Tree:
    """A page's nodes with children and numbers for equal subtrees."""

    def __init__(self, depths: list[int], tags: list[str], known: dict):
        self.tags = tags
        self.children: list[list[int]] = [[] for _ in tags]
        stack: list[int] = []
        for node, depth in enumerate(depths):
            while stack and depths[stack[-1]] >= depth:
                stack.pop()
            if stack:
                self.children[stack[-1]].append(node)
            stack.append(node)
        self.shape = [0] * len(tags)
        for node in range(len(tags) - 1, -1, -1):
            key = (tags[node], *[self.shape[c] for c in self.children[node]])
            shape = known.setdefault(key, len(known))
            self.shape[node] = shape


class Matcher:
    """Simple tree matching: the largest set of node pairs that keeps order and ancestry.

    Subtrees of one shape are matched as they stand, and children of one shape at either
    end are paired before the rest is solved, which loses nothing: no pair of subtrees
    weighs more than the smaller one.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.weights: dict[tuple[int, int], int] = {}
        self.sizes: dict[int, int] = {}
        self.parts: list[tuple] = []

    def tree(self, depths: list[int], tags: list[str]) -> Tree:
        tree = Tree(depths, tags, self.known)
        for key in list(self.known)[len(self.parts) :]:
            self.parts.append(key)
            self.sizes[len(self.parts) - 1] = 1 + sum(self.sizes[s] for s in key[1:])
        return tree

    def weight(self, one: int, other: int) -> int:
        if one == other:
            return self.sizes[one]
        if self.parts[one][0] != self.parts[other][0]:
            return 0
        key = (one, other)
        if key not in self.weights:
            a, b = self.parts[one][1:], self.parts[other][1:]
            self.weights[key] = 1 + sum(self.weight(x, y) for x, y in self.paired(a, b, range(len(a)), range(len(b)), shapes=True))
        return self.weights[key]

    def paired(self, a, b, left, right, shapes=False):
        """Pairs of children, as shapes or as the numbers in ``left`` and ``right``."""
        low = 0
        top = min(len(a), len(b))
        while low < top and a[low] == b[low]:
            low += 1
        high = 0
        while high < top - low and a[-1 - high] == b[-1 - high]:
            high += 1
        found = [(i, i) for i in range(low)]
        found += self._middle(a[low : len(a) - high], b[low : len(b) - high], low)
        found += [(len(a) - high + i, len(b) - high + i) for i in range(high)]
        if shapes:
            return [(a[i], b[j]) for i, j in found]
        return [(left[i], right[j]) for i, j in found]

    def _middle(self, a, b, offset: int) -> list[tuple[int, int]]:
        if not a or not b:
            return []
        ua, ia = np.unique(np.array(a), return_inverse=True)
        ub, ib = np.unique(np.array(b), return_inverse=True)
        table = np.array([[self.weight(int(x), int(y)) for y in ub] for x in ua], dtype=np.int32)
        # two rows of weights, and a bit a cell each for where the best comes from
        best = np.zeros(len(b) + 1, dtype=np.int32)
        above, before = [], []
        for i in range(len(a)):
            row = np.zeros_like(best)
            row[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + table[ia[i], ib]))
            above.append(np.packbits(row[1:] == best[1:]))
            before.append(np.packbits(row[1:] == row[:-1]))
            best = row

        def told(bits: list[np.ndarray], i: int, j: int) -> bool:
            return bool(bits[i - 1][(j - 1) >> 3] >> (7 - (j - 1) % 8) & 1)

        found, i, j = [], len(a), len(b)
        while i and j:
            if told(above, i, j):
                i -= 1
            elif told(before, i, j):
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((offset + i, offset + j))
        return found[::-1]

    def align(self, reference: Tree, page: Tree) -> list[tuple[int, int]]:
        """Matched nodes of the reference and of the page."""
        found, todo = [], [(0, 0)] if reference.tags and page.tags else []
        while todo:
            a, b = todo.pop()
            found.append((a, b))
            left, right = reference.children[a], page.children[b]
            shapes = [reference.shape[c] for c in left], [page.shape[c] for c in right]
            for x, y in self.paired(*shapes, left, right):
                if reference.tags[x] == page.tags[y]:
                    todo.append((x, y))
        return found
