"""A forgiving reader of HTML that reports elements by their paths, for tasks on many pages.

Elements are named by the path of tags, classes and ids that leads to them, as a hash
chain, so deep nesting costs no more than the markup is long. Missing end tags of
paragraphs, list items, cells and the like are implied; stray end tags are ignored;
comments, scripts, styles and other raw text are skipped. Pages that break off are read as far as
they go.
"""

import re
from typing import NamedTuple

import xxhash

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</(?P<end>[A-Za-z][^\s/>]*)[^>]*>?|<(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)[^>]*>?", re.S
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS, _CAMEL, _SPLIT = re.compile(r"\d{3,}"), re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[^A-Za-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Which open elements a start tag ends, and which open elements stop the search for them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"body"}),
}

#: Elements that hold no article text, words of classes and ids that say so, and how such words begin.
CHROME_TAGS = frozenset("nav aside footer form head select button dialog svg canvas audio video object map datalist menu".split())
CHROME_WORDS = frozenset(
    "ad ads adbox adslot banner sponsor sponsored promo promotion consent gdpr notice notices popup modal overlay subscribe signup login menu nav topbar toolbar footer"
    " masthead reply replies respond discussion social share sharing related recommended pagination pager widget skip".split()
)
CHROME_STEMS = ("advert", "comment", "cookie", "sidebar", "newsletter", "breadcrumb", "navbar", "navigation", "disqus", "sponsor", "recommend")
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
STATE_WORDS = frozenset("has with no without is not".split())

ROOT = 1
CHROME, ARTICLE, LINK, HEADER, HEADING = 1, 2, 4, 8, 16


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def token(parent: int, what: str) -> int:
    """The name of an element or text below ``parent``."""
    return _signed(xxhash.xxh64_intdigest(f"{parent}|{what}"))


def _says_chrome(names: str) -> tuple[bool, bool]:
    """Whether classes and ids name something outside the article, and whether they name a header."""
    chrome = header = False
    for name in names.split():
        words = [w.lower() for w in _SPLIT.split(_CAMEL.sub(" ", name)) if w]
        if not words or words[0] in STATE_WORDS:
            continue
        chrome |= any(w in CHROME_WORDS or w.startswith(CHROME_STEMS) for w in words)
        header |= "header" in words
    return chrome, header


def described(parent: int, name: str, attrs: str) -> tuple[int, int]:
    """(path, flags) of an element."""
    a = {k.lower(): b or c or d for k, b, c, d in _ATTR.findall(attrs)} if attrs and not attrs.isspace() else {}
    names = f"{a.get('class', '')} {a.get('id', '')}".strip()
    role = a.get("role", "").lower()
    flags = 0
    chrome, header = _says_chrome(names) if names else (False, False)
    if name in ("html", "body", "main"):
        chrome = False
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    if chrome or hidden or name in CHROME_TAGS or role in CHROME_ROLES:
        flags |= CHROME
    if name in ("article", "main") or role == "main" or a.get("itemprop", "").lower() == "articlebody":
        flags |= ARTICLE
    flags |= LINK * (name == "a") | HEADER * (name == "header" or header) | HEADING * (name == "h1")
    return token(parent, f"{name}.{_DIGITS.sub('#', names)}"), flags


class Open(NamedTuple):
    """An element: its tag, path and flags, the place of its parent among the elements, and what it is inside of or is itself."""

    name: str
    path: int
    flags: int
    up: int
    chrome: bool
    link: bool
    article: bool


class Piece(NamedTuple):
    """Text between two tags: its block, its raw text, and the place of the element that holds it."""

    block: int
    raw: str
    at: int


_SEEN: dict[tuple[int, str, str], tuple[int, int]] = {}


def read(markup: str) -> tuple[list[Open], list[Piece]]:
    """All elements in the order of their start tags, the first of them the page itself, and all pieces of text."""
    elements = [Open("", ROOT, 0, -1, False, False, False)]
    pieces: list[Piece] = []
    stack, open_names = [0], {}
    block, pos, size = 0, 0, len(markup)
    if len(_SEEN) > 100_000:
        _SEEN.clear()

    def close_to(i: int) -> None:
        nonlocal block
        for e in stack[i:]:
            open_names[elements[e].name] -= 1
            block += elements[e].name in BLOCK
        del stack[i:]

    def imply(targets: set, stops: set, nearest: bool = False) -> None:
        """Close the open ``targets`` down to the first of ``stops``, or only the nearest that no block lies above."""
        if not any(open_names.get(t) for t in targets):
            return
        last = 0
        for i in range(len(stack) - 1, 0, -1):
            n = elements[stack[i]].name
            if n in targets:
                last = i
            if n in (BLOCK if nearest else stops):
                break
        if last:
            close_to(last)

    while pos < size:
        lt = markup.find("<", pos)
        m = _PART.match(markup, lt) if lt >= 0 else None
        if m is None:
            end = size if lt < 0 else lt + 1
            pieces.append(Piece(block, markup[pos:end], stack[-1]))
            pos = end
            continue
        if lt > pos:
            pieces.append(Piece(block, markup[pos:lt], stack[-1]))
        pos = m.end()
        if m["name"]:
            name, attrs = m["name"].lower(), m["attrs"]
            if name in BLOCK:
                imply({"p"}, set(), True)
                block += 1
            if name in ENDS:
                imply(*ENDS[name])
            up = elements[stack[-1]]
            key = (up.path, name, attrs)
            if key not in _SEEN:
                _SEEN[key] = described(*key)
            path, flags = _SEEN[key]
            out = bool(flags & CHROME) or name in RAW or bool(flags & HEADER) and not up.article
            if name == "br":
                pieces.append(Piece(block, " ", stack[-1]))
            elements.append(Open(name, path, flags, stack[-1], up.chrome or out, up.link or bool(flags & LINK), up.article or bool(flags & ARTICLE)))
            if name in RAW:
                stop = re.compile(f"</{name}(?![^\\s/>])[^>]*>?", re.I).search(markup, pos)
                pos = stop.end() if stop else size
            elif name not in VOID:
                stack.append(len(elements) - 1)
                open_names[name] = open_names.get(name, 0) + 1
        elif m["end"]:
            name = m["end"].lower()
            block += name in BLOCK
            if open_names.get(name):
                for i in range(len(stack) - 1, 0, -1):
                    n = elements[stack[i]].name
                    if n == name:
                        close_to(i)
                        break
                    if n in BLOCK and name not in BLOCK:
                        break
    return elements, pieces
