"""HTML to blocks: the leaf text runs of a page with their tag paths.

A block is the text between two borders of block-level elements; inline
elements, drawings, formulas, embedded objects and <br> don't end it. Scripts,
styles, templates, titles and comments hold no text. Elements that HTML closes
by implication are closed so (<p> by any block-level element, <li>, cells,
options by their like); end tags without a start are ignored, and what is left
open ends with its parent or with the page. A raw element that is never closed
takes the rest of the page, as in browsers.

Time is linear in the page: a tag's end is looked for once, and elements nested
deeper than `DEPTH` keep their text but add nothing to its path. A `<` that
begins no tag, or whose tag never ends, is text. An empty page has no blocks.
"""

from __future__ import annotations

import html
import re

#: Names of HTML.
BLOCK_LEVEL = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav noscript ol optgroup option p pre search section select summary"
    " table caption colgroup col tbody thead tfoot tr td th ul button label".split()
)
RAW = frozenset("script style title textarea template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "tbody", "thead"),
    "tfoot": ("tr", "td", "th", "tbody", "thead")
}
_STOPS = frozenset("ul ol menu dl table select body html article section div form".split())
_ON = ("tr", "tbody", "tfoot", "optgroup")  # these close more than one element
FOREIGN = ("svg", "math")
DEPTH = 400
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label|type)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Leaf:
    """text; path: (tag, tokens of its attributes) from the root; linked: the share of characters inside links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: float):
        self.text, self.path, self.linked = text, path, linked


_memo: dict[str, tuple] = {}


def _tokens(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role, itemprop, aria-label and type, in small letters."""
    if attributes in _memo:
        return _memo[attributes]
    out = []
    for _, value in _NAMED.findall(attributes):
        out += (w.lower() for w in _PART.findall(html.unescape(value.strip("\"'"))))
    if len(_memo) > 20_000:
        _memo.clear()
    _memo[attributes] = tuple(dict.fromkeys(out))
    return _memo[attributes]


def tokens(page: str):
    """(text before, "" or "/" of an end tag, name in small letters, attributes, end) of each tag; name None for the text at the end."""
    at = text = 0
    quotes = True  # until a tag with an open quote has run to the end of the page
    while True:
        at = page.find("<", at)
        if at < 0 or page.find(">", at) < 0 and not page.startswith("<!--", at):
            break
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark = "-->" if page[at + 2] == "-" else "]]>"
            stop = page.find(mark, at + (4 if mark == "-->" else 9))
            yield page[text:at], "", "", "", 0
            at = text = stop + 3 if stop >= 0 else len(page)
            continue
        if page[at + 1] in "!?":
            yield page[text:at], "", "", "", 0
            at = text = page.find(">", at) + 1
            continue
        slash = "/" if page[at + 1] == "/" else ""
        name = _NAME.match(page, at + 1 + len(slash))
        if not name:
            at += 1
            continue
        close = _QUOTED_END.match(page, name.end()) if quotes else None
        quotes = quotes and close is not None
        end = close.end() if close else page.find(">", name.end()) + 1
        skip = yield page[text:at], slash, name[0].lower(), page[name.end() : end - 1], end
        at = text = end if skip is None else skip
    yield page[text:], "", None, "", len(page)


class _Reader:
    """Open elements and the text of the block that is being read."""

    def __init__(self):
        self.out: list[Leaf] = []
        self.stack: list[tuple[str, tuple]] = []
        self.open: dict[str, int] = {}
        self.deeper: dict[str, int] = {}  # open elements below DEPTH
        self.parts: list[tuple[str, bool]] = []
        self.path: tuple | None = None  # of the stack as it is, once a leaf needed it

    def say(self, text: str) -> None:
        if text:
            self.parts.append((text, self.open.get("a", 0) > 0))

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(p for p, _ in self.parts)).split())
            if text:
                whole = sum(len(p) for p, _ in self.parts)
                if self.path is None:
                    self.path = tuple(x for x in self.stack if x[0] in BLOCK_LEVEL or x[1])
                self.out.append(Leaf(text, self.path, sum(len(p) for p, inside in self.parts if inside) / whole))
            self.parts.clear()

    def cut(self, k: int) -> None:
        """Close the elements from the k-th on."""
        if any(name in BLOCK_LEVEL for name, _ in self.stack[k:]):
            self.flush()
        for name, _ in self.stack[k:]:
            self.open[name] -= 1
        del self.stack[k:]
        self.deeper.clear()
        self.path = None

    def end(self, name: str) -> None:
        if self.deeper.get(name, 0):
            self.deeper[name] -= 1
        elif self.open.get(name, 0):
            self.cut(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == name))
            return
        if name in BLOCK_LEVEL:
            self.flush()

    def implied(self, name: str) -> None:
        """What a block-level start tag closes."""
        if self.open.get("p", 0):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    self.cut(k)
                    break
                if self.stack[k][0] in BLOCK_LEVEL:
                    break
        likes = CLOSES.get(name, ())
        if any(self.open.get(x, 0) for x in likes):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in likes:
                    self.cut(k)
                    if name not in _ON:
                        break
                elif self.stack[k][0] in _STOPS:
                    break

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK_LEVEL:
            self.flush()
            self.implied(name)
        if name in VOID or attributes.endswith("/") and (name in FOREIGN or any(self.open.get(x, 0) for x in FOREIGN)):
            return
        if len(self.stack) >= DEPTH:
            self.deeper[name] = self.deeper.get(name, 0) + 1
            return
        self.stack.append((name, _tokens(attributes) if attributes else ()))
        self.open[name] = self.open.get(name, 0) + 1
        self.path = None


def leaves(page: str) -> list[Leaf]:
    reader, found, skip = _Reader(), tokens(page), None
    while True:
        text, slash, name, attributes, end = found.send(skip)
        skip = None
        reader.say(text)
        if name is None:
            break
        if name == "br":
            reader.parts.append((" ", False))
        elif slash:
            reader.end(name)
        elif name in RAW:
            stop = _RAW_END[name].search(page, end)
            skip = page.find(">", stop.end()) + 1 if stop else 0
            skip = skip or len(page)
        elif name:
            reader.start(name, attributes)
    reader.flush()
    return reader.out
