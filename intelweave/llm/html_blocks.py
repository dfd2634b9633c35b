"""Pages cut into leaf blocks: runs of text between the edges of block elements, with their tag paths.

One forward scan with a stack of open block elements; markup may be incomplete in any way. Paths are
nodes of a tree shared by all pages of a batch, so a deep page costs no more than its tags.
"""

from __future__ import annotations

import re
from html import unescape

# Elements that begin a block, elements whose content is no text, and what an opening tag closes.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style title noscript template textarea select button datalist iframe object svg math canvas audio video".split())
RAW = frozenset("script style title textarea".split())  # up to their end tag everything is content
ENDED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("ul ol menu dl table".split())  # an opening tag closes nothing beyond one of these
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INLINE_SPACE = frozenset("br img input wbr".split())
_VOID = frozenset("hr".split())

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def path_tokens(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, then the words of its class, id and role."""
    words = {p.lower() for m in _NAMES.finditer(attributes) for p in _PARTS.findall(m[2] or m[3] or m[4] or "")} if "=" in attributes else ()
    return (tag, *sorted("." + w for w in words))


class Paths:
    """A tree of tag paths; node 0 is the root. ``parent`` and ``tokens`` stand in the order of creation."""

    def __init__(self) -> None:
        self.parent, self.tokens = [0], [()]
        self.known: dict[tuple[int, str, str], int] = {}

    def child(self, node: int, tag: str, attributes: str) -> int:
        key = (node, tag, attributes)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.parent)
            self.parent.append(node)
            self.tokens.append(path_tokens(tag, attributes))
        return found


def blocks_of(html: str, paths: Paths) -> list[tuple[str, int, int]]:
    """(text, path node, characters inside links) of every leaf block in page order.

    Character references are decoded, then white space becomes single blanks; blocks without text are
    left out. What stands in ``HIDDEN`` elements and comments is no text. ``</p>`` and the like may be
    missing, as may the ends of tags and of the page; end tags that close nothing are ignored.
    """
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int]] = []
    depth: dict[str, int] = {}  # open elements by tag
    text: list[str] = []
    linked: list[str] = []
    endless: set[str] = set()  # hidden elements that end nowhere in the rest of the page
    node, in_link, at, n = 0, False, 0, len(html)

    def flush() -> None:
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                links = len(" ".join(unescape("".join(linked)).split())) if linked else 0
                out.append((words, node, min(links, len(words))))
            text.clear()
            linked.clear()

    def pop() -> None:
        nonlocal node
        tag, node = stack.pop()
        depth[tag] -= 1

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if in_link:
                linked.append(piece)

    while at < n:
        tag_at = html.find("<", at)
        if tag_at < 0:
            add(html[at:])
            break
        m = _TAG.match(html, tag_at)
        if m is None:  # a sign of its own
            add(html[at:tag_at + 1])
            at = tag_at + 1
            continue
        add(html[at:tag_at])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            in_link = not closing
        elif tag in HIDDEN:
            if closing:
                continue
            end = None if tag in endless else _end_of(tag).search(html, at)
            if end is not None:
                at = end.end()
            elif tag in RAW:
                at = n
            else:
                endless.add(tag)
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            in_link = False
            if not closing:
                if depth.get("p"):
                    while stack and stack[-1][0] == "p":
                        pop()
                ended = ENDED_BY.get(tag)
                if ended:
                    low = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ended or stack[i][0] in SCOPES), None) if any(depth.get(t) for t in ended) else None
                    if low is not None and stack[low][0] in ended:
                        while low > 0 and stack[low - 1][0] in ended:
                            low -= 1
                        while len(stack) > low:
                            pop()
                if tag not in _VOID:
                    stack.append((tag, node))
                    depth[tag] = depth.get(tag, 0) + 1
                    node = paths.child(node, tag, m[3] if "=" in m[3] else "")
            else:
                ends = HEADINGS if tag in HEADINGS else (tag,)  # any heading's end tag closes a heading
                if any(depth.get(t) for t in ends):
                    while stack[-1][0] not in ends:
                        pop()
                    pop()
        elif tag in _INLINE_SPACE:
            add(" ")
    flush()
    return out


_ENDS: dict[str, re.Pattern] = {}


def _end_of(tag: str) -> re.Pattern:
    if tag not in _ENDS:
        _ENDS[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
    return _ENDS[tag]
