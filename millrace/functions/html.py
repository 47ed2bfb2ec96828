"""Cutting sloppy HTML into tags and text with one regular expression, without building a tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

#: Tags that don't end a block of text.
INLINE = frozenset("a abbr b code em i img kbd mark small span strong sub sup u".split())
#: Elements whose text is never shown.
HIDDEN = frozenset("script style noscript template".split())
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("html head title meta link base script style noscript template".split())

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*?)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def squeeze(text: str) -> str:
    """Entities decoded, white-space runs as one space, ends trimmed."""
    return _SPACE.sub(" ", unescape(text)).strip()


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", raw text), ("open", tag, raw attributes) or ("close", tag, ""), in order, without comments and hidden elements."""
    html = _COMMENT.sub("", html)
    at, hidden = 0, ""
    for m in _TAG.finditer(html):
        if hidden:
            if m.group(1) and m.group(2).lower() == hidden:
                hidden, at = "", m.end()
            continue
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            yield "close", tag, ""
        elif tag in HIDDEN:
            if not m.group(3).rstrip().endswith("/") or tag in ("script", "style"):
                hidden = tag
        else:
            yield "open", tag, m.group(3)
    if not hidden and at < len(html):
        yield "text", "", html[at:]


def title_of(html: str) -> str:
    found = re.search(r"<title[^>]*>(.*?)</title", html, re.S | re.I)
    return squeeze(found.group(1)) if found else ""


def blocks(html: str | None) -> list[tuple[str, tuple[str, ...], bool]]:
    """(text, path, linked): the texts between neighbouring block tags with the open elements around them.

    Inline tags are dropped; text in the head and in hidden elements doesn't count. A path entry is a tag with its
    classes, id and role, such as "div.sidebar". linked tells whether most of the text is in links.
    """
    out: list[tuple[str, tuple[str, ...], bool]] = []
    if not html:
        return out
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    in_link, linked, head = 0, 0, False

    def flush():
        nonlocal linked
        whole = squeeze("".join(text))
        if whole:
            out.append((whole, tuple(x for _, x in stack), 2 * linked > sum(map(len, text))))
        text.clear()
        linked = 0

    for kind, tag, rest in events(html):
        if kind == "text":
            if not head:
                text.append(rest)
                linked += len(rest) if in_link else 0
            continue
        if tag == "head":
            flush()
            head = kind == "open"
            continue
        if head:
            if tag in _HEAD:
                continue
            head = False
        if tag in INLINE:
            if tag == "a":
                in_link = 1 if kind == "open" else 0
            continue
        flush()
        in_link = 0 if kind == "close" or tag not in VOID else in_link
        if kind == "open":
            if tag in VOID:
                continue
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd"):  # an end tag that was left out
                ends = {"p": ("p",), "li": ("p", "li"), "tr": ("td", "th", "tr", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p")}[tag]
                while stack and stack[-1][0] in ends:
                    stack.pop()
            at = attributes(rest)
            stack.append((tag, ".".join([tag, *at.get("class", "").lower().split()]) + ("#" + at["id"].lower() if at.get("id") else "") + ("@" + at["role"].lower() if at.get("role") else "")))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
    flush()
    return out
