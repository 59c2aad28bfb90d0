"""HTML as a sequence of leaf blocks: runs of text between block boundaries, with the elements around them."""

from __future__ import annotations

import html
from typing import NamedTuple

import regex

# Fixed values of HTML: elements without content, elements that hold raw text, elements that run on inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noframes noembed".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
# What closes an open element of the same kind, up to the elements that hold it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TAG = regex.compile(
    r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)"""
)
_ATTRIBUTE = regex.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
_NAMES = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = regex.compile(r"[\s\x1c-\x1f]+")


class Block(NamedTuple):
    path: tuple[str, ...]  # elements around it, outermost first: `tag` or `tag:name,name` of class, id and role
    text: str  # with character references decoded and white space as one space
    linked: int  # characters of it inside links


def _element(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    names = [n.lower() for _, *values in _ATTRIBUTE.findall(attributes) for v in values for n in _NAMES.findall(v)]
    return f"{tag}:{','.join(dict.fromkeys(names))}" if names else tag


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in its order.

    Any input gives a result: unclosed and crossed tags end where the element around them ends, a `<` that begins no tag is
    text, comments, declarations and raw text (scripts, styles, titles) are skipped.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # (tag, element) of block elements
    path: tuple[str, ...] = ()
    parts: list[str] = []
    links = linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(until: int) -> None:
        nonlocal path
        del stack[until:]
        path = tuple(e for _, e in stack)

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    links = 0
                    break
            continue
        if tag in RAW:
            end = regex.compile(f"</{tag}(?![A-Za-z0-9])[^>]*(?:>|\\Z)", regex.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in CLOSES:
            same, holders = CLOSES[tag]
            outermost = len(stack)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in holders:
                    break
                if stack[i][0] in same:
                    outermost = i
            close(outermost)
        stack.append((tag, _element(tag, attributes)))
        path = (*path, stack[-1][1])
    add(page[at:])
    flush()
    return out
