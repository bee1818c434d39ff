"""HTML as a sequence of leaf blocks, each with the path of open elements around it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

# HTML's element groups.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN_TAGS = frozenset("script style title textarea iframe noscript template svg object select".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SPACE_TAGS = frozenset("br hr img input button option label".split())

# A quote opens a value only behind "="; anywhere else it is part of a name. Possessive, so no input is read twice over.
ATTRIBUTES = r"(?:\s++|/|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|=)*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
HIDDEN_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in HIDDEN_TAGS}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """Text with white space collapsed, the words naming each open element outermost first, and the share of it in links."""

    text: str
    path: tuple[tuple[str, ...], ...]
    linked: float


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    if "=" not in attributes:
        return (tag,)
    found = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower()
    return (tag, *dict.fromkeys(PART.findall(found)))


def blocks(page: str | None) -> Iterator[Block]:
    """The leaf blocks of a page in order. Scripts, styles, comments and markup give none; character references are decoded."""
    page = page or ""
    stack: list[tuple[str, ...]] = []
    text: list[str] = []
    linked = total = link_depth = 0

    def close() -> Iterator[Block]:
        nonlocal linked, total
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            yield Block(joined, tuple(stack), linked / max(1, total))
        text.clear()
        linked = total = 0

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            got = m.group()
            if got[0] != "<" or got == "<":
                text.append(got)
                total += len(got)
                linked += len(got) * (link_depth > 0)
            continue
        tag, ending = tag.lower(), bool(m.group(1))
        if tag in HIDDEN_TAGS and not ending:
            # A slash closes no HTML element; only foreign ones heed it.
            if tag != "svg" or not m.group(3).endswith("/"):
                end = HIDDEN_END[tag].search(page, at)
                at = end.end() if end else size
        elif tag in BLOCK_TAGS:
            yield from close()
            link_depth = 0
            if ending:
                if any(x[0] == tag for x in stack):
                    while stack.pop()[0] != tag:
                        pass
            else:
                if tag in CLOSES_P and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                stack.append(_names(tag, m.group(3)))
        elif tag == "a":
            link_depth = max(0, link_depth + (-1 if ending else 1))
        elif tag in SPACE_TAGS:
            text.append(" ")
    yield from close()
