"""Leaf blocks of a page's markup, and the lines of its visible text with the block each came from."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_CLASS = re.compile(r"class\s*=\s*[\"']([^\"']*)")
_NAME = re.compile(r"([a-zA-Z-]+)\s*=")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)

# Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template svg head".split())
FORMAT = frozenset("b i em strong u s small sup sub code mark abbr cite q br wbr img font time kbd samp var".split())
CONTROLS = frozenset("a span button label".split())
INLINE = FORMAT | CONTROLS
TEXTUAL = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote dd dt figcaption caption summary".split())
CELLS = frozenset("td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav aside footer noscript menu dialog form".split())
MAIN = frozenset("main article".split())


class Leaf:
    """The text of one leaf element, with the names of its ancestors from the innermost and the nearest container."""

    __slots__ = ("text", "tag", "path", "attributes", "container")

    def __init__(self, text: str, tag: str, path: tuple[str, ...], attributes: str, container: int):
        self.text, self.tag, self.path, self.attributes, self.container = text, tag, path, attributes, container


def leaves(markup: str | None) -> tuple[list[Leaf], str]:
    """(leaves in document order, title). Cut or unclosed markup gives what there is."""
    if not markup:
        return [], ""
    found = _TITLE.search(markup)
    title = " ".join(html.unescape(found.group(1)).split()) if found else ""
    stack: list[tuple[str, str, int]] = []
    out: list[Leaf] = []
    parts: list[str] = []
    owner: tuple | None = None
    number, at, n = 0, 0, len(markup)

    def flush() -> None:
        nonlocal owner
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and owner:
                out.append(Leaf(text, *owner))
            parts.clear()
        owner = None

    def place() -> tuple:
        """Tag, ancestors, attributes and container number of the text at hand."""
        i = len(stack) - 1
        for k in range(i, -1, -1):  # inline elements belong to the paragraph, item or heading around them
            if stack[k][0] in TEXTUAL:
                i = k
                break
            if stack[k][0] not in INLINE:
                if stack[i][0] in FORMAT:
                    i = k
                break
        if i < 0:
            return "body", (), "", 0
        above = stack[i - 1] if i else ("body", "", 0)
        own = stack[i] if stack[i][0] not in ("div", "section", "main", "article", "td", "body") or i == 0 else above
        return stack[i][0], tuple(t for t, _, _ in reversed(stack[:i]) if t not in ("html", "body")), above[1], own[2] if own is above else above[2]

    while at < n:
        m = _TOKEN.search(markup, at)
        raw = markup[at : m.start()] if m else markup[at:].partition("<")[0] if markup.rfind("<", at) > markup.rfind(">", at) else markup[at:]
        if raw and not raw.isspace():
            if owner is None:
                owner = place()
            parts.append(raw)
        elif raw:
            parts.append(" ") if parts else None
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SKIPPED and not m.group(1):
            end = re.compile(rf"</{tag}\s*>", re.I).search(markup, at)
            at = end.end() if end else n
            continue
        if not (tag in FORMAT or (tag in CONTROLS and any(t in TEXTUAL for t, _, _ in stack))):
            flush()
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID and not m.group(3).endswith("/"):
            number += 1
            stack.append((tag, m.group(3), number))
    flush()
    return out, title


_BULLET = re.compile(r"^(?:[-*•–]|#{1,6}|\d{1,3}[.)])\s+")


def matched(lines: list[str], blocks: list[Leaf]) -> list[int]:
    """For each line (white space collapsed) the index of the leaf it shows, whole or as a wrapped piece of it; else -1."""
    whole: dict[str, list[int]] = {}
    starts: dict[str, list[int]] = {}
    for i, b in enumerate(blocks):
        whole.setdefault(b.text, []).append(i)
        starts.setdefault(b.text[:16], []).append(i)
    out, at, offset = [], -1, 0
    for line in lines:
        got = -1
        for text in (line, _BULLET.sub("", line)):
            if at >= 0 and offset < len(blocks[at].text) and blocks[at].text.startswith(text, offset):
                got, offset = at, offset + len(text) + 1
                break
            if text in whole:
                places = whole[text]
                got = places.pop(0) if len(places) > 1 else places[0]
                offset = len(text) + 1
                break
            for i in starts.get(text[:16], ()):
                t = blocks[i].text
                if t.startswith(text) or (i == len(blocks) - 1 and text.startswith(t)):
                    got, offset = i, len(text) + 1
                    break
            if got >= 0:
                break
        if got >= 0:
            at = got
        else:
            offset = 1 << 30
        out.append(got)
    return out


class Page:
    """The non-blank lines of a capture's visible text and, where the markup shows them, their leaves."""

    __slots__ = ("numbers", "raw", "lines", "leaf", "leaves", "title", "blank_before")

    def __init__(self, visible: str, raw_html: str | None, rendered_html: str | None):
        self.numbers, self.raw, self.lines, self.blank_before = [], [], [], []
        blank = True
        for i, line in enumerate(visible.split("\n"), 1):
            text = " ".join(line.split())
            if text:
                self.numbers.append(i)
                self.raw.append(line)
                self.lines.append(text)
                self.blank_before.append(blank)
            blank = not text
        self.leaves, self.title, self.leaf = [], "", [-1] * len(self.lines)
        best = 0
        for markup in (rendered_html, raw_html):
            if markup:
                found, title = leaves(markup)
                self.title = self.title or title
                places = matched(self.lines, found)
                hits = sum(p >= 0 for p in places)
                if hits > best:
                    best, self.leaves, self.leaf = hits, found, places
                if 2 * best >= len(self.lines):
                    break


def container_kinds(page: Page) -> dict[int, tuple[bool, bool]]:
    """For each container whether it holds text elements (paragraphs, items, headings) and whether it holds controls."""
    kinds: dict[int, list[bool]] = {}
    for b in page.leaves:
        k = kinds.setdefault(b.container, [False, False])
        k[0] |= b.tag in TEXTUAL
        k[1] |= b.tag in CONTROLS
    return {c: (a, b) for c, (a, b) in kinds.items()}
