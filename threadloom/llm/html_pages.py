"""Reading one HTML page: tags, entity-decoded text blocks, and the element path of each block."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

# Element kinds of HTML.
RAW = {"script", "style", "textarea", "noscript", "iframe", "template", "title", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "nav", "aside", "blockquote", "td", "th"}

NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: elements deeper than this count as the element at this depth, so that a page's paths stay in proportion to it
DEEPEST = 64


class Block(NamedTuple):
    path: tuple  # element keys from the outside in
    text: str
    linked: int  # characters inside links


def element_key(tag: str, attributes: str) -> str:
    """Tag with the letters-only parts of its class, id and role, so that numbering doesn't tell elements apart."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag
    parts = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                parts.add("hidden")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                parts.add("hidden")
        else:
            for word in value.split():
                if not any(c.isdigit() for c in word):
                    parts.update(p.lower() for p in NAME_PART.findall(word))
                else:
                    parts.update(p.lower() for p in NAME_PART.findall(re.sub(r"\d+\w*", " ", word)) if len(p) > 1)
    return tag + "".join("." + p for p in sorted(parts))


class Tags:
    """The markup of one page in order, found in one pass whatever quotes or brackets are unbalanced."""

    def __init__(self, page: str):
        self.page = page
        #: where to go on
        self.at = 0
        #: behind these there is no further one to look for
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.last |= {end: page.rfind(end) for end in ("-->", "]]>")}

    def until(self, end: str, at: int) -> int:
        """Behind the next ``end``, or the end of the page."""
        return self.page.index(end, at) + len(end) if self.last[end] >= at else len(self.page)

    def tag_end(self, at: int) -> int:
        """The index of the ``>`` that ends the tag whose name stands before ``at``, quoted ones apart; -1 if there is none."""
        page, start = self.page, at
        while at < len(page):
            at = PLAIN.match(page, at).end()
            if at == len(page):
                break
            if page[at] == ">":
                return at
            at = page.index(page[at], at + 1) + 1 if self.last[page[at]] > at else at + 1
        return page.index(">", start) if self.last[">"] >= start else -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name or "!" or "[", whether it closes, attributes) of each tag, comment ("!") and CDATA section ("[")."""
        page = self.page
        while (start := page.find("<", self.at)) >= 0:
            m = NAME.match(page, start + 1)
            if m:
                end = self.tag_end(m.end())
                if end < 0:
                    return
                self.at = end + 1
                yield start, self.at, m[1].lower(), page[start + 1] == "/", page[m.end() : end]
            elif page.startswith("<!--", start):
                self.at = self.until("-->", start + 4)
                yield start, self.at, "!", False, ""
            elif page.startswith("<![CDATA[", start):
                self.at = self.until("]]>", start + 9)
                yield start, self.at, "[", False, page[start + 9 : self.at].removesuffix("]]>")
            elif page.startswith(("<!", "<?"), start):
                self.at = self.until(">", start)
                yield start, self.at, "!", False, ""
            else:
                self.at = start + 1


def raw_end(page: str, tag: str, at: int) -> int:
    """Behind the end tag of an element whose content is no markup."""
    end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    return end.end() if end else len(page)


def walk(page: str) -> Iterator[tuple[str, tuple, str, bool]]:
    """("open", path, "", False) for each block element and ("text", path, text, in_link) for each run of text."""
    stack: list[tuple[str, tuple]] = [("", ())]
    opened: Counter = Counter()
    links, at, n = 0, 0, len(page)

    def close(k: int) -> None:
        opened.subtract(tag for tag, _ in stack[k:])
        del stack[k:]

    tags = Tags(page)
    for start, end, tag, closes, attributes in tags:
        if start > at:
            yield "text", stack[-1][1], page[at:start], links > 0
        at = end
        if tag in "![":
            if tag == "[":
                yield "text", stack[-1][1], html.escape(attributes), links > 0
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closes else 1
            continue
        if tag in VOID:
            yield "text", stack[-1][1], " ", False
            if tag == "hr":
                yield "open", stack[-1][1], "", False
            continue
        if closes:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    links = 0
                    break
                if tag not in SCOPES and stack[k][0] in SCOPES:
                    break
            yield "open", stack[-1][1], "", False
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                tags.at = at = raw_end(page, tag, at)
            continue
        links = 0
        if stack[-1][0] == "p":
            close(len(stack) - 1)
        ends = CLOSES.get(tag)
        if ends and any(opened[t] for t in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in SCOPES and stack[k][0] not in ends:
                    break
        path = stack[-1][1] if len(stack[-1][1]) >= DEEPEST else (*stack[-1][1], element_key(tag, attributes))
        stack.append((tag, path))
        opened[tag] += 1
        yield "open", path, "", False
    if at < n:
        yield "text", stack[-1][1], page[at:], links > 0


def blocks(page: str) -> Iterator[Block]:
    """The text blocks of a page in order: white space as one space, character references decoded."""
    path, parts, linked = (), [], 0
    for kind, at, text, in_link in walk(page):
        if kind == "open" or at != path:
            text_of = " ".join(html.unescape("".join(parts)).split()) if parts else ""
            if text_of:
                yield Block(path, text_of, min(linked, len(text_of)))
            path, parts, linked = at, [], 0
        if kind == "text":
            parts.append(text)
            if in_link:
                linked += len(text)
    text_of = " ".join(html.unescape("".join(parts)).split()) if parts else ""
    if text_of:
        yield Block(path, text_of, min(linked, len(text_of)))
