"""Wrappers: one union-free regular expression for each host, inferred from its pages.

An expression gives for each element path its child elements in order. Children that
are missing somewhere are optional; a child that comes again repeats, with all that
stood between (a repeated group); text is a slot. Pages align one after another, and
the expressions of two sets of pages align in the same way, so they merge in any tree.

A page's text is chosen by matching its paths with the expression. A slot whose text never
changes over ``TEMPLATE_PAGES`` different pages belongs to the template. Optional containers
count less than those that all pages have, unless they are alternatives (each page has one
of them), and slots that neither repeat nor stand in a repeated group less than those that
do. The descent from the page's root follows the heaviest container and leaves optional
containers beside one that all pages have. Element and class names are a further hint.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from hashlib import blake2b
from itertools import combinations
from typing import NamedTuple

from threadloom.llm.html_pages import Block

# Elements and name parts of page furniture, and containers that may hold an article.
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "head", "object", "canvas", "fieldset", "figcaption"}
FURNITURE_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "alert", "author", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "hidden", "login", "masthead", "menu", "meta", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notification", "pager", "pagination", "popup", "print", "promo", "promoted", "rail", "recommended", "related", "replies", "reply", "respond",
    "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar", "widget",
}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td"}
ARTICLE_TAGS = {"article", "main"}


#: different pages that must agree on a slot's text before it counts as template
TEMPLATE_PAGES = 5
#: what text in optional containers and text outside any repetition count
OPTIONAL, SINGLE = 0.3, 0.5


class Slot(NamedTuple):
    """A text slot's place in its host's expression."""

    chars: float  # mean of the pages that have it
    weight: float
    firm: bool  # in no optional container
    template: bool
    linked: bool


class Order:
    """Child keys in order. A key goes in behind another one in constant time: labels leave gaps and are dealt anew when one is used up."""

    GAP = 1 << 512

    def __init__(self):
        self.labels: dict[str, int] = {}
        self.after: dict[str | None, str | None] = {None: None}

    def put(self, key: str, behind: str | None) -> None:
        behind_label, following = self.labels.get(behind, 0), self.after[behind]
        label = behind_label + self.GAP if following is None else (behind_label + self.labels[following]) // 2
        if label == behind_label:
            for k, known in enumerate(self, 1):
                self.labels[known] = k * self.GAP
            return self.put(key, behind)
        self.labels[key] = label
        self.after[behind], self.after[key] = key, following

    def __iter__(self):
        key = self.after[None]
        while key is not None:
            yield key
            key = self.after[key]


class Together:
    """Which keys came together on a page: as pairs while there are few keys, else as the pages' sets, the same of which count once."""

    FEW = 256

    def __init__(self):
        self.keys: set[str] = set()
        self.pairs: set[tuple[str, str]] = set()
        self.sets: set[frozenset] = set()

    def add(self, keys: frozenset) -> None:
        self.keys |= keys
        if len(self.keys) <= self.FEW:
            self.pairs.update(combinations(sorted(keys), 2))
        else:
            self.sets.add(keys)

    def merge(self, other: "Together") -> None:
        self.keys |= other.keys
        self.pairs |= other.pairs
        self.sets |= other.sets

    def covered(self, among: dict[str, int]) -> dict[str, int]:
        """For each key the sum of ``among`` over the keys of it that never came with that key, the key left out."""
        beside: dict[str, set[str]] = {}
        for a, b in self.pairs:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
        within: dict[str, list[int]] = {}
        sets = list(self.sets)
        for k, one in enumerate(sets):
            for key in one:
                within.setdefault(key, []).append(k)
        total, out = sum(among.values()), {}
        shared: dict[tuple, tuple[frozenset, int]] = {}  # keys of the same sets have them in common
        for key, own in among.items():
            member = tuple(within.get(key, ()))
            if member not in shared:
                union = frozenset().union(*(sets[k] for k in member))
                shared[member] = union, sum(among.get(k, 0) for k in union)
            union, held = shared[member]
            more = sum(among.get(k, 0) for k in beside.get(key, ()) if k not in union and k != key)
            out[key] = total - held - more - (0 if key in union else own)
        return out


class Wrapper:
    """The expression of some pages and what its text slots held."""

    def __init__(self):
        self.pages = 0
        #: path -> child keys in order; path -> pages with it; paths that repeat; path -> child containers of one page
        self.children: dict[tuple, Order] = {}
        self.seen: Counter = Counter()
        self.repeated: set[tuple] = set()
        self.together: dict[tuple, Together] = {}
        self.groups: dict[tuple, dict[tuple[str, str], None]] = {}
        #: path -> [pages, blocks, characters, linked characters, the one text or None if it varies, up to TEMPLATE_PAGES different pages with it]
        self.slots: dict[tuple, list] = {}

    def add(self, page: list[Block]) -> None:
        """Aligns one page's stream of blocks."""
        self.pages += 1
        seen: dict[tuple, list[str]] = {}
        digest = blake2b(digest_size=8)
        for block in page:
            digest.update(f"{'>'.join(block.path)}\n{block.text}\n".encode("utf-8", "replace"))
            for depth in range(len(block.path)):
                own = seen.setdefault(block.path[:depth], [])
                if not own or own[-1] != block.path[depth]:
                    own.append(block.path[depth])
        own_page = digest.digest()
        self.seen[()] += 1
        for path, keys in seen.items():
            self._align(path, keys)
            present = set(keys)
            self.seen.update((*path, key) for key in present)
            holders = frozenset(key for key in present if container(key))
            if len(holders) > 1:
                self.together.setdefault(path, Together()).add(holders)
        last: Counter = Counter()
        before: tuple | None = None
        for block in page:
            if block.path and block.path == before:
                self.repeated.add(block.path)
            before = block.path
            slot = self.slots.setdefault(block.path, [0, 0, 0, 0, block.text, set()])
            slot[0] += not last[block.path]
            last[block.path] += 1
            slot[1] += 1
            slot[2] += len(block.text)
            slot[3] += block.linked
            if slot[4] != block.text:
                slot[4] = None
                slot[5] = set()
            elif len(slot[5]) < TEMPLATE_PAGES:
                slot[5].add(own_page)

    def _align(self, path: tuple, keys: Iterable[str]) -> None:
        known = self.children.setdefault(path, Order())
        place: str | None = None
        for key in keys:
            if key not in known.labels:
                known.put(key, place)
            elif place is not None and known.labels[key] <= known.labels[place]:  # comes again: all from here to the last place repeats
                self.groups.setdefault(path, {})[key, place] = None
            place = key

    def merge(self, other: "Wrapper") -> "Wrapper":
        for path, keys in other.children.items():
            self._align(path, keys)
        self.seen.update(other.seen)
        self.repeated |= other.repeated
        for path, together in other.together.items():
            self.together.setdefault(path, Together()).merge(together)
        for path, groups in other.groups.items():
            self.groups.setdefault(path, {}).update(groups)
        for path, slot in other.slots.items():
            mine = self.slots.get(path)
            if mine is None:
                self.slots[path] = [*slot[:5], set(slot[5])]
            else:
                for k in range(4):
                    mine[k] += slot[k]
                if mine[4] != slot[4]:
                    mine[4] = None
                mine[5] = set(sorted(mine[5] | slot[5])[:TEMPLATE_PAGES]) if mine[4] is not None else set()
        self.pages += other.pages
        return self

    def optional(self, path: tuple) -> bool:
        return self.seen[path] < self.seen[path[:-1]]

    def expression(self, path: tuple = ()) -> str:
        """The inferred expression as text: ``?`` optional, ``+`` or ``{...}+`` repeated, ``#`` a text slot."""
        out = "#" if path in self.slots else ""
        ends = Counter(b for _, b in self.groups.get(path, ()))
        starts = Counter(a for a, _ in self.groups.get(path, ()))
        for key in self.children.get(path, ()):
            inner = f"{key}({self.expression((*path, key))})"
            repeated, own = (*path, key) in self.repeated, bool(starts[key] and ends[key])
            out += "{" * starts[key] + inner + "+" * (repeated and not own) + "?" * self.optional((*path, key)) + "}+" * ends[key]
        return out

    def _loose(self, path: tuple, apart: dict[tuple, dict[str, int]]) -> bool:
        """Whether the container ``path`` is optional and no alternative: it and the siblings never seen with it don't cover all pages."""
        if not self.optional(path):
            return False
        parent, key = path[:-1], path[-1]
        if parent not in apart:
            apart[parent] = self.together.get(parent, Together()).covered({k: self.seen[(*parent, k)] for k in self.children[parent] if container(k)})
        return self.seen[path] + apart[parent][key] < self.seen[parent]

    def _grouped(self, path: tuple) -> bool:
        """Whether ``path`` repeats or stands in a repeated group of its parent."""
        if path in self.repeated:
            return True
        groups = self.groups.get(path[:-1])
        labels = self.children[path[:-1]].labels if groups else {}
        return any(labels[a] <= labels[path[-1]] <= labels[b] for a, b in groups or ())

    def status(self) -> dict[tuple, Slot]:
        """What the expression tells of each slot."""
        loose: dict[tuple, bool] = {(): False}
        apart: dict[tuple, dict[str, int]] = {}
        out = {}
        for path, (pages, _, chars, linked, constant, different) in self.slots.items():
            for k in range(1, len(path) + 1):
                if path[:k] not in loose:
                    loose[path[:k]] = loose[path[: k - 1]] or container(path[k - 1]) and self._loose(path[:k], apart)
            mean, firm = chars / pages, not loose[path]
            weight = mean * (1 if firm else OPTIONAL) * (1 if path and self._grouped(path) else SINGLE)
            template = constant is not None and len(different) >= TEMPLATE_PAGES and not in_article(path)
            out[path] = Slot(mean, weight, firm, template, linked > 0.6 * chars)
        return out

    def content(self, paths: Iterable[tuple] | None = None) -> set[tuple]:
        """Those of ``paths`` (of all slots, if None) that hold the main text of a page with just these."""
        return choose(self.status(), self.slots if paths is None else paths)


def choose(slots: dict[tuple, Slot], paths: Iterable[tuple]) -> set[tuple]:
    """The paths of one page that hold its main text. Hints by names, then template text, give way where nothing else is left."""
    paths = [p for p in paths if p in slots and not slots[p].linked]
    for named, template in ((furniture, True), (furniture_tag, True), (furniture_tag, False)):
        found = {p: slots[p] for p in paths if not (template and slots[p].template) and not any(named(key) for key in p)}
        if found:
            return descend(found)
    return set()


def descend(open_: dict[tuple, Slot]) -> set[tuple]:
    inside = {p for p in open_ if in_article(p)}
    if any(open_[p].firm for p in inside) or sum(open_[p].weight for p in inside) > 0.3 * sum(s.weight for s in open_.values()):
        return inside
    depth = 0
    while True:
        weight: Counter = Counter()
        lean: Counter = Counter()
        for path, slot in open_.items():
            if len(path) > depth:
                weight[path[depth]] += slot.weight
                lean[path[depth]] += slot.chars if slot.firm else -slot.chars
        best = max(weight, key=lambda k: (weight[k], k), default=None)
        if best is None or not container(best):
            return set(open_)
        if lean[best] >= 0:
            open_ = {p: s for p, s in open_.items() if len(p) <= depth or p[depth] == best or lean[p[depth]] >= 0 or not container(p[depth])}
        if weight[best] < 0.7 * sum(s.weight for s in open_.values()):
            return set(open_)
        open_ = {p: s for p, s in open_.items() if len(p) > depth and p[depth] == best}
        depth += 1


def container(key: str) -> bool:
    return key.split(".")[0] in CONTAINERS


def in_article(path: tuple) -> bool:
    return any(key.split(".")[0] in ARTICLE_TAGS for key in path)


def furniture_tag(key: str) -> bool:
    return key.split(".")[0] in FURNITURE_TAGS


def furniture(key: str) -> bool:
    tag, *names = key.split(".")
    if tag in ("html", "body", *ARTICLE_TAGS):
        return False
    return tag in FURNITURE_TAGS or tag == "header" or not FURNITURE_NAMES.isdisjoint(names)
