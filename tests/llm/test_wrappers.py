"""The inference against a plain version with lists and pairs, and its cost on pages with many siblings."""

import random
import time
import tracemalloc
from itertools import combinations

from threadloom.llm.html_pages import Block
from threadloom.llm.wrappers import OPTIONAL, SINGLE, TEMPLATE_PAGES, Order, Wrapper, container, in_article


class Plain:
    """Everything of all pages kept: orders as lists, pairs of siblings as a set."""

    def __init__(self, pages):
        self.children, self.seen, self.repeated, self.pairs, self.groups, self.slots = {}, {(): 0}, set(), {}, {}, {}
        for page in pages:
            self.add(page)

    def add(self, page):
        self.seen[()] += 1
        streams = {}
        for b in page:
            for d in range(len(b.path)):
                own = streams.setdefault(b.path[:d], [])
                if not own or own[-1] != b.path[d]:
                    own.append(b.path[d])
        for path, keys in streams.items():
            self.align(path, keys)
            for key in set(keys):
                self.seen[(*path, key)] = self.seen.get((*path, key), 0) + 1
            self.pairs.setdefault(path, set()).update(frozenset(p) for p in combinations({k for k in keys if container(k)}, 2))
        for k, b in enumerate(page):
            if k and b.path and page[k - 1].path == b.path:
                self.repeated.add(b.path)
            self.slots.setdefault(b.path, []).append((tuple((x.path, x.text) for x in page), b.text, b.linked))

    def align(self, path, keys):
        known, place = self.children.setdefault(path, []), -1
        for key in keys:
            if key in known:
                at = known.index(key)
                if at <= place:
                    self.groups.setdefault(path, set()).add((key, known[place]))
            else:
                at = place + 1
                known.insert(at, key)
            place = at

    def loose(self, path):
        parent, own = path[:-1], self.seen[path]
        if own == self.seen[parent]:
            return False
        apart = [k for k in self.children[parent] if k != path[-1] and container(k) and frozenset((k, path[-1])) not in self.pairs[parent]]
        return own + sum(self.seen[(*parent, k)] for k in apart) < self.seen[parent]

    def status(self):
        out = {}
        for path, texts in self.slots.items():
            firm = not any(container(path[k - 1]) and self.loose(path[:k]) for k in range(1, len(path) + 1))
            order = self.children.get(path[:-1], [])
            grouped = path in self.repeated or any(order.index(a) <= order.index(path[-1]) <= order.index(b) for a, b in self.groups.get(path[:-1], ()))
            pages = {p for p, _, _ in texts}
            chars = sum(len(t) for _, t, _ in texts)
            mean = chars / sum(any(b == path for b, _ in p) for p in self.each)
            constant = len({t for _, t, _ in texts}) == 1 and len(pages) >= TEMPLATE_PAGES and not in_article(path)
            out[path] = (mean, mean * (1 if firm else OPTIONAL) * (1 if path and grouped else SINGLE), firm, constant, sum(x for _, _, x in texts) > 0.6 * chars)
        return out


def drawn(rng, keys):
    page = []
    for _ in range(rng.randrange(1, 9)):
        path = ("html", "body", *(rng.choice(keys) for _ in range(rng.randrange(0, 4))), rng.choice(["p", "h2", "li"]))
        text = rng.choice(["fixed", f"text {rng.randrange(99)}"])
        page.append(Block(path, text, rng.choice([0, 0, len(text)])))
    return page


def test_status_as_a_plain_version_gives_it_in_any_tree_of_merges(monkeypatch):
    rng = random.Random(12)
    for trial in range(150):
        monkeypatch.setattr("threadloom.llm.wrappers.Together.FEW", rng.choice([1, 3, 256]))
        keys = ["div.a", "div.b", "div.c", "section", "article", "td", "span"][: rng.randrange(2, 8)]
        pages = [drawn(rng, keys) for _ in range(rng.randrange(1, 12))]
        plain = Plain(pages)
        plain.each = [tuple((b.path, b.text) for b in p) for p in pages]
        wrapper = Wrapper()
        for page in pages:
            wrapper.add(page)
        assert {p: tuple(s) for p, s in wrapper.status().items()} == plain.status()
        assert {p: list(o) for p, o in wrapper.children.items()} == plain.children
        halves = [Wrapper(), Wrapper()]
        for k, page in enumerate(pages):
            halves[k % 2].add(page)
        merged = halves[0].merge(halves[1]).status()
        # the order of keys depends on the order of pages, and with it which groups are seen; the rest doesn't
        assert {p: (s.chars, s.firm, s.template, s.linked) for p, s in merged.items()} == {p: (s[0], *s[2:]) for p, s in plain.status().items()}


def test_order_keeps_places_when_labels_run_out():
    rng = random.Random(1)
    order, plain = Order(), []
    for k in range(600):
        behind = None if not plain else rng.choice([plain[0], plain[-1], plain[len(plain) // 2], None])
        order.put(str(k), behind)
        plain.insert(0 if behind is None else plain.index(behind) + 1, str(k))
    assert list(order) == plain == sorted(plain, key=order.labels.get)


def test_many_siblings_cost_in_proportion():
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda n, page: "div." + page + "".join(letters[n // 26**k % 26] for k in range(4))
    pages = [[Block(("html", "body", name(n, page), "p"), f"text {n}", 0) for n in range(10_000)] for page in "xyx"]
    tracemalloc.start()
    began = time.process_time()
    wrapper, other = Wrapper(), Wrapper()
    wrapper.add(pages[0])
    other.add(pages[1])
    other.add(pages[2])
    wrapper.merge(other)
    found = wrapper.status()
    took, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 20_000 and took < 10 and most < 150e6, (took, most)  # three pages under tracemalloc
