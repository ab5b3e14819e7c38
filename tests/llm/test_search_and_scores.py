"""Nearest neighbours, token counts, licences, quality ranking and HTML extraction against plain versions."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, corpus, frame
from threadloom.llm.ann import search
from threadloom.llm.hilbert import hilbert_keys
from threadloom.llm.html_extract import extract
from threadloom.llm.html_pages import blocks
from threadloom.llm.license_scan import LINES, PROSE, TEMPLATES, WINDOW_TERMS, license_scan
from threadloom.llm.license_texts import TEXTS
from threadloom.llm.quality_ranker import fit, rank_quality
from threadloom.llm.token_counts import head_body_tail, token_counts
from threadloom.llm.wrappers import Wrapper

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# nearest neighbours


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def nearest(rows, own, k):
    usable = {i: v for i, v in rows.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    far = sorted((float(np.sqrt(((np.array(usable[own]) - np.array(v)) ** 2).sum())), i) for i, v in usable.items() if i != own)
    return [i for _, i in far[:k]]


def test_search_small_table_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = {i: [float(x) for x in rng.normal(size=6)] for i in range(150)}
    for i in range(60, 90):
        rows[i] = rows[0]  # a group of copies larger than k
    rows |= {200: None, 300: [0.0] * 6, 400: [1.0] * 5 + [None], 500: [1.0] * 5 + [float("nan")], 600: [1.0] * 5 + [float("inf")], 700: [1.0] * 3}
    table = [*rows.items(), (100, rows[100]), (None, rows[1])]
    got = search(spark.createDataFrame(table, "vec_id long, vector array<double>").repartition(3), F.col("vec_id") % 20 == 0, k=5).collect()
    plain = {i: v for i, v in rows.items() if i != 700}
    for own in (0, 20, 40, 60, 80, 100, 120, 140):
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == own)
        assert [i for _, i in mine] == nearest(plain, own, 5)
    assert {r.query_id for r in got} == {0, 20, 40, 60, 80, 100, 120, 140}


def test_search_recall_on_isotropic_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = search(spark.createDataFrame(rows, "vec_id long, vector array<double>"), F.col("vec_id") % 100 == 0, least=100).collect()
    hits = 0
    for own in range(0, 4000, 100):
        far = ((x - x[own]) ** 2).sum(1)
        far[own] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == own} & set(np.argsort(far)[:10].tolist()))
    assert hits >= 0.9 * 400


def crowded(kind):
    """2,400 vectors of which some crowd: a third within 1e-5 of a point, one far off all, or a third near copies of a few."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2400, 32))
    if kind == "tight third":
        x[::3] = x[1] + 1e-5 * rng.normal(size=x[::3].shape)
    elif kind == "outlier":
        x[7] *= 1e6
    else:
        x[::3] = x[rng.integers(1, 9, 800)] + 1e-7 * rng.normal(size=x[::3].shape)
    return x


@pytest.mark.parametrize("kind", ["tight third", "outlier", "near copies"])
def test_search_recall_where_vectors_crowd(spark, kind):
    x = crowded(kind)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = search(spark.createDataFrame(rows, "vec_id long, vector array<double>"), F.col("vec_id") % 60 < 2, least=60).collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
    hits = collections.Counter()
    for own in (i for i in range(2400) if i % 60 < 2):
        far = ((x - x[own]) ** 2).sum(1)
        far[own] = np.inf
        hits[own % 3 == 0] += len(found[own] & set(np.argsort(far)[:10].tolist()))
    assert min(hits[True], hits[False]) >= 0.9 * 400, hits  # as many queries in the crowd as outside


def test_search_empty_and_single(spark):
    schema = "vec_id long, vector array<float>"
    assert search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert search(spark.createDataFrame([(1, [1.0])], schema), F.lit(True)).count() == 0


# token counts


@pytest.mark.parametrize("rule", ["start", "majority", "split"])
def test_token_counts_match_single_tokens(spark, rule):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(rule)
    rows = []
    for i, text in enumerate([*corpus(5, 12), "naïve 数据 ééé\n\n\n  x", "", None, "a" * 5000]):
        n = len(text or "")
        cuts = sorted(rng.randrange(n + 1) for _ in range(4)) if n else [0, 0, 0, 0]
        rows.append((i, text, [("x", cuts[0], cuts[1]), ("y", cuts[1], cuts[2]), ("x", cuts[3], n + 5), ("z", None, 3)]))
    rows.append((99, "no sections", None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<name:string,start:int,end:int>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts(docs, RANKS, PATTERN, rule).collect()}
    for i, text, sections in rows:
        text = text or ""
        of_byte, of_cell, names, before = [], [], [], ()
        for k, c in enumerate(text):
            at = next((j for j, s in enumerate(sections or []) if s[1] is not None and s[1] <= k < s[2]), None)
            names += [sections[at][0] if at is not None else None] if at != before else []
            before = at
            of_byte += [names[-1]] * len(c.encode())
            of_cell += [len(names) - 1] * len(c.encode())
        want, at = {}, 0
        for t in enc.encode_ordinary(text):
            size = len(enc.decode_single_token_bytes(t))
            held, cells = of_byte[at : at + size], of_cell[at : at + size]
            at += size
            if rule == "start":
                want[held[0]] = want.get(held[0], 0) + 1
            elif rule == "split":
                for h in held:
                    want[h] = want.get(h, 0) + 1 / size
            else:  # by interval, so two intervals of one name count apart; ties to the earlier
                most = max(sorted(set(cells)), key=cells.count)
                want[names[most]] = want.get(names[most], 0) + 1
        assert {s for d, s in got if d == i} >= {s[0] for s in sections or []}
        mine = {s: v for (d, s), v in got.items() if d == i and v}
        assert mine.keys() == want.keys() and all(abs(mine[s] - want[s]) < 1e-6 for s in want)
    assert token_counts(docs.limit(0), RANKS, PATTERN, rule).count() == 0


def test_head_body_tail_cover_text(spark):
    rows = [r[:2] for r in awkward(corpus(3, 8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", head_body_tail(F.col("text")).alias("sections"))
    for r in docs.collect():
        if r.text is not None:
            parts = [r.text[s.start : s.end] for s in r.sections]
            assert "".join(parts) == r.text
            assert parts[0].rstrip("\n") == r.text.split("\n")[0]
    counts = token_counts(docs, RANKS, PATTERN)
    assert counts.where("section IS NULL").count() == 0 and counts.select("doc_id").distinct().count() == len({r[0] for r in rows})


# licences


def test_license_inheritance(spark):
    filler = "this tool of the shop is under the hill and for a version of it"
    rows = [
        ("p/LICENSE", "x\nReleased under the MIT License.\n", "k", "u"), ("p/a.py", filler, "k", "u"), ("p/q/b.py", "# Licensed under the Apache License, Version 2.0\n" + filler, "k", "u"),
        ("p/q/c.py", filler, "k", "u"), ("p/q/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3.", "k", "u"), ("p/q/r/d.py", None, "k", "u"),
        ("z/e.py", "", "k", "u"), (None, filler, "k", "u"), ("p/a.py", filler, "k", "u"), ("root.py", filler, "k", "u"),
        ("y/long.py", filler * 30 + " Released under the MIT License.", "k", "u"),
    ]
    rows += [(f"w/{i}.txt", filler + f" {i}", "k", "u") for i in range(20)]
    got = license_scan(spark.createDataFrame(rows, "path string, text string, license string, own string")).collect()
    found = {r.path: (r.license, r.how, r.license_path) for r in got}
    assert len(got) == len(rows) and all(r.own == "u" for r in got)
    assert found["p/LICENSE"] == ("MIT", "own", "p/LICENSE") and found["p/a.py"] == ("MIT", "inherited", "p/LICENSE")
    assert found["p/q/b.py"] == ("Apache-2.0", "own", "p/q/b.py") and found["p/q/c.py"] == ("GPL-3.0", "inherited", "p/q/LICENSE.txt")
    assert found["p/q/r/d.py"] == ("GPL-3.0", "inherited", "p/q/LICENSE.txt")
    assert found["z/e.py"] == found[None] == found["root.py"] == found["y/long.py"] == found["w/3.txt"] == (None, None, None)


def test_license_common_header_and_windows(spark):
    """A third of the files share one header; others wrap theirs, stand without a path or come twice."""
    filler = "this tool of the shop is under the hill and for a version of it"
    header = "# Licensed under the Apache License, Version 2.0"
    rows = [(f"a/{i}.py", f"{header}\n{filler} {i}") for i in range(20)] + [(f"b/{i}.py", f"{filler} {i}") for i in range(40)]
    rows += [("h/LICENSE", header), ("h/x.py", filler), ("w/wrapped.py", "// This work is licensed under the GNU\n// General Public\n//\n// License, version 3\n" + filler)]
    rows += [("l/COPYING", "\n\n".join("Redistribution and use in source and binary forms, with or without modification, are permitted".split(" "))), ("l/m/n.py", filler)]
    rows += [(None, header + "\n" + filler), (None, filler), rows[0], rows[0], ("b/de.txt", "mit")]
    got = license_scan(spark.createDataFrame(rows, "path string, text string").repartition(3)).collect()
    found = {(r.path, (r.text or "")[:3] == "# L"): (r.license, r.how, r.license_path) for r in got}
    assert len(got) == len(rows) and all(found[f"a/{i}.py", True] == ("Apache-2.0", "own", f"a/{i}.py") for i in range(20))
    assert all(r.cosine == 1 for r in got if (r.text or "").startswith(header)) and all(r.license is None for r in got if (r.path or "").startswith("b/"))
    assert found["h/x.py", False] == ("Apache-2.0", "inherited", "h/LICENSE") and found["w/wrapped.py", False] == ("GPL-3.0", "own", "w/wrapped.py")
    assert found["l/m/n.py", False] == ("BSD-3-Clause", "inherited", "l/COPYING")
    assert found[None, True][:2] == ("Apache-2.0", "own") and found[None, False] == (None, None, None)


def plain_cosines(phrase, templates):
    """license -> cosine of one phrase with each template, by dictionaries."""
    terms = lambda text: [t.strip(".") for t in re.split(r"[^a-z0-9.]+", text.lower()) if t.strip(".")]
    n, df = len(templates), collections.Counter(t for _, p in templates for t in set(terms(p)))
    weight = lambda t: 1.0 if t in PROSE else math.log((1 + n) / (1 + df[t])) + 1
    own = collections.Counter(terms(phrase))
    mine = {t: k * (weight(t) if df[t] else math.log(1 + n) + 1) for t, k in own.items()}
    # terms that no template has are each a term of its own in the length
    length = math.sqrt(sum(v * v for t, v in mine.items() if df[t]) + sum(k for t, k in own.items() if not df[t]) * (math.log(1 + n) + 1) ** 2)
    out = {}
    for name, p in templates:
        other = {t: k * weight(t) for t, k in collections.Counter(terms(p)).items()}
        shared = [t for t in other if t in mine]
        if len(shared) > 1:
            cosine = sum(other[t] * mine[t] for t in shared) / length / math.sqrt(sum(v * v for v in other.values()))
            out[name] = max(out.get(name, 0), round(cosine, 6))
    return out


def plain_license(text, licence_file):
    lines = [x for x in text.split("\n") if re.search("[A-Za-z0-9]", x)]
    short = lambda part: len(re.findall(r"[a-z0-9.]*[a-z0-9][a-z0-9.]*", "\n".join(part).lower())) <= WINDOW_TERMS
    parts = lines + ["\n".join(lines[i : i + k]) for i in range(len(lines)) for k in range(2, LINES + 1) if i + k <= len(lines) and short(lines[i : i + k])]
    found = [c for p in parts + [text] * licence_file for c in plain_cosines(p, TEMPLATES).items()] + [c for p in [text] * licence_file for c in plain_cosines(p, TEXTS).items()]
    return min(((-c, name) for name, c in found if c >= 0.6), default=(None, None))[::-1]


def test_license_matches_plain_cosines(spark):
    """Headers whole, cut, wrapped and mixed with other words; licence files with whole texts; every row against all templates."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        words = " ".join(rng.choice([*TEMPLATES])[1] for _ in range(rng.randrange(1, 3))).split(" ")
        words = [w for w in words if rng.random() < 0.85] + [rng.choice(["the", "hill", "of", "version", "shop"]) for _ in range(rng.randrange(4))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n"]) for w in words) + "\nthis is a file of the shop"
        rows.append((f"d{i}/{'LICENSE' if i % 4 == 0 else 'x.py'}", text))
    rows += [(f"t{i}/COPYING", f"Copyright 2020 Jo Doe\n\n{text[: len(text) if i % 2 else len(text) * 3 // 4]}") for i, (_, text) in enumerate(TEXTS)]
    rows += [rows[0], rows[-1], rows[-1]]
    got = license_scan(spark.createDataFrame(rows, "path string, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        name, far = plain_license(r.text, "x.py" not in r.path)
        assert (r.license, r.cosine if r.license is None else round(r.cosine, 5)) == (name, None if far is None else round(-far, 5)), r.path
    assert [next(r.license for r in got if r.path == f"t{i}/COPYING") for i in range(len(TEXTS))] == [name for name, _ in TEXTS]


def test_license_empty(spark):
    assert license_scan(spark.createDataFrame([], "path string, text string")).count() == 0


# quality ranking


def test_pairwise_fit_orders_by_signal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    label = (x[:, 1] + 0.1 * rng.normal(size=500) > 0).astype(int)
    weights, threshold = fit(x, label, pairs=5000)
    assert weights[1] > 5 * np.abs(weights[[0, 2]]).max() and abs(((x @ weights > threshold) == label).mean() - 1) < 0.1


def test_rank_quality(spark):
    rng = random.Random(2)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(60)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    rows = awkward([*good, *bad])
    docs = frame(spark, rows)
    labels = [(i, int(i < 60), 0) for i in range(120) if i % 4] + [(1, 0, 0), (None, 1, 0), (5000, 1, 0), (3, None, None)]
    got = rank_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.doc_id < 120 and r.held_out]
    assert min(r.score for r in held if r.doc_id < 60) > max(r.score for r in held if r.doc_id >= 60)
    none = rank_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5}


# html


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body class='has-sidebar'><nav><a href=/>home</a></nav><header>site</header><div id=content><h1>T%d</h1>"
    "<p>first &amp; %d &lt;b&gt;<br>line&nbsp;two<p>second <a href=x>linked %d</a> words here<ul><li>one %d<li>two</ul><script>var x='</p>';</script>"
    "<div class='ad'>buy</div><!-- <p>no</p> --></div><div class=comments><p>me %d</p></div><aside>side</aside><form>q<input></form><footer>(c)</footer></body></html>"
)


def test_wrapper_expression_and_merge():
    pages = [PAGE.replace("%d", str(i)) for i in range(8)]
    whole, left, right = Wrapper(), Wrapper(), Wrapper()
    for k, p in enumerate(pages):
        whole.add(list(blocks(p)))
        (left if k < 3 else right).add(list(blocks(p)))
    assert left.merge(right).content() == whole.content() and left.expression() == whole.expression()
    some = Wrapper()
    for p in ["<div><p>a<ul><li>x</ul><p>b<ul><li>y</ul></div>", "<div><p>c</div>", "<div><h2>t</h2><p>d</div>"]:
        some.add(list(blocks(p)))
    assert some.expression() == "div(h2(#)?{p(#)ul(li(#))?}+)"


def test_extract(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.replace("%d", str(i))) for i in range(8)]
    rows += [(10, "http://b.example:80/x", "<article><p>only &#233; para</article>"), (11, None, "plain text"), (12, "::", ""), (13, "http://c.example/", None), (14, "http://a.example/y", PAGE[:-200])]
    rows += [rows[0], (15, "http://d.example/", "<div>" * 3000 + "<p>deep</p>"), (16, "http://e.example", "<p>" + "word " * 50_000)]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))).collect()}
    assert got[3].text == "T3\nfirst & 3 <b> line two\nsecond linked 3 words here\none 3\ntwo"
    assert got[10].text == "only é para" and got[11].text == "plain text" and got[12].text == got[13].text == "" and got[15].text == "deep"
    assert got[14].text.startswith("T%d\nfirst") and all(r.n_chars == len(r.text) for r in got.values()) and got[16].n_chars == 249_999
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_extract_tells_optional_containers_by_alignment(spark):
    """No name tells the visitors' texts from the article: only that some pages lack them, however long they are."""
    article = "<div class=zq><p>story {0} begins in this way</p><p>story {0} ends in that way</p></div>"
    said = "<div class=xk><p>visitor {0} says quite a lot here and goes on and on for long</p><p>visitor {0} adds some more, long as well</p></div>"
    pages = [("http://h.example/%d" % i, "<body>" + article.format(i) + (said.format(i) if i % 2 else "") + "</body>") for i in range(8)]
    assert extracted(spark, pages) == [f"story {i} begins in this way\nstory {i} ends in that way" for i in range(8)]


def test_extract_mixed_layouts(spark):
    pages = [(f"http://m.example/{i}", f"<body><article><p>first kind {i}</p></article></body>") for i in range(9)]
    pages += [(f"http://m.example/{i}", f"<body><div class=old><p>second kind {i}</p></div></body>") for i in range(2)]
    pages += [(f"http://n.example/{i}", f"<body><div class=new><p>{'long ' * 30}{i}</p></div></body>") for i in range(9)]
    pages += [("http://n.example/x", "<body><div class=old><p>rare kind</p></div></body>")]
    pages += [(None, "<article><p>no url</p></article>"), (None, "<div><p>no url either</p></div>")]
    got = extracted(spark, pages)
    assert got[8:11] == ["first kind 8", "second kind 0", "second kind 1"] and got[20:] == ["rare kind", "no url", "no url either"]
    assert got[11] == "long " * 30 + "0"


@pytest.mark.parametrize("copies", [4, 6])
def test_extract_repeated_pages(spark, copies):
    page = "<body><div class=c><h1>Title</h1><p>the one paragraph</p></div></body>"
    assert extracted(spark, [(f"http://r.example/{i}", page) for i in range(copies)]) == ["Title\nthe one paragraph"] * copies


def drawn_site(rng, host, layout, n):
    """(url, html, text) of pages of one layout: menus, notices, adverts, related links, readers' comments and a footer about an article."""
    words = lambda k: " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(500)}" for _ in range(k))
    out = []
    for i in range(n):
        title, paragraphs = words(6), [words(rng.randrange(8, 60)) for _ in range(rng.randrange(2, 9))]
        links = "".join(f"<li><a href=/{k}>{words(2)}</a></li>" for k in range(8))
        said = "".join(f"<div class={layout['said']}><b>{words(1)}</b><p>{words(rng.randrange(5, 30))}</p></div>" for _ in range(rng.randrange(4)))
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        tag = layout["tag"]
        html = (
            f"<html><head><title>{title} | {host}</title></head><body><div class={layout['top']}><ul>{links}</ul></div><div class={layout['ad']}>buy {words(3)} now</div>"
            f"<{tag}>{body}</{tag.split(' ')[0]}>" + (f"<div class={layout['more']}>{said}</div>" if said else "") + f"<div class={layout['end']}>about us, terms, {host} since 1999</div></body></html>"
        )
        out.append((f"http://{host}/{i}", html, "\n".join([title, *paragraphs])))
    return out


def test_extract_precision_and_recall(spark):
    """By words over five layouts, two of which name nothing; the README states these figures."""
    rng = random.Random(7)
    named = {"top": "nav", "ad": "advert", "more": "comments", "said": "comment", "end": "footer"}
    blank = {"top": "a1x", "ad": "qqb", "more": "zzv", "said": "kkw", "end": "ttu"}
    layouts = [{"tag": "article", **named}, {"tag": "main", **blank}, {"tag": "div class=post", **named}, {"tag": "div class=xyzzy", **blank}, {"tag": "div id=content", **blank}]
    pages = [p for k, layout in enumerate(layouts) for p in drawn_site(rng, f"site{k}.example", layout, 30)]
    got = extracted(spark, [p[:2] for p in pages])
    right = sum((collections.Counter(g.split()) & collections.Counter(w.split())).total() for g, (_, _, w) in zip(got, pages))
    precision, recall = right / sum(len(g.split()) for g in got), right / sum(len(w.split()) for _, _, w in pages)
    print("precision", round(precision, 4), "recall", round(recall, 4))
    assert precision > 0.95 and recall > 0.99


@pytest.mark.parametrize("page", ["<div>x" * 30_000, '<a href="x ' * 30_000 + "<p>end", '<p title=">' * 30_001 + "end", "<section><div>" * 20_000 + "<p>end" + "</b></p>" * 20_000])
def test_blocks_of_odd_markup_take_time_in_proportion(page):
    import time

    began = time.process_time()
    list(blocks(page))
    assert time.process_time() - began < 5
