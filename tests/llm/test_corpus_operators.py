"""Quality rules, line dedup, Jaccard join, mixing, packing and the pipeline against plain versions."""

import collections
import hashlib
import math
import pickle
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm.helpers import SCHEMA, WORD, awkward, corpus, frame, words
from threadloom.llm.jaccard_join import jaccard_join
from threadloom.llm.line_dedup import line_dedup
from threadloom.llm.mix_sources import mix_sources
from threadloom.llm.packing import WordIds, cuts, pack
from threadloom.llm.kneser_ney import ORDER, HashArrays, probabilities, stored
from threadloom.llm.quality_rules import quality_rules
from threadloom.session import BATCH_BYTES, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# quality rules


def plain_counts(text):
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def plain_perplexity(texts):
    """Interpolated modified Kneser-Ney over the code points of one language's texts, by dictionaries."""
    def grams(text):
        padded = (0,) * (ORDER - 1) + tuple(map(ord, text))
        return [padded[i : i + ORDER] for i in range(len(text))]

    counts = collections.Counter(g for t in texts for g in grams(t))
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, collections.Counter(g[1:] for g in levels[0]))
    prob = {(): 1 / (len(levels[0]) + 1)}
    for level in levels:
        of = [sum(v == i for v in level.values()) for i in (1, 2, 3, 4)]
        cut = [0.5] * 3
        if min(of[:3]) > 0:
            y = of[0] / (of[0] + 2 * of[1])
            cut = [min(max(i - (i + 1) * y * of[i] / of[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
        total, off = collections.Counter(), collections.Counter()
        for g, v in level.items():
            total[g[:-1]] += v
            off[g[:-1]] += cut[min(v, 3) - 1]
        prob = {g: (v - cut[min(v, 3) - 1]) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * prob[g[1:]] for g, v in level.items()}
    return [math.exp(-sum(math.log(prob[g]) for g in grams(t)) / len(t)) if t else None for t in texts]


def test_quality_rules_counts_and_perplexity(spark):
    rng = random.Random(3)
    rows = awkward(corpus(2, 20) + [" ".join(words(200, rng, 12)) for _ in range(6)])
    got = {(r.doc_id, r.text): r for r in quality_rules(frame(spark, rows)).collect()}
    texts = {lang: sorted({r[1] or "" for r in rows if r[2] == lang}) for lang in {r[2] for r in rows}}
    plain = {lang: dict(zip(own, plain_perplexity(own))) for lang, own in texts.items()}
    for row in rows:
        r, ppl = got[row[0], row[1]], plain[row[2]][row[1] or ""]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(row[1] or "")
        assert (ppl is None and r.perplexity is None) or abs(math.log(r.perplexity / ppl)) < 1e-3
        assert r.kept == (not r.base_failed and (ppl is None or r.low <= r.perplexity <= r.high))
        assert r.size == row[6]


def test_perplexity_band_rejects_only_the_odd_language_text(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice(("ba", "ne", "to", "ri")) for _ in range(3)) for _ in range(80)) for _ in range(60)]
    odd = " ".join("".join(rng.choice("XQ#|9%") for _ in range(6)) for _ in range(80))
    rows = [(i, t, "en", "a", 0, "", "", "", "") for i, t in enumerate([*texts, odd])]
    kept = {r.doc_id for r in quality_rules(frame(spark, rows)).where("kept").collect()}
    assert kept == set(range(60))


def test_copies_and_rare_languages_keep_their_band(spark):
    rng = random.Random(6)
    plain = lambda: " ".join("".join(rng.choice(("ba", "ne", "to", "ri", "lo")) for _ in range(rng.randrange(1, 4))) for _ in range(80))
    texts = [("en", plain()) for _ in range(60)]
    texts += [texts[0]] * 100 + [("xx", plain()), (None, plain())]
    rows = [(i, t, lang, "a", 0, "", "", "", "") for i, (lang, t) in enumerate(texts)]
    assert quality_rules(frame(spark, rows)).where("kept").count() == len(rows)


def test_kneser_ney_is_a_distribution_and_is_found_in_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("threadloom.llm.kneser_ney.FILE_ENTRIES", 150)
    rows = awkward(corpus(3, 12))
    found = probabilities(frame(spark, rows)).selectExpr("lang", "gram", "key", "p", "cast(ln(p) as float) log_p").persist()
    sums = found.groupBy("lang", found.gram.substr(1, ORDER - 1)).agg({"p": "sum"}).collect()
    assert max(r[2] for r in sums) <= 1 + 1e-9
    arrays = pickle.loads(pickle.dumps(stored(found.select("key", "log_p"), str(tmp_path))))
    want = {r.key: r.log_p for r in found.collect()}
    assert len(arrays.files) > 3
    keys = np.array([*want, 5], np.int64)
    assert np.allclose(arrays.find(keys)[:-1], np.array(list(want.values()), np.float32)) and arrays.find(keys)[-1] < -20
    assert isinstance(arrays, HashArrays)


def test_texts_go_to_python_in_small_batches_while_a_table_is_written(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": [batch.num_rows], "size": [batch.nbytes]})

    docs = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 4000) AS text")
    seen = written(docs.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in seen) == 3000 and max(r.size for r in seen) <= 1.1 * BATCH_BYTES
    assert spark.conf.get(key) == before


# line dedup


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_lines(rows, min_words):
    lines = {}
    for r in rows:
        for no, line in enumerate((r[1] or "").split("\n")):
            if WORD.search(line):
                lines[r[0], no] = line
    order = sorted(lines)
    gone = {}
    for i, at in enumerate(order):
        w = WORD.findall(lines[at])
        for before in order[:i]:
            if lines[before] == lines[at]:
                gone[at] = "exact"
                break
            v = WORD.findall(lines[before])
            if len(w) >= min_words and len(v) >= min_words and one_edit(w, v):
                gone.setdefault(at, "near")
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_matches_all_pairs(spark, seed):
    rows = [r for r in awkward(corpus(seed, 40)) if r[1] is None or len(r[1]) < 10_000]
    got = line_dedup(frame(spark, rows), min_words=5).collect()
    gone = plain_lines(rows, 5)
    assert sum(v == "near" for v in gone.values()) > 3
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if text[r.doc_id] is None:
            assert r.text is None and r.n_lines == 0
            continue
        lines = text[r.doc_id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if (r.doc_id, k) not in gone)
        assert (r.n_lines, r.n_exact + r.n_near) == (len(lines), sum(d == r.doc_id for d, _ in gone))
        assert r.n_near == sum(v == "near" for (d, _), v in gone.items() if d == r.doc_id)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("min_words", [1, 2, 6])
def test_line_dedup_by_any_white_space(spark, min_words):
    rng = random.Random(min_words)
    gaps = [" ", " ", "  ", "\t", " \r", "\x0b\x0c"]
    rows = []
    for i in range(60):
        w = [f"é{k}\u2003" if k % 5 == 0 else f"w{k}" for k in range(rng.randrange(1, 9))]
        if rng.random() < 0.7:
            w[rng.randrange(len(w))] = f"new{i}"
        line = "".join(x + rng.choice(gaps) for x in w)
        lines = [rng.choice(["", " ", "\t"]) + line, rng.choice(["", "\r", " \x0b"]), line.strip()]
        rows.append((i, "\n".join(lines), "en", "a", 0, "", "", "", ""))
    gone = plain_lines(rows, min_words)
    got = line_dedup(frame(spark, rows), min_words=min_words).collect()
    assert {r.doc_id: r.text for r in got} == {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if (r[0], k) not in gone) for r in rows}


def test_line_dedup_splits_a_text_once(spark):
    lines = [f"line {k} of many" for k in range(30_000)]
    began = time.monotonic()
    (got,) = line_dedup(frame(spark, [(1, "\n".join([*lines, lines[0]]), "en", "a", 0, "", "", "", "")])).select("text", "n_lines", "n_exact").collect()
    assert got == ("\n".join(lines), 30_001, 1)
    assert time.monotonic() - began < 40  # before: not ended in 80 s


def test_line_dedup_hot_group_and_long_line(spark):
    base = [f"x{i}" for i in range(30)]
    rows = [(i, " ".join([*base[:10], f"v{i}", *base[11:]]), "en", "a", 0, "", "", "", "") for i in range(200)]
    rows.append((500, " ".join(f"z{i}" for i in range(4000)), "en", "a", 0, "", "", "", ""))
    rows.append((501, " ".join(f"z{i}" for i in range(4000) if i != 17), "en", "a", 0, "", "", "", ""))
    rows.append((None, " ".join(base), "en", "a", 0, "", "", "", ""))
    got = {r.doc_id: r.text for r in line_dedup(frame(spark, rows)).collect()}
    assert [k for k, t in got.items() if t and k is not None] == [0, 500] or sorted(k for k, t in got.items() if t and k is not None) == [0, 500]
    assert got[None] == " ".join(base)


# Jaccard join


def plain_components(rows, size=5, percent=80):
    sets = {}
    for r in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("seed", "bucket"), [(1, 24), (2, 2), (4, 1)])
def test_jaccard_components_match_all_pairs(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr("threadloom.llm.jaccard_join.PAIR_BUCKET", bucket)
    monkeypatch.setattr("threadloom.llm.jaccard_join.ROUNDS", 2)
    rng = random.Random(seed)
    texts = [t.replace("w1", "W1") for t in corpus(seed, 40)]
    base = words(60, rng)
    for _ in range(15):  # a chain and a cloud of near copies around the threshold
        base = list(base)
        base[rng.randrange(60)] = f"c{rng.randrange(99)}"
        texts.append(" ".join(base))
    middle = words(90, rng)
    for k in range(40):  # copies about one middle, each with more edits of its own; many link with a few others only
        copy, edits = list(middle), k % 8
        for at in rng.sample(range(90), edits):
            copy[at : at + rng.randrange(2)] = [f"e{rng.randrange(30)}"]
        texts.append(" ".join(copy[rng.randrange(3) :]))
    rows = awkward(texts)
    got = jaccard_join(frame(spark, rows)).collect()
    want = plain_components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 5


# mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total >= limit * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(limit * sizes[s])
        rest = share * sum(sizes.values()) - sum(target.values())
        open_ -= set(over)
    return target


def test_mixing_takes_each_target_exactly(spark):
    rows = [r for r in awkward(corpus(7, 60))][:-2]
    got = mix_sources(frame(spark, rows)).collect()
    again = mix_sources(frame(spark, rows, 5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    target = plain_targets(sizes)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    assert {s: taken[s] for s in sizes} == {s: math.floor(target[s] + 1e-9) for s in sizes}


# packing


def check_piece(r, ids):
    assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def check_packing(got, texts, copies=None):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    by_doc = collections.defaultdict(list)
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        if copies:
            assert sum(r.length for r in own) == copies[i] * len(ids)
            own = list({r.start: r for r in own if not check_piece(r, ids)}.values())
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return 1 - sum(r.length for r in got) / 4096 / len(by_sequence)


def test_packing_round_trip(spark):
    rows = awkward([*corpus(9, 30), "It's <|endoftext|> here", "don't!! ΣΑΣ ñ a≠b", "UPPER <|ENDOFTEXT|>x", "\x1f\x85 12345"])[:-2]
    got = pack(frame(spark, rows), TOKENIZER).collect()
    assert check_packing(got, {r[0]: r[1] for r in rows}) < 0.5


def test_packing_has_little_padding(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng.randrange(1, 3000), rng)), "en", "a", 0, "", "", "", "") for i in range(200)]
    got = pack(frame(spark, rows), TOKENIZER).collect()
    assert check_packing(got, {r[0]: r[1] for r in rows}) < 0.02


def test_plain_words_go_to_the_model_alone(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    full = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(3)
    plain = sorted({"".join(rng.choice("etaoinshrdlucméßñöü"[: rng.choice([12, 19])]) for _ in range(rng.randrange(1, 30))) for _ in range(2000)} - {""})
    plain += [chr(c) for c in (0xDF, 0xFF, 0x131, 0x24F)]
    others = ["Upper", "don't", "1a", "e\u0301t", "ΣΑΣ", "\u0149", "\u01c5a", "\xaa", "\xb5", "\u01c6", "", "endoftext", "<|endoftext|>x", "數", "x." * 300]
    find = WordIds(TOKENIZER)
    find.learn([*plain, *others])
    for w in [*plain, *others]:
        k = find.found[w]
        assert find.ids[find.starts[k] : find.starts[k] + find.sizes[k]].tolist() == full.encode(w, add_special_tokens=False).ids, w

    class Refuses:
        def encode_batch_fast(self, texts, add_special_tokens):
            assert not texts
            return []

    find.clear()
    find.tokenizer = Refuses()
    find.learn(plain)
    full.pre_tokenizer = pre_tokenizers.Split("e", "isolated")
    full.save(str(tmp_path / "split.json"))
    assert not WordIds(str(tmp_path / "split.json")).letters


def test_cuts_cover_and_fit():
    for n in [*range(1, 400), 4095, 4096, 4097, 20_000, 8191]:
        out = cuts(n, 4096, 1 / 64)
        assert sum(length for length, _ in out) == n
        assert all(length * k <= 4096 and length * k >= 4032 for length, k in out)


# all


@pytest.mark.parametrize("operator", [quality_rules, line_dedup, jaccard_join, mix_sources, lambda d: pack(d, TOKENIZER)])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline_stages_keep_columns_and_count(spark):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [" ".join("".join(rng.choice(("ba", "ne", "to", "ri", "lu")) for _ in range(3)) for _ in range(90)) for _ in range(40)]
    texts = [*clean, clean[0], clean[1] + " end", "short"]
    rows = [(i, t, "en", ("a", "b")[i % 2], len(t), "", "", "", "") for i, t in enumerate(texts)]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        kept[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(kept[name], docs.schema)
    assert {r.doc_id for r in kept["quality_rules"]} == set(range(42))
    by_id = {r.doc_id: r.text for r in kept["line_dedup"]}
    assert set(by_id) == set(range(40)) and all(by_id[i] == clean[i] for i in range(40))
    assert {r.doc_id for r in kept["jaccard_join"]} == set(range(40))
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["mix_sources"]}


def plain_bands(rows, lower=8.0, upper=3.5, floor=0.5, prior=30.0):
    """Rows that the base rules and the bands of their language keep."""
    logs = {}
    for lang in {r[2] for r in rows}:
        own = sorted({r[1] or "" for r in rows if r[2] == lang})
        logs[lang] = {t: math.log(p) for t, p in zip(own, plain_perplexity(own)) if p and not plain_counts(t)[5]}
    mark = lambda xs, q: sorted(xs)[math.ceil(q * len(xs)) - 1]
    spread = lambda xs: (mark(xs, 0.75) - mark(xs, 0.25)) / 1.349
    every = spread([x for own in logs.values() for x in own.values()])
    kept = []
    for r in rows:
        own = logs[r[2]]
        if (r[1] or "") in own:
            xs = list(own.values())
            s = max(spread(xs), floor * every) * (1 + prior / len(xs))
            if -lower * s - 1e-6 <= own[r[1]] - mark(xs, 0.5) <= upper * s + 1e-6:
                kept.append(r)
    return kept


def plain_copies(rows):
    """How often the mix emits each document."""
    sizes, by_key = collections.Counter(), collections.defaultdict(lambda: collections.defaultdict(list))
    for i, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        by_key[source][hashlib.md5(f"{i}:mix".encode()).hexdigest()].append((i, n))
    out = {}
    for source, target in plain_targets(sizes).items():
        whole = math.floor(target + 1e-9)
        epochs = whole // sizes[source] if sizes[source] else 0
        due = whole - epochs * sizes[source]
        for key in sorted(by_key[source]):
            own = sum(n for _, n in by_key[source][key])
            for i, n in by_key[source][key]:
                part = n * due // own if own and due > 0 else 0
                out[i] = epochs + (due > 0 and (due >= own or 2 * part >= n))
            due -= own
    return out


def test_pipeline_run_matches_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    syllables = ("ba", "ne", "to", "ri", "lu", "ka")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts = ["\n".join(" ".join(word() for _ in range(rng.randrange(50, 80))) for _ in range(rng.randrange(2, 5))) for _ in range(60)]
    for k in range(12):  # near copies with two words changed in every line, and exact ones
        lines = [line.split(" ") for line in texts[k].split("\n")]
        for line in lines if k % 3 else ():
            line[20:22] = "new0", "new1"
        texts.append("\n".join(" ".join(line) for line in lines))
    texts += [" ".join(rng.choice("XQ#|9%") * 3 for _ in range(80)), " ".join(word() for _ in range(6000)), texts[5] + " more", "one two"]
    rows = [(i, t, ("en", None)[i % 40 == 39], ("a", "b", None)[i % 3], len(t)) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None, "en", "a", None), (n + 1, "", None, None, 0), (n + 2, " \n ", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = plain_bands(rows)
    assert 60 < len(kept) < len(texts)
    gone = plain_lines(kept, 8)
    left = []
    for r in kept:
        text = "\n".join(x for no, x in enumerate(r[1].split("\n")) if (r[0], no) not in gone)
        if WORD.search(text):
            left.append((r[0], text, r[3]))
    label = plain_components(left)
    alone = [r for r in left if label[r[0]][1] == r[0]]
    assert len(kept) - len(left) >= 4 and len(left) - len(alone) >= 4
    copies = {i: n for i, n in plain_copies(alone).items() if n}
    check_packing(got, {i: t for i, t, _ in alone if i in copies}, copies)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
