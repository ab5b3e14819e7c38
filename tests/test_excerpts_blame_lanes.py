"""Excerpts, canonical JSON, blame and followed lanes against plain versions."""

import hashlib
import json
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadloom.functions.canonical import canonical, canonical_json, number, receipt_hash
from threadloom.functions.fingerprints import line_print
from threadloom.operators.aggregates import verified_chain
from threadloom.operators.blame import blame, blamed_commits
from threadloom.operators.excerpts import best_windows, cut, task_words
from threadloom.streaming.lanes import follow_lanes


def plain_fit(text, needle, words):
    tokens = [t for t in re.split(r"[^\w]+", text) if t]
    if not tokens:
        return 0
    damp, total = 1.2 * (1 - 0.75 + 0.75 * (len(tokens) / 40.0)), 0.0
    for w in words:
        n = float(tokens.count(w)) or (0.35 if "_" not in w and len(w.encode()) >= 4 and w in text else 0.0)
        total += n * 2.2 / (n + damp) if n else 0.0
    if needle.strip() and needle.strip() in text:
        total += 2.5 * 2.2 / (1 + damp)
    return int(total * 10_000 + 0.5)


def test_best_windows(spark):
    rng = random.Random(1)
    words = ["fix", "the", "parser", "parse_tree", "parsers", "été", "in", "rust", "  ", "tree.", "Parser", "\n"]
    rows = [(s, i, rng.choice(["user", "assistant", "tool", None]), rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for s in "abcdef" for i in range(rng.randrange(1, 20))]
    task = "Fix the parser in parse_tree, été"
    assert task_words(task) == ["fix", "parser", "parse_tree", "été"]
    got = {r.session_id: r for r in best_windows(spark.createDataFrame(rows, "session_id string, msg_idx int, role string, text string").repartition(3), task).collect()}
    seen = set()
    for s in "abcdef":
        able = [(i, role, t.strip()) for x, i, role, t in rows if x == s and role != "tool" and t and t.strip()]
        if not able:
            continue
        seen.add(s)
        scores = [plain_fit(t.lower(), task.lower(), task_words(task)) for _, _, t in able]
        at = scores.index(max(scores))
        window = able[max(at - 1, 0) : at + 2]
        assert (got[s].score, got[s].lo, got[s].hi) == (scores[at], window[0][0], window[-1][0] + 1)
        assert [(e.msg_idx, e.role, e.text, e.cut) for e in got[s].excerpt] == [(*w, False) for w in window]
    assert set(got) == seen


def test_excerpts_are_cut_on_whole_characters(spark):
    texts = {"abc": ("abc", False), "  abcdefgh ": ("abcdefgh", False), "abcdefghi": ("abcdefgh…", True), "éééééé": ("éééé…", True), "aéééééé": ("aééé…", True), "```py\nx = 1": ("```py\nx\n```…", True), "": ("", False)}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cut(F.col("t"), 8).alias("c")).collect()
    assert {r.t: tuple(r.c) for r in got} == texts


def test_canonical_json(spark):
    assert [number(x) for x in (1.0, -0.0, 1.5, 1e15, 1e16, 1.25e20, 1e-5, 1e-6, 123456.789, 5e-324)] == ["1.0", "-0.0", "1.5", "1000000000000000.0", "1e16", "1.25e20", "0.00001", "1e-6", "123456.789", "5e-324"]
    texts = {
        ' {"b" : 1.0, "a":[1, {"z":null,"y":true}], "\\u00e9":"\\u001f\\n/\\"" } ': '{"a":[1,{"y":true,"z":null}],"b":1.0,"é":"\\u001f\\n/\\""}',
        '{"\\ud83d\\ude00":1,"\\uffff":2}': '{"￿":2,"😀":1}', '{"a":1,"a":2}': '{"a":2}', "18446744073709551616": "1.8446744073709552e19", "[]": "[]", "{}": "{}", "nope": None, "NaN": None, '""': '""',
        "[[1],[],[2,[3]]]": "[[1],[],[2,[3]]]",
    }
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", canonical_json("t").alias("c")).collect()}
    assert got == {**texts, None: None}
    rng = random.Random(2)

    def drawn(depth=0):
        kind = rng.randrange(6 if depth < 4 else 4)
        if kind == 4:
            return [drawn(depth + 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return {rng.choice("abcdeé"): drawn(depth + 1) for _ in range(rng.randrange(4))}
        return [rng.randrange(-9, 9), rng.choice("aé\n\"\\"), rng.choice([None, True, False]), rng.uniform(1, 9)][kind]

    for _ in range(300):
        value = drawn()
        assert canonical(value) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_a_chain_over_unordered_payloads_verifies(spark):
    rng = random.Random(3)
    rows, prev = [], ""
    for seq in range(1, 40):
        body = {"n": seq, "who": rng.choice(["a", "b"]), "d": {"y": 1.0, "x": [seq]}}
        digest = hashlib.sha256(f"receipt\n{prev}\n{json.dumps(body, sort_keys=True, separators=(',', ':'))}".encode()).hexdigest()
        keys = list(body)
        rng.shuffle(keys)
        rows.append(("p", seq, prev, json.dumps({k: body[k] for k in keys}, indent=rng.choice([None, 2])), digest))
        prev = digest
    table = spark.createDataFrame(rows, "producer string, seq long, prev string, body string, hash string").repartition(3)
    assert table.where(receipt_hash("receipt", F.col("prev"), F.col("body")) != F.col("hash")).count() == 0
    chain = verified_chain(table.withColumn("body", canonical_json("body")), "producer", "receipt")
    assert chain.where("ok").count() == 39
    broken = table.withColumn("body", F.when(F.col("seq") == 7, F.lit('{"n":7}')).otherwise(canonical_json("body")))
    assert [r.seq for r in verified_chain(broken, "producer", "receipt").where("NOT ok").collect()] == [7]


def history(rng, commits):
    """Changes of one file, and for each line of the newest version (commit, its number there, text)."""
    lines = [(None, i + 1, f"old line {i}") for i in range(rng.randrange(0, 30))]
    changes, texts = [], []
    for c in range(commits):
        hunks, made, at, grown = [], [], 0, 0
        for _ in range(rng.randrange(0, 4)):
            if at > len(lines):
                break
            start = rng.randrange(at, min(at + 8, len(lines)) + 1)  # lines before the hunk
            gone, new = min(rng.randrange(0, 4), len(lines) - start), rng.randrange(0, 4)
            if not gone and not new:
                continue
            hunks.append({"old_start": start + (gone > 0), "old_lines": gone, "new_start": start + grown + (new > 0), "new_lines": new})
            made += lines[at:start] + [(f"c{c}", start + grown + k + 1, f"c{c} line {start} {k}") for k in range(new)]
            at, grown = start + gone, grown + new - gone
            if at < len(lines):
                made.append(lines[at])
                at += 1
        lines = made + lines[at:]
        texts += [(f"c{c}", n, t) for who, n, t in lines if who == f"c{c}"]
        changes.append((c, f"c{c}", hunks))
    return changes, lines, texts


def test_blame_as_a_plain_replay_gives_it(spark):
    rng = random.Random(4)
    changes, asked, texts, want = [], [], [], {}
    for f in range(25):
        done, lines, said = history(rng, rng.randrange(0, 30))
        changes += [(f"f{f}", *c) for c in done]
        texts += [(f"f{f}", c, n, t) for c, n, t in said]
        if lines and f % 5:
            lo = rng.randrange(1, len(lines) + 1)
            hi = rng.randrange(lo, len(lines) + 1)
            asked.append((f"f{f}", lo, hi))
            want |= {(f"f{f}", n): lines[n - 1] for n in range(lo, hi + 1)}
    schema = "file string, seq int, commit_id string, hunks array<struct<old_start: long, old_lines: long, new_start: long, new_lines: long>>"
    table = spark.createDataFrame([(f, s, c, [tuple(h.values()) for h in hs]) for f, s, c, hs in changes], schema).repartition(5)
    found = blame(table, spark.createDataFrame([*asked, ("none", 1, 2), (None, 1, 2), ("f1", 5, 4)], "file string, first int, last int"))
    got = {}
    for r in found.collect():
        for k in range(r.last - r.first + 1):
            assert (r.file, r.first + k) not in got
            got[r.file, r.first + k] = (r.commit_id, r.origin + k)
    assert {k: v for k, v in got.items() if k[0] != "none"} == {k: v[:2] for k, v in want.items()}
    assert got["none", 1] == (None, 1)
    said = spark.createDataFrame([(f, c, 0, n, t) for f, c, n, t in texts], "file string, commit_id string, commit_ts long, line long, text string")
    prints = {(r.file, r.commit_id): set(r.prints) for r in blamed_commits(found, said).collect()}
    for (file, n), (commit, _, text) in want.items():
        assert commit is None or line_print(text) in prints[file, commit]


def test_lanes_are_followed_by_changes_and_silence(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime(2026, 1, 1)
    at = lambda s: (start + timedelta(seconds=s)).strftime("%Y-%m-%d %H:%M:%S")
    schema = "session_id string, agent_id string, ts timestamp, status string, last_text string, last_tool string, tokens long"
    batches = [
        [("s", "a", at(0), "running", "hi", None, 1), ("s", "a", at(0), "running", "hi", None, 1), ("s", "b", at(0), "running", None, "Bash", 2)],
        [("s", "a", at(5), "running", "hi", None, 1), ("s", "a", at(2), "running", "late", None, 0), ("s", "b", at(9), "done", "bye", "Bash", 3)],
        [("s", "c", at(200), "running", "x", None, 9)],
        [("s", "a", at(201), "running", "back", None, 5), ("s", "c", at(201), "running", "x", None, 9)],
        [("s", "c", at(900), "done", "x", None, 9)],
    ]
    source = tmp_path / "in"
    source.mkdir()
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    out = []
    query = follow_lanes(read, quiet=100, late="10 seconds").writeStream.foreachBatch(lambda df, _: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, rows in enumerate(batches):
            names = [c.split()[0] for c in schema.split(", ")]
            (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
            query.processAllAvailable()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r[1], (r[2] - start).total_seconds(), r[3], r[4], r[7]) for rows in out for r in rows)
    assert got == sorted([
        ("a", 0, "running", "hi", False), ("b", 0, "running", None, False), ("b", 9, "done", "bye", False), ("c", 200, "running", "x", False),
        ("a", 105, "returned", "hi", True), ("a", 201, "running", "back", False), ("c", 900, "done", "x", False), ("a", 301, "returned", "back", True),
    ])


def test_blame_keeps_a_file_in_one_task_where_both_sides_come_dealt_by_file(spark):
    """A merge join, as for many files, in which Spark puts other partitions together on either side; each commit writes one line above all others."""
    hunk = F.struct(*[F.lit(n).cast("long").alias(c) for c, n in (("old_start", 0), ("old_lines", 0), ("new_start", 1), ("new_lines", 1))])
    table = spark.range(10_000, numPartitions=3).select(F.format_string("f%s", F.col("id") % 200).alias("file"), (F.floor(F.col("id") / 200) + 1).alias("seq"), F.col("id").cast("string").alias("commit_id"), F.array(hunk).alias("hunks"))
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {name: spark.conf.get(name, None) for name in sizes}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        found = blame(table, table.select("file").distinct().select("file", F.lit(1).alias("first"), F.lit(50).alias("last"))).collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    got = {(r.file, r.first + k): (r.commit_id, r.origin + k) for r in found for k in range(r.last - r.first + 1)}
    assert got == {(f"f{f}", 50 - s): (str(s * 200 + f), 1) for f in range(200) for s in range(50)}
