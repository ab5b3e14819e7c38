"""Distillates against a plain fold over small sessions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import distill as D

SCHEMA = f"session_id string, msg_idx int, role string, kind string, text string, calls {D.CALLS}, results {D.RESULTS}"


def sessions():
    rng = random.Random(9)
    out = {}
    for s in range(24):
        rows, open_calls, n = [], [], 0
        for i in range(rng.randrange(1, 26)):
            kind = rng.random()
            if kind < 0.25:
                rows.append(("user", rng.choice(["prompt", "peer_message", "note"]), rng.choice(["Do it.", "", "Please look."]), [], []))
            elif kind < 0.65:
                made = []
                for _ in range(rng.choice([0, 1, 1, 2])):
                    tool, given = rng.choice([
                        ("Bash", {"command": "pytest -q"}), ("Bash", {"command": "ssh me@box ls"}), ("Bash", {"command": "git commit -m x"}), ("Write", {"file_path": "/n/plan.md", "content": "note " * 9}),
                        ("Read", {"file_path": "/src/a.py"}), ("Task", {"description": "dig", "prompt": "dig deep"}), ("SendMessage", {"to": "bob", "message": "hello bob"}), ("Bash", {"command": "sleep 1"}),
                    ])
                    made.append((f"s{s}c{n}", tool, json.dumps(given)))
                    open_calls.append(made[-1])
                    n += 1
                rows.append(("assistant", "reply", rng.choice(["Working.", "", "Done now."]), made, []))
            elif open_calls:
                call = open_calls.pop(rng.randrange(len(open_calls)))
                content = {"Bash": rng.choice(["[main abc1234] Fix it\n 1 file", "On branch dev\n3 passed", "2 failed, error: x\nerror: no such file", "ok"]), "Read": "é" * rng.randrange(30)}.get(call[1], "fine")
                rows.append(("tool", "tool_result", "", [], [(call[0], content, rng.random() < 0.2)]))
        out[f"s{s}"] = rows
    return out


def plain_cut(rows, keep):
    if keep == 0:
        return len(rows)
    seen, start = 0, len(rows)
    for i in range(len(rows) - 1, -1, -1):
        if rows[i][0] == "assistant" and rows[i][3]:
            seen, start = seen + len(rows[i][3]), i
            if seen >= keep:
                break
    while start and rows[start - 1][0] == "assistant":
        start -= 1
    prompt = next((i for i, r in enumerate(rows) if r[:2] == ("user", "prompt")), None)
    if prompt is not None and start <= prompt:
        start = prompt + 1
        while start < len(rows) and rows[start][0] != "assistant":
            start += 1
    least, at = 0 if prompt is None else prompt + 1, len(rows)
    where = {c[0]: i for i, r in enumerate(rows) for c in r[3]}
    while at > start:
        at -= 1
        for result in rows[at][4]:
            if least <= where[result[0]] < start:
                start = where[result[0]]
                while start > least and rows[start - 1][0] == "assistant":
                    start -= 1
    return start


def cut_text(text, most, pointer):
    data = text.encode()
    if len(data) <= most:
        return text
    head = data[: most * 3 // 5].decode(errors="ignore")
    tail = data[len(data) - (most - most * 3 // 5) :].decode(errors="ignore")
    return f"{head}\n[… {len(data) - len(head.encode()) - len(tail.encode())} bytes elided — {pointer} …]\n{tail}"


@pytest.mark.parametrize("keep", [0, 1, 3, 12])
def test_cuts(spark, keep):
    flat = [(s, i, *r) for s, rows in sessions().items() for i, r in enumerate(rows)]
    got = {r.session_id: r.start for r in D.cuts(spark.createDataFrame(flat, SCHEMA).repartition(3), keep).collect()}
    assert got == {s: plain_cut(rows, keep) for s, rows in sessions().items() if rows}


def test_distillates(spark):
    made, most = sessions(), 20
    flat = [(s, i, *r) for s, rows in made.items() for i, r in enumerate(rows)] + [(None, 0, "user", "prompt", "x", None, None), ("bare", 0, None, None, None, None, None)]
    got = D.distill(spark.createDataFrame(flat, SCHEMA).repartition(3), keep_last=3, tail_result_max=most, note_max=most)
    brief, story, book, sidecar, kept, mined = {}, [], [], [], [], {}
    for s, rows in made.items():
        if not rows:
            continue
        start = plain_cut(rows, 3)
        prompt = next((i for i, r in enumerate(rows) if r[:2] == ("user", "prompt")), None)
        if prompt is not None:
            brief[s] = rows[prompt][2]
        results = {x[0]: (i, x) for i, r in enumerate(rows) for x in r[4]}
        lines = []
        for i, (role, kind, text, calls, answers) in enumerate(rows):
            if i >= start:
                kept.append((s, i, text, [(a, cut_text(b, most, a), c) for a, b, c in answers]))
                continue
            if text.strip() and role != "assistant" and kind in D.INCOMING and i != prompt:
                story.append((s, i, -1, "to", kind, text))
            if text.strip() and role == "assistant":
                story.append((s, i, -1, "own", None, text))
            for k, (call, tool, given) in enumerate(calls):
                given = json.loads(given)
                target = next(iter(given.values()))
                if tool == "Write":
                    story.append((s, i, k, "note", target, cut_text(given["content"], most, call)))
                if tool == "Task":
                    story.append((s, i, k, "spawned", target, cut_text(given["prompt"], most, call)))
                if tool == "SendMessage":
                    story.append((s, i, k, "sent", target, given["message"]))
                at, answer = results.get(call, (None, None))
                fact = lambda kind, value, i=i: mined.update({(s, kind, value): (mined.get((s, kind, value), (0, 0))[0] + 1, i)})
                if tool == "Bash" and "ssh" in target:
                    fact("host", "me@box")
                if tool in ("Read", "Write"):
                    fact("path", target)
                text_lines = answer[1].split("\n") if answer else []
                verdicts = [x for x in text_lines if re.search(D.VERDICT, x)]
                errors = [x for x in text_lines if re.search(D.ERROR_LINE, x)] or text_lines[:1]
                if answer and tool == "Bash":
                    for sha in re.findall(D.COMMIT, answer[1]):
                        fact("commit", sha[1])
                    for branch in set(re.findall(D.ON_BRANCH, answer[1])):
                        fact("branch", branch)
                    if "pytest" in target and verdicts:
                        fact("verdict", target)
                if answer and answer[2]:
                    fact("error", errors[0].strip())
                outcome = "no result" if not answer else f"error: {errors[0].strip()}" if answer[2] else verdicts[-1].strip() if tool == "Bash" and verdicts else f"{len(answer[1].encode())} bytes"
                label = f"{tool} {target}"
                if lines and lines[-1][3:] == [label, outcome]:
                    lines[-1][1:3] = [i, lines[-1][2] + 1]
                else:
                    lines.append([i, i, 1, label, outcome])
        book += [(s, *x) for x in lines]
        for i, r in enumerate(rows):
            sidecar += [(s, i, x[0], x[1]) for x in r[4] if i < start or len(x[1].encode()) > most]
    key = lambda x: tuple((v is not None, v) for v in x)
    rows = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=key)
    assert {r.session_id: r.text for r in got.brief.collect()} == brief
    assert rows(got.timeline, "session_id", "msg_idx", "part", "what", "label", "text") == sorted(story, key=key)
    assert rows(got.ledger, "session_id", "first", "last", "n", "label", "outcome") == sorted(book, key=key)
    assert rows(got.elided, "session_id", "msg_idx", "call_id", "content") == sorted(sidecar, key=key)
    assert {(r.session_id, r.kind, r.value): (r.n, r["last"]) for r in got.facts.collect()} == mined
    tail = sorted((r.session_id, r.msg_idx, r.text, [tuple(x) for x in r.results]) for r in got.tail.where("session_id <> 'bare'").collect())
    assert tail == sorted(kept)
    stats = {r.session_id: r for r in got.stats.collect()}
    assert set(stats) == {s for s, rows in made.items() if rows} | {"bare"}
    for s, r in stats.items():
        assert r.timeline_entries == sum(x[0] == s for x in story) and r.elided_outputs == sum(x[0] == s for x in sidecar)
        assert r.commits == sum(k[:2] == (s, "commit") for k in mined) and r.errors == sum(n for k, (n, _) in mined.items() if k[:2] == (s, "error"))
        assert r.tail_tool_calls <= r.tool_calls and r.tail_start == (plain_cut(made[s], 3) if s != "bare" else 1)


def test_head_and_tail_keep_whole_characters(spark):
    texts = ["", "abc", "é" * 30, "aé" * 20, "x" * 21, "😀" * 8]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.head_tail(F.col("t"), 20, F.lit("id")).alias("c")).collect()
    assert {r.t: r.c for r in got} == {t: cut_text(t, 20, "id") for t in texts}
