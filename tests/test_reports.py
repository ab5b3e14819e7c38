"""Context reports, lane verdicts, inboxes and training records against plain versions."""

import json
import random
from datetime import datetime, timedelta

from threadloom.operators import context as C
from threadloom.operators import lanes as L
from threadloom.operators import records as R
from threadloom.operators import sessions as S
from threadloom.operators import tasks as K
from threadloom.operators import tools as T

BLOCKS = "session_id string, msg_idx long, role string, kind string, type string, tokens long, tool string, call_id string, attachment string"
PART = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean>"
MESSAGE = f"session_id string, msg_idx long, id string, ts timestamp, role string, kind string, origin string, text string, queued boolean, content array<{PART}>"
T0 = datetime(2024, 1, 1)


def text(s):
    return ("text", s, None, None, None, None, None)


def call(id_, name, **input_):
    return ("tool_use", None, id_, name, json.dumps(input_), None, None)


def result(id_, s):
    return ("tool_result", s, None, None, None, id_, None)


def message(idx, role, kind, *parts, queued=False, session="s"):
    said = "\n".join(p[1] for p in parts if p[0] == "text" and p[1])
    return (session, idx, f"m{idx}", T0 + timedelta(minutes=idx), role, kind, "human" if kind == "prompt" else "model", said, queued, list(parts))


def test_tool_results_take_the_name_of_their_call(spark):
    rows = [
        ("s", 0, "assistant", "reply", "tool_use", 5, "mcp__x__y", "1", None), ("s", 1, "tool", "tool_result", "tool_result", 7, None, "1", None), ("s", 2, "tool", "tool_result", "tool_result", 8, None, "1", None),
        ("t", 0, "tool", "tool_result", "tool_result", 9, None, "1", None), ("t", 1, "tool", "tool_result", "tool_result", None, "Bash", "2", None), ("s", 3, "system", "notice", "tool_use", 4, "Bash", "3", None),
    ]
    got = {r.tool: (r.calls, r.result_tokens, r.mcp) for r in C.by_tool(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got == {"mcp__x__y": (1, 15, True), C.UNKNOWN: (0, 9, False), "Bash": (0, 0, False)}


def plain_window(rows):
    """Rows (idx, id, parent, kind) after the last compaction."""
    b = max((i for i, r in enumerate(rows) if r[3] == "compaction_boundary"), default=None)
    s = max((i for i, r in enumerate(rows) if r[3] == "compaction_summary"), default=None)
    if b is None and s is None:
        return rows
    if b is None:
        return rows[s:]
    if s is not None and s > b and s != b + 1 and not (rows[b][1] is not None and rows[s][2] == rows[b][1]):
        return rows[s:]
    return rows[b + 1 :]


def test_active_windows(spark):
    rng = random.Random(5)
    kinds = ["prompt", "reply", "compaction_boundary", "compaction_summary"]
    rows = []
    for s in range(60):
        at = 0
        for _ in range(rng.randrange(9)):
            at += rng.choice([1, 1, 2])  # an active branch leaves gaps
            rows.append((f"s{s}", at, f"m{at}" if rng.random() < 0.8 else None, f"m{rng.randrange(8)}" if rng.random() < 0.5 else None, rng.choice(kinds)))
    got = C.active_window(spark.createDataFrame(rows, "session_id string, msg_idx long, id string, parent_id string, kind string")).collect()
    want = {(f"s{s}", r[0]) for s in range(60) for r in plain_window([r[1:] for r in rows if r[0] == f"s{s}"])}
    assert {(r.session_id, r.msg_idx) for r in got} == want


def test_window_report_counts_a_response_once(spark):
    schema = "session_id string, msg_idx long, id string, parent_id string, role string, kind string, tokens long, prompt_tokens long, usage_key string"
    rows = [
        ("s", 0, "a", None, "user", "prompt", 100, None, None), ("s", 1, "b", "a", "system", "compaction_boundary", 50, None, None), ("s", 2, "c", "b", "user", "compaction_summary", 40, None, None),
        ("s", 3, "d", "c", "user", "prompt", 10, None, None), ("s", 4, "e", "d", "assistant", "reply", 20, 1000, "r1"), ("s", 5, "f", "e", "assistant", "reply", 20, 1100, "r1"),
        ("s", 6, "g", "f", "user", "prompt", 5, None, None), ("s", 7, "h", "g", "assistant", "reply", None, 1500, "r2"), ("t", 0, None, None, "system", "notice", 9, 0, None),
    ]
    reports = C.window_reports(spark.createDataFrame(rows, schema))
    got = {r.session_id: r.asDict() for r in reports.collect()}
    assert got["s"] == dict(session_id="s", compacted=True, messages=6, turns=2, total=95, first_prompt=1100, shown_before=50, overhead=1050, current=1500, peak=1500, burn=400, steps=1)
    assert got["t"] == dict(session_id="t", compacted=False, messages=1, turns=1, total=0, first_prompt=None, shown_before=None, overhead=None, current=None, peak=0, burn=0, steps=0)
    assert C.overall(reports).first().asDict() == dict(sessions=2, compacted=1, messages=7, turns=3, total=95, peak=1500, overhead=1050, burn_per_turn=400)
    assert C.overall(reports.limit(0)).first().sessions == 0


def finished(lane, lanes):
    """Whether a lane is done, plainly: by its own state and all below it."""
    below = [x for x in lanes if x[1] == lane[0]]
    open_ = sum(not finished(x, lanes) for x in below)
    owes = lane[4] > 0 or open_ > 0 or (lane[3] == "process_exit" and lane[2] == "stopped")
    stranded = lane[2] not in ("running", "failed", "killed") and owes
    return lane[2] in ("completed", "done", "returned") and not stranded


def test_obligations_reach_every_ancestor(spark):
    rng = random.Random(3)
    lanes = []
    for i in range(80):
        status = rng.choice(["completed", "completed", "done", "returned", "returned", "running", "stopped", "killed"])
        lanes.append((str(i), str(rng.randrange(i)) if i and rng.random() < 0.8 else None, status, rng.choice(["transcript", "process_exit"]), int(rng.random() < 0.1)))
    frame = spark.createDataFrame([(*x, 0, None) for x in lanes], "session_id string, parent_id string, status string, source string, open_tool_calls int, open_tasks int, open_decisions int")
    got = {r.session_id: (r.unreturned, r.finished) for r in L.obligations(frame).collect()}
    assert got == {x[0]: (sum(not finished(y, lanes) for y in lanes if y[1] == x[0]), finished(x, lanes)) for x in lanes}
    ring = spark.createDataFrame([("a", "b", "stopped", "transcript", 1, 0, 0), ("b", "a", "done", "transcript", 0, 0, 0)], frame.schema)
    assert {r.session_id: r.stranded for r in L.obligations(ring).collect()} == {"a": True, "b": True}


def test_verdicts_in_order_of_their_witnesses(spark):
    from pyspark.sql import functions as F

    names = "journal notice notice_at stop_seen parked exited exit_at ledger_at reported last_turn".split()
    schema = "journal string, notice string, notice_at timestamp, stop_seen boolean, parked string, exited boolean, exit_at timestamp, ledger_at timestamp, reported boolean, last_turn timestamp"
    later, earlier = T0 + timedelta(seconds=1), T0 - timedelta(seconds=1)
    cases = [
        (dict(journal="partial", notice="killed"), ("partial", "journal")), (dict(notice="completed", notice_at=T0), ("completed", "task_notification")), (dict(notice="completed", notice_at=earlier), ("running", "transcript")),
        (dict(notice="completed", notice_at=T0, stop_seen=False), ("running", "transcript")), (dict(notice="killed", notice_at=T0, stop_seen=False), ("killed", "task_notification")),
        (dict(notice="working", notice_at=later, stop_seen=True), ("running", "task_notification")), (dict(notice="working", notice_at=T0, stop_seen=True), ("stopped", "subagent_stop")),
        (dict(notice="completed", stop_seen=True), ("completed", "task_notification")), (dict(notice="completed"), ("running", "transcript")), (dict(stop_seen=True, parked="waiting"), ("waiting", "subagent_stop")),
        (dict(exited=True, exit_at=later, reported=True), ("returned", "process_exit")), (dict(exited=True, exit_at=earlier), ("running", "transcript")), (dict(exited=True), ("stopped", "process_exit")),
        (dict(ledger_at=T0), ("stopped", "hook_ledger")), (dict(ledger_at=earlier), ("running", "transcript")), (dict(reported=True), ("running", "transcript")), (dict(reported=True, last_turn=T0 - timedelta(seconds=590)), ("returned", "transcript")),
    ]
    rows = [tuple({"last_turn": T0, **given}.get(n) for n in names) + (k,) for k, (given, _) in enumerate(cases)]
    told = spark.createDataFrame(rows, schema + ", k int").select("k", L.verdict(F.lit(T0 + timedelta(seconds=10))).alias("v")).collect()
    assert {r.k: tuple(r.v) for r in told} == {k: want for k, (_, want) in enumerate(cases)}


def test_silence_is_measured_in_fractions_of_seconds(spark):
    from pyspark.sql import functions as F

    names = ["journal", "notice", "parked"], ["notice_at", "exit_at", "ledger_at"], ["stop_seen", "exited"]
    nothing = [F.lit(None).cast(t).alias(c) for cols, t in zip(names, ("string", "timestamp", "boolean")) for c in cols]
    ends = {0.8: "running", 0.2: "returned", 0.25: "returned", 0.250001: "running"}  # the whole seconds are 600 apart each time
    frame = spark.createDataFrame([(k, T0 + timedelta(seconds=k)) for k in ends], "k double, last_turn timestamp").select("k", "last_turn", F.lit(True).alias("reported"), *nothing)
    told = frame.select("k", L.verdict(F.lit(T0 + timedelta(seconds=600.25))).alias("v")).collect()
    assert {r.k: r.v.status for r in told} == ends


def test_salvage_keeps_order_and_leaves_the_done_out(spark):
    lanes = spark.createDataFrame([("s", "killed"), ("t", "done"), ("u", None)], "session_id string, status string")
    messages = spark.createDataFrame([message(0, "user", "prompt", text("do it")), message(1, "assistant", "reply", text("begun")), message(2, "assistant", "reply", text(" "))], MESSAGE)
    events = spark.createDataFrame([("s", 3, "file_edit", "b"), ("s", 1, "file_edit", "b"), ("s", 2, "file_edit", "a"), ("s", 2, "command", "ls"), ("s", 4, "command", None), ("t", 1, "command", "x")], "session_id string, msg_idx long, kind string, target string")
    got = {r.session_id: tuple(r)[1:] for r in L.salvage(lanes, messages, events).collect()}
    assert got == {"s": ("killed", "do it", ["b", "a"], ["ls"], "begun"), "u": (None, None, [], [], None)}
    assert L.salvage(lanes, messages, events, every=True).count() == 3


def test_salvage_as_its_sql_with_nulls_and_wide_spaces(spark, tmp_path):
    import duckdb

    from threadloom.plans import demo

    told = [("user", None), ("user", "do it"), ("assistant", "begun"), ("assistant", "\u00a0\u3000"), ("assistant", None), ("assistant", "\t")]
    turns = [(conv, turn, role, words) for conv, n in ((1, 4), (2, 6), (3, 1)) for turn, (role, words) in enumerate(told[:n])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    events = [(k, T0 + timedelta(seconds=k), (1, 2, 3, None)[k % 4], ("click", "signup", "view")[k % 3], float(k), '{"k": %d}' % (k % 5)) for k in range(40)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    for name in ("events", "conversations"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.execute(demo.oracle_sql()["t21_salvage"])
    names = [c[0] for c in want.description]
    rows = {tuple(r) for r in want.fetchall()}
    assert {r[0] for r in rows} == {"1", "2", "3", None} and {r[names.index("last_note")] for r in rows} == {"begun", "\t", None}
    assert {tuple(r) for r in demo.queries()["t21_salvage"](spark, str(tmp_path)).select(*names).collect()} == rows


def test_openai_records(spark):
    rows = [
        message(0, "user", "prompt", text("find it"), ("image", None, None, None, None, None, None)),
        message(1, "assistant", "reply", ("thinking", "hm", None, None, None, None, None), text("I look"), call("c1", "grep", q='a"b'), call(None, "ls")),
        message(2, "tool", "tool_result", result("c1", "one"), result(None, "two"), text("a reminder")), message(3, "assistant", "reply", call("", "ls")), message(4, "system", "notice", text("hidden")),
        message(5, "assistant", "reply", result(None, "late"), text(" ")), message(6, "tool", "tool_result", result(None, None)), message(7, "assistant", "reply", text("")), message(0, "user", "prompt", text("  "), session="blank"),
    ]
    got = {r.session_id: json.loads(r.record)["messages"] for r in R.openai_tools(spark.createDataFrame(rows, MESSAGE)).collect()}
    fn = lambda id_, name, args: {"id": id_, "type": "function", "function": {"name": name, "arguments": json.dumps(args)}}
    assert got == {"s": [
        {"role": "user", "content": "find it\n\n[image]"},
        {"role": "assistant", "content": "I look", "reasoning_content": "hm", "tool_calls": [fn("c1", "grep", {"q": 'a"b'}), fn("call_1", "ls", {})]},
        {"role": "tool", "tool_call_id": "c1", "content": "one"}, {"role": "tool", "tool_call_id": "call_1", "content": "two"}, {"role": "user", "content": "a reminder"},
        {"role": "assistant", "content": None, "tool_calls": [fn("call_2", "ls", {})]}, {"role": "tool", "tool_call_id": "call_2", "content": "late"}, {"role": "tool", "tool_call_id": "call_0", "content": ""},
    ]}
    assert "reasoning_content" not in R.openai_tools(spark.createDataFrame(rows, MESSAGE), reasoning=False).first().record


def plain_cycles(rows):
    """(index, prompt, report, plan, calls before, calls after, commit after) of messages, told in order."""
    turns, last, queued = [], None, False
    span = lambda: dict(texts=[], calls=0, commit=False)
    spans = [span()]
    for m in rows:
        kind, said, q, parts = m[5], m[7], m[8], m[9]
        if kind == "prompt" and said.strip():
            if (q or queued) and last == said:
                continue
            last, queued = said, q
            turns.append(said)
            spans.append(span())
        elif kind == "reply":
            for p in parts:
                if p[0] == "tool_use":
                    spans[-1]["calls"] += 1
                    spans[-1]["commit"] |= "git commit" in p[4]
            if said.strip() and not said.strip().startswith("[PRUNED id="):
                spans[-1]["texts"].append(said)
    return [
        (k, turns[k], (spans[k]["texts"] or [None])[-1], (spans[k + 1]["texts"] or [None])[0], spans[k]["calls"], spans[k + 1]["calls"], spans[k + 1]["commit"]) for k in range(1, len(turns))
    ]


def test_cycle_rows(spark):
    rng = random.Random(11)
    every, want = [], {}
    for s in range(25):
        rows = []
        for i in range(rng.randrange(14)):
            if rng.random() < 0.5:
                rows.append(message(i, "user", "prompt", text(rng.choice(["go", "go", "stop", " ", "[from x] go"])), queued=rng.random() < 0.4, session=f"s{s}"))
            else:
                parts = [text(rng.choice(["ok", "done", "", "[PRUNED id=1 bytes=2]"]))]
                parts += [call(str(i), "Bash", command=rng.choice(["git commit -m x", "ls"])) for _ in range(rng.randrange(3))]
                rows.append(message(i, "assistant", "reply", *parts, session=f"s{s}"))
        every += rows
        want |= {(f"s{s}", c[0]): c[1:] for c in plain_cycles(rows)}
    found = R.cycle_rows(spark.createDataFrame(every, MESSAGE))
    assert len(found.columns) == 20
    got = {(r.session, r["index"]): (r.prompt, r.report, r.plan, r.tool_calls_before, r.tool_calls_after, r.commit_after) for r in found.collect()}
    assert got == want
    assert all(sum(r.tools_after.values()) == r.tool_calls_after for r in found.collect())
    assert R.cycle_rows(spark.createDataFrame([], MESSAGE)).count() == 0


def test_affordances_and_flags(spark):
    rows = [
        message(0, "assistant", "reply", call("1", "core:TodoWrite"), call("2", "Bash", run_in_background=True), call("3", "Bash", command="ls"), call("4", "tracker_odd"), call("5", "TaskGet")),
        message(1, "system", "model_change"), message(2, "user", "prompt", ("image", None, None, None, None, None, None)), message(3, "user", "subagent_return", text("x")),
    ]
    frame = spark.createDataFrame(rows, MESSAGE)
    found = T.affordances(frame)
    assert sorted((r.msg_idx, r.kind, r.action) for r in found.collect()) == [
        (0, "background_job", "start"), (0, "plan", "read"), (0, "plan", "update"), (0, "plan", "write"), (1, "model_change", "record"), (2, "image", "hold"), (3, "subagent_return", "record"),
    ]
    from pyspark.sql import functions as F

    kimi = T.affordances(frame.withColumn("harness", F.lit("kimi")))
    assert (0, "plan", "read") not in {(r.msg_idx, r.kind, r.action) for r in kimi.collect()}
    flags = S.flags(found).first().asDict()
    assert {k for k, v in flags.items() if v is True} == {"has_background", "has_background_job", "has_plan", "has_model_change", "has_images", "has_subagent_return", "has_tools"}


def test_inbox_cut_equals_a_plain_sort(spark):
    rng = random.Random(2)
    rows = [
        (str(i), "t", rng.choice(["open", "claimed", "done", "resolved"]), rng.choice(["web:a", "a", "b", None]), rng.choice([[], ["discuss"], None]), rng.choice([[], ["x"], None]), rng.choice([True, False, None]), rng.choice(["a", "web:b", None]), T0 + timedelta(hours=rng.randrange(50)), None, T0)
        for i in range(400)
    ]
    schema = "task_id string, title string, state string, assignee string, tags array<string>, options array<string>, provisional boolean, last_by string, last_ts timestamp, posed_at timestamp, resolved_at timestamp"
    items = K.inboxes(spark.createDataFrame(rows, schema))
    plain = {}
    for r in items.collect():
        plain.setdefault((r.who, r.section), []).append(((-1 if r.section == "closed" else 1) * r.since.timestamp(), r.task_id))
    want = {key: [x[1] for x in sorted(v)[:7]] for key, v in plain.items()}
    got = {}
    for r in sorted(K.inbox_page(items, 7).collect(), key=lambda r: r.place):
        got.setdefault((r.who, r.section), []).append(r.task_id)
    assert got == want and {"a", "b"} == {k[0] for k in got}
    assert all(r.unread for r in K.inboxes(spark.createDataFrame(rows, schema), unread_only=True).where("section = 'open'").collect())


def test_open_calls_as_ranges_equal_a_plain_walk(spark):
    from threadloom.operators.transforms import open_calls

    rng = random.Random(8)
    rows, want = [], {}
    for s in range(30):
        made, answered, at = [], set(), 0
        for _ in range(rng.randrange(12)):
            at += rng.choice([1, 1, 3])
            calls, results = ([f"c{rng.randrange(9)}" for _ in range(rng.randrange(3))] for _ in range(2))
            rows.append((f"s{s}", at, rng.choice([calls, calls, None]), results))
            for c in rows[-1][2] or []:
                made += [c] * (c not in made)
            answered |= set(results)
            want[f"s{s}", at] = [c for c in made if c not in answered]
    frame = spark.createDataFrame(rows, "session_id string, msg_idx long, calls array<string>, results array<string>")
    assert {(r.session_id, r.msg_idx): r.pending for r in open_calls(frame).collect()} == want


def test_uuid7_times_and_deadlines(spark):
    from pyspark.sql import functions as F

    from threadloom.functions.ids import uuid7_time
    from threadloom.functions.text import deadline_phrase, json_at

    ms = 1767225600123
    ids = [f"{ms:012x}"[:8] + "-" + f"{ms:012x}"[8:] + "-7abc-8def-0123456789ab", "not-an-id", None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").select(uuid7_time(F.col("id"))).collect()]
    assert got[0] is not None and got[1:] == [None, None]
    now, times = F.lit(T0), [T0 + timedelta(days=2), T0 - timedelta(hours=30), T0, None]
    read = [r[0] for r in spark.createDataFrame([(x,) for x in times], "d timestamp").select(deadline_phrase(F.col("d"), now)).collect()]
    assert read == ["by 01-03 (in 2d)", "by 12-30 (OVERDUE 1d)", "by 01-01 (in now)", None]
    values = [r[0] for r in spark.createDataFrame([('{"k": 3}',), ('{"k": "x"}',), ("{",), (None,)], "t string").select(json_at(F.col("t"), "$.k", "long")).collect()]
    assert values == [3, None, None, None]
