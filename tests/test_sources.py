"""Readers against small written files, with awkward lines."""

import json
import sqlite3

from threadloom.sources import discover as S
from threadloom.sources import documents as D
from threadloom.sources import jsonl as J
from threadloom.sources.sqlite import SqliteSource

CLAUDE = [
    {"type": "user", "uuid": "u1", "parentUuid": None, "sessionId": "alpha", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "fix it"}},
    {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "sessionId": "alpha", "timestamp": "2026-01-01T00:00:05Z", "message": {
        "role": "assistant", "id": "r1", "model": "m", "usage": {"input_tokens": 3, "output_tokens": 7, "cache_read_input_tokens": 2},
        "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/x"}}]}},
    {"type": "user", "uuid": "u2", "parentUuid": "a1", "sessionId": "alpha", "timestamp": "2026-01-01T00:00:06Z", "message": {
        "role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "done"}], "is_error": True}]}},
    {"type": "assistant", "uuid": "a2", "sessionId": "alpha", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t2", "name": "Bash", "input": {}}]}},
    {"type": "system", "subtype": "compact_boundary", "sessionId": "alpha"},
    {"type": "user", "isCompactSummary": True, "sessionId": "alpha", "message": {"role": "user", "content": "so far"}},
]


def test_claude_lines(spark, tmp_path):
    odd = ["", "not json", "[1, 2]", "null", "7", '{"type": "user"', '{"type": "user", "message": null, "sessionId": "alpha"}']
    (tmp_path / "s.jsonl").write_text("\r\n".join([*(json.dumps(x) for x in CLAUDE), *odd]))
    rows = J.read_claude(spark, str(tmp_path)).orderBy("msg_idx").collect()
    assert [r.kind for r in rows] == ["prompt", "reply", "tool_result", "reply", "compaction_boundary", "compaction_summary", "prompt"]
    assert [r.role for r in rows[:3]] == ["user", "assistant", "tool"] and rows[0].content[0].text == "fix it"
    assert [b.type for b in rows[1].content] == ["thinking", "text", "tool_use"] and json.loads(rows[1].content[2].input) == {"file_path": "/x"}
    assert (rows[1].usage.input, rows[1].usage.output, rows[1].usage.cache_read, rows[1].usage.cache_creation) == (3, 7, 2, None)
    assert rows[2].content[0].text == "done" and rows[6].content == []
    events = {r.call_id: (r.tool, r.failed) for r in J.tool_events(J.read_claude(spark, str(tmp_path))).collect()}
    assert events == {"t1": ("Edit", True), "t2": ("Bash", None)}
    assert J.bad_lines(spark, str(tmp_path)).count() == 5


def test_codex_lines(spark, tmp_path):
    items = [
        {"type": "session_meta", "payload": {"id": "c1", "cwd": "/w"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hello"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "call_id": "k", "name": "shell", "arguments": "{}"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "k", "output": "fine"}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 2}}}},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, items)))
    rows = J.read_codex(spark, str(tmp_path)).orderBy("msg_idx").collect()
    assert [(r.session_id, r.kind, r.role) for r in rows] == [("c1", "prompt", "user"), ("c1", "reply", "assistant"), ("c1", "tool_result", "tool"), ("c1", "notice", "system")]
    assert rows[0].content[0].text == "hello" and rows[2].content[0].tool_use_id == "k"
    assert (rows[3].usage.input, rows[3].usage.cache_read, rows[3].usage.output) == (6, 4, 2)


def test_opensession_documents(spark, tmp_path):
    doc = {"open_session": "1", "id": "o1", "messages": [{"role": "user", "kind": "prompt", "origin": "human", "content": [{"type": "text", "text": "hi"}], "usage": {"input_tokens": 1}}, {"role": "assistant", "kind": "reply", "content": "yo"}]}
    (tmp_path / "o.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "bad.json").write_text("{")
    rows = J.read_opensession(spark, str(tmp_path)).orderBy("msg_idx").collect()
    assert [(r.session_id, r.msg_idx, r.role, r.content[0].text) for r in rows] == [("o1", 0, "user", "hi"), ("o1", 1, "assistant", "yo")]
    assert rows[0].usage.input == 1 and rows[1].usage is None


def test_sqlite_source(spark, tmp_path):
    paths = []
    for k in range(2):
        paths.append(str(tmp_path / f"{k}.db"))
        with sqlite3.connect(paths[-1]) as db:
            db.execute("CREATE TABLE messages (session_id TEXT, role TEXT, content TEXT)")
            db.executemany("INSERT INTO messages VALUES (?, ?, ?)", [(f"s{k}", "user", "a"), (f"s{k}", "assistant", None)])
    spark.dataSource.register(SqliteSource)
    read = spark.read.format("sqlite").option("paths", ",".join(paths)).option("query", "SELECT session_id, role, content FROM messages")
    rows = read.schema("session_id string, role string, content string").load().orderBy("session_id", "role").collect()
    assert [tuple(r) for r in rows] == [("s0", "assistant", None), ("s0", "user", "a"), ("s1", "assistant", None), ("s1", "user", "a")]


def test_emit_round_trip(spark, tmp_path):
    from threadloom.sources import emit

    (tmp_path / "a").mkdir()
    (tmp_path / "a/s.jsonl").write_text("\n".join(json.dumps(x) for x in CLAUDE))
    first = J.read_claude(spark, str(tmp_path / "a")).cache()
    emit.claude_lines(first).orderBy("msg_idx").coalesce(1).select("value").write.text(str(tmp_path / "b"))
    again = J.read_claude(spark, str(tmp_path / "b"))
    columns = ["session_id", "msg_idx", "id", "parent_id", "role", "kind", "origin", "ts", "model", "content"]
    assert again.select(columns).orderBy("msg_idx").collect() == first.select(columns).orderBy("msg_idx").collect()
    assert emit.fidelity(first, again).where("lost > 0").count() == 0
    assert emit.markdown(first).first().value.startswith("## user\n\nfix it\n\n## assistant\n\nhm\n\nok")


def test_event_rows_and_affordances(spark, tmp_path):
    from pyspark.sql import functions as F

    from threadloom.operators import tools as O

    patch = "*** Begin Patch\n*** Update File: a.py\n*** Add File: b.py\n"
    calls = [
        ("s", 0, "1", "Edit", '{"file_path": "/x"}', False), ("s", 1, "2", "Bash", '{"command": "ls"}', True), ("s", 2, "3", "apply_patch", json.dumps({"input": patch}), None),
        ("s", 3, "4", "ns:Read", '{"path": "/y"}', False), ("s", 4, "5", "Grep", '{"pattern": "z"}', False), ("s", 5, "6", "TodoWrite", "{}", False), ("s", 6, "7", None, None, None),
    ]
    df = spark.createDataFrame(calls, "session_id string, msg_idx int, call_id string, tool string, input string, failed boolean").withColumn("ts", F.lit(None).cast("timestamp"))
    rows = {(r.call_id, r.kind, r.target, r.call) for r in O.event_rows(df).collect()}
    assert rows == {
        ("1", "file_edit", "/x", True), ("2", "command", "ls", True), ("2", "error", None, False), ("3", "file_edit", "a.py", True), ("3", "file_edit", "b.py", False),
        ("4", "file_read", "/y", True), ("5", "tool", "z", True), ("6", "tool", None, True), ("7", "tool", None, True),
    }
    kinds = [r.a and r.a.kind for r in df.orderBy("msg_idx").select(O.affordance(F.col("tool")).alias("a")).collect()]
    assert kinds == [None, None, None, None, None, "plan", None]
    said = spark.createDataFrame([("[main 1a2b3c4] x", "1A2B3C4D5E"), ("zz1a2b3c4", "1a2b3c4"), (None, "1a2b3c4")], "o string, s string")
    assert [r[0] for r in said.select(O.names_commit(F.col("o"), F.col("s"))).collect()] == [True, False, None]
    tree = [("s", 0, "a", None), ("s", 1, "b", "a"), ("s", 2, "c", "a"), ("s", 3, "d", "c")]
    branch = O.active_branch(spark.createDataFrame(tree, "session_id string, msg_idx int, id string, parent_id string")).collect()
    assert {r.id for r in branch} == {"a", "c", "d"}


def said(messages):
    return [(r.session_id, r.role, r.kind, [(b.type, b.text, b.name, b.tool_use_id or b.id) for b in r.content]) for r in messages.orderBy("session_id", "msg_idx").collect()]


def test_gemini_and_qwen(spark, tmp_path):
    doc = {"sessionId": "g", "messages": [
        {"id": "1", "type": "user", "content": "hi", "timestamp": "2025-01-01T00:00:00Z"},
        {"id": "2", "type": "gemini", "content": [{"text": "ok"}], "model": "m", "thoughts": [{"subject": "s", "description": "d"}],
         "toolCalls": [{"id": "c", "name": "run", "args": {"a": 1}, "result": [{"x": 1}], "status": "error"}], "tokens": {"input": 10, "output": 2, "cached": 4}},
    ]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{")
    got = D.read_gemini(spark, str(tmp_path))
    assert said(got) == [("g", "user", "prompt", [("text", "hi", None, None)]), ("g", "assistant", "reply", [("thinking", "s: d", None, None), ("text", "ok", None, None), ("tool_use", None, "run", "c"), ("tool_result", '[{"x":1}]', None, "c")])]
    assert [r.usage.input for r in got.where("usage IS NOT NULL").collect()] == [6]
    assert [r.failed for r in J.tool_events(got).collect()] == [True]
    lines = [{"uuid": "1", "sessionId": "q", "type": "user", "message": {"parts": [{"text": "do"}]}}, {"uuid": "2", "parentUuid": "1", "sessionId": "q", "type": "assistant", "message": {"parts": [{"text": "hm", "thought": True}, {"functionCall": {"id": "f", "name": "ls", "args": {}}}]}},
             {"uuid": "3", "parentUuid": "2", "sessionId": "q", "type": "tool_result", "message": {"parts": [{"functionResponse": {"id": "f", "name": "ls", "response": {"o": "x"}}}]}}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n[1]\nnone")
    got = D.read_qwen(spark, str(tmp_path / "q.jsonl"))
    assert [(r[1], r[3]) for r in said(got)] == [("user", [("text", "do", None, None)]), ("assistant", [("thinking", "hm", None, None), ("tool_use", None, "ls", "f")]), ("tool", [("tool_result", '{"o":"x"}', None, "f")])]
    assert [r.parent_id for r in got.orderBy("msg_idx").collect()] == [None, "1", "2"]


def test_pi_kimi_cline(spark, tmp_path):
    lines = [{"type": "session", "id": "p"}, {"type": "message", "id": "1", "message": {"role": "user", "content": [{"type": "text", "text": "go"}]}},
             {"type": "message", "id": "2", "parentId": "1", "message": {"role": "assistant", "content": [{"type": "toolCall", "id": "t", "name": "sh", "arguments": {}}], "usage": {"input": 3, "output": 1}}},
             {"type": "message", "id": "3", "parentId": "2", "message": {"role": "toolResult", "toolCallId": "t", "content": "out", "isError": False}}, {"type": "compaction", "id": "4", "parentId": "3", "summary": "so far"}, {"type": "model_change", "id": "5"}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = said(D.read_pi(spark, str(tmp_path / "p.jsonl")))
    assert [(r[1], r[2]) for r in got] == [("user", "prompt"), ("assistant", "reply"), ("tool", "tool_result"), ("system", "compaction_summary")] and {r[0] for r in got} == {"p"}
    assert got[2][3] == [("tool_result", "out", None, "t")] and got[3][3] == [("text", "so far", None, None)]
    (tmp_path / "k").mkdir()
    lines = [{"role": "_system_prompt", "content": "be"}, {"role": "user", "content": "x"}, {"role": "assistant", "content": [{"type": "text", "text": "y"}], "tool_calls": [{"id": "a", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "a", "content": "z"}, {"role": "_checkpoint", "id": 1}]
    (tmp_path / "k" / "context.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = said(D.read_kimi(spark, str(tmp_path / "k" / "context.jsonl")))
    assert {r[0] for r in got} == {"k"} and [r[2] for r in got] == ["system_prompt", "prompt", "reply", "tool_result", "notice"]
    assert got[2][3] == [("text", "y", None, None), ("tool_use", None, "f", "a")] and got[4][3] == []
    (tmp_path / "17").mkdir()
    (tmp_path / "17" / "api_conversation_history.json").write_text(json.dumps([{"role": "user", "content": "a"}, {"role": "assistant", "content": [{"type": "tool_use", "id": "u", "name": "n", "input": {}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u", "content": [{"type": "text", "text": "r"}], "is_error": True}]}]))
    got = said(D.read_cline(spark, str(tmp_path / "17")))
    assert [r[1] for r in got] == ["user", "assistant", "tool"] and got[2][3] == [("tool_result", "r", None, "u")] and got[0][0] == "17"


def test_exports_continue_lmstudio_and_discovery(spark, tmp_path):
    node = lambda parent, role, text, to="all": {"parent": parent, "message": {"id": "m", "author": {"role": role}, "content": {"parts": [text]}, "recipient": to, "create_time": 1.5}}
    talk = {"conversation_id": "c", "current_node": "d", "default_model_slug": "s", "mapping": {"a": {"parent": None}, "b": node("a", "user", "q"), "x": node("b", "assistant", "dropped branch"), "c": node("b", "assistant", "ls", "python"), "d": node("c", "assistant", "done")}}
    (tmp_path / "gpt.json").write_text(json.dumps([talk]))
    got = said(D.read_chatgpt_export(spark, str(tmp_path / "gpt.json")))
    assert [(r[1], r[3][0][:3]) for r in got] == [("user", ("text", "q", None)), ("assistant", ("tool_use", None, "python")), ("assistant", ("text", "done", None))]
    (tmp_path / "cl.json").write_text(json.dumps([{"uuid": "e", "chat_messages": [{"uuid": "1", "sender": "human", "text": "t", "content": []}, {"uuid": "2", "sender": "assistant", "content": [{"type": "text", "text": "u"}], "created_at": "2025-01-02T00:00:00Z"}]}]))
    assert [(r[1], r[3][0][1]) for r in said(D.read_claude_export(spark, str(tmp_path / "cl.json")))] == [("user", "t"), ("assistant", "u")]
    item = {"message": {"role": "assistant", "content": "w", "toolCalls": [{"id": "1", "function": {"name": "f", "arguments": "{}"}}]}, "toolCallStates": [{"toolCallId": "1", "status": "errored", "output": []}]}
    (tmp_path / "co.json").write_text(json.dumps({"sessionId": "h", "history": [{"message": {"role": "user", "content": [{"type": "text", "text": "v"}]}}, item]}))
    got = said(D.read_continue(spark, str(tmp_path / "co.json")))
    assert [b[0] for b in got[1][3]] == ["text", "tool_use", "tool_result"] and got[0][3][0][1] == "v"
    steps = [{"type": "contentBlock", "style": {"type": "thinking"}, "content": [{"type": "text", "text": "hm"}]}, {"type": "status"}, {"type": "contentBlock", "content": [{"type": "text", "text": "yes"}], "genInfo": {"identifier": "m", "stats": {"promptTokensCount": 5, "predictedTokensCount": 2}}}]
    turns = [{"versions": [{"type": "singleStep", "role": "user", "content": [{"type": "text", "text": "old"}]}, {"type": "singleStep", "role": "user", "content": [{"type": "text", "text": "new"}]}], "currentlySelected": 1}, {"versions": [{"type": "multiStep", "role": "assistant", "steps": steps}]}]
    (tmp_path / "9.conversation.json").write_text(json.dumps({"messages": turns}))
    got = D.read_lmstudio(spark, str(tmp_path / "9.conversation.json"))
    assert [[b[1] for b in r[3]] for r in said(got)] == [["new"], ["hm", "yes"]] and got.where("model = 'm'").count() == 1
    stores = [("lmstudio", str(tmp_path / "9.conversation.json")), ("continue", str(tmp_path / "co.json")), ("nope", "x"), ("qwen", str(tmp_path / "absent"))]
    found, failed = S.discover_all(spark, stores)
    assert set(failed) == {"x", str(tmp_path / "absent")}
    got = {r.session_id: (r.harness, r.title, r.models, r.n_messages, r.input) for r in S.session_rows(found).collect()}
    assert got == {"9": ("lmstudio", "new", ["m"], 2, 5), "h": ("continue", "v", [], 2, None)}


def test_emitters_read_back(spark, tmp_path):
    from threadloom.sources import emit

    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, CLAUDE)))
    first = J.read_claude(spark, str(tmp_path / "c.jsonl"))
    told = lambda m: [[(b.type, b.text, b.name, b.id or b.tool_use_id) for b in r.content] for r in m.orderBy("session_id", "msg_idx").collect()]
    for name, out, read in (("o", emit.opensession_documents, J.read_opensession), ("g", emit.gemini_documents, D.read_gemini)):
        out(first).select("value").write.text(str(tmp_path / name), lineSep="\n")
        for k, r in enumerate(out(first).collect()):
            (tmp_path / f"{name}{k}.json").write_text(r.value)
        again = read(spark, str(tmp_path / f"{name}*.json"))
        kinds = lambda m: [[b[0] for b in r] for r in told(m)]
        assert kinds(again) == kinds(first)
        if name == "o":
            assert told(again) == told(first) and emit.field_fidelity(first, again).where("lost > 0").count() == 0
            assert [r.usage for r in again.orderBy("session_id", "msg_idx").collect()][1].input == 3
        else:
            assert {r.field for r in emit.field_fidelity(first, again).where("lost > 0").collect()} <= {"parent_id", "usage", "ts"}
    (tmp_path / "q.jsonl").write_text("\n".join(r.value for r in emit.qwen_lines(first).orderBy("session_id", "msg_idx").collect()))
    again = D.read_qwen(spark, str(tmp_path / "q.jsonl"))
    assert [[b[0] for b in r] for r in told(again)] == [[b[0] for b in r] for r in told(first)] and emit.field_fidelity(first, again, ("id", "parent_id", "ts")).where("lost > 0").count() == 0
    for r in emit.cline_documents(first).collect():
        (tmp_path / r.session_id).mkdir()
        (tmp_path / r.session_id / "h.json").write_text(r.value)
    again = D.read_cline(spark, str(tmp_path / "*" / "h.json"))
    assert again.count() == first.where("role <> 'system'").count()
