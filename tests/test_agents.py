"""Readers of more agents against small written files, and codex rollouts in all their forms."""

import json

import zstandard

from threadloom.sources import agents as A
from threadloom.sources import discover as S
from threadloom.sources import jsonl as J

ITEMS = [
    {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}]}, {"type": "function_call", "call_id": "c", "name": "shell", "arguments": "{\"command\": \"ls\"}"},
    {"type": "function_call_output", "call_id": "c", "output": "a b"}, {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]}, {"type": "odd"},
]


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def shape(rows):
    return [(r.role, r.kind, [(b.type, b.text or b.name) for b in r.content]) for r in rows]


WANT = [
    ("user", "prompt", [("text", "go")]), ("assistant", "reply", [("tool_use", "shell")]), ("tool", "tool_result", [("tool_result", "a b")]), ("assistant", "reply", [("text", "done")]), ("system", "notice", []),
]


def test_codex_compressed_and_documents(spark, tmp_path):
    now = [{"type": "session_meta", "payload": {"id": "new"}}, *[{"type": "response_item", "payload": i} for i in ITEMS]]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "rollout-1.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress("\n".join(map(json.dumps, now)).encode()))
    rows = J.read_codex(spark, str(tmp_path / "z")).orderBy("msg_idx").collect()
    assert shape(rows) == WANT and {r.session_id for r in rows} == {"new"}
    write(tmp_path / "old" / "rollout-a.json", [{"session": {"id": "old", "timestamp": "2025-05-05T19:24:54Z"}, "items": ITEMS}])
    write(tmp_path / "old" / "rollout-b.json", [json.dumps(ITEMS)])
    for name, bad in (("c", '{"session": {"id": "x"}, "items": ['), ("d", ""), ("e", '{"session": {"id": "y"}}'), ("f", '{"items": 3}')):
        (tmp_path / "old" / f"rollout-{name}.json").write_text(bad)
    found = A.read_codex_document(spark, str(tmp_path / "old")).orderBy("session_id", "msg_idx").collect()
    assert shape([r for r in found if r.session_id == "old"]) == WANT and shape([r for r in found if r.session_id == "rollout-b"]) == WANT and len(found) == 10
    assert found[0].ts is not None and J.tool_events(A.read_codex_document(spark, str(tmp_path / "old"))).count() == 2


def test_openclaw(spark, tmp_path):
    use = {"type": "toolCall", "id": "t", "name": "exec", "arguments": {"command": "ls"}}
    v3 = [
        {"type": "session", "version": 3, "id": "s3", "timestamp": "2026-01-01T00:00:00Z"}, {"type": "message", "id": "a", "parentId": None, "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "user", "content": "hi"}},
        {"type": "message", "id": "b", "parentId": "a", "message": {"role": "assistant", "timestamp": 1767225602000, "model": "m", "content": [{"type": "thinking", "thinking": "hm"}, use], "usage": {"input": 1, "output": 2, "cacheRead": 3, "cacheWrite": 4}}},
        {"type": "message", "id": "c", "parentId": "b", "message": {"role": "toolResult", "toolCallId": "t", "isError": True, "content": [{"type": "text", "text": "no"}]}},
        {"type": "message", "id": "d", "parentId": "a", "message": {"role": "bashExecution", "command": "pwd", "output": "/x"}}, {"type": "message", "id": "e", "parentId": "d", "message": {"role": "compactionSummary", "summary": "so far"}},
        {"type": "message", "id": "f", "parentId": "e", "message": {"role": "custom", "customType": "openclaw.cache-ttl"}}, "torn {",
    ]
    v1 = [{"type": "session", "version": 1, "id": "s1"}, {"type": "message", "id": "x", "message": {"role": "user", "content": "a"}}, {"type": "message", "id": "y", "message": {"role": "assistant", "content": []}}]
    write(tmp_path / "one.jsonl", v3)
    write(tmp_path / "two.jsonl", v1)
    rows = A.read_openclaw(spark, str(tmp_path)).orderBy("session_id", "msg_idx").collect()
    new = [r for r in rows if r.session_id == "s3"]
    assert [r.kind for r in new] == ["prompt", "reply", "tool_result", "prompt", "compaction_summary", "notice"] and [r.parent_id for r in new] == [None, "a", "b", "a", "d", "e"]
    assert tuple(new[1].usage)[1:] == (1, 2, 3, 4) and new[1].ts is not None and new[3].content[0].text == "$ pwd\n/x" and new[2].content[0].is_error
    assert [(r.id, r.parent_id) for r in rows if r.session_id == "s1"] == [("x", None), ("y", "x")]


def test_grok(spark, tmp_path):
    write(tmp_path / "cwd" / "sess" / "chat_history.jsonl", [
        {"type": "system", "content": "be good"}, {"type": "user", "content": [{"type": "text", "text": "rules"}], "synthetic_reason": "project_instructions"}, {"type": "user", "content": [{"type": "text", "text": "hi"}]},
        {"type": "reasoning", "id": "r", "summary": [{"type": "summary_text", "text": "think"}]}, {"type": "reasoning", "summary": []},
        {"type": "assistant", "content": "", "model_id": "g", "tool_calls": [{"id": "1", "name": "grep", "arguments": "{\"q\": 1}"}, {"id": "2", "name": "read", "arguments": {"f": "x"}}]},
        {"type": "tool_result", "tool_call_id": "1", "content": "out"}, {"type": "assistant", "content": "ok", "reasoning": {"text": "inner"}}, {"type": "reasoning", "summary": [{"text": "late"}]}, {"type": "other"},
    ])
    rows = A.read_grok(spark, str(tmp_path / "cwd" / "*")).orderBy("msg_idx").collect()
    assert {r.session_id for r in rows} == {"sess"}
    assert shape(rows) == [
        ("system", "system_prompt", [("text", "be good")]), ("user", "injected_context", [("text", "rules")]), ("user", "prompt", [("text", "hi")]),
        ("assistant", "reply", [("thinking", "think"), ("thinking", None), ("tool_use", "grep"), ("tool_use", "read")]), ("tool", "tool_result", [("tool_result", "out")]),
        ("assistant", "reply", [("thinking", "inner"), ("text", "ok")]), ("system", "notice", [("thinking", "late")]),
    ]
    assert [json.loads(b.input) for b in rows[3].content[2:]] == [{"q": 1}, {"f": "x"}]


def test_kimi_code(spark, tmp_path):
    loop = lambda **e: {"type": "context.append_loop_event", "event": e, "time": 1767225600000}
    log = [
        {"type": "metadata", "protocol_version": "1.5"}, {"type": "profile.bind", "modelAlias": "k2"}, {"type": "context.append_message", "message": {"role": "user", "content": [{"type": "text", "text": "go"}], "origin": {"kind": "user"}}},
        {"type": "context.append_message", "message": {"role": "user", "content": [{"type": "text", "text": "note"}], "origin": {"kind": "task"}}}, loop(type="step.begin", step=1), loop(type="content.part", part={"type": "think", "think": "hm"}),
        loop(type="content.part", part={"type": "think", "think": ""}), loop(type="content.part", part={"type": "text", "text": "I look"}), loop(type="tool.call", toolCallId="c", name="Bash", args={"command": "ls"}),
        loop(type="tool.result", toolCallId="c", result={"output": "x", "isError": True}), loop(type="step.end", messageId="m1", usage={"inputOther": 1, "output": 2, "inputCacheRead": 3, "inputCacheCreation": 4}),
        {"type": "context.apply_compaction", "summary": "short"}, loop(type="step.begin", step=2), loop(type="content.part", part={"type": "text", "text": "cut"}), {"type": "turn.cancel"},
    ]
    write(tmp_path / "session_1" / "agents" / "main" / "wire.jsonl", log)
    write(tmp_path / "session_1" / "agents" / "agent-2" / "wire.jsonl", [loop(type="step.begin"), loop(type="content.part", part={"type": "text", "text": "sub"})])
    rows = A.read_kimi_code(spark, str(tmp_path / "session_1" / "agents" / "*" / "wire.jsonl")).orderBy("session_id", "msg_idx").collect()
    assert shape([r for r in rows if r.session_id == "session_1/agent-2"]) == [("assistant", "reply", [("text", "sub")])]
    main = [r for r in rows if r.session_id == "session_1"]
    assert shape(main) == [
        ("user", "prompt", [("text", "go")]), ("user", "injected_context", [("text", "note")]), ("assistant", "reply", [("thinking", "hm"), ("text", "I look"), ("tool_use", "Bash")]), ("tool", "tool_result", [("tool_result", "x")]),
        ("system", "compaction_boundary", []), ("system", "compaction_summary", [("text", "short")]), ("assistant", "reply", [("text", "cut")]), ("system", "notice", [("text", None)]),
    ]
    assert tuple(main[2].usage) == ("m1", 1, 2, 3, 4) and main[6].usage is None and main[2].model == "k2" and main[1].origin == "scheduler"


def test_all_of_them_in_one_table(spark, tmp_path):
    write(tmp_path / "old" / "a.json", [{"session": {"id": "old"}, "items": ITEMS}])
    write(tmp_path / "g" / "s" / "chat_history.jsonl", [{"type": "user", "content": "hi"}])
    found, failed = S.discover_all(spark, [("codex-2025", str(tmp_path / "old")), ("grok", str(tmp_path / "g" / "s"))])
    assert not failed and {(r.harness, r.n) for r in found.groupBy("harness").count().withColumnRenamed("count", "n").collect()} == {("codex-2025", 5), ("grok", 1)}


MESSAGES = [
    ("s", 0, "a", None, "user", "prompt", "human", "2026-01-01 00:00:00", None, [("text", "say \"hi\" <b>\nto bob@example.com", None, None, None, None, None)], None),
    ("s", 1, "b", "a", "assistant", "reply", "model", "2026-01-01 00:00:01", "m", [("thinking", "hm", None, None, None, None, None), ("text", "ok", None, None, None, None, None), ("tool_use", None, "c1", "Bash", "{\"command\":\"ls\"}", None, None)], ("r", 1, 2, 3, 4)),
    ("s", 2, "c", "b", "tool", "tool_result", "harness", "2026-01-01 00:00:02", None, [("tool_result", "x", None, None, None, "c1", True), ("tool_result", "y", None, None, None, "c2", False)], None),
    ("t", 0, "d", None, "user", "prompt", "human", "2026-01-02 00:00:00", None, [("text", "other", None, None, None, None, None)], None),
]


def told(rows):
    """Blocks in order without what a shape may leave out."""
    return [(r.session_id, b.type, b.text, b.id, b.name, b.tool_use_id) for r in sorted(rows, key=lambda r: (r.session_id, r.msg_idx)) for b in r.content if b.type != "text" or b.text]


def test_emitters_of_more_agents_read_back(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from threadloom.sources import documents as D
    from threadloom.sources import emit

    schema = f"session_id string, msg_idx long, id string, parent_id string, role string, kind string, origin string, ts string, model string, content array<{J.BLOCK}>, usage {J.USAGE}"
    first = spark.createDataFrame(MESSAGES, schema).withColumn("ts", F.to_timestamp("ts"))
    want = told(first.collect())
    paths = {}
    for name in ("codex", "openclaw", "grok", "continue", "lmstudio"):
        paths[name] = str(tmp_path / name)
        emit.write_sessions(emit.emitted(first, name), paths[name])
        files = list((tmp_path / name / "session_id=s").glob("*.txt"))
        assert len(files) == 1
    assert told(J.read_codex(spark, paths["codex"]).drop("origin").collect()) == want
    claw = A.read_openclaw(spark, paths["openclaw"])
    assert told(claw.collect()) == want
    s = claw.where("session_id = 's'").orderBy("msg_idx").collect()
    assert [(r.id, r.parent_id) for r in s] == [("a", None), ("b", "a"), ("c.1", "b"), ("c", "c.1")] and tuple(s[1].usage) == ("r", 1, 2, 3, 4) and s[2].content[0].is_error
    assert emit.field_fidelity(first, claw).where("lost > 0").count() == 0
    grok = told(A.read_grok(spark, paths["grok"] + "/*").collect())
    assert [(x[0].removeprefix("session_id="), *x[1:]) for x in grok] == want
    assert told(D.read_continue(spark, paths["continue"]).collect()) == [x for x in want if x[1] != "thinking"]
    assert sorted(x[1:3] for x in told(D.read_lmstudio(spark, paths["lmstudio"]).collect())) == sorted(x[1:3] for x in want if x[1] in ("text", "thinking"))
    with pytest.raises(ValueError, match="can't write"):
        emit.emitted(first, "cursor")


def test_share_page(spark):
    from threadloom.sources import emit

    frame = spark.createDataFrame([(m[0], m[1], m[4], m[9]) for m in MESSAGES], f"session_id string, msg_idx long, role string, content array<{J.BLOCK}>")
    pages = {r.session_id: r.value for r in emit.share_pages(frame).collect()}
    assert set(pages) == {"s", "t"} and "bob@example.com" not in pages["s"] and "say &quot;hi&quot; &lt;b&gt;\nto [REDACTED:email]" in pages["s"]
    assert pages["s"].count("<section") == 3 and "<summary>call Bash</summary><pre>{&quot;command&quot;:&quot;ls&quot;}" in pages["s"] and pages["s"].index("ok") < pages["s"].index("call Bash")
    assert "http" not in pages["s"] and emit.share_pages(frame.limit(0)).count() == 0
