"""SQLite stores as their agents lay them out."""

import json
import sqlite3

import pytest
import zstandard
from pyspark.sql.datasource import EqualTo, StringStartsWith

from threadloom.sources import stores
from threadloom.sources.jsonl import MESSAGE_COLUMNS, tool_events
from threadloom.sources.sqlite import PushingReader, read_table


def store(path, *statements):
    with sqlite3.connect(path) as db:
        for sql, *rows in statements:
            db.executemany(sql, rows) if rows else db.execute(sql)
    return str(path)


def told(df):
    assert df.columns == MESSAGE_COLUMNS
    return [(r.session_id, r.msg_idx, r.role, r.kind, [(b.type, b.text or b.name or b.input) for b in r.content]) for r in df.orderBy("session_id", "msg_idx").collect()]


@pytest.mark.parametrize("push", ["false", "true"])
def test_row_ranges_filters_and_missing_columns(spark, tmp_path, push):
    a = store(tmp_path / "a.db", ("CREATE TABLE t (k TEXT, n INTEGER, x, b BLOB)",), ("INSERT INTO t VALUES (?, ?, ?, ?)", *[(f"key{i:03}", i, str(i), zstandard.compress(f"z{i}".encode())) for i in range(250)]))
    b = store(tmp_path / "b.db", ("CREATE TABLE t (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID",), ("INSERT INTO t VALUES (?, ?)", ("other", 7), ("none", None)))
    c = store(tmp_path / "c.db", ("CREATE TABLE elsewhere (k TEXT)",))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
    try:
        t = read_table(spark, [a, b, c], "t", "k string, n long, x long, b string, gone string", rows="100", zstd="b")
        assert t.rdd.getNumPartitions() == 4
        assert t.count() == 252 and t.where("gone IS NOT NULL").count() == 0
        assert sorted(r.k for r in t.where("k LIKE 'key00%' AND n >= 3 AND n IN (2, 3, 4, 7)").collect()) == ["key003", "key004", "key007"]
        assert [r.b for r in t.where("n = 249").collect()] == ["z249"] and t.where("n = 7").count() == 2 and t.where("n IS NULL").count() == 1
        reader = PushingReader({"paths": a, "table": "t"}, t.schema)
        assert reader.pushFilters([EqualTo(("n",), 7), EqualTo(("x",), 5), StringStartsWith(("k",), "key")])  # Spark tests them again
        with sqlite3.connect(a) as db:
            assert reader.statement(db, 1, 9)[0].endswith(' WHERE rowid BETWEEN ? AND ? AND "n" = ? AND "k" >= ? AND substr("k", 1, length(?)) = ?')
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_broken_frames_and_inferred_schema(spark, tmp_path):
    a = store(tmp_path / "a.db", ("CREATE TABLE t (k TEXT, n INTEGER, r REAL, b BLOB)",), ("INSERT INTO t VALUES (?, ?, ?, ?)", ("x", 1, 0.5, b"\x28\xb5\x2f\xfdbroken"), ("y", 2, None, "plain")))
    assert [tuple(r) for r in read_table(spark, [a], "t", "k string, b string", zstd="b").orderBy("k").collect()] == [("x", None), ("y", "plain")]
    read = spark.read.format("sqlite").options(paths=a, table="t").load()
    assert dict(read.dtypes) == {"k": "string", "n": "bigint", "r": "double", "b": "binary"}


def test_opencode(spark, tmp_path):
    part = lambda i, m, **p: (i, m, json.dumps(p))
    path = store(
        tmp_path / "o.db", ("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, data TEXT)",), ("CREATE TABLE part (id TEXT, message_id TEXT, data TEXT)",),
        ("INSERT INTO message VALUES (?, ?, ?, ?)", ("m2", "s", 1767225601000, json.dumps({"role": "assistant", "modelID": "big", "tokens": {"input": 5, "output": 2, "cache": {"read": 1, "write": 0}}})), ("m1", "s", 1767225600000, '{"role":"user"}'), ("m3", "s", 1767225602000, "no json"), ("m4", "s", 1767225603000, '{"role":"assistant","error":{"name":"E"}}')),
        ("INSERT INTO part VALUES (?, ?, ?)", part("p1", "m1", type="text", text="hi"), part("p3", "m2", type="tool", tool="bash", callID="c", state={"status": "error", "input": {"command": "ls"}, "error": "no"}), part("p2", "m2", type="reasoning", text="hm"), part("p4", "m2", type="step-start")),
    )
    got = stores.read_opencode(spark, [path])
    assert told(got) == [
        ("s", 0, "user", "prompt", [("text", "hi")]), ("s", 1, "assistant", "reply", [("thinking", "hm"), ("tool_use", "bash"), ("tool_result", "no")]), ("s", 2, None, "notice", []), ("s", 3, "assistant", "error", []),
    ]
    assert [(r.call_id, r.tool, r.input, r.failed) for r in tool_events(got).collect()] == [("c", "bash", '{"command":"ls"}', True)]
    second = got.where("msg_idx = 1").first()
    assert second.usage.input == 5 and second.usage.cache_read == 1 and second.model == "big" and second.ts.second == 1


def test_goose(spark, tmp_path):
    row = lambda i, role, content, meta=None: (i, f"g{i}", "s", role, json.dumps(content), 1767225600 + i, json.dumps(meta) if meta else None)
    path = store(
        tmp_path / "g.db", ("CREATE TABLE messages (id INTEGER PRIMARY KEY, message_id TEXT, session_id TEXT, role TEXT, content_json TEXT, created_timestamp INTEGER, metadata_json TEXT)",),
        ("INSERT INTO messages VALUES (?, ?, ?, ?, ?, ?, ?)", row(1, "user", [{"type": "text", "text": "go"}]), row(2, "user", [{"type": "text", "text": "ctx"}], {"userVisible": False}),
         row(3, "assistant", [{"type": "toolRequest", "id": "c", "toolCall": {"status": "success", "value": {"name": "sh", "arguments": {"x": 1}}}}], {"inference": {"requestedModel": "m"}, "usage": {"inputTokens": 3}}),
         row(4, "user", [{"type": "toolResponse", "id": "c", "toolResult": {"status": "success", "value": {"content": [{"type": "text", "text": "ok"}], "isError": False}}}]),
         row(5, "user", [{"type": "toolResponse", "id": "d", "toolResult": {"status": "success", "value": [{"type": "text", "text": "bare"}]}}]), row(6, "assistant", [{"type": "error", "message": "bad"}])),
    )
    got = stores.read_goose(spark, [path])
    assert told(got) == [
        ("s", 0, "user", "prompt", [("text", "go")]), ("s", 1, "system", "injected_context", [("text", "ctx")]), ("s", 2, "assistant", "reply", [("tool_use", "sh")]),
        ("s", 3, "tool", "tool_result", [("tool_result", "ok")]), ("s", 4, "tool", "tool_result", [("tool_result", "bare")]), ("s", 5, "assistant", "error", [("error", "bad")]),
    ]
    assert [(r.call_id, r.failed) for r in tool_events(got).collect()] == [("c", False)]


def test_hermes_with_and_without_newer_columns(spark, tmp_path):
    calls = json.dumps([{"id": "c1", "type": "function", "function": {"name": "web", "arguments": '{"q":"x"}'}}])
    old = store(tmp_path / "old.db", ("CREATE TABLE messages (id INTEGER PRIMARY KEY, session_id TEXT, role TEXT, content TEXT, tool_calls TEXT, tool_call_id TEXT, tool_name TEXT, timestamp REAL)",), ("INSERT INTO messages (session_id, role, content, tool_calls, tool_call_id, timestamp) VALUES (?, ?, ?, ?, ?, ?)", ("a", "user", '\x00json:[{"type":"text","text":"multi"}]', None, None, 1.0), ("a", "assistant", "", calls, None, 2.0), ("a", "tool", "res", None, "c1", 3.0)))
    new = store(tmp_path / "new.db", ("CREATE TABLE messages (id INTEGER PRIMARY KEY, session_id TEXT, role TEXT, content TEXT, timestamp REAL, reasoning TEXT, active INTEGER, compacted INTEGER, _compressed_summary INTEGER)",), ("INSERT INTO messages (session_id, role, content, reasoning, active, compacted, _compressed_summary) VALUES (?, ?, ?, ?, ?, ?, ?)", ("b", "user", "old", None, 0, 1, 0), ("b", "user", "rewound", None, 0, 0, 0), ("b", "user", "sum", None, 1, 0, 1), ("b", "assistant", "yes", "why", 1, 0, 0)))
    assert told(stores.read_hermes(spark, [old, new])) == [
        ("a", 0, "user", "prompt", [("text", "multi")]), ("a", 1, "assistant", "reply", [("tool_use", "web")]), ("a", 2, "tool", "tool_result", [("tool_result", "res")]),
        ("b", 0, "user", "prompt", [("text", "old")]), ("b", 1, "user", "compaction_summary", [("text", "sum")]), ("b", 2, "assistant", "reply", [("thinking", "why"), ("text", "yes")]),
    ]


def test_zed_generations(spark, tmp_path):
    old = {"version": "0.2.0", "messages": [{"id": 0, "role": "user", "segments": [{"type": "text", "text": "q"}]}, {"id": 1, "role": "assistant", "segments": [{"type": "thinking", "text": "t"}], "tool_uses": [{"id": "c", "name": "grep", "input": {}}], "tool_results": [{"tool_use_id": "c", "is_error": True, "content": "none"}]}]}
    new = {"version": "0.3.0", "model": {"model": "m"}, "messages": [{"User": {"id": "u", "content": [{"Text": "q"}, {"Mention": {"uri": "f"}}]}}, {"Agent": {"content": [{"Text": "a"}, {"ToolUse": {"id": "d", "name": "ls", "input": {"p": 1}}}], "tool_results": {"d": {"tool_use_id": "d", "is_error": False, "content": {"Text": "out"}}}}}, "Resume", {"Compaction": {}}]}
    path = store(tmp_path / "z.db", ("CREATE TABLE threads (id TEXT PRIMARY KEY, data_type TEXT, data BLOB)",), ("INSERT INTO threads VALUES (?, ?, ?)", ("old", "zstd", zstandard.compress(json.dumps(old).encode())), ("new", "json", json.dumps(new).encode()), ("oldest", "json", b'{"messages":[{"role":"user","text":"hi"}]}')))
    assert told(stores.read_zed(spark, [path])) == [
        ("new", 0, "user", "prompt", [("text", "q"), ("file", '"f"')]), ("new", 1, "assistant", "reply", [("text", "a"), ("tool_use", "ls"), ("tool_result", "out")]), ("new", 2, "system", "notice", []), ("new", 3, "system", "compaction_boundary", []),
        ("old", 0, "user", "prompt", [("text", "q")]), ("old", 1, "assistant", "reply", [("thinking", "t"), ("tool_use", "grep"), ("tool_result", "none")]), ("oldest", 0, "user", "prompt", [("text", "hi")]),
    ]


def test_cursor(spark, tmp_path):
    cell = lambda k, v: (k, json.dumps(v).encode())
    path = store(
        tmp_path / "c.vscdb", ("CREATE TABLE cursorDiskKV (key TEXT UNIQUE ON CONFLICT REPLACE, value BLOB)",),
        ("INSERT INTO cursorDiskKV VALUES (?, ?)", cell("composerData:n", {"_v": 10, "fullConversationHeadersOnly": [{"bubbleId": "b2", "type": 1}, {"bubbleId": "b1", "type": 2}, {"bubbleId": "gone"}]}),
         cell("bubbleId:n:b1", {"type": 2, "text": "", "thinking": {"text": "hm"}, "toolFormerData": {"name": "edit", "rawArgs": '{"p":1}', "result": '{"ok":1}', "status": "completed"}, "tokenCount": {"inputTokens": 4, "outputTokens": 2}}),
         cell("bubbleId:n:b2", {"type": 1, "text": "fix"}), cell("composerData:o", {"conversation": [{"bubbleId": "x", "type": 1, "text": "old"}]}), ("other", b"1")),
    )
    got = stores.read_cursor(spark, [path])
    assert told(got) == [("n", 0, "user", "prompt", [("text", "fix")]), ("n", 1, "assistant", "reply", [("thinking", "hm"), ("tool_use", "edit"), ("tool_result", '{"ok":1}')]), ("o", 0, "user", "prompt", [("text", "old")])]
    assert got.where("id = 'b1'").first().usage.input == 4


def test_devin_walks_the_forest(spark, tmp_path):
    node = lambda n, up, role, text, **more: ("s", n, up, json.dumps({"message_id": f"m{n}", "role": role, "content": text} | more), 1767225600)
    long = [("t", n, n - 1 if n else None, json.dumps({"role": "user", "content": str(n)}), 0) for n in range(40)]
    path = store(
        tmp_path / "d.db", ("CREATE TABLE sessions (id TEXT, main_chain_id INTEGER)",), ("CREATE TABLE message_nodes (session_id TEXT, node_id INTEGER, parent_node_id INTEGER, chat_message TEXT, created_at INTEGER)",), ("CREATE TABLE subagent_heads (session_id TEXT, agent_id TEXT, chain_node_id INTEGER)",),
        ("INSERT INTO sessions VALUES (?, ?)", ("s", 3), ("t", None)), ("INSERT INTO subagent_heads VALUES (?, ?, ?)", ("s", "kick", 6), ("s", "lost", 99)),
        ("INSERT INTO message_nodes VALUES (?, ?, ?, ?, ?)", node(1, None, "user", "old copy"), node(2, None, "user", "go"), node(3, 2, "assistant", "", tool_calls=[{"id": "c", "name": "exec", "arguments": {"a": 1}}], thinking={"thinking": "hm"}), node(5, None, "user", "handoff"), node(6, 5, "tool", "res", tool_call_id="c"), *long),
    )
    got = told(stores.read_devin(spark, [path]))
    assert [g for g in got if g[0] != "t"] == [
        ("s", 0, "user", "prompt", [("text", "go")]), ("s", 1, "assistant", "reply", [("thinking", "hm"), ("tool_use", "exec")]), ("s/kick", 0, "user", "prompt", [("text", "handoff")]), ("s/kick", 1, "tool", "tool_result", [("tool_result", "res")]),
    ]
    assert [g[4] for g in got if g[0] == "t"] == [[("text", str(n))] for n in range(40)]
