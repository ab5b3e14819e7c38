"""A mixed upload against the readers on the same files laid out by harness."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest

from threadloom.sources import documents as D
from threadloom.sources import jsonl as J
from threadloom.sources.discover import READERS
from threadloom.sources.uploads import document_harness, line_harness, read_upload

CLAUDE = "\n".join(json.dumps(x) for x in [
    {"type": "user", "uuid": "u1", "sessionId": "alpha", "message": {"role": "user", "content": "fix é it"}},
    {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "sessionId": "alpha", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}]}},
])
CODEX = "\n".join(json.dumps(x) for x in [
    {"type": "session_meta", "payload": {"id": "c1"}},
    {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}},
])
QWEN = json.dumps({"type": "user", "uuid": "q", "sessionId": "qs", "message": {"parts": [{"text": "ask"}]}})
PI = json.dumps({"type": "session", "id": "p1"}) + "\n" + json.dumps({"type": "message", "id": "m", "message": {"role": "user", "content": "hey"}})
KIMI = json.dumps({"role": "_system_prompt", "content": "be good"}) + "\n" + json.dumps({"role": "user", "content": "do"})
GEMINI = json.dumps({"sessionId": "g1", "projectHash": "h", "messages": [{"type": "user", "content": "what"}, {"type": "gemini", "content": "that"}]}, indent=2)
CONTINUE = json.dumps({"sessionId": "n1", "history": [{"message": {"role": "user", "content": "q"}}]})
CLINE = json.dumps([{"role": "user", "content": "task"}, {"role": "assistant", "content": [{"type": "text", "text": "did"}]}])
LMSTUDIO = json.dumps({"messages": [{"versions": [{"type": "singleStep", "role": "user", "content": [{"type": "text", "text": "lm"}]}], "currentlySelected": 0}]})
TALK = {"uuid": "x1", "chat_messages": [{"uuid": "e", "sender": "human", "text": "exported"}]}
GPT = [{"conversation_id": "gp", "current_node": "n", "mapping": {"n": {"id": "n", "parent": None, "message": {"author": {"role": "user"}, "content": {"parts": ["gpt"]}}}}}]
OPEN = json.dumps({"open_session": 1, "id": "o1", "messages": [{"role": "user", "content": "shared"}]})

FILES = {
    "claude/a.jsonl": CLAUDE, "codex/rollout-1.jsonl": CODEX, "qwen/q.jsonl": QWEN, "pi/p.jsonl": PI, "kimi/context.jsonl": KIMI, "gemini/chat.json": GEMINI, "continue/n.json": CONTINUE,
    "cline/task7/api_conversation_history.json": CLINE, "lmstudio/1.conversation.json": LMSTUDIO, "claude-export/conversations.json": json.dumps([TALK]), "chatgpt-export/conversations.json": json.dumps(GPT),
    "opensession/o.opensession.json": OPEN,
}


def shown(frame):
    return sorted((r.session_id, r.msg_idx, r.role, r.kind, json.dumps([b.text for b in r.content])) for r in frame.collect())


@pytest.fixture(scope="module")
def expected(spark, tmp_path_factory):
    """Each harness's messages by its own reader on its own folder."""
    root = tmp_path_factory.mktemp("plain")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return {h: shown(READERS[h](spark, f"{root}/{h}" if h != "cline" else f"{root}/cline/*")) for h in READERS if (root / h).exists()}


def test_a_mixed_upload(spark, tmp_path, expected):
    names = list(FILES)
    with zipfile.ZipFile(tmp_path / "some.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("folder/", "")
        for n in names[:5]:
            z.writestr(f"any/{n}", FILES[n])
        z.writestr("any/readme.md", "# not a transcript")
        z.writestr("any/bytes.jsonl", b'{"type": "user", "uuid": "\xff"}')
        z.writestr("any/empty.jsonl", "")
    with tarfile.open(tmp_path / "rest.tar.gz", "w:gz") as t:
        for n in names[5:10]:
            data = FILES[n].encode()
            info = tarfile.TarInfo(n)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "gpt.json.gz").write_bytes(gzip.compress(FILES[names[10]].encode()))
    import zstandard

    (tmp_path / "deep" / "o.json.zst").write_bytes(zstandard.ZstdCompressor().compress(FILES[names[11]].encode()))
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "value.json").write_text('{"some": "thing"}')
    found, skipped = read_upload(spark, str(tmp_path))
    assert {(r.harness): shown(found.where(f"harness = '{r.harness}'")) for r in found.select("harness").distinct().collect()} == expected
    assert all(expected.values())
    left = {r.file.rsplit("/", 1)[-1]: r.reason for r in skipped.collect()}
    assert left.pop("broken.zip").split(":")[0] in ("BadZipFile", "ArrowInvalid")
    assert left == {"readme.md": "no known shape", "bytes.jsonl": "not UTF-8", "empty.jsonl": "no known shape", "value.json": "no known shape"}


def test_limits_and_members_that_break_halfway(spark, tmp_path):
    many = "\n".join([CLAUDE] * 50)
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        z.writestr("a.jsonl", many)
    with zipfile.ZipFile(tmp_path / "torn.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("b.jsonl", many)
        z.writestr("c.jsonl", CODEX)
    data = bytearray((tmp_path / "torn.zip").read_bytes())
    at = data.index(b"alpha", 3000)
    data[at : at + 5] = b"omega"  # the checksum no longer fits
    (tmp_path / "torn.zip").write_bytes(bytes(data))
    found, skipped = read_upload(spark, str(tmp_path), total_bytes=len(many.encode()) + len(CODEX))
    reasons = {r.file.rsplit("/", 1)[-1]: r.reason for r in skipped.collect()}
    assert list(reasons) == ["b.jsonl"] and "CRC" in reasons["b.jsonl"]
    assert sorted((r.harness, r["count"]) for r in found.groupBy("harness").count().collect()) == [("claude", 100), ("codex", 1)]
    found, skipped = read_upload(spark, f"{tmp_path}/big.zip", entry_bytes=1000)
    assert found is None and "more than 1000 bytes" in skipped.first().reason
    found, skipped = read_upload(spark, f"{tmp_path}/big.zip", entries=0)
    assert found is None and "more than 0 members" in skipped.first().reason


def test_shapes_that_nothing_tells(tmp_path):
    assert document_harness("a.json", 7) is None and document_harness("a.json", []) is None and document_harness("a.json", {"messages": 3, "history": {}}) is None
    assert line_harness("a.jsonl", [{"type": 3}, {"role": 1, "content": 2}]) is None
    assert document_harness("x.json", TALK) == "claude-export"  # one talk by itself is read as a list of one


def test_one_exported_talk(spark, tmp_path):
    (tmp_path / "talk.json").write_text(json.dumps(TALK))
    found, _ = read_upload(spark, str(tmp_path))
    assert [(r.session_id, r.harness, r.content[0].text) for r in found.collect()] == [("x1", "claude-export", "exported")]
    assert D.documents(spark, str(tmp_path)).count() == 1 and J.bad_lines(spark, str(tmp_path)).count() == 0
