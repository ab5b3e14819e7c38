"""Uploaded trees and archives: what each member holds is told by its content, and all are read as one table of messages.

A folder may mix transcripts, compressed ones and zip or tar archives. Listing and unpacking
are Spark tasks: a zip's members are tasks of their own, since its directory tells where each
begins, while a tar is read from its start by one task. Lines stream into rows; a document
that is one JSON value is one row.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import folder
from threadloom.sources.discover import READERS

MEMBER = "archive string, member string, size bigint, reason string"
ROW = "harness string, file string, block bigint, at bigint, value string, reason string"
HEAD = 8  # records that tell a line file's harness
BATCH = 4 << 20  # characters of text a batch
NONE = "-"  # the harness of members left out

# Record types by harness.
QWEN_TYPES = {"user", "assistant", "system", "tool_result"}
CODEX_TYPES = {"session_meta", "response_item", "event_msg", "turn_context", "compacted"}
CLAUDE_TYPES = {"user", "assistant", "system", "summary", "attachment", "file-history-snapshot", "queue-operation"}


def base(name: str) -> str:
    return name.replace("\\", "/").rsplit("/", 1)[-1].lower()


def line_harness(name: str, records: list[dict]) -> str | None:
    """The harness of a line file by its first records, or None."""
    types = {r.get("type") for r in records if isinstance(r.get("type"), str)}

    def qwen(r: dict) -> bool:
        message = r.get("message")
        parts = isinstance(message, dict) and "parts" in message
        return ("sessionId" in r or "parentUuid" in r) and r.get("type") in QWEN_TYPES and (parts or bool({"usageMetadata", "toolCallResult", "systemPayload"} & r.keys()))

    if base(name).startswith("rollout-") or any(r.get("type") in CODEX_TYPES and "payload" in r for r in records):
        return "codex"
    if any(qwen(r) for r in records):
        return "qwen"
    if records and records[0].get("type") == "session" and "id" in records[0]:
        return "pi"
    if any(r.get("type") in CLAUDE_TYPES and ({"sessionId", "uuid", "message"} & r.keys()) for r in records):
        return "claude"
    if any(isinstance(r.get("role"), str) and "content" in r for r in records) and not types:
        return "kimi"
    return None


def document_harness(name: str, v) -> str | None:
    """The harness of a file that is one JSON value, or None."""
    some = [i for i in (v if isinstance(v, list) else [v])[:HEAD] if isinstance(i, dict)]
    if any("mapping" in i for i in some):
        return "chatgpt-export"
    if any("chat_messages" in i for i in some):
        return "claude-export"
    if isinstance(v, list):
        return "cline" if any("role" in i and "content" in i for i in some) else None
    if not isinstance(v, dict):
        return None
    if base(name).endswith(".opensession.json") or {"open_session", "openSession"} & v.keys():
        return "opensession"
    first = [m for m in v["messages"][:HEAD] if isinstance(m, dict)] if isinstance(v.get("messages"), list) else []
    if any("versions" in m for m in first):
        return "lmstudio"
    if "messages" in v and ("sessionId" in v or "projectHash" in v):
        return "gemini"
    turns = [h for h in v["history"][:HEAD] if isinstance(h, dict)] if isinstance(v.get("history"), list) else []
    if "history" in v and ("workspaceDirectory" in v or any("message" in h for h in turns)):
        return "continue"
    return None


def opened(path: str):
    """A seekable stream of a file on any file system that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        store, inner = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def unpacked(stream, name: str):
    """A single file's bytes without its compression, and its name without the suffix for it."""
    if name.endswith(".gz"):
        return gzip.GzipFile(fileobj=stream), name[:-3]
    if name.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True), name[:-4]
    return stream, name


def is_tar(name: str) -> bool:
    return name.lower().endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz"))


def counted(lines: Iterator[bytes], most: int) -> Iterator[str]:
    """Decoded lines; ValueError beyond ``most`` bytes or where the text isn't UTF-8."""
    size = 0
    for line in lines:
        size += len(line)
        if size > most:
            raise ValueError(f"more than {most} bytes")
        yield line.decode()


def rows_of(name: str, file: str, stream, most: int) -> Iterator[tuple]:
    """ROW tuples of one member; the last one names the reason if the member can't be used."""
    try:
        stream, plain = unpacked(stream, name)
        held = io.BufferedReader(stream)
        lines = counted(iter(lambda: held.readline(most + 1), b""), most)
        whole, head, records = None, [], []
        if not base(plain).endswith((".jsonl", ".ndjson")):
            whole = "".join(lines)
            try:
                v = json.loads(whole)
            except (ValueError, RecursionError):
                lines = iter(io.StringIO(whole, newline="\n"))  # many records under another name
            else:
                harness = document_harness(plain, v)
                if harness:
                    single = harness.endswith("-export") and isinstance(v, dict)
                    yield harness, file, 0, 0, f"[{whole}]" if single else whole, None
                    return
                lines = iter([whole])
        for line in lines:
            head.append(line)
            try:
                v = json.loads(line)
            except (ValueError, RecursionError):
                v = None
            if isinstance(v, dict):
                records.append(v)
            if len(records) == HEAD or len(head) == 64 * HEAD:
                break
        harness = line_harness(plain, records) if records else None
        if not harness:
            yield NONE, file, 0, 0, None, "no known shape"
            return
        at = 0
        for source in (head, lines):
            for line in source:
                yield harness, file, 0, at, line.rstrip("\r\n"), None
                at += 1
    except UnicodeDecodeError:
        yield NONE, file, 0, 0, None, "not UTF-8"
    except Exception as e:  # broken or encrypted members fail in many kinds
        yield NONE, file, 0, 0, None, f"{type(e).__name__}: {e}"[:200]


def members(paths: Iterator[pa.RecordBatch], entries: int, total_bytes: int) -> Iterator[tuple]:
    """MEMBER tuples: a zip's members, or a file that is read whole."""
    for batch in paths:
        for path in batch.column("path").to_pylist():
            if not path.lower().endswith(".zip"):
                yield path, None, 0, None
                continue
            try:
                with opened(path) as f, zipfile.ZipFile(f) as z:
                    held = [i for i in z.infolist() if not i.is_dir()]
                if len(held) > entries or sum(i.file_size for i in held) > total_bytes:
                    yield path, None, 0, f"more than {entries} members or {total_bytes} bytes"
                    continue
                for i in held:
                    yield path, i.filename, i.file_size, None
            except (zipfile.BadZipFile, OSError, NotImplementedError, ValueError) as e:  # Arrow tells a seek before the start by a ValueError
                yield path, None, 0, f"{type(e).__name__}: {e}"[:200]


def member_rows(archive: str, member: str | None, entries: int, entry_bytes: int, total_bytes: int) -> Iterator[tuple]:
    try:
        with opened(archive) as f:
            if member is not None:
                with zipfile.ZipFile(f) as z, z.open(member) as stream:  # reads no more than the directory says
                    yield from rows_of(member, f"{archive}!/{member}", stream, entry_bytes)
            elif is_tar(archive):
                total = 0
                with tarfile.open(fileobj=f, mode="r|*") as t:
                    for n, i in enumerate(i for i in t if i.isfile()):
                        total += i.size
                        if n >= entries or total > total_bytes:
                            yield NONE, f"{archive}!/{i.name}", 0, 0, None, f"after {entries} members or {total_bytes} bytes"
                            return
                        yield from rows_of(i.name, f"{archive}!/{i.name}", t.extractfile(i), entry_bytes)
            else:
                yield from rows_of(archive, archive, f, entry_bytes)
    except Exception as e:
        yield NONE, archive if member is None else f"{archive}!/{member}", 0, 0, None, f"{type(e).__name__}: {e}"[:200]


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)


def unpack(spark: SparkSession, path: str, entries: int, entry_bytes: int, total_bytes: int) -> DataFrame:
    """ROW of all members below ``path``, written once, by harness."""
    text, whole = pa.string(), pa.int64()
    listed = pa.schema([("archive", text), ("member", text), ("size", whole), ("reason", text)])
    shape = pa.schema([("harness", text), ("file", text), ("block", whole), ("at", whole), ("value", text), ("reason", text)])

    def listing(parts):
        yield from batches(members(parts, entries, total_bytes), listed)

    def unpacking(parts):
        for part in parts:
            for m in part.to_pylist():
                if m["reason"]:
                    rows = iter([(NONE, m["archive"], 0, 0, None, m["reason"])])
                else:
                    rows = member_rows(m["archive"], m["member"], entries, entry_bytes, total_bytes)
                yield from batches(rows, shape)

    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # names alone, no content
    found = paths.mapInArrow(listing, MEMBER)
    spread = found.repartition("archive", "member").mapInArrow(unpacking, ROW)
    out = folder(spark, "upload")
    spread.write.partitionBy("harness").parquet(out)
    return spark.read.schema(ROW).parquet(out)


def read_upload(spark: SparkSession, path: str, entries: int = 10_000, entry_bytes: int = 256 << 20, total_bytes: int = 512 << 20) -> tuple[DataFrame | None, DataFrame]:
    """Messages of all members below ``path`` with their harness (None if none can be read), and (file, reason) of members left out.

    An archive of more than ``entries`` members or ``total_bytes`` unpacked bytes is refused (a tar is
    read up to there), and so is a member of more than ``entry_bytes``: all are named with
    the reason. A member that breaks halfway gives no messages. A member's name in ``file`` is
    ``archive!/member``.
    """
    rows = unpack(spark, path, entries, entry_bytes, total_bytes)
    skipped = rows.where(F.col("harness") == NONE).select("file", "reason")
    out = None
    for harness in sorted(r.harness for r in rows.select("harness").distinct().collect() if r.harness != NONE):  # as many as there are readers
        own = rows.where(F.col("harness") == harness).join(skipped.select("file"), "file", "left_anti").select("file", "block", "at", "value")
        found = READERS[harness](spark, own).withColumn("harness", F.lit(harness))
        out = found if out is None else out.unionByName(found)
    return out, skipped
