"""Predicates, tokens, fingerprints, graphs, provenance, tasks and followers on small rows."""

import json

import pandas as pd
from pyspark.sql import functions as F

from threadloom.functions import fingerprints as H
from threadloom.functions import predicates as P
from threadloom.functions import text as X
from threadloom.functions import tokens as K
from threadloom.operators import aggregates as A
from threadloom.operators import graphs as G
from threadloom.operators import search as Q
from threadloom.operators import tasks as T
from threadloom.operators import transforms as M
from threadloom.streaming import watch as W


def test_three_valued_predicates(spark):
    rows = spark.createDataFrame([("a", "Fix it", 3), ("b", None, None), ("c", "other", 9)], "id string, title string, n int")
    ids = lambda test: {r.id for r in rows.where(test).collect()}
    title, n = F.col("title"), F.col("n")
    assert ids(P.contains(title, "FIX")) == {"a"} and ids(~P.contains(title, "FIX")) == {"b", "c"}
    assert ids(P.number(n, 4)) == {"c"} and ids(~P.number(n, 4)) == {"a"}
    assert ids(P.contains(title, "zzz") | P.number(n, 1)) == {"a", "c"} and ids(P.bare("c", title, F.col("id"))) == {"c"}
    assert ids(P.admitted(F.lit("/w/x/y"), title, allow=["/w/**"])) == {"a", "b", "c"} and not ids(P.admitted(F.lit("/w/x/y"), title, allow=["/w/*"]))
    assert not ids(P.admitted(F.lit("/w/x"), title, allow=["/w"], deny=["/w/x"])) and not ids(P.admitted(F.lit(None).cast("string"), title, allow=["/w"]))


def test_text_and_tokens(spark):
    rows = spark.createDataFrame([("ab\ncdéf", "claude-opus-4-20250514"), ("", "x/gpt-4o"), (None, "claude-4-7")], "t string, m string")
    got = rows.select(X.truncate(F.col("t"), 4), K.effective_bytes(F.col("t")), K.block_tokens(F.col("t")), K.tokenizer_scale(F.col("m")), K.price(F.col("m"))["input"]).collect()
    assert [tuple(r) for r in got] == [("ab …", 8, 16, 1.35, 15.0), ("", 0, 12, 1.25, 2.5), (None, None, 12, 1.0, None)]


def test_fingerprints(spark):
    assert H.line_print("};") is None and H.line_print("  x = 1 ") == H.line_print("x = 1") != H.line_print("x = 2")
    assert H.hunk_print("a\n\n  b") == H.hunk_print("  a\nb\n") and H.hunk_print(" \n") is None
    got = spark.createDataFrame([("x = 1\n}\nx = 1",), (None,)], "t string").select(H.edit_prints("t").alias("p")).collect()
    assert got[0].p == [H.hunk_print("x = 1\n}\nx = 1"), H.line_print("x = 1")] and got[1].p == []


def test_graph_walk_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent int, child int")
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1500)] + [(2001, 2000), (3001, 3002), (3002, 3001), (3003, 3001)], "id long, parent_id long")
    deep = {r.id: (r.root, r.depth) for r in G.depths(chain).collect()}
    assert all(deep[i] == (0, i) for i in range(1500)) and deep[2001] == (2001, 0) and deep[3001] == deep[3002] == deep[3003] == (None, None)
    up = G.ways_up(chain.where("parent_id IS NOT NULL").selectExpr("id", "parent_id up"), spark.createDataFrame([(700,), (3003,)], "id long")).collect()
    assert {r.id for r in up if r.start == 700} == set(range(701)) and {r.id for r in up if r.start == 3003} == {3001, 3002, 3003}
    got = G.descendants(edges, spark.createDataFrame([(1,)], "id int")).collect()
    assert {(r.id, r.depth) for r in got} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_boundaries_pair_by_parent_then_latest(spark):
    rows = spark.createDataFrame([("s", 0, "b1", "compaction_boundary", None), ("s", 1, "b2", "compaction_boundary", None), ("s", 2, "x", "compaction_summary", "b2"), ("s", 3, "y", "compaction_summary", None)], "session_id string, msg_idx int, id string, kind string, parent_id string")
    assert {(r.summary, r.boundary) for r in G.paired_boundaries(rows).collect()} == {("x", "b2"), ("y", "b1")}


def test_frontier_and_chain(spark):
    rows = spark.createDataFrame([("p", s) for s in (1, 2, 2, 3, 5, 9)] + [("q", 2)], "p string, seq long")
    assert {(r.p, r.frontier, r.highest, r.gaps) for r in A.frontier(rows, ["p"], "seq").collect()} == {("p", 3, 9, 2), ("q", 0, 2, 1)}
    import hashlib

    prev, chain = "", []
    for k in range(1, 4):
        body = json.dumps({"k": k})
        h = hashlib.sha256(f"receipt-v1\n{prev}\n{body}".encode()).hexdigest()
        chain.append(("s", k, prev, body if k != 3 else body + " ", h))
        prev = h
    got = A.verified_chain(spark.createDataFrame(chain, "s string, seq long, prev string, body string, hash string"), "s", "receipt-v1").orderBy("seq").collect()
    assert [r.ok for r in got] == [True, True, False]


def test_exact_and_phrase(spark):
    docs = spark.createDataFrame([(1, "The quick fox"), (2, "quick, the fox"), (3, None)], "doc_id int, text string")
    assert {r.doc_id for r in Q.exact(docs, "QUICK fox").collect()} == {1} and Q.exact(docs, "").count() == 0
    assert {r.doc_id for r in Q.phrase(docs, ["quick", "the"]).collect()} == {2}


def test_prune_round_trip(spark):
    rows = spark.createDataFrame([("s", i, "user", "prompt", "x" * (10 + i * 50)) for i in range(6)], "session_id string, msg_idx int, role string, kind string, text string")
    pruned, sidecar = M.prune(rows, 60, 2)
    assert sidecar.count() == 2 and pruned.where("text LIKE '[PRUNED%'").count() == 2
    back = M.retrieve(pruned, sidecar).select(*rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def task_events(*events):
    return [(f"{k:03d}", "t1", "2026-01-01", "me", e, json.dumps(p)) for k, (e, p) in enumerate(events)]


TASK = "id string, task_id string, ts string, by string, event string, payload string"


def test_task_fold(spark):
    log = task_events(("opened", {"title": "x"}), ("claimed", {"assignee": "a"}), ("tagged", {"tags": ["p", "q"]}), ("tagged", {"tags": ["q"]}), ("merged_local", {}), ("status_set", {"text": "go"}), ("done", {}))
    again = [*log, log[1]]
    other = [("000", "t2", "2026-01-01", "me", "opened", "{}"), ("001", "t2", "2026-01-01", "me", "blocked_by", '{"task": "t1"}'), ("002", "t2", "", "", "blocked_by", '{"task": "gone"}')]
    bad = [("000", "t3", "", "", "opened", "{}"), ("001", "t3", "", "", "done", "{}"), ("002", "t3", "", "", "claimed", "{}")]
    tasks = T.fold_tasks(spark.createDataFrame(again + other + bad, TASK))
    got = {r.task_id: r for r in tasks.collect()}
    assert (got["t1"].state, got["t1"].assignee, got["t1"].tags, got["t1"].status, got["t1"].revisions, got["t1"].error) == ("done", "a", ["p", "q"], "go", 1, None)
    assert got["t3"].error == "002: claimed after done"
    assert {r.task_id: r.is_blocked for r in T.blocked(tasks).collect()} == {"t1": False, "t2": True, "t3": False}


def test_many_short_logs_fold_in_one_stream(spark):
    """A call of Python for each task took nearly all the time; events of a million tasks now stream by, sorted."""
    rows = [(f"{k}", f"t{i}", "", "me", e, "{}") for i in range(500) for k, e in enumerate(("opened", "claimed", "noted", "done")[: 1 + i % 4])]
    rows += [("0", "t7", "", "me", "opened", "{}"), ("1", "t6", "later", "me", "claimed", "{}"), (None, "t9", "", "me", "noted", "{}"), ("0", None, "", "me", "opened", None)]
    tasks = T.fold_tasks(spark.createDataFrame(rows, TASK))
    assert "FlatMapGroups" not in tasks._jdf.queryExecution().executedPlan().toString()
    got = {r.task_id: r for r in tasks.collect()}
    assert len(got) == 501 and all(got[f"t{i}"].state == ("open", "claimed", "claimed", "done")[i % 4] for i in range(500))
    assert got["t7"].error is None and got["t9"].notes == 1 and got[None].state == "open"
    assert [(i, got[i].error) for i in got if got[i].error] == [("t6", "1: another event has this id")]


def test_task_decisions():
    log = [("opened", {}), ("posed", {"options": ["a", "b"], "default": "a"}), ("resolved", {"choice": "a", "provisional": True}), ("resolved", {"choice": "b"}), ("resolved", {"choice": "a"})]
    got = T.fold_one(pd.DataFrame(task_events(*log), columns=[c.split()[0] for c in TASK.split(", ")]))
    assert (got["choice"], got["provisional"], got["error"]) == ("b", False, "004: resolved already")


def stream(spark, tmp_path, schema, batches, build):
    source, out = tmp_path / "in", []
    source.mkdir()
    for k, batch in enumerate(batches):
        pd.DataFrame(batch).to_parquet(source / f"{k}.parquet")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    frame = build(read)
    mode = "update" if "frontier" in frame.columns else "append"
    frame.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: out.append([tuple(r) for r in df.collect()])).trigger(availableNow=True).start().awaitTermination()
    return [b for b in out if b]


def test_watch_new_and_updated(spark, tmp_path):
    batches = [{"session_id": ["a", "a"], "msg_idx": [0, 1]}, {"session_id": ["a", "b"], "msg_idx": [1, 0]}, {"session_id": ["a"], "msg_idx": [4]}]
    got = stream(spark, tmp_path, "session_id string, msg_idx long", batches, W.watch)
    assert got == [[("a", "new", 0, 2)], [("b", "new", 0, 1)], [("a", "updated", 2, 3)]]


def test_ingest_buffers_out_of_order(spark, tmp_path):
    batches = [{"producer": ["p"] * 2, "epoch": ["e"] * 2, "seq": [1, 3]}, {"producer": ["p"] * 2, "epoch": ["e"] * 2, "seq": [3, 2]}]
    assert stream(spark, tmp_path, "producer string, epoch string, seq long", batches, W.ingest) == [[("p", "e", 1, 1)], [("p", "e", 3, 0)]]


def test_merged_batches_equal_a_full_rebuild(spark):
    full = [("a", i, i * 2) for i in range(5)] + [("b", 0, 9)]
    old = spark.createDataFrame([("a", i, 0 if i > 1 else i * 2) for i in range(4)] + [("b", 0, 9)], "session_id string, msg_idx int, v int")
    batch = spark.createDataFrame([("a", i, i * 2) for i in range(2, 5)], "session_id string, msg_idx int, v int")
    assert sorted(map(tuple, W.merged(old, batch).collect())) == sorted(full)


def test_git_verbs_and_paths(spark):
    rows = {
        "git -C /x commit -m y": (True, False), "cd a && git --no-pager -c k=v push origin": (False, True), "digit commit": (False, False),
        "git log --grep commit": (False, False), "echo git; git commit|cat": (True, False), "": (False, False),
    }
    got = spark.createDataFrame([(c,) for c in rows], "c string").select("c", X.git_verb(F.col("c"), "commit").alias("a"), X.git_verb(F.col("c"), "push").alias("b")).collect()
    assert {r.c: (r.a, r.b) for r in got} == rows
    paths = {"/a/./b/../c": "/a/c", "x//y": "/home/u/x/y", "../../../z": "/z", "": "/home/u"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.clean_path(F.col("p"), "/home/u").alias("c")).collect()
    assert {r.p: r.c for r in got} == paths


def test_usage_without_identity_never_repeats(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, n int")
    assert sorted(r.n for r in A.exact_usage(rows, ["k"], ["n"]).collect()) == [1, 3, 4]


def test_rewind_closes_calls_and_outcomes_want_none_open(spark):
    rows = spark.createDataFrame(
        [("s", 0, "user", "prompt", "q", [], [], []), ("s", 1, "assistant", "reply", "", ["c1", "c2"], [], []), ("s", 2, "tool", "tool_result", "", [], ["c1"], []),
         ("s", 3, "tool", "tool_result", "", [], ["c2"], ["c2"]), ("s", 4, "assistant", "reply", "done", [], [], []),
         ("u", 0, "user", "prompt", "q", [], [], []), ("u", 1, "assistant", "reply", "ok", ["d"], ["d"], [])],
        "session_id string, msg_idx int, role string, kind string, text string, calls array<string>, results array<string>, failed array<string>",
    )
    assert [r.msg_idx for r in M.rewind(rows.where("session_id = 's'"), 1, F.col("role") == "none").orderBy("msg_idx").collect()] == [0, 1, 2, 3]
    assert {(r.session_id, r.msg_idx): r.pending for r in M.open_calls(rows).collect()}["s", 2] == ["c2"]
    assert [r.session_id for r in M.clean_outcomes(rows).collect()] == ["u"]


def test_splice_numbers_spans_in_order(spark):
    rows = spark.createDataFrame([(s, i, "user", f"{s}{i}") for s in "ab" for i in range(4)], "session_id string, msg_idx int, role string, text string")
    spans = spark.createDataFrame([(0, "b", 1, 3), (1, "a", 0, 2), (2, "b", 0, 1)], "ord int, session_id string, start int, stop int")
    assert [r.text for r in M.splice(rows, spans).orderBy("new_idx").collect()] == ["b1", "b2", "a0", "a1", "b0"]


def test_batch_wants_all_words(spark):
    docs = spark.createDataFrame([(1, "The red fox"), (2, "a red hen"), (3, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "red"), (2, "fox RED"), (3, "red cow"), (4, "")], "item_id int, text string")
    assert sorted(tuple(r) for r in Q.batch(docs, asked).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_written_tables_go_when_asked(spark):
    import os

    from threadloom import session

    kept = session.written(spark.range(3), "kept")
    gone = session.written(spark.range(3), "gone")
    assert kept.count() == gone.count() == 3 and all(os.path.isdir(p) for p in session.made[-2:])
    session.delete(spark, session.made[-1:])
    assert os.path.isdir(session.made[-2]) and not os.path.exists(session.made[-1]) and kept.count() == 3


def test_ranges_as_their_sql_with_nulls_and_repeats(spark, tmp_path):
    """A line without a part has no range and joins its file's last one; one without a number has no end."""
    import duckdb

    from threadloom.plans import demo

    lines = [(file, part, line) for file in (1, 2, None) for part, line in ((None, 1), (None, 4), (3, None), (3, 1), (3, 1), (10, 2), (40, None), (12, 5))] + [(3, None, 1), (4, 7, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    db.execute("SET threads = 1")  # both windows of the SQL then order equal ranges alike
    want = db.execute(f"SELECT file, first, last FROM ({demo.oracle_sql()['a12_hunks']})").fetchall()
    got = demo.queries()["a12_hunks"](spark, str(tmp_path)).select("file", "first", "last").collect()
    assert {tuple(r) for r in got} == set(want) and len(got) == len(want) == 11
