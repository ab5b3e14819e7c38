"""Queries on facts that need events, children or literals: filters, limits, merges, cursors."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from threadloom.functions import predicates as P
from threadloom.functions import text as X
from threadloom.operators import aggregates as A
from threadloom.operators import graphs as G
from threadloom.operators import provenance as V
from threadloom.operators import search as Q
from threadloom.operators import sessions as S
from threadloom.operators import tasks as K
from threadloom.operators import transforms as T
from threadloom.plans.aggregates import EVENTS, events
from threadloom.plans.catalog import MESSAGES
from threadloom.plans.joins import TIMED, edits_commits
from threadloom.plans.registry import query
from threadloom.plans.search import WORDS
from threadloom.sources.conversations import messages_from_conversations
from threadloom.streaming import watch as W

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)


@query("SELECT user_id FROM events GROUP BY user_id HAVING bool_or(contains(lower(event_type), 'urch'))")
def f02_model(t):
    held = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("models"))
    return held.where(P.model(F.col("models"), "URCH")).select("user_id")


@query("SELECT doc_id FROM documents WHERE NOT coalesce(contains(lower(source), 'rc1'), false)")
def f03_cwd(t):
    return t.documents.where(~P.contains(F.col("source"), "rc1")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_brand, p_type)), '1 s') OR lower(p_brand) = 'brand#22' OR lower(p_type) = 'brand#22'")
def f09_git(t):
    return t.part.where(P.git(F.col("p_brand"), F.col("p_type"), "1 S") | P.git_equals(F.col("p_brand"), F.col("p_type"), "brand#22")).select("p_partkey")


@query(f"WITH {EVENTS} SELECT DISTINCT session_id FROM ev WHERE kind IN ('file_edit', 'file_read') AND contains(target, '77')")
def f12_touched(t):
    return S.touching(events(t), "77")


@query(f"""WITH {EVENTS} SELECT session_id, {", ".join(f"coalesce(bool_or(kind IN ({', '.join(repr(k) for k in kinds)})), false) AS has_{name}" for name, kinds in S.FLAGS.items())},
  bool_or(kind <> 'error') AS has_tools FROM ev GROUP BY session_id""")
def f13_flags(t):
    return S.flags(events(t))


CHILDREN = "c AS (SELECT CAST(l_orderkey AS VARCHAR) AS session_id, CASE WHEN l_orderkey % 4 <> 0 THEN CAST(l_orderkey - l_orderkey % 4 AS VARCHAR) END AS parent_id, l_returnflag AS tool, l_linestatus AS agent FROM lineitem)"


def children(t):
    parent = F.when(F.col("l_orderkey") % 4 != 0, (F.col("l_orderkey") - F.col("l_orderkey") % 4).cast("string"))
    return t.lineitem.select(F.col("l_orderkey").cast("string").alias("session_id"), parent.alias("parent_id"), F.col("l_returnflag").alias("tool"), F.col("l_linestatus").alias("agent"))


@query(f"WITH {CHILDREN} SELECT DISTINCT parent_id AS session_id FROM c WHERE tool = 'R' AND parent_id IS NOT NULL AND parent_id NOT IN (SELECT session_id FROM c WHERE tool = 'R')")
def f14_subtool(t):
    return S.subtool(children(t), "r")


@query(f"WITH {CHILDREN} SELECT DISTINCT parent_id AS session_id FROM c WHERE contains(lower(agent), 'f') AND parent_id IS NOT NULL")
def f15_agent(t):
    return S.through_children(children(t), P.contains(F.col("agent"), "F"))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS session_id FROM orders WHERE contains(lower(o_orderpriority), 'urgent')")
def f17_workflow(t):
    runs = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").cast("string").alias("parent_id"), "o_orderpriority")
    return S.through_children(runs, P.contains(F.col("o_orderpriority"), "urgent"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 OR p_retailprice >= 1500 OR p_size = 3")
def f19_ranges(t):
    return t.part.where(P.ranged(F.col("p_size"), "10..20") | P.ranged(F.col("p_retailprice"), "1500..") | P.ranged(F.col("p_size"), "3")).select("p_partkey")


@query("""SELECT o_orderkey FROM orders WHERE (o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01') OR o_orderdate > TIMESTAMP '1998-05-01'
  OR (o_orderdate >= TIMESTAMP '1995-05-05' AND o_orderdate < TIMESTAMP '1995-05-06')""")
def f20_dates(t):
    day = F.col("o_orderdate")
    return t.orders.where(P.dated(day, "1996-02-01..1996-02-29") | P.dated(day, "1998-05-01", ">") | P.dated(day, "1995-05-05")).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25'")
def f28_since(t):
    return t.events.where(F.col("ts").cast("timestamp") >= F.lit(P.since_instant("1w", NOW))).select("event_id")


LANES = """l AS (SELECT user_id, CASE WHEN arg_max(event_type, event_id) = 'purchase' THEN 'done' ELSE 'open' END AS status, max(ts) AS last FROM events GROUP BY user_id),
q AS (SELECT *, epoch(TIMESTAMP '2024-02-01') - epoch(last) > 86400 AS quiet FROM l)"""


@query(f"""WITH {LANES} SELECT user_id, status = 'done' AS done, status <> 'done' AND NOT quiet AS running, status <> 'done' AND quiet AS stranded, status <> 'done' AS unfinished FROM q""")
def f29_lanes(t):
    status = F.when(F.max_by("event_type", "event_id") == "purchase", "done").otherwise("open")
    lanes = t.events.groupBy("user_id").agg(status.alias("status"), F.max(F.col("ts").cast("timestamp")).alias("last"))
    names = ("done", "running", "stranded", "unfinished")
    return lanes.select("user_id", *[P.lane(F.col("status"), F.col("last"), name, F.lit(NOW), 86_400).alias(name) for name in names])


@query("SELECT doc_id, '/w/' || coalesce(lang, 'x') || '/' || coalesce(source, 'y') AS path FROM documents")
def p06_clean_path(t):
    lang, source = F.coalesce("lang", F.lit("x")), F.coalesce("source", F.lit("y"))
    odd = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("./"), lang, F.lit("/no/..//"), source)).otherwise(F.concat(F.lit("/../w/./"), lang, F.lit("/"), source, F.lit("/")))
    return t.documents.select("doc_id", X.clean_path(odd, "/w").alias("path"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS place FROM orders ORDER BY place LIMIT 50")
def o05_exact_order(t):
    when = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    top = t.orders.orderBy(when.desc_nulls_last(), "o_orderkey").limit(50)
    from pyspark.sql import Window

    return top.select("o_orderkey", F.row_number().over(Window.orderBy(when.desc_nulls_last(), "o_orderkey")).alias("place"))


@query(f"WITH {EVENTS} SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx, kind) AS place FROM ev")
def o07_event_order(t):
    from pyspark.sql import Window

    return events(t).select("session_id", "event_id", F.row_number().over(Window.partitionBy("session_id").orderBy("msg_idx", "kind")).alias("place"))


@query("""WITH b AS (SELECT o_orderkey, sum(CAST(o_totalprice AS BIGINT)) OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS upto,
  (SELECT sum(CAST(o_totalprice AS BIGINT)) FROM orders) AS every FROM orders) SELECT o_orderkey FROM b WHERE upto <= 5000000""")
def q10_live_budget(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderdate", F.round("o_totalprice").cast("long").alias("size"))
    return S.newest_within(rows, "o_orderdate", "size", 5_000_000).select(F.col("id").alias("o_orderkey"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents), r AS (SELECT doc_id, CASE WHEN contains(' ' || array_to_string(words, ' ') || ' ', ' the idiot erthth ') THEN 0
  WHEN list_contains(words, 'the') AND list_contains(words, 'idiot') AND list_contains(words, 'erthth') THEN 1 WHEN list_contains(words, 'idiot') OR list_contains(words, 'erthth') THEN 2 END AS tier FROM w)
SELECT doc_id, tier FROM r WHERE tier = (SELECT min(tier) FROM r)""")
def q11_recall(t):
    return Q.recall(t.documents, "The idiot, erthth")


@query("""WITH r AS (SELECT l_orderkey AS file, l_partkey % 50 AS first, l_partkey % 50 + l_linenumber AS last FROM lineitem),
b AS (SELECT *, max(last) OVER (PARTITION BY file ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR first > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT file, min(first) AS first, max(last) AS last FROM n GROUP BY file, run""")
def a12_hunks(t):
    first = F.col("l_partkey") % 50
    return A.merged_ranges(t.lineitem.select(F.col("l_orderkey").alias("file"), first.alias("first"), (first + F.col("l_linenumber")).alias("last")), ["file"], "first", "last")


@query(f"""WITH {EVENTS}, k AS (SELECT session_id, msg_idx, CASE tool WHEN 'purchase' THEN 'compaction_boundary' WHEN 'signup' THEN 'compaction_summary' ELSE kind END AS kind FROM ev)
SELECT session_id, count(*) FILTER (kind = 'compaction_boundary') AS boundaries, count(*) FILTER (kind = 'compaction_summary') AS summaries, max(msg_idx) FILTER (starts_with(kind, 'compaction')) AS last FROM k GROUP BY session_id""")
def a15_compactions(t):
    kind = F.when(F.col("tool") == "purchase", "compaction_boundary").when(F.col("tool") == "signup", "compaction_summary").otherwise(F.col("kind"))
    return A.compactions(events(t).withColumn("kind", kind))


@query("SELECT o_custkey, count(*) AS runs, count(*) FILTER (o_orderstatus <> 'F') AS open, CAST(sum(CAST(o_totalprice * 100 AS BIGINT)) AS BIGINT) AS cost, max(o_orderdate) AS last FROM orders GROUP BY o_custkey")
def a20_workflow_totals(t):
    rows = t.orders.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return A.workflow_totals(rows, "o_custkey", "o_orderstatus", "cents", "o_orderdate")


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS tools FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def a29_tool_map(t):
    held = A.tool_map(t.events, "user_id", "event_type")
    named = F.transform(F.map_entries("tools"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return held.select("user_id", F.array_join(named, ",").alias("tools"))


@query(TIMED.replace("CAST(epoch(ts) AS BIGINT)", "CAST(floor(epoch(ts)) AS BIGINT)") + " SELECT edit_id FROM e WHERE edit_id NOT IN (SELECT edit_id FROM m)")
def j18_outside_git(t):
    edits, commits = edits_commits(t)
    return V.unmatched(edits, V.timed(edits, commits, after=300, before=600)).select("edit_id")


TASK_EVENTS = """e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'claimed' WHEN 'signup' THEN 'tagged' WHEN 'purchase' THEN 'done' ELSE event_type END AS event,
  CASE WHEN event_id % 3 = 0 THEN '{"title": "t"}' WHEN event_id % 3 = 1 THEN '{"assignee": "a"}' ELSE '{"tags": ["x"]}' END AS payload, CASE WHEN event_id % 11 <> 0 THEN user_id END AS task_id FROM events)"""


@query(f"""WITH {TASK_EVENTS} SELECT event_id, CASE WHEN task_id IS NULL THEN 'no task' WHEN event NOT IN ('opened', 'claimed', 'tagged', 'done') THEN 'unknown event'
  WHEN event = 'opened' AND event_id % 3 <> 0 THEN 'no title' WHEN event = 'claimed' AND event_id % 3 <> 1 THEN 'no assignee' WHEN event = 'tagged' AND event_id % 3 <> 2 THEN 'no tags' END AS error FROM e""")
def e03_e04_shapes(t):
    kind, i = F.col("event_type"), F.col("event_id")
    event = F.when(kind == "click", "opened").when(kind == "view", "claimed").when(kind == "signup", "tagged").when(kind == "purchase", "done").otherwise(kind)
    payload = F.when(i % 3 == 0, '{"title": "t"}').when(i % 3 == 1, '{"assignee": "a"}').otherwise('{"tags": ["x"]}')
    return t.events.select("event_id", K.shape_error(event, payload, F.when(i % 11 != 0, F.col("user_id"))).alias("error"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1997-01-01'")
def e05_list(t):
    tasks = t.orders.select("o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("state"), F.array("o_orderpriority").alias("tags"), F.array().cast("array<string>").alias("options"))
    return K.listed(tasks, ["O", "P"], tag="1-URGENT", decisions=False, since=P.since(F.col("o_orderdate"), "1997-01-01")).select("o_orderkey")


@query(f"WITH {MESSAGES} SELECT session_id, max(msg_idx) + 1 AS mark FROM messages GROUP BY session_id")
def r02_cursor(t):
    marks = messages_from_conversations(t.conversations).groupBy("session_id").agg((F.max("msg_idx") + 1).alias("n"))
    back = marks.select(W.decoded_cursor(W.encoded_cursor(F.col("session_id"), F.lit("m"), F.col("n"))).alias("c"))
    return back.select(F.col("c.session").alias("session_id"), F.col("c.mark").alias("mark"))


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS old, CASE WHEN p_partkey >= 3 THEN CAST(p_partkey // 3 AS VARCHAR) END AS up FROM part)
SELECT 's' AS origin_session, 'n' AS session_id, sha256('n/' || old)[1:32] AS id, sha256('n/' || up)[1:32] AS parent_id FROM p""")
def t14_restamp(t):
    up = F.when(F.col("p_partkey") >= 3, F.floor(F.col("p_partkey") / 3).cast("string"))
    rows = t.part.select(F.lit("s").alias("session_id"), F.col("p_partkey").cast("string").alias("id"), up.alias("parent_id"))
    return T.restamped(rows, "n").select("origin_session", "session_id", "id", "parent_id")


@query(f"WITH {MESSAGES} SELECT session_id, msg_idx, CASE WHEN role = 'assistant' AND trim(coalesce(text, '')) <> '' THEN '<think>' || text || '</think>' || chr(10) || 'said' ELSE 'said' END AS text FROM messages")
def t20_thinking(t):
    rows = messages_from_conversations(t.conversations).withColumn("thinking", F.when(F.col("role") == "assistant", F.col("text"))).withColumn("text", F.lit("said"))
    return T.thinking(rows, "inline").select("session_id", "msg_idx", "text")


@query("""WITH RECURSIVE up(start, id) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 10 = 7 UNION ALL SELECT start, id // 3 FROM up WHERE id >= 3) SELECT CAST(start AS BIGINT) AS start, CAST(id AS BIGINT) AS id FROM up""")
def j13_ways_up(t):
    """The way from a leaf to its root, by doubled steps."""
    links = t.part.where("p_partkey >= 3").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("up"))
    return G.ways_up(links, t.part.where("p_partkey % 10 = 7").select(F.col("p_partkey").alias("id")))
