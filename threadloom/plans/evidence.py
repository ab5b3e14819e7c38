"""Queries on tool calls, patches, commit names, hash chains and task logs, all derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import aggregates as A
from threadloom.operators import search as Q
from threadloom.operators import tasks as K
from threadloom.operators import tools as U
from threadloom.plans.aggregates import EVENTS, events
from threadloom.plans.registry import query

NAMES = ["Bash", "Edit", "Read", "Grep", "apply_patch", "Task", "SendMessage", "TaskStop", "mcp__notes__list", "TodoWrite", "core:Skill"]


def called(t):
    """The driver's events as calls: a tool by the event's number, its input with the keys that it reads."""
    n = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (n % len(NAMES) + 1).cast("int"))
    path = F.concat(F.lit("/r/"), "target")
    input_ = F.to_json(F.struct(
        F.when(name == "Bash", F.concat(F.lit("make "), "target")).alias("command"), F.when(name.isin("Edit", "Read"), path).alias("file_path"), F.when(name == "Grep", F.concat(F.lit("x"), "target")).alias("pattern"),
        F.when(name == "SendMessage", F.col("target")).alias("to"), F.when(name == "Task", F.col("target")).alias("description"), F.when(name == "mcp__notes__list", path).alias("path"),
        F.when(name == "apply_patch", F.concat(F.lit("*** Update File: a/"), "target", F.lit("\n-x\n+y\n*** Move to: b/"), "target", F.lit(" \n"))).alias("patch"), F.when((name == "Bash") & (n % 2 == 0), True).alias("run_in_background"),
    ))
    return events(t).select("session_id", "msg_idx", "ts", n.cast("string").alias("call_id"), name.alias("tool"), input_.alias("input"), (n % 4 == 0).alias("failed"), "target", "event_id")


CALLS = f"""WITH {EVENTS}, c AS (SELECT session_id, msg_idx, event_id, target, event_id % 4 = 0 AS failed, [{", ".join(repr(n) for n in NAMES)}][event_id % {len(NAMES)} + 1] AS tool FROM ev)"""


@query(CALLS + """ SELECT event_id, CASE tool WHEN 'Bash' THEN 'command' WHEN 'Edit' THEN 'file_edit' WHEN 'apply_patch' THEN 'file_edit' WHEN 'Read' THEN 'file_read' WHEN 'mcp__notes__list' THEN 'file_read' WHEN 'Grep' THEN 'search' WHEN 'Task' THEN 'subagent_spawn'
  WHEN 'SendMessage' THEN 'agent_message' WHEN 'TaskStop' THEN 'background' ELSE 'other' END AS op, CASE tool WHEN 'Bash' THEN 'make ' || target WHEN 'Edit' THEN '/r/' || target WHEN 'Read' THEN '/r/' || target WHEN 'mcp__notes__list' THEN '/r/' || target WHEN 'Grep' THEN 'x' || target
  WHEN 'Task' THEN target WHEN 'SendMessage' THEN target END AS target FROM c""")
def p15_operations(t):
    did = U.operation(F.col("tool"), F.col("input"))
    return called(t).select("event_id", did["op"].alias("op"), did["target"].alias("target"))


@query(CALLS + """, e AS (SELECT session_id, msg_idx, CASE tool WHEN 'Bash' THEN 'command' WHEN 'Edit' THEN 'file_edit' WHEN 'apply_patch' THEN 'file_edit' WHEN 'Read' THEN 'file_read' WHEN 'mcp__notes__list' THEN 'file_read' ELSE 'tool' END AS kind,
  unnest(CASE tool WHEN 'Bash' THEN ['make ' || target] WHEN 'Grep' THEN ['x' || target] WHEN 'Task' THEN [target] WHEN 'SendMessage' THEN [target] WHEN 'apply_patch' THEN ['a/' || target, 'b/' || target] WHEN 'TaskStop' THEN [NULL] WHEN 'TodoWrite' THEN [NULL] WHEN 'core:Skill' THEN [NULL] ELSE ['/r/' || target] END) AS target FROM c)
SELECT session_id, msg_idx, kind, target FROM e UNION ALL SELECT session_id, msg_idx, 'error', NULL FROM c WHERE failed""")
def t15_event_rows(t):
    return U.event_rows(called(t)).select("session_id", "msg_idx", "kind", "target")


@query(CALLS + """ SELECT event_id, kind, action FROM (SELECT event_id, CASE tool WHEN 'Bash' THEN 'background_job' WHEN 'Task' THEN 'subagent_spawn' WHEN 'TaskStop' THEN 'background_job' WHEN 'TodoWrite' THEN 'plan' WHEN 'core:Skill' THEN 'skill' END AS kind,
  CASE tool WHEN 'Bash' THEN 'start' WHEN 'Task' THEN 'spawn' WHEN 'TaskStop' THEN 'stop' WHEN 'TodoWrite' THEN 'write' WHEN 'core:Skill' THEN 'load' END AS action, tool <> 'Bash' OR event_id % 2 = 0 AS holds FROM c) WHERE kind IS NOT NULL AND holds""")
def t16_affordances(t):
    found = called(t).withColumn("a", U.affordance(F.col("tool"), F.col("input"))).where("a IS NOT NULL")
    return found.select("event_id", F.col("a.kind").alias("kind"), F.col("a.action").alias("action"))



@query("""SELECT p_partkey, 'src/' || p_brand || '.py' || CASE WHEN p_size % 2 = 0 THEN '|' || trim(p_name) ELSE '' END || '|lib/' || p_partkey AS targets FROM part""")
def p14_patch_targets(t):
    size = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("*** Add File: "), "p_name", F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("*** Begin Patch\n*** Update File: src/"), "p_brand", F.lit(".py  \n+x\n"), size, F.lit("+++ b/lib/"), F.col("p_partkey").cast("string"), F.lit("\t2024\n+++ /dev/null\n"))
    return t.part.select("p_partkey", F.array_join(U.patch_targets(text), "|").alias("targets"))


@query("""WITH o AS (SELECT o_orderkey, md5(CAST(o_orderkey - o_orderkey % 2 AS VARCHAR)) AS sha, 'main ' || upper(md5(CAST(o_orderkey - o_orderkey % 3 % 2 AS VARCHAR))[1:5 + o_orderkey % 6]) || CASE WHEN o_orderkey % 7 = 0 THEN 'z' ELSE '' END || '] done' AS out FROM orders)
SELECT o_orderkey, len(list_filter(regexp_split_to_array(lower(out), '[^0-9a-z]+'), lambda w: regexp_full_match(w, '[0-9a-f]{7,64}') AND (starts_with(w, sha) OR starts_with(sha, w)))) > 0 AS named FROM o""")
def p18_commit_named(t):
    k = F.col("o_orderkey")
    sha = F.md5((k - k % 2).cast("string"))
    short = F.substr(F.md5((k - k % 3 % 2).cast("string")), F.lit(1), (5 + k % 6).cast("int"))
    out = F.concat(F.lit("main "), F.upper(short), F.when(k % 7 == 0, "z").otherwise(""), F.lit("] done"))
    return t.orders.select("o_orderkey", U.names_commit(out, sha).alias("named"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS session_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, session_id LIMIT 25")
def o03_best_of_session(t):
    hits = t.lineitem.select(F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_extendedprice").alias("score"))
    return Q.best_of_session(hits, 25)


# each order is a link of its customer's chain; the hash of every tenth is spoilt, and a link whose number is spoilt breaks at the next
CHAIN = """WITH RECURSIVE l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, CAST(o_orderkey AS VARCHAR) AS body FROM orders),
c AS (SELECT o_custkey, o_orderkey, seq, '' AS prev, sha256('log' || chr(10) || '' || chr(10) || body) AS hash FROM l WHERE seq = 1
  UNION ALL SELECT l.o_custkey, l.o_orderkey, l.seq, c.hash, sha256('log' || chr(10) || c.hash || chr(10) || l.body) FROM c JOIN l ON l.o_custkey = c.o_custkey AND l.seq = c.seq + 1)"""


@query(CHAIN + " SELECT o_custkey, seq, o_orderkey % 10 <> 0 AND (seq = 1 OR lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY seq) % 10 <> 0) AS ok FROM c")
def w07_chain(t):
    """The chain itself is folded from each customer's few orders; then each spoilt hash fails itself and the link behind it."""
    links = F.sort_array(F.collect_list(F.col("o_orderkey")))
    start = F.array().cast("array<struct<key:bigint,prev:string,hash:string>>")

    def link(done, key):
        prev = F.coalesce(F.get(done, F.size(done) - 1)["hash"], F.lit(""))
        hash_ = F.sha2(F.concat(F.lit("log\n"), prev, F.lit("\n"), key.cast("string")), 256)
        return F.concat(done, F.array(F.struct(key.alias("key"), prev.alias("prev"), hash_.alias("hash"))))

    made = t.orders.groupBy("o_custkey").agg(links.alias("keys")).select("o_custkey", F.posexplode(F.aggregate("keys", start, link)).alias("at", "x"))
    spoilt = F.when(F.col("x.key") % 10 == 0, F.reverse("x.hash")).otherwise(F.col("x.hash"))
    rows = made.select("o_custkey", (F.col("at") + 1).alias("seq"), F.col("x.prev").alias("prev"), spoilt.alias("hash"), F.col("x.key").cast("string").alias("body"))
    return A.verified_chain(rows, "o_custkey", "log")


# a customer's orders as a task's log: opened, then claimed, noted, released, tagged, status_set over and over; an order of a number that ends in 0 closes it
LOG = """WITH n AS (SELECT o_custkey AS task, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
g AS (SELECT *, CASE WHEN rn = 1 THEN 'opened' WHEN o_orderkey % 10 = 0 THEN 'done' ELSE ['claimed', 'noted', 'released', 'tagged', 'status_set'][(rn - 2) % 5 + 1] END AS event FROM n),
d AS (SELECT task, min(rn) FILTER (event = 'done') AS d FROM g GROUP BY task),
b AS (SELECT g.task, min(rn) AS b, arg_min(event, rn) AS bad FROM g JOIN d ON g.task = d.task WHERE rn > d AND event IN ('claimed', 'released', 'done') GROUP BY g.task),
k AS (SELECT g.*, d, b, bad FROM g JOIN d ON g.task = d.task LEFT JOIN b ON b.task = g.task WHERE b IS NULL OR rn < b)"""


@query(LOG + """ SELECT CAST(task AS VARCHAR) AS task_id, CASE WHEN max(d) IS NOT NULL THEN 'done' WHEN arg_max(event, CASE WHEN event IN ('claimed', 'released') THEN rn END) = 'claimed' THEN 'claimed' ELSE 'open' END AS state,
  count(*) FILTER (event = 'noted') AS notes, count(*) FILTER (event = 'status_set') AS revisions, CAST(arg_max(o_orderkey, CASE WHEN event = 'status_set' THEN rn END) AS VARCHAR) AS status, max(bad) || ' after done' AS error FROM k GROUP BY task""")
def e01_folded_tasks(t):
    k, rn = F.col("o_orderkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    cycle = F.array(*[F.lit(x) for x in ("claimed", "noted", "released", "tagged", "status_set")])
    log = t.orders.withColumn("rn", rn).select(
        F.lpad(k.cast("string"), 12, "0").alias("id"), F.col("o_custkey").cast("string").alias("task_id"), F.col("o_orderdate").cast("string").alias("ts"), F.lit("me").alias("by"),
        F.when(F.col("rn") == 1, "opened").when(k % 10 == 0, "done").otherwise(F.element_at(cycle, ((F.col("rn") - 2) % 5 + 1).cast("int"))).alias("event"), F.to_json(F.struct(k.cast("string").alias("text"))).alias("payload"),
    )
    return K.fold_tasks(log).select("task_id", "state", F.col("notes").cast("long").alias("notes"), F.col("revisions").cast("long").alias("revisions"), "status", F.regexp_replace("error", "^[0-9]+: ", "").alias("error"))
