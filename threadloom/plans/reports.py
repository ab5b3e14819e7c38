"""Context, lane, inbox and training-record queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import context as C
from threadloom.operators import lanes as L
from threadloom.operators import records as R
from threadloom.operators import tasks as K
from threadloom.plans.aggregates import EVENTS, events
from threadloom.plans.catalog import MESSAGES
from threadloom.plans.registry import query
from threadloom.sources.conversations import messages_from_conversations

# the driver's events as blocks: clicks call tools, views answer by the same key, purchases think, sign-ups are injected or asked
BLOCKS = f"""WITH {EVENTS}, b AS (SELECT session_id, msg_idx, event_id, CASE tool WHEN 'view' THEN 'tool' WHEN 'signup' THEN 'user' WHEN 'error' THEN 'system' ELSE 'assistant' END AS role,
CASE tool WHEN 'view' THEN 'tool_result' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'injected_context' ELSE 'prompt' END WHEN 'error' THEN 'notice' ELSE 'reply' END AS kind,
CASE tool WHEN 'click' THEN 'tool_use' WHEN 'view' THEN 'tool_result' WHEN 'purchase' THEN 'thinking' ELSE 'text' END AS type, event_id % 97 AS tokens,
CASE WHEN tool = 'click' THEN CASE WHEN CAST(target AS INT) % 2 = 0 THEN 'mcp__' ELSE '' END || 't' || CAST(CAST(target AS INT) % 5 AS VARCHAR) END AS tool, target AS call_id,
CASE WHEN event_id % 4 = 0 THEN 'hook' END AS attachment FROM ev)"""


def blocks(t):
    e, k, n = F.col("tool"), F.col("target").cast("int"), F.col("event_id")
    role = F.when(e == "view", "tool").when(e == "signup", "user").when(e == "error", "system").otherwise("assistant")
    kind = F.when(e == "view", "tool_result").when(e == "signup", F.when(n % 2 == 0, "injected_context").otherwise("prompt")).when(e == "error", "notice").otherwise("reply")
    type_ = F.when(e == "click", "tool_use").when(e == "view", "tool_result").when(e == "purchase", "thinking").otherwise("text")
    tool = F.when(e == "click", F.concat(F.when(k % 2 == 0, "mcp__").otherwise(""), F.lit("t"), (k % 5).cast("string")))
    return events(t).select(
        "session_id", "msg_idx", "event_id", role.alias("role"), kind.alias("kind"), type_.alias("type"), (n % 97).alias("tokens"), tool.alias("tool"), F.col("target").alias("call_id"),
        F.when(n % 4 == 0, "hook").alias("attachment"), "value",
    )


SOURCE = """CASE type WHEN 'thinking' THEN 'thinking' WHEN 'tool_use' THEN 'tool_call_args' WHEN 'tool_result' THEN 'tool_results' ELSE
CASE WHEN kind = 'injected_context' THEN 'attachments' WHEN role = 'assistant' THEN 'assistant_text' WHEN role = 'system' THEN 'system_text' ELSE 'user_text' END END"""


@query(BLOCKS + f" SELECT session_id, {SOURCE} AS source, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS blocks FROM b WHERE kind <> 'notice' GROUP BY ALL")
def a13_context_by_source(t):
    return C.by_source(blocks(t), ["session_id"])


@query(BLOCKS + """, names AS (SELECT session_id, call_id, max(tool) AS tool FROM b WHERE type = 'tool_use' AND call_id IS NOT NULL GROUP BY ALL),
every AS (SELECT tool, 1 AS calls, 0 AS tokens FROM b WHERE type = 'tool_use' UNION ALL SELECT coalesce(n.tool, '(unknown tool)'), 0, b.tokens FROM b LEFT JOIN names n ON b.session_id = n.session_id AND b.call_id = n.call_id WHERE type = 'tool_result')
SELECT tool, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS result_tokens, starts_with(tool, 'mcp__') AS mcp FROM every GROUP BY tool""")
def a13_context_by_tool(t):
    return C.by_tool(blocks(t))


@query(BLOCKS + " SELECT coalesce(attachment, kind) AS attachment, CAST(sum(tokens) AS BIGINT) AS tokens FROM b WHERE kind = 'injected_context' GROUP BY 1")
def a13_context_by_attachment(t):
    return C.by_attachment(blocks(t))


@query(f"""WITH {MESSAGES} SELECT what, name, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS tokens FROM (SELECT text, unnest([{{'what': 'role', 'name': role}}, {{'what': 'kind', 'name': kind}}, {{'what': 'origin', 'name': origin}}], recursive := true) FROM messages) GROUP BY ALL""")
def a24_profile(t):
    return C.profile(messages_from_conversations(t.conversations).withColumn("n", F.char_length("text")), ["role", "kind", "origin"], "n")


WINDOWS = BLOCKS + """, m AS (SELECT b.* EXCLUDE (kind, tokens), CASE WHEN type = 'thinking' AND b.event_id % 7 = 0 THEN 'compaction_boundary' WHEN type = 'text' AND b.event_id % 5 = 0 THEN 'compaction_summary' ELSE kind END AS kind,
  tokens, CASE WHEN b.event_id % 3 = 0 THEN CAST(floor(value * 100) AS BIGINT) END AS prompt_tokens, CASE WHEN b.event_id % 4 = 0 THEN CAST(b.msg_idx // 8 AS VARCHAR) END AS usage_key FROM b JOIN (SELECT event_id, value FROM events) v ON v.event_id = b.event_id),
c AS (SELECT *, max(CASE WHEN kind = 'compaction_boundary' THEN msg_idx END) OVER p AS lb, max(CASE WHEN kind = 'compaction_summary' THEN msg_idx END) OVER p AS ls FROM m WINDOW p AS (PARTITION BY session_id)),
w AS (SELECT *, coalesce('k' || usage_key, 'm' || CAST(msg_idx AS VARCHAR)) AS key, kind NOT IN ('notice', 'compaction_boundary') AS shown, lb IS NOT NULL OR ls IS NOT NULL AS compacted
  FROM c WHERE msg_idx >= coalesce(CASE WHEN lb IS NULL OR ls > lb + 1 THEN ls ELSE lb + 1 END, 0)),
r AS (SELECT session_id, key, min(msg_idx) AS pos, max(prompt_tokens) AS rd FROM w WHERE prompt_tokens > 0 GROUP BY ALL),
f AS (SELECT session_id, min(pos) AS first_at, arg_min(rd, pos) AS first_prompt, arg_max(rd, pos) AS current, max(rd) AS peak, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT w.session_id, bool_or(compacted) AS compacted, count(*) AS messages, count(*) FILTER (shown AND role = 'user' AND kind = 'prompt') AS asked, count(DISTINCT CASE WHEN shown AND role = 'assistant' THEN key END) AS replies,
  CAST(coalesce(sum(tokens) FILTER (shown), 0) AS BIGINT) AS total, CAST(coalesce(sum(tokens) FILTER (shown AND msg_idx < first_at), 0) AS BIGINT) AS before FROM w LEFT JOIN f ON w.session_id = f.session_id GROUP BY ALL),
report AS (SELECT s.session_id, compacted, messages, CASE WHEN asked > 0 THEN asked WHEN replies > 0 THEN replies ELSE 1 END AS turns, total, first_prompt, CASE WHEN first_prompt IS NOT NULL THEN before END AS shown_before,
  CASE WHEN first_prompt IS NOT NULL THEN greatest(first_prompt - before, 0) END AS overhead, current, coalesce(peak, 0) AS peak, CASE WHEN n >= 2 AND current > first_prompt THEN current - first_prompt ELSE 0 END AS burn,
  CASE WHEN n >= 2 AND current > first_prompt THEN n - 1 ELSE 0 END AS steps FROM s LEFT JOIN f ON s.session_id = f.session_id)"""


def window_rows(t):
    n = F.col("event_id")
    kind = F.when((F.col("type") == "thinking") & (n % 7 == 0), "compaction_boundary").when((F.col("type") == "text") & (n % 5 == 0), "compaction_summary").otherwise(F.col("kind"))
    nothing = F.lit(None).cast("string")
    return blocks(t).select(
        "session_id", "msg_idx", nothing.alias("id"), nothing.alias("parent_id"), "role", kind.alias("kind"), "tokens", F.when(n % 3 == 0, F.floor(F.col("value") * 100)).alias("prompt_tokens"),
        F.when(n % 4 == 0, F.floor(F.col("msg_idx") / 8).cast("string")).alias("usage_key"),
    )


@query(WINDOWS + " SELECT * FROM report")
def a14_window_report(t):
    return C.window_reports(window_rows(t))


@query(WINDOWS + """ SELECT count(*) AS sessions, count(*) FILTER (compacted) AS compacted, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(total) AS BIGINT) AS total, max(peak) AS peak,
  CAST(floor(median(overhead)) AS BIGINT) AS overhead, CAST(CASE WHEN sum(steps) > 0 THEN sum(burn) // sum(steps) ELSE sum(total) // sum(turns) END AS BIGINT) AS burn_per_turn FROM report""")
def a14_window_overall(t):
    return C.overall(C.window_reports(window_rows(t)))


# lanes with evidence of every kind, spread over the sessions by their number, each below the one of a third of its number
LANES = f"""WITH RECURSIVE {EVENTS}, g AS (SELECT session_id, CAST(session_id AS BIGINT) AS n, min(ts) AS started, max(ts) AS last_turn, arg_max(tool, msg_idx) AS last_tool, count(*) FILTER (call) AS tool_calls, arg_max(kind, msg_idx) IN ('file_read', 'command') AS reported,
  count(*) FILTER (kind = 'tool') % 2 AS open_tool_calls FROM ev GROUP BY session_id),
l AS (SELECT *, CASE WHEN n % 13 = 5 THEN 'done' END AS journal, CASE n % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'killed' END AS notice, last_turn + INTERVAL 1 SECOND * (n % 3 - 1) AS notice_at,
  CASE n % 4 WHEN 0 THEN true WHEN 1 THEN false END AS stop_seen, CASE WHEN n % 8 = 4 THEN 'parked' END AS parked, n % 6 = 3 AS exited, last_turn AS exit_at, CASE WHEN n % 7 = 1 THEN last_turn END AS ledger_at FROM g),
v AS (SELECT *, CASE WHEN notice IS NULL THEN false WHEN (notice = 'running' AND stop_seen IS true) OR (notice = 'completed' AND stop_seen IS false) THEN notice_at > last_turn ELSE notice_at >= last_turn END AS timely FROM l),
s AS (SELECT *, CASE WHEN journal IS NOT NULL THEN journal WHEN timely THEN notice WHEN stop_seen IS true THEN coalesce(parked, 'stopped') WHEN exited THEN CASE WHEN reported THEN 'returned' ELSE 'stopped' END WHEN ledger_at IS NOT NULL THEN 'stopped'
    WHEN reported AND epoch((SELECT max(ts) FROM events)) // 1 - epoch(last_turn) // 1 >= 600 THEN 'returned' ELSE 'running' END AS status,
  CASE WHEN journal IS NOT NULL THEN 'journal' WHEN timely THEN 'task_notification' WHEN stop_seen IS true THEN 'subagent_stop' WHEN exited THEN 'process_exit' WHEN ledger_at IS NOT NULL THEN 'hook_ledger' ELSE 'transcript' END AS source FROM v),
o AS (SELECT *, CASE WHEN n >= 3 THEN n // 3 END AS up, open_tool_calls > 0 OR (source = 'process_exit' AND status = 'stopped') AS owes FROM s),
walk(n, up) AS (SELECT n, up FROM o WHERE owes OR status NOT IN ('completed', 'done', 'returned') UNION SELECT o.n, o.up FROM walk JOIN o ON o.n = walk.up),
d AS (SELECT up AS n, count(*) AS unreturned FROM (SELECT DISTINCT n, up FROM walk WHERE up IS NOT NULL) GROUP BY up),
z AS (SELECT o.*, coalesce(d.unreturned, 0) AS unreturned, status NOT IN ('running', 'failed', 'killed') AND (owes OR coalesce(d.unreturned, 0) > 0) AS stranded FROM o LEFT JOIN d ON d.n = o.n)"""


def lanes(t):
    e = events(t)
    calls = e.groupBy(F.col("session_id").alias("_of")).agg((F.count_if(F.col("kind") == "tool") % 2).alias("open_tool_calls"))
    facts = L.lane_facts(e).join(calls, F.col("session_id").eqNullSafe(F.col("_of")))  # events of no user are a lane too
    n, last = F.col("session_id").cast("long"), F.col("last_turn").cast("timestamp")
    evidence = facts.select(
        "session_id", F.when(n >= 3, F.floor(n / 3).cast("string")).alias("parent_id"), last.alias("last_turn"), "last_tool", "tool_calls", "open_tool_calls", F.col("last_kind").isin("file_read", "command").alias("reported"),
        F.when(n % 13 == 5, "done").alias("journal"), F.when(n % 5 == 0, "completed").when(n % 5 == 1, "running").when(n % 5 == 2, "killed").alias("notice"), F.timestamp_micros(F.unix_micros(last) + (n % 3 - 1) * 1_000_000).alias("notice_at"),
        F.when(n % 4 == 0, True).when(n % 4 == 1, False).alias("stop_seen"), F.when(n % 8 == 4, "parked").alias("parked"), (n % 6 == 3).alias("exited"), last.alias("exit_at"), F.when(n % 7 == 1, last).alias("ledger_at"),
        F.lit(0).alias("open_tasks"), F.lit(0).alias("open_decisions"),
    )
    now = e.agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    told = evidence.join(F.broadcast(now)).withColumn("v", L.verdict(F.col("now")))
    return L.obligations(told.withColumns({"status": F.col("v.status"), "source": F.col("v.source")}).drop("v", "now"))


@query(LANES + " SELECT session_id, last_tool, tool_calls, status, source, unreturned, stranded, status IN ('completed', 'done', 'returned') AND NOT stranded AS finished FROM z")
def a18_a19_lane_verdicts(t):
    return lanes(t).select("session_id", "last_tool", "tool_calls", "status", "source", "unreturned", "stranded", "finished")


@query(LANES + f""", {MESSAGES}, talk AS (SELECT session_id, arg_min(text, CASE WHEN kind = 'prompt' THEN msg_idx END) AS prompt, arg_max(text, CASE WHEN role = 'assistant' AND trim(text) <> '' THEN msg_idx END) AS last_note FROM messages GROUP BY 1),
once AS (SELECT session_id, kind, target, min(msg_idx) AS pos FROM ev WHERE target IS NOT NULL AND kind IN ('file_edit', 'command') GROUP BY ALL),
lists AS (SELECT session_id, string_agg(target, ',' ORDER BY pos) FILTER (kind = 'file_edit') AS files, string_agg(target, ',' ORDER BY pos) FILTER (kind = 'command') AS commands FROM once GROUP BY 1)
SELECT z.session_id, status, prompt, coalesce(files, '') AS files, coalesce(commands, '') AS commands, last_note FROM z LEFT JOIN talk ON talk.session_id = z.session_id LEFT JOIN lists ON lists.session_id = z.session_id WHERE status <> 'done'""")
def t21_salvage(t):
    left = L.salvage(lanes(t), messages_from_conversations(t.conversations), events(t))
    return left.withColumns({c: F.array_join(c, ",") for c in ("files", "commands")})


TASKS = """WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'web:' ELSE '' END || CAST(o_custkey % 40 AS VARCHAR) AS assignee,
CASE WHEN o_orderkey % 11 = 0 THEN 'resolved' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'claimed' ELSE 'open' END AS state, o_orderkey % 3 = 0 OR o_orderkey % 11 = 0 AS decision, o_orderkey % 9 = 0 AS parked,
o_orderkey % 2 = 1 AS provisional, CAST(o_custkey % 7 AS VARCHAR) AS last_by, o_orderdate AS last_ts, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate - INTERVAL 9 DAY END AS posed_at, o_orderdate - INTERVAL 2 DAY AS resolved_at FROM orders),
r AS (SELECT task_id, regexp_replace(assignee, '^web:', '') AS who, state, last_by, last_ts, state = 'resolved' AND provisional AS veto, CASE WHEN state = 'resolved' AND provisional THEN 'provisional' WHEN state IN ('resolved', 'done') THEN NULL
  WHEN decision AND parked THEN 'discussing' WHEN decision THEN 'decision_owed' WHEN state = 'open' THEN 'assigned_open' ELSE 'claimed' END AS reason, posed_at, resolved_at FROM t),
i AS (SELECT who, task_id, CASE WHEN reason IS NULL THEN CASE WHEN last_ts >= TIMESTAMP '1995-01-01' OR who = '3' OR last_by = '3' THEN 'closed' END WHEN last_ts >= TIMESTAMP '1995-01-01' OR who = '3' OR last_by = '3' THEN 'open' ELSE 'hidden' END AS section, reason,
  CASE reason WHEN 'provisional' THEN resolved_at WHEN 'decision_owed' THEN coalesce(posed_at, last_ts) ELSE last_ts END AS since, last_by <> who AS unread FROM r),
x AS (SELECT * FROM i WHERE section IS NOT NULL)"""


def inbox_items(t):
    k, date = F.col("o_orderkey"), F.col("o_orderdate")
    state = F.when(k % 11 == 0, "resolved").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "claimed").otherwise("open")
    nothing = F.array().cast("array<string>")
    tasks = t.orders.select(
        k.cast("string").alias("task_id"), F.lit("").alias("title"), F.concat(F.when(k % 2 == 0, "web:").otherwise(""), (F.col("o_custkey") % 40).cast("string")).alias("assignee"), state.alias("state"),
        F.when((k % 3 == 0) | (k % 11 == 0), F.array(F.lit("yes"), F.lit("no"))).otherwise(nothing).alias("options"), F.when(k % 9 == 0, F.array(F.lit("discuss"))).otherwise(nothing).alias("tags"), (k % 2 == 1).alias("provisional"),
        (F.col("o_custkey") % 7).cast("string").alias("last_by"), date.alias("last_ts"), F.when(k % 4 != 0, date - F.expr("INTERVAL 9 DAY")).alias("posed_at"), (date - F.expr("INTERVAL 2 DAY")).alias("resolved_at"),
    )
    return K.inboxes(tasks, F.lit("1995-01-01").cast("timestamp"), caller="3")


@query(TASKS + f""" SELECT who, {", ".join(f"count(*) FILTER (section = 'open' AND reason = '{r}') AS {r}" for r in K.REASONS)}, count(*) FILTER (section = 'open' AND unread) AS unread, count(*) FILTER (section = 'closed') AS closed,
  count(*) FILTER (section = 'hidden') AS hidden, min(since) FILTER (section = 'open') AS oldest FROM x GROUP BY who""")
def e10_inbox_counts(t):
    return K.inbox_counts(inbox_items(t))


@query(TASKS + """ SELECT * FROM (SELECT who, task_id, section, reason, since, unread, row_number() OVER (PARTITION BY who, section ORDER BY CASE WHEN section = 'closed' THEN -epoch_us(since) ELSE epoch_us(since) END, task_id) AS place FROM x) WHERE place <= 10""")
def e10_inbox_items(t):
    return K.inbox_page(inbox_items(t), 10).drop("title")


# tools turns answer the assistant's turn before them; every third call has no id
TOOLED = f"""WITH {MESSAGES}, t AS (SELECT session_id, msg_idx, role, kind, text, trim(coalesce(text, '')) = '' AS blank FROM messages WHERE role <> 'system'),
j AS (SELECT session_id, msg_idx, CASE WHEN role = 'assistant' THEN '{{"role":"assistant","content":' || CASE WHEN blank THEN 'null' ELSE CAST(to_json(text) AS VARCHAR) END ||
    ',"tool_calls":[{{"id":' || CAST(to_json('c' || CAST(msg_idx AS VARCHAR)) AS VARCHAR) || ',"type":"function","function":{{"name":"look","arguments":"{{}}"}}}}]}}'
  WHEN role = 'tool' THEN '{{"role":"tool","tool_call_id":' || CAST(to_json('c' || CAST(msg_idx - 1 AS VARCHAR)) AS VARCHAR) || ',"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}}'
  WHEN NOT blank THEN '{{"role":"user","content":' || CAST(to_json(text) AS VARCHAR) || '}}' END AS turn FROM t)
SELECT session_id, '{{"messages":[' || string_agg(turn, ',' ORDER BY msg_idx) || ']}}' AS record FROM j WHERE turn IS NOT NULL GROUP BY session_id"""

BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean>"


def called(t):
    """Conversations as typed blocks: each assistant turn calls ``look``, each tool turn answers the turn before it."""
    m = messages_from_conversations(t.conversations)
    nothing, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    named = lambda idx: F.concat(F.lit("c"), idx.cast("string"))
    said = F.struct(F.lit("text"), F.col("text"), nothing, nothing, nothing, nothing, no).cast(BLOCK)
    call = F.struct(F.lit("tool_use"), nothing, named(F.col("msg_idx")), F.lit("look"), F.lit("{}"), nothing, no).cast(BLOCK)
    result = F.struct(F.lit("tool_result"), F.col("text"), nothing, nothing, nothing, named(F.col("msg_idx") - 1), no).cast(BLOCK)
    content = F.when(F.col("role") == "assistant", F.array(said, call)).when(F.col("role") == "tool", F.array(result)).otherwise(F.array(said))
    return m.withColumn("content", content).withColumn("id", nothing).withColumn("ts", F.lit(None).cast("timestamp"))


@query(TOOLED)
def t05_openai_tools(t):
    return R.openai_tools(called(t))


@query(f"""WITH {MESSAGES}, s AS (SELECT *, count(*) FILTER (kind = 'prompt' AND trim(coalesce(text, '')) <> '') OVER (PARTITION BY session_id ORDER BY msg_idx) AS n FROM messages),
a AS (SELECT session_id, n, count(*) AS calls, arg_min(text, CASE WHEN trim(coalesce(text, '')) <> '' THEN msg_idx END) AS first, arg_max(text, CASE WHEN trim(coalesce(text, '')) <> '' THEN msg_idx END) AS last FROM s WHERE kind = 'reply' GROUP BY ALL),
h AS (SELECT * FROM s WHERE kind = 'prompt' AND trim(coalesce(text, '')) <> '' AND n > 1)
SELECT h.session_id AS session, h.n - 1 AS index, h.text AS prompt, starts_with(ltrim(h.text), '[from ') AS relayed, b.last AS report, p.first AS plan, coalesce(b.calls, 0) AS tool_calls_before, coalesce(p.calls, 0) AS tool_calls_after
FROM h LEFT JOIN a b ON b.session_id = h.session_id AND b.n = h.n - 1 LEFT JOIN a p ON p.session_id = h.session_id AND p.n = h.n""")
def t07_cycle_rows(t):
    return R.cycle_rows(called(t)).select("session", "index", "prompt", "relayed", "report", "plan", "tool_calls_before", "tool_calls_after")


@query("""SELECT n_nationkey, n_name, c_custkey, orphan FROM (SELECT n_nationkey, n_name, c_custkey, false AS orphan FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 4 <> 1
  UNION ALL SELECT c_nationkey, NULL, c_custkey, true FROM customer WHERE c_nationkey % 4 = 1)""")
def j16_phase_tree(t):
    """Phases of a quarter of the nations are unknown, so their agents are orphans."""
    agents = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return L.phase_tree(agents, t.nation.where("n_nationkey % 4 <> 1").select("n_nationkey", "n_name"), ["n_nationkey"]).select("n_nationkey", "n_name", "c_custkey", "orphan")


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS final, o_orderkey - 1 AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 END AS b FROM orders)
SELECT CAST(t.id AS VARCHAR) AS task_id, NOT coalesce(x.final, false) OR (t.b IS NOT NULL AND NOT coalesce(y.final, false)) AS is_blocked FROM t LEFT JOIN t x ON x.id = t.a LEFT JOIN t y ON y.id = t.b""")
def j15_e07_blocked(t):
    """Each order waits for the number before it and for half its own number; numbers that no order has block too."""
    k = F.col("o_orderkey")
    blockers = F.filter(F.array((k - 1).cast("string"), F.when(k % 2 == 0, F.floor(k / 2).cast("string"))), lambda b: b.isNotNull())
    tasks = t.orders.select(k.cast("string").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("state"), blockers.alias("blocked_by"))
    return K.blocked(tasks)
