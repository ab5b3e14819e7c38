"""Aggregation, window and set queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import aggregates as A
from threadloom.operators import context as C
from threadloom.operators import lanes as L
from threadloom.operators import sessions as S
from threadloom.operators import sets as Z
from threadloom.operators import tools as U
from threadloom.operators import windows as O
from threadloom.plans.catalog import MESSAGES, SESSIONS, catalog
from threadloom.plans.registry import query
from threadloom.sources.conversations import messages_from_conversations

EVENTS = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS msg_idx, ts, event_type AS tool,
         CASE event_type WHEN 'click' THEN 'file_edit' WHEN 'view' THEN 'file_read' WHEN 'signup' THEN 'command' WHEN 'error' THEN 'error' ELSE 'tool' END AS kind,
         event_type <> 'error' AS call, json_extract_string(props, '$.k') AS target, value, event_id FROM events
)"""


def events(t):
    """The event catalog as the driver's stream gives it: one session a user."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = F.col("event_type")
    kind = F.when(e == "click", "file_edit").when(e == "view", "file_read").when(e == "signup", "command").when(e == "error", "error").otherwise("tool")
    return t.events.select(
        F.col("user_id").cast("string").alias("session_id"), rn.cast("long").alias("msg_idx"), "ts", e.alias("tool"), kind.alias("kind"),
        (e != "error").alias("call"), F.get_json_object("props", "$.k").alias("target"), "value", "event_id",
    )


@query("""SELECT count(*) AS sessions, CAST(sum(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 10 END) AS BIGINT) AS messages,
  count(*) FILTER (o_orderkey % 7 = 0) AS uncounted, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders""")
def a01_corpus_stats(t):
    counted = t.orders.withColumn("n", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 10))
    return A.corpus_stats(counted, "n", "o_orderdate", "o_orderdate")


@query("""SELECT coalesce(CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END, '(no cwd)') AS name, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, name LIMIT 10""")
def a01_top_groups(t):
    return A.top_groups(t.orders, F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")), 10, "(no cwd)")


@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN '*' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN '*' ELSE l_linestatus END AS l_linestatus,
  count(*) AS calls, sum(l_quantity) AS l_quantity, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, round(sum(CASE WHEN l_returnflag = 'R' THEN l_tax END), 2) AS cost
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def a02_a06_usage_rollup(t):
    rows = t.lineitem.withColumn("cost", F.when(F.col("l_returnflag") == "R", F.col("l_tax")))
    return A.usage_totals(rows, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_linenumber"], "cost").withColumn("cost", F.round("cost", 2))


@query("""SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def a03_exact_usage(t):
    return A.exact_usage(t.lineitem, ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_suppkey", "l_linenumber")


@query(f"""WITH {EVENTS} SELECT tool, count(*) FILTER (call) AS calls, count(*) FILTER (kind = 'file_edit') AS edits, count(*) FILTER (kind = 'file_read') AS reads,
  count(*) FILTER (kind = 'command') AS commands, count(*) FILTER (kind = 'error') AS errors FROM ev GROUP BY tool""")
def a07_tool_histogram(t):
    return A.tool_histogram(events(t), ["tool"])


@query(f"""WITH {EVENTS} SELECT tool, count(DISTINCT session_id) AS agents, count(*) AS used, min(ts) AS first, max(ts) AS last FROM ev GROUP BY tool""")
def a09_agents_using(t):
    return A.tool_users(events(t))


@query(f"""WITH {EVENTS} SELECT session_id, target, count(*) FILTER (kind = 'file_edit') AS edits, count(*) FILTER (kind = 'file_read') AS reads, max(ts) AS last
  FROM ev GROUP BY session_id, target HAVING count(*) FILTER (kind = 'file_edit') > 0""")
def a11_touched(t):
    return A.touched(events(t))


@query(f"WITH {MESSAGES} SELECT role, CAST(sum(CAST(ceil(length(text) / 2.5::DOUBLE) AS BIGINT) + 12) AS BIGINT) AS tokens, count(*) AS blocks FROM messages GROUP BY role")
def a13_context_by_role(t):
    tokens = F.ceil(F.char_length("text") / 2.5) + 12
    found = C.profile(messages_from_conversations(t.conversations).withColumn("tokens", tokens), ["role"], "tokens")
    return found.select(F.col("name").alias("role"), "tokens", F.col("messages").alias("blocks"))


@query(f"""WITH {EVENTS}, b AS (SELECT *, max(CASE WHEN kind = 'error' THEN msg_idx END) OVER (PARTITION BY session_id) AS cut FROM ev)
SELECT session_id, count(*) AS n_rows, round(max(value), 4) AS peak, round(arg_min(value, msg_idx), 4) AS first, round(arg_max(value, msg_idx), 4) AS current
FROM b WHERE cut IS NULL OR msg_idx > cut GROUP BY session_id""")
def a14_active_window(t):
    kind = F.when(F.col("kind") == "error", "compaction_boundary").otherwise(F.col("kind"))
    live = C.active_window(events(t).select("session_id", "msg_idx", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("parent_id"), kind.alias("kind"), "value"))
    return live.groupBy("session_id").agg(
        F.count("*").alias("n_rows"), F.round(F.max("value"), 4).alias("peak"), F.round(F.min_by("value", "msg_idx"), 4).alias("first"),
        F.round(F.max_by("value", "msg_idx"), 4).alias("current"),
    )


@query("SELECT round(median(o_totalprice), 2) AS mid, count(*) AS n FROM orders")
def a14_median(t):
    return t.orders.agg(F.round(F.median("o_totalprice"), 2).alias("mid"), F.count("*").alias("n"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
  count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def a16_affordance_counts(t):
    return U.affordance_counts(t.events, "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("SELECT o_custkey, string_agg(DISTINCT lower(o_orderpriority), ',' ORDER BY lower(o_orderpriority)) AS models FROM orders GROUP BY o_custkey")
def a17_models(t):
    return A.lowered_values(t.orders, "o_custkey", "o_orderpriority").select("o_custkey", F.array_join("values", ",").alias("models"))


@query(f"""WITH {EVENTS}, l AS (SELECT session_id, min(ts) AS started, max(ts) AS last_turn, arg_max(tool, msg_idx) AS last_tool, count(*) FILTER (call) AS tool_calls, arg_max(kind, msg_idx) AS last_kind FROM ev GROUP BY session_id)
SELECT session_id, started, last_turn, last_tool, tool_calls, CASE WHEN last_kind = 'error' THEN 'stranded' WHEN last_turn <= (SELECT max(ts) FROM events) - INTERVAL 600 SECOND THEN 'returned' ELSE 'running' END AS status FROM l""")
def a18_a19_lanes(t):
    facts = L.lane_facts(events(t))
    silent = Z.quiet(facts, "session_id", "last_turn", 600).select("session_id", F.lit(True).alias("quiet"))
    status = F.when(F.col("last_kind") == "error", "stranded").when(F.col("quiet"), "returned").otherwise("running")
    return facts.join(silent, "session_id", "left").select("session_id", "started", "last_turn", "last_tool", "tool_calls", status.alias("status"))


@query(f"""WITH {EVENTS} SELECT target, edits, n_reads FROM (SELECT target, count(*) FILTER (kind = 'file_edit') AS edits, count(*) FILTER (kind = 'file_read') AS n_reads FROM ev GROUP BY target) ORDER BY edits + n_reads DESC, target LIMIT 12""")
def a21_files(t):
    return A.file_totals(events(t), 12)


@query("""WITH held AS (SELECT l_suppkey, l_linenumber + 7 * (l_orderkey % 5) AS seq FROM lineitem), once AS (SELECT DISTINCT * FROM held),
runs AS (SELECT l_suppkey, min(seq) AS first, max(seq) AS last FROM (SELECT *, seq - row_number() OVER (PARTITION BY l_suppkey ORDER BY seq) AS run FROM once) GROUP BY l_suppkey, run)
SELECT l_suppkey, CAST(coalesce(max(CASE WHEN first = 1 THEN last END), 0) AS BIGINT) AS frontier, max(last) AS highest, count(*) - CASE WHEN min(first) = 1 THEN 1 ELSE 0 END AS gaps FROM runs GROUP BY l_suppkey""")
def a23_w06_frontier(t):
    held = t.lineitem.select("l_suppkey", (F.col("l_linenumber") + 7 * (F.col("l_orderkey") % 5)).alias("seq"))
    return A.frontier(held, ["l_suppkey"], "seq")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT day, n, CAST(least(4, ceil(4.0 * n / (SELECT max(n) FROM d))) AS INT) AS level FROM d""")
def a25_heatmap(t):
    return A.day_levels(t.orders, "o_orderdate")


@query("""SELECT c_mktsegment, count(DISTINCT c_custkey) AS n, count(*) FILTER (o_orderstatus = 'O') AS open, min(o_orderdate) AS first, max(o_orderdate) AS last FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def a26_projects(t):
    both = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    return A.projects(both, "c_mktsegment", "c_custkey", "o_orderdate", {"open": F.col("o_orderstatus") == "O"})


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def a27_distinct(t):
    return Z.different(t.lineitem, ["l_partkey", "l_suppkey"])


@query(f"""WITH {EVENTS}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n FROM ev)
SELECT session_id, msg_idx, greatest(n - 4, 0) AS omitted FROM b WHERE msg_idx < 1 OR back <= 3""")
def a28_overview(t):
    return S.overview(events(t), 1, 3)


@query(f"WITH {EVENTS} SELECT event_id, session_id, msg_idx FROM ev")
def w01_message_index(t):
    return events(t).select("event_id", "session_id", "msg_idx")


@query(f"""WITH {EVENTS}, s AS (SELECT *, sum(CASE WHEN tool = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY msg_idx) AS span FROM ev)
SELECT session_id, CAST(span AS BIGINT) AS span, min(msg_idx) AS first, max(msg_idx) AS last, arg_min(tool, msg_idx) AS opened_by, arg_max(tool, msg_idx) AS closed_by FROM s GROUP BY session_id, span""")
def w02_cycles(t):
    return O.cycles(events(t), "session_id", "msg_idx", F.col("tool") == "signup", "tool")


@query(f"""WITH {EVENTS} SELECT event_id FROM (SELECT event_id, tool, lag(tool) OVER (PARTITION BY session_id ORDER BY msg_idx) AS before FROM ev) WHERE before IS NULL OR before <> tool""")
def w03_w12_skip_repeats(t):
    return O.changes(events(t), "session_id", "msg_idx", "tool").select("event_id")


@query(f"""WITH {EVENTS}, l AS (SELECT event_id, session_id, msg_idx, CASE WHEN event_id % 3 = 0 THEN floor(value / 20) END AS lim FROM ev),
p AS (SELECT *, last_value(lim IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
SELECT event_id, CAST(lim AS BIGINT) AS lim FROM p WHERE lim IS NOT NULL AND before IS DISTINCT FROM lim""")
def w04_limit_changes(t):
    lim = F.when(F.col("event_id") % 3 == 0, F.floor(F.col("value") / 20))
    return O.changes(events(t).withColumn("lim", lim), "session_id", "msg_idx", "lim").select("event_id", "lim")


@query(f"""WITH {EVENTS} SELECT event_id, round(value - lag(value) OVER (PARTITION BY session_id ORDER BY msg_idx), 4) AS burn FROM ev""")
def w05_deltas(t):
    return O.deltas(events(t), "session_id", ["msg_idx"], "value", "burn").select("event_id", F.round("burn", 4).alias("burn"))


@query(f"""WITH {MESSAGES}, h AS (SELECT session_id, msg_idx, sum(length(text)) OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS total, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS rn FROM messages)
SELECT session_id, msg_idx FROM h WHERE total <= 1500 OR rn = 1""")
def w08_newest_within_budget(t):
    m = messages_from_conversations(t.conversations)
    return S.within_budget(m, F.char_length("text"), 1500, newest=True).select("session_id", "msg_idx")


@query(f"""WITH {EVENTS} SELECT event_id, CAST(count(*) FILTER (kind = 'error') OVER (PARTITION BY session_id ORDER BY msg_idx) AS BIGINT) AS window_id FROM ev""")
def w09_window_ids(t):
    return O.spans(events(t), "session_id", "msg_idx", F.col("kind") == "error").select("event_id", F.col("span").alias("window_id"))


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3""")
def w10_top_per_group(t):
    return O.top_per_group(t.lineitem, "l_orderkey", [F.col("l_extendedprice").desc(), F.col("l_linenumber")], 3).select("l_orderkey", "l_linenumber")


@query("""SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS revisions FROM orders GROUP BY o_custkey""")
def w11_latest_status(t):
    return O.latest(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", "status")


@query(f"""WITH {MESSAGES}, h AS (SELECT session_id, msg_idx, sum(length(text)) OVER (PARTITION BY session_id ORDER BY msg_idx) AS total FROM messages) SELECT session_id, msg_idx FROM h WHERE total <= 1000 OR msg_idx = 0""")
def w14_byte_budget(t):
    return S.within_budget(messages_from_conversations(t.conversations), F.char_length("text"), 1000).select("session_id", "msg_idx")


@query("""SELECT event_id, 'live' AS via FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, 'index' AS via FROM events WHERE event_id % 10 <> 0 AND user_id % 2 = 0""")
def u01_live_over_index(t):
    """Rows re-read live shadow their indexed revision."""
    live = t.events.where("event_id % 10 = 0").select("event_id", F.lit("live").alias("via"))
    index = t.events.where("user_id % 2 = 0").select("event_id", F.lit("index").alias("via"))
    return Z.shadowed(index, live, "event_id")


@query("""(SELECT doc_id FROM documents WHERE contains(text, 'the') INTERSECT SELECT doc_id FROM documents WHERE contains(text, 'and')) EXCEPT SELECT doc_id FROM documents WHERE contains(text, 'idiot')""")
def u02_postings(t):
    def having(w):
        return t.documents.where(F.contains("text", F.lit(w))).select("doc_id")

    return Z.matching([having("the"), having("and")], [having("idiot")], "doc_id")


@query("""WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS rn FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY rn) AS seen FROM f GROUP BY user_id""")
def u03_first_seen(t):
    return Z.first_seen(t.events, "user_id", "event_type", ["ts", "event_id"]).select("user_id", F.array_join("seen", ",").alias("seen"))


@query(f"""WITH {SESSIONS} SELECT session_id FROM (SELECT session_id, title, row_number() OVER (PARTITION BY lower(title) ORDER BY n_chars DESC, session_id) AS rn FROM titled) WHERE rn = 1 OR title IS NULL""")
def u04_title_duplicates(t):
    return Z.best_of_duplicates(catalog(t), F.lower("title"), [F.col("n_chars").desc(), F.col("session_id")]).select("session_id")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
def u05_union(t):
    return Z.united(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0) AND c_nationkey <> 3")
def u06_vanished(t):
    """Known customers that a thin inventory misses; nation 3's part of it failed, so none of its customers goes."""
    found = t.orders.where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return Z.vanished(t.customer, found, "c_custkey", F.col("c_nationkey") != 3).select("c_custkey")
