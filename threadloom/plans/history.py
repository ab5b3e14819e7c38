"""Excerpts, line origins and receipts over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions.canonical import canonical_json, receipt_hash
from threadloom.operators.blame import blame
from threadloom.operators.commits import merged_branches, sweep
from threadloom.operators.distill import CALLS, RESULTS, distill
from threadloom.operators.excerpts import K1, best_windows, task_words
from threadloom.operators.revive import revive
from threadloom.plans.catalog import MESSAGES
from threadloom.plans.registry import query
from threadloom.sources.conversations import messages_from_conversations

TASK = "thre thtion lich erth"


def _fit_sql(task: str) -> str:
    """The score in SQL: counts of the task's words in the tokens, damped by their number."""
    damp = "(1.2 * (0.25 + 0.75 * (len(tokens) / 40.0)))"
    parts = []
    for w in task_words(task):
        n = f"len(list_filter(tokens, lambda t: t = '{w}'))"
        part = f"CASE WHEN contains(low, '{w}') THEN 0.35 ELSE 0.0 END" if len(w) >= 4 else "0.0"
        one = f"(CASE WHEN {n} > 0 THEN {n}::DOUBLE ELSE {part} END)"
        parts.append(f"({one} * {K1 + 1}::DOUBLE / ({one} + {damp}))")
    parts.append(f"CASE WHEN contains(low, '{task.lower()}') THEN (2.5 * {K1 + 1}::DOUBLE) / (1 + {damp}) ELSE 0.0 END")
    return f"CASE WHEN len(tokens) = 0 THEN 0 ELSE CAST(round(({' + '.join(parts)}) * 10000) AS BIGINT) END"


@query(f"""WITH {MESSAGES}, able AS (SELECT session_id, msg_idx, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS said FROM messages WHERE role <> 'tool'),
words AS (SELECT session_id, msg_idx, lower(said) AS low, regexp_extract_all(lower(said), '[\\p{{L}}\\p{{N}}_]+') AS tokens FROM able WHERE said <> ''),
scored AS (SELECT session_id, msg_idx, {_fit_sql(TASK)} AS score FROM words),
near AS (SELECT *, coalesce(lag(msg_idx) OVER w, msg_idx) AS lo, coalesce(lead(msg_idx) OVER w, msg_idx) + 1 AS hi FROM scored WINDOW w AS (PARTITION BY session_id ORDER BY msg_idx))
SELECT session_id, score, lo, hi FROM near QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, msg_idx) = 1""")
def q13_best_windows(t):
    return best_windows(messages_from_conversations(t.conversations), TASK, 1 << 20).select("session_id", "score", "lo", "hi")


RECEIPTS = "threadloom-receipt"


@query(f"""SELECT event_id, sha256('{RECEIPTS}' || chr(10) || prev || chr(10) || body) AS hash FROM (
  SELECT event_id, coalesce(sha256(CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR)), '') AS prev,
    '{{{{"id":' || event_id || ',"props":' || replace(replace(props, ': ', ':'), ', ', ',') || ',"type":"' || event_type || '","value":[{{{{"a":true,"z":null}}}}]}}}}' AS body FROM events)""".replace("{{", "{").replace("}}", "}"))
def p19_receipts(t):
    """Bodies with their keys out of order and loose white space; the SQL writes them in canonical order itself."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    prev = F.coalesce(F.sha2(F.lag("event_id").over(own).cast("string"), 256), F.lit(""))
    body = F.format_string('{ "value": [ {"z":null, "a": true} ], "type":"%s",  "props":%s, "id": %d }', "event_type", "props", "event_id")
    return t.events.select("event_id", prev.alias("prev"), body.alias("body")).select("event_id", receipt_hash(RECEIPTS, F.col("prev"), F.col("body")).alias("hash"))


@query("SELECT event_id, replace(replace(props, ': ', ':'), ', ', ',') AS body FROM events")
def p19_canonical(t):
    return t.events.select("event_id", canonical_json("props").alias("body"))


# a file for each supplier, a commit for each of its lines with one hunk whose place and size come from the row
HUNKS = """h AS (SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq, l_orderkey * 10 + l_linenumber AS commit_id,
  1 + l_partkey % 300 AS start, CAST(l_quantity AS BIGINT) % 4 AS lines, l_linenumber % 3 AS gone FROM lineitem)"""


@query(f"""WITH RECURSIVE {HUNKS}, top AS (SELECT file, max(seq) AS seq FROM h GROUP BY file),
walk(file, line, seq, pos, commit_id) AS (
  SELECT file, line, seq, line, NULL::BIGINT FROM top, (SELECT unnest(range(1, 101)) AS line)
  UNION ALL
  SELECT w.file, w.line, w.seq - 1, CASE WHEN w.pos >= h.start + h.lines THEN w.pos - h.lines + h.gone ELSE w.pos END,
    CASE WHEN w.pos >= h.start AND w.pos < h.start + h.lines THEN h.commit_id END
  FROM walk w JOIN h ON h.file = w.file AND h.seq = w.seq WHERE w.commit_id IS NULL)
SELECT file, line, pos AS origin, CAST(commit_id AS VARCHAR) AS commit_id FROM walk WHERE commit_id IS NOT NULL OR seq = 0""")
def s25_blame(t):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    start, lines, gone = 1 + F.col("l_partkey") % 300, F.col("l_quantity").cast("long") % 4, (F.col("l_linenumber") % 3).cast("long")
    # in a diff a hunk without new or old lines names the line before it
    hunk = F.struct((start - F.when(gone == 0, 1).otherwise(0)).alias("old_start"), gone.alias("old_lines"), (start - F.when(lines == 0, 1).otherwise(0)).alias("new_start"), lines.alias("new_lines"))
    file = F.col("l_suppkey").cast("string").alias("file")
    commits = t.lineitem.select(file, F.row_number().over(order).alias("seq"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("commit_id"), F.array(hunk).alias("hunks"))
    found = blame(commits, t.lineitem.select(file).distinct().select("file", F.lit(1).alias("first"), F.lit(100).alias("last")))
    each = found.select("file", "commit_id", "first", "origin", F.posexplode(F.sequence("first", "last")).alias("k", "line"))
    return each.select(F.col("file").cast("long").alias("file"), F.col("line").cast("long").alias("line"), (F.col("origin") + F.col("k")).alias("origin"), "commit_id")


@query(f"""WITH {MESSAGES}, cut AS (SELECT session_id, min(msg_idx) FILTER (role = 'user') AS prompt, coalesce(max(msg_idx) FILTER (role <> 'assistant') + 1, 0) AS start FROM messages GROUP BY session_id)
SELECT session_id, any_value(start) AS tail_start, count(*) AS messages, count(*) FILTER (msg_idx < start AND trim(text) <> '' AND msg_idx IS DISTINCT FROM prompt AND role IN ('user', 'assistant')) AS timeline_entries,
  coalesce(sum(strlen(text)) FILTER (msg_idx >= start), 0)::BIGINT AS tail_bytes, sum(strlen(text))::BIGINT AS source_bytes, max(text) FILTER (msg_idx = prompt) AS brief
FROM messages JOIN cut USING (session_id) GROUP BY session_id""")
def t11_distill(t):
    """Conversations have no tool calls, so the tail is the agent's last run of messages; the fold of calls is held against a plain one in tests."""
    none = [F.array().cast(CALLS).alias("calls"), F.array().cast(RESULTS).alias("results")]
    done = distill(messages_from_conversations(t.conversations).select("session_id", F.col("msg_idx").cast("int").alias("msg_idx"), "role", "kind", "text", *none))
    counts = done.stats.select("session_id", "tail_start", "messages", "timeline_entries", "tail_bytes", "source_bytes")
    return counts.join(done.brief.select("session_id", F.col("text").alias("brief")), "session_id", "left")


# orders as the commits of fifty repositories, two lines of history that merge now and then and break sometimes
GRAPH = """c AS (SELECT o_custkey % 50 AS repo, o_orderkey AS id, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders),
links AS (SELECT a.repo, a.id, b.id AS parent FROM c a JOIN c b ON a.repo = b.repo AND b.n = a.n - 2 WHERE a.id % 97 <> 0 UNION ALL SELECT a.repo, a.id, b.id FROM c a JOIN c b ON a.repo = b.repo AND b.n = a.n - 3 WHERE a.id % 5 = 0)"""


@query(f"""WITH RECURSIVE {GRAPH}, reach(repo, id) AS (SELECT repo, arg_max(id, n) FROM c GROUP BY repo UNION SELECT l.repo, l.parent FROM reach r JOIN links l ON r.repo = l.repo AND r.id = l.id),
merged AS (SELECT repo, 'task/' || id AS name FROM c JOIN reach USING (repo, id) WHERE status = 'F'),
named AS (SELECT repo, id, unnest(list_distinct(['task/' || id, 'task/' || CAST(id AS VARCHAR)[:8], 'task/' || CAST(id AS VARCHAR)[:13], 'task/' || (id + 1)])) AS name FROM c WHERE id % 4 <> 0)
SELECT CAST(n.id AS VARCHAR) AS task_id, 'open' AS state, array_to_string(list_sort(list(DISTINCT name)), ',') AS branches FROM named n JOIN merged m USING (repo, name) GROUP BY n.id""")
def e09_sweep(t):
    repo, own = (F.col("o_custkey") % 50).cast("string"), F.col("o_orderkey").cast("string")
    order = Window.partitionBy("repo").orderBy("o_orderkey")
    held = t.orders.select(repo.alias("repo"), "o_orderkey", own.alias("id"), "o_orderstatus")
    first = F.when(F.col("o_orderkey") % 97 != 0, F.lag("id", 2).over(order))
    second = F.when(F.col("o_orderkey") % 5 == 0, F.lag("id", 3).over(order))
    commits = held.select("repo", "id", F.col("o_orderkey").alias("seq"), F.array(first, second).alias("parents"))
    remote = F.col("o_orderkey") % 2 == 1
    branches = held.where("o_orderstatus = 'F'").select("repo", F.concat(F.when(remote, "origin/").otherwise(""), F.lit("task/"), "id").alias("name"), "id", remote.alias("remote"))
    mains = held.groupBy("repo").agg(F.max_by("id", "o_orderkey").alias("id")).select("repo", F.lit("main").alias("name"), "id", F.lit(False).alias("remote"))
    title = F.concat(F.lit("after refs/heads/task/"), (F.col("o_orderkey") + 1).cast("string"))
    tasks = held.select(F.col("id").alias("task_id"), F.when(F.col("o_orderkey") % 4 == 0, "done").otherwise("open").alias("state"), title.alias("title"), "repo")
    found = sweep(tasks, merged_branches(commits, branches.unionByName(mains)))
    return found.select("task_id", "state", F.array_join("branches", ",").alias("branches"))


@query(f"""WITH {MESSAGES}, r AS (SELECT session_id, msg_idx, length(text) // 2 AS b, CASE WHEN length(text) > 300 THEN 20 ELSE length(text) // 2 END AS a, CASE WHEN role = 'assistant' THEN 400 * (1 + msg_idx // 3) END AS used,
  msg_idx = 2 AND session_id::BIGINT % 3 = 0 AS boundary, msg_idx = 4 AND session_id::BIGINT % 7 = 0 AS side, CASE session_id::BIGINT % 4 WHEN 0 THEN 'claude-opus-4-6' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN '<synthetic>' END AS model FROM messages),
w AS (SELECT *, coalesce(max(CASE WHEN boundary THEN msg_idx + 1 END) OVER (PARTITION BY session_id), 0) AS start FROM r),
h AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY msg_idx) - b AS prefix FROM w WHERE NOT side AND msg_idx >= start),
u AS (SELECT *, lag(used) OVER o AS prev, row_number() OVER o AS rn FROM h WHERE used > 0 WINDOW o AS (PARTITION BY session_id ORDER BY msg_idx)),
p AS (SELECT *, used - lag(used) OVER o AS grew, prefix - lag(prefix) OVER o AS span FROM u WHERE prev IS DISTINCT FROM used AND NOT (start > 0 AND rn = 1) WINDOW o AS (PARTITION BY session_id ORDER BY msg_idx)),
g AS (SELECT session_id, max(msg_idx) AS anchor, arg_max(used, msg_idx) AS recorded, count(*) AS n, min(greatest(used - prefix, 0)) AS overhead, coalesce(sum(span) FILTER (grew > 0 AND span > 0), 0) AS est, coalesce(sum(grew) FILTER (grew > 0 AND span > 0), 0) AS rec FROM p GROUP BY session_id),
s AS (SELECT h.session_id, any_value(start) AS start, arg_max(model, msg_idx) FILTER (model <> '<synthetic>') AS model, sum(a) AS content, coalesce(sum(a) FILTER (msg_idx >= anchor), 0) AS tail, coalesce(sum(a - b) FILTER (msg_idx < anchor AND a < b), 0) AS less,
  coalesce(sum(a - b) FILTER (msg_idx < anchor AND a > b), 0) AS more, any_value(recorded) AS recorded, any_value(n) AS n, any_value(overhead) AS overhead, any_value(est) AS est, any_value(rec) AS rec FROM h LEFT JOIN g USING (session_id) GROUP BY h.session_id),
k AS (SELECT *, CASE WHEN model IS DISTINCT FROM 'claude-opus-4-6' AND n >= 2 AND est >= 128 AND rec > 0 THEN greatest(least(est / rec, 2.5::DOUBLE), 0.5::DOUBLE) WHEN model = 'claude-opus-4-6' THEN 1.35::DOUBLE WHEN model = 'gpt-4o' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM s),
e AS (SELECT session_id, start, CAST(ceil(greatest((coalesce(overhead, 20000) + content) / scale, coalesce(recorded + tail * 1.1::DOUBLE + (less * 0.8::DOUBLE / scale + more * 1.1::DOUBLE), 0)) * 1.05::DOUBLE) AS BIGINT) AS estimate FROM k)
SELECT w.session_id, msg_idx, CASE WHEN over THEN estimate ELSE used END AS used, CASE WHEN over THEN used END AS orig_used
FROM (SELECT w.*, estimate, coalesce(NOT side AND msg_idx >= w.start AND used > estimate, false) AS over FROM w LEFT JOIN e USING (session_id)) w""")
def t10_revive(t):
    number, length = F.col("session_id").cast("long"), F.char_length("text")
    half = F.floor(length / 2)
    none = [F.lit(0).alias(f"{s}_{p}") for s in ("before", "after") for p in ("signature", "images")]
    records = messages_from_conversations(t.conversations).select(
        "session_id", F.col("msg_idx").cast("long").alias("msg_idx"), half.alias("before_tokens"), F.when(length > 300, 20).otherwise(half).alias("after_tokens"), *none,
        F.when(F.col("role") == "assistant", 400 * (1 + F.floor(F.col("msg_idx") / 3))).alias("used"), ((F.col("msg_idx") == 2) & (number % 3 == 0)).alias("boundary"),
        ((F.col("msg_idx") == 4) & (number % 7 == 0)).alias("sidechain"), F.when(number % 4 == 0, "claude-opus-4-6").when(number % 4 == 1, "gpt-4o").when(number % 4 == 2, "<synthetic>").alias("model"),
    )
    return revive(records).select("session_id", "msg_idx", "used", "orig_used")
