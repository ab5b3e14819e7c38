"""Catalog, predicate, projection and ordering queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import predicates as P
from threadloom.functions import text as X
from threadloom.functions import tokens as K
from threadloom.operators import aggregates as A
from threadloom.operators import sessions as S
from threadloom.plans.registry import query
from threadloom.sources.conversations import messages_from_conversations

MESSAGES = """
messages AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS msg_idx, role,
         CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'reply' WHEN 'tool' THEN 'tool_result' WHEN 'system' THEN 'notice' END AS kind,
         CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'model' WHEN 'tool' THEN 'harness' WHEN 'system' THEN 'harness' END AS origin, text
  FROM conversations
)"""
SESSIONS = MESSAGES + """, sessions AS (
  SELECT session_id, arg_min(text, msg_idx) FILTER (kind = 'prompt') AS head,
         count(*) FILTER ((role = 'user' AND kind = 'prompt') OR (role = 'assistant' AND kind = 'reply')) AS message_count,
         count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
  FROM messages GROUP BY session_id
), titled AS (
  SELECT session_id, CASE WHEN length(head) <= 80 THEN replace(head, chr(10), ' ') ELSE replace(head, chr(10), ' ')[1:79] || '…' END AS title,
         message_count, n_rows, n_chars FROM sessions
)"""


def catalog(t):
    return S.sessions(messages_from_conversations(t.conversations))


@query(f"WITH {SESSIONS} SELECT * FROM titled")
def s31_sessions(t):
    return catalog(t)


@query(f"WITH {MESSAGES} SELECT * FROM messages")
def s28_messages(t):
    return messages_from_conversations(t.conversations)


@query(f"WITH {MESSAGES} SELECT session_id, msg_idx, role FROM messages WHERE msg_idx >= 1 AND msg_idx < 3")
def s33_range(t):
    return S.window_of(messages_from_conversations(t.conversations), span=(1, 3)).select("session_id", "msg_idx", "role")


@query(f"WITH {MESSAGES} SELECT count(*) AS n_rows, count(DISTINCT session_id) AS n_sessions, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(msg_idx) AS last_idx FROM messages")
def s34_tee(t):
    m = messages_from_conversations(t.conversations)
    return A.tallied(m, {"n_sessions": "session_id"}, {"n_chars": F.char_length("text")}, {"last_idx": "msg_idx"})


@query(f"WITH {SESSIONS} SELECT * FROM titled WHERE session_id = '17'")
def s35_find_by_id(t):
    return S.find(catalog(t), "17")


@query("""SELECT o_custkey, o_orderstatus, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def s36_preferred_copy(t):
    return S.preferred(t.orders, ["o_custkey", "o_orderstatus"], [F.col("o_orderdate").desc(), "o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""WITH recent AS (
  SELECT event_type, props, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events
), tally AS (SELECT event_type, count(*) AS n FROM recent WHERE rn <= 100 GROUP BY event_type)
SELECT event_type, n, event_type NOT IN ('click', 'view') AS is_new FROM tally""")
def s37_census(t):
    """Kinds among the 100 most recent events of each, and those that the manifest doesn't list."""
    manifest = t.spark.createDataFrame([("click",), ("view",)], "event_type string")
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("ts").desc(), "event_id"))
    tally = t.events.withColumn("rn", rn).where("rn <= 100").groupBy("event_type").agg(F.count("*").alias("n"))
    known = manifest.withColumn("known", F.lit(True))
    return tally.join(F.broadcast(known), "event_type", "left").select("event_type", "n", F.col("known").isNull().alias("is_new"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def f01_harness(t):
    return t.events.where(P.any_of(F.col("event_type"), ["click", "error"], P.equals)).select("event_id", "event_type")


@query("SELECT p_partkey, p_name FROM part WHERE NOT coalesce(contains(lower(p_name), '1'), false)")
def f04_title_negated(t):
    return t.part.where(~P.contains(F.col("p_name"), "1")).select("p_partkey", "p_name")


@query(f"WITH {SESSIONS} SELECT session_id FROM titled WHERE contains(lower(session_id), '7')")
def f05_id(t):
    return catalog(t).where(P.contains(F.col("session_id"), "7")).select("session_id")


@query(f"WITH {SESSIONS} SELECT session_id, message_count FROM titled WHERE message_count BETWEEN 2 AND 4")
def f06_msgs(t):
    return catalog(t).where(P.number(F.col("message_count"), 2, 4)).select("session_id", "message_count")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01'")
def f07_created(t):
    return t.orders.where(P.on_day(F.col("o_orderdate"), "1995-03-01", "1995-03-31")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'")
def f08_updated(t):
    when = F.coalesce("o_orderdate", F.lit(None).cast("timestamp"))
    return t.orders.where(P.since(when, "1997-01-01") & P.before(when, "1997-02-01")).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'and')")
def f10_text(t):
    return t.documents.where(X.holds_words(F.col("text"), ["the", "and"])).select("doc_id")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def f11_tool(t):
    return S.using(t.events, F.col("event_type") == "purchase", "user_id")


@query("""SELECT user_id, bool_or(event_type = 'error') AS has_errors, bool_or(event_type <> 'error') AS has_tools,
  count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY user_id""")
def f13_has_flags(t):
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(F.bool_or(kind == "error").alias("has_errors"), F.bool_or(kind != "error").alias("has_tools"), F.count_if(kind == "error").alias("n_errors"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) >= 10""")
def f16_child_counts(t):
    n = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))
    return n.where(P.number(F.col("n_orders"), 10))


@query("SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '1') OR contains(lower(s_name), '2')")
def f18_or_list(t):
    return t.supplier.where(P.any_of(F.col("s_name"), ["1", "2"])).select("s_suppkey")


@query("""WITH n AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS k FROM events)
SELECT event_id FROM n WHERE (v >= 50 OR coalesce(k = 'click', false)) AND NOT (coalesce(k = 'view', false)) AND NOT (v < 10)""")
def f21_kleene(t):
    n = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("k"))
    wanted = (P.number(F.col("v"), 50) | P.equals(F.col("k"), "click")) & ~P.equals(F.col("k"), "view") & ~(F.col("v") < 10)
    return n.where(wanted).select("event_id")


@query(f"WITH {SESSIONS} SELECT session_id, message_count FROM titled WHERE message_count >= 2 ORDER BY message_count DESC, session_id LIMIT 5")
def f23_limited_filter(t):
    return S.listing(catalog(t).where(P.number(F.col("message_count"), 2)), "message_count", 5).select("session_id", "message_count")


@query("""SELECT doc_id, source FROM documents WHERE (source = 'src1' OR starts_with(source, 'src1/') OR starts_with(source, 'src2')) AND NOT source = 'src20'""")
def f25_admission(t):
    path = F.col("source")
    ok = (P.admitted(path, F.col("lang"), allow=["src1"]) | P.definite(F.startswith(path, F.lit("src2")))) & P.admitted(path, F.col("lang"), deny=["src20"])
    return t.documents.where(ok).select("doc_id", "source")


@query(f"""WITH {MESSAGES} SELECT session_id, msg_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_idx DESC) AS back FROM messages) WHERE back <= 2""")
def f26_last(t):
    return S.window_of(messages_from_conversations(t.conversations), last=2).select("session_id", "msg_idx")


@query(f"WITH {MESSAGES} SELECT session_id, msg_idx, kind IN ('prompt', 'reply', 'tool_result', 'error') AS exchange, kind IN ('prompt', 'reply', 'tool_result') AS visible FROM messages")
def f27_kinds(t):
    m = messages_from_conversations(t.conversations)
    return m.select("session_id", "msg_idx", P.is_exchange(F.col("kind")).alias("exchange"), P.is_model_visible(F.col("kind"), F.col("role")).alias("visible"))


@query(f"""WITH {MESSAGES} SELECT session_id, string_agg(text, chr(10) ORDER BY msg_idx) AS body FROM messages GROUP BY session_id""")
def p01_text(t):
    m = messages_from_conversations(t.conversations)
    ordered = F.sort_array(F.collect_list(F.struct("msg_idx", "text")))
    return m.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("body"))


@query("SELECT doc_id, CASE WHEN length(text) <= 60 THEN replace(text, chr(10), ' ') ELSE replace(text, chr(10), ' ')[1:59] || '…' END AS head FROM documents")
def p03_truncate(t):
    return t.documents.select("doc_id", X.truncate(F.col("text"), 60).alias("head"))


@query("""WITH d AS (SELECT doc_id, CAST(n_chars AS BIGINT) * n_chars AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0::DOUBLE * 10 + 0.5) / 10)
  WHEN n < 1073741824 THEN printf('%.1f MB', floor(n / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(n / 1073741824.0::DOUBLE * 10 + 0.5) / 10) END AS size FROM d""")
def p04_human_bytes(t):
    n = F.col("n_chars").cast("long") * F.col("n_chars")
    return t.documents.select("doc_id", X.human_bytes(n).alias("size"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS last_part, CASE WHEN starts_with(url, 'https://') THEN '~' || url[7:] ELSE url END AS home FROM pages""")
def p05_paths(t):
    return t.pages.select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("last_part"), X.home_relative(F.col("url"), "https:/").alias("home"))


@query("SELECT doc_id, 2 * length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS bytes FROM documents")
def p07_effective_bytes(t):
    return t.documents.select("doc_id", K.effective_bytes(F.col("text")).cast("long").alias("bytes"))


@query("SELECT doc_id, CAST(12 + ceil((2 * length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / 2.5::DOUBLE) AS BIGINT) AS tokens FROM documents")
def p08_token_estimate(t):
    return t.documents.select("doc_id", K.block_tokens(F.col("text")).cast("long").alias("tokens"))


MODELS = ["claude-opus-4-5", "anthropic/claude-sonnet-4-20250514", "claude-4-7-opus", "gpt-4o-mini", "gpt-5", "o3-mini", "gemini-2.5-pro", "qwen3-coder", "grok-4", "deepseek-r1", "unknown", "claude-3-5-haiku", "kimi-k2"]
SCALE_OF = [1.35, 1.35, 1.0, 1.25, 1.25, 1.25, 1.30, 1.20, 1.20, 1.18, 1.0, 1.35, 1.18]
PRICE_OF = [(5, .5, 6.25, 25), (3, .3, 3.75, 15), None, (.4, .1, .4, 1.6), (1.25, .125, 1.25, 10), (1.1, .275, 1.1, 4.4), (1.25, .3125, 1.25, 10), (1.2, .3, 1.2, 6), (3, .75, 3, 15), (.55, .14, .55, 2.19), None, (.8, .08, 1, 4), None]


def model_case(values) -> str:
    whens = " ".join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values))
    return f"(CASE l_partkey % {len(values)} {whens} END)"


def model_of(key):
    return F.element_at(F.array(*[F.lit(m) for m in MODELS]), (key % len(MODELS) + 1).cast("int"))


@query(f"""SELECT l_orderkey, l_linenumber, CAST({model_case(SCALE_OF)} AS DOUBLE) AS scale FROM lineitem""")
def p09_tokenizer_scale(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", K.tokenizer_scale(model_of(F.col("l_partkey"))).alias("scale"))


@query(f"""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber = 1 THEN l_tax END,
  (l_quantity * 100 * {model_case([p and p[0] for p in PRICE_OF])}::DOUBLE + l_linenumber * 10 * {model_case([p and p[1] for p in PRICE_OF])}::DOUBLE + l_quantity * 10 * {model_case([p and p[3] for p in PRICE_OF])}::DOUBLE) / 1000000.0) AS cost FROM lineitem""")
def p11_cost(t):
    tokens = {"input": F.col("l_quantity") * 100, "cache_read": F.col("l_linenumber") * 10, "cache_write": F.lit(0), "output": F.col("l_quantity") * 10}
    reported = F.when(F.col("l_linenumber") == 1, F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", K.estimated_cost(model_of(F.col("l_partkey")), reported, tokens).alias("cost"))


GIT = r"(^|[\s;&|])git(?:\s+-[Cc]\s+[^\s;&|]+|\s+-[^\s;&|]+)*\s+{}($|[\s;&|])"


@query(f"""SELECT doc_id, regexp_matches(cmd, '{GIT.format("commit")}') AS commits, regexp_matches(cmd, '{GIT.format("push")}') AS pushes FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'cd x; git -C /x commit -m ' WHEN 1 THEN 'git commit -a && git --no-pager push ' WHEN 2 THEN 'digit pushed ' ELSE '' END || text AS cmd FROM documents)""")
def p17_git_verbs(t):
    i = F.col("doc_id") % 4
    head = F.when(i == 0, "cd x; git -C /x commit -m ").when(i == 1, "git commit -a && git --no-pager push ").when(i == 2, "digit pushed ").otherwise("")
    cmd = F.concat(head, F.col("text"))
    return t.documents.select("doc_id", X.git_verb(cmd, "commit").alias("commits"), X.git_verb(cmd, "push").alias("pushes"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def p20_digest(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS n_printable FROM documents")
def p21_printable(t):
    return t.documents.select("doc_id", F.char_length(X.printable(F.col("text"))).cast("long").alias("n_printable"))


@query("""WITH f AS (SELECT doc_id, text, strpos(lower(text), 'idiot') AS rn FROM documents)
SELECT doc_id, CASE WHEN rn > 0 THEN substring(text, greatest(rn - 40, 1), rn - greatest(rn - 40, 1) + 125) ELSE text[1:160] END AS snippet FROM f""")
def p22_snippet(t):
    return t.documents.select("doc_id", X.snippet(F.col("text"), "idiot").alias("snippet"))


@query("SELECT doc_id, translate(lower(text), 'ς', 'σ') AS folded FROM documents")
def p23_folded(t):
    return t.documents.select("doc_id", X.folded(F.col("text")).alias("folded"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def p24_json(t):
    return t.events.select("event_id", X.json_at(F.col("props"), "$.k", "long").alias("k"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h' ELSE CAST(s // 86400 AS VARCHAR) || 'd' END AS age FROM (
  SELECT event_id, CAST(floor(epoch((SELECT max(ts) FROM events)) - epoch(ts)) AS BIGINT) AS s FROM events)""")
def p26_age(t):
    last = t.events.agg(F.max("ts").alias("last"))
    s = F.floor(F.col("last").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")).cast("long")
    return t.events.join(F.broadcast(last)).select("event_id", X.age_short(s).alias("age"))


@query(f"WITH {SESSIONS} SELECT session_id, n_chars FROM (SELECT * FROM titled ORDER BY n_chars DESC, session_id LIMIT 10)")
def o01_listing(t):
    return S.listing(catalog(t), "n_chars", 10, newest_first=False).select("session_id", "n_chars")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts NULLS LAST, user_id, event_id LIMIT 50")
def o04_timeline(t):
    return S.timeline(t.events, "ts", ["user_id", "event_id"], 50).select("event_id", "ts", "user_id")


@query("SELECT o_orderkey, CAST(count(*) OVER () AS BIGINT) AS total FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o06_total(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    return S.top_of(urgent, [F.col("o_totalprice").desc(), "o_orderkey"], 20).select("o_orderkey", "total")


@query(f"WITH {SESSIONS} SELECT session_id AS id, 'conversation' AS harness, title, message_count FROM titled")
def k09_rows(t):
    return catalog(t).select(F.col("session_id").alias("id"), F.lit("conversation").alias("harness"), "title", "message_count")
