"""Tool calls as operations: what was run, edited, read, searched, spawned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tool names by operation, name fragments that tell writing from reading, input keys of a file target, patch headers.
COMMANDS = ["Bash", "bash", "shell", "local_shell", "exec_command", "run_shell_command", "execute_command", "run_command", "terminal", "run_terminal_cmd"]
SPAWNS = ["Task", "Agent", "spawn_agent", "new_task", "delegate_task", "invoke_subagent"]
SENDS = ["SendMessage", "send_message", "followup_task", "send_input", "team_send_message", "post_message"]
BACKGROUND = ["BashOutput", "KillShell", "KillBash", "TaskOutput", "TaskStop", "write_stdin"]
WRITE_HINTS = ["edit", "write", "patch", "notebook", "replace", "create", "save"]
SEARCH_HINTS = ["grep", "glob", "search"]
READ_HINTS = ["read", "grep", "glob", "search", "cat", "view", "list"]
FILE_KEYS = ["file_path", "absolute_path", "filePath", "notebook_path", "target_file", "path", "TargetFile", "Path", "AbsolutePath", "AbsolutePathUri", "File"]
COMMAND_KEYS = ["command", "cmd", "CommandLine"]
PATCH_HEADER = r"(?m)^\*\*\* (?:Update File|Add File|Delete File|Move to): *(.+?) *$"

# Affordances by tool name, (kind, action).
AFFORDANCES = {
    ("plan", "write"): ["TodoWrite", "todo_write", "todowrite", "write_todos", "todo__todo_write", "SetTodoList", "TodoList", "update_plan", "Checklist", "update_todo_list"],
    ("plan", "read"): ["TodoRead", "todo_read", "todoread", "TaskList", "TaskGet", "tracker_list_tasks", "tracker_get_task", "tracker_visualize"],
    ("plan", "create"): ["TaskCreate", "tracker_create_task"], ("plan", "update"): ["TaskUpdate", "tracker_update_task"],
    ("plan", "enter"): ["EnterPlanMode", "enter_plan_mode"], ("plan", "exit"): ["ExitPlanMode", "exit_plan_mode"],
    ("goal", "create"): ["CreateGoal", "create_goal"], ("goal", "update"): ["UpdateGoal", "update_goal", "SetGoalBudget"], ("goal", "read"): ["GetGoal", "get_goal"],
    ("schedule", "create"): ["CronCreate", "cron_create", "scheduler_create", "ScheduleWakeup", "loop_wakeup"],
    ("schedule", "delete"): ["CronDelete", "cron_delete", "scheduler_delete"], ("schedule", "list"): ["CronList", "cron_list", "scheduler_list"],
    ("background_job", "start"): ["Monitor", "monitor"], ("background_job", "stop"): ["KillShell", "KillBash", "TaskStop", "kill_command_or_subagent"],
    ("background_job", "read"): ["BashOutput", "TaskOutput", "get_command_or_subagent_output", "WaitFor", "CheckBackgroundJob", "command_status", "write_stdin"],
    ("subagent_spawn", "spawn"): ["Task", "Agent", "spawn_agent"], ("skill", "load"): ["Skill", "activate_skill", "load_skill", "Skills"], ("skill", "manage"): ["skill_manage"],
    ("question", "ask"): ["AskUserQuestion", "ask_user", "ask_user_question", "ask_followup_question", "ask_question", "AskQuestion", "request_user_input", "request_user_input_async"],
}

# Names that some agents use in a sense of their own.
OWN_AFFORDANCES = {
    "hermes": {("plan", "write"): ["todo"], ("plan", "read"): ["todo_list"], ("question", "ask"): ["clarify"]},
    "qwen": {("plan", "create"): ["task_create"], ("plan", "update"): ["task_update"], ("plan", "read"): ["task_list", "task_get"], ("skill", "load"): ["skill"]},
    "kimi": {("background_job", "read"): ["TaskList"], None: ["TaskGet"]},
    "opencode": {("skill", "load"): ["skill"], ("question", "ask"): ["question"]},
    "roo": {("skill", "load"): ["skill"]},
    "antigravity": {("approval", "ask"): ["ask_permission"], ("schedule", "create"): ["schedule"]},
}

# Tools that start a background job if an input flag says so, and message kinds that are affordances by themselves.
BACKGROUND_FLAGS = {"Bash": ["run_in_background"], "run_terminal_command": ["background", "is_background"], "run_shell_command": ["is_background"]}
KIND_AFFORDANCES = {
    "compaction_boundary": "compaction_boundary", "compaction_summary": "compaction_summary", "model_change": "model_change", "branch": "branch",
    "subagent_spawn": "subagent_spawn", "subagent_return": "subagent_return",
}


def first_of(input_: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(input_, f"$.{k}") for k in keys])


def hinted(name: Column, hints: list[str]) -> Column:
    return F.lower(name).rlike("|".join(hints))


def patch_targets(text: Column) -> Column:
    """Files that a patch names in its headers, or in the new side of a unified diff."""
    named = F.regexp_extract_all(text, F.lit(PATCH_HEADER), 1)
    diff = F.regexp_extract_all(text, F.lit(r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)"), 1)
    return F.array_distinct(F.filter(F.concat(named, diff), lambda p: p != "/dev/null"))


def operation(name: Column, input_: Column) -> Column:
    """struct(op, target) of a call by its name and JSON input; target is the command, file, pattern or recipient."""
    bare = F.element_at(F.split(name, ":"), -1)
    file, command = first_of(input_, FILE_KEYS), first_of(input_, COMMAND_KEYS)
    op = (
        F.when(bare.isin(SPAWNS), "subagent_spawn").when(bare.isin(SENDS), "agent_message").when(bare.isin(BACKGROUND), "background")
        .when(bare.isin(COMMANDS), "command").when(hinted(bare, SEARCH_HINTS), "search").when(file.isNotNull() & hinted(bare, WRITE_HINTS), "file_edit")
        .when(hinted(bare, ["patch"]), "file_edit").when(file.isNotNull() & hinted(bare, READ_HINTS), "file_read").otherwise("other")
    )
    target = (
        F.when(op == "command", command).when(op == "search", F.coalesce(first_of(input_, ["pattern", "query", "regex"]), file))
        .when(op == "agent_message", first_of(input_, ["to", "target", "recipient"])).when(op == "subagent_spawn", first_of(input_, ["description", "subagent_type", "name"]))
        .otherwise(file)
    )
    return F.struct(op.alias("op"), target.alias("target"))


def event_rows(calls: DataFrame) -> DataFrame:
    """Event rows of calls (session_id, msg_idx, ts, call_id, tool, input, failed): one an affected file, the first with ``call``; and one for a failure."""
    did = calls.withColumn("did", operation(F.col("tool"), F.col("input")))
    patched = patch_targets(F.coalesce(first_of(F.col("input"), ["patch", "input", "diff", "raw"]), F.lit("")))
    files = F.when((F.col("did.op") == "file_edit") & F.col("did.target").isNull(), patched).otherwise(F.array("did.target"))
    spread = did.select("session_id", "msg_idx", "ts", "call_id", "tool", "failed", F.col("did.op").alias("op"), F.posexplode_outer(files).alias("at", "target"))
    kind = F.when(F.col("op").isin("file_edit", "file_read", "command"), F.col("op")).otherwise("tool")
    columns = ["session_id", "msg_idx", "ts", "call_id", "tool"]
    rows = spread.select(*columns, kind.alias("kind"), "target", (F.coalesce("at", F.lit(0)) == 0).alias("call"))
    errors = calls.where("failed").select(*columns, F.lit("error").alias("kind"), F.lit(None).cast("string").alias("target"), F.lit(False).alias("call"))
    return rows.unionByName(errors)


def affordance(name: Column, input_: Column | None = None, harness: Column | None = None) -> Column:
    """struct(kind, action) of a tool call, or null; an agent's own sense of a name comes first, then flags of the input, then the common names."""
    bare = F.element_at(F.split(name, ":"), -1)
    nothing = F.lit(None).cast("struct<kind:string,action:string>")

    def struct(kind: str, action: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(action).alias("action"))

    out = F.when(F.startswith(bare, F.lit("tracker_")), struct("plan", "update")).otherwise(nothing)
    for (kind, action), names in AFFORDANCES.items():
        out = F.when(bare.isin(names), struct(kind, action)).otherwise(out)
    if input_ is not None:
        for tool, flags in BACKGROUND_FLAGS.items():
            set_ = F.coalesce(*[F.when(F.get_json_object(input_, f"$.{f}") == "true", True) for f in flags], F.lit(False))
            out = F.when((bare == tool) & set_, struct("background_job", "start")).otherwise(out)
    if harness is not None:
        for who, table in OWN_AFFORDANCES.items():
            for key, names in table.items():
                out = F.when((harness == who) & bare.isin(names), struct(*key) if key else nothing).otherwise(out)
    return out


def affordances(messages: DataFrame) -> DataFrame:
    """(session_id, msg_idx, kind, action) of ``messages`` (session_id, msg_idx, kind, content, and harness if known): by tool calls and by message kinds."""
    harness = F.col("harness") if "harness" in messages.columns else None
    calls = messages.withColumn("b", F.explode("content")).where("b.type = 'tool_use'").withColumn("a", affordance(F.col("b.name"), F.col("b.input"), harness))
    named = calls.where("a IS NOT NULL").select("session_id", "msg_idx", F.col("a.kind").alias("kind"), F.col("a.action").alias("action"))
    kinds = F.create_map(*[F.lit(x) for kv in KIND_AFFORDANCES.items() for x in kv])
    marked = messages.withColumn("_kind", F.try_element_at(kinds, F.col("kind"))).where("_kind IS NOT NULL").select("session_id", "msg_idx", F.col("_kind").alias("kind"), F.lit("record").alias("action"))
    images = messages.where(F.exists("content", lambda b: b["type"] == "image")).select("session_id", "msg_idx", F.lit("image").alias("kind"), F.lit("hold").alias("action"))
    return named.unionByName(marked).unionByName(images)


def affordance_counts(rows: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """(by, a column for each of ``kinds``): rows of each kind; the kinds are given, so no job looks for them."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def names_commit(output: Column, sha: Column) -> Column:
    """Whether an output holds a commit id as a whole token of seven digits or more, either one a prefix of the other."""
    tokens = F.regexp_extract_all(F.lower(output), F.lit(r"(?<![0-9a-z])([0-9a-f]{7,64})(?![0-9a-z])"), 1)
    return F.exists(tokens, lambda t: F.startswith(t, F.lower(sha)) | F.startswith(F.lower(sha), t))


def active_branch(messages: DataFrame) -> DataFrame:
    """(session_id, id) on the way from each session's newest message back through its parents."""
    from threadloom.operators.graphs import ways_up

    newest = messages.where("id IS NOT NULL").groupBy("session_id").agg(F.max_by("id", "msg_idx").alias("leaf"))
    key = lambda c: F.struct("session_id", F.col(c).alias("id"))
    links = messages.where("id IS NOT NULL AND parent_id IS NOT NULL").select(key("id").alias("id"), key("parent_id").alias("up"))
    walked = ways_up(links, newest.select(key("leaf").alias("id")))
    return walked.select(F.col("id.session_id").alias("session_id"), F.col("id.id").alias("id"))
