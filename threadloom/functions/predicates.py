"""Session predicates with the three-valued logic of the reference model.

An absent string or date is definitely not a match (so a negation keeps the row); an
uncounted number or an unresolved fact is unknown (so both the test and its negation drop
the row). Compose the columns with ``&``, ``|`` and ``~``; Spark's own logic is the same.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message kinds.
EXCHANGE = ["prompt", "reply", "tool_result", "subagent_spawn", "subagent_return", "error"]
VISIBLE = ["prompt", "reply", "tool_result", "injected_context", "system_prompt", "compaction_summary"]


def definite(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def contains(column: Column, needle: str) -> Column:
    return definite(F.contains(F.lower(column), F.lit(needle.lower())))


def equals(column: Column, value: str) -> Column:
    return definite(F.lower(column) == value.lower())


def any_of(column: Column, values: Iterable[str], test=contains) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(column, v)
    return out


def number(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive range; null stays unknown."""
    if low is not None and high is not None and low > high:
        raise ValueError("reversed range")
    out = column.isNotNull() | F.lit(None).cast("boolean")
    if low is not None:
        out = out & (column >= low)
    if high is not None:
        out = out & (column <= high)
    return out


def on_day(column: Column, first: str, last: str | None = None) -> Column:
    """Whole days from ``first`` through ``last``."""
    after = F.date_add(F.to_date(F.lit(last or first)), 1)
    return definite((column >= F.to_timestamp(F.lit(first))) & (column < after.cast("timestamp")))


def since(column: Column, instant: str) -> Column:
    return definite(column >= F.to_timestamp(F.lit(instant)))


def before(column: Column, instant: str) -> Column:
    return definite(column < F.to_timestamp(F.lit(instant)))


def bare(needle: str, *columns: Column) -> Column:
    """A word without a field: in any of the columns."""
    out = F.lit(False)
    for c in columns:
        out = out | contains(c, needle)
    return out


def is_exchange(kind: Column) -> Column:
    return kind.isin(EXCHANGE)


def is_model_visible(kind: Column, role: Column) -> Column:
    return kind.isin(VISIBLE) | (kind.isin("subagent_spawn", "subagent_return") & (role != "system"))


def is_turn(kind: Column, role: Column) -> Column:
    return ((role == "user") & (kind == "prompt")) | ((role == "assistant") & (kind == "reply")) | (role.isin("user", "assistant") & (kind == "subagent_spawn"))


def admitted(cwd: Column, harness: Column, allow: list[str] = (), deny: list[str] = (), harnesses: list[str] = ()) -> Column:
    """Session admission: deny wins, an allow list needs a working directory; ``/**`` is any depth, ``/*`` one."""

    def under(rule: str) -> Column:
        if rule.endswith("/**"):
            return F.startswith(cwd, F.lit(rule[:-2])) | (cwd == rule[:-3])
        if rule.endswith("/*"):
            return F.startswith(cwd, F.lit(rule[:-1])) & ~F.contains(F.substr(cwd, F.lit(len(rule))), F.lit("/"))
        return (cwd == rule) | F.startswith(cwd, F.lit(rule.rstrip("/") + "/"))

    out = F.lit(True)
    if allow:
        out = out & definite(any_column(under(r) for r in allow))
    if deny:
        out = out & ~definite(any_column(under(r) for r in deny))
    if harnesses:
        out = out & definite(harness.isin(list(harnesses)))
    return out


def any_column(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def model(models: Column, needle: str) -> Column:
    """Whether any of a session's models holds the needle."""
    return definite(F.exists(models, lambda m: F.contains(F.lower(m), F.lit(needle.lower()))))


def git(branch: Column, remote: Column, needle: str) -> Column:
    return contains(F.concat_ws(" ", branch, remote), needle)


def git_equals(branch: Column, remote: Column, value: str) -> Column:
    return equals(branch, value) | equals(remote, value)


def ranged(column: Column, literal: str) -> Column:
    """``lo..hi``, either side open, or one number."""
    low, dots, high = literal.partition("..")
    at = lambda x: float(x) if x.strip() else None
    if not (low.strip() or high.strip()):
        raise ValueError(f"no range: {literal!r}")
    return number(column, at(low), at(high if dots else low))


def dated(column: Column, literal: str, operator: str = ":") -> Column:
    """A date test: ``:`` with a day or ``day..day`` takes whole days; other operators compare with midnight, and a full timestamp is exact."""
    if operator not in (":", "=", "<", "<=", ">", ">="):
        raise ValueError(f"no such operator: {operator!r}")
    first, dots, last = literal.partition("..")
    if dots:
        if operator not in (":", "=") or last < first:
            raise ValueError(f"no such range: {operator}{literal}")
        return on_day(column, first, last)
    if operator == ":" and len(literal) == 10:
        return on_day(column, literal)
    instant = F.to_timestamp(F.lit(literal))
    tests = {":": column == instant, "=": column == instant, "<": column < instant, "<=": column <= instant, ">": column > instant, ">=": column >= instant}
    return definite(tests[operator])


def since_instant(literal: str, now: datetime) -> datetime:
    """The instant of ``30m``, ``2h``, ``3d`` or ``1w`` before ``now``, of a date, a timestamp, or a time-ordered UUID."""
    unit = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
    if literal[-1:] in unit and literal[:-1].isdigit():
        return now - timedelta(**{unit[literal[-1]]: int(literal[:-1])})
    bare_id = literal.replace("-", "")
    if len(bare_id) == 32 and bare_id[12] == "7":
        return datetime.fromtimestamp(int(bare_id[:12], 16) / 1000, now.tzinfo)
    try:
        found = datetime.fromisoformat(literal.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"no duration, date or id: {literal!r}") from None
    return found if found.tzinfo else found.replace(tzinfo=now.tzinfo)


def lane(status: Column, last: Column, wanted: str, now: Column, quiet_seconds: int = 3600) -> Column:
    """Lane filters: running, done, stranded (not done and quiet for long), unfinished."""
    done = definite(status == "done")
    quiet = definite(now.cast("double") - last.cast("double") > quiet_seconds)
    tests = {"done": done, "unfinished": ~done, "stranded": ~done & quiet, "running": ~done & ~quiet}
    if wanted not in tests:
        raise ValueError(f"no lane filter: {wanted!r}")
    return tests[wanted]
