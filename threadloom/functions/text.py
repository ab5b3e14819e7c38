"""Text expressions shared by search and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-case ASCII letter-and-digit runs of ``text``, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def truncate(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters; a cut is marked."""
    flat = F.regexp_replace(text, "\n", " ")
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def human_bytes(n: Column) -> Column:
    def unit(power: int, name: str) -> Column:
        return F.format_string(f"%.1f {name}", n / float(1024**power))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def home_relative(path: Column, home: str) -> Column:
    inside = F.startswith(path, F.lit(home.rstrip("/") + "/"))
    return F.when(inside, F.concat(F.lit("~"), F.substr(path, F.lit(len(home.rstrip("/")) + 1)))).otherwise(path)


def last_part(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def snippet(text: Column, needle: str, lead: int = 40, trail: int = 120) -> Column:
    """The text around the first match, else its head."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - lead, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at - start + len(needle) + trail)).otherwise(F.substring(text, 1, lead + trail))


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), "ς", "σ")


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def git_verb(command: Column, verb: str) -> Column:
    """Whether a shell command line has a part that runs git with ``verb``: its first word behind git that is no option and no option's value."""

    def named(part: Column) -> Column:
        words = F.filter(F.split(part, r"\s+"), lambda w: w != "")
        at = F.array_position(words, "git")
        rest = F.when(at > 0, F.slice(words, at.cast("int") + 1, F.size(words))).otherwise(F.array().cast("array<string>"))
        start = F.struct(F.lit(False).alias("value"), F.lit("").alias("verb"))

        def step(state: Column, word: Column) -> Column:
            found = F.when((state["verb"] != "") | state["value"] | F.startswith(word, F.lit("-")), state["verb"]).otherwise(word)
            return F.struct((~state["value"] & (state["verb"] == "") & word.isin("-C", "-c")).alias("value"), found.alias("verb"))

        return F.aggregate(rest, start, step)["verb"] == verb

    return F.exists(F.split(command, r"[;&|\n]+"), named)


def clean_path(path: Column, cwd: Column | str = "/") -> Column:
    """``path`` made absolute on ``cwd``, with ``.``, ``..`` and repeated slashes resolved by their text alone."""
    base = F.lit(cwd) if isinstance(cwd, str) else cwd
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(base, F.lit("/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda out, p: F.when(p != "..", F.concat(out, F.array(p))).when(F.size(out) > 0, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def age_short(seconds: Column) -> Column:
    """An age in its largest whole unit: now, minutes, hours or days."""
    whole = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, "now").when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def deadline_phrase(deadline: Column, now: Column) -> Column:
    """How a deadline reads: its day, and how far off or overdue it is."""
    left = F.unix_seconds(deadline) - F.unix_seconds(now)
    day = F.date_format(deadline, "MM-dd")
    return F.when(left >= 0, F.concat(F.lit("by "), day, F.lit(" (in "), age_short(left), F.lit(")"))).otherwise(F.concat(F.lit("by "), day, F.lit(" (OVERDUE "), age_short(-left), F.lit(")")))


def json_at(text: Column, path: str, kind: str = "string") -> Column:
    """The value at a path of a JSON text, null where the text isn't JSON or the value isn't of that kind."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def holds_words(text: Column, words: list[str]) -> Column:
    """Whether a text holds all words of letters and digits, wherever they stand."""
    found = F.lit(True)
    for w in words:
        found = found & F.lower(text).rlike(f"(?<![a-z0-9]){w.lower()}(?![a-z0-9])")
    return found
