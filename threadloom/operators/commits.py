"""Commit graphs of many parents: what a branch reaches, and tasks whose branches are merged."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graphs import depths
from threadloom.operators.tasks import TERMINAL
from threadloom.session import written

# Endings that make a name a file rather than a branch.
FILE_ENDINGS = (
    "md markdown txt rst org adoc rs js mjs cjs ts tsx jsx py go c h cpp hpp java kt rb sh zsh bash json jsonl toml yaml yml html css sql lock xml pdf png jpg svg"
).split()
NAMES = r"[A-Za-z0-9][A-Za-z0-9._/-]*"
MENTION = rf"`({NAMES})`|\brefs/heads/({NAMES})|(?i:\bbranch)\s*[:=]\s*`?({NAMES})`?|\b(task/{NAMES})"


def tracks(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, track, pos) of all commits, and the links between tracks (track, pos, to_track, to_pos).

    Of the commits with the same first parent one continues its track, so that tracks are paths and
    a track reached at a place is reached below it.
    """
    firsts = links.where("k = 0").groupBy("id").agg(F.min("up").alias("up"))
    kept = written(firsts.groupBy("up").agg(F.max("id").alias("id")).select("id", "up"), "kept")
    nodes = rows.select(F.struct("repo", "id").alias("id")).distinct().join(kept, "id", "left").select("id", F.col("up").alias("parent_id"))
    placed = depths(written(nodes, "nodes"))
    loop = F.col("root").isNull()  # commits of a cycle are tracks of one
    placed = written(placed.select("id", F.coalesce("root", "id").alias("track"), F.coalesce("depth", F.lit(0)).cast("long").alias("pos"), loop.alias("loop")), "tracks")
    inner = kept.join(placed.where("NOT loop").select("id"), "id", "left_semi")
    cross = links.select("id", "up").distinct().join(inner, ["id", "up"], "left_anti").join(placed.drop("loop"), "id")
    ends = placed.select(F.col("id").alias("up"), F.col("track").alias("to_track"), F.col("pos").alias("to_pos"))
    return placed.drop("loop"), written(cross.join(ends, "up").select("track", "pos", "to_track", "to_pos"), "cross")


#: commits that one task looks through at a time
BLOCK = 1024
_NODE = "repo string, id string, seq long, parents array<string>, block long"
_NODES = pa.schema([("repo", pa.string()), ("id", pa.string()), ("seq", pa.int64()), ("parents", pa.list_(pa.string())), ("block", pa.int64())])
_PLACE = pa.schema([("repo", pa.string()), ("id", pa.string())])


def reachable(commits: DataFrame, starts: DataFrame, size: int = BLOCK) -> DataFrame:
    """(repo, id): all commits that each repository's ``starts`` (repo, id) reach, themselves included.

    ``commits`` has repo, id and parents, the first parent first, and perhaps seq, a whole number that mostly grows from parent to
    child (a time, a place in the log); parents that aren't in the table, null and repeated ones lead nowhere, and a cycle ends. With seq
    ``by_blocks`` takes ``size`` neighbours at a time, else ``by_tracks`` goes along first parents. Any seq gives the same rows.
    """
    rows = commits.where("repo IS NOT NULL AND id IS NOT NULL").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    if "seq" not in commits.columns:
        return by_tracks(rows.select("repo", "id", "parents"), starts)
    once = rows.groupBy("repo", "id").agg(F.max(F.col("seq").cast("long")).alias("seq"), F.array_distinct(F.array_compact(F.flatten(F.collect_list("parents")))).alias("parents"))
    return by_blocks(once, starts.select("repo", "id").distinct(), size)


def in_blocks(rows: DataFrame, size: int, tasks: int | None = None) -> DataFrame:
    """(block, repo, id, parents): ``rows`` in the order of their repositories and seq, ``size`` of them as arrays in one row."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        values = [pa.concat_arrays([b.column(k) for b in held]) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], ["repo", "id", "parents"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    order = ["repo", "seq", "id"]
    dealt = rows.repartitionByRange(*[tasks] * bool(tasks), *order).sortWithinPartitions(*order).select("repo", "id", "parents")
    return dealt.mapInArrow(cut, "repo array<string>, id array<string>, parents array<array<string>>").withColumn("block", F.monotonically_increasing_id())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
    """Each block's row, and its links (repo, id) -> [(repo, parent)]."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, {(r, i): [(r, p) for p in parents] for r, i, parents in zip(row["repo"], row["id"], row["parents"])}


def _seen(links: dict, starts: list[tuple]) -> set[tuple]:
    """What ``starts`` reach by ``links``, with the places outside at which they leave."""
    seen, todo = set(), list(starts)
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += links.get(at, ())
    return seen


def _leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, links in _blocks(batches):
        yield pa.RecordBatch.from_pylist([{"repo": r, "id": i} for r, i in {p for ps in links.values() for p in ps} - links.keys()], _PLACE)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, links in _blocks(batches):
        kept, most = {}, sum(map(len, links.values()))
        for at in [(e["repo"], e["id"]) for e in row["entered"]]:
            kept[at] = [p for p in _seen(links, [at]) if p not in links]
            most -= len(kept[at])
            if most < 0:  # shorter as it is
                kept = links
                break
        yield pa.RecordBatch.from_pylist([{"repo": r, "id": i, "seq": row["block"], "parents": [p for _, p in kept[r, i]], "block": row["block"]} for r, i in kept], _NODES)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, links in _blocks(batches):
        yield pa.RecordBatch.from_pylist([{"repo": r, "id": i} for r, i in _seen(links, [(e["repo"], e["id"]) for e in row["entered"]]) & links.keys()], _PLACE)


def by_blocks(rows: DataFrame, starts: DataFrame, size: int, tasks: int | None = None) -> DataFrame:
    """``reachable`` for ``rows`` (repo, id, seq, parents) of different commits, with work that grows as their number.

    Of a block only commits count that a start or a link from outside enters, with what they reach outside: these make a smaller history,
    in which the same is done, until one block is left. Then each block is looked through once from the commits at which it is
    entered. A block whose contraction has more links than itself stays as it is; a history that blocks don't make
    four times smaller, as neighbours by seq are seldom linked in it, goes by tracks.
    """
    cut = written(in_blocks(rows, size, tasks), "blocks")
    total, n = cut.agg(F.coalesce(F.sum(F.size("id")), F.lit(0)), F.count("*")).first()
    nodes = cut.select("block", F.explode(F.arrays_zip("repo", "id")).alias("at")).select("block", "at.repo", "at.id")
    doors = starts if n <= 1 else written(cut.mapInArrow(_leave, "repo string, id string").unionByName(starts).distinct(), "doors")
    entries = written(nodes.join(doors, ["repo", "id"]), "entries")

    def entered(at: DataFrame) -> DataFrame:
        return cut.join(at.groupBy("block").agg(F.collect_list(F.struct("repo", "id")).alias("entered")), "block")

    if n > 1:
        smaller = written(entered(entries).mapInArrow(_contract, _NODE), "smaller")
        left = smaller.count()
        if left * 4 > total:
            return by_tracks(cut.select(F.explode(F.arrays_zip("repo", "id", "parents")).alias("at")).select("at.*"), starts)
        entries = smaller.join(by_blocks(smaller.drop("block"), starts, size, left // (8 * size) + 1), ["repo", "id"], "left_semi").select("block", "repo", "id")
    return entered(entries).mapInArrow(_spread, "repo string, id string")


def by_tracks(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``reachable`` for ``rows`` (repo, id, parents), whatever their order.

    Histories are cut into tracks along first parents, in
    as many joins as the logarithm of the longest. A round then carries one number a track, how far up it is reached, over the
    links between tracks that came within reach; each link is followed once. Rounds count how deeply
    merges are nested, not how long a history is.
    """
    rows = written(rows, "commits")
    links = rows.select("repo", "id", F.posexplode("parents").alias("k", "parent")).where("parent IS NOT NULL").distinct()
    known = rows.select("repo", F.col("id").alias("parent")).distinct()
    links = links.join(known, ["repo", "parent"], "left_semi").select(F.struct("repo", "id").alias("id"), F.struct("repo", F.col("parent").alias("id")).alias("up"), "k")
    placed, cross = tracks(rows, written(links, "links"))
    begun = starts.select(F.struct("repo", "id").alias("id")).distinct().join(placed, "id")
    state = written(begun.groupBy("track").agg(F.lit(-1).cast("long").alias("low"), F.max("pos").alias("top")), "state")
    while not state.where("top > low").isEmpty():
        more = cross.join(state.where("top > low"), "track").where("pos > low AND pos <= top").groupBy(F.col("to_track").alias("track")).agg(F.max("to_pos").alias("more"))
        old = state.select("track", F.col("top").alias("low"))
        state = written(old.join(more, "track", "full").select("track", F.coalesce("low", F.lit(-1)).alias("low"), F.greatest("low", "more").alias("top")), "state")
    return placed.join(state, "track").where("pos <= top").select("id.repo", "id.id")


def merged_branches(commits: DataFrame, branches: DataFrame, main: str | None = None) -> DataFrame:
    """(repo, name) of ``branches`` (repo, name, id, remote) whose commit the main branch reaches.

    ``commits`` is that of ``reachable``. The main branch is ``main``, else main, else master; a repository without it gives none. A remote branch
    counts under its name and under the part after the remote's; ``.../HEAD`` and the main branch itself don't count.
    """
    local = branches.where("NOT remote AND name IS NOT NULL")
    if main:
        heads = local.where(F.col("name") == main).select("repo", "id", "name")
    else:
        found = local.where("name IN ('main', 'master')").groupBy("repo").agg(F.min_by(F.struct("id", "name"), "name").alias("m"))
        heads = found.select("repo", "m.id", "m.name")
    got = branches.where("name IS NOT NULL").join(reachable(commits, heads), ["repo", "id"], "left_semi")
    short = F.when(F.col("remote"), F.regexp_replace("name", "^[^/]*/", ""))
    named = got.join(heads.select("repo", F.col("name").alias("_main")), "repo").withColumn("short", F.coalesce(short, F.col("name")))
    named = named.where("NOT endswith(name, '/HEAD') AND name <> _main AND short <> _main")
    return named.select("repo", F.explode(F.array_distinct(F.array("name", "short"))).alias("name")).distinct()


def is_branch(name: Column) -> Column:
    """Whether a text can be a branch's name and isn't a file's."""
    file = rf"(?i)[^/]\.({'|'.join(FILE_ENDINGS)})$"
    return (F.char_length(name) >= 2) & name.rlike(r"^[A-Za-z0-9_][A-Za-z0-9._/-]*(?<![./])$") & ~name.rlike(r"\.\.|//") & ~name.rlike(file)


def named_branches(text: Column) -> Column:
    """Branches that a text names by structure: refs/heads/x, branch: x, task/x, or `x` with a mark or digit in it."""
    text = F.coalesce(text, F.lit(""))
    quoted = F.transform(F.regexp_extract_all(text, F.lit(MENTION), 1), lambda s: F.regexp_replace(s, r"[./]+$", ""))
    quoted = F.filter(quoted, lambda s: is_branch(s) & s.rlike("[-/_0-9]"))
    other = [F.transform(F.regexp_extract_all(text, F.lit(MENTION), k), lambda s: F.regexp_replace(s, r"[.,;:)]+$", "")) for k in (2, 3, 4)]
    return F.array_distinct(F.concat(quoted, *[F.filter(o, is_branch) for o in other]))


def candidates(tasks: DataFrame) -> Column:
    """All branches that a task may be about: its own, its tags' and those its texts name."""
    own = F.when(F.trim("task_id") != "", F.array(*[F.concat(F.lit("task/"), s) for s in (F.col("task_id"), F.substring("task_id", 1, 8), F.substring("task_id", 1, 13))]))
    nothing = F.array().cast("array<string>")
    tags = F.coalesce("tags", nothing) if "tags" in tasks.columns else nothing
    tagged = F.filter(F.transform(F.filter(tags, lambda t: t.startswith("branch:")), lambda t: F.trim(F.substr(t, F.lit(8)))), is_branch)
    texts = [named_branches(F.col(c)) for c in ("title", "body") if c in tasks.columns]
    return F.array_distinct(F.concat(F.coalesce(own, nothing), tagged, *texts))


def sweep(tasks: DataFrame, merged: DataFrame) -> DataFrame:
    """(task_id, state, branches): live tasks with the merged branches that they name, in order. Nothing is closed: these are candidates.

    ``tasks`` has task_id and state, perhaps tags, title, body and repo; a task without a repository
    may be about any. ``merged`` is ``merged_branches``.
    """
    live = tasks.where(~F.coalesce(F.col("state").isin(*sorted(TERMINAL)), F.lit(False)))
    repo = F.col("repo") if "repo" in tasks.columns else F.lit(None).cast("string")
    named = live.select("task_id", "state", repo.alias("_repo"), F.explode(candidates(tasks)).alias("name"))
    met = named.join(merged, "name").where(F.col("_repo").isNull() | (F.col("_repo") == F.col("repo")))
    return met.groupBy("task_id", "state").agg(F.sort_array(F.collect_set("name")).alias("branches"))
