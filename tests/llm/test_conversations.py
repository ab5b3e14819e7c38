"""Conversation repair against an exhaustive search, chat formatting against exact round trips."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from threadloom.llm import conversation_repair as repair_of
from threadloom.llm.chat_format import PARTS, Extents, Flatten, Template, format_turns, read_back, read_turn, text_parts
from threadloom.llm.conversation_repair import cheapest, repaired_digests, row_marks

RIGHT = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string, piece string"


def plain_damage(rows):
    """(conv, turn, role, text) after damage, in order."""
    out = []
    shown = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain_codes(rows):
    seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        initial = role[:1] if role[:1] in ("u", "a", "s") and role else "x"
        if not bare:
            fault, code = "blank", "D"
        elif (role, text) in seen:
            fault, code = "duplicate", "D"
        elif bare[-1] not in ".!?":
            fault, code = "truncated", initial.upper()
        else:
            fault, code = None, initial
        if fault:
            faults[fault] += 1
        seen.add((role, text))
        codes += code
    return codes, faults


def plain_repair(codes):
    """Cheapest cost and least audit by a table over (rows done, initials' state), all inserts included."""
    best = {(0, ""): (0, "")}  # the state is the last initial; '' before any
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def relax(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value
            return True
        return False

    for i in range(len(codes) + 1):
        for _ in range(4):
            for last in ("", "s", "u", "a"):
                if (i, last) in best:
                    cost, audit = best[i, last]
                    for to in follows[last]:
                        if to != "s":
                            relax(best, (i, to), (cost + 3, audit + "I"))
        if i == len(codes):
            break
        for last in ("", "s", "u", "a"):
            if (i, last) not in best:
                continue
            cost, audit = best[i, last]
            relax(best, (i + 1, last), (cost + 4, audit + "D"))
            if codes[i] != "D":
                charge = 3 * codes[i].isupper()
                if codes[i].lower() in follows[last]:
                    relax(best, (i + 1, codes[i].lower()), (cost + charge, audit + "K"))
                for to in set(follows[last]) & set("ua"):
                    relax(best, (i + 1, to), (cost + charge + 3, audit + "R"))
    return min(best[len(codes), last] for last in ("", "a") if (len(codes), last) in best)


def replayed(codes, audit):
    """Roles' initials that an audit gives."""
    out, i = "", 0
    for letter in audit:
        want = "a" if out.endswith("u") else "u"
        if letter == "K":
            out += codes[i].lower()
        elif letter in "RI":
            out += want
        i += letter != "I"
    assert i == len(codes)
    return out


def test_search_is_exhaustive_on_all_short_rows():
    for n in range(5):
        for codes in map("".join, itertools.product("DuasxUAS", repeat=n)):
            cost, audit, state = cheapest(codes, 0, None)
            assert (cost, audit) == plain_repair(codes), codes
            assert RIGHT.fullmatch(replayed(codes, audit)) and not repair_of.ENDS[state]


def test_search_on_long_rows_and_marks():
    rng = random.Random(5)
    for _ in range(40):
        codes = "".join(rng.choice("uauauaDsxUAS") for _ in range(rng.randrange(1, 200)))
        cost, audit, _ = cheapest(codes, 0, None)
        assert (cost, audit) == plain_repair(codes)
        marks = row_marks(codes, audit, 0)
        assert len(marks) == len(codes) and "".join(marks).translate(str.maketrans("uaUA", "IIRR")) == audit


def test_segments_crossings_are_exact():
    rng = random.Random(6)
    codes = ["".join(rng.choice("DuasxUAS") for _ in range(n)) for n in (0, 1, 2, 5, 9)]
    for line, costs in zip(codes, repair_of.crossing_costs(codes)):
        for entry in range(4):
            for out in range(4):
                only = [10**6 * (s != out) for s in range(4)]
                assert costs[entry, out] >= 10**6 or cheapest(line, entry, only)[0] == costs[entry, out]


def conversations():
    rng = random.Random(7)
    texts = ["Yes.", "No!", "What?", "cut off", "", "  \n", "héllo. \t", "a\nb.", "</s>", "Long " * 2000 + "."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(0, 9)):
            role = "system" if not turn and rng.random() < 0.4 else rng.choice(["user", "assistant"][turn % 2 :: 1] + ["tool"] * (rng.random() < 0.1))
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), None if rng.random() < 0.05 else role, rng.choice([*texts, None, f"Turn {turn}.", f"Turn {turn}."])))
    rows += [(900, t, ("user", "assistant")[t % 2], f"Hot {t // 3}.") for t in range(700)]  # many segments
    rows += [(901, 1, "user", "Same.")] * 300
    rows += [(902, 3, "", "Empty role."), (902, 4, "User", "Capital.")]
    return rows


def with_extras(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(params=[10, 4], ids=["blocks of 1024", "blocks of 16"])
def block_bits(request, monkeypatch):
    monkeypatch.setattr(repair_of, "BLOCK_BITS", request.param)


def test_repaired_digests(spark, block_bits):
    rows = conversations()
    got = {r["conv_id"]: r.asDict() for r in repaired_digests(with_extras(spark, rows)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = plain_damage([r for r in rows if r[0] == conv])
        codes, faults = plain_codes(mine)
        cost, audit = plain_repair(codes)
        out, i, last = [], 0, ""
        for letter in audit:
            want = "assistant" if last == "u" else "user"
            if letter == "I":
                out.append((want, ""))
            elif letter == "K":
                out.append(mine[i][2:])
            elif letter == "R":
                out.append((want, mine[i][3]))
            i += letter != "I"
            last = out[-1][0][:1] if out else ""
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        want = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **faults,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        }
        assert got[conv] == want


def test_repaired_turns_are_right_and_empty_tables_give_none(spark):
    rows = with_extras(spark, conversations())
    done = repair_of.repair(repair_of.damaged(rows))
    lines = done.turns.orderBy("conv_id", "at", "place").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "place", F.substring("role", 1, 1).alias("c")))), lambda x: x["c"]), "").alias("line"))
    assert all(RIGHT.fullmatch(r["line"]) for r in lines.collect())
    assert repaired_digests(rows.limit(0)).count() == 0


AWKWARD = ["", "plain", "\\", "\\\\</s>\\", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "[[INST]INST]", "<<s>s>", "<|image|>", "\n\n", "é 数\\n", "<\\/s>", "<</SYS>></s", "a" * 200_000]


def test_escapes_leave_no_control_string_and_come_back():
    template = Template()
    visitor = Flatten(template, Extents())
    rng = random.Random(3)
    pieces = [*template.strings(), "\\", "<", ">", "|", "[", "\n", "x", "/"]
    texts = AWKWARD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for text in texts:
        made = visitor.turn(text, [{"kind": "text", "text": text}])["piece"]
        inner = made[len(template.open) : -len(template.close)]
        assert not any(s in inner for s in template.strings())
        assert read_turn(made, template) == (text, text)


def test_read_back(spark):
    rows = [(c, t, ("user", "assistant", None, "a\nb")[(c + t) % 4], x) for c in range(4) for t, x in enumerate([*AWKWARD, None])]
    rows += [(None, None, "assistant", "x"), (5, 0, "user", "only"), (6, 0, "assistant", "twice"), (6, 0, "assistant", "twice")]
    got = {r["conv_id"]: r.asDict() for r in read_back(format_turns(text_parts(with_extras(spark, rows)))).collect()}
    template = Template()
    visitor = Flatten(template, Extents())
    for conv in {r[0] for r in rows}:
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        learned = "".join(t for role, t in mine if role == "assistant")
        assert got[conv] == {
            "conv_id": conv, "n_turns": len(mine), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest(),
            "loss_chars": len(learned), "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(),
            "formatted_chars": sum(len(visitor.turn(r, [{"kind": "text", "text": t}])["piece"]) for r, t in mine),
        }
    assert len(got) == len({r[0] for r in rows})
    assert read_back(format_turns(text_parts(with_extras(spark, rows).limit(0)))).count() == 0


def test_parts_become_placeholders_in_order(spark):
    part = lambda kind, **more: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more
    parts = [part("text", text="See <|image|>: "), part("image", ref="a.png", width=1024, height=513), part("audio", ref="b.wav", seconds=2.1), part("document", pages=3), part("text", text="done"), part("image", width=-4)]
    rows = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", parts), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts {PARTS}")
    learned, asked, empty = format_turns(rows).orderBy("turn").collect()
    assert learned["piece"] == "<|im_start|>assistant\nSee <\\|image|>: <|image|><|audio|><|document|>done<|image|><|im_end|>\n"
    assert [learned["piece"][s["start"] : s["end"]] for s in learned["loss"]] == ["See <\\|image|>: ", "done"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in learned["attachments"]] == [("image", "a.png", 85 + 170 * 4), ("audio", "b.wav", 27), ("document", "", 768), ("image", "", 85)]
    assert all(learned["piece"].startswith(f"<|{a['kind']}|>", a["offset"]) for a in learned["attachments"])
    assert learned["attachment_tokens"] == sum(a["tokens"] for a in learned["attachments"])
    assert asked["loss"] == [] and asked["attachments"] != [] and empty["piece"] == "<|im_start|>user\n<|im_end|>\n"
