"""Conversation repair against a left-to-right search, and that against all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpusmill.llm import repair

FORM = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if act == 0:
            continue
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out += [(conv, turn, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    return out


def faults(rows):
    """(role, text, fault) of one conversation's rows in order."""
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append((role, text, "b" if not last else "d" if (role, text) in seen else "n" if last in ".!?" else "t"))
        seen.add((role, text))
    return out


def leftmost(marks):
    """(cost, audit, lines) by the states of the form from left to right."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def insert(states):
        for _ in range(2):
            for p, (c, e, o) in list(states.items()):
                for new, name in (("u", "user"), ("a", "assistant")):
                    if (p, new) in step:
                        q = step[p, new]
                        states[q] = min(states.get(q, (10**9,)), (c + 5, e + "I", [*o, name + ":"]))
        return states

    states = insert({"": (0, "", [])})
    for role, text, fault in marks:
        after = {}

        def put(q, *found, after=after):
            after[q] = min(after.get(q, (10**9,)), found)

        for p, (c, e, o) in states.items():
            put(p, c + 2, e + "D", o)
            if fault in "tn":
                extra = 5 if fault == "t" else 0
                if (p, role[:1]) in step:
                    put(step[p, role[:1]], c + extra, e + "K", [*o, f"{role}:{text}"])
                for new, name in (("u", "user"), ("a", "assistant")):
                    if (p, new) in step:
                        put(step[p, new], c + 1 + extra, e + "R", [*o, f"{name}:{text}"])
        states = insert(after)
    return min(states[q] for q in ("", "a") if q in states)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in brute_damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks = faults([(r[2], r[3]) for r in mine])
        cost, audit, lines = leftmost(marks)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = [m[2] for m in marks]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        out[conv] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, POS string, audit int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "x" * 3000 + ".", "Ünï。", None, "a. \n"]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "", None, "tool", "User", "union"]
    out = []
    for conv in range(150):
        for turn in range(rng.randint(0, 14)):
            text = rng.choice(texts[:3] + texts) if rng.random() < 0.4 else f"{turn} says."
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            out.append((conv, rng.choice([turn] * 9 + [None, turn + 3]), role, text))
    out += [(None, i, ("assistant", "user")[i % 2], "ok.") for i in range(5)] + [(1000, 7, "user", "one.")] * 40 + [(1001, None, "system", None)] * 3
    # One conversation with a third of all rows and more.
    out += [(5000, i, rng.choice(roles[:14]), f"{rng.randint(0, 400)}{rng.choice('.!?x')}") for i in range(700)]
    return [(*r, "pos", 1) for r in out]


def test_summary_equals_left_to_right_search(spark, rows):
    plain = [r[:4] for r in rows]
    assert got(repair.summary(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(plain)


def test_small_blocks_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_TURNS", 3)
    assert got(repair.summary(spark.createDataFrame(rows, SCHEMA))) == brute([r[:4] for r in rows])


def test_repaired_turns_have_the_form(spark, rows):
    found, repaired = repair.repair(spark.createDataFrame(rows, SCHEMA))
    edits, lines = {r["conv_id"]: r["audit"] for r in found.collect()}, {}
    for r in sorted(repaired.collect(), key=lambda r: (r["pos"], r["seq"])):
        lines.setdefault(r["conv_id"], []).append(r)
        assert (r["edit"] == "I") == (r["turn"] is None and r["text"] == "") or r["turn"] is None
    for conv, audit in edits.items():
        mine = lines.get(conv, [])
        assert "".join(r["edit"] for r in mine) == audit.replace("D", "")
        assert FORM.fullmatch("".join(r["role"][:1] for r in mine))


def test_empty_table_gives_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    found, repaired = repair.repair(empty)
    assert (found.count(), repaired.count(), repair.summary(empty).count()) == (0, 0, 0)


def test_conversation_of_which_nothing_is_left(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "gone.")], "conv_id long, turn long, role string, text string")
    assert got(repair.summary(df)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_parse_is_the_least_of_all_edits():
    """Every string of edits up to six over every short run of turns."""
    rng = random.Random(4)
    for _ in range(60):
        turns = [rng.choice("suax") + rng.choice("bdtnnn") for _ in range(rng.randint(0, 4))]
        options = []
        for size in range(len(turns), 7):
            for word in itertools.product("DIKR", repeat=size):
                if sum(e != "I" for e in word) == len(turns):
                    options.append("".join(word))
        least = min(filter(None, (_value(w, turns) for w in options)))
        assert repair.best(repair.parse([repair.LEAVES[t] for t in turns])) == least


def _value(word, turns):
    """(cost, edits) where they give the form by some choice of roles."""
    cost, shapes, at = 0, [""], 0
    for e in word:
        initial, fault = (" ", "n") if e == "I" else turns[at]
        at += e != "I"
        if e in "KR" and fault in "bd":
            return None
        cost += {"K": 0, "R": 1, "D": 2, "I": 5}[e] + (5 if e in "KR" and fault == "t" else 0)
        shapes = [s + c for s in shapes for c in ([""] if e == "D" else [initial] if e == "K" else "ua")]
    return (cost, word) if any(FORM.fullmatch(s) for s in shapes) else None


def test_any_split_gives_the_same_cell():
    rng = random.Random(8)
    for _ in range(40):
        leaves = [repair.LEAVES[rng.choice("suax") + rng.choice("bdtnn")] for _ in range(rng.randint(2, 12))]
        whole = repair.parse(leaves)
        for cut in range(1, len(leaves)):
            assert repair.joined(repair.parse(leaves[:cut]), repair.parse(leaves[cut:])) == whole
