"""Conversation repair against a search over whole conversations, row by row."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import repair

BLANK = " \t\n\x0b\x0c\r"
STEP = {"0s": "1", "0u": "2", "1u": "2", "2a": "3", "3u": "2"}


def brute_audit(kinds, initials):
    """Least (cost, audit) by growing every partial repair row by row: the best of each state, inserts tried up to twice before each row."""
    best = {"0": (0, "")}

    def with_inserts(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                for letter in "ua":
                    if q + letter in STEP:
                        to, new = STEP[q + letter], (c + 5, a + "I")
                        best[to] = min(best.get(to, new), new)
        return best

    for kind, first in zip(kinds, initials):
        after = {}
        for q, (c, a) in with_inserts(best).items():
            options = [(q, c + 2, "D")]
            if kind not in ("blank", "duplicate"):
                extra = 5 * (kind == "truncated")
                options += [(STEP[q + x], c + 1 + extra, "R") for x in "ua" if q + x in STEP]
                if q + first in STEP:
                    options.append((STEP[q + first], c + extra, "K"))
            for to, cost, letter in options:
                after[to] = min(after.get(to, (cost, a + letter)), (cost, a + letter))
        best = after
    return min(v for q, v in with_inserts(best).items() if q in "03")


def brute(rows):
    """What the query returns, for rows (conv_id, turn, role, text)."""
    whole = {}
    for conv, turn, role, text in rows:
        held = whole.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if fault == 4:
            role = "user"
        if fault:
            held += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {conv: brute_one(held) for conv, held in whole.items()}


def brute_one(held):
    if not held:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    held = sorted(held, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, kinds = set(), []
    for _, role, text in held:
        inner = text.strip(BLANK)
        kinds.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, *_ in held if t is not None}
    initials = [r[:1] for _, r, _ in held]
    cost, audit = brute_audit(kinds, initials)
    out, state, i = [], "0", 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role = "assistant" if state == "2" else "user"
        if letter == "K":
            role = held[i][1]
        out.append(f"{role}:{'' if letter == 'I' else held[i][2]}")
        state = STEP[state + role[0]]
        i += letter != "I"
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def check(spark, rows, df=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") if df is None else df
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def made(seed, convs, most):
    rng = random.Random(seed)
    words = ["Yes.", "No", "What?", " ", "", "ok!", "fine . ", "a:b", "Zürich"]
    rows = []
    for c in range(convs):
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([1, 1, 1, 2])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(words) + (str(turn) + "." if rng.random() < 0.6 else "")))
    return rows


@pytest.mark.parametrize("length", range(6))
def test_search_equals_brute_force_on_all_short_conversations(length):
    names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    for kinds in itertools.product((0, 1, 3), repeat=length):
        for initials in itertools.product("suax" if length < 4 else "sua", repeat=length):
            if length > 3 and random.Random(str((kinds, initials))).random() > 0.03:
                continue
            assert repair.cheapest(list(kinds), list(initials), 0, repair.ENDS) == brute_audit([names[k] for k in kinds], initials)


def test_products_of_pieces_equal_the_whole():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 24)
        kinds, initials = [rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(n)], [rng.choice("uuaas") for _ in range(n)]
        cut = sorted(rng.sample(range(n + 1), min(3, n)))
        parts = [repair.product(kinds[i:j], initials[i:j]) for i, j in zip([0, *cut], [*cut, n])]
        joined = repair.all_joined(parts)
        assert min(v for (p, q), v in joined.items() if p == 0 and q in repair.ENDS) == repair.cheapest(kinds, initials, 0, repair.ENDS)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    check(spark, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()], df)


def test_short_and_long_conversations(spark, monkeypatch):
    check(spark, made(1, 150, 7))
    check(spark, made(2, 3, 700))  # longer than a piece, over several tasks
    monkeypatch.setattr(repair, "PIECE", 3)
    check(spark, made(4, 30, 40))


def test_one_conversation_of_equal_rows_and_many_tasks(spark):
    rows = [(7, t % 5, "user", "Same.") for t in range(900)] + [(7, None, "system", "Rules.")] * 3 + made(5, 20, 5)
    check(spark, rows)


def test_nulls_ties_other_columns_empty_and_very_long(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "", "x."), (1, 1, "user", None), (2, 1, None, "a."), (2, 1, None, "a."), (3, 3, "assistant", "x" * 300_000 + "."), (3, 9, "user", "y" * 300_000),
            *[(4, t, "user", "t.") for t in range(60) if zlib.crc32(f"4:{t}".encode()) % 20 == 0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"cost": F.lit("x"), "digest": F.lit(1), "task": F.lit(2), "audit": F.lit(None)})
    check(spark, rows, df)
    assert repair.repair(df.where("false")).count() == 0


def test_repaired_rows_give_the_digest(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 4)
    df = spark.createDataFrame(made(6, 12, 30), "conv_id long, turn long, role string, text string")
    lines = {}
    for r in sorted(repair.repaired_rows(repair.damage(df)).collect(), key=lambda r: (r.conv_id, r.task or 0, r.piece or 0, r.n)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair.repair(df).collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
