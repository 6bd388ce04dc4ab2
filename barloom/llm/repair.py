"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A lattice node is (rows taken, state) where the state is the place in the pattern
``(s?(ua)+)?`` of role initials: nothing yet, after s, after u, after a. Edits are
the edges. A forward heap from the start and a reverse heap from the ends settle
nodes by cost until no cheaper or equally cheap path can be left; all crossings
of the least cost are finished, and the one with the ASCII-least audit (the
edits' initials) is taken. An audit fixes the repaired rows: every edit but Keep
takes the only role the state allows.

Rows are sorted over all tasks by conversation and order, in ranges, so that a
conversation of any size is dealt out. A conversation that lies inside a task is
solved there, piece by piece of ``PIECE`` rows; one that may go on in the next
task leaves its pieces to the next step, which finds rows that repeat one of an
earlier piece, solves each piece from every state to every state, and joins the
pieces' (cost, audit) products in order. Costs add up and audits append; of equal
cost no audit begins another one, as an audit tells its cost, so the least audit
of the whole is made of least audits of the pieces. Only the digest of the
repaired text reads a long conversation in one task, in order, as a digest must;
it holds one piece at a time.

Defined cases: nulls of conv_id and turn are one space in the checksum, null role
and text are one space; rows of null conv_id are one conversation. Rows of one
turn (and null turns, which come first) go by role and text digest, a repeated
row next to its original. Empty role: no initial. Conversations without rows
after damage: zeros, an empty audit and the digest of the empty text. Other
columns are not read. An empty table gives no rows. The table should be files or
a written table, as row numbers that deal out equal rows are taken while reading.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BLANKS, stored

# Fixed values of the contract: what edits cost, the faults, the pattern of role initials.
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = {"su", "ua", "au"}
ENDS = (0, 3)
#: The role a Rerole or an Insert gives in each state, and the state after it.
GIVES = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Rows that one search takes.
PIECE = 64


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by crc32(``conv_id:turn``) % 20; ``again`` numbers a repeated row."""
    blank = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce("text", blank)
    out = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                     F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                     F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("again"))
    return out.withColumn("again", F.explode("again"))


def edges(kinds: list[int], initials: list[str], i: int, q: int) -> list[tuple[int, str, int, int]]:
    """(cost, letter, rows taken, state) of each edit at a node."""
    _, after = GIVES[q]
    out = [(INSERT, "I", i, after)]
    if i < len(kinds):
        out.append((DELETE, "D", i + 1, q))
        if kinds[i] in (SOUND, CUT_OFF):
            more = TRUNCATED if kinds[i] == CUT_OFF else 0
            out.append((RETYPE + more, "R", i + 1, after))
            if (q, initials[i]) in NEXT:
                out.append((more, "K", i + 1, NEXT[q, initials[i]]))
    return out


def back_edges(kinds: list[int], initials: list[str], i: int, q: int) -> list[tuple[int, str, int, int]]:
    """The edits that lead to a node: (cost, letter, rows taken, state) of where they start."""
    return [(cost, letter, j, p) for j in (i - 1, i) if j >= 0 for p in range(4) for cost, letter, x, y in edges(kinds, initials, j, p) if (x, y) == (i, q)]


def cheapest(kinds: list[int], initials: list[str], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost, and the least audit of that cost, from ``start`` before all rows to one of ``ends`` after them."""
    n = len(kinds)
    # a label is (cost, audit); rows taken order nodes of equal cost, as edits without cost take a row
    heaps = [[(0, 0, start, "")], [(0, 0, q, "") for q in sorted(ends)]]
    settled: list[dict[tuple[int, int], tuple[int, str]]] = [{}, {}]
    best = None

    def meet(cost: int) -> None:
        nonlocal best
        best = cost if best is None else min(best, cost)

    while all(heaps):
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, taken, q, audit = heapq.heappop(heaps[side])
        i = n - taken if side else taken
        if (i, q) in settled[side]:
            continue
        settled[side][i, q] = cost, audit
        there = settled[1 - side]
        if (i, q) in there:
            meet(cost + there[i, q][0])
        for more, letter, j, p in (back_edges if side else edges)(kinds, initials, i, q):
            if (j, p) in settled[side]:
                continue
            heapq.heappush(heaps[side], (cost + more, n - j if side else j, p, letter + audit if side else audit + letter))
            if (j, p) in there:
                meet(cost + more + there[j, p][0])
    if best is None:
        return None
    forth, back = settled
    crossings = [audit + back[node][1] for node, (cost, audit) in forth.items() if node in back and cost + back[node][0] == best]
    crossings += [audit + letter + back[j, p][1] for (i, q), (cost, audit) in forth.items() for more, letter, j, p in edges(kinds, initials, i, q)
                  if (j, p) in back and cost + more + back[j, p][0] == best]
    return best, min(crossings)


def product(kinds: list[int], initials: list[str], starts=range(4), ends=range(4)) -> dict[tuple[int, int], tuple[int, str]]:
    """``cheapest`` of one piece between single states."""
    found = {(p, q): cheapest(kinds, initials, p, (q,)) for p in starts for q in ends}
    return {k: v for k, v in found.items() if v is not None}


def joined(a: dict, b: dict) -> dict[tuple[int, int], tuple[int, str]]:
    """The product of two pieces in a row."""
    out: dict = {}
    for (p, m), (cost, audit) in a.items():
        for (m2, q), (more, rest) in b.items():
            if m == m2 and ((p, q) not in out or cost + more <= out[p, q][0]):
                out[p, q] = min(out.get((p, q), (cost + more + 1, "")), (cost + more, audit + rest))
    return out


def all_joined(products: list[dict]) -> dict[tuple[int, int], tuple[int, str]]:
    """The product of all pieces, by halves, so that audits are copied log times."""
    while len(products) > 1:
        products = [joined(*products[i:i + 2]) if i + 1 < len(products) else products[i] for i in range(0, len(products), 2)]
    return products[0]


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[str], int, int]:
    """Lines ``role:text`` that an audit makes of these rows, the state after them, the audit's letters used."""
    lines, i, used = [], 0, 0
    for letter in audit:
        if letter != "I" and i == len(roles):
            break
        used += 1
        given, after = GIVES[state]
        if letter == "I":
            lines.append(f"{given}:")
            state = after
            continue
        if letter == "R":
            lines.append(f"{given}:{texts[i]}")
            state = after
        elif letter == "K":
            lines.append(f"{roles[i]}:{texts[i]}")
            state = NEXT[state, roles[i][:1]]
        i += 1
    return lines, state, used


def solve(roles: list[str], texts: list[str], kinds: list[int]) -> tuple[int, str, list[str]]:
    """Cost, audit and repaired lines of a whole conversation in memory."""
    cost, audit = cheapest(kinds, [r[:1] for r in roles], 0, ENDS)
    return cost, audit, repaired(roles, texts, audit, 0)[0]


def kinds_of(roles: list[str], texts: list[str], seen: set) -> list[int]:
    """First fault of each row; ``seen`` holds the rows before and is added to."""
    out = []
    for row in zip(roles, texts):
        inner = row[1].strip(BLANKS)
        out.append(BLANK if not inner else DUPLICATE if row in seen else CUT_OFF if inner[-1] not in ".!?" else SOUND)
        seen.add(row)
    return out


def counts(turns: list[int | None], roles: list[str]) -> list:
    """[least turn, greatest turn, different turns, pairs of roles that may not follow each other]."""
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    return [min(known, default=None), max(known, default=None), len(set(known)), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))]


OUT = "gaps blank duplicate truncated illegal cost".split()
DONE = f"lines array<string>, audit string, repaired_sha256 string, {', '.join(f'{c} long' for c in OUT)}"
OPEN = "task long, piece long, roles array<string>, texts array<string>, turns array<long>"


def _pieces(rows: DataFrame, keep: bool) -> DataFrame:
    """A row a conversation that lies inside a task, solved; a row a piece of one that touches the task's first or last row."""
    kind = dict(rows.dtypes)["conv_id"]
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "at", "again"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.withColumns({"digest": F.xxhash64("text"), "at": F.monotonically_increasing_id()}).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("digest", "at", "again")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        names = ["conv_id", "task", "piece", "roles", "texts", "turns", "lines", "audit", "repaired_sha256", *OUT]
        types = [conv_type(kind), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.string(), *[pa.int64()] * len(OUT)]
        buffer: list[tuple] = []

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in buffer], t) for i, t in enumerate(types)], names)
            buffer.clear()
            return out

        def solved(conv, held: list[tuple]) -> tuple:
            turns, roles, texts = map(list, zip(*held))
            kinds = kinds_of(roles, texts, set())
            cost, audit, lines = solve(roles, texts, kinds)
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            low, high, different, illegal = counts(turns, roles)
            gaps = 0 if low is None else high - low + 1 - different
            return conv, None, None, None, None, None, lines if keep else None, audit, digest, gaps, kinds.count(BLANK), kinds.count(DUPLICATE), kinds.count(CUT_OFF), illegal, cost

        def piece(conv, number: int, held: list[tuple]) -> tuple:
            turns, roles, texts = map(list, zip(*held))
            return conv, task, number, roles, texts, turns, None, None, None, *[None] * len(OUT)

        conv, held, apart, number = object(), [], True, 0  # apart: the conversation goes in pieces
        for batch in batches:
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if own != conv:
                    if held:
                        buffer.append(piece(conv, number, held) if apart else solved(conv, held))
                        number, apart = number + apart, False
                    conv, held = own, []
                elif len(held) == PIECE:
                    buffer.append(piece(conv, number, held))
                    held, number, apart = [], number + 1, True
                held.append(tuple(row))
                if len(buffer) >= 500:
                    yield send()
        if held:
            buffer.append(piece(conv, number, held))
        if buffer:
            yield send()

    return ordered.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(work, f"conv_id {kind}, {OPEN}, {DONE}")


def conv_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]


def _solved(damaged: DataFrame, keep: bool) -> DataFrame:
    """Rows with the results of a conversation, and, if ``keep``, rows with the lines of its pieces in order of task and piece."""
    kind = dict(damaged.dtypes)["conv_id"]
    parts = stored(_pieces(damaged, keep))
    opened = _repair_open(parts.where("task IS NOT NULL").select("conv_id", "task", "piece", "roles", "texts", "turns"), kind, keep)
    return parts.where("task IS NULL").select(*opened.columns).unionByName(opened)


def repair(rows: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """Per conv_id of ``rows``: the faults, gaps and cheapest repair of its rows in ``damaged`` (conv_id, turn, role, text, again; by default ``damage(rows)``)."""
    found = _solved(damage(rows) if damaged is None else damaged, keep=False).withColumnRenamed("conv_id", "conv")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in OUT]
    return rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repaired_rows(damaged: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, role, text, in order of (task, piece, n)."""
    return _solved(damaged, keep=True).select("conv_id", "task", "piece", F.posexplode("lines").alias("n", "line")).select(
        "conv_id", "task", "piece", "n", F.expr("substring(line, 1, instr(line, ':') - 1)").alias("role"), F.expr("substring(line, instr(line, ':') + 1)").alias("text"))


def _repair_open(pieces: DataFrame, kind: str, keep: bool) -> DataFrame:
    """The same for conversations in pieces that any number of tasks left."""
    key = [F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")]  # nulls meet as well
    pieces = pieces.select("*", *key)
    # a row is a duplicate if it stands in an earlier piece, or earlier in its own
    each = pieces.select("none", "conv", "task", "piece", F.explode(F.arrays_zip("roles", "texts")).alias("x"))
    seen = each.groupBy("none", "conv", F.sha2(F.concat(F.col("x.roles").cast("binary"), F.lit(b"\x00"), F.col("x.texts").cast("binary")), 256).alias("digest"), "task", "piece").count()
    first = seen.groupBy("none", "conv", "digest").agg(F.min(F.struct("task", "piece")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = seen.join(first, ["none", "conv", "digest"]).where("struct(task, piece) <> first").groupBy("task", "piece").agg(F.collect_set("digest").alias("known"))
    pieces = pieces.join(again, ["task", "piece"], "left")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                task, number, none, conv = (batch.column(c)[i].as_py() for c in ("task", "piece", "none", "conv"))
                roles, texts, turns, known = (batch.column(c)[i].as_py() for c in ("roles", "texts", "turns", "known"))
                known = set(known or ())
                before = {r for r in zip(roles, texts) if hashlib.sha256(r[0].encode() + b"\0" + r[1].encode()).hexdigest() in known} if known else set()
                kinds = kinds_of(roles, texts, before)
                initials = [r[:1] for r in roles]
                found = all_joined([product(kinds[j:j + PIECE], initials[j:j + PIECE]) for j in range(0, len(kinds), PIECE)])
                low, high, different, illegal = counts(turns, roles)
                paths = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in found.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((none, pa.bool_()), (conv, pa.string()), (task, pa.int64()), (number, pa.int64()), (len(roles), pa.int64()), (low, pa.int64()), (high, pa.int64()), (different, pa.int64()), (illegal, pa.int64()),
                                                   (initials[0], pa.string()), (initials[-1], pa.string()), (kinds.count(BLANK), pa.int64()), (kinds.count(DUPLICATE), pa.int64()), (kinds.count(CUT_OFF), pa.int64()), (paths, PATHS))], names)

    names = "none conv task piece n low high different illegal head tail blank duplicate truncated paths".split()
    PATHS = pa.list_(pa.struct([("p", pa.int64()), ("q", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))
    solved = stored(pieces.select("task", "piece", "none", "conv", "roles", "texts", "turns", "known").mapInArrow(
        search, "none boolean, conv string, task long, piece long, n long, low long, high long, different long, illegal long, head string, tail string, "
                "blank long, duplicate long, truncated long, paths array<struct<p: long, q: long, cost: long, audit: string>>"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by conversation and order; a row a piece with its start state and edits, and one a conversation."""
        rows = (r for batch in batches for r in batch.to_pylist())
        for (none, conv), own in groupby(rows, key=lambda r: (r["none"], r["conv"])):
            products, sizes, total, last, gaps = [], [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "different"), 0), None, [None, None, None]
            for r in own:
                products.append({(x["p"], x["q"]): (x["cost"], x["audit"]) for x in r["paths"]})
                sizes.append((r["task"], r["piece"], r["n"]))
                for c in total:
                    total[c] += r[c]
                if last is not None:
                    total["illegal"] += last + r["head"] not in LEGAL
                if r["low"] is not None:  # turns go up, so only the neighbours can share one
                    total["different"] -= r["low"] == gaps[1]
                    gaps[:2] = [r["low"] if gaps[0] is None else gaps[0], r["high"]]
                last = r["tail"]
            cost, audit = min(v for (p, q), v in all_joined(products).items() if p == 0 and q in ENDS)
            gap = 0 if gaps[0] is None else gaps[1] - gaps[0] + 1 - total["different"]
            whole = [gap, total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost]
            at = 0
            for k, (task, piece, n) in enumerate(sizes):
                end, left = at, n
                while end < len(audit) and (left or audit[end] == "I" or k == len(sizes) - 1):
                    left -= audit[end] != "I"
                    end += 1
                final = k == len(sizes) - 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((task, pa.int64()), (piece, pa.int64()), (audit[at:end], pa.string()), (audit if final else None, pa.string()), *((x if final else None, pa.int64()) for x in whole))],
                                                 ["task", "piece", "part", "audit", *OUT])
                at = end

    order = ["none", "conv", "task", "piece"]
    edits = solved.repartition("none", "conv").sortWithinPartitions(*order).mapInArrow(chain, f"task long, piece long, part string, audit string, {', '.join(f'{c} long' for c in OUT)}")
    whole = pieces.select(*order, "conv_id", "roles", "texts").join(edits, ["task", "piece"]).repartition("none", "conv").sortWithinPartitions(*order)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by conversation and order; one row a conversation, from its last piece."""
        state, own, empty = 0, hashlib.sha256(), True
        for batch in batches:
            for i in range(batch.num_rows):
                roles, texts, part, audit = (batch.column(c)[i].as_py() for c in ("roles", "texts", "part", "audit"))
                lines, state, _ = repaired(roles, texts, part, state)
                if lines:
                    own.update((("" if empty else "\n") + "\n".join(lines)).encode())
                    empty = False
                if audit is not None or keep:
                    done = own.hexdigest() if audit is not None else None
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c)[i:i + 1] for c in ("conv_id", "task", "piece")), pa.array([lines if keep else None], pa.list_(pa.string())), pa.array([audit], pa.string()), pa.array([done], pa.string()), *(batch.column(c)[i:i + 1] for c in OUT)],
                        ["conv_id", "task", "piece", "lines", "audit", "repaired_sha256", *OUT])
                if audit is not None:
                    state, own, empty = 0, hashlib.sha256(), True

    return whole.select("conv_id", "task", "piece", "roles", "texts", "part", "audit", *OUT).mapInArrow(digest, f"conv_id {kind}, task long, piece long, {DONE}")
