"""Exact top-k with repeated ids, copies and several lengths, against brute force."""

import math
import random

from barloom.llm import vafile


def brute(rows, queries, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    out = set()
    for q, v in {q: v for q, v in queries}.items():
        own = [math.floor(1024 * x) for x in v]
        scored = sorted((-sum(a * b for a, b in zip(own, w)), i) for i, w in whole if i != q and len(w) == len(own))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_repeated_ids_copies_and_lengths(spark):
    rng = random.Random(2)
    vectors = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(30)]
    rows = [(i, vectors[i]) for i in range(30)]
    rows += [(3, vectors[3])] * 6 + [(5, vectors[9])] * 7 + [(n, vectors[9]) for n in range(40, 60)] + [(1, vectors[2])] * 2
    rows += [(n, [rng.uniform(-1, 1) for _ in range(3)]) for n in range(100, 107)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = [rows[0], rows[3], rows[5], rows[9], rows[-1]]
    asked = spark.createDataFrame(queries, df.schema)
    for k in (1, 4):
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.top_k(df, asked, k).collect()]
        want = brute(rows, queries, k)
        assert len(got) == len(want) and set(got) == want


def test_vectors_and_tiles_are_not_broadcast(spark, monkeypatch):
    """Their files are far smaller than they are in memory, so a join that trusts the size would fill the driver."""
    plans, store = [], vafile.stored
    monkeypatch.setattr(vafile, "BLOCK", 16)
    monkeypatch.setattr(vafile, "TILE", 80, raising=False)  # twenty queries
    monkeypatch.setattr(vafile, "SLICE", 6, raising=False)
    monkeypatch.setattr(vafile, "stored", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), store(df))[1])
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)] + [(300 + i, [0.5] * 4) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = vafile.top_k(df, df.where("vec_id % 5 = 0"), 3)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert [p for p in plans if "BroadcastExchange" in p] == []
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()]
    want = brute(rows, rows[::5], 3)
    assert len(got) == len(want) and set(got) == want
