"""Near-duplicates, substrings and the pipeline against brute-force versions."""

import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import components, simhash, substring

WORD = "[^\x20\x09-\x0D]+"


def plain_fingerprint(text, size, seed=42):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def plain_groups(ids, linked):
    """Smallest id that links lead to, for each id."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_texts(seed=7):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 15])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" \n".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    rows += [None, "", " \t", "one", "ONE", "one two three four"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [4096, 9])
def test_groups_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = near_texts()
    docs = spark.createDataFrame([*rows, (3, rows[3][1]), (None, "x y z")], "doc_id long, text string").withColumn("fp", F.lit(1))
    fp = {i: plain_fingerprint(t, 4) for i, t in rows}
    want = plain_groups([i for i, _ in rows], lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None
        else:
            assert (row.fingerprint, row.component_id) == (f"{fp[row.doc_id]:016x}", want[row.doc_id])
    assert any(k != v for k, v in want.items())
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_similar_texts_share_a_component_and_others_do_not(spark):
    rows = near_texts(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits, lanes = simhash.lane_plan(len(rows), 0.8)
    lanes = max(lanes, 4)
    total = math.floor(64 * lanes * simhash.differing_share(0.74))
    fp = {i: [plain_fingerprint(t, 5, 42 + k) for k in range(lanes)] for i, t in rows}
    linked = lambda a, b: (sum((x ^ y).bit_count() for x, y in zip(fp[a], fp[b])) <= total
                           and any(((x ^ y) >> (64 - bits)).bit_count() <= 4 for x, y in zip(fp[a], fp[b])))
    want = plain_groups([i for i, _ in rows], linked)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert got == want
    shingles = lambda t: {tuple(w[i:i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)}
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.8]
    assert pairs and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


@pytest.mark.parametrize("block", [1 << 18, 50])
def test_exact_links_are_the_pairs_of_that_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SHINGLES", block)
    rng = random.Random(3)
    rows = []
    for group in range(30):  # copies of one text with runs of words replaced: Jaccard about 0.6 to 0.95
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(6):
            copy, n = list(base), rng.choice([2, 6, 10, 14, 20, 30])
            at = rng.randrange(200 - n)
            copy[at:at + n] = [f"x{rng.randrange(5000)}" for _ in range(n)]
            rows.append((len(rows), " ".join(copy)))
    # equal fingerprints by one shingle that outnumbers all others, but different sets
    rows += [(len(rows) + k, "a " * 300 + " ".join(f"{c}{i}" for i in range(30))) for k, c in enumerate("yz")]
    rows += [(500, rows[0][1]), (501, rows[0][1].upper())]
    sets = {i: {tuple(w[k:k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)} for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    want = plain_groups(list(sets), lambda a, b: (min(a, b), max(a, b)) in near)
    docs = spark.createDataFrame([*rows, (None, "x y z")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.exact(docs).collect()}
    assert got.pop(None) is None
    apart = {(a, b) for a in sets for b in sets if a < b and want[a] != want[b]}
    assert not any(got[a] == got[b] for a, b in apart)  # nothing below the bar is joined
    assert sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {None, *(i for i, c in got.items() if i == c)}
    assert simhash.exact(docs.where("false")).count() == 0


def test_walk_finds_all_links_of_two_subtrees():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    y = np.unique(np.concatenate([rng.integers(0, 2**64, 2000, dtype=np.uint64), x[:300] ^ np.uint64(0b1011), x[300:400]]))
    for bits in (64, 24):
        got = {p for i, j in simhash.walk(x, y, False, 0, 4, bits) for p in zip(i.tolist(), j.tolist())}
        differ = np.bitwise_count((x[:, None] ^ y[None, :]) >> np.uint64(64 - bits))
        assert got == set(zip(*(z.tolist() for z in np.nonzero(differ <= 4))))


def test_walk_holds_little_at_once():
    rng = np.random.default_rng(3)
    spread = np.unique(rng.integers(0, 2**64, 8000, dtype=np.uint64))
    crowd = np.unique(rng.integers(0, 2**40, 1500, dtype=np.uint64))  # all share the leading bits
    for x, found in ((spread, None), (crowd, len(crowd) * (len(crowd) - 1))):
        tracemalloc.start()
        n = sum(len(i) for i, _ in simhash.walk(x, x, True, 0, 4, 24))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found is None or n == found
        assert peak < 48 << 20


def test_components_of_paths_stars_and_repeated_links(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200), (200, 200)]
    rename = list(range(300))
    rng.shuffle(rename)
    pairs = [(rename[a], rename[b]) for a, b in pairs]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    ids = sorted({x for p in pairs for x in p})
    want = plain_groups(ids, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert got == {i: want[i] for i in ids}


def plain_removal(rows, length):
    first, words = {}, [re.findall(WORD, t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for p in range(len(w) - length + 1):
            if d is not None:
                g = tuple(w[p:p + length])
                first[g] = min(first.get(g, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = {q for p in range(len(w) - length + 1) if d is not None and first[tuple(w[p:p + length])] < d for q in range(p, p + length)}
        out.append((d, len(w), len(gone), [x for j, x in enumerate(w) if j not in gone]))
    return out


def repeating_rows(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            text += b[a:rng.randint(a, len(b))] + [rng.choice(vocab)] * rng.randint(0, 2)
        rows.append((i, " \n".join(text) if i % 2 else " ".join(text)))
    rows += [(5, rows[5][1]), (5, rows[7][1]), (None, rows[3][1]), (300, None), (301, ""), (302, " ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length", [10, 20])
def test_removal_equals_all_windows(spark, length):
    rows = repeating_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cuts", F.lit(1)).withColumn("row", F.lit("x"))
    want = [(d, n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, n, gone, kept in plain_removal(rows, length)]
    assert sorted(map(tuple, substring.removal(docs, length).collect()), key=str) == sorted(want, key=str)
    assert sum(x[2] > 0 for x in want) > 5
    cut = substring.cut(docs, length)
    assert cut.columns == docs.columns
    kept = sorted((str(r.doc_id), re.findall(WORD, r.text or "")) for r in cut.collect())
    assert kept == sorted((str(d), kept) for d, _, _, kept in plain_removal(rows, length))
    assert substring.removal(docs.where("false"), length).count() == 0


def test_spans_have_a_true_source(spark):
    rows = [(d, t) for d, t in repeating_rows(9) if d is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = {}
    for d, t in rows:
        words.setdefault(d, []).append((t or "").split())
    spans = substring.repeated(docs, 15).collect()
    assert spans
    for x in spans:
        assert x.src < x.d and x.e - x.s >= 15
        assert any(a[x.s:x.e] and a[x.s:x.e] == b[x.src_s:x.src_s + x.e - x.s] for a in words[x.d] for b in words[x.src])


def test_blanks_of_kept_words_stay():
    assert substring.shorten("a\tb  c\nd e", [{"s": 1, "e": 2}]) == "a c\nd e"
    assert substring.shorten("a b", [{"s": 0, "e": 2}]) == ""


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in ("st", "re", "mo", "ti", "la") for b in ("on", "er", "al", "ing", "us")] + ["the", "of", "and", "to", "in"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    clean = [text(rng.randint(120, 300)) for _ in range(30)]
    passage = text(70)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[1].replace("the", "a", 1)), (102, "too short"), (103, "spam spam spam spam " * 40), (104, None),
             (105, text(60) + " " + passage + " " + text(60)), (106, text(60) + " " + passage + " " + text(60)),
             (107, text(80) + ' token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" ' + text(80)), (108, "#$%& " * 300)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    first = set(seen["quality_rules"])
    assert first == {*range(30), 100, 101, 105, 106, 107}
    assert set(seen["simhash_near_dedup"]) == first - {100, 101}
    third = seen["substring_dedup"]
    left = [(i, r.text) for i, r in seen["simhash_near_dedup"].items()]
    assert {i: (r.text.split(), r.n_chars) for i, r in third.items()} == {d: (kept, len(third[d].text)) for d, _, _, kept in plain_removal(left, 50) if kept}
    assert passage in third[105].text and passage not in third[106].text
    fourth = seen["secret_scans"]
    assert "1beb58b8" not in fourth[107].text and "[SECRET]" in fourth[107].text
    assert {i: r.text for i, r in fourth.items() if i != 107} == {i: r.text for i, r in third.items() if i != 107}
    pieces = spark.read.parquet(f"{tmp_path}/best_fit_packing").collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {i: len(r.text.split()) for i, r in fourth.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, pieces))
