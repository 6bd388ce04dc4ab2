"""Alignment against the tokenizer libraries and common ends found by brute force."""

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from barloom.llm import align
from tests.llm.test_tokens import texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a ", " ", " a", "x  ", "  ", "\n x\n", "<|endoftext|> b", "a<|endoftext|>", "<s> </s>", "a\u2581b", "tokens, tokens and more tokens."]


class Brute:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        with open(A, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = [c for c in map(chr, range(256)) if c.isprintable() and c != " "]
        self.of = {c: ord(c) for c in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letters)}
        self.vocab = {i: p for p, i in vocab.items()}

    def groups(self, text):
        """[(A ids, B ids)] or None without tokens."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        ab = [bytes(self.of[c] for c in self.vocab[i]) for i in a]
        bb = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            return None
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        out, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            x, y = ea.index(end) + 1, eb.index(end) + 1
            out.append((a[i:x], b[j:y]))
            i, j = x, y
        return out


def test_byte_table_is_the_public_one():
    brute = Brute()
    assert align.byte_table({p: i for i, p in brute.vocab.items() if i != 50256}) == {i: bytes(brute.of[c] for c in p) for i, p in brute.vocab.items() if i != 50256}


def test_groups_equal_brute_force(spark):
    brute, some = Brute(), texts() + ODD
    rows = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").withColumn("groups", F.lit(1))
    got = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in align.groups(rows, A, B).collect()}
    for i, text in enumerate(some):
        assert got[i] == (brute.groups(text) or []), text[:60]


def test_a_far_cut_is_found_and_cutless_intervals_stay_whole():
    rng = np.random.default_rng(5)
    for n, share in ((1, 1), (7, 2), (400, 3), (3000, 900)):
        end = 4 * n
        a, b = (np.append(np.sort(rng.choice(np.arange(2 + k, end, share + k), min(n, (end - 4) // (share + 1)), replace=False)), end) for k in (0, 1)) if n > 1 else (np.array([4]), np.array([4]))
        at, bt = align.shared_cuts(a, b, *(np.array([x]) for x in (0, len(a), 0, len(b))))
        want = np.intersect1d(a, b)
        assert (a[at - 1] == want).all() and (b[bt - 1] == want).all()


def expected(some):
    brute, out, holders = Brute(), [], Counter()
    links = []
    for text in some:
        groups = brute.groups(text) or []
        pairs = Counter((a, b) for x, y in groups for a in x for b in y)
        holders.update(pairs.keys())
        links.append((groups, pairs))
    best = {}
    for (a, _), n in holders.items():
        best[a] = max(best.get(a, 0), n)
    for groups, pairs in links:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(pairs.values()), sum(n for p, n in pairs.items() if holders[p] == best[p[0]]),
                    sum(n * holders[p] for p, n in pairs.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def test_counts_equal_brute_force(spark, monkeypatch):
    some = [t for t in texts() if len(t) < 4000][:250] + ODD + ODD + [None, ""] + ["the cat sat, the dog sat"] * 5
    want = Counter(expected([t or "" for t in some]))
    monkeypatch.setattr(align, "BLOCK", 1500)  # many blocks
    rows = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(some)], "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    got = align.link_counts(rows, A, B)
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == want
    assert align.link_counts(rows.where("false"), A, B).count() == 0


def test_long_text_and_small_memo_give_the_same(monkeypatch):
    own, brute = align.Aligner(A, B), Brute()
    text = " ".join(["word", "Wörter", "日本", "x1y2"] * 300) + "a" * 20000
    want = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in brute.groups(text))
    monkeypatch.setattr(align, "MEMO", 0)
    for _ in range(2):
        [ids] = own.block([text])
        assert ";".join(own.text[i] for i in ids) == want
