"""Token operators against the libraries whose results they must give."""

import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from barloom.llm import bpe, counts

RANKS, PIECES, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
PARTS = ["a", " ", "\n", "é", "日", "\x1c", "▁", "'s", "'S", "<s>", "</s>", "\x00", "1", "23", "!!", "\U0001F600", "  ", "\t", "\xa0", "x", "token", "lowest", "\r\n", "<0x41>"]


def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + ["", "a" * 5000, " " * 3000, "日本語" * 900, "ab" * 4000 + " " * 40 + "x", " " * 17 + "x" + " " * 31, "!" * 777,
                  "".join(rng.choice("abcdefghij") for _ in range(9000)), "".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(3000))]


def test_byte_bpe_equals_the_rank_library_and_decodes_back():
    own = bpe.coder(RANKS, PATTERN)
    want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    some = texts()
    for text, ids in zip(some, own.encode(some)):
        assert ids == want.encode_ordinary(text)
        assert own.decode(list(map(str, ids))) == text.encode()


def test_byte_bpe_needs_every_byte():
    with pytest.raises(ValueError):
        bpe.ByteBPE({b"a": 0}, PATTERN)


def test_long_texts_are_cut_where_no_pretoken_spans(monkeypatch):
    from barloom.llm import common
    some = texts()
    monkeypatch.setattr(bpe, "text_parts", lambda t: common.text_parts(t, 50))
    monkeypatch.setattr(bpe, "chunks", lambda t: [range(i, i + 1) for i in range(len(t))])
    want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    own = bpe.ByteBPE(bpe.read_ranks(RANKS), PATTERN)
    assert own.encode(some) == [want.encode_ordinary(t) for t in some]


def test_piece_counts_equal_the_library():
    some = texts()
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(some, num_threads=1)
    assert counts.merger(PIECES).count_texts(some) == [len(x) for x in want]


def test_rounds_and_heap_agree(monkeypatch):
    some = texts()[:60]
    own = counts.merger(PIECES)
    pre = [p for t in some for p in counts.PRETOKENS.findall("▁" + t.replace(" ", "▁"))]
    rounds = own.count(pre)
    monkeypatch.setattr(counts, "LONG", 0)
    assert (rounds == own.count(pre)).all()


def test_spark_forms_take_nulls_repeats_and_other_columns(spark):
    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("other")).withColumn("ids", F.lit(0))
    digests = bpe.round_trip_digests(docs, RANKS, PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in digests) == [("1", 0), ("2", 0), ("3", 2), ("3", 2), ("None", 1)]
    back = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == [b"", b"", b"two words", b"two words", b"x"]
    count = counts.count_tokens(docs, PIECES, 1).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.over_limit) for r in count) == [("1", 0, False), ("2", 0, False), ("3", 9, True), ("3", 9, True), ("None", 1, False)]
    assert bpe.round_trip_digests(docs.where("false"), RANKS, PATTERN).count() == counts.count_tokens(docs.where("false"), PIECES, 1).count() == 0
