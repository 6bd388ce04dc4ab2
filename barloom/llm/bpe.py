"""Byte-level BPE with a sentencepiece model made from a rank file.

The rank file lists byte strings in merge order. Every byte is mapped to one
character, each byte string becomes a piece scored by its negative rank, and the
model normalises nothing, so sentencepiece's merges (best score, then leftmost)
are the rank merges. Texts are cut by a pattern first; each match is encoded on
its own and memoised, as natural text repeats its words.

Defined cases: a null text is the empty text (no ids); repeated rows are encoded
again each; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from barloom.llm.common import chunks, text_parts

#: The character that stands for byte b is FIRST + b.
FIRST = 0x100
#: Memoised pre-tokens per Python worker; the memo starts anew beyond it.
MEMO = 500_000
#: Longer pre-tokens are not memoised.
MEMO_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank, one pair a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_SHIFT)


_SHIFT = {b: FIRST + b for b in range(256)}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; piece i is the i-th byte string by rank."""
    model = pb.ModelProto()
    for data, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece=as_chars(data), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(ranks)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    spec = model.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class ByteBPE:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing[:5]}")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.name = [str(rank) for rank in sorted(ranks.values())]  # of piece i
        self.bytes_of = {str(rank): data for data, rank in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        #: pre-token -> its ids as decimal text, joined by blanks
        self.memo: dict[str, str] = {}

    def encode_pretokens(self, pretokens: list[str]) -> list[str]:
        """Ids of each pre-token: its own rank if it has one, else the merges."""
        raw = [p.encode() for p in pretokens]
        out = [str(self.ranks[r]) if r in self.ranks else None for r in raw]
        todo = [i for i, x in enumerate(out) if x is None]
        found = self.model.encode([as_chars(raw[i]) for i in todo], num_threads=1) if todo else []
        name = self.name
        for i, ids in zip(todo, found):
            out[i] = " ".join([name[x] for x in ids])
        return out

    def _look_up(self, lists: list[list[str]]) -> list[list[str]]:
        """Ids of each list's pre-tokens; those not seen before are encoded in one call."""
        if len(self.memo) > MEMO:
            self.memo = {}
        memo = self.memo
        got = [list(map(memo.get, found)) for found in lists]
        gaps = [(ids, found, [i for i, x in enumerate(ids) if x is None]) for ids, found in zip(got, lists) if None in ids]
        new = list({found[i] for _, found, at in gaps for i in at})
        learned = dict(zip(new, self.encode_pretokens(new)))
        for ids, found, at in gaps:
            for i in at:
                ids[i] = learned[found[i]]
        memo.update((p, ids) for p, ids in learned.items() if len(p) <= MEMO_CHARS)
        return got

    def encode_text(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """(row, ids as decimal text) in order; a long text comes in several parts, one without ids not at all."""
        for run in chunks(texts):
            if len(run) == 1:
                for part in text_parts(texts[run[0]]):
                    if part:
                        yield run[0], " ".join(self._look_up([self.pattern.findall(part)])[0])
                continue
            for i, ids in zip(run, self._look_up([self.pattern.findall(texts[i]) for i in run])):
                if ids:
                    yield i, " ".join(ids)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for i, ids in self.encode_text(texts):
            out[i] += map(int, ids.split())
        return out

    def decode(self, ids: list[str]) -> bytes:
        """Bytes of the ids (decimal text), by the inverse of the rank table."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder per Python worker and file."""
    return ByteBPE(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of ``text``; ``path`` must be readable on every executor."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            ids = own.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of ``ids`` (null ids: none)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            data = [own.decode(list(map(str, ids or []))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {dict(encoded.dtypes)['doc_id']}, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the bytes decoded from them.

    One pass, so that ids never travel; long texts go through part by part.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [0] * len(texts)
            by_ids, by_bytes = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            for i, ids in own.encode_text(texts):
                single = ids.split(" ")
                by_ids[i].update(((" " if n[i] else "") + ids).encode())
                by_bytes[i].update(own.decode(single))
                n[i] += len(single)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in by_ids], pa.string()), pa.array([x.hexdigest() for x in by_bytes], pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
