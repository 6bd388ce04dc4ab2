"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

Pre-tokens of a batch lie in ragged numpy arrays: one flat array of symbols and
the start of each sequence. A round finds every sequence's best pair (lowest
rank, then leftmost), merges all of them at once, drops the sequences without a
pair and counts their symbols. A symbol outside the vocabulary counts its bytes
(byte fallback). Sequences are cut first where no piece holds the two characters
side by side, as no merge crosses such a place; what is still longer than
``LONG`` symbols is merged with a heap, which gives the same result in
n log n steps.

Defined cases: a null text is the empty text (0 bytes, 0 tokens); control
strings such as ``<s>`` inside a text are ordinary characters; repeated rows
count each; other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from barloom.llm.common import chunks, text_parts

BLANK = "▁"
NONE = np.iinfo(np.int64).max
#: Longest sequence, in symbols, that the rounds take.
LONG = 128
#: Memoised pre-tokens per Python worker; the memo starts anew beyond it.
MEMO = 1_000_000
MEMO_CHARS = 64
#: Without a memo hit a run of blanks goes with the characters after it, as no piece has a blank after another character.
PRETOKENS = re.compile(f"{BLANK}+[^{BLANK}]*")


class PieceMerger:
    """Merge tables of one model as sorted arrays."""

    def __init__(self, data: bytes):
        model = pb.ModelProto.FromString(data)
        norm = model.normalizer_spec
        if (model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap
                or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces):
            raise ValueError("a BPE model with byte fallback, identity normalisation and a leading blank is expected")
        kind = pb.ModelProto.SentencePiece
        if any(p.type == kind.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        if any(BLANK in p.lstrip(BLANK) for p in score):
            raise ValueError("a piece holds a blank after another character")
        rank = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        names = sorted(set(score) | {c for p in score for c in p})
        self.number = {name: i for i, name in enumerate(names)}
        self.base = len(names)
        pairs = {}
        beside = set()
        for piece, s in score.items():
            for i in range(1, len(piece)):
                beside.add(self.number[piece[i - 1]] * self.base + self.number[piece[i]])
                left, right = self.number.get(piece[:i]), self.number.get(piece[i:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (rank[s], self.number[piece])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)
        self.pairs, self.beside = pairs, np.array(sorted(beside), np.int64)
        # a symbol of the vocabulary is one token, another character its bytes
        self.weight = np.array([1 if n in score else len(n.encode()) for n in names], np.int64)
        self.memo: dict[str, int] = {}

    def _pair_rows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the tables; the last row stands for no pair."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        miss = (self.keys[at] != key) | (left < 0) | (right < 0) if len(self.keys) else np.ones(len(key), bool)
        at[miss] = len(self.keys)
        return at

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        total = np.zeros(len(pretokens), np.int64)
        if not pretokens:
            return total
        chars = "".join(pretokens)
        number = self.number
        known = {c: number.get(c, -1) for c in set(chars)}
        sym = np.fromiter(map(known.__getitem__, chars), np.int64, len(chars))
        owner = np.repeat(np.arange(len(pretokens)), np.fromiter(map(len, pretokens), np.int64, len(pretokens)))
        lost = sym < 0
        if lost.any():
            size = np.fromiter((len(chars[i].encode()) for i in np.flatnonzero(lost)), np.int64)
            np.add.at(total, owner[lost], size)
        # cut: another pre-token, or two characters that no piece has side by side
        key = sym[:-1] * self.base + sym[1:]
        at = np.minimum(np.searchsorted(self.beside, key), max(len(self.beside) - 1, 0))
        cut = (owner[:-1] != owner[1:]) | lost[:-1] | lost[1:]
        cut |= (self.beside[at] != key) if len(self.beside) else True
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        sizes = np.diff(np.append(starts, len(sym)))
        for i in np.flatnonzero(sizes > LONG):
            part = sym[starts[i]:starts[i] + sizes[i]]
            total[owner[starts[i]]] += self._heap(part.tolist())
        use = (sizes <= LONG) & ~lost[starts]
        seq = np.repeat(np.arange(len(starts)), sizes)
        keep = use[seq]
        self._rounds(sym[keep], seq[keep], owner[starts], total)
        return total

    def _rounds(self, sym: np.ndarray, seq: np.ndarray, owner: np.ndarray, total: np.ndarray) -> None:
        """Merge each sequence's best pair, all sequences at once, until none has one."""
        if not len(sym):
            return
        row = np.full(len(sym), len(self.keys))  # of the pair that starts at each symbol
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        row[inside] = self._pair_rows(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.concatenate([[True], seq[1:] != seq[:-1]])
            starts = np.flatnonzero(first)
            rank = self.ranks[row]
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            over = best == NONE
            if over.any():  # these are final
                gone = np.repeat(over, sizes)
                np.add.at(total, owner[seq[gone]], self.weight[sym[gone]])
                sym, seq, row, rank = sym[~gone], seq[~gone], row[~gone], rank[~gone]
                best, sizes = best[~over], sizes[~over]
                if not len(sym):
                    return
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            hit = hit[np.concatenate([[True], seq[hit[1:]] != seq[hit[:-1]]])]  # leftmost of each sequence
            sym[hit] = self.merged[row[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, row, hit = sym[keep], seq[keep], row[keep], place[hit]
            n = len(sym)
            row[hit] = len(self.keys)
            right = hit[(hit + 1 < n)]
            right = right[seq[right] == seq[right + 1]]
            row[right] = self._pair_rows(sym[right], sym[right + 1])
            left = hit[hit > 0] - 1
            left = left[seq[left] == seq[left + 1]]
            row[left] = self._pair_rows(sym[left], sym[left + 1])

    def _heap(self, sym: list[int]) -> int:
        """Tokens of one long sequence."""
        n, base, pairs = len(sym), self.base, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := pairs.get(sym[i] * base + sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        weight = self.weight
        return int(sum(weight[s] for s in sym if s >= 0))

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; the pre-tokens not seen before are merged together."""
        out = [0] * len(texts)
        for run in chunks(texts):
            if len(self.memo) > MEMO:
                self.memo = {}
            if len(run) == 1 and len(texts[run[0]]) > 1 << 20:
                i = run[0]
                out[i] = sum(self._sum([PRETOKENS.findall(part)]) [0] for part in self._marked(texts[i]))
                continue
            lists = [PRETOKENS.findall(BLANK + texts[i].replace(" ", BLANK)) if texts[i] else [] for i in run]
            for i, n in zip(run, self._sum(lists)):
                out[i] = n
        return out

    @staticmethod
    def _marked(text: str) -> Iterator[str]:
        for k, part in enumerate(text_parts(text)):
            yield ("" if k else BLANK) + part.replace(" ", BLANK)

    def _sum(self, lists: list[list[str]]) -> list[int]:
        memo = self.memo
        got = [list(map(memo.get, found)) for found in lists]
        gaps = [(n, found, [i for i, x in enumerate(n) if x is None]) for n, found in zip(got, lists) if None in n]
        new = list({found[i] for _, found, at in gaps for i in at})
        learned = dict(zip(new, self.count(new).tolist()))
        for n, found, at in gaps:
            for i in at:
                n[i] = learned[found[i]]
        memo.update((p, n) for p, n in learned.items() if len(p) <= MEMO_CHARS)
        return list(map(sum, got))


@functools.lru_cache(maxsize=4)
def merger(path: str) -> PieceMerger:
    """One merger per Python worker and file."""
    with open(path, "rb") as f:
        return PieceMerger(f.read())


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """Per row: bytes and tokens of ``text``, and whether the tokens exceed ``limit``.

    ``path`` must be readable on every executor.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = own.count_texts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
