"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both token sequences of a text are byte ranges of the same bytes. An interval of
both sequences is cut at a common end: the A ends nearest to its middle are
looked up among the B ends by bisection, in windows that double until one is
found; both halves are cut in the same way. An interval without a common end
inside is a leaf, a group. All open intervals of a batch take each step
together, as numpy arrays.

A text is first taken apart before blanks (U+0020) that follow a character other
than white space. Neither tokenizer has a token across such a place, so it is a
shared cut of every text, and equal units have equal tokens, groups and links:
they are worked out once per worker and looked up afterwards.

Corpus-wide counts go by block. A block is a bounded run of documents of one
task; it sends each id pair once, with the number of its documents that hold the
pair, and gets each pair's total back. So a pair that stands in every document
is one row a block, and no document travels with its pairs more than once.

Defined cases: null and empty texts, and texts whose tokens do not join to
blank+text (such as those with U+2581), have no tokens: zeros and an empty
``groups_sha256``. Repeated rows are documents of their own, each counted; a
null doc_id is carried along. A text without a blank is one unit. Special
strings inside texts are plain text. Other columns are not read. An empty table
gives no rows. ``a_path`` and ``b_path`` must be readable on every executor.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, stored

BLANK = "▁"
#: A unit starts at a blank after anything but white space.
UNITS = regex.compile(r"(?<=\S)(?= )")
#: Memoised units per Python worker; beyond it the half used most stays.
MEMO = 300_000
#: Longer units are not memoised beyond their block.
MEMO_CHARS = 64
#: Characters of a block (a longer document is a block alone).
BLOCK = 1 << 20


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, a_lo, a_hi, b_lo, b_hi) -> tuple[np.ndarray, np.ndarray]:
    """Token positions after each shared end, in order, for intervals [lo, hi) of A and B tokens that end together.

    Ends increase over all intervals, so one bisection serves any of them.
    """
    cut_a, cut_b = [a_hi], [b_hi]
    reach = np.ones(len(a_lo), np.int64)
    while True:
        inner = (a_hi - a_lo > 1) & (b_hi - b_lo > 1)
        a_lo, a_hi, b_lo, b_hi, reach = (x[inner] for x in (a_lo, a_hi, b_lo, b_hi, reach))
        if not len(a_lo):
            break
        mid = (a_lo + a_hi - 2) // 2
        first, last = np.maximum(a_lo, mid - reach + 1), np.minimum(a_hi - 2, mid + reach - 1)
        n = last - first + 1
        start = np.cumsum(n) - n
        probe = np.arange(n.sum()) + np.repeat(first - start, n)
        at = np.searchsorted(b_end, a_end[probe])
        off = probe - np.repeat(mid, n)
        order = np.where(b_end[at] == a_end[probe], 2 * np.abs(off) + (off > 0), np.iinfo(np.int64).max)  # nearest, then left
        best = np.minimum.reduceat(order, start)
        found = best < np.iinfo(np.int64).max
        leaf = ~found & (first == a_lo) & (last == a_hi - 2)
        on = ~found & ~leaf
        i = mid[found] + np.where(best[found] % 2 == 1, best[found] // 2, -(best[found] // 2))
        j = np.searchsorted(b_end, a_end[i])
        cut_a.append(i + 1)
        cut_b.append(j + 1)
        one = np.ones(len(i), np.int64)
        a_lo, a_hi, b_lo, b_hi, reach = (
            np.concatenate(x) for x in (
                (a_lo[on], a_lo[found], i + 1), (a_hi[on], i + 1, a_hi[found]), (b_lo[on], b_lo[found], j + 1), (b_hi[on], j + 1, b_hi[found]),
                (2 * reach[on], one, one)))
    a, b = np.concatenate(cut_a), np.concatenate(cut_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] - 1 of every i, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def counted(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the rows (or the sum of ``weight``) of each."""
    if weight is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at], np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)


def byte_table(vocabulary: dict[str, int]) -> dict[int, bytes]:
    """Bytes of each entry of a byte-level vocabulary: printable bytes stand for themselves, the others for U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return {i: bytes(map(byte_of.__getitem__, piece)) for piece, i in vocabulary.items() if all(c in byte_of for c in piece)}


class Aligner:
    """Both tokenizers, and what is known of units seen before."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as f:
            own = json.load(f)
        kind = own["pre_tokenizer"] or {}
        if own["normalizer"] is not None or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex"):
            raise ValueError("A: a byte-level tokenizer with its usual pattern, without normaliser or added blank, is expected")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("B: a piece holds a blank after another character")
        self.a_bytes = byte_table(own["model"]["vocab"])
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)}
        self.blank = self.b.encode("! ")[len(self.b.encode("!")):]  # of a blank at the end of a text
        self.a_size, self.b_size = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_marked = [f"{i}{mark}" for mark in ",|" for i in range(len(self.a_size))]
        self.b_marked = [f"{i}{mark}" for mark in ",;\n" for i in range(len(self.b_size))]
        self.pair_base = len(self.a_size) * len(self.b_size)  # an id pair is one number, A id first
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []  # of each unit's groups
        self.bad: set[int] = set()  # units to whose bytes their tokens do not join
        self.uses = np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.first = np.zeros(1, np.int64)  # where a unit's pairs start
        self.pairs = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def thin_out(self, size: int) -> None:
        """Keep the ``size`` memoised units that were used most."""
        names = list(self.known)
        at = np.fromiter(self.known.values(), np.int64, len(names))
        best = np.argsort(-self.uses[at], kind="stable")[:size]
        at, names = at[best], [names[i] for i in best.tolist()]
        bad = {k for k, i in enumerate(at.tolist()) if i in self.bad}
        per = self.first[at + 1] - self.first[at]
        rows = ragged(self.first[at], per)
        text, uses, sizes, pairs, links = [self.text[i] for i in at.tolist()], self.uses[at], self.sizes[at], self.pairs[rows], self.links[rows]
        self.forget()
        self.known, self.text, self.bad = {u: k for k, u in enumerate(names)}, text, bad
        self.uses, self.sizes, self.first, self.pairs, self.links = uses // 2, sizes, np.append(0, np.cumsum(per)), pairs, links

    def _encode_a(self, units: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A ids of all units, one after the other, and how many each has.

        Units that end in white space are encoded alone; the others go in one
        string, as a unit is a text's part between two places that no token spans.
        """
        alone = np.fromiter((u[-1].isspace() for u in units), bool, len(units))
        order = np.argsort(alone, kind="stable")
        k = len(units) - int(alone.sum())
        found = self.a.encode_batch_fast(["".join([units[i] for i in order[j:min(j + 512, k)]]) for j in range(0, k, 512)] + [units[i] for i in order[k:]], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), np.int64)
        ends, bounds = np.cumsum(self.a_size[ids]), np.cumsum(size[order])
        after = np.searchsorted(ends, bounds)
        if len(ids) and (after[-1] >= len(ends) or (ends[after] != bounds).any()):
            raise ValueError("A: a token spans a blank that follows another character, or loses bytes")
        n = np.diff(after + 1, prepend=0)
        per = np.empty(len(units), np.int64)
        start = np.empty(len(units), np.int64)
        per[order], start[order] = n, np.cumsum(n) - n
        return ids[ragged(start, per)], per

    def learn(self, units: list[str]) -> None:
        """Tokens, groups and links of new units, each of which starts with a blank."""
        raw = [u.encode() for u in units]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        a, n_a = self._encode_a(units, size)
        b_ids = self.b.encode([u[1:] for u in units], num_threads=1)
        if " " in units:
            b_ids[units.index(" ")] = list(self.blank)
        n_b = np.fromiter(map(len, b_ids), np.int64, len(units))
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, n_b.sum())
        good = np.ones(len(units), bool)
        for ids, n, table, length in ((a, n_a, self.a_bytes, self.a_size), (b, n_b, self.b_bytes, self.b_size)):
            own = np.bincount(np.repeat(np.arange(len(raw)), n), length[ids], len(raw))
            if (own != size).any() or b"".join(map(table.__getitem__, ids.tolist())) != b"".join(raw):
                at = np.cumsum(n) - n
                good &= np.fromiter((b"".join(map(table.__getitem__, ids[i:i + k].tolist())) == x for i, k, x in zip(at, n, raw)), bool, len(raw))
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        a_hi, b_hi = np.cumsum(n_a)[good], np.cumsum(n_b)[good]
        cut_a, cut_b = shared_cuts(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), a_hi - n_a[good], a_hi, b_hi - n_b[good], b_hi)
        size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        group_a, group_b = np.repeat(np.arange(len(cut_a)), size_a), np.repeat(np.arange(len(cut_a)), size_b)
        owner = np.repeat(np.arange(len(units)), n_a)[cut_a - 1] if len(cut_a) else np.zeros(0, np.int64)
        self._write(units, good, a, b, cut_a, cut_b, size_a, size_b, owner)
        # equal ids of a group first, then their products
        base = len(self.b_size)
        ga, ca = counted(group_a * len(self.a_size) + a)
        gb, cb = counted(group_b * base + b)
        n = np.bincount(gb // base, minlength=len(cut_a))
        per = n[ga // len(self.a_size)]
        left = np.repeat(np.arange(len(ga)), per)
        right = ragged((np.cumsum(n) - n)[ga // len(self.a_size)], per)
        key = owner[ga[left] // len(self.a_size)] * self.pair_base + (ga[left] % len(self.a_size)) * base + gb[right] % base
        key, occ = counted(key, ca[left] * cb[right])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.bincount(key // self.pair_base, minlength=len(units))))
        self.pairs, self.links = np.append(self.pairs, key % self.pair_base), np.append(self.links, occ)
        whole = [np.bincount(owner, w, len(units)).astype(np.int64) for w in (np.ones(len(owner)), (size_a * size_b).astype(float))]
        self.sizes = np.vstack([self.sizes, np.column_stack([n_a, n_b, *whole])])

    def _write(self, units, good, a, b, cut_a, cut_b, size_a, size_b, owner) -> None:
        """The text of each unit's groups, all in one pass: A ids, then B ids of a group, each with the mark that follows it."""
        base, n, m = len(self.text), len(self.a_marked) // 2, len(self.b_marked) // 3
        at = cut_b - size_b  # B tokens before each group
        seat_a = np.arange(len(a)) + np.repeat(at, size_a)
        seat_b = np.arange(len(b)) + np.repeat(cut_a, size_b)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[cut_a - 1] = 1
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        mark_b[cut_b - 1] = 1 + last
        row = np.empty(len(a) + len(b), np.int64)
        row[seat_a] = a + mark_a * n
        row[seat_b] = b + mark_b * m + 2 * n
        lines = iter("".join(map((self.a_marked + self.b_marked).__getitem__, row.tolist())).split("\n"))
        self.text += [next(lines) if ok else "" for ok in good.tolist()]
        self.bad.update((base + np.flatnonzero(~good)).tolist())
        self.known |= {u: base + k for k, u in enumerate(units)}

    def block(self, texts: list[str]) -> list[list[int] | None]:
        """Unit numbers of each text (None: it has no tokens)."""
        if len(self.text) > MEMO:
            self.thin_out(MEMO // 2)
        lists = [UNITS.split(" " + t) if t else [] for t in texts]
        new = list({u for units in lists for u in units if u not in self.known})
        if new:
            self.learn(new)
        found = [list(map(self.known.__getitem__, units)) for units in lists]
        self.uses = np.append(self.uses, np.zeros(len(self.text) - len(self.uses), np.int64))
        for ids in found:
            np.add.at(self.uses, ids, 1)
        for u in new:
            if len(u) > MEMO_CHARS:
                del self.known[u]
        return [None if not ids or not self.bad.isdisjoint(ids) else ids for ids in found]


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per Python worker and pair of files."""
    return Aligner(a_path, b_path)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id and its groups of ids in order (none: an empty array)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for run in chunks(texts, BLOCK):
                out = []
                for ids in own.block([texts[i] for i in run]):
                    cut = [g.split("|") for i in ids or [] for g in own.text[i].split(";")]
                    out.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in cut])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[run.start:run.stop], pa.array(out, kind)], ["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, groups array<struct<a: array<int>, b: array<int>>>")


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a document, its links by pair number of its block; a row a block with its pairs and how many of its documents hold each."""
    id_kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for run in chunks(texts, BLOCK):
                found = own.block([texts[i] for i in run])
                n = np.fromiter((len(x or ()) for x in found), np.int64, len(found))
                unit = np.fromiter((i for x in found for i in x or ()), np.int64, n.sum())
                doc = np.repeat(np.arange(len(found)), n)
                totals = np.zeros((len(found), 4), np.int64)
                np.add.at(totals, doc, own.sizes[unit])
                key, times = counted(doc * len(own.text) + unit)
                doc, unit = np.divmod(key, max(1, len(own.text)))
                per = own.first[unit + 1] - own.first[unit]
                at = ragged(own.first[unit], per)
                key, occ = counted(np.repeat(doc, per) * own.pair_base + own.pairs[at], own.links[at] * np.repeat(times, per))
                doc, pair = np.divmod(key, own.pair_base)
                pairs, idx, holders = np.unique(pair, return_inverse=True, return_counts=True)
                digests = [hashlib.sha256(";".join([own.text[i] for i in x]).encode()).hexdigest() if x else "" for x in found]
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(found)))).astype(np.int32)
                rows = len(found)
                ids = batch.column("doc_id")[run.start:run.stop]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * rows, pa.int64()), pa.array([False] * rows), ids, *(pa.array(c) for c in totals.T), pa.array(digests, pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(occ)), pa.nulls(rows, pa.list_(pa.int64()))], names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([True]), pa.nulls(1, ids.type), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()),
                     pa.nulls(1, pa.list_(pa.int32())), pa.array([holders.astype(np.int64)], pa.list_(pa.int64())), pa.array([(pairs // len(own.b_size) << 32) | pairs % len(own.b_size)], pa.list_(pa.int64()))], names)
                number += 1

    names = ["block", "is_block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "idx", "n", "pairs"]
    return docs.select("doc_id", "text").mapInArrow(
        work, f"block long, is_block boolean, doc_id {id_kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, idx array<int>, n array<long>, pairs array<long>")


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: tokens, groups, links; links whose pair is its A id's most frequent (by documents), and the sum of the links' counts."""
    parts = stored(_blocks(docs, a_path, b_path))
    held = parts.where("is_block").select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("i", "x")).select("block", "i", F.col("x.pairs").alias("pair"), F.col("x.n").alias("n"))
    total = held.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("a", F.shiftright("pair", 32))
    best = total.groupBy("a").agg(F.max("total").alias("most"))
    total = total.join(best, "a").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = held.join(total, "pair").select(F.col("block").alias("of"), "i", "total", "best")
    out = "doc_id n_a n_b n_groups n_links groups_sha256".split()

    def add(rows: pa.Table, known: pa.Table) -> pa.Table:
        size = known.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = known.column("i").to_numpy()
        count[at], best[at] = known.column("total").to_numpy(), known.column("best").to_numpy()
        idx, n = rows.column("idx").combine_chunks(), rows.column("n").combine_chunks()
        each = np.diff(idx.offsets.to_numpy())
        doc, i, n = np.repeat(np.arange(rows.num_rows), each), idx.flatten().to_numpy(), n.flatten().to_numpy()
        sums = np.zeros((rows.num_rows, 2), np.int64)
        np.add.at(sums, doc, np.column_stack([n * best[i], n * count[i]]))
        return pa.table([rows.column(c) for c in out] + [pa.array(sums[:, 0]), pa.array(sums[:, 1])], [*out, "n_best", "count_sum"])

    docs = parts.where("NOT is_block").select("block", *out, "idx", "n")
    kind = dict(parts.dtypes)["doc_id"]
    return docs.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(
        add, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
