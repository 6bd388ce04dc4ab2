"""Removal of long word sequences that repeat across documents.

The graph is a de Bruijn graph over words: every window of ``LENGTH`` words is an
edge between its first and its last ``LENGTH - 1`` words. Only edges that repeat
matter, and they come in long paths, so paths are matched first:

1. Anchors. An edge's anchor is the least hash of the ``SHINGLE``-word shingles
   inside it: equal edges have equal anchors, so an edge whose anchor occurs in
   one document only cannot repeat. That leaves few edges and loses none.
2. Paths. Consecutive edges of a document with one anchor compact into a path,
   named by a 128-bit digest of its words. A join on digests finds the smallest
   document that runs through the whole path; later ones repeat all its edges.
3. Edges. Where different paths meet in one anchor the graph branches: a path's
   first document may still share part of it with an earlier document. Only these
   first holders are taken apart into edges (96-bit digests), and a join finds
   each edge's first source.
4. Spans. Repeated edges and paths carry the coordinates of their source; those
   that run on at one distance from it compact into spans.

Counts and minima are combined before shuffles, and joins on hot paths or edges
can be split. Nothing is capped or sampled.

Defined cases: null and blank texts have no words; documents shorter than
``LENGTH`` words keep everything; rows without doc_id are neither cut nor a
source; repeated rows (same doc_id and text) are cut alike, as an equal doc_id is
no smaller one. Other columns pass through ``cut`` and are not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import release, scratch, stored

LENGTH = 50
SHINGLE = 8
#: Memoised word hashes per Python worker.
MEMO = 500_000
#: Bytes of an edge's digest.
EDGE = 12
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def anchors(words: list[bytes], length: int) -> np.ndarray:
    """The anchor of each window of ``length`` words."""
    n = len(words)
    if n < length:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    size = min(SHINGLE, length)
    x = np.zeros(n - size + 1, np.uint64)
    for i in range(size):  # an order-sensitive mix of the words' hashes
        x = (x * _MIX) ^ (x >> np.uint64(29))
        x += h[i:n - size + 1 + i]
    x *= _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    wide, done = length - size + 1, 1
    while 2 * done <= wide:  # minimum over growing spans
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (wide - done)], x[wide - done:]) if wide > done else x


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def _bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in the words joined by one blank."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return np.concatenate([[0], ends[:-1] + 1]), ends


def _path_digests(joined: bytes, a: np.ndarray, b: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> list[bytes]:
    """128-bit digest of the words of each path."""
    digest = xxhash.xxh3_128_digest
    return [digest(joined[i:j]) for i, j in zip(a[start].tolist(), b[start + size + length - 2].tolist())]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """d, k and the anchors m with 64 bits of their paths' digests, each once a document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = text.encode().split()
                m = anchors(words, length)
                if len(m):
                    start, size = runs(m)
                    paths = _path_digests(b" ".join(words), *_bounds(words), start, size, length)
                    both = np.stack([m[start].view(np.int64), np.frombuffer(b"".join(paths), np.int64)[::2]], axis=1)
                    found.append(np.unique(both, axis=0))
                    at.append(np.full(len(found[-1]), i))
            if found:
                both, at = np.concatenate(found), pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([batch.column("d").take(at), batch.column("k").take(at), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["d", "k", "m", "p"])

    return docs.mapInArrow(work, "d long, k long, m long, p long")


def _path_rows(docs: DataFrame, length: int) -> DataFrame:
    """Paths with a shared anchor (docs: d, k, text, shared); digests of the edges side by side where the anchor branches.

    later: an earlier document has the anchor.
    """
    types = {"d": pa.int64(), "k": pa.int64(), "s": pa.int32(), "n": pa.int32(), "path": pa.binary(), "later": pa.bool_(), "edges": pa.binary()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            out: list[tuple] = []
            for d, k, text, shared in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "text")), batch.column("shared")):
                words = text.encode().split()
                m = anchors(words, length)
                start, size = runs(m)
                known = {v: (x, y) for v, x, y in zip(*(shared.values.field(c).to_pylist() for c in ("m", "branches", "later")))}
                use = [i for i, v in enumerate(m[start].view(np.int64).tolist()) if v in known]
                joined, (a, b) = b" ".join(words), _bounds(words)
                start, size = start[use], size[use]
                for v, s, n, path in zip(m[start].view(np.int64).tolist(), start.tolist(), size.tolist(), _path_digests(joined, a, b, start, size, length)):
                    branches, later = known[v]
                    edges = b"".join([digest(joined[i:j])[:EDGE] for i, j in zip(a[s:s + n].tolist(), b[s + length - 1:s + length - 1 + n].tolist())]) if branches else None
                    out.append((d, k, s, n, path, later, edges))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types.values())], list(types))

    return docs.mapInArrow(work, "d long, k long, s int, n int, path binary, later boolean, edges binary")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans that a smaller doc_id holds too: d, k (doc_id and text hash), s and e (words), src and src_s.

    src is the smallest doc_id that holds the span's part and src_s a place in it.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), F.col("text").cast("string").alias("text"))
    with scratch(spark):
        with scratch(spark):
            marks = stored(_anchor_rows(rows, length))
            shared = marks.groupBy("m").agg(F.min("d").alias("a"), F.max("d").alias("b"), (F.min("p") < F.max("p")).alias("branches")).where("a < b")
            lists = stored(marks.select("m", "d", "k").join(shared.select("m", "a", "branches"), "m").groupBy("d", "k").agg(
                F.collect_set(F.struct("m", "branches", (F.col("d") > F.col("a")).alias("later"))).alias("shared")), result=True)
        release(spark)
        paths = stored(_path_rows(rows.join(lists, ["d", "k"]).select("d", "k", "text", "shared"), length), result=True)
    release(spark)
    first = stored(paths.groupBy("path").agg(F.min("d").alias("src"), F.min_by("s", "d").alias("src_s"), F.max("d").alias("last")))
    whole = paths.select("d", "k", "s", "n", "path").join(first.where("src < last").select("path", "src", "src_s"), "path").where(
        F.col("d") > F.col("src")).select("d", "k", "s", "n", "src", "src_s")
    # first holders of branching anchors, taken apart
    heads = stored(paths.where("edges IS NOT NULL").select("path", F.col("d").alias("src"), "k", "s", "n", "later", "edges").join(
        first.select("path", "src"), ["path", "src"]).select(F.col("src").alias("d"), "k", "s", "n", "later", "edges"))
    release(spark)
    apart = heads.select("d", "k", "s", "later", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substr("edges", i * EDGE + 1, F.lit(EDGE)))).alias("i", "edge")).withColumn("s", F.col("s") + F.col("i"))
    source = apart.groupBy("edge").agg(F.min("d").alias("src"), F.min_by("s", "d").alias("src_s"), F.max("d").alias("last")).where("src < last").drop("last")
    single = apart.where("later").select("edge", "d", "k", "s").join(source, "edge").where(F.col("d") > F.col("src")).select(
        "d", "k", "s", F.lit(1).alias("n"), "src", "src_s")
    return _spans(whole.union(single), length)


def _spans(pieces: DataFrame, length: int) -> DataFrame:
    """Compact pieces of one document that run on at one distance from one source."""
    lists = pieces.groupBy("d", "k", "src", (F.col("src_s") - F.col("s")).alias("off")).agg(F.array_sort(F.collect_set(F.struct("s", "n"))).alias("p"))
    joined = F.aggregate("p", F.array().cast("array<struct<s:int,e:int>>"), lambda a, x: F.when(
        (F.size(a) > 0) & (x["s"] <= F.get(a, F.size(a) - 1)["e"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["s"].alias("s"), F.greatest(F.get(a, F.size(a) - 1)["e"], x["s"] + x["n"]).alias("e")))),
    ).otherwise(F.concat(a, F.array(F.struct(x["s"].alias("s"), (x["s"] + x["n"]).alias("e"))))))
    return lists.select("d", "k", "src", "off", F.explode(joined).alias("x")).select(
        "d", "k", F.col("x.s").alias("s"), (F.col("x.e") + (length - 1)).alias("e"), "src", (F.col("x.s") + F.col("off")).alias("src_s"))


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """Rows of docs as struct ``row``, and their spans (null: none) as ``cuts``."""
    with scratch(docs.sparkSession):
        cuts = stored(repeated(docs, length).groupBy("d", "k").agg(F.collect_set(F.struct("s", "e")).alias("cuts")), result=True)
    release(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"))
    return rows.join(cuts, ["d", "k"], "left").select("row", "cuts")


def covered(n: int, cuts: list[dict] | None) -> np.ndarray:
    """Which of n words a span covers."""
    delta = np.zeros(n + 1, np.int32)
    for x in cuts if cuts is not None else ():
        delta[x["s"]] += 1
        delta[x["e"]] -= 1
    return np.cumsum(delta[:n]) > 0


def removal(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, words, words removed, digest of the kept words joined by one blank."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                words = (text or "").encode().split()
                n.append(len(words))
                if cuts:
                    out = covered(len(words), cuts)
                    gone.append(int(out.sum()))
                    words = [words[i] for i in np.flatnonzero(~out)]
                else:
                    gone.append(0)
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    both = _with_spans(docs.select("doc_id", "text"), length).select("row.doc_id", "row.text", "cuts")
    return both.mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")


def shorten(text: str, cuts: list[dict]) -> str:
    """The text without the words of the spans; what stays keeps its own blanks, with one blank where something went."""
    data = text.encode()
    words = data.split()
    keep = ~covered(len(words), cuts)
    parts, at, first, last = [], 0, None, 0
    for word, stays in zip(words, keep.tolist()):
        at = data.index(word, at)
        if stays:
            first = at if first is None else first
            last = at + len(word)
        elif first is not None:
            parts.append(data[first:last])
            first = None
        at += len(word)
    if first is not None:
        parts.append(data[first:last])
    return b" ".join(parts).decode()


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows with repeated words removed from ``text``; ``n_chars`` follows if there is one. Rows without a cut stay as they are."""
    both = _with_spans(docs, length)

    @F.pandas_udf("string")
    def new(text, cuts):
        return text.combine(cuts, lambda t, c: None if t is None else t if c is None else shorten(t, c))

    changed = F.when(F.col("cuts").isNotNull(), new(F.col("row.text"), F.col("cuts"))).otherwise(F.col("row.text"))
    both = both.select("row", "cuts", changed.alias("new"))
    out = []
    for name, kind in docs.dtypes:
        if name == "text":
            out.append(F.col("new").cast(kind).alias("text"))
        elif name == "n_chars":
            out.append(F.when(F.col("cuts").isNotNull(), F.length("new")).otherwise(F.col("row.n_chars")).cast(kind).alias("n_chars"))
        else:
            out.append(F.col("row")[name].alias(name))
    return both.select(*out)
