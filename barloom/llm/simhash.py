"""Near-duplicate groups by SimHash and a trie self-join.

Fingerprint: hash every word shingle to 64 bits; a bit of the fingerprint is set
if it is set in over half the hashes. Distinct fingerprints form a binary trie.
The self-join walks pairs of nodes downwards together, counts the bits in which
their paths differ and gives a pair up as soon as the budget is exceeded, so every
link within the budget is found and no other pair reaches a leaf.

On Spark the trie is cut at a depth where a subtree holds about ``BLOCK``
fingerprints (a crowded one is dealt over several parts). Pairs of subtrees whose
prefixes differ within the budget are tiles; a fingerprint goes once to each of its
tiles, and each tile is walked on its own with numpy. A task gives back a spanning forest of the links it found,
never all pairs of a group; the forests are merged by contraction on Spark.

``groups`` is one trie over 64 bits with a fixed budget. Four bits are little:
texts that share 0.8 of their shingles differ in about ten of 64. ``similar``
links by similarity instead: several fingerprints (lanes) with different seeds,
a trie self-join over the leading bits of each, and a link where the bits of
several lanes together agree as texts of that similarity do. The number of leading bits
and of lanes follow from the number of rows, so that chance meetings per row and
the share of links found stay the same at every size.

``exact`` takes such links, with a loose total, as candidates only: links are the
pairs whose sets of shingles reach the similarity, see there.

Defined cases: null and blank texts have no shingle and fingerprint zero, and
link like any other; a shorter text than a shingle is one shingle. Rows without
doc_id get their fingerprint and a null component and link nothing. Repeated
rows share a component. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import release, scratch, stored
from barloom.llm.components import components, forest, merge

SEED = 42
#: Fingerprints in a subtree row, about.
BLOCK = 1 << 16
#: A node pair of at most so many leaf pairs is compared leaf by leaf.
LEAVES = 64
#: Node pairs worked on at once; more wait on a stack.
FRONT = 1 << 16
#: Leaf pairs compared at once.
PAIRS = 1 << 16
#: Further lanes whose bits a candidate of ``exact`` is judged by.
CHECKED = 2
#: Shingles of a block of documents whose sets are compared with those of another, about.
SHINGLES = 1 << 18
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


def fingerprint(text: str, size: int, lanes: int = 1) -> np.ndarray:
    """One unsigned number a lane; lane i hashes with seed ``SEED + i``."""
    words = text.encode().lower().split()  # bytes: A-Z only, and blanks are \x20 and \x09 to \x0D
    n = len(words)
    if not n:
        return np.zeros(lanes, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(joined, SEED + i) for i in range(lanes)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:n - size] + 1])
    total, set_bits = n - size + 1, np.zeros((lanes, 64), np.int64)
    for i in range(0, total, SLICE):
        some = [joined[a:b] for a, b in zip(starts[i:i + SLICE].tolist(), ends[i + size - 1:i + size - 1 + SLICE].tolist())]
        for lane in range(lanes):
            raw = np.array([digest(x, SEED + lane) for x in some], np.dtype("<u8")).view(np.uint8).reshape(-1, 8)
            set_bits[lane] += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > total, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, size: int, lanes: int = 1) -> DataFrame:
    """doc_id and fp (an array of 64 bits a lane, as longs) of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py() or "", size, lanes) for t in batch.column("text")]
            flat = np.concatenate(fp).view(np.int64) if fp else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, lanes, np.int32)), pa.array(flat))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, fp array<long>")


def walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, budget: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) whose leading ``bits`` differ within the budget.

    a and b are sorted subtrees at ``depth``, the same one if ``same``.
    """
    if not len(a) or not len(b):
        return
    ones_a, ones_b = {}, {}

    def ones(x: np.ndarray, held: dict, d: int) -> np.ndarray:
        if d not in held:
            held[d] = np.concatenate([[0], np.cumsum((x >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        return held[d]

    used = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth))) if depth else 0
    one = np.ones(1, np.int64)
    stack = [(depth, 0 * one, len(a) * one, 0 * one, len(b) * one, used * one)]
    while stack:
        d, alo, ahi, blo, bhi, used = stack.pop()
        if len(alo) > FRONT:
            half = len(alo) // 2
            stack.append((d, alo[half:], ahi[half:], blo[half:], bhi[half:], used[half:]))
            alo, ahi, blo, bhi, used = alo[:half], ahi[:half], blo[:half], bhi[:half], used[:half]
            stack.append((d, alo, ahi, blo, bhi, used))
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAVES) | (d == bits)
        if small.any():
            yield from _leaves(a, b, same, alo[small], ahi[small], blo[small], bhi[small], budget, bits)
            big = ~small
            alo, ahi, blo, bhi, used = alo[big], ahi[big], blo[big], bhi[big], used[big]
        if not len(alo):
            continue
        ca, cb = ones(a, ones_a, d), ones(b, ones_b, d)
        amid, bmid = ahi - (ca[ahi] - ca[alo]), bhi - (cb[bhi] - cb[blo])
        own = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), bool)
        cross = used < budget
        parts = [(alo, amid, blo, bmid, used, None), (amid, ahi, bmid, bhi, used, None),
                 (alo, amid, bmid, bhi, used + 1, cross), (amid, ahi, blo, bmid, used + 1, cross & ~own)]
        out = []
        for x0, x1, y0, y1, u, ok in parts:
            keep = (x1 > x0) & (y1 > y0)
            if ok is not None:
                keep &= ok
            out.append((x0[keep], x1[keep], y0[keep], y1[keep], u[keep]))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*out))))


def _leaves(a, b, same, alo, ahi, blo, bhi, budget, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare all leaf pairs of small node pairs, ``PAIRS`` at a time, also inside one node pair (many rows can share the leading bits)."""
    wide = bhi - blo
    n = (ahi - alo) * wide
    ends = np.cumsum(n)
    for first in range(0, int(ends[-1]), PAIRS):
        last = min(first + PAIRS, int(ends[-1]))
        lo, hi = np.searchsorted(ends, [first, last - 1], "right")
        held = np.minimum(ends[lo:hi + 1], last) - np.maximum(ends[lo:hi + 1] - n[lo:hi + 1], first)
        pair = np.repeat(np.arange(lo, hi + 1), held)
        k = np.arange(first, last) - (ends - n)[pair]
        i, j = alo[pair] + k // wide[pair], blo[pair] + k % wide[pair]
        hit = np.bitwise_count((a[i] ^ b[j]) >> np.uint64(64 - bits)) <= budget
        if same:
            hit &= i != j
        if hit.any():
            yield i[hit], j[hit]


def links(distinct: DataFrame, n: int, lane: int, budget: int, bits: int = 64, checked: Sequence[int] = (), total: int = 64) -> DataFrame:
    """Spanning links (u, v) of doc_id between ``n`` distinct fingerprints (fp, d).

    Two link if the leading ``bits`` of ``lane`` differ in at most ``budget``
    and all bits of it and of the ``checked`` lanes in at most ``total``.

    A tile is a pair of subtrees, or of parts of crowded ones, and one task walks
    it. A row goes to each of its tiles once, with its numbers only.
    """
    cut = min(bits, max(0, int(np.ceil(np.log2(max(1, n / BLOCK))))))
    held = [lane, *checked]
    names = [f"f{i}" for i in range(len(held))]
    rows = distinct.select(*(F.get("fp", F.lit(x)).alias(c) for x, c in zip(held, names)), "d")
    rows = rows.withColumn("p", F.shiftrightunsigned("f0", 64 - cut) if cut else F.lit(0).cast("long"))
    sizes = rows.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    rows = rows.join(sizes, "p").withColumn("c", F.pmod(F.xxhash64(*names), F.col("chunks")).cast("int")).drop("chunks")
    masks = [m for m in range(1 << cut) if m.bit_count() <= budget]
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = sizes.select("p", parts("chunks").alias("c"))
    tiles = own.select("p", "c", F.explode(F.lit(masks).cast("array<long>")).alias("m")).select("p", "c", F.col("p").bitwiseXOR(F.col("m")).alias("q"))
    tiles = tiles.join(sizes.withColumnRenamed("p", "q"), "q").select("p", "c", "q", parts("chunks").alias("e"))
    # each unordered pair once; a tile of one part with itself has no second side
    tiles = tiles.where(F.struct("p", "c") <= F.struct(F.col("q").alias("p"), F.col("e").alias("c")))
    tile = ["p", "c", "q", "e"]
    left = rows.join(tiles, ["p", "c"]).select(*tile, *names, "d")
    second = rows.withColumnsRenamed({"p": "q", "c": "e"}).join(tiles.where("p < q OR c < e"), ["q", "e"]).select(*tile, *names, "d")
    second = second.toDF(*(f"{c}_" for c in second.columns))

    def work(some: pa.Table, other: pa.Table) -> pa.Table:
        (fa, da), (fb, db) = (_columns(x.select(range(len(tile), x.num_columns))) for x in (some, other))
        same = not len(db)
        if same:
            fb = fa
        # both sides share one numbering: b comes after a
        ids = np.concatenate([da, db])
        parent = np.arange(len(ids))
        for i, j in walk(fa[0], fb[0], same, cut, budget, bits):
            if checked:
                near = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int64) for x, y in zip(fa, fb)) <= total
                i, j = i[near], j[near]
            merge(parent, i, j if same else j + len(da))
        at = forest(parent)
        return pa.table({"u": ids[at], "v": ids[parent[at]]})

    return left.groupBy(*tile).cogroup(second.groupBy(*(f"{c}_" for c in tile))).applyInArrow(work, "u long, v long")


def _columns(x: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Fingerprints (unsigned, an array a lane) in the trie order of the first lane, with their doc_id, the last column."""
    *fp, d = (c.to_numpy() for c in x.columns)
    fp = [f.view(np.uint64) for f in fp]
    order = np.argsort(fp[0], kind="stable")
    return [f[order] for f in fp], d[order]


def _classes(marked: DataFrame, lanes: int, find) -> DataFrame:
    """Rows of ``marked`` (doc_id, fp) with component_id; ``find`` gives the links of distinct fingerprints and their number."""
    kind = dict(marked.dtypes)["doc_id"]
    named = marked.select("doc_id", *(F.get("fp", F.lit(i)).alias(f"f{i}") for i in range(lanes)))
    keys = [f"f{i}" for i in range(lanes)]
    one = named.where("doc_id IS NOT NULL").groupBy(*keys).agg(F.min(F.col("doc_id").cast("long")).alias("d"))
    distinct = stored(one.select(F.array(*keys).alias("fp"), "d"))
    with scratch(marked.sparkSession):
        found = stored(components(find(distinct, distinct.count())), result=True)
    classes = distinct.join(found, distinct.d == found.node, "left").select(
        *(F.get("fp", F.lit(i)).alias(f"f{i}") for i in range(lanes)), F.coalesce("label", "d").cast(kind).alias("component_id"))
    return named.join(classes, keys, "left").select(
        "doc_id", F.array(*keys).alias("fp"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def groups(docs: DataFrame, size: int = 4, budget: int = 4) -> DataFrame:
    """Per row: doc_id, fp and component_id, the smallest doc_id that links lead to."""
    return _classes(stored(fingerprints(docs, size)), 1, lambda distinct, n: links(distinct, n, 0, budget))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``groups`` with the fingerprint as 16 hexadecimal digits."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")


def differing_share(similarity: float) -> float:
    """Share of bits in which texts of a given Jaccard similarity differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def lane_plan(n: int, similarity: float, budget: int = 4, found: float = 0.97) -> tuple[int, int]:
    """Leading bits and lanes for ``n`` rows: chance meetings per row stay level, and ``found`` of the links are met."""
    bits = min(64, max(1, math.ceil(math.log2(max(2, n)))) + 10)
    p = differing_share(similarity)
    hit = sum(math.comb(bits, i) * p ** i * (1 - p) ** (bits - i) for i in range(budget + 1))
    return bits, max(1, math.ceil(math.log(1 - found) / math.log(1 - hit)))


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, margin: float = 0.06, budget: int = 4) -> DataFrame:
    """Per row: doc_id, fp (a number a lane) and component_id by links of ``similarity`` or more.

    Similarity is estimated from all lanes, with ``margin`` for the estimate's spread.
    """
    bits, lanes = lane_plan(docs.count(), similarity, budget)
    lanes = max(lanes, 4)  # 256 bits at least, for the estimate
    total = math.floor(64 * lanes * differing_share(similarity - margin))

    def find(distinct: DataFrame, n: int) -> DataFrame:
        found = []
        for lane in range(lanes):
            found.append(stored(links(distinct, n, lane, budget, bits, [x for x in range(lanes) if x != lane], total)))
            release(docs.sparkSession)
        return reduce(DataFrame.union, found)

    return _classes(stored(fingerprints(docs, size, lanes)), lanes, find)


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes."""
    words = text.encode().lower().split()
    n = max(1, len(words) - size + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), SEED) for i in range(n)), np.uint64, n))


def _digested(docs: DataFrame, size: int, lanes: int) -> DataFrame:
    """``fingerprints`` with a digest of the set of shingles after the lanes, so that equal rows have equal sets."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                fp += [fingerprint(text, size, lanes), np.array([xxhash.xxh64_intdigest(shingles(text, size).tobytes(), SEED)], np.uint64)]
            flat = np.concatenate(fp).view(np.int64) if fp else np.empty(0, np.int64)
            ends = pa.array(np.arange(0, len(flat) + 1, lanes + 1, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(flat))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, fp array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """node and s, the set of shingles, of every row of docs (node, text)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                sets = [shingles(t or "", size) for t in part.column("text").to_pylist()]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["node", "s"])

    return docs.select("node", "text").mapInArrow(work, "node long, s array<long>")


def _compared(some: pa.Table, all_: pa.Table, similarity: float) -> pa.Table:
    """Spanning links (u, v) of the labels in two blocks, by pairs of documents whose sets reach the similarity."""
    links: list[tuple[int, int]] = []
    if some.num_rows and all_.num_rows:
        sets, near = (t.column("s").combine_chunks() for t in (some, all_))
        sizes = np.diff(near.offsets.to_numpy())
        flat = near.flatten().to_numpy().view(np.uint64)
        order = np.argsort(flat, kind="stable")
        keys, owner = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        labels = all_.column("v").to_numpy()
        parent = {int(x): int(x) for x in np.concatenate([labels, some.column("v").to_numpy()])}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for row, own in enumerate(some.column("v").to_pylist()):
            x = sets[row].values.to_numpy().view(np.uint64)
            lo, hi = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
            n = hi - lo
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            both = np.bincount(owner[at], minlength=len(sizes))
            for other in np.unique(labels[(both > 0) & (both >= similarity * (len(x) + sizes - both) - 1e-9)]).tolist():
                a, b = root(own), root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((own, other))
    u, v = zip(*links) if links else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def verified(docs: DataFrame, loose: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (u, v) of exact Jaccard ``similarity`` or more among the documents that ``loose`` links (spanning ones) lead to.

    All pairs of a loose component count. First the loose links themselves are
    compared, which joins most of a group of true copies; then what is still
    outside the largest part of its component meets all the component's
    documents, block by block. So a component costs its size times what the
    first step left over, and no block depends on the component's size.
    """
    with scratch(docs.sparkSession):
        edges = stored(loose.distinct())
        inside = components(edges)
        kind = dict(docs.dtypes)["doc_id"]
        texts = docs.select("doc_id", "text").join(inside.select(F.col("node").cast(kind).alias("doc_id"), "node"), "doc_id")
        sets = stored(_sets(texts, size).withColumn("h", F.xxhash64("s")).dropDuplicates(["node", "h"]).drop("h"))
        release(docs.sparkSession)
        pairs = edges.join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u")
        both = F.size(F.array_intersect("a", "b"))
        near = stored(pairs.where(both >= similarity * (F.size("a") + F.size("b") - both) - 1e-9).select("u", "v").distinct())
        parts = components(near).select(F.col("node").alias("part_node"), F.col("label").alias("part"))
        members = stored(inside.join(parts, F.col("node") == F.col("part_node"), "left").select("node", "label", F.coalesce("part", "node").alias("v")))
        sized = stored(sets.join(members, "node").select("label", "v", "s"))
        split = sized.groupBy("label", "v").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("size")).groupBy("label").agg(
            F.max_by("v", F.struct("n", "v")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "v", "size")).alias("top"))
        # two documents have met already
        split = split.where("parts > 1 AND n > 2").select("label", "main", F.ceil(F.col("size") / SHINGLES).cast("int").alias("blocks"),
                                                          F.ceil((F.col("size") - F.col("top.size")) / SHINGLES).cast("int").alias("rest_blocks"))
        rows = sized.join(split, "label").withColumn("h", F.xxhash64("s"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
        block = lambda n: F.pmod("h", F.greatest(F.col(n), F.lit(1))).cast("int")
        some = rows.where("v <> main").select("label", block("rest_blocks").alias("i"), upto("blocks").alias("j"), "v", "s")
        all_ = rows.select("label", upto("rest_blocks").alias("i"), block("blocks").alias("j"), "v", "s").toDF("label_", "i_", "j_", "v", "s")
        more = some.groupBy("label", "i", "j").cogroup(all_.groupBy("label_", "i_", "j_")).applyInArrow(lambda a, b: _compared(a, b, similarity), "u long, v long")
        return stored(near.union(more), result=True)


def exact(docs: DataFrame, size: int = 5, similarity: float = 0.8, loose: float = 0.6, budget: int = 4, found: float = 0.99) -> DataFrame:
    """Per row: doc_id, fp (a number a lane and a digest) and component_id by links of exact Jaccard ``similarity`` or more.

    Candidates are met with probability ``found`` at that similarity, and are
    dropped unseen only where a lane and the ``CHECKED`` next ones together speak
    for less than ``loose``.
    """
    bits, lanes = lane_plan(docs.count(), similarity, budget, found)
    lanes = max(lanes, 4)
    total = math.floor(64 * (1 + CHECKED) * differing_share(loose))

    def find(distinct: DataFrame, n: int) -> DataFrame:
        met = []
        for lane in range(lanes):
            met.append(stored(links(distinct, n, lane, budget, bits, [(lane + 1 + i) % lanes for i in range(CHECKED)], total)))
            release(docs.sparkSession)
        return verified(docs, reduce(DataFrame.union, met), size, similarity)

    return _classes(stored(_digested(docs, size, lanes)), lanes + 1, find)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component of ``exact`` the one with the smallest doc_id.

    Rows that repeat a doc_id count as copies of one document: the one whose text
    has the smallest hash stays. Rows without doc_id stay.
    """
    with scratch(docs.sparkSession):
        keep = stored(exact(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), result=True)
    release(docs.sparkSession)
    own = Window.partitionBy("doc_id").orderBy("order")
    rows = docs.select("doc_id", F.xxhash64("text").alias("order"), F.struct(*docs.columns).alias("row"))
    first = rows.where("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi").withColumn("r", F.row_number().over(own)).where("r = 1")
    return first.select("row").union(rows.where("doc_id IS NULL").select("row")).select("row.*")
