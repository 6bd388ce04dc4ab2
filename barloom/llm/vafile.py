"""Exact top-k inner-product search with a vector-approximation file.

Vectors are integers (floor of a scaled component). A grid splits every
dimension's range into at most 256 cells; the approximation file holds one byte
a component. For a query, a cell gives a lower and an upper bound of the score.

1. Scan. Blocks of cells meet tiles of queries. A task goes from block to block and
   keeps each query's k best lower bounds so far; a candidate stays if its upper bound
   reaches the k-th of them. Those over all tasks then narrow the candidates again.
2. Read. Exact vectors are read in the order of upper bounds: first each query's
   best ``k``, which gives an exact k-th score, then every candidate whose upper
   bound still reaches it. After that no other vector can enter the result.

The scan shuffles cells (a byte a component) once per tile of queries, and tiles once per
part of the blocks; exact vectors are read by row number for candidates only. No join is
left to a broadcast: files of vectors are many times larger in memory than their size on
disk says, and would go through the driver. Queries are a stated set and meet
all rows in blocks. Of equal vectors in a block only k copies of each of the k + 1
smallest ids can enter any result, so only they go on: copies stay bounded.

Scores are exact: products are sums of integers in double precision while those
stay below 2**53, else in Python's integers; beyond the range of a long a score
is the nearest long.

Defined cases: rows whose id or vector is null, or whose vector holds null or a
non-finite component, take no part. Vectors of different lengths do not meet: each
length is ranked on its own. Repeated ids are rows of their own as candidates; a query's
own id is never its candidate. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stored

CELLS = 256
#: Rows of a block of cells, components of a tile of queries, and queries scored at once.
BLOCK = 4096
TILE = 1 << 19
SLICE = 512
EXACT = 2.0 ** 53
LONG = 2 ** 63
RESULT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(rows: DataFrame, vector_id: str, vector: str, scale: int) -> DataFrame:
    """id and v (array<double> holding integers) of the rows that take part."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    good = rows.where(F.col(vector_id).isNotNull() & F.col(vector).isNotNull()).where(F.forall(vector, finite))
    return good.select(F.col(vector_id).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def grid_of(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value and cell width of each dimension (two numbers a dimension reach the driver)."""
    ends = vectors.agg(*(f(F.get("v", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(width) for f in (F.min, F.max))).first()
    low = np.array([ends[f"min{i}"] for i in range(width)], float)
    high = np.array([ends[f"max{i}"] for i in range(width)], float)
    return low, np.maximum(1.0, np.ceil((high - low + 1) / CELLS))


def cells(vectors: DataFrame, low: np.ndarray, size: np.ndarray, k: int) -> DataFrame:
    """The approximation file: per block its ids and its cells (row-major bytes)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                ids, row, x = part.column("id").to_numpy(), part.column("row").to_numpy(), _matrix(part.column("v"), len(low))
                order = np.lexsort((row, ids))
                ids, row, x = ids[order], row[order], x[order]
                _, same = np.unique(x, axis=0, return_inverse=True)
                by = np.argsort(same.ravel(), kind="stable")
                vector, own = np.diff(same.ravel()[by], prepend=-1) != 0, ids[by]
                one = vector | np.concatenate([[True], own[1:] != own[:-1]])  # first of a vector and id
                number = np.cumsum(one)
                at = np.arange(len(by))
                copy = at - np.maximum.accumulate(np.where(one, at, 0))
                ordinal = number - number[np.maximum.accumulate(np.where(vector, at, 0))]
                keep = np.sort(by[(ordinal <= k) & (copy < k)])
                code = np.minimum((x[keep] - low) // size, CELLS - 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (ids[keep], row[keep], code)], ["ids", "rows", "cells"])

    return vectors.select("id", "row", "v").mapInArrow(work, "ids binary, rows binary, cells binary")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact for whole numbers."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return a @ b.T
    whole = lambda x: np.array([[int(y) for y in row] for row in x.tolist()], object).reshape(x.shape)
    return whole(a) @ whole(b).T


def _scan(dealt: DataFrame, low: np.ndarray, size: np.ndarray, k: int) -> DataFrame:
    """Candidates of blocks that follow their tile, with bounds: q, id, row, low, high."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # k best lower bounds of each query of the tile at hand
        qid = qv = None
        for batch in batches:
            for n in range(batch.num_rows):
                queries = batch.column("tile")[n].values
                if queries is not None:
                    qid, qv, best = queries.field("id").to_numpy(), _matrix(queries.field("v"), len(low)), {}
                    continue
                ids, row = (np.frombuffer(batch.column(c)[n].as_py(), np.int64) for c in ("ids", "rows"))
                corner = np.frombuffer(batch.column("cells")[n].as_py(), np.uint8).reshape(len(ids), -1) * size + low
                for first in range(0, len(qid), SLICE):
                    found = _meet(qid[first:first + SLICE], qv[first:first + SLICE], ids, corner, size, k, best)
                    if found:
                        q, own, lower, upper = (np.concatenate(x) for x in zip(*found))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, ids[own], row[own], lower, upper)], ["q", "id", "row", "low", "high"])

    return dealt.mapInArrow(work, "q long, id long, row long, low double, high double")


def _meet(qid: np.ndarray, qv: np.ndarray, ids: np.ndarray, corner: np.ndarray, size: np.ndarray, k: int, best: dict[int, np.ndarray]) -> list[tuple]:
    """What a block adds for each query: ids repeated, places in the block, bounds. ``best`` takes its lower bounds."""
    base = _dot(qv, corner)
    if base.dtype == object:
        slack_low = np.array([sum(int(w - 1) * min(int(x), 0) for w, x in zip(size, r)) for r in qv.tolist()], object)
        slack_high = np.array([sum(int(w - 1) * max(int(x), 0) for w, x in zip(size, r)) for r in qv.tolist()], object)
    else:
        slack_low, slack_high = np.minimum(qv, 0) @ (size - 1), np.maximum(qv, 0) @ (size - 1)
    out = []
    for i, q in enumerate(qid.tolist()):
        known = best.get(q, np.empty(0))
        # doubles next to an exact bound, outwards, so that rounding loses no candidate
        upper = np.nextafter((base[i] + slack_high[i]).astype(float), np.inf)
        own = np.flatnonzero((upper >= known[0] if len(known) == k else True) & (ids != q))
        lower = np.nextafter((base[i][own] + slack_low[i]).astype(float), -np.inf)
        bounds = np.concatenate([known, lower])
        if len(bounds) > k:
            bounds = np.partition(bounds, len(bounds) - k)[-k:]  # the least of them comes first
        elif len(bounds) == k:
            bounds.sort()
        best[q] = bounds
        if len(bounds) == k:
            use = upper[own] >= bounds[0]
            own, lower = own[use], lower[use]
        if len(own):
            out.append((np.full(len(own), q), own, lower, upper[own]))
    return out


def _scores(candidates: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact scores of candidate pairs, from the vectors read by row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                width = len(batch.column("v")[0])
                a, b = _matrix(batch.column("v"), width), _matrix(batch.column("w"), width)
                if (np.abs(a).max() * np.abs(b).max()) * width < EXACT:
                    score = (a * b).sum(axis=1).astype(np.int64)
                else:
                    exact = [sum(int(x) * int(y) for x, y in zip(r, s)) for r, s in zip(a.tolist(), b.tolist())]
                    score = np.array([max(-LONG, min(LONG - 1, x)) for x in exact], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("id"), batch.column("row"), pa.array(score)], ["q", "id", "row", "score"])

    pairs = candidates.select("q", "id", "row").join(vectors.select("row", "v").hint("merge"), "row").join(
        queries.select(F.col("id").alias("q"), F.col("v").alias("w")).hint("merge"), "q")
    return pairs.select("q", "id", "row", "v", "w").mapInArrow(work, "q long, id long, row long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int, vector_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """For each row of ``queries`` (distinct ids) its ``k`` rows of highest score: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    every = stored(integer_vectors(rows, vector_id, vector, scale).withColumn("row", F.monotonically_increasing_id()))
    widths = sorted(r.w for r in every.select(F.size("v").alias("w")).distinct().collect() if r.w)  # lengths, not rows
    out = spark.createDataFrame([], RESULT)
    for width in widths:
        asked = integer_vectors(queries, vector_id, vector, scale).where(F.size("v") == width).dropDuplicates(["id"])
        out = out.union(_top_k(every.where(F.size("v") == width), stored(asked), width, k))
    return out


def _top_k(every: DataFrame, asked: DataFrame, width: int, k: int) -> DataFrame:
    """``top_k`` among vectors of one length."""
    spark = every.sparkSession
    low, size = grid_of(every, width)
    index = stored(cells(every, low, size, k))
    blocks, n_queries = index.count(), asked.count()
    if not n_queries:
        return spark.createDataFrame([], RESULT)
    tiles = -(-n_queries * width // TILE)
    # tasks enough for all cores; more parts would only send the tiles more often
    parts = max(1, min(blocks, -(-8 * int(spark.conf.get("spark.sql.shuffle.partitions")) // tiles)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select(each(tiles).alias("t"), F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), "ids", "rows", "cells")
    right = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("t")).agg(F.collect_list(F.struct("id", "v")).alias("tile"))
    right = right.select("t", each(parts).alias("part"), "tile")
    # no join: a tile goes once to each part and is followed by the part's blocks
    dealt = right.unionByName(left, allowMissingColumns=True).repartition(max(2, parts * tiles), "t", "part")
    found = stored(_scan(dealt.sortWithinPartitions("t", "part", F.col("tile").isNull()).select("ids", "rows", "cells", "tile"), low, size, k))
    by_low = Window.partitionBy("q").orderBy(F.desc("low"))
    kth = found.withColumn("r", F.row_number().over(by_low)).where(F.col("r") <= k).groupBy("q").agg(F.min("low").alias("kth"), F.count("*").alias("n"))
    left_over = stored(found.join(kth.hint("merge"), "q").where((F.col("n") < k) | (F.col("high") >= F.col("kth"))).select("q", "id", "row", "high"))
    # first the k best upper bounds, then whatever can still reach the exact k-th score
    order = Window.partitionBy("q").orderBy(F.desc("high"), "id", "row")
    ranked = left_over.withColumn("r", F.row_number().over(order))
    first = stored(_scores(ranked.where(F.col("r") <= k), every, asked))
    sure = first.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    second = ranked.where(F.col("r") > k).join(sure.hint("merge"), "q").where((F.col("n") < k) | (F.col("high") >= F.col("least")))
    exact = first.union(_scores(second, every, asked))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
