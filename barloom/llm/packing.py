"""Best-fit packing into bins of several permitted capacities.

Sequences are cut into pieces of at most the largest capacity. Pieces of one
length are alike, so the plan is made on the histogram of lengths, at most one
entry per length whatever the number of documents: lengths are placed from the
longest down, each into the open bins with the least room that fits, equal bins
together; what fits none opens bins of the capacity that costs least for the
tokens it may still take. At the end every bin shrinks to the smallest capacity
that holds its contents. The plan says, for each run of equal bins, which ranks
of a length go where.

Spark then numbers the pieces of a length: sorted into ranges of (length, doc_id,
piece), they are numbered inside each range, and a length that spans several ranges
goes on from the counts before. So a frequent length takes as many windows as its
rows fill ranges. Numbers are joined with the plan on length and rank block.

Cost of a bin: its capacity plus ``overhead`` tokens. A new bin's size is the one
with the least cost per token filled, where the fill is forecast from the shorter
pieces still to come.

Defined cases: sequences of length zero or null are not packed and have no row;
repeated rows are packed each; ties in length go by doc_id (null first), then by
piece, then by an arbitrary order of equal rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stored, words

#: Ranks in one block of the plan's join key.
STRIDE = 4096


def plan(histogram: dict[int, int], capacities: list[int], overhead: int = 16) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, count, first bin, offset, capacity).

    Ranks ``first rank`` to ``first rank + count - 1`` of a length go to the bins from
    ``first bin`` on, one each, at the same offset; ``capacity`` is the bins' final one.
    """
    capacities = sorted(capacities)
    largest = capacities[-1]
    # runs of equal bins: [first bin, count, capacity, contents], contents = ((length, first rank), ...)
    open_runs: dict[int, list] = defaultdict(list)  # by room left
    rooms: list[int] = []  # rooms with open runs, ascending
    done, next_bin = [], 0
    to_come = sum(n * c for n, c in histogram.items())

    def put(run: list, room: int) -> None:
        if room == 0:
            done.append((run, 0))
        else:
            if not open_runs[room]:
                bisect.insort(rooms, room)
            open_runs[room].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        to_come -= length * left
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count, capacity, contents = open_runs[room].pop()
                if not open_runs[room]:
                    rooms.pop(at)
                    del open_runs[room]
                # a bin that takes a piece is then the fullest that fits: it takes more while it can
                fit = min(room // length, left)
                take = min(left // fit, count)
                if take < count:
                    put([first + take, count - take, capacity, tuple((x, r + take) for x, r in contents)], room)
                put([first, take, capacity, contents + tuple((length, rank + i * take) for i in range(fit))], room - fit * length)
                take *= fit
            else:
                # tokens of shorter pieces that each new bin may count on
                share = to_come / left
                cost = {c: (c + overhead) / min(c, length * (c // length) + share) for c in capacities if c >= length}
                capacity = min(cost, key=lambda c: (cost[c], c))
                fit = min(capacity // length, left)
                take = left // fit
                contents = tuple((length, rank + i * take) for i in range(fit))
                put([next_bin, take, capacity, contents], capacity - fit * length)
                next_bin += take
                take *= fit
            left -= take
            rank += take
    for room, all_ in open_runs.items():
        done += [(run, room) for run in all_]
    rows = []
    for (first, count, capacity, contents), room in done:
        used = capacity - room
        final = capacities[bisect.bisect_left(capacities, used)]
        offset = 0
        for length, rank in contents:
            rows.append((length, rank, count, first, offset, final))
            offset += length
    assert largest >= max(histogram, default=0)
    return rows


def pack(sequences: DataFrame, capacities: list[int], overhead: int = 16) -> DataFrame:
    """doc_id, piece, start, length, bin, bin_offset and bin_capacity of every piece.

    ``sequences`` has doc_id and ``size``, the length of each sequence.
    """
    spark, largest = sequences.sparkSession, max(capacities)
    size = F.col("size").cast("long")
    sized = sequences.where(F.col("size") > 0).select("doc_id", size.alias("size"))
    pieces = sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / largest))).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest), F.col("size") - F.col("piece") * largest).cast("int").alias("length"))
    # stored first: ranges are sampled from it, and texts are not counted again
    held = stored(pieces.withColumn("order", F.monotonically_increasing_id()))
    ranges = held.repartitionByRange("length", "doc_id", "piece", "order").withColumn("range", F.spark_partition_id())
    own = Window.partitionBy("length", "range").orderBy("doc_id", "piece", "order")
    local = stored(ranges.withColumn("r", F.row_number().over(own) - 1).drop("order"))
    # at most one row for each length and range: bounded by capacity and partitions, not by documents
    counts = local.groupBy("length", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.createDataFrame(plan(histogram, capacities, overhead), "length int, rank0 long, count long, bin0 long, bin_offset int, bin_capacity int")
    ranked = local.join(offsets, ["length", "range"]).withColumn("rank", F.col("before") + F.col("r")).drop("before", "r", "range")
    blocks = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("rank0") / STRIDE), F.floor((F.col("rank0") + F.col("count") - 1) / STRIDE))))
    inside = (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("count"))
    return ranked.withColumn("block", F.floor(F.col("rank") / STRIDE)).join(blocks, ["length", "block"]).where(inside).select(
        "doc_id", "piece", "start", "length", (F.col("bin0") + F.col("rank") - F.col("rank0")).alias("bin"), "bin_offset", "bin_capacity")


def by_words(docs: DataFrame) -> DataFrame:
    """doc_id and the number of words as ``size``."""
    return docs.select("doc_id", F.size(words(F.col("text").cast("string"))).alias("size"))
