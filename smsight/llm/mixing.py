"""Mixing sources to target weights by Pfair scheduling of blocks.

Every source is a stream of blocks of ``block_rows`` documents in hash order; one slot of the mix takes one block. In the
fluid mix each source advances at its weight (the weights of unfinished sources sum to 1), and when one has given all its
blocks the weights of the others are scaled up. Block i of a source has the release time floor(f(i)) and the deadline
ceil(f(i + 1)), where f(i) is when the fluid mix has given i of its blocks: i / w until the first source ends. Each slot goes
to the released block with the earliest deadline. Then every source has had, at every slot of the mix, less than one block
more or less than in the fluid mix. All of that is exact: weights are the rational numbers that the floats stand for.

Every document is mixed in once. The driver goes through the schedule once and keeps, for each frame of slots, only which
sources are ahead of the whole blocks of the fluid mix; executors schedule the frames again from there and give documents
their places. Every source is a stream of its own, unless ``max_streams`` asks that all smaller ones share one.

Defined results: a null source counts as the empty string; identical rows take neighbouring places in any order; an empty
table gives an empty mix; a weight of zero or less is an error. Null ids and texts are mixed like any other. Columns with the
names of the results are replaced, others are untouched, whatever they are called.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 64
FRAME = 1024
BUCKET_ROWS = 1024
BROADCAST_STREAMS = 1 << 17  # some MB; beyond, rows and streams are joined by an exchange
REST = "\x00rest"


def quotas(weights: dict[str, float], frame: int) -> dict[str, int]:
    """Whole parts of a frame near the weights, at least one each (largest remainders; ties to the lesser name).

    For a mix that repeats; ``mix`` keeps exact weights.
    """
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights are positive")
    total = sum(weights.values())
    spare = frame - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    left = frame - sum(out.values())
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[:left]:
        out[s] += 1
    return out


class Fluid:
    """The fluid mix of streams with so many blocks, in whole numbers."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, float]):
        self.names = sorted(blocks)
        if any(weights[s] <= 0 for s in self.names):
            raise ValueError("weights are positive")
        exact = [Fraction(weights[s]) for s in self.names]
        scale = math.lcm(*(w.denominator for w in exact))
        self.parts = [int(w * scale) for w in exact]
        self.blocks = [blocks[s] for s in self.names]
        self.total = sum(self.blocks)
        # stream k ends when every part has given blocks / parts; then ``given`` blocks are of ended streams, ``active`` parts remain
        ends = sorted(zip(map(Fraction, self.blocks, self.parts), self.blocks, self.parts))
        self.ends, self.given, self.active = [e for e, _, _ in ends], [0], [sum(self.parts)]
        for _, n, part in ends:
            self.given.append(self.given[-1] + n)
            self.active.append(self.active[-1] - part)
        self.times = [g + a * e for g, a, e in zip(self.given, self.active, self.ends)]

    def window(self, k: int, i: int) -> tuple[int, int]:
        """Release time and deadline of block i of stream k."""
        part = self.parts[k]
        j = bisect_right(self.ends, Fraction(i, part)) if len(self.ends) > 1 else 0
        release = self.given[j] + self.active[j] * i // part
        if j < len(self.ends) and self.ends[j] * part < i + 1:
            j = bisect_right(self.ends, Fraction(i + 1, part))
        return release, self.given[j] - (-self.active[j] * (i + 1) // part)

    def whole(self, slot: int) -> list[int]:
        """Whole blocks that each stream has given before a slot."""
        j = bisect_right(self.times, slot)
        if j == len(self.times):
            return list(self.blocks)
        over, active = slot - self.given[j], self.active[j]
        return [min(n, part * over // active) for n, part in zip(self.blocks, self.parts)]


def schedule(fluid: Fluid, done: list[int], begin: int, end: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(stream, block, slot, release, deadline) of slots, earliest deadline first; counts in ``done`` what streams have given."""
    coming = [(*fluid.window(k, i), k) for k, i in enumerate(done) if i < fluid.blocks[k]]
    heapq.heapify(coming)
    ready: list[tuple[int, int, int]] = []
    for slot in range(begin, end):
        while coming and coming[0][0] <= slot:
            release, deadline, k = heapq.heappop(coming)
            heapq.heappush(ready, (deadline, k, release))
        deadline, k, release = heapq.heappop(ready)
        yield k, done[k], slot, release, deadline
        done[k] += 1
        if done[k] < fluid.blocks[k]:
            heapq.heappush(coming, (*fluid.window(k, done[k]), k))


def frame_order(parts: dict[str, int]) -> list[str]:
    """Which source each slot goes to, of streams with as many blocks as they weigh."""
    fluid = Fluid(parts, parts)
    return [fluid.names[k] for k, *_ in schedule(fluid, [0] * len(parts), 0, fluid.total)]


def frame_states(fluid: Fluid, size: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """For each frame its first slot and the streams ahead of their whole blocks; and the last slot of each stream."""
    done, states, last = [0] * len(fluid.names), [], [0] * len(fluid.names)
    for begin in range(0, fluid.total, size):
        states.append((begin, [k for k, (n, least) in enumerate(zip(done, fluid.whole(begin))) if n > least]))
        for k, _, slot, _, _ in schedule(fluid, done, begin, min(begin + size, fluid.total)):
            last[k] = slot
    return states, last


def one_frame(fluid: Fluid, size: int, begin: int, ahead: list[int]) -> list[tuple[int, int, int, int, int]]:
    """The schedule of a frame from its state."""
    done = fluid.whole(begin)
    for k in ahead:
        done[k] += 1
    return list(schedule(fluid, done, begin, min(begin + size, fluid.total)))


@dataclass
class Phase:
    """Blocks ``first``..``last`` - 1 of a stream, those of one frame: block first + i has slot begin + places[i]."""

    stream: str
    first: int
    last: int
    begin: int
    quota: int
    frame: int
    places: list[int]


def _blocks(rows: dict[str, int], block_rows: int) -> dict[str, int]:
    return {s: -(-n // block_rows) for s, n in rows.items() if n}


def plan(rows: dict[str, int], weights: dict[str, float], block_rows: int = BLOCK_ROWS, frame: int = FRAME) -> list[Phase]:
    """The whole schedule of streams with so many rows, frame by frame as the executors make it."""
    fluid, out = Fluid(_blocks(rows, block_rows), weights), []
    for begin, ahead in frame_states(fluid, frame)[0]:
        slots: dict[int, list[tuple[int, int]]] = {}
        for k, block, slot, _, _ in one_frame(fluid, frame, begin, ahead):
            slots.setdefault(k, []).append((block, slot - begin))
        out += [Phase(fluid.names[k], x[0][0], x[-1][0] + 1, begin, len(x), frame, [place for _, place in x]) for k, x in slots.items()]
    return out


def slot_table(spark: SparkSession, rows: dict[str, int], weights: dict[str, float], block_rows: int, frame: int) -> DataFrame:
    """(stream_, block, slot, release, deadline, missing): one row for each block; ``missing`` rows earlier blocks lack."""
    fluid = Fluid(_blocks(rows, block_rows), weights)
    size = max(frame, 4 * len(fluid.names))  # the state of a frame is less than its slots at any number of streams
    states, last = frame_states(fluid, size)
    short = sorted((slot, n * block_rows - rows[s]) for s, n, slot in zip(fluid.names, fluid.blocks, last))
    lacks = [0]
    for _, n in short:
        lacks.append(lacks[-1] + n)
    ends = [slot for slot, _ in short]
    sent = spark.sparkContext.broadcast((fluid, ends, lacks))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fluid, ends, lacks = sent.value
        for batch in batches:
            for begin, ahead in zip(batch.column("begin").to_pylist(), batch.column("ahead").to_pylist()):
                k, block, slot, release, deadline = zip(*one_frame(fluid, size, begin, ahead))
                missing = [lacks[bisect_right(ends, t - 1)] for t in slot]
                yield pa.record_batch({"stream_": pa.array([fluid.names[x] for x in k], pa.string())} | {
                    c: pa.array(x, pa.int64()) for c, x in
                    zip(("block", "slot", "release", "deadline", "missing"), (block, slot, release, deadline, missing))})

    frames = spark.createDataFrame(states, "begin bigint, ahead array<int>")
    return frames.mapInArrow(work, "stream_ string, block bigint, slot bigint, release bigint, deadline bigint, missing bigint")


def _bucket(bits: Column) -> Column:
    """The highest bits of a row's hash: buckets in hash order."""
    return F.floor((F.shiftright("hash_", 32) + (1 << 31)) / F.pow(F.lit(2.0), 32 - bits)).cast("bigint")


def mix(documents: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5,
        key_cols: tuple[str, ...] = ("doc_id",), block_rows: int = BLOCK_ROWS, frame: int = FRAME,
        max_streams: int | None = None) -> DataFrame:
    """The documents with ``block`` (number inside the source), ``slot``, ``release``, ``deadline`` and ``position``.

    A source weighs what ``weights`` says, else its share of rows to the power ``temperature``. Ordered by ``position``,
    0 to the number of rows - 1, the rows are the mix.
    """
    added = ("block", "slot", "release", "deadline", "position")
    own = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in added]
    spark = documents.sparkSession
    name = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    counted = documents.groupBy(name.alias("stream_")).agg(F.count(F.lit(1)).alias("n"))
    rows = top = {r["stream_"]: r["n"] for r in (counted.orderBy(F.desc("n"), "stream_").limit(max_streams) if max_streams else counted).collect()}
    total = sum(top.values())
    if max_streams:
        total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
        if total > sum(top.values()):
            rows = top | {REST: total - sum(top.values())}
    given = weights or {}
    share = {s: given.get(s, (n / total) ** temperature) for s, n in rows.items()}
    slots = slot_table(spark, rows, share, block_rows, frame)
    bits = spark.createDataFrame(
        [(s, max(0, math.ceil(math.log2(n / BUCKET_ROWS)))) for s, n in rows.items()], "stream_ string, bits_ int")

    stream = F.col("stream_") if REST not in rows else F.when(F.col("stream_").isin(list(top)), F.col("stream_")).otherwise(F.lit(REST))
    # a document's columns travel as one, so that no working column has the name of one of them
    keys = [F.col(f"`{c}`") for c in key_cols]
    placed = documents.select(F.struct(*own).alias("row_"), F.struct(*keys).alias("key_"), name.alias("stream_"), F.xxhash64(*keys).alias("hash_"))
    # one row for each source, broadcast where they are few enough
    bits = F.broadcast(bits) if len(rows) <= BROADCAST_STREAMS else bits
    placed = placed.withColumn("stream_", stream).join(bits, "stream_").withColumn("bucket_", _bucket(F.col("bits_"))).drop("bits_")
    sizes = placed.groupBy("stream_", "bucket_").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("stream_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("stream_", "bucket_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_"), "n")
    parts = offsets.withColumn("block", F.explode(F.expr(f"sequence(before_ div {block_rows}, (before_ + n - 1) div {block_rows})")))
    place = F.struct("before_", "block", "slot", "release", "deadline", "missing")
    parts = parts.join(slots, ["stream_", "block"]).select("stream_", "bucket_", place.alias("place_"))
    # the blocks of a bucket travel with its rows, so texts are exchanged once and no row carries a list
    both = placed.unionByName(parts, allowMissingColumns=True)
    inside = Window.partitionBy("stream_", "bucket_")
    ranked = both.withColumn("rank_", F.row_number().over(inside.orderBy(F.col("place_").isNotNull(), "hash_", "key_")) - 1)
    begins = F.greatest(F.col("place_.block") * block_rows - F.col("place_.before_"), F.lit(0))
    ranked = ranked.withColumn("is_row_", F.col("place_").isNull()).withColumn("rank_", F.when(F.col("is_row_"), F.col("rank_")).otherwise(begins))
    timed = ranked.withColumn("place_", F.last("place_", ignorenulls=True).over(inside.orderBy("rank_", "is_row_"))).where("is_row_")
    position = F.col("place_.slot") * block_rows + F.col("place_.before_") + F.col("rank_") - F.col("place_.block") * block_rows - F.col("place_.missing")
    return timed.select("row_.*", *(F.col(f"place_.{c}").alias(c) for c in added[:-1]), position.cast("bigint").alias("position"))
