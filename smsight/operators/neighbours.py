"""Exact nearest rows of a table with itself, by blocks of a tree whose boxes bound how far their rows can be.

The rows are numbered by their projection onto the direction of greatest variance. A tree, cut at medians of the column that
varies most, deals them into blocks of rows that are close in all columns. A row whose ``k`` nearest so far lie within ``r`` needs
no block whose smallest box is further than ``r``. Every block first looks at its own rows, then at the few nearest blocks that its
rows reach, then at all others that they still reach. The result doesn't depend on the tree, block size, partitions or batches:
distances are summed column by column, and equal ones are told apart by row number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsight.operators.ranks import bucketed_running_sums, top_per_group, with_buckets
from smsight.session import written

BLOCK_ROWS = 1024
SLACK = 1e-9  # of rounding, when distances are compared with bounds
SKETCH_ROWS = 1 << 15  # that the cuts of the tree are taken from; all rows are searched
FIRST_MET = 8  # nearest blocks that a block looks at before all the others in reach


def principal_direction(rows: DataFrame, features: list[str]) -> list[float]:
    """The unit vector along which the rows vary most; only sums of products leave the tasks."""
    n = len(features)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, square = 0, np.zeros(n), np.zeros((n, n))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)], axis=1) if n else np.zeros((batch.num_rows, 0))
            count, total, square = count + len(x), total + x.sum(0), square + x.T @ x
        if count:
            flat = np.concatenate([[count], total, square.ravel()])
            yield pa.record_batch({"at": pa.array(np.arange(len(flat))), "v": pa.array(flat)})

    sums = rows.select(*features).mapInArrow(products, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    if not sums:
        return [0.0] * n
    flat = np.array([r.v for r in sums])
    mean = flat[1:n + 1] / flat[0]
    covariance = flat[n + 1:].reshape(n, n) / flat[0] - np.outer(mean, mean)
    main = np.linalg.eigh(covariance)[1][:, -1]
    main = np.round(main * np.sign(main[np.argmax(np.abs(main))]), 6)  # sums of another order end in other digits
    length = float(np.sqrt((main ** 2).sum()))
    return [float(v / length) if length else 0.0 for v in main]


def numbered(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows with ``_along``, their projection, and ``_rank``, their number by it from 1."""
    along = F.lit(0.0)
    for name, weight in zip(features, principal_direction(rows, features)):
        along = along + F.col(name) * F.lit(weight)
    spread = with_buckets(rows.select(*features, F.lit(1).alias("_one")).withColumn("_along", along), "_along")
    return bucketed_running_sums(spread, [], [F.col("_along"), *[F.col(f) for f in features]], {"_rank": "_one"}).select("_rank", "_along", *features)


def _nearer(x: np.ndarray, y: np.ndarray, numbers: np.ndarray, same: bool, best: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of each row of ``x`` after looking at the rows of ``y``, which have ``numbers`` and may be the ``same`` rows."""
    k = best.shape[1]
    rough = (x ** 2).sum(1)[:, None] - 2 * x @ y.T + (y ** 2).sum(1)[None, :]
    margin = 1e-7 * ((x ** 2).sum(1)[:, None] + (y ** 2).sum(1).max(initial=0.0)) + 1e-12
    if same:
        np.fill_diagonal(rough, np.inf)
    limit = best[:, -1:] + margin
    if y.shape[0] > k:
        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1:k] + 2 * margin)
    i, j = np.nonzero((rough <= limit) & np.isfinite(rough))  # a screen; what passes is measured exactly
    exact = np.zeros(len(i))
    for f in range(x.shape[1]):
        exact += (x[i, f] - y[j, f]) ** 2
    rows = np.concatenate([np.repeat(np.arange(len(x)), k), i])
    distance = np.concatenate([best.ravel(), exact])
    number = np.concatenate([who.ravel(), numbers[j]])
    order = np.lexsort((number, distance, rows))
    rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = order[place < k]
    return distance[keep].reshape(-1, k), number[keep].reshape(-1, k)


def cuts_of(x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree over ``x`` with at most ``rows`` rows in a leaf, unless they are all equal: column, cut and first child of every
    inner node (its second one follows), column -1 and the rows of every leaf."""
    column, cut, child, held = [-1], [0.0], [0], [len(x)]
    waiting = [(0, np.arange(len(x)))]
    while waiting:
        node, at = waiting.pop()
        if len(at) <= rows:
            continue
        part = x[at]
        for f in np.argsort(-part.var(axis=0), kind="stable").tolist():
            low = part[:, f] <= np.median(part[:, f])
            if low.all():  # half of the rows or more have the greatest value
                low = part[:, f] < part[:, f].max()
            if low.any():
                break
        else:
            continue
        column[node], cut[node], child[node] = f, part[low, f].max(), len(column)
        for side in (low, ~low):
            waiting.append((len(column), at[side]))
            column, cut, child, held = [*column, -1], [*cut, 0.0], [*child, 0], [*held, int(side.sum())]
    return np.array(column), np.array(cut), np.array(child), np.array(held)


def leaf_of(x: np.ndarray, column: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    node = np.zeros(len(x), np.int64)
    inner = np.flatnonzero(column[node] >= 0)
    while len(inner):
        here = node[inner]
        node[inner] = child[here] + (x[inner, column[here]] > cut[here])
        inner = inner[column[node[inner]] >= 0]
    return node


def _bytes(values: np.ndarray) -> bytes:
    """Packed column by column, as most columns have few values."""
    return zlib.compress(np.ascontiguousarray(values.T).tobytes(), 1)


def _values(packed: bytes, rows: int, kind: type = np.float64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), kind).reshape(-1, rows).T)


STATE = "block long, rows int, numbers binary, x binary, best binary, who binary, least binary, most binary"
PAIRS = "block long, other long, gap double, near boolean"


def _row(block: int, numbers: np.ndarray, x: np.ndarray, best: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
    packed = {"numbers": _bytes(numbers[:, None]), "x": _bytes(x), "best": best.tobytes(), "who": who.tobytes(),
              "least": x.min(0).tobytes(), "most": x.max(0).tobytes()}
    return pa.record_batch({"block": pa.array([block], pa.int64()), "rows": pa.array([len(x)], pa.int32()),
                            **{name: pa.array([value], pa.binary()) for name, value in packed.items()}})


def _unpacked(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = row["rows"]
    return (_values(row["numbers"], n, np.int64)[:, 0], _values(row["x"], n), np.frombuffer(row["best"]).reshape(n, k),
            np.frombuffer(row["who"], np.int64).reshape(n, k))


def _in_reach(x: np.ndarray, best: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows may have one of their nearest inside of a box."""
    far = np.sqrt(best[:, -1]) * (1 + SLACK) + SLACK
    outside = np.maximum(np.maximum(least - x, x - most), 0.0)
    return (outside ** 2).sum(1) <= far ** 2


def nearest_blocks(ranked: DataFrame, features: list[str], k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The numbers (who) of the ``k`` nearest others of each row with the squared distances (best), in blocks of ``block_rows`` numbers.

    ``ranked`` is what :func:`numbered` gives; there have to be more than ``k`` rows. Row ``i`` of block ``b`` has the number
    ``b * block_rows + i + 1``.
    """
    width, spark = len(features), ranked.sparkSession
    count = ranked.count()
    step = -(-count // SKETCH_ROWS)
    sketch = ranked.where(F.col("_rank") % step == 0).select(*features).toArrow()
    columns = [sketch.column(i).to_numpy() for i in range(width)]
    tree = spark.sparkContext.broadcast(cuts_of(np.stack(columns, axis=1) if columns else np.zeros((0, 0)), max(1, block_rows // step)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, cut, child, held = tree.value
        pieces = np.maximum(1, -(-held * step // block_rows))  # of a leaf whose rows are all equal
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features], axis=1) if width else np.zeros((batch.num_rows, 0))
            leaf = leaf_of(x, column, cut, child)
            number = batch.column("_rank").to_numpy()
            block = leaf + number * 7919 % pieces[leaf] * len(column)
            yield pa.record_batch([pa.array(block, pa.int64()), *batch.columns], ["_block", *batch.schema.names])

    rows = ranked.select(F.col("_rank").cast("bigint").alias("_rank"), *features)
    dealt = rows.mapInArrow(deal, f"_block long, {', '.join(f'{name} {kind}' for name, kind in rows.dtypes)}").repartition("_block").sortWithinPartitions("_block", "_rank")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def made() -> Iterator[pa.RecordBatch]:
            numbers = np.concatenate([n for n, _ in held])
            x = np.concatenate([part for _, part in held])
            parts = -(-len(x) // (2 * block_rows))  # where the cuts fit badly
            for i in range(parts):
                own, mine = numbers[i::parts], np.ascontiguousarray(x[i::parts])
                best, who = _nearer(mine, mine, own, True, np.full((len(mine), k), np.inf), np.zeros((len(mine), k), np.int64))
                yield _row(int(own[0]), own, mine, best, who)  # its first number names a block

        for batch in batches:
            blocks, numbers = batch.column("_block").to_numpy(), batch.column("_rank").to_numpy()
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features], axis=1) if width else np.zeros((batch.num_rows, 0))
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and blocks[a] != block:
                    yield from made()
                    held = []
                block = int(blocks[a])
                held.append((numbers[a:b], x[a:b]))
        if held:
            yield from made()

    state = written(dealt.mapInArrow(pack, STATE), "blocks")
    boxes = state.select("block", "least", "most").orderBy("block").collect()
    names = np.array([b.block for b in boxes], np.int64)
    box = lambda field: np.array([np.frombuffer(b[field]) for b in boxes]).reshape(len(boxes), width)
    known = spark.sparkContext.broadcast((names, box("least"), box("most")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other blocks that a row reaches, the nearest boxes first."""
        names, least, most = known.value
        for batch in batches:
            for row in batch.to_pylist():
                x, best = _values(row["x"], row["rows"]), np.frombuffer(row["best"]).reshape(-1, k)
                low, high = x.min(0), x.max(0)
                gap = np.zeros(len(names))
                for f in range(width):
                    gap += np.maximum(np.maximum(least[:, f] - high[f], low[f] - most[:, f]), 0.0) ** 2
                reach = np.sqrt(best[:, -1].max()) * (1 + SLACK) + SLACK
                others = [int(i) for i in np.argsort(gap, kind="stable") if gap[i] <= reach ** 2 and names[i] != row["block"]]
                others = [i for i in others if _in_reach(x, best, least[i], most[i]).any()]
                yield pa.record_batch({"block": pa.array([row["block"]] * len(others), pa.int64()), "other": pa.array(names[others], pa.int64()),
                                       "gap": pa.array(gap[others], pa.float64()), "near": pa.array([True] * len(others), pa.bool_())})

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["other"] is None:  # the block itself comes before those that it meets
                    if here is not None:
                        yield _row(*here)
                    here = [row["block"], *_unpacked(row, k)]
                    continue
                needs = _in_reach(here[2], here[3], np.frombuffer(row["least"]), np.frombuffer(row["most"]))
                if needs.any():
                    best, who = here[3].copy(), here[4].copy()
                    best[needs], who[needs] = _nearer(here[2][needs], _values(row["x"], row["rows"]), _values(row["numbers"], row["rows"], np.int64)[:, 0], False, best[needs], who[needs])
                    here[3], here[4] = best, who
        if here is not None:
            yield _row(*here)

    fixed = state.select(F.col("block").alias("other"), "rows", "numbers", "x", "least", "most")
    empty = lambda c: F.lit(None).cast("binary").alias(c)
    met = None
    for first in (True, False):
        pairs = state.select("block", "rows", "x", "best").mapInArrow(meet, PAIRS)
        if first:
            pairs = top_per_group(pairs, ["block"], [F.col("gap"), F.col("other")], FIRST_MET).drop("rank")
        else:
            pairs = pairs.join(met, ["block", "other"], "left_anti")
        met = written(pairs, "meetings").select("block", "other", "gap")
        own = state.withColumns({"other": F.lit(None).cast("bigint"), "gap": F.lit(-1.0)})
        seen = met.join(fixed, "other").select("block", "rows", "numbers", "x", empty("best"), empty("who"), "least", "most", "other", "gap")
        both = own.unionByName(seen).repartition("block").sortWithinPartitions("block", "gap", "other")
        state = written(both.mapInArrow(widen, STATE), "blocks")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers = _values(row["numbers"], row["rows"], np.int64)[:, 0]
                found = np.concatenate([np.frombuffer(row[c], np.int64).reshape(-1, k) for c in ("best", "who")], axis=1)
                yield pa.record_batch({"number": pa.array(numbers), "found": pa.array([f.tobytes() for f in found], pa.binary())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def made() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2 * k)
            best, who = np.ascontiguousarray(both[:, :k]).tobytes(), np.ascontiguousarray(both[:, k:]).tobytes()
            return pa.record_batch({"block": pa.array([block], pa.int64()), "best": pa.array([best], pa.binary()), "who": pa.array([who], pa.binary())})

        for batch in batches:
            for at, found in zip(batch.column("block").to_pylist(), batch.column("found").to_pylist()):
                if held and at != block:
                    yield made()
                    held = []
                block = at
                held.append(found)
        if held:
            yield made()

    found = state.select("rows", "numbers", "best", "who").mapInArrow(unfold, "number long, found binary")
    numbered_blocks = found.withColumn("block", F.floor((F.col("number") - 1) / block_rows)).repartition("block").sortWithinPartitions("block", "number")
    return written(numbered_blocks.select("block", "found").mapInArrow(gather, "block long, best binary, who binary"), "nearest")


def nearest(ranked: DataFrame, features: list[str], k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(rank, place 1..k, other, distance) of every row's nearest others."""
    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                best, who = np.frombuffer(row["best"]).reshape(-1, k), np.frombuffer(row["who"], np.int64).reshape(-1, k)
                n = len(best)
                yield pa.record_batch({
                    "rank": pa.array(np.repeat(row["block"] * block_rows + 1 + np.arange(n), k)), "place": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    "other": pa.array(who.ravel()), "distance": pa.array(np.sqrt(best.ravel()))})

    return nearest_blocks(ranked, features, k, block_rows).mapInArrow(unfold, "rank long, place int, other long, distance double")
