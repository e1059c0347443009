"""Running totals, ranks, quantiles, folds and pages that no single task has to hold.

A window ordered over a whole table, or over a key that owns a third of it, runs in one task.
Here the order is first cut into buckets; the totals of the buckets (a few hundred rows per
group) give every bucket its offset, and the ordered window runs inside a bucket only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_SKETCH_SIZE = 32768  # ranks are right to about 0.02 % of the rows


def with_buckets(df: DataFrame, column: str, buckets: int = 256, bucket_rows: int = 1 << 16) -> DataFrame:
    """Add ``_bucket``, monotone in ``column``, with about equally many rows per value.

    There are at least ``buckets`` and so many that one has about ``bucket_rows`` rows, at most 2^16. One job makes
    a quantile sketch and the row count; only those (a few hundred KB) reach the driver.
    """
    df = df.withColumn("_key", F.col(column).cast("double"))
    known = F.when(~F.isnan("_key"), F.col("_key"))
    size = F.lit(_SKETCH_SIZE)
    summary = df.agg(F.count(known).alias("n"), F.kll_sketch_agg_double(known, size).alias("sketch")).first()
    cuts: list[float] = []
    if summary["n"]:
        buckets = min(max(buckets, -(-summary["n"] // bucket_rows)), 1 << 16)
        ranks = F.lit([i / buckets for i in range(1, buckets)])
        at = df.sparkSession.range(1).select(F.kll_sketch_get_quantile_double(F.lit(bytes(summary["sketch"])), ranks).alias("at")).first()["at"]
        cuts = sorted({x for x in at if abs(x) != float("inf")})
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    out = Bucketizer(splits=splits, inputCol="_key", outputCol="_b", handleInvalid="keep").transform(df)
    return out.withColumn("_bucket", F.col("_b").cast("int")).drop("_b", "_key")


def bucketed_running_sums(
    df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, str], descending: bool = False,
) -> DataFrame:
    """Inclusive running sums in ``order`` over a table that already has ``_bucket``.

    ``sums`` maps a new column to the column it accumulates; ``order`` must be unique inside a
    group and agree with ``_bucket`` (descending order runs the buckets backwards).
    """
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = W.partitionBy(*groups, F.lit(0)).orderBy(bucket_order).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    offsets = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in [*groups, "_bucket"]],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = W.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in [*groups, "_bucket"]])  # null is a group like any other
    out = df.join(offsets, same)
    return out.withColumns(
        {n: F.col(f"_o_{n}") + F.sum(c).over(inside) for n, c in sums.items()}
    ).drop(*[f"_o_{n}" for n in sums], *[f"_g_{g}" for g in [*groups, "_bucket"]])


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], buckets: int = 256) -> DataFrame:
    """One row with linearly interpolated quantiles ``q0, q1, ..`` (no sampling, no single sort task)."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    running = bucketed_running_sums(
        with_buckets(values, "_value", buckets), [], [F.col("_value")], {"_upto": "_n"})
    rows = values.agg(F.sum("_n")).scalar()
    at = lambda index: F.min(F.when(F.col("_upto") > index, F.col("_value")))
    out = []
    for i, p in enumerate(probabilities):
        position = F.lit(p) * (F.col("_rows") - 1)
        low, high = at(F.floor(position)), at(F.ceil(position))
        share = F.first(position - F.floor(position))
        out.append((low + (high - low) * share).alias(f"q{i}"))
    return running.withColumn("_rows", rows).agg(*out)


def stratified_folds(df: DataFrame, label: str, row_id: str, folds: int, seed: int = 42) -> DataFrame:
    """Assign ``fold`` so that every class is spread evenly.

    Rows are ranked per class by a hash; the leading hash digits are the buckets, so even a
    two-class table is ranked by 4096 tasks.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed)))))
    hashed = hashed.withColumns({"_bucket": F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"), "_one": F.lit(1)})
    ranked = bucketed_running_sums(hashed, [label], [F.col("_hash"), F.col(row_id)], {"_rank": "_one"})
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_hash", "_bucket", "_one", "_rank")


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group; Spark keeps ``k`` rows per group before the shuffle."""
    window = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered table (pages count from 0)."""
    return df.orderBy(*order).offset(number * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total_rows")).withColumn(
        "total_pages", F.ceil(F.col("total_rows") / F.lit(size)).cast("long"))
