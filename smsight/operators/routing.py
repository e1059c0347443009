"""Routes and connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ANY_GROUP, ANY_HEADER = "ALL", "*"


def _anchored(pattern):
    return F.concat(F.lit("^(?:"), pattern, F.lit(")$"))


def match_routes(messages: DataFrame, routes: DataFrame) -> DataFrame:
    """The active route with the lowest priority per message, else the default route.

    A route matches on group, header and a full regex match of the destination.  Routes become
    one sorted list per (group, header), so messages are not multiplied; Spark broadcasts those
    lists if they are small and splits hot keys of a shuffle join if they are not.
    """
    active = routes.where("active")
    default = routes.where("is_default").agg(F.min_by("route_id", F.struct("priority", "route_id"))).scalar()
    lists = active.groupBy("group_id", "alpha_header").agg(
        F.array_sort(F.collect_list(F.struct("priority", "route_id", "destination_pattern"))).alias("_list"))
    own = [("group_id", "alpha_header"), ("group_id", None), (None, "alpha_header")]
    out, found = messages, []
    for i, (group, header) in enumerate(own):
        side = lists.select(F.col("group_id").alias("_g"), F.col("alpha_header").alias("_h"), F.col("_list").alias(f"_list{i}"))
        if group is None:
            side, key = side.where(F.col("_g") == ANY_GROUP), F.col("alpha_header") == F.col("_h")
        elif header is None:
            side, key = side.where(F.col("_h") == ANY_HEADER), F.col("group_id") == F.col("_g")
        else:
            key = (F.col("group_id") == F.col("_g")) & (F.col("alpha_header") == F.col("_h"))
        out = out.join(side, key, "left").drop("_g", "_h")
        found.append(F.col(f"_list{i}"))
    # one list applies to every message
    everyone = lists.where((F.col("group_id") == ANY_GROUP) & (F.col("alpha_header") == ANY_HEADER))
    out = out.withColumn("_all", everyone.select(F.struct("_list")).scalar().getField("_list"))
    empty = F.array().cast("array<struct<priority:int,route_id:string,destination_pattern:string>>")
    best = F.array_min(F.flatten(F.array(*[F.filter(
        F.coalesce(c, empty),
        lambda r: r.destination_pattern.isNull() | F.regexp_like(F.col("destination"), _anchored(r.destination_pattern)),
    ) for c in [*found, F.col("_all")]])))
    return out.withColumn("route_id", F.coalesce(best.route_id, default)).drop("_all", *[f"_list{i}" for i in range(len(own))])


def routes_by_priority(routes: DataFrame) -> DataFrame:
    return routes.orderBy("priority", "route_id")


def connector_downtime(probes: DataFrame, minutes: int = 5) -> DataFrame:
    """Minutes of unavailability after each probe.

    The first failed probe of a run counts 0, every further one adds ``minutes``.  Runs are
    found per connector and day; a day's first run continues the run that is open at the end
    of the day before, whose length comes from the per-day table.
    """
    day = F.to_date("probed_at")
    rows = probes.withColumns({"_day": day, "_down": (~F.col("available")).cast("int")})
    inside = W.partitionBy("connector_id", "_day").orderBy("probed_at", "probe_id")
    rows = rows.withColumn("_run", F.sum(F.col("available").cast("int")).over(inside))
    rows = rows.withColumn("_in_run", F.sum("_down").over(
        W.partitionBy("connector_id", "_day", "_run").orderBy("probed_at", "probe_id")))
    days = rows.groupBy("connector_id", "_day").agg(
        F.count("*").alias("_n"), F.sum("_down").alias("_down_n"),
        F.max_by("_in_run", F.struct("_run", "_in_run")).alias("_tail"))
    order = W.partitionBy("connector_id").orderBy("_day")
    days = days.withColumn("_block", F.sum(F.when(F.col("_n") > F.col("_down_n"), 1).otherwise(0)).over(
        order.rowsBetween(W.unboundedPreceding, 0)))
    block = W.partitionBy("connector_id", "_block").orderBy("_day")
    days = days.withColumn("_open", F.sum("_tail").over(block))
    days = days.withColumn("_carried", F.coalesce(F.lag("_open").over(order), F.lit(0)))
    joined = rows.join(days.select("connector_id", "_day", "_carried"), ["connector_id", "_day"])
    failures = F.col("_in_run") + F.when(F.col("_run") == 0, F.col("_carried")).otherwise(0)
    return joined.withColumn(
        "unavailable_minutes", F.when(F.col("available"), F.lit(None).cast("long")).otherwise((failures - 1) * minutes)
    ).drop("_day", "_down", "_run", "_in_run", "_carried")
