"""Encodings of categories and recipients."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from smsight.functions import scoring, vocab as V
from smsight.operators.ranks import exact_quantiles


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """A 0/1 column per known value; an unknown value is all zeros."""
    return df.withColumns({
        f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values
    })


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Integer codes in sorted order of the distinct values."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    # the rank runs over distinct values, a category list, not over rows
    codes = values.withColumn(out, F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(column)) - 1)
    return df.join(codes, column, "left")


def group_stats(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(target).alias("n_eng"), F.count("*").alias("n_obs"), F.avg(target).alias("rate"),
        F.stddev_samp(target).alias("rate_std"),
    )


def global_rate(stats: DataFrame) -> Column:
    """Overall mean as a scalar subquery over already grouped rows."""
    return stats.agg(F.sum("n_eng") / F.sum("n_obs").cast("double")).scalar()


def leave_one_out(total: Column, count: Column, own: Column, fallback: Column) -> Column:
    return F.when(count > 1, (total - own) / (count - 1).cast("double")).otherwise(fallback)


def loo_rate(df: DataFrame, key: str, target: str = "engaged", out: str = "loo_rate") -> DataFrame:
    """Mean of the other rows of the same key; the overall mean for a single row or a null key.

    Grouped first (partial sums) and joined back, so a recipient with a third of all rows is
    split by the skew-join handling instead of filling one window task.
    """
    stats = df.groupBy(key).agg(F.sum(target).alias("n_eng"), F.count("*").alias("n_obs"))
    return df.join(stats, key, "left").withColumn(
        out, leave_one_out(F.col("n_eng"), F.col("n_obs"), F.col(target), global_rate(stats)))


def target_encoding(
    df: DataFrame, keys: list[str], target: str = "engaged", reference_formula: bool = False,
) -> DataFrame:
    """Leave-one-out rate per key, as ``<key>_target_loo``.

    One pass groups by all keys together; the per-key sums come from that small table, so the
    rows are joined once.  ``reference_formula`` repeats the published formula, which adds the
    group sum once per row of the group.  A row whose key is null gets the overall mean for it.
    """
    cells = df.groupBy(*keys).agg(F.sum(target).alias("n_eng"), F.count("*").alias("n_obs"))
    fallback = global_rate(cells)
    sums = {}
    for key in keys:
        per_key = W.partitionBy(key)
        sums[f"_s_{key}"] = F.sum("n_eng").over(per_key)
        sums[f"_n_{key}"] = F.sum("n_obs").over(per_key)
    lookup = cells.withColumns(sums).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *sums)
    out = df.join(lookup, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), "left")
    for key in keys:
        total, count = F.col(f"_s_{key}"), F.col(f"_n_{key}")
        if reference_formula:
            total = total * count
        rate = leave_one_out(total, count, F.col(target), fallback)
        out = out.withColumn(f"{key}_target_loo", F.when(F.col(key).isNull(), fallback).otherwise(rate))
    return out.drop(*sums, *[f"_k_{k}" for k in keys])


def apply_rates(df: DataFrame, fitted: DataFrame, key: str, out: str, fallback: float) -> DataFrame:
    """Plain group rates fitted on other rows (``key, rate``); unseen keys get ``fallback``."""
    rates = fitted.select(key, F.col("rate").alias(out))
    return df.join(rates, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(fallback)))


def recipient_features(df: DataFrame, key: str = "msisdn", target: str = "engaged", type_code: str | None = None) -> DataFrame:
    """Rate, tier, volume and cold-start features of the recipient.

    A null recipient has the overall rate, no messages and is no cold start.
    """
    stats = df.groupBy(key).agg(F.sum(target).alias("n_eng"), F.count("*").alias("msisdn_sms_count"))
    mean = stats.agg(F.sum("n_eng") / F.sum("msisdn_sms_count").cast("double")).scalar()
    rate = F.col("msisdn_engagement_rate")
    out = df.join(stats, key, "left").withColumn(
        "msisdn_sms_count", F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.col("msisdn_sms_count")))
    out = out.withColumn("msisdn_engagement_rate", leave_one_out(
        F.col("n_eng"), F.col("msisdn_sms_count"), F.col(target), mean)).drop("n_eng")
    out = with_tier(out, "msisdn_engagement_rate", "msisdn_tier")
    return out.withColumns({
        "msisdn_rate_vs_global": rate - mean,
        "msisdn_cold_start": (F.col("msisdn_sms_count") == 1).cast("int"),
        "msisdn_sms_count_log": F.log1p("msisdn_sms_count"),
        "msisdn_rate_squared": rate * rate,
        "msisdn_rate_x_type": rate * (F.col(type_code) if type_code else F.lit(0)),
    })


def with_tier(df: DataFrame, rate: str, out: str, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Tier 0, 1 or 2 by the two quantiles; above the median when both are equal."""
    cuts = exact_quantiles(df, rate, [low, high, 0.5])
    cut = cuts.select(F.struct("q0", "q1", "q2")).scalar()  # one subquery for all three
    q33, q66, median = (cut.getField(f"q{i}") for i in range(3))
    value = F.col(rate)
    tier = F.when(value <= q33, 0).when(value <= q66, 1).otherwise(2)
    return df.withColumn(out, F.when(q33 == q66, (value > median).cast("int")).otherwise(tier))


def tier_engagement(df: DataFrame, tier: str = "msisdn_tier", target: str = "engaged") -> DataFrame:
    return df.groupBy(F.col(tier).alias("tier")).agg(
        F.count("*").alias("n"), (F.avg(target) * 100).alias("rate_pct"),
    ).withColumn("label", scoring.lookup(F.col("tier"), V.TIER_LABELS, "other"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def interactions(df: DataFrame, hour: str = "send_hour") -> DataFrame:
    """Products of text signals with the hour, the salary period and the recipient rate.

    Expects the text signals, hour flags, ``nlp_proba_max`` and ``campaign_type_enc``; without
    an hour column all products are 0.
    """
    names = [
        "sensitive_x_morning", "marketing_x_evening", "marketing_x_evening_strong",
        "transact_x_morning", "livraison_x_evening", "urgent_x_morning", "financial_x_salary",
        "urgent_x_hour", "otp_x_campaign_type", "proba_x_morning", "proba_x_evening",
        "marketing_x_msisdn",
    ]
    if hour not in df.columns:
        return df.withColumns({n: F.lit(0.0) for n in names})
    c = F.col
    morning, evening, proba = c("is_peak_morning"), c("is_peak_evening"), c("nlp_proba_max")
    recipient = c("msisdn_engagement_rate") if "msisdn_engagement_rate" in df.columns else F.lit(0.3)
    products = [
        c("is_sensitive") * morning, c("is_marketing") * evening, c("is_marketing") * evening * proba,
        c("is_transactional") * morning, c("is_livraison_kw") * evening, c("is_urgent_high") * morning,
        c("is_financial") * c("is_salary_period"), c("urgency_score") * (c(hour) / F.lit(23.0)),
        c("is_otp") * c("campaign_type_enc"), proba * morning, proba * evening,
        c("is_marketing") * evening * recipient,
    ]
    return df.withColumns({n: p.cast("double") for n, p in zip(names, products)})


def coarse_labels(df: DataFrame, label: str = "nlp_type_reel") -> DataFrame:
    """Coarse type, domain and fixed probability used when no trained classifier is at hand."""
    kind = scoring.lookup(F.col(label), V.COARSE_TYPE, V.COARSE_TYPE_DEFAULT)
    return df.withColumn("nlp_type", kind).withColumns({
        "nlp_domaine": scoring.lookup(F.col("nlp_type"), V.DOMAIN_OF_TYPE, V.DOMAIN_DEFAULT),
        "nlp_proba_max": F.lit(V.RULE_PROBABILITY),
    })


def messages_last_day(df: DataFrame, key: str = "msisdn", ts: str = "send_datetime", row_id: str = "sms_id") -> DataFrame:
    """``sms_last_24h``: earlier messages to the same recipient in the 24 hours before each one.

    Whole minutes are counted in a grouped table (one row per recipient and minute); only the
    first and last minute of the day are compared row by row, in groups of one recipient and
    one minute.  No task sees the history of a busy recipient.  Rows without recipient or time
    have no earlier messages.
    """
    day_minutes = 1440
    minute = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(60_000_000)).cast("long")
    offset = F.unix_micros(F.col(ts).cast("timestamp")) % F.lit(60_000_000)
    rows = df.withColumns({"_minute": minute, "_offset": offset})
    known = rows.where(F.col(key).isNotNull() & F.col("_minute").isNotNull())
    per_minute = known.groupBy(key, "_minute").agg(F.count("*").alias("_n"))
    whole = per_minute.withColumn("_whole", F.coalesce(
        F.sum("_n").over(W.partitionBy(key).orderBy("_minute").rangeBetween(-(day_minutes - 1), -1)), F.lit(0)))
    # a copy moved one day on stands for "sent a day before" inside the same minute
    copies = known.select(key, "_minute", "_offset", F.lit(0).alias("_past")).unionByName(
        known.select(key, (F.col("_minute") + day_minutes).alias("_minute"), "_offset", F.lit(1).alias("_past")))
    moments = copies.groupBy(key, "_minute", "_offset").agg(
        F.sum(1 - F.col("_past")).alias("_own"), F.sum("_past").alias("_old"))
    cell = W.partitionBy(key, "_minute").orderBy("_offset")
    edges = moments.withColumn(
        "_edge",
        F.coalesce(F.sum("_own").over(cell.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        + F.sum("_old").over(cell.rowsBetween(0, W.unboundedFollowing)),
    ).where(F.col("_own") > 0).select(key, "_minute", "_offset", "_edge")
    counts = edges.join(whole.select(key, "_minute", "_whole"), [key, "_minute"]).select(
        key, "_minute", "_offset", (F.col("_edge") + F.col("_whole")).alias("sms_last_24h"))
    out = rows.join(counts, [key, "_minute", "_offset"], "left").drop("_minute", "_offset")
    return out.withColumn("sms_last_24h", F.coalesce("sms_last_24h", F.lit(0)))
