"""Scores, rates, costs, labels and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from smsight.functions import vocab as V


def lookup(key: Column, table: dict, default=None) -> Column:
    """A short fixed table as a CASE expression (no join)."""
    out = None
    for k, v in table.items():
        value = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    if isinstance(default, Column):
        return out.otherwise(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def score_to_rate(score: Column) -> Column:
    """Linear map of a normalised score to a percentage, clamped."""
    (s0, s1), (r0, r1) = V.RATE_SCORE_RANGE, V.RATE_RANGE
    rate = F.lit(r0) + (score - F.lit(s0)) / F.lit(s1 - s0) * F.lit(r1 - r0)
    return F.least(F.lit(r1), F.greatest(F.lit(r0), rate))


def prediction_to_rate(score: Column) -> Column:
    """Scores up to 2 are scaled, larger ones are percentages already, missing is 65."""
    return (
        F.when(score.isNull(), F.lit(65.0))
        .when(score <= 2.0, F.least(F.lit(95.0), score * 75.0 + 20.0))
        .otherwise(score)
    )


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, the rounding of the timing responses."""
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def cost(recipients: Column, pages: Column, rate: str = V.COST_PER_PAGE) -> Column:
    price = F.lit(rate).cast("decimal(6,4)")
    return (price * (recipients * pages).cast("decimal(14,0)")).cast("decimal(18,4)")


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part * F.lit(100.0) / F.nullif(total, F.lit(0)))


def date_progress(status: Column, start: Column, end: Column, now: Column) -> Column:
    """Elapsed share of the campaign period in percent, clamped to 0..100."""
    s, e, n = (F.unix_micros(c.cast("timestamp")) for c in (start, end, now))
    share = F.floor((n - s) * F.lit(100.0) / F.nullif(e - s, F.lit(0)) + F.lit(0.5)).cast("int")
    return (
        F.when(status == "COMPLETED", F.lit(100))
        .when(start.isNull() | end.isNull(), F.lit(0))
        .when(n >= e, F.lit(100))
        .when(n <= s, F.lit(0))
        .otherwise(share)
    )


def request_key(campaign_type: Column, operator: Column, nlp_type: Column, domain: Column, message: Column) -> Column:
    """Equal keys mean the same request up to case and outer blanks of the message."""
    digest = F.hex(F.xxhash64(F.trim(F.lower(F.coalesce(message, F.lit(""))))))
    return F.concat_ws(":", campaign_type, operator, nlp_type, F.coalesce(domain, F.lit("default")), digest)


def context_key(campaign_type: Column, operator: Column, nlp_type: Column, weekday: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in (campaign_type, operator, nlp_type, weekday)]
    return F.concat_ws("_", *parts)


def hour_label(start: Column, end: Column) -> Column:
    return F.format_string("%02dh–%02dh", start, end)


def canonical_label(label: Column) -> Column:
    return lookup(label, V.TYPE_SYNONYMS, label)
