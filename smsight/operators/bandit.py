"""Send-hour bandit: replay of feedback, drift, hour choice, decision log.

A feedback event turns a parameter ``x`` into ``max(1, d * x) + e``.  Chains of such steps
compose to ``max(c, m * x + b)``, and composition is associative, so the ordered history of a
context can be folded in pieces: every piece of a range-partitioned, sorted table yields one
``(c, m, b)`` and the pieces are chained.  A context with a third of all events is spread over
many tasks, and no history is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from smsight.functions import vocab as V

KEYS = ["context_key", "hour"]
PIECE_SCHEMA = (
    "context_key string, hour int, first_at long, first_id long, n long, "
    "ca double, cb double, m double, ba double, bb double"
)


def _compose(hits: np.ndarray, decay: float) -> tuple[float, float, float]:
    """Chain the steps of one sorted run: ``x -> max(c, m * x + b)``."""
    n = len(hits)
    weights = decay ** np.arange(n - 1, -1, -1, dtype=float)
    # value left at the end if the floor of 1 was applied last at step i
    tails = np.cumsum((weights * hits)[::-1])[::-1]
    return float((weights + tails).max()), float(decay ** n), float(tails[0])


def _chain(a: tuple, b: tuple) -> tuple:
    """First ``a``, then ``b``."""
    (c1, m1, b1), (c2, m2, b2) = a, b
    return max(c2, m2 * c1 + b2), m1 * m2, m2 * b1 + b2


def _fold_partition(decay: float):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for key, run in batch.groupby(KEYS, sort=False):
                hits = run["engaged"].to_numpy(dtype=float)
                alpha, beta = _compose(hits, decay), _compose(1.0 - hits, decay)
                if key == open_key:
                    state = state[:2] + (state[2] + len(run), _chain(state[3], alpha), _chain(state[4], beta))
                    continue
                if open_key is not None:
                    done.append((*open_key, *state[:3], state[3][0], state[4][0], state[3][1], state[3][2], state[4][2]))
                open_key = key
                state = (int(run["at"].iloc[0]), int(run["id"].iloc[0]), len(run), alpha, beta)
            if done:
                yield pd.DataFrame(done, columns=_PIECE_COLUMNS)
                done = []
        if open_key is not None:
            done.append((*open_key, *state[:3], state[3][0], state[4][0], state[3][1], state[3][2], state[4][2]))
            yield pd.DataFrame(done, columns=_PIECE_COLUMNS)

    return fold


_PIECE_COLUMNS = ["context_key", "hour", "first_at", "first_id", "n", "ca", "cb", "m", "ba", "bb"]


def history_pieces(feedback: DataFrame, decay: float = V.BANDIT_DECAY, partitions: int | None = None) -> DataFrame:
    """Fold the feedback of each range partition to one piece per context and hour.

    ``feedback`` has ``context_key, hour, at (timestamp), id (unique), engaged``.  The range
    partitioning includes time and id, so a busy context is cut into several pieces.
    """
    rows = feedback.select(
        "context_key", F.col("hour").cast("int").alias("hour"),
        F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"),
        F.col("engaged").cast("int").alias("engaged"))
    order = ["context_key", "hour", "at", "id"]
    spread = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order).mapInPandas(_fold_partition(decay), PIECE_SCHEMA)


def chain_pieces(pieces: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """``alpha`` and ``beta`` per context and hour after all pieces, in order.

    A context has at most one piece per range partition.  ``state`` holds the parameters
    before the first piece; without it they start at 1.
    """
    entry = F.struct("first_at", "first_id", "ca", "cb", "m", "ba", "bb", "n")
    lists = pieces.groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).alias("_pieces"))
    if state is None:
        lists = lists.withColumns({"_a": F.lit(1.0), "_b": F.lit(1.0), "_u": F.lit(0).cast("long")})
    else:
        before = state.select(
            *KEYS, F.col("alpha").alias("_a"), F.col("beta").alias("_b"), F.col("n_updates").alias("_u"))
        lists = lists.join(before, KEYS, "full").withColumns({
            "_a": F.coalesce("_a", F.lit(1.0)), "_b": F.coalesce("_b", F.lit(1.0)), "_u": F.coalesce("_u", F.lit(0))})
    empty = F.array().cast(
        "array<struct<first_at:bigint,first_id:bigint,ca:double,cb:double,m:double,ba:double,bb:double,n:bigint>>")
    steps = F.coalesce("_pieces", empty)
    apply = lambda c, b: F.aggregate(
        steps, F.col("_a" if c == "ca" else "_b"), lambda x, p: F.greatest(p[c], p["m"] * x + p[b]))
    return lists.select(
        *KEYS, apply("ca", "ba").alias("alpha"), apply("cb", "bb").alias("beta"),
        (F.col("_u") + F.aggregate(steps, F.lit(0).cast("long"), lambda x, p: x + p["n"])).alias("n_updates"))


def replay_bandit(feedback: DataFrame, state: DataFrame | None = None, decay: float = V.BANDIT_DECAY, partitions: int | None = None) -> DataFrame:
    """Bandit parameters after the feedback, oldest first (ties by id)."""
    return chain_pieces(history_pieces(feedback, decay, partitions), state)


def detect_drift(decisions: DataFrame, now: Column) -> DataFrame:
    """Contexts whose rate of the last 7 days fell below 80 % of the rest of the last 30 days."""
    labelled = decisions.where(
        F.col("engaged").isNotNull() & (F.col("decided_at") >= now - F.expr("INTERVAL 30 DAYS")))
    recent = F.col("decided_at") > now - F.expr("INTERVAL 7 DAYS")
    hit = F.col("engaged").cast("int")
    rates = labelled.groupBy("context_key").agg(
        F.count("*").alias("n"), F.avg(F.when(recent, hit)).alias("recent_rate"),
        F.avg(F.when(~recent, hit)).alias("older_rate"))
    drift = (F.col("n") >= V.DRIFT_MIN_ROWS) & (F.col("recent_rate") < F.col("older_rate") * V.DRIFT_RATIO)
    return rates.withColumn("drift", F.coalesce(drift, F.lit(False)))


def reset_drifted(state: DataFrame, drift: DataFrame) -> DataFrame:
    """State with the parameters of drifted contexts set back to 1."""
    flags = drift.where("drift").select("context_key", F.lit(True).alias("_drift"))
    fresh = lambda c: F.when(F.col("_drift"), F.lit(1.0)).otherwise(F.col(c)).alias(c)
    return state.join(flags, "context_key", "left").select(*KEYS, fresh("alpha"), fresh("beta"), "n_updates")


def beta_draws(seed: int):
    """One Beta draw per row, seeded by the row's own key, so partitions and batches don't matter."""

    @F.pandas_udf("double")
    def draw(alpha: pd.Series, beta: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([
            np.random.default_rng([seed, int(k) & 0xFFFFFFFFFFFFFFFF]).beta(a, b) for a, b, k in zip(alpha, beta, key)], dtype=float)

    return draw


def choose_hours(
    contexts: DataFrame, state: DataFrame, scores: DataFrame, seed: int | None = 42,
    epsilon: float = V.BANDIT_EPSILON, weight: float = V.BANDIT_WEIGHT, normalize_scores: bool = False,
) -> DataFrame:
    """Send hour per context: explore with probability ``epsilon``, else the best mixed score.

    ``contexts(context_key, nlp_type)`` meets its 17 hours, the state and the hour scores
    ``(nlp_type, hour, ml_score)``.  ``seed=None`` is the deterministic mode: no exploration
    and the Beta mean instead of a draw.
    """
    hours = F.sequence(F.lit(V.BANDIT_HOURS[0]), F.lit(V.BANDIT_HOURS[1]))
    grid = contexts.select("context_key", "nlp_type").distinct().withColumn("hour", F.explode(hours))
    joined = grid.join(state, KEYS, "left").join(scores, ["nlp_type", "hour"], "left").withColumns({
        "alpha": F.coalesce("alpha", F.lit(1.0)), "beta": F.coalesce("beta", F.lit(1.0)),
        "ml_score": F.coalesce("ml_score", F.lit(V.BANDIT_SCORE_DEFAULT))})
    per_context = W.partitionBy("context_key", "nlp_type")
    model = F.col("ml_score") / F.max("ml_score").over(per_context) if normalize_scores else F.col("ml_score")
    if seed is None:
        draw, explore = F.col("alpha") / (F.col("alpha") + F.col("beta")), F.lit(False)
        lucky = F.lit(0)
    else:
        draw = beta_draws(seed)("alpha", "beta", F.xxhash64("context_key", "nlp_type", "hour"))
        uniform = lambda salt: F.pmod(F.xxhash64("context_key", "nlp_type", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1e6
        explore = uniform("explore") < epsilon
        count = V.BANDIT_HOURS[1] - V.BANDIT_HOURS[0] + 1
        lucky = F.lit(V.BANDIT_HOURS[0]) + F.floor(uniform("hour") * count).cast("int")
    mixed = joined.withColumn("mixed", F.round(F.lit(1 - weight) * draw + F.lit(weight) * model, 9))
    preferred = F.when(explore, F.when(F.col("hour") == lucky, 2.0e9).otherwise(F.lit(-1.0))).otherwise(F.col("mixed"))
    best = mixed.withColumn("_p", preferred).groupBy("context_key", "nlp_type").agg(
        F.max_by(F.struct("hour", "ml_score", "mixed"), F.struct(F.col("_p"), -F.col("hour"))).alias("_b"),
        F.max("_p").alias("_p"))
    return best.select(
        "context_key", "nlp_type", F.col("_b.hour").alias("hour"), F.col("_b.ml_score").alias("ml_score"),
        F.col("_b.mixed").alias("mixed_score"),
        F.when(F.col("_p") > 1e9, "explore").otherwise("ts_ml_hybrid").alias("method"))


def log_decisions(chosen: DataFrame, now: Column, ttl_days: int = V.DECISION_TTL_DAYS) -> DataFrame:
    """Decision rows as they are appended to the log."""
    return chosen.withColumns({"decided_at": now, "expires_at": now + F.make_dt_interval(days=F.lit(ttl_days))})


def purge_expired(log: DataFrame, now: Column) -> DataFrame:
    return log.where(F.col("expires_at") > now)


def join_feedback(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """Feedback with its decision and a status ``updated`` or ``not_found``."""
    known = decisions.select("sms_id", "context_key", "recommended_hour")
    return feedback.join(known, "sms_id", "left").withColumn(
        "status", F.when(F.col("context_key").isNull(), "not_found").otherwise("updated"))


def latest_feedback(feedback: DataFrame, clicks_only: bool = False) -> DataFrame:
    """Final state per message (newest feedback), or its first click only."""
    row = F.struct("received_at", "feedback_id", "engaged")
    order = F.struct("received_at", "feedback_id")
    if clicks_only:
        chosen = feedback.where("engaged").groupBy("sms_id").agg(F.min_by(row, order).alias("_r"))
    else:
        chosen = feedback.groupBy("sms_id").agg(F.max_by(row, order).alias("_r"))
    return chosen.select("sms_id", "_r.*")


def bandit_size(state: DataFrame) -> DataFrame:
    return state.agg(F.count_distinct("context_key").alias("n_contexts"), F.sum("n_updates").alias("n_updates"))
