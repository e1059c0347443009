"""Streams that keep state of their own per key: bandit parameters in event order, decisions that expire, counts of sliding spans.

State lives in Spark's state store (RocksDB), per key; a batch reads and writes only the keys that it has rows or timers for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Types
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from smsight.functions import vocab as V
from smsight.operators.bandit import KEYS, _compose

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store; a session that has set a store of its own keeps it."""
    if "RocksDB" not in (spark.conf.get(STORE[0], None) or ""):
        spark.conf.set(*STORE)


class OrderedBandit(StatefulProcessor):
    """Alpha and beta of one context and hour after its feedback, in the order of the events.

    Events wait until the watermark has passed them, then they are folded for good, oldest first; what waits is folded onto
    that for the answer. So late rows inside the watermark change the answer as if they had come in time, and the state holds
    three numbers and the events of the last ``delay``. Rows behind the watermark are dropped by Spark, rows without time,
    id or outcome before.
    """

    def __init__(self, decay: float):
        self.decay = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "alpha double, beta double, n long")
        self.waiting = handle.getListState("waiting", "at long, id long, engaged int")

    def _fold(self, before: tuple, events: list[tuple]) -> tuple:
        if not events:
            return before
        hits = np.array([e[2] for e in events], float)
        (ca, m, ba), (cb, _, bb) = _compose(hits, self.decay), _compose(1.0 - hits, self.decay)
        return max(ca, m * before[0] + ba), max(cb, m * before[1] + bb), before[2] + len(events)

    def _settle(self, new: list[tuple], watermark_ms: int) -> tuple:
        """Fold what the watermark has passed, keep the rest, and return the parameters after all of it."""
        before = self.settled.get() if self.settled.exists() else (1.0, 1.0, 0)
        events = sorted([tuple(e) for e in self.waiting.get()] + new)
        passed = [e for e in events if e[0] < watermark_ms * 1000]
        rest = events[len(passed):]
        if passed:
            before = self._fold(before, passed)
            self.settled.update(before)
        if rest:
            self.waiting.put(rest)
        elif events:
            self.waiting.clear()
        return self._fold(before, rest), rest

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [e for part in rows for e in zip(part["at"].tolist(), part["id"].tolist(), part["engaged"].tolist())]
        (alpha, beta, n), rest = self._settle(new, timerValues.getCurrentWatermarkInMs())
        if rest:
            self.handle.registerTimer(rest[-1][0] // 1000 + 1)
        yield pd.DataFrame({"context_key": [key[0]], "hour": [key[1]], "alpha": [alpha], "beta": [beta], "n_updates": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle([], timerValues.getCurrentWatermarkInMs())
        return iter(())  # the answer stays what it was

    def close(self) -> None:
        pass


def bandit_updates(feedback: DataFrame, decay: float = V.BANDIT_DECAY, delay: str = "1 day") -> DataFrame:
    """Stream of changed parameters (context_key, hour, alpha, beta, n_updates); ``feedback`` as in ``replay_bandit``."""
    use_state_store(feedback.sparkSession)
    rows = feedback.where("at IS NOT NULL AND id IS NOT NULL AND engaged IS NOT NULL").withWatermark("at", delay).select(
        "context_key", F.col("hour").cast("int").alias("hour"), F.col("at").alias("event_at"), F.unix_micros("at").alias("at"),
        F.col("id").cast("long").alias("id"), F.col("engaged").cast("int").alias("engaged"))
    return rows.groupBy(*KEYS).transformWithStateInPandas(
        OrderedBandit(decay), "context_key string, hour int, alpha double, beta double, n_updates long", "Update", "EventTime")


class ExpiringDecisions(StatefulProcessor):
    """The decisions of one bucket: kept for their time to live, counting feedback, then given out as answered or expired and forgotten.

    A call serves all decisions of the bucket that have rows or have run out. The open ones are one value: numbers as packed
    arrays, contexts as numbers of the distinct ones.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ids binary, at binary, feedback binary, code binary, contexts array<string>")

    def _held(self) -> pd.DataFrame:
        if not self.open.exists():
            return pd.DataFrame({"sms_id": np.array([], np.int64), "at": np.array([], np.int64), "feedback": np.array([], np.int64), "context": np.array([], object)})
        ids, at, feedback, code, contexts = self.open.get()
        longs = lambda packed: np.frombuffer(bytes(packed), np.int64)
        return pd.DataFrame({"sms_id": longs(ids), "at": longs(at), "feedback": longs(feedback), "context": np.array(contexts, object)[longs(code)]})

    def _keep(self, held: pd.DataFrame) -> None:
        if not len(held):
            if self.open.exists():
                self.open.clear()
            return
        code, contexts = pd.factorize(held["context"])
        packed = [held[c].to_numpy(np.int64).tobytes() for c in ("sms_id", "at", "feedback")]
        self.open.update((*packed, code.astype(np.int64).tobytes(), list(contexts)))

    def _expire(self, held: pd.DataFrame, watermark_ms: int, changed: bool) -> Iterator[pd.DataFrame]:
        """Give out and forget what the watermark has passed; the next timer is that of the oldest decision left."""
        over = (held["at"] // 1000 + self.ttl_ms).to_numpy() <= watermark_ms  # as timers run out
        left = held[~over]
        if changed or over.any():
            self._keep(left)
        if len(left):
            self.handle.registerTimer(int(left["at"].min()) // 1000 + self.ttl_ms)
        if over.any():
            gone = held[over]
            yield pd.DataFrame({"sms_id": gone["sms_id"].to_numpy(), "context_key": gone["context"].to_numpy(), "decided_at": pd.to_datetime(gone["at"].to_numpy(), unit="us"),
                                "n_feedback": gone["feedback"].to_numpy(), "status": np.where(gone["feedback"].to_numpy() > 0, "answered", "expired")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([part[["sms_id", "at", "answers", "context_key"]] for part in rows], ignore_index=True)
        held = self._held()
        made = new[~new["answers"].to_numpy(bool)].assign(context=lambda d: d["context_key"].fillna(""))
        made = made[~made["sms_id"].isin(held["sms_id"])].sort_values(["at", "context"]).drop_duplicates("sms_id")  # a repeated decision is the first one
        held = pd.concat([held, made.assign(feedback=np.int64(0))[["sms_id", "at", "feedback", "context"]]], ignore_index=True)
        answers = new.loc[new["answers"].to_numpy(bool), ["sms_id", "at"]].rename(columns={"at": "answered"})
        met = answers.merge(held[["sms_id", "at"]].assign(row=np.arange(len(held))), on="sms_id")
        met = met[(met["at"] <= met["answered"]) & (met["answered"] <= met["at"] + self.ttl_ms * 1000)]
        held["feedback"] = held["feedback"].to_numpy(np.int64) + np.bincount(met["row"].to_numpy(np.int64), minlength=len(held))
        yield from self._expire(held, timerValues.getCurrentWatermarkInMs(), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._expire(self._held(), timerValues.getCurrentWatermarkInMs(), False)

    def close(self) -> None:
        pass


def closed_decisions(
    decisions: DataFrame, feedback: DataFrame, ttl_days: int = V.DECISION_TTL_DAYS, delay: str = "1 day", buckets: int = 1024,
) -> DataFrame:
    """Stream of decisions whose time to live has run out, with the number of feedbacks that came in that time.

    ``decisions(sms_id, context_key, decided_at)``, ``feedback(sms_id, received_at)``. A decision comes out once, when the
    watermark has passed its expiry; feedback without a decision is dropped. Decisions are dealt by hash over ``buckets``, so a
    call serves many of them.
    """
    use_state_store(decisions.sparkSession)
    both = decisions.select("sms_id", "context_key", F.col("decided_at").alias("event_at"), F.lit(False).alias("answers")).unionByName(
        feedback.select("sms_id", F.lit(None).cast("string").alias("context_key"), F.col("received_at").alias("event_at"), F.lit(True).alias("answers")))
    rows = both.where("event_at IS NOT NULL AND sms_id IS NOT NULL").withWatermark("event_at", delay).withColumns(
        {"at": F.unix_micros("event_at"), "sms_id": F.col("sms_id").cast("bigint"), "bucket": F.pmod(F.hash(F.col("sms_id").cast("bigint")), F.lit(buckets))})
    return rows.groupBy("bucket").transformWithStateInPandas(
        ExpiringDecisions(ttl_days * 86_400_000), "sms_id long, context_key string, decided_at timestamp, n_feedback long, status string", "Append", "EventTime")


class SlidingRuns(StatefulProcessor):
    """Sums of the counts of one bucket of recipients over sliding spans, as runs of span ends with the same sum.

    A count enters the spans that end from ``first`` to ``last``, a ``slide`` apart. So the sum of a recipient changes only where
    a count comes in or has gone out, and rows grow with the counts, not with the spans. Runs are given up to the watermark;
    counts that later spans need are kept.
    """

    def __init__(self, key_type: Types.DataType, span_us: int, slide_us: int):
        self.key_type, self.span, self.slide = key_type, span_us, slide_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = {"upto": Types.LongType(), "msisdn": Types.ArrayType(self.key_type), "start": Types.ArrayType(Types.LongType()), "n": Types.ArrayType(Types.LongType())}
        self.open = handle.getValueState("open", Types.StructType([Types.StructField(c, kind) for c, kind in kinds.items()]))

    def _advance(self, new: list[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        """Runs behind the last ones and up to the watermark (microseconds)."""
        upto, parts = None, new
        if self.open.exists():
            upto, keys, starts, ns = self.open.get()
            if not new and upto >= watermark:
                return  # a timer of a bucket that had rows in this batch
            parts = [pd.DataFrame({"msisdn": pd.Series(list(keys), dtype=object), "start": np.array(starts, np.int64), "n": np.array(ns, np.int64)}), *new]
        if not parts:
            return
        counts = pd.concat(parts, ignore_index=True)
        last = counts["start"].to_numpy(np.int64) + self.span
        first = last - (self.span // self.slide - 1) * self.slide
        code, keys = pd.factorize(counts["msisdn"].astype(object), use_na_sentinel=False)
        whose, at = np.concatenate([code, code]), np.concatenate([first, last + self.slide])
        n = counts["n"].to_numpy(np.int64)
        order = np.lexsort((at, whose))
        whose, at, total = whose[order], at[order], np.cumsum(np.concatenate([n, -n])[order])  # zero behind each recipient
        on_grid = lambda us: (us - self.span) // self.slide * self.slide + self.span
        begin = at[:-1] if upto is None else np.maximum(at[:-1], on_grid(upto) + self.slide)
        end = np.minimum(at[1:] - self.slide, on_grid(watermark))
        run = np.flatnonzero((total[:-1] > 0) & (begin <= end))
        left = last > watermark
        if left.any():
            rest = counts[left]
            self.open.update((watermark, rest["msisdn"].tolist(), rest["start"].tolist(), rest["n"].tolist()))
            due = max(int(first[left].min()), on_grid(watermark) + self.slide)
            self.handle.registerTimer(due // 1000)
        elif self.open.exists():
            self.open.clear()
        if len(run):
            yield pd.DataFrame({"msisdn": keys[whose[run]], "first_end": begin[run], "last_end": end[run], "n": total[run]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [part[["msisdn", "start", "n"]] for part in rows]
        yield from self._advance(new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def sliding_runs(counts: DataFrame, span_us: int, slide_us: int, buckets: int = 1024) -> DataFrame:
    """Stream of (msisdn, first_end, last_end, n): ``n`` messages in each span that ends from ``first_end`` to ``last_end``.

    ``counts(msisdn, event_at, start, n)`` are closed counts per recipient and slide (microseconds) in a stream that has a
    watermark on ``event_at``. Recipients are dealt by hash over ``buckets``, so a call serves many of them.
    """
    use_state_store(counts.sparkSession)
    kind = counts.schema["msisdn"].dataType
    out = Types.StructType([Types.StructField("msisdn", kind), *[Types.StructField(c, Types.LongType()) for c in ("first_end", "last_end", "n")]])
    dealt = counts.withColumn("bucket", F.pmod(F.hash("msisdn"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(SlidingRuns(kind, span_us, slide_us), out, "Append", "EventTime")
