import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from smsight.functions import scoring, vocab as V
from smsight.operators import timing as M


def curve(spark, values, kind="Rappel"):
    return spark.createDataFrame(
        [(kind, h, float(v), float(v)) for h, v in enumerate(values)], "nlp_type string, send_hour int, time_norm double, hybrid double")


def window(spark, values, kind="Rappel"):
    r = M.optimal_windows(curve(spark, values, kind)).first()
    return r.best_hour, r.window_start, r.window_end, r.method


def test_matrix_smoothing(spark):
    rows = [(9, "OTP", 1)] * 3 + [(9, "OTP", 0), (10, "Livraison", 0)]
    df = spark.createDataFrame(rows, "send_hour int, nlp_type_reel string, engaged int")
    m = {(r.nlp_type, r.send_hour): r.time_score for r in M.time_score_matrix(df).collect()}
    g = 3 / 5
    assert len(m) == 48
    assert m["OTP", 9] == pytest.approx((3 + 30 * g) / 34)
    assert m["Livraison", 10] == pytest.approx(15 * g / 16)
    assert m["OTP", 0] == pytest.approx(g)


def test_matrix_reads_rows_once_and_keeps_rows_without_hour_or_type(spark, tmp_path):
    rows = [(9, "OTP", 1), (9, "OTP", 1), (None, "OTP", 0), (30, "OTP", 0), (8, None, 1)]
    spark.createDataFrame(rows, "send_hour int, nlp_type_reel string, engaged int").write.parquet(f"{tmp_path}/rows")
    matrix = M.time_score_matrix(spark.read.parquet(f"{tmp_path}/rows"))
    assert matrix._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    m = {(r.nlp_type, r.send_hour): r for r in matrix.collect()}
    assert len(m) == 48 and all(r.global_rate == 3 / 5 for r in m.values())
    assert (m["OTP", 9].n_eng, m["OTP", 9].n_obs, m[None, 8].n_obs) == (2, 2, 1)
    assert sum(r.n_obs for r in m.values()) == 3 and m[None, 9].time_score == 3 / 5
    assert M.time_score_matrix(spark.read.parquet(f"{tmp_path}/rows").limit(0)).count() == 0


def test_windows(spark):
    flat = [1.0] * 24
    assert window(spark, flat) == (9, 9, 13, "fallback_posthoc")
    assert window(spark, flat, "Unknown") == (9, 9, 13, "fallback_posthoc")
    spike = flat.copy()
    spike[15] = 2.0
    assert window(spark, spike) == (15, 15, 16, "hybrid_norm")
    assert window(spark, spike, "OTP") == (7, 7, 11, "morning_priority")
    assert window(spark, spike, "Promotion") == (17, 17, 19, "evening_priority")
    last = flat.copy()
    last[23] = 2.0
    assert window(spark, last) == (23, 23, 23, "hybrid_norm")


def walk(window, start, end):
    """The hour-by-hour walk, as the brute-force answer."""
    lo, hi = V.WINDOW_HOURS[window]
    cursor = start.replace(minute=0, second=0)
    if start.minute or start.second:
        cursor += dt.timedelta(hours=1)
    if cursor.hour < lo:
        cursor = cursor.replace(hour=lo)
    hours, steps = [], 0
    while cursor <= end:
        if lo <= cursor.hour <= hi:
            hours.append(cursor.hour)
            cursor += dt.timedelta(hours=1)
        else:
            cursor = (cursor + dt.timedelta(days=1)).replace(hour=lo) if cursor.hour > hi else cursor.replace(hour=lo)
    return hours


def test_active_hours_equal_the_walk(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        start = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.choice([0, 15, 45]), hours=rng.randrange(24 * 40))
        end = start + dt.timedelta(minutes=rng.randrange(60 * 24 * rng.choice([1, 5, 40, 160])))
        rows.append((i, start, end, rng.choice(list(V.WINDOW_HOURS))))
    df = spark.createDataFrame(rows, "i int, start timestamp_ntz, end timestamp_ntz, sending_window string")
    scores = V.REFERENCE_CURVES["OTP"]
    df = df.withColumn("scores", F.array(*[F.lit(s) for s in scores]))
    for r in M.forecast_engagement(df).collect():
        _, start, end, name = rows[r.i]
        hours = walk(name, start, end)
        assert r.active_hours == len(hours), rows[r.i]
        lo, hi = V.WINDOW_HOURS[name]
        used = [scores[h] for h in hours] or scores[lo:hi + 1]
        rate = min(95.0, max(30.0, 30 + (sum(used) / len(used) - 0.5) / 0.8 * 65))
        assert r.engagement_rate == pytest.approx(rate, abs=1e-8)
        assert len(r.top_windows) == 2 and r.top_windows[0].rate >= r.top_windows[1].rate


def test_timing_lookup_levels(spark):
    results = spark.createDataFrame(
        [("CLASSIC", "Orange", "OTP", 9, 8, 10, "08h–10h", "m", 1.2, [(9, 1.0, 1.0, 1.1)])],
        "camp_type string, operateur string, nlp_type string, best_hour int, window_start int, window_end int, window_label string, "
        "method string, hybrid_score_peak double, hourly_curve array<struct<hour:int,time_score_raw:double,time_score_norm:double,hybrid_score_norm:double>>")
    asked = spark.createDataFrame(
        [(1, "classic", "ORANGE", "OTP"), (2, "TRANSACTIONAL", "Telecom", "OTP"), (3, "CLASSIC", "Orange", "Rappel")],
        "i int, campaign_type string, operateur string, nlp_type string")
    rows = {r.i: r for r in M.predict_timing(asked, results).collect()}
    assert (rows[1].best_hour, rows[2].best_hour, rows[3].best_hour) == (9, 9, 9)
    assert (rows[1].method, rows[2].method, rows[3].method) == ("m", "m", "fallback_default")
    assert (rows[3].window_start, rows[3].window_end, rows[3].window_label) == (8, 10, "8h–10h")
    assert rows[1].predicted_engagement_rate == 95.0 and rows[1].hourly_scores[0].in_window
    assert len(rows[3].hourly_scores) == 24 and rows[3].hourly_scores[9].hybrid_score == 1.1


def test_rates(spark):
    values = spark.createDataFrame([(0.5,), (1.3,), (0.9,), (9.0,), (None,)], "s double")
    assert [r[0] for r in values.select(scoring.score_to_rate(F.col("s"))).collect()][:4] == [30.0, 95.0, 62.5, 95.0]
    assert [r[0] for r in values.select(scoring.prediction_to_rate(F.col("s"))).collect()] == [57.5, 95.0, 87.5, 9.0, 65.0]


def test_cost_and_progress(spark):
    row = spark.range(1).select(
        scoring.cost(F.lit(102), F.lit(2)).alias("c"),
        *[scoring.date_progress(F.lit(s), F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-03").cast("timestamp_ntz"),
                                F.lit(n).cast("timestamp_ntz")).alias(a)
          for a, s, n in [("x", "RUNNING", "2024-01-02"), ("y", "COMPLETED", "2024-01-02"), ("z", "RUNNING", "2023-01-01")]],
    ).first()
    assert (str(row.c), row.x, row.y, row.z) == ("10.2000", 50, 100, 0)
