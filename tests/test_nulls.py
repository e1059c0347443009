"""Rows with null keys, groups or scores stay, with the defined values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from smsight.operators import bandit, encoding as E, evaluation as Q, ranks


@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", "x", 1), ("a", "y", 0), ("a", "x", 1), ("b", "x", 0), (None, "y", 1), (None, None, 0)]
    return spark.createDataFrame(data, "msisdn string, kind string, engaged int").coalesce(1)


def test_leave_one_out_of_null_keys_is_the_overall_rate(rows):
    out = E.loo_rate(rows, "msisdn").collect()
    assert len(out) == 6
    assert {round(r.loo_rate, 9) for r in out if r.msisdn is None} == {0.5}
    assert sorted(r.loo_rate for r in out if r.msisdn == "a") == [0.5, 0.5, 1.0]


def test_target_encoding_keeps_null_keys(rows):
    out = E.target_encoding(rows, ["msisdn", "kind"]).collect()
    assert len(out) == 6
    assert {r.msisdn_target_loo for r in out if r.msisdn is None} == {0.5}
    assert [r.kind_target_loo for r in out if r.msisdn is None and r.kind == "y"] == [0.0]
    assert [r.kind_target_loo for r in out if r.kind is None] == [0.5]


def test_recipient_features_keep_null_recipients(rows):
    out = E.recipient_features(rows).collect()
    assert len(out) == 6
    assert {(r.msisdn_engagement_rate, r.msisdn_sms_count, r.msisdn_cold_start) for r in out if r.msisdn is None} == {(0.5, 0, 0)}


def test_messages_last_day_keeps_null_recipients_and_times(spark):
    at = dt.datetime(2024, 1, 1, 12)
    data = [(1, "a", at), (2, "a", at + dt.timedelta(hours=1)), (3, None, at), (4, None, at + dt.timedelta(hours=1)), (5, "a", None)]
    df = spark.createDataFrame(data, "sms_id int, msisdn string, send_datetime timestamp_ntz")
    assert {r.sms_id: r.sms_last_24h for r in E.messages_last_day(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_folds_of_a_null_class(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(30)], "id int, kind string")
    counts = ranks.stratified_folds(df, "kind", "id", 5).groupBy("kind", "fold").count().collect()
    assert {(r.kind, r["count"]) for r in counts} == {(None, 4), ("a", 2)}


def test_curve_of_null_groups_and_scores(spark):
    data = [(None, 0.9, 1), (None, 0.1, 0), ("g", 0.5, 1), ("g", None, 1), ("g", 0.2, 0)]
    df = spark.createDataFrame(data, "grp string, score double, engaged int")
    curve = Q.pr_curve(df, ["grp"])
    out = {r.grp: (r.total, r.positives) for r in curve.select("grp", "total", "positives").distinct().collect()}
    assert out == {None: (2, 1), "g": (2, 1)}
    assert Q.curve_areas(Q.pr_curve(df)).first().n_rows == 4


def test_beta_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200).select((F.col("id") % 7 + 1.0).alias("a"), F.lit(2.0).alias("b"), F.xxhash64("id").alias("k"))
    draw = bandit.beta_draws(42)
    first, second = (sorted((r.k, r.d) for r in df.repartition(n).select("k", draw("a", "b", "k").alias("d")).collect()) for n in (2, 8))
    assert first == second and all(0 < d < 1 for _, d in first)
