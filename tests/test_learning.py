import pytest
from pyspark.sql import functions as F

from smsight.operators import learning as L, ranks
from smsight.session import written
from smsight.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    """Engagement that follows the evening and one feature."""
    base = spark.range(1200).select(
        F.col("id").alias("sms_id"), (F.col("id") % 24).cast("double").alias("send_hour"),
        (F.col("id") * 7919 % 101 / 101).alias("x"), (F.col("id") * 31 % 17).cast("double").alias("noise"))
    return written(base.withColumn("engaged", (F.col("x") + (F.col("send_hour") > 16).cast("int") * 0.6 > 0.9).cast("int")), "rows")


FEATURES = ["send_hour", "x", "noise"]


def test_train_calibrate_and_save(spark, rows, tmp_path):
    folds = ranks.stratified_folds(rows, "engaged", "sms_id", 5)
    train, test = folds.where("fold > 0").drop("fold"), folds.where("fold = 0").drop("fold")
    chosen = {k: v for k, v in L.members(iterations=5).items() if k in ("gbt", "logistic")}
    model = L.train_engagement_model(train, test, FEATURES, chosen)
    scored = model.score(L.assembled(test, FEATURES))
    assert L.auc(scored, "score") > 0.9
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1
    top = L.feature_importance(spark, model).first()
    assert top.feature in ("x", "send_hour")
    tables.write_feature_importance(L.feature_importance(spark, model), str(tmp_path / "fi"))
    assert spark.read.option("header", True).csv(str(tmp_path / "fi")).count() == 3


def test_selection_and_ablation(rows):
    tree = L.members(iterations=3)["gbt"]
    kept = L.select_features(rows, FEATURES, tree, step=1, keep=2, folds=2)
    assert set(kept) >= {"x", "send_hour"}
    assert L.eliminated(FEATURES, kept) in ([], ["noise"])
    out = {r["features"]: r["auc_roc"] for r in L.ablation(rows, rows, tree, {"Phase1": ["send_hour"], "X": ["x"]})}
    assert out["all"] > out["without X"]


def test_smote_balances(rows):
    skewed = rows.where((F.col("engaged") == 0) | (F.col("sms_id") % 5 == 0))
    out = L.smote(skewed, FEATURES)
    n = {r.engaged: r["count"] for r in out.groupBy("engaged").count().collect()}
    assert n[1] == n[0]
    assert out.where("not synthetic").count() == skewed.count()
    span = skewed.where("engaged = 1").agg(F.min("x"), F.max("x")).first()
    made = out.where("synthetic").agg(F.min("x"), F.max("x")).first()
    assert span[0] <= made[0] and made[1] <= span[1]


@pytest.mark.parametrize("rows_per_batch", [1, 2, 10_000])
def test_smote_does_not_depend_on_batches_or_partitions(spark, rows_per_batch):
    data = [(float(i), float(i * i % 17), int(i < 30)) for i in range(1300)] + [(0.5, 3.0, 1)] * 3
    df = spark.createDataFrame(data, "x double, y double, engaged int")
    plain = sorted(map(tuple, L.smote(df, ["x", "y"]).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    try:
        again = sorted(map(tuple, L.smote(df.repartition(rows_per_batch % 5 + 1), ["x", "y"]).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert again == plain and sum(r[2] for r in plain) == 1270


def test_smote_of_three_rows_is_exact(spark):
    df = spark.createDataFrame([(float(i), int(i < 3)) for i in range(10)], "x double, engaged int")
    assert L.smote(df, ["x"]).where("synthetic").count() == 4


def test_message_classifier(spark):
    kinds = {"OTP": "votre code est", "Livraison": "votre colis arrive", "Promotion": "promo soldes remise"}
    m = spark.createDataFrame([(f"{k}{i}", f"{t} {i}", k) for k, t in kinds.items() for i in range(30)], "message_id string, message string, kind string")
    m = L.message_features(m)
    _, quality = L.train_message_classifier(m, m, "kind", buckets=256, iterations=5)
    assert quality["accuracy"] > 0.95 and abs(quality["gap"]) < 1e-9


def test_queries_fit_whole_models(spark, monkeypatch):
    from smsight.plans import queries as Q

    class Stop(Exception):
        pass

    asked = []

    def engagement(train, test, features, estimators=None, calibrated=True, validation=None, patience=60, *rest):
        asked.append(((estimators or L.members())["gbt"].getMaxIter(), patience, validation))
        raise Stop

    def messages(train, test, label, **options):
        stages = L.message_pipeline(label, **options).getStages()
        asked.append((stages[-1].getClassifier().getMaxIter(), stages[1].getNumFeatures()))
        raise Stop

    monkeypatch.setattr(Q, "_split", lambda spark, d: (None, "later", None, []))
    monkeypatch.setattr(L, "smote", lambda train, features: spark.range(1).withColumns({"engaged": F.lit(0), "synthetic": F.lit(False)}))
    monkeypatch.setattr(L, "train_engagement_model", engagement)
    monkeypatch.setattr(L, "train_message_classifier", messages)
    for query in (Q.engagement_model, Q.feature_importance, Q.message_model):
        with pytest.raises(Stop):
            query(spark, "/root/testdata/sf0.001")
    assert asked == [(300, 60, "later"), (300, 60, "later"), (20, 1 << 13)]


@pytest.mark.parametrize("n,width,block_rows", [(5000, 4, 256), (1500, 2, 1024), (1300, 9, 64), (7, 3, 4)])
def test_nearest_rows_equal_brute_force(spark, n, width, block_rows):
    import numpy as np
    from smsight.operators import neighbours as N
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, width)) * rng.uniform(1, 5, width), 1)  # many ties
    x[: n // 5] = x[n // 5: 2 * (n // 5)]
    names = [f"f{i}" for i in range(width)]
    ranked = written(N.numbered(spark.createDataFrame(x.tolist(), names).repartition(5), names), "ranked")
    rows = ranked.orderBy("_rank").collect()
    y = np.array([[r[c] for c in names] for r in rows])
    want = {}
    for i in range(n):
        distance = np.zeros(n)
        for f in range(width):
            distance += (y[i, f] - y[:, f]) ** 2
        distance[i] = np.inf
        want[i + 1] = (np.lexsort((np.arange(n), distance))[:5] + 1).tolist()
    got = {i: [0] * 5 for i in want}
    for r in N.nearest(ranked, names, 5, block_rows).collect():
        got[r.rank][r.place - 1] = r.other
    assert got == want


def test_smote_of_one_row_repeats_it(spark):
    df = spark.createDataFrame([(1.5, 1)] + [(float(i), 0) for i in range(4)], "x double, engaged int")
    made = L.smote(df, ["x"]).where("synthetic").collect()
    assert [(r.x, r.engaged) for r in made] == [(1.5, 1)] * 3


def test_best_round_waits_for_its_patience():
    assert L.best_round([0.5, 0.4, 0.45, 0.41, 0.3], 2) == (2, True)
    assert L.best_round([0.5, 0.4, 0.45, 0.41, 0.3], 3) == (5, False)
    assert L.best_round([0.5, 0.5, 0.5], 2) == (1, True)
    assert L.best_round([], 2) == (0, False)


def test_boosting_stops_where_the_validation_loss_is_least(spark, rows):
    noisy = rows.withColumn("engaged", F.when(F.col("sms_id") % 3 == 0, 1 - F.col("engaged")).otherwise(F.col("engaged")))
    folds = ranks.stratified_folds(noisy, "engaged", "sms_id", 4)
    train, validation = (written(L.assembled(part.withColumn("weight", F.lit(1.0)), FEATURES), "part") for part in (folds.where("fold > 0"), folds.where("fold = 0")))
    whole = L.GBTClassifier(maxIter=24, maxDepth=4, stepSize=0.3, labelCol="engaged", seed=7)
    model, rounds = L.early_stopped(whole, train, validation, patience=3)
    losses = whole.fit(train).evaluateEachIteration(validation)
    want, _ = L.best_round(losses, 3)  # the plain way: all rounds, then the least loss
    assert rounds == want < 24 and model.getNumTrees == want
    shorter = model.evaluateEachIteration(validation)
    assert shorter == pytest.approx(losses[:want])


def test_elimination_equals_a_plain_loop(rows):
    tree = L.members(iterations=2)["gbt"]
    sizes = L.elimination(rows, FEATURES, tree, step=1, keep=1, folds=2)
    assert [len(s["features"]) for s in sizes] == [3, 2, 1]
    table = ranks.stratified_folds(L.class_weight(rows), "engaged", "sms_id", 2).select("engaged", "weight", "fold", *FEATURES)

    def path(fold):
        left, seen = list(FEATURES), []
        while True:
            train = table if fold is None else table.where(F.col("fold") != fold)
            model = tree.fit(L.assembled(train, left))
            area = None if fold is None else L.auc(L.with_score(model, L.assembled(table.where(F.col("fold") == fold), left), "score"), "score")
            seen.append((list(left), area))
            if len(left) == 1:
                return seen
            values = model.featureImportances.toArray()
            left.remove(left[min(range(len(left)), key=lambda i: (values[i], i))])

    paths = {fold: path(fold) for fold in (None, 0, 1)}
    for at, size in enumerate(sizes):
        assert size["features"] == paths[None][at][0]
        assert size["fold_auc"] == pytest.approx([paths[0][at][1], paths[1][at][1]])


def test_chain_scores_match_areas_in_sql(spark, rows, tmp_path):
    import duckdb
    parts = ranks.stratified_folds(rows.where("engaged = 0 OR sms_id % 2 = 0"), "engaged", "sms_id", 4)
    train, validation, test = (parts.where(c).drop("fold") for c in ("fold > 1", "fold = 1", "fold = 0"))
    chosen = {k: v for k, v in L.members(iterations=12).items() if k != "forest"}
    model = L.training_chain(train, validation, test, FEATURES, chosen, selector=L.members(iterations=2)["gbt"], step=1, keep=2, patience=4)
    assert set(model.features) >= {"x", "send_hour"} and 1 <= model.rounds["gbt"] <= 12
    scored = written(model.score(L.assembled(test, model.features)).select("engaged", "score"), "scored")
    scored.write.parquet(str(tmp_path / "scored"))
    sql = """WITH s AS (SELECT engaged, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place FROM read_parquet(?))
      SELECT (sum(place) FILTER (engaged = 1) - p * (p + 1) / 2.0) / (p * n) FROM s, (SELECT count(*) FILTER (engaged = 1) AS p, count(*) FILTER (engaged = 0) AS n FROM s) GROUP BY p, n"""
    area = duckdb.execute(sql, [str(tmp_path / "scored" / "*.parquet")]).fetchone()[0]
    assert L.auc(scored, "score") == pytest.approx(area) and area > 0.9


def test_fatigue_features_are_used_where_known(spark):
    facts = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-01 11:00:00")], "sms_id int, msisdn string, t string")
    facts = L.with_fatigue(facts.withColumn("send_datetime", F.to_timestamp("t")))
    assert {r.sms_id: (r.sms_last_24h, round(r.sms_fatigue_penalty, 6)) for r in facts.collect()} == {1: (0, 1.0), 2: (1, 0.92)}
    assert L.feature_list(facts)[-2:] == L.FATIGUE_FEATURES and L.feature_list(facts.drop("sms_last_24h")) == L.ALL_FEATURES


def test_blocks_meet_only_those_whose_box_they_reach(spark, monkeypatch):
    import numpy as np
    from smsight.operators import neighbours as N
    # the direction of greatest variance is the first column; rows of one value there fall into far clusters of the second
    rows = [(1000.0 * a, 10.0 * b, c / 100.0) for a in range(2) for b in range(12) for c in range(64)]
    names, written_tables = ["x", "y", "z"], {}
    ranked = written(N.numbered(spark.createDataFrame(rows, names), names), "ranked")
    keep = N.written
    monkeypatch.setattr(N, "written", lambda df, name: written_tables.setdefault((name, len(written_tables)), keep(df, name)))
    found = N.nearest(ranked, names, 3, 16).toPandas()
    met = [df.groupBy("near").count().collect() for (name, _), df in written_tables.items() if name == "meetings"]
    near = sum(r["count"] for rows in met for r in rows if r["near"])
    assert near <= 96 * 6 and sum(r["count"] for rows in met for r in rows) >= near
    x = np.array([[r[c] for c in names] for r in ranked.orderBy("_rank").collect()])
    for r in (1, 700, 1536):
        distance = np.sqrt(((x - x[r - 1]) ** 2).sum(1))
        distance[r - 1] = np.inf
        assert np.allclose(sorted(found[found["rank"] == r].distance), np.sort(distance)[:3])
