"""Engagement model and message classifier on Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF, ElementwiseProduct, HashingTF, StringIndexer, VectorAssembler, VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smsight.functions import calendar as C, text as T, vocab as V
from smsight.operators import encoding as E
from smsight.operators.evaluation import curve_areas, pr_curve
from smsight.operators.neighbours import BLOCK_ROWS, nearest_blocks, numbered
from smsight.operators.ranks import stratified_folds
from smsight.session import written

CALENDAR_FEATURES = [
    "send_hour", "send_month", "is_monday", "is_friday", "is_weekend", "is_mid_week", "is_morning", "is_afternoon",
    "is_evening", "is_night", "is_peak", "is_peak_morning", "is_peak_evening", "day_of_month", "is_salary_period",
    "week_of_month", "quarter", "is_ramadan", "is_summer", "is_rentree", "is_winter", "schedule_h_start",
    "schedule_h_end", "schedule_position", "campaign_type_enc", "message_lenth", "encoding_enc", "nbr_page",
    "smsc_name_enc", "operateur_failure_rate", "smsc_id", "groupe_id", "nlp_text_mult",
]
SIGNAL_FEATURES = [
    "urgency_score", *V.SIGNAL_PATTERNS, "is_urgent_high", "is_sensitive", "is_marketing", "is_transactional", "nlp_proba_max",
]
INTERACTION_FEATURES = [
    "sensitive_x_morning", "marketing_x_evening", "marketing_x_evening_strong", "transact_x_morning",
    "livraison_x_evening", "urgent_x_morning", "financial_x_salary", "urgent_x_hour", "otp_x_campaign_type",
    "proba_x_morning", "proba_x_evening", "marketing_x_msisdn",
]
ONE_HOT_FEATURES = [f"type_{t}" for t in V.MESSAGE_TYPES] + [f"domain_{d}" for d in V.DOMAINS]
RECIPIENT_FEATURES = ["msisdn_engagement_rate", "msisdn_rate_vs_global", "msisdn_sms_count", "msisdn_cold_start",
                      "msisdn_sms_count_log", "msisdn_rate_squared", "msisdn_rate_x_type"]
ENCODED_KEYS = ["smsc_name", "campaign_type", "nlp_type", "nlp_domaine"]
TARGET_FEATURES = [f"{k}_target_loo" for k in ENCODED_KEYS]
FAMILIES = {
    "Phase1": CALENDAR_FEATURES, "NLP": SIGNAL_FEATURES + INTERACTION_FEATURES + ONE_HOT_FEATURES,
    "MSISDN": RECIPIENT_FEATURES, "TargetEnc": TARGET_FEATURES,
}
ALL_FEATURES = [f for family in FAMILIES.values() for f in family]
#: used where the facts have both: earlier messages of the last 24 hours, and 0.92 to that power
FATIGUE_FEATURES = ["sms_last_24h", "sms_fatigue_penalty"]
FATIGUE_BASE = 0.92
LABEL = "engaged"


# --- features ----------------------------------------------------------------------------------

def row_features(facts: DataFrame) -> DataFrame:
    """Features that depend on the row alone."""
    df = C.with_weekday(C.with_hour_flags(C.with_schedule(C.with_calendar(facts))))
    code = lambda column, values: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in sorted(values)]), F.col(column)) - 1, F.lit(0))
    df = E.coarse_labels(df).withColumns({
        "campaign_type_enc": code("campaign_type", V.CAMPAIGN_TYPES), "smsc_name_enc": code("smsc_name", V.OPERATORS),
        "encoding_enc": (F.col("encoding") == "UCS2").cast("int"), "groupe_id": F.coalesce("groupe_id", F.lit(0)),
    })
    df = E.one_hot(E.one_hot(T.text_signals(df), "nlp_type", V.MESSAGE_TYPES, "type"), "nlp_domaine", V.DOMAINS, "domain")
    return df


def with_fatigue(facts: DataFrame) -> DataFrame:
    """``sms_last_24h`` and ``sms_fatigue_penalty`` of every message."""
    return E.messages_last_day(facts).withColumn("sms_fatigue_penalty", F.pow(F.lit(FATIGUE_BASE), F.col("sms_last_24h")))


def feature_list(facts: DataFrame) -> list[str]:
    """All features, with those on fatigue where the facts have them."""
    known = set(FATIGUE_FEATURES) <= set(facts.columns)
    return ALL_FEATURES + (FATIGUE_FEATURES if known else [])


def fitted_features(train: DataFrame, *others: DataFrame) -> tuple[DataFrame, ...]:
    """Recipient and target encodings fitted on the training rows only.

    Training rows get leave-one-out rates; rows of the ``others`` get the plain rate of their
    group, and the overall training rate where the group is new.
    """
    mean = train.agg(F.avg(LABEL)).first()[0]
    rate, type_code = F.col("msisdn_engagement_rate"), F.col("campaign_type_enc")
    derived = {
        "msisdn_rate_vs_global": rate - F.lit(mean), "msisdn_cold_start": (F.col("msisdn_sms_count") == 1).cast("int"),
        "msisdn_sms_count_log": F.log1p("msisdn_sms_count"), "msisdn_rate_squared": rate * rate, "msisdn_rate_x_type": rate * type_code,
    }
    stats = train.groupBy("msisdn").agg(F.avg(LABEL).alias("rate"), F.count("*").alias("msisdn_sms_count"))
    left = E.loo_rate(train, "msisdn", LABEL, "msisdn_engagement_rate").withColumnRenamed("n_obs", "msisdn_sms_count").drop("n_eng")
    left = E.target_encoding(left, ENCODED_KEYS, LABEL)
    sides = [left]
    for other in others:
        right = other.join(stats.withColumnRenamed("rate", "msisdn_engagement_rate"), "msisdn", "left").withColumns({
            "msisdn_engagement_rate": F.coalesce("msisdn_engagement_rate", F.lit(mean)),
            "msisdn_sms_count": F.coalesce("msisdn_sms_count", F.lit(0))})
        for key in ENCODED_KEYS:
            fitted = train.groupBy(key).agg(F.avg(LABEL).alias("rate"))
            right = E.apply_rates(right, fitted, key, f"{key}_target_loo", mean)
        sides.append(right)
    return tuple(E.interactions(side.withColumns(derived)) for side in sides)


def weight_of(df: DataFrame, label: str = LABEL, factor: float = 1.2) -> DataFrame:
    """Rows of each class, and the weight of the positive one: ``negatives / positives * factor``."""
    sums = df.agg(F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"))
    return sums.withColumn("weight", F.col("negatives") / F.greatest("positives", F.lit(1)) * factor)


def class_weight(df: DataFrame, label: str = LABEL, factor: float = 1.2) -> DataFrame:
    """Weight the positive class by ``negatives / positives * factor``."""
    weight = weight_of(df, label, factor).select("weight").scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, weight).otherwise(F.lit(1.0)))


def smote(
    df: DataFrame, features: list[str], label: str = LABEL, k: int = 5, ratio: float = 1.0, seed: int = 42, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add interpolated minority rows until they are exactly ``ratio`` times the majority.

    Partners are drawn from the ``k`` nearest rows of the whole minority, exactly, at every size. Rows are numbered along a
    projection, copies are dealt out evenly by number, and draws are seeded by it, so nothing depends on partitions or
    batches. A null feature counts as 0 here. A minority of one row has no neighbour: it is repeated as it is.
    """
    counts = {bool(r["positive"]): r["n"] for r in df.groupBy((F.col(label) == 1).alias("positive")).agg(F.count("*").alias("n")).collect()}
    minority = 1 if counts.get(True, 0) <= counts.get(False, 0) else 0
    small, large = sorted((counts.get(True, 0), counts.get(False, 0)))
    needed = int(large * ratio) - small
    base = df.select(*[F.col(f).cast("double").alias(f) for f in features], label).withColumn("synthetic", F.lit(False))
    if small < 1 or needed <= 0:
        return base
    kinds = dict(df.dtypes)
    columns = [f"f{i}" for i in range(len(features))]  # features may have any name
    rows = df.where(F.col(label) == minority).select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(c) for f, c in zip(features, columns)])
    near = min(k, small - 1)
    ranked = written(numbered(rows, columns), "minority")
    if near:
        def draw(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    who = np.frombuffer(row["who"], np.int64).reshape(-1, near)
                    rank = row["block"] * block_rows + 1 + np.arange(len(who))
                    copies = np.array([r * needed // small - (r - 1) * needed // small for r in rank.tolist()], np.int64)
                    rng = np.random.default_rng([seed, row["block"]])
                    at = np.repeat(np.arange(len(who)), copies)
                    yield pa.record_batch({"rank": pa.array(rank[at]), "other": pa.array(who[at, rng.integers(0, near, len(at))]),
                                           "share": pa.array(rng.random(len(at)))})

        pairs = nearest_blocks(ranked, columns, near, block_rows).select("block", "who").mapInArrow(draw, "rank long, other long, share double")
    else:
        pairs = ranked.select(F.col("_rank").cast("bigint").alias("rank"), F.col("_rank").cast("bigint").alias("other"), F.lit(0.0).alias("share"),
                              F.explode(F.sequence(F.lit(1), F.lit(needed)))).drop("col")
    side = lambda name: ranked.select(F.col("_rank").cast("bigint").alias(name), F.struct(*columns).alias(f"of_{name}"))
    made = pairs.join(side("rank"), "rank").join(side("other"), "other").select(*[
        (F.col("of_rank")[c] + F.col("share") * (F.col("of_other")[c] - F.col("of_rank")[c])).alias(f) for f, c in zip(features, columns)])
    return base.unionByName(made.select("*", F.lit(minority).cast(kinds[label]).alias(label), F.lit(True).alias("synthetic")))


# --- training --------------------------------------------------------------------------------------

def members(iterations: int = 300, seed: int = 42) -> dict:
    """Ensemble members: boosted trees, random forest and logistic regression."""
    common = dict(featuresCol="features", labelCol=LABEL, weightCol="weight")
    return {
        "gbt": GBTClassifier(maxDepth=5, stepSize=0.03, subsamplingRate=0.75, maxIter=iterations, minInstancesPerNode=8,
                             maxBins=64, seed=seed, **common),
        "forest": RandomForestClassifier(maxDepth=8, numTrees=max(20, iterations // 5), subsamplingRate=0.75,
                                         minInstancesPerNode=8, seed=seed, **common),
        "logistic": LogisticRegression(maxIter=100, regParam=0.01, **common),
    }


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    keep = [c for c in ("sms_id", LABEL, "weight", "fold", "nlp_type") if c in df.columns]
    return assembler.transform(df).select(*keep, "features")


def with_score(model, df: DataFrame, out: str) -> DataFrame:
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(df).withColumn(out, p).drop("rawPrediction", "probability", "prediction")


def scores_of(model, df: DataFrame) -> DataFrame:
    """``score`` and label, written: a curve reads them several times."""
    return written(with_score(model, df, "score").select("score", LABEL), "scores")


def auc(df: DataFrame, score: str, metric: str = "auc_roc") -> float:
    """Area under the whole curve, over every distinct score; 0 where it is not defined."""
    return float(curve_areas(pr_curve(df, score=score, label=LABEL)).first()[metric] or 0.0)


def in_parallel(work: Callable, items: list, parallelism: int = 4) -> list:
    """``work`` on every item, several at a time: a fit is a chain of short jobs that leaves most of a cluster idle."""
    if not items:
        return []
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), items, 1)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """Rounds with the least loss before ``patience`` rounds went by without a better one, and whether they did."""
    best, least = 0, float("inf")
    for i, loss in enumerate(losses):
        if loss < least:
            best, least = i + 1, loss
        elif i + 1 - best >= patience:
            return best, True
    return best, False


def early_stopped(estimator: GBTClassifier, train: DataFrame, validation: DataFrame, patience: int = 60):
    """Boosted trees up to the round of least log-loss on ``validation``, and that number of rounds.

    Boosting goes on until ``patience`` rounds have brought nothing, or ``maxIter`` is reached. The number of rounds
    doubles from fit to fit; since every round is drawn by seed and number, a longer fit begins with the shorter one, and
    its first trees are the shorter model.
    """
    most = estimator.getMaxIter()
    rounds = min(most, patience + 1)
    while True:
        model = estimator.copy({estimator.maxIter: rounds}).fit(train)
        best, over = best_round(model.evaluateEachIteration(validation), patience)
        if over or rounds == most:
            break
        rounds = min(most, 2 * rounds)
    best = max(1, best)
    return (model if best == rounds else first_trees(estimator, model, best)), best


def first_trees(estimator: GBTClassifier, model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model that ``estimator`` fits in so many ``rounds``, taken from a longer one of the same rows."""
    java, spark = model._java_obj, SparkSession.active()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], float(java.treeWeights()[i])
    shorter = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights, model.numFeatures, model.numClasses)
    made = estimator.copy({estimator.maxIter: rounds})._copyValues(GBTClassificationModel(shorter))
    made._transfer_params_to_java()
    return made


def isotonic(scored: DataFrame):
    """Isotonic calibration of ``raw``; equal scores become one weighted point first."""
    points = scored.groupBy("raw").agg(
        F.avg(LABEL).alias("rate"), F.count("*").cast("double").alias("n"))
    return IsotonicRegression(featuresCol="raw", labelCol="rate", weightCol="n", predictionCol="score").fit(points)


def out_of_fold(estimators: dict, train: DataFrame, folds: int = 3) -> dict[tuple, Callable]:
    """The fit of every estimator without each fold, by (name, fold)."""
    return {(name, fold): lambda e=estimator, fold=fold: e.fit(train.where(F.col("fold") != fold))
            for name, estimator in estimators.items() for fold in range(folds)}


def calibrations_of(estimators: dict, train: DataFrame, folds: int = 3, parallelism: int = 4, fitted: dict | None = None) -> dict:
    """Isotonic calibration of every estimator on its out-of-fold scores; all folds of all estimators share one table.

    ``fitted`` are the models of :func:`out_of_fold` that are there already.
    """
    fitted = dict(fitted or {})
    left = {task: fit for task, fit in out_of_fold(estimators, train, folds).items() if task not in fitted}
    fitted |= dict(zip(left, in_parallel(lambda fit: fit(), list(left.values()), parallelism)))
    scored = {name: reduce(DataFrame.unionByName, [
        with_score(fitted[name, fold], train.where(F.col("fold") == fold), "raw").select("raw", LABEL) for fold in range(folds)])
        for name in estimators}
    return dict(zip(scored, in_parallel(isotonic, list(scored.values()), parallelism)))


class EngagementModel:
    """Members with their calibration, averaged by AUC."""

    def __init__(self, models: dict, calibrations: dict, weights: dict[str, float], features: list[str], rounds: dict[str, int] | None = None):
        self.models, self.calibrations, self.weights, self.features = models, calibrations, weights, features
        self.rounds = rounds or {}

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        total = sum(self.weights.values())
        names = []
        for name, model in self.models.items():
            df = with_score(model, df, "raw")
            column = f"score_{name}"
            if name in self.calibrations:
                df = self.calibrations[name].transform(df).withColumnRenamed("score", column)
            else:
                df = df.withColumn(column, F.col("raw"))
            df, names = df.drop("raw"), [*names, name]
        mixed = reduce(lambda a, b: a + b, [F.col(f"score_{n}") * F.lit(self.weights[n] / total) for n in names])
        return df.withColumn(out, mixed)


ROWS_A_TASK = 1 << 18  # of feature vectors that a fit keeps in one partition


def dealt(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """Rows of a written table over so many tasks that none has many more than ``rows``.

    Splits go by the bytes of files; feature vectors pack so well there that one split can unfold to gigabytes, which
    every round of a fit reads. Tables with enough splits are left alone.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def train_engagement_model(
    train: DataFrame, test: DataFrame, features: list[str], estimators: dict | None = None, calibrated: bool = True,
    validation: DataFrame | None = None, patience: int = 60, fitted_on: DataFrame | None = None, parallelism: int = 4,
) -> EngagementModel:
    """Fit and calibrate the members; each weighs as much as its AUC on ``test``.

    With ``validation`` rows boosting stops early, and calibration uses the number of rounds found. ``fitted_on`` are
    the rows for the members (such as rebalanced ones) where they aren't ``train``; calibration always sees real rows.
    """
    # fits iterate, so what they read is written once
    prepared = dealt(written(stratified_folds(assembled(class_weight(train), features), LABEL, "sms_id", 3), "prepared"))
    rows = prepared if fitted_on is None else dealt(written(assembled(class_weight(fitted_on), features), "fitted-on"))
    held = dealt(written(assembled(test, features), "held"))
    judged = None if validation is None else dealt(written(assembled(validation.withColumn("weight", F.lit(1.0)), features), "validation"))
    estimators = dict(estimators or members())

    names = list(estimators)
    stopping = [name for name in names if judged is not None and isinstance(estimators[name], GBTClassifier)]

    def member(name):
        if name in stopping:
            return early_stopped(estimators[name], rows, judged, patience)
        return estimators[name].fit(rows), None

    # boosting goes on longest; fits that don't need its rounds fill the time
    steady = {name: e for name, e in estimators.items() if name not in stopping}
    work = {name: lambda name=name: member(name) for name in [*stopping, *steady]} | (out_of_fold(steady, prepared) if calibrated else {})
    done = dict(zip(work, in_parallel(lambda fit: fit(), list(work.values()), parallelism)))
    models = {name: done[name][0] for name in names}
    rounds = {name: done[name][1] for name in stopping}
    sized = {name: e.copy({e.maxIter: rounds[name]}) if name in rounds else e for name, e in estimators.items()}
    folded = {task: model for task, model in done.items() if isinstance(task, tuple)}
    calibrations = calibrations_of(sized, prepared, 3, parallelism, folded) if calibrated else {}

    def weigh(name):
        single = EngagementModel({name: models[name]}, {k: v for k, v in calibrations.items() if k == name}, {name: 1.0}, features)
        return auc(written(single.score(held).select("score", LABEL), "scores"), "score")

    return EngagementModel(models, calibrations, dict(zip(names, in_parallel(weigh, names, parallelism))), features, rounds)


def sliced(df: DataFrame, indices: list[int]) -> DataFrame:
    """Rows with some positions of their feature vector."""
    return VectorSlicer(inputCol="features", outputCol="_sliced", indices=indices).transform(df).drop("features").withColumnRenamed("_sliced", "features")


def cross_validate(df: DataFrame, features: list[str], estimator, folds: int = 5, parallelism: int = 4) -> list[float]:
    """AUC per stratified fold."""
    prepared = written(stratified_folds(assembled(class_weight(df), features), LABEL, "sms_id", folds), "prepared")

    def held_out(fold: int) -> float:
        model = estimator.fit(prepared.where(F.col("fold") != fold))
        return auc(scores_of(model, prepared.where(F.col("fold") == fold)), "score")

    return in_parallel(held_out, list(range(folds)), parallelism)


def ablation(train: DataFrame, test: DataFrame, estimator, families: dict[str, list[str]] | None = None, parallelism: int = 4) -> list[dict]:
    """AUC and PR-AUC without each feature family, with the first one alone, and with all."""
    families = families or FAMILIES
    first = next(iter(families))
    every = [f for family in families.values() for f in family]
    sets = {"all": every, f"only {first}": families[first], "without nlp_text_mult": [f for f in every if f != "nlp_text_mult"]}
    sets |= {f"without {name}": [f for f in every if f not in family] for name, family in families.items() if name != first}
    rows, held = written(assembled(class_weight(train), every), "prepared"), written(assembled(test, every), "held")

    def measured(name: str) -> dict:
        indices = [every.index(f) for f in sets[name]]
        scored = scores_of(estimator.fit(sliced(rows, indices)), sliced(held, indices))
        return {"features": name, "auc_roc": auc(scored, "score"), "pr_auc": auc(scored, "score", "pr_auc")}

    return in_parallel(measured, list(sets), parallelism)


def elimination(df: DataFrame, features: list[str], estimator, step: int = 5, keep: int = 50, folds: int = 3, parallelism: int = 4) -> list[dict]:
    """Recursive elimination under cross-validation: for every size the AUC of each fold and the features left on all rows.

    Each fold eliminates by the importances of its own training rows, and one more path does so on all rows. The paths
    share one table of assembled rows with their folds, read by position, and go on side by side.
    """
    prepared = written(stratified_folds(assembled(class_weight(df), features), LABEL, "sms_id", folds), "prepared")
    paths: dict[int | None, list[int]] = {fold: list(range(len(features))) for fold in [None, *range(folds)]}
    sizes = []
    while True:
        def fit(fold):
            rows = sliced(prepared, paths[fold])
            model = estimator.fit(rows if fold is None else rows.where(F.col("fold") != fold))
            held = None if fold is None else auc(scores_of(model, rows.where(F.col("fold") == fold)), "score")
            return model.featureImportances.toArray(), held

        found = dict(zip(paths, in_parallel(fit, list(paths), parallelism)))
        areas = [found[fold][1] for fold in range(folds)]
        sizes.append({"features": [features[i] for i in paths[None]], "fold_auc": areas, "auc": float(np.mean(areas))})
        drop = min(step, len(paths[None]) - keep)
        if drop <= 0:
            return sizes
        for fold, (importance, _) in found.items():
            gone = set(np.argsort(importance, kind="stable")[:drop].tolist())
            paths[fold] = [i for at, i in enumerate(paths[fold]) if at not in gone]


def select_features(df: DataFrame, features: list[str], estimator, step: int = 5, keep: int = 50, folds: int = 3) -> list[str]:
    """The set of :func:`elimination` with the best mean AUC, of equals the smallest."""
    return max(reversed(elimination(df, features, estimator, step, keep, folds)), key=lambda size: size["auc"])["features"]


def training_chain(
    train: DataFrame, validation: DataFrame, test: DataFrame, features: list[str], estimators: dict | None = None, selector=None,
    step: int = 5, keep: int = 50, patience: int = 60, parallelism: int = 4,
) -> EngagementModel:
    """Rebalance, select features, fit with early stopping, calibrate on real rows, weigh by AUC."""
    balanced = written(with_row_ids(smote(train, features), features), "balanced")
    if selector is not None:
        features = select_features(balanced, features, selector, step, keep)
    return train_engagement_model(train, test, features, estimators, True, validation, patience, balanced, parallelism)


def with_row_ids(df: DataFrame, features: list[str]) -> DataFrame:
    """``sms_id`` of rows that have none, from their values."""
    return df.withColumn("sms_id", F.xxhash64(*features, LABEL, "synthetic"))


def eliminated(features: list[str], selected: list[str]) -> list[str]:
    return [f for f in features if f not in set(selected)]


COMPOSITE_FEATURES = ["is_urgent_high", "is_sensitive", "is_marketing", "is_transactional", "is_livraison_kw"]
#: family tag of every feature that has one of its own; all others are text signals
SOURCES = (
    dict.fromkeys(INTERACTION_FEATURES, "Interaction")
    | dict.fromkeys(COMPOSITE_FEATURES, "Composite")
    | {name: f"OHE_{'type' if name.startswith('type_') else 'domain'}" for name in ONE_HOT_FEATURES}
    | dict.fromkeys(CALENDAR_FEATURES, "Phase1")
    | {"nlp_text_mult": "NLP_v8"}
    | dict.fromkeys(TARGET_FEATURES, "TargetEnc")
    | dict.fromkeys(RECIPIENT_FEATURES, "MSISDN")
)


def feature_importance(spark, model: EngagementModel, top: int | None = None) -> DataFrame:
    """Mean importance over the tree members, with the family tag, largest first."""
    rows = [
        (feature, float(value), SOURCES.get(feature, "NLP_base"))
        for member in model.models.values() if hasattr(member, "featureImportances")
        for feature, value in zip(model.features, member.featureImportances.toArray())]
    out = spark.createDataFrame(rows, "feature string, importance double, source string").groupBy("feature", "source").agg(
        F.avg("importance").alias("importance")).orderBy(F.col("importance").desc(), "feature")
    return out.limit(top) if top else out


# --- message classifier ---------------------------------------------------------------------------------

def char_ngrams(chars: str, n: int = 3) -> Column:
    """Character n-grams from a column of single characters.

    It has to be a column: an expression would be evaluated again for every position.
    """
    last = F.greatest(F.size(chars) - (n - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.concat_ws("", F.slice(chars, i, n)))


def message_features(df: DataFrame, message: str = "message") -> DataFrame:
    """Normalised text, its words, character trigrams and hand-made features."""
    clean = df.withColumn("message_clean", T.normalize_message(message, darija=False))
    clean = clean.withColumn("_single", F.split(F.concat(F.lit(" "), "message_clean", F.lit(" ")), ""))
    return T.manual_text_features(clean, "message_clean", message).withColumns({
        "_words": F.split("message_clean", " "), "_chars": char_ngrams("_single")}).drop("_single")


def message_pipeline(label: str, buckets: int = 1 << 13, char_weight: float = 1.2, iterations: int = 20) -> Pipeline:
    """Word and character TF-IDF (characters weigh 1.2) with hand-made features, linear SVM per class."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
        HashingTF(inputCol="_words", outputCol="_word_tf", numFeatures=buckets), IDF(inputCol="_word_tf", outputCol="_word"),
        HashingTF(inputCol="_chars", outputCol="_char_tf", numFeatures=buckets), IDF(inputCol="_char_tf", outputCol="_char_idf"),
        ElementwiseProduct(scalingVec=Vectors.dense([char_weight] * buckets), inputCol="_char_idf", outputCol="_char"),
        VectorAssembler(inputCols=["_word", "_char", *T.MANUAL_FEATURES], outputCol="features"),
        OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=0.01), labelCol="_label", featuresCol="features", parallelism=4),
    ])


def train_message_classifier(train: DataFrame, test: DataFrame, label: str, **options) -> tuple[PipelineModel, dict[str, float]]:
    """The fitted classifier with accuracy, weighted F1 and the train-test gap."""
    model = message_pipeline(label, **options).fit(train)
    measure = lambda df, name: MulticlassClassificationEvaluator(labelCol="_label", metricName=name).evaluate(df)
    seen, held = model.transform(train), model.transform(test)
    accuracy, train_accuracy = measure(held, "accuracy"), measure(seen, "accuracy")
    return model, {"accuracy": accuracy, "f1_weighted": measure(held, "f1"), "train_accuracy": train_accuracy, "gap": train_accuracy - accuracy}
