"""What fits and searches read and repeat."""

from itertools import product

from pyspark.sql import functions as F

from smsight.operators import learning as L, neighbours as N
from smsight.session import written


def test_blocks_are_close_in_all_columns(spark, monkeypatch):
    corners = list(product((0.0, 100.0), repeat=6))  # clusters whose projections onto any one direction overlap
    names, kept, keep = [f"f{i}" for i in range(6)], [], N.written
    rows = spark.createDataFrame([tuple(c + (i + 1) * (7 * f + 3) % 37 / 4 for f, c in enumerate(corner)) for corner in corners for i in range(32)], names)
    ranked = keep(N.numbered(rows, names), "ranked")
    monkeypatch.setattr(N, "written", lambda df, name: (kept.append((name, out := keep(df, name))), out)[1])
    found = N.nearest(ranked, names, 2, 32)
    assert found.agg(F.max("distance")).first()[0] < 25
    assert sum(df.where("near").count() for name, df in kept if name == "meetings") <= len(corners)


def test_boosting_keeps_its_first_trees_instead_of_fitting_again(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("sms_id"), (F.col("id") % 23).cast("double").alias("x"), (F.col("id") * 7 % 31).cast("double").alias("y"))
    rows = rows.withColumns({"engaged": ((F.col("x") > 9) != (F.col("sms_id") % 4 == 0)).cast("int"), "weight": F.lit(1.0)})
    train, validation = (written(L.assembled(rows.where(c), ["x", "y"]), "part") for c in ("sms_id % 2 = 0", "sms_id % 2 = 1"))
    whole, asked, fit = L.GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.5, labelCol="engaged", seed=3), [], L.GBTClassifier.fit
    monkeypatch.setattr(L.GBTClassifier, "fit", lambda self, df, *a: (asked.append(self.getMaxIter()), fit(self, df, *a))[1])
    model, rounds = L.early_stopped(whole, train, validation, patience=2)
    assert rounds < max(asked) and asked == sorted(asked) and rounds not in asked
    plain = fit(whole.copy({whole.maxIter: rounds}), train)
    assert model.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:] and model.treeWeights == plain.treeWeights
    assert model.featureImportances == plain.featureImportances and model.getMaxIter() == rounds
    scored = [sorted(map(tuple, L.with_score(m, validation, "score").select("sms_id", "score").collect())) for m in (model, plain)]
    assert scored[0] == scored[1]


def test_scores_are_written_before_their_curve(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").alias("sms_id"), (F.col("id") % 23).cast("double").alias("x"), (F.col("id") * 7 % 31).cast("double").alias("y"))
    rows, names, keep = rows.withColumn("engaged", (F.col("x") > 9).cast("int")), [], L.written
    monkeypatch.setattr(L, "written", lambda df, name: (names.append(name), keep(df, name))[1])
    sizes = L.elimination(rows, ["x", "y"], L.members(iterations=2)["forest"], step=1, keep=1, folds=2)
    assert [len(s["features"]) for s in sizes] == [2, 1] and names.count("scores") == 4
