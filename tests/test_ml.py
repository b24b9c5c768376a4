"""Training, evaluation, stored versions and ablation."""

import math
import os

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from lendspark import registry
from lendspark.functions import features
from lendspark.operators import ml, ranks
from lendspark.sources.scratch import scratch, shared_folder

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """A number that decides, one that says nothing, a category with a rare value, nulls."""
    df = spark.range(400).select(
        (F.col("id") % 10).cast("double").alias("good"),
        F.when(F.col("id") % 9 > 0, (F.xxhash64("id") % 100).cast("double")).alias("noise"),
        F.when(F.col("id") == 7, "rare").otherwise(F.concat(F.lit("c"), F.col("id") % 2)).alias("kind"),
        (F.col("id") % 10 >= 6).cast("int").alias("y"),
        "id",
    )
    return df.cache()


def test_classifiers_by_name(spark):
    with pytest.raises(ValueError, match="unknown classifier: svm"):
        ml.classifier("svm", "y")
    made = ml.classifier("gbt", "y", weight="w", maxIter=3)
    assert made.getMaxIter() == 3 and made.getMaxDepth() == 5 and made.getWeightCol() == "w" and made.getSeed() == 42


def test_grid_takes_what_the_estimator_has(spark):
    made = ml.classifier("logistic", "y")
    assert len(ml.param_grid(made, {"regParam": [0.0, 0.1], "maxIter": [5, 6, 7], "maxDepth": [1, 2]})) == 6


def test_cross_validation_fits_preprocessing_in_the_folds(spark, rows):
    model = ml.train(rows, ["good", "noise"], ["kind"], "y", "logistic", grid={"regParam": [0.01, 50.0]}, folds=2, maxIter=20)
    assert ml.best_params(model, ["regParam", "maxIter", "maxDepth"]) == {"regParam": 0.01, "maxIter": 20}
    assert len(model.stages) == 6  # filler, indexer, encoder, assembler, scaler, classifier
    row = ml.evaluate(ml.scores(model, rows), "y").first()
    assert row["roc_auc"] == 1.0 and row["promoted"] and row["ks_statistic"] == 1.0


def test_stored_versions_are_compared(spark, rows, tmp_path):
    good = ml.save_model(ml.train(rows, ["good"], [], "y", "logistic", maxIter=10), str(tmp_path), "v1")
    noise = ml.save_model(ml.train(rows, ["noise"], [], "y", "logistic", maxIter=10), str(tmp_path), "v2")
    out = ml.compare_models({"v2": noise, "v1": good}, rows, "y").orderBy("rank").collect()
    assert [r["model"] for r in out] == ["v1", "v2"] and out[0]["roc_auc"] > out[1]["roc_auc"]


def test_ablation_ranks_what_is_missed(spark, rows):
    key = F.col("id").cast("long").alias("SK_ID_CURR")
    app = rows.select(key, "y", "noise")
    children = {"telling": rows.select(key, "good"), "silent": rows.select(key, (F.col("noise") * 2).alias("twice"))}
    ids = features.hash_split(app.select("SK_ID_CURR"), "SK_ID_CURR")
    out = {r["config"]: r for r in ml.ablation(app, children, ids.where("split = 0"), ids.where("split > 0"), "y", ["noise"], "logistic", maxIter=10).collect()}
    assert set(out) == {"application_only", "full", "without_telling", "without_silent"} and out["full"]["delta_auc"] == 0
    assert out["without_telling"]["delta_auc"] < -0.2 and out["without_silent"]["rank"] > out["without_telling"]["rank"]


def test_feature_columns(spark, rows):
    sparse = rows.withColumn("empty", F.lit(None).cast("double"))
    assert features.feature_columns(sparse, "y", ("id",)) == (["good", "noise"], ["kind"])


def test_preprocessing_is_exact(spark, rows):
    """Medians, order of categories and scales; unseen and missing values have a slot of their own."""
    df = rows.withColumn("noise", F.when(F.col("id") % 50 == 0, math.nan).otherwise(F.col("noise"))).withColumn("blank", F.lit(None).cast("double"))
    df = df.withColumn("kind", F.when(F.col("id") % 20 != 3, F.col("kind")))
    table = {(r["feature"], r["value"]): r for r in ml.preprocessing_table(df, ["noise", "blank"], ["kind"]).collect()}
    x = np.array([r["noise"] if r["noise"] is not None else math.nan for r in df.select("noise").collect()], dtype=float)
    median = np.nanmedian(x)
    assert table["noise", None]["fill"] == median and table["noise", None]["scale"] == pytest.approx(np.std(np.where(np.isnan(x), median, x), ddof=1))
    assert (table["blank", None]["fill"], table["blank", None]["scale"]) == (0.0, 0.0)
    kinds = [r["kind"] for r in df.select("kind").collect()]
    order = sorted({k for k in kinds if k}, key=lambda k: (-kinds.count(k), k))
    assert [v for (f, v), r in sorted(table.items(), key=lambda e: e[1]["position"]) if f == "kind"] == [*order, None]
    _, out = ml.fit_and_transform(df, ["noise", "blank"], ["kind"])
    vectors = out.select("kind", "noise", "features").collect()
    for r, v in zip(vectors, x, strict=True):
        slot = 2 + (order.index(r["kind"]) if r["kind"] else len(order))
        hot = [(k == r["kind"]) for k in kinds]
        want = {0: (median if math.isnan(v) else v) / table["noise", None]["scale"], slot: 1 / np.std(hot, ddof=1)}
        assert r["features"].size == 3 + len(order) and {i: w for i, w in enumerate(r["features"]) if w} == pytest.approx({i: w for i, w in want.items() if w})
    model, _ = ml.fit_and_transform(df, ["noise"], ["kind"])
    unseen = model.transform(spark.createDataFrame([(None, "never")], "noise double, kind string")).first()["features"]
    assert unseen[len(order) + 1] > 0


def test_metrics_equal_mllib(spark, rows):
    """All of them come from one written table; MLlib's evaluators, which read the model's output seven times, say the same."""
    made = rows.withColumn("y", F.when(F.xxhash64("id") % 5 == 0, 1 - F.col("y")).otherwise(F.col("y"))).cache()
    for name, params in (("logistic", {"maxIter": 10}), ("random_forest", {"numTrees": 3, "maxDepth": 3})):
        out = ml.scores(ml.train(made, ["good", "noise"], ["kind"], "y", name, **params), made)
        got = ml.evaluate(out, "y").first()
        out = out.select(F.col("y").cast("double").alias("y"), "rawPrediction", "probability", "prediction").cache()
        for metric, own in (("areaUnderROC", "roc_auc"), ("areaUnderPR", "pr_auc")):
            assert got[own] == pytest.approx(BinaryClassificationEvaluator(labelCol="y", metricName=metric).evaluate(out), abs=6e-5)
        for metric, own in (("accuracy", "accuracy"), ("f1", "f1"), ("weightedPrecision", "weighted_precision"), ("weightedRecall", "weighted_recall")):
            assert got[own] == pytest.approx(MulticlassClassificationEvaluator(labelCol="y", metricName=metric).evaluate(out), abs=6e-5)
        assert 0.5 < got["roc_auc"] < 1


def test_one_class_has_no_areas(spark, rows):
    model = ml.train(rows, ["good"], [], "y", "logistic", maxIter=5)
    row = ml.evaluate(ml.scores(model, rows.where("y = 1")), "y").first()
    assert row["roc_auc"] is None and not row["promoted"] and 0 <= row["accuracy"] <= 1
    none = ml.evaluate(ml.scores(model, rows.where("false")), "y").first()
    assert none["accuracy"] is None and none["ks_statistic"] is None


def counted(spark, rows, name):
    """``rows`` with a column worked out in Python, and how often that was."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return rows.withColumn(name, F.udf(same, "double")(name)), seen


def test_preprocessing_reads_numbers_twice(spark, rows):
    df, seen = counted(spark, rows.select("good"), "good")
    ml.preprocessing_table(df, ["good"], [])
    assert seen.value == 2 * rows.count()


def test_medians_from_brackets_are_exact(spark, monkeypatch):
    """Ties, negative values, even and odd numbers; a bracket that misses is noticed."""
    n = 3001
    df = spark.range(n).select(
        (F.xxhash64("id") % 1000 / 7).alias("many"),
        F.when(F.col("id") % 2 == 0, F.xxhash64("id") % 3).cast("double").alias("ties"),
        F.when(F.col("id") % 4 > 0, (F.xxhash64("id") % 10**6).cast("double")).otherwise(math.nan).alias("holes"),
        F.when(F.col("id") % 3 > 0, -5.0).otherwise(F.col("id").cast("double")).alias("below"),
    )
    x = {c: np.array([r[c] if r[c] is not None else math.nan for r in df.select(c).collect()], dtype=float) for c in df.columns}
    monkeypatch.setattr(ranks, "WHOLE", 10)
    for accuracy, slack in ((4_000, 1e-3), (3, 0.0)):
        monkeypatch.setattr(ranks, "MEDIAN_ACCURACY", accuracy)
        monkeypatch.setattr(ranks, "MEDIAN_SLACK", slack)
        with scratch(spark) as area:
            got = ranks.median_moments(df, df.columns, area)
        for c, v in x.items():
            v = v[~np.isnan(v)]
            assert got[c][:2] == (len(v), np.median(v))
            assert got[c][2:] == (pytest.approx(v.mean()), pytest.approx(((v - v.mean()) ** 2).sum()))


def test_several_models_work_rows_out_once(spark, rows):
    df, seen = counted(spark, rows, "good")
    made = {"logistic": ml.classifier("logistic", "y", maxIter=5), "gbt": ml.classifier("gbt", "y", maxIter=2)}
    models = ml.train_several(df, ["good", "noise"], ["kind"], made)
    assert list(models) == list(made) and seen.value == rows.count()
    alone = ml.train(rows, ["good", "noise"], ["kind"], "y", "logistic", maxIter=5)
    assert models["logistic"].stages[-1].coefficients.toArray() == pytest.approx(alone.stages[-1].coefficients.toArray())


def test_cross_validation_works_rows_out_once(spark, rows):
    df, seen = counted(spark, rows, "good")
    ml.train(df, ["good"], [], "y", "logistic", grid={"regParam": [0.01, 50.0]}, folds=2, maxIter=5)
    assert seen.value == rows.count()


@pytest.mark.parametrize("name", ["train_metrics", "model_comparison", "ablation"])
def test_model_queries(spark, name):
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    out = registry.QUERIES[name](spark, DIR).collect()
    assert set(os.listdir(shared_folder(spark).removeprefix("file:"))) <= before  # nothing is left behind
    assert {"train_metrics": 1, "model_comparison": 3, "ablation": 7}[name] == len(out)
    assert all(0 <= r["ks_statistic"] <= 1 and 0.3 <= r["roc_auc"] <= 1 for r in out)


@pytest.fixture
def fits(monkeypatch):
    """(classifier, iterations it took, rows) of every fit."""
    seen, detached = [], ml.detached

    def note(model, area):
        seen.append((model, model.summary.totalIterations, model.summary.predictions.count()))
        return detached(model, area)

    monkeypatch.setattr(ml, "detached", note)
    return seen


def test_ablation_query_trains_to_the_end_on_all_loans(spark, fits):
    """No fit is cut short, and every loan that isn't held out is trained on."""
    registry.QUERIES["ablation"](spark, DIR).collect()
    ids = features.hash_split(spark.read.parquet(f"{DIR}/orders.parquet"), "o_orderkey")
    assert len(fits) == 7 and {n for _, _, n in fits} == {ids.where("split <> 2").count()}
    assert all(ml.best_params(ml.PipelineModel([m]), list(ml.DEFAULTS["logistic"])) == ml.DEFAULTS["logistic"] and k < m.getMaxIter() for m, k, _ in fits)


def test_train_metrics_query_tries_the_whole_grid(spark, fits):
    """Six candidates in each of three folds, none cut short, and the best of them once more on all training rows."""
    registry.QUERIES["train_metrics"](spark, DIR).collect()
    tried = [(m.getRegParam(), m.getElasticNetParam()) for m, _, _ in fits]
    whole = sorted((r, e) for r in (0.001, 0.01, 0.1) for e in (0.0, 0.5))
    assert len(fits) == 19 and sorted(tried[:18]) == sorted(3 * whole) and tried[18] in whole
    assert all(m.getMaxIter() == 100 and k < 100 for m, k, _ in fits)
    assert sum(n for _, _, n in fits[:18]) == 6 * 2 * fits[18][2]  # each row is trained on in two folds
