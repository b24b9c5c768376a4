"""MLlib jobs: preprocessing, training, evaluation, ablation, explanation.

A fitted classifier is stored and loaded before it scores anything: a loaded
one holds its parameters only, no data, lineage or summary of its training.
Preprocessing is made of plain values, so it holds nothing else either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, scratch
from .aggregates import KEY, build_master
from .ranks import median_moments, running_counts
from .statistics import long_text, score_statistics

#: Default parameters by classifier.
DEFAULTS = {
    "logistic": {"maxIter": 100, "regParam": 0.01, "elasticNetParam": 0.0, "standardization": True},
    "random_forest": {"numTrees": 100, "maxDepth": 10, "maxBins": 64, "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt"},
    "gbt": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8},
}
#: What cross-validation tries by classifier, and its number of folds.
GRIDS = {
    "logistic": {"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]},
    "random_forest": {"numTrees": [50, 100], "maxDepth": [5, 10]},
    "gbt": {"maxDepth": [3, 5, 7], "maxIter": [50, 100]},
}
FOLDS = 3
#: So many models are fitted at once: while one waits for the driver, another has the executors.
AT_ONCE = 2
CLASSES = {"logistic": LogisticRegression, "random_forest": RandomForestClassifier, "gbt": GBTClassifier}


# ── preprocessing ────────────────────────────────────────────────────────────


def _number(c: str):
    """A column as double, NaN as null."""
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def preprocessing_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """feature, kind, position, value, n, fill, scale: all that preprocessing learns, in four readings of ``df``.

    numeric: one row, with the exact median as fill and the sample deviation
    of the filled column as scale. categorical: one row a value, the most
    frequent first (of equals the smallest), then one of null value for
    missing and unseen ones; scale is the deviation of its 0/1 column. A
    column without any value is filled with 0.
    """
    rows: list[tuple] = []
    with scratch(df.sparkSession) as area:
        found = median_moments(df, numeric, area) if numeric else {}
    n = df.count()
    for c in numeric:
        k, fill, mean, squares = found.get(c, (0, 0.0, 0.0, 0.0))
        squares += k * (n - k) / n * (mean - fill) ** 2 if n else 0.0  # those of the filled column
        rows.append((c, "numeric", 0, None, n, fill, math.sqrt(squares / (n - 1)) if n > 1 else 0.0))
    counts = long_text(df, categorical).groupBy("feature", "value").count().collect() if categorical else []
    spread = lambda k: math.sqrt(k / n * (1 - k / n) * n / (n - 1)) if n > 1 else 0.0
    for c in categorical:
        mine = sorted(((-r["count"], r["value"]) for r in counts if r["feature"] == c))
        rest = n + sum(k for k, _ in mine)
        rows += [(c, "categorical", i, v, k, None, spread(k)) for i, (v, k) in enumerate([*((v, -k) for k, v in mine), (None, rest)])]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string, position int, value string, n long, fill double, scale double")


def preprocessing(df: DataFrame, table: DataFrame, scale: bool = True) -> PipelineModel:
    """MLlib stages of a ``preprocessing_table``: fill, index, one-hot (both keep unseen values), assemble, scale.

    ``df`` gives the schema only. A slot without deviation becomes 0.
    """
    rows = sorted(table.collect(), key=lambda r: r["position"])
    numeric = list(dict.fromkeys(r["feature"] for r in rows if r["kind"] == "numeric"))
    categorical = list(dict.fromkeys(r["feature"] for r in rows if r["kind"] == "categorical"))
    of = {c: [r for r in rows if r["feature"] == c] for c in (*numeric, *categorical)}
    fill = "".join(f", coalesce(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), {of[c][0]['fill']!r}D) AS `{c}__filled`" for c in numeric)
    stages: list = [SQLTransformer(statement=f"SELECT *{fill} FROM __THIS__")]
    inputs, factors = [f"{c}__filled" for c in numeric], [of[c][0]["scale"] for c in numeric]
    if categorical:
        indexed, hot = [f"{c}__index" for c in categorical], [f"{c}__hot" for c in categorical]
        labels = [[r["value"] for r in of[c] if r["value"] is not None] for c in categorical]
        stages.append(StringIndexerModel.from_arrays_of_labels(labels, inputCols=categorical, outputCols=indexed, handleInvalid="keep"))
        encoder = OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep")
        stages.append(encoder.fit(stages[-1].transform(df.select(*categorical).limit(0))))  # sizes come from the labels
        inputs += hot
        for c in categorical:
            factors += [r["scale"] for r in of[c]]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features_raw" if scale else "features", handleInvalid="keep")
    stages.append(assembler)
    if scale:
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense([1 / s if s else 0.0 for s in factors]), inputCol="features_raw", outputCol="features"))
    return PipelineModel(stages=stages)


def fit_and_transform(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool = True, on: DataFrame | None = None) -> tuple[PipelineModel, DataFrame]:
    """The preprocessing, fitted on ``df`` or on the rows ``on``, and its output for ``df``."""
    model = preprocessing(df, preprocessing_table(df if on is None else on, numeric, categorical), scale)
    return model, model.transform(df)


# ── training ─────────────────────────────────────────────────────────────────


def classifier(name: str, target: str, weight: str | None = None, seed: int = 42, **params):
    """A classifier by name with the defaults and ``params``; ValueError for another name."""
    if name not in CLASSES:
        raise ValueError(f"unknown classifier: {name}")
    made = CLASSES[name](labelCol=target, featuresCol="features", **(DEFAULTS[name] | params))
    if weight:
        made = made.setWeightCol(weight)
    return made.setSeed(seed) if made.hasParam("seed") else made


def param_grid(estimator, grid: Mapping[str, Sequence]) -> list:
    """All combinations; parameters that the estimator lacks are left out."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        if estimator.hasParam(name):
            builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def detached(model: Model, area: Scratch) -> Model:
    """A fitted model as it is once stored and loaded."""
    path = area.new("model")
    model.write().save(path)
    return type(model).load(path)


def _at_once(fits: Sequence[Callable], spark: SparkSession) -> list:
    """What ``fits`` return, in their order."""
    with ThreadPool(min(AT_ONCE, len(fits))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(f) for f in fits])


def train(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, name: str = "gbt", grid: Mapping[str, Sequence] | None = None, folds: int = FOLDS, weight: str | None = None, **params
) -> PipelineModel:
    """Preprocessing and classifier; with a grid, cross-validated on the area under the ROC curve.

    In cross-validation the preprocessing is fitted in each fold, so that no
    fold sees another's medians and scales; a fold is preprocessed once, and
    all candidates score it in one reading. Of equally good ones the first is
    taken.
    """
    made = classifier(name, target, weight, **params)
    needed = [c for c in dict.fromkeys([*numeric, *categorical, target, weight]) if c]
    with scratch(df.sparkSession) as area:
        candidates, rows = [made.copy(p) for p in param_grid(made, grid)] if grid else [made], df.select(*needed)
        if len(candidates) > 1:
            rows = area.written(rows.withColumn("__fold", F.floor(F.rand(42) * folds)))
            areas = [0.0] * len(candidates)
            for fold in range(folds):
                models = _fitted(rows.where(F.col("__fold") != fold), numeric, categorical, candidates, area)
                held_out = PipelineModel(models[0].stages[:-1]).transform(rows.where(F.col("__fold") == fold))  # the same for all
                found = evaluate_models({k: m.stages[-1] for k, m in enumerate(models)}, held_out.select("features", target), target, ("raw",))
                areas = [a + (found[k]["roc_auc"] or 0.0) for k, a in enumerate(areas)]
            candidates = [candidates[areas.index(max(areas))]]
        return _fitted(rows, numeric, categorical, candidates, area)[0]


def train_several(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], estimators: Mapping) -> dict[str, PipelineModel]:
    """Models by name of several classifiers of one target and weight: ``df`` is worked out once, preprocessed and assembled once for all."""
    made = list(estimators.values())
    needed = dict.fromkeys([*numeric, *categorical, made[0].getLabelCol(), *_weight(made[0])])
    with scratch(df.sparkSession) as area:
        return dict(zip(estimators, _fitted(area.written(df.select(*needed)), numeric, categorical, made, area), strict=True))


def _weight(estimator) -> list[str]:
    return [estimator.getWeightCol()] if estimator.isDefined("weightCol") and estimator.getWeightCol() else []


def _fitted(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], estimators: Sequence, area: Scratch) -> list[PipelineModel]:
    """A model for each estimator on one matrix of ``rows``, which is written once."""
    target = estimators[0].getLabelCol()
    before, out = fit_and_transform(rows, numeric, categorical)
    matrix = area.written(out.select("features", F.col(target).cast("double").alias(target), *_weight(estimators[0])))
    fitted = _at_once([lambda e=e: detached(e.fit(matrix), area) for e in estimators], rows.sparkSession)
    return [PipelineModel(stages=[*before.stages, m]) for m in fitted]


def save_model(model: PipelineModel, folder: str, version: str) -> str:
    """Stores a model as one version under ``folder``, on any Hadoop file system; its path."""
    path = f"{folder.rstrip('/')}/{version}"
    model.write().overwrite().save(path)
    return path


def best_params(model: PipelineModel, names: Sequence[str]) -> dict:
    """The named parameters of the classifier, as far as it has them."""
    last = model.stages[-1]
    return {n: last.getOrDefault(n) for n in names if last.hasParam(n) and last.isDefined(n)}


# ── evaluation ───────────────────────────────────────────────────────────────


def scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions with pd_score, the probability of class 1."""
    return model.transform(df).withColumn("pd_score", vector_to_array("probability")[1])


def _verdict(predictions: DataFrame):
    return F.struct(vector_to_array("rawPrediction")[1].alias("raw"), vector_to_array("probability")[1].alias("pd"), (F.col("prediction") == 1).alias("hit"))


def _confusion(hit0: int, miss0: int, hit1: int, miss1: int) -> dict[str, float]:
    """Accuracy and class-weighted precision, recall and F1 of two classes, from how many of each were taken for class 1."""
    n, shares = hit0 + miss0 + hit1 + miss1, []
    for right, wrong, lost in ((miss0, miss1, hit0), (hit1, hit0, miss1)):
        precision, recall = (right / (right + x) if right else 0.0 for x in (wrong, lost))
        shares.append(((right + lost) / n, precision, recall, 2 * precision * recall / (precision + recall) if right else 0.0))
    precision, recall, f1 = (sum(s[0] * s[k] for s in shares) for k in (1, 2, 3))
    return {"accuracy": (miss0 + hit1) / n, "f1": f1, "weighted_precision": precision, "weighted_recall": recall}


def _measures(judged: DataFrame, target: str, names: Sequence, parts: Sequence[str] = ("raw", "pd")) -> dict:
    """Metrics by name of ``judged`` (target, v0, v1, ...), which is written once and read for its counts.

    Areas are those of the raw prediction, exact at every score; ks is that of
    the probability. What a single class leaves undefined is None, and what
    only a part that isn't asked for gives.
    """
    keys = [f"v{k}" for k in range(len(names))]
    with scratch(judged.sparkSession) as area:
        rows = area.written(judged.where(F.col(target).isin(0, 1)).select(F.col(target).cast("int").alias("g"), *keys))
        long = rows.select("g", F.inline(F.array(*[F.struct(F.lit(f"{v}.{part}").alias("feature"), F.col(f"{v}.{part}").alias("value")) for v in keys for part in parts])))
        found = {r["feature"]: r for r in score_statistics(running_counts(long, "g", area)).collect()}
        cells = [F.count_if((F.col("g") == g) & (F.col(f"{v}.hit") == hit)).alias(f"{v}{g}{hit:d}") for v in keys for g in (0, 1) for hit in (True, False)]
        counts = rows.agg(*cells).first()
    out = {}
    for name, v in zip(names, keys, strict=True):
        raw, pd = found.get(f"{v}.raw"), found.get(f"{v}.pd")
        values = {"roc_auc": raw and raw["roc_auc"], "pr_auc": raw and raw["pr_auc"], "ks_statistic": pd and pd["ks"]}
        cell = [counts[f"{v}{g}{hit}"] for g in (0, 1) for hit in (1, 0)]
        out[name] = values | (_confusion(*cell) if sum(cell) else dict.fromkeys(("accuracy", "f1", "weighted_precision", "weighted_recall")))
    return out


def evaluate_models(models: Mapping, df: DataFrame, target: str, parts: Sequence[str] = ("raw", "pd")) -> dict:
    """Metrics by name of several models, all of which score ``df`` in the same reading; of ``parts``, raw gives the areas and pd gives ks."""
    rows, names = df.select("*", F.col(target).alias("__target")), list(models)
    for k, name in enumerate(names):
        out = models[name].transform(rows)
        rows = out.select(*rows.columns, _verdict(out).alias(f"__v{k}"))
    return _measures(rows.select("__target", *[F.col(f"__v{k}").alias(f"v{k}") for k in range(len(names))]), "__target", names, parts)


#: Columns of a row of metrics.
METRICS = ("ks_statistic", "roc_auc", "pr_auc", "accuracy", "f1", "weighted_precision", "weighted_recall")


def _row(found: Mapping[str, float | None]) -> dict:
    return {m: None if found[m] is None else round(found[m], 4) for m in METRICS}


def evaluate(predictions: DataFrame, target: str, least_auc: float = 0.70) -> DataFrame:
    """One row: areas, accuracy, f1, weighted precision and recall, ks_statistic, promoted (area of at least 0.70)."""
    found = _measures(predictions.select(target, _verdict(predictions).alias("v0")), target, ["one"])["one"]
    schema = ", ".join(f"{m} double" for m in METRICS) + ", promoted boolean"
    return predictions.sparkSession.createDataFrame([(*_row(found).values(), (found["roc_auc"] or 0.0) >= least_auc)], schema)


def compare_models(models: Mapping[str, PipelineModel | str], test: DataFrame, target: str, least_auc: float = 0.70) -> DataFrame:
    """One row of metrics for each model, ranked by the area under the ROC curve.

    A model is given itself or by the path of a stored version. All of them
    score in one reading of ``test``."""
    loaded = {name: PipelineModel.load(m) if isinstance(m, str) else m for name, m in models.items()}
    found = evaluate_models(loaded, test, target)
    ranked = sorted(found, key=lambda name: (-_row(found[name])["roc_auc"] if found[name]["roc_auc"] is not None else 1.0, name))
    rows = [(*_row(found[name]).values(), (found[name]["roc_auc"] or 0.0) >= least_auc, name, k + 1) for k, name in enumerate(ranked)]
    return test.sparkSession.createDataFrame(rows, ", ".join(f"{m} double" for m in METRICS) + ", promoted boolean, model string, rank int")


def _sliceable(out: DataFrame, target: str, area: Scratch) -> DataFrame:
    """(target, every) of preprocessed rows, written; the slots of ``every`` have their columns' names."""
    return area.written(out.select(target, F.col("features").alias("every", metadata=out.schema["features_raw"].metadata)))


def ablation(application: DataFrame, aggregates: Mapping[str, DataFrame], train_ids: DataFrame, test_ids: DataFrame, target: str, numeric: Sequence[str], name: str = "logistic", **params) -> DataFrame:
    """Metrics without children, with all, and with each one left out; deltas against all.

    All tables are joined, filled, scaled (as the training rows say) and
    assembled once, and written, training and test rows apart, as each training
    reads its matrix twice; a configuration is a slice of that matrix by the
    names of its columns. All models score the test rows in one reading.
    """
    of = {t: [c for c in df.columns if c != KEY] for t, df in aggregates.items()}
    configs = {"application_only": [], "full": list(of)} | {f"without_{t}": [x for x in of if x != t] for t in of}
    columns = {config: [*numeric, *[c for t in tables for c in of[t]]] for config, tables in configs.items()}
    parts = train_ids.select(KEY).distinct().withColumn("__test", F.lit(False)).unionByName(test_ids.select(KEY).distinct().withColumn("__test", F.lit(True)))
    spark = application.sparkSession
    with scratch(spark) as area:
        master = build_master(application, aggregates).join(parts, KEY)
        master = area.written(master.select(F.col(target).cast("double").alias(target), "__test", *columns["full"]))
        before = preprocessing(master, preprocessing_table(master.where("not __test"), columns["full"], []))
        train, test = (_sliceable(before.transform(master.where(part)), target, area) for part in ("not __test", "__test"))
        models = {}
        for config, names in columns.items():
            slicer = VectorSlicer(inputCol="every", outputCol="features", names=[f"{c}__filled" for c in names])
            fitted = classifier(name, target, **params).fit(slicer.transform(train).select("features", target))
            models[config] = PipelineModel(stages=[slicer, detached(fitted, area)])
        found = {config: _row(m) for config, m in evaluate_models(models, test, target).items()}
    less = lambda config, m: None if None in (found[config][m], found["full"][m]) else round(found[config][m] - found["full"][m], 4)
    rows = [(c, len(columns[c]), found[c]["roc_auc"], found[c]["ks_statistic"], less(c, "roc_auc"), less(c, "ks_statistic")) for c in configs]
    rows = [(*r, k + 1) for k, r in enumerate(sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0.0, r[0])))]
    return spark.createDataFrame(rows, "config string, n_features int, roc_auc double, ks_statistic double, delta_auc double, delta_ks double, rank int")


# ── explanation ──────────────────────────────────────────────────────────────


def feature_importance(model: PipelineModel, predictions: DataFrame) -> DataFrame:
    """feature, importance, pct: by the names in the assembled vector's metadata."""
    last = model.stages[-1]
    attrs = next(predictions.schema[c].metadata["ml_attr"]["attrs"] for c in ("features_raw", "features") if c in predictions.columns and "attrs" in predictions.schema[c].metadata.get("ml_attr", {}))
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    weights = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(weights.sum()) or 1.0
    rows = [(names.get(k, f"slot_{k}"), float(w), round(100 * float(w) / total, 2)) for k, w in enumerate(weights)]
    return predictions.sparkSession.createDataFrame(rows, "feature string, importance double, pct double")


def row_explanations(df: DataFrame, key: str, importances: Mapping[str, float], numeric: Sequence[str], top_k: int = 5) -> DataFrame:
    """(key, rank, feature, impact, direction): the ``top_k`` drivers of each row.

    A number's impact is its importance times tanh((x - mean) / abs(mean)), or
    a tenth of it without a usable mean or value; a category's a twentieth.
    """
    have = [c for c in importances if c in df.columns]
    mine = [c for c in have if c in numeric]
    means = df.agg(*[F.avg(c).alias(f"__mean_{c}") for c in mine])
    rows = df.crossJoin(F.broadcast(means))  # one row of means

    def impact(c: str):
        w = F.lit(float(importances[c]))
        if c not in mine:
            return w * 0.05
        m = F.col(f"__mean_{c}")
        return F.when(m.isNotNull() & (m != 0) & F.col(c).isNotNull(), w * F.tanh((F.col(c) - m) / F.abs(m))).otherwise(w * 0.1)

    drivers = F.array(*[F.struct((-F.abs(impact(c))).alias("by"), F.lit(c).alias("feature"), impact(c).alias("impact")) for c in have])
    out = rows.select(key, F.posexplode(F.slice(F.array_sort(drivers), 1, top_k)).alias("pos", "d"))
    direction = F.when(F.col("d.impact") > 0, "increases_risk").otherwise("decreases_risk")
    return out.select(key, (F.col("pos") + 1).alias("rank"), F.col("d.feature").alias("feature"), F.col("d.impact").alias("impact"), direction.alias("direction"))
