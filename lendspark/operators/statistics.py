"""Scorecards, rank tests and drift, as aggregations over all features at once.

Wide tables are unpivoted to (feature, value); every statistic is a grouping by
feature and bin or value. Nulls and NaN are left out on entry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_1_tail, kolmogorov_p
from ..sources.scratch import scratch, settled
from .ranks import pick_quantiles, quantile_counts, running_counts

#: Values that a report of drift names: the most frequent ones.
NAMED = 20


def long_form(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """(keep..., feature, value double) of the features that ``df`` has."""
    names = [c for c in features if c in df.columns]
    rows = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(keep), names, "feature", "value")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def long_text(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """(keep..., feature, value string) without nulls."""
    names = [c for c in features if c in df.columns]
    return df.select(*keep, *[F.col(c).cast("string").alias(c) for c in names]).unpivot(list(keep), names, "feature", "value").where("value is not null")


# ── scorecard ────────────────────────────────────────────────────────────────


def iv_strength(iv: Column) -> Column:
    """The usual reading of an information value. The bands."""
    return F.when(iv < 0.02, "useless").when(iv < 0.10, "weak").when(iv < 0.30, "medium").when(iv < 0.50, "strong").otherwise("suspicious")


def _woe(bins: DataFrame, smoothing: float) -> DataFrame:
    """(feature, bin..., n, bad) with good, woe, iv_part, iv."""
    whole = Window.partitionBy("feature")
    rows = bins.withColumn("good", F.col("n") - F.col("bad"))
    share = lambda c: F.greatest(F.col(c).cast("double"), F.lit(smoothing)) / (F.sum(c).over(whole) + smoothing)
    rows = rows.withColumns({"pct_good": share("good"), "pct_bad": share("bad")})
    rows = rows.withColumn("woe", F.log(F.col("pct_good") / F.col("pct_bad")))
    rows = rows.withColumn("iv_part", (F.col("pct_good") - F.col("pct_bad")) * F.col("woe"))
    return rows.withColumn("iv", F.sum("iv_part").over(whole))


def woe_numeric(df: DataFrame, features: Sequence[str], target: str, bins: int = 10, smoothing: float = 0.5) -> DataFrame:
    """feature, bin, n, good, bad, woe, iv_part, iv: quantile bins (a, b], the first with its lower end.

    ``target`` is 0 or 1. A feature of fewer than two values has one bin and IV 0.
    """
    with scratch(df.sparkSession) as area:
        values, quantiles = quantile_counts(long_form(df, features, target), target, bins, area)
        rows = values.join(F.broadcast(quantile_edges(df, quantiles)), "feature")  # one row a feature
        below = F.size(F.filter("edges", lambda e: e < F.round("value", 9)))
        counts = rows.groupBy("feature", F.greatest(F.lit(1), below).alias("bin"), (F.size("edges") < 2).alias("flat")).agg(F.sum(F.col("c0") + F.col("c1")).alias("n"), F.sum("c1").alias("bad"))
        counts = settled(counts.where("n > 0"))
    out = _woe(counts, smoothing)
    return out.withColumns({c: F.when(F.col("flat"), 0.0).otherwise(F.col(c)) for c in ("woe", "iv_part", "iv")}).select("feature", "bin", "n", "good", "bad", "woe", "iv_part", "iv")


def woe_categorical(df: DataFrame, features: Sequence[str], target: str, smoothing: float = 0.5) -> DataFrame:
    """The same with one bin for each value."""
    rows = long_text(df, features, target).where(F.col(target).isNotNull())
    counts = rows.groupBy("feature", F.col("value").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("bad"))
    out = _woe(counts, smoothing)
    single = F.count("*").over(Window.partitionBy("feature")) < 2
    return out.withColumns({c: F.when(single, 0.0).otherwise(F.col(c)) for c in ("woe", "iv_part", "iv")}).select("feature", "bin", "n", "good", "bad", "woe", "iv_part", "iv")


def iv_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, least: float = 0.02) -> DataFrame:
    """feature, kind, n_bins, iv, strength of features with iv of at least ``least``, ranked."""
    parts = [("numeric", woe_numeric(df, numeric, target))] if numeric else []
    parts += [("categorical", woe_categorical(df, categorical, target))] if categorical else []
    out = None
    for kind, woe in parts:
        one = woe.groupBy("feature").agg(F.lit(kind).alias("kind"), F.count("*").alias("n_bins"), F.first("iv").alias("iv"))
        out = one if out is None else out.unionByName(one)
    rank = F.row_number().over(Window.orderBy(F.desc("iv"), "feature"))  # one row a feature
    return out.where(F.col("iv") >= least).select("feature", "kind", "n_bins", "iv", iv_strength(F.col("iv")).alias("strength"), rank.alias("rank"))


# ── rank statistics ──────────────────────────────────────────────────────────


def quantile_edges(df: DataFrame, quantiles: Mapping[str, Sequence[float]], digits: int = 9) -> DataFrame:
    """(feature, edges): the distinct quantiles, rounded so that engines agree; ``df`` gives the session."""
    rows = df.sparkSession.createDataFrame([(f, list(q)) for f, q in quantiles.items()], "feature string, q array<double>")
    return rows.select("feature", F.array_sort(F.array_distinct(F.transform("q", lambda x: F.round(x, digits)))).alias("edges"))


def kruskal_ranking(df: DataFrame, features: Sequence[str], target: str, top_k: int | None = 20, alpha: float = 0.05, least_rows: int = 30) -> DataFrame:
    """feature, n, h (2 digits), p_value, significant, rank: Kruskal-Wallis of two classes, with ties.

    Features of under ``least_rows`` rows, with an empty class or one value only are left out.
    """
    with scratch(df.sparkSession) as area:
        v = running_counts(long_form(df, features, target), target, area)
        t = (F.col("c0") + F.col("c1")).cast("double")
        r = F.col("b0") + F.col("b1") + (t + 1) / 2
        s = settled(v.groupBy("feature").agg(F.sum("c0").cast("double").alias("n0"), F.sum("c1").cast("double").alias("n1"), F.sum(F.col("c0") * r).alias("r0"), F.sum(F.col("c1") * r).alias("r1"), F.sum(t * t * t - t).alias("ties")))
    s = s.where((F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("n0") + F.col("n1") >= least_rows)).withColumn("n", F.col("n0") + F.col("n1"))
    s = s.withColumn("corr", 1 - F.col("ties") / (F.col("n") * F.col("n") * F.col("n") - F.col("n"))).where("corr > 0")
    h = (12 / (F.col("n") * (F.col("n") + 1)) * (F.col("r0") * F.col("r0") / F.col("n0") + F.col("r1") * F.col("r1") / F.col("n1")) - 3 * (F.col("n") + 1)) / F.col("corr")
    s = s.select("feature", F.col("n").cast("long").alias("n"), h.alias("raw"), F.round(h, 2).alias("h"))
    rank = F.row_number().over(Window.orderBy(F.desc("h"), "feature"))  # one row a feature
    out = s.select("feature", "n", "h", chi2_1_tail(F.col("raw")).alias("p_value"), rank.alias("rank")).withColumn("significant", F.col("p_value") < alpha)
    return out.where(F.col("rank") <= top_k) if top_k else out


def both_samples(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, g) of two samples: g is 0 for ``ref`` and 1 for ``cur``."""
    return long_form(ref, features).withColumn("g", F.lit(0)).unionByName(long_form(cur, features).withColumn("g", F.lit(1)))


def _ks(v: DataFrame) -> DataFrame:
    """(feature, n_ref, n_cur, ks, ks_p) of running counts."""
    gap = F.abs(F.try_divide(F.col("b0") + F.col("c0"), F.col("n0")) - F.try_divide(F.col("b1") + F.col("c1"), F.col("n1")))
    d = v.groupBy("feature", F.col("n0").alias("n_ref"), F.col("n1").alias("n_cur")).agg(F.max(gap).alias("d"))
    few = (F.col("n_ref") <= 1) | (F.col("n_cur") <= 1)
    d = d.withColumn("ks", F.when(few, 0.0).otherwise(F.col("d")))
    return d.select("feature", "n_ref", "n_cur", "ks", F.when(few, 1.0).otherwise(kolmogorov_p(F.col("ks"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))).alias("ks_p"))


def ks_two_sample(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, n_ref, n_cur, ks, ks_p; a side of one row or none gives 0 and 1."""
    with scratch(ref.sparkSession) as area:
        return settled(_ks(running_counts(both_samples(ref, cur, features), "g", area)))


def score_statistics(v: DataFrame) -> DataFrame:
    """(feature, n0, n1, roc_auc, pr_auc, ks) of running counts of scores by class.

    roc_auc comes from rank sums; pr_auc is the area under the line through
    (recall, precision) at each score from the highest down, which starts at
    recall 0 with the first precision. All of it is sums over values.
    """
    v = v.withColumns({c: F.col(c).cast("double") for c in ("n0", "n1")})
    r = F.col("b0") + F.col("b1") + (F.col("c0") + F.col("c1") + 1) / 2
    gap = F.abs(F.try_divide(F.col("b0") + F.col("c0"), F.col("n0")) - F.try_divide(F.col("b1") + F.col("c1"), F.col("n1")))
    tp, fp = F.col("n1") - F.col("b1"), F.col("n0") - F.col("b0")
    before = tp - F.col("c1") + fp - F.col("c0")
    here, last = tp / (tp + fp), F.when(before > 0, (tp - F.col("c1")) / before)
    area = F.try_divide(F.col("c1") * (here + F.coalesce(last, here)) / 2, F.col("n1"))
    m = v.groupBy("feature", "n0", "n1").agg(F.sum(F.col("c1") * r).alias("r1"), F.max(gap).alias("ks"), F.sum(area).alias("pr_auc"))
    auc = F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0"))
    return m.select("feature", "n0", "n1", auc.alias("roc_auc"), "pr_auc", "ks")


def classification_metrics(scored: DataFrame, target: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: n, roc_auc and ks from rank sums, accuracy, precision, recall, f1 at a threshold."""
    rows = scored.where(F.col(target).isin(0, 1)).select(F.lit("score").alias("feature"), F.col(score).cast("double").alias("value"), F.col(target).alias("g"))
    with scratch(scored.sparkSession) as area:
        v = running_counts(rows.where(F.col("value").isNotNull()), "g", area)
        hit = F.col("value") >= threshold
        cut = v.groupBy("feature").agg(F.sum(F.when(hit, F.col("c1")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("c0")).otherwise(0)).alias("fp"))
        m = settled(score_statistics(v).join(F.broadcast(cut), "feature"))  # one row each
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "n1")
    return m.select(
        (F.col("n0") + F.col("n1")).cast("long").alias("n"),
        F.round("roc_auc", 4).alias("roc_auc"),
        F.round("ks", 4).alias("ks_statistic"),
        F.round((F.col("tp") + F.col("n0") - F.col("fp")) / (F.col("n0") + F.col("n1")), 4).alias("accuracy"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n1")), 4).alias("f1"),
    )


# ── drift ────────────────────────────────────────────────────────────────────


def psi_severity(psi: Column, warning: float = 0.10, alert: float = 0.25) -> Column:
    """The bands."""
    return F.when(psi < warning, "none").when(psi < alert, "moderate").otherwise("significant")


def psi(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """feature, n_bins, psi, severity: bins [a, b) between quantiles of ``ref``, open at the ends.

    n_bins 0 marks a feature of fewer than three edges or with an empty side,
    whose psi of 0 says nothing.
    """
    with scratch(ref.sparkSession) as area:
        values, quantiles = quantile_counts(both_samples(ref, cur, features), "g", bins, area, first_only=True)
        return settled(_psi(values, quantile_edges(ref, quantiles), epsilon))


def _psi(values: DataFrame, edges: DataFrame, epsilon: float) -> DataFrame:
    """``psi`` of (feature, value, c0, c1) and the features' edges."""
    values = values.select("feature", "value", "c0", "c1").join(F.broadcast(edges), "feature")  # one row a feature
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    bin_ = F.size(F.filter(inner, lambda e: e <= F.round("value", 9)))
    counts = values.groupBy("feature", bin_.alias("bin"), F.size("edges").alias("n_edges")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    n = Window.partitionBy("feature")  # bins of a feature
    counts = counts.withColumns({"n0": F.sum("c0").over(n), "n1": F.sum("c1").over(n)})
    p, q = F.try_divide("c0", "n0") + epsilon, F.try_divide("c1", "n1") + epsilon
    sound = (F.col("n_edges") >= 3) & (F.col("n0") > 0) & (F.col("n1") > 0)
    out = counts.groupBy("feature", sound.alias("sound"), "n_edges").agg(F.sum(F.when(sound, (q - p) * F.log(q / p)).otherwise(0.0)).alias("raw"))
    value = F.when(F.col("sound"), F.col("raw")).otherwise(0.0)
    return out.select("feature", F.when(F.col("sound"), F.col("n_edges") - 1).otherwise(0).cast("long").alias("n_bins"), F.round(value, 4).alias("psi"), psi_severity(value).alias("severity"))


def _moments(v: DataFrame, side: str, c: str) -> DataFrame:
    """(feature, mean_side, std_side): mean and population deviation of counted values."""
    mean = v.groupBy("feature").agg((F.sum(F.col("value") * F.col(c)) / F.nullif(F.sum(c), F.lit(0))).alias(f"mean_{side}"))
    off = F.col("value") - F.col(f"mean_{side}")
    return v.join(F.broadcast(mean), "feature").groupBy("feature", f"mean_{side}").agg(F.sqrt(F.sum(off * off * F.col(c)) / F.nullif(F.sum(c), F.lit(0))).alias(f"std_{side}"))


def drift_report(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """Per feature: psi, severity, ks, ks_p, means, population deviations, sizes. Values are counted once for all of it."""
    with scratch(ref.sparkSession) as area:
        v = running_counts(both_samples(ref, cur, features), "g", area)
        sizes = v.where("n0 > 0").groupBy("feature").agg(F.first("n0").alias("n"))
        found = pick_quantiles(v.select("feature", "value", F.col("c0").alias("c"), F.col("b0").alias("b")), sizes, bins)
        edges = quantile_edges(ref, {f: [q[k] for k in range(bins + 1)] for f, q in found.items()})
        out = _psi(v, edges, epsilon).join(_ks(v), "feature").join(_moments(v, "ref", "c0"), "feature").join(_moments(v, "cur", "c1"), "feature")
        return settled(out.withColumns({"ks": F.round("ks", 4), "ks_p": F.round("ks_p", 6)}))


def drift_summary(report: DataFrame) -> DataFrame:
    """One row: n_features, n_drifting, overall severity, recommendation."""
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("severity") == s, F.col("feature"))))
    row = report.agg(F.count("*").alias("n_features"), F.count_if(F.col("severity") != "none").alias("n_drifting"), of("significant").alias("sig"), of("moderate").alias("mod"))
    overall = F.when(F.size("sig") > 0, "significant").when(F.size("mod") > 0, "moderate").otherwise("none")
    names = lambda c: F.concat_ws(", ", F.slice(c, 1, 5))
    advice = F.concat_ws(
        "; ",
        F.when(F.size("sig") > 0, F.concat(F.lit("retrain and look at the sources of: "), names("sig"))),
        F.when(F.size("mod") > 0, F.concat(F.lit("watch: "), names("mod"))),
        F.when((F.size("sig") == 0) & (F.size("mod") == 0), F.lit("go on monitoring")),
    )
    return row.select("n_features", "n_drifting", overall.alias("overall"), advice.alias("recommendation"))


def retraining_decision(report: DataFrame, critical: float = 0.25, warning: float = 0.10, n_warnings: int = 3) -> DataFrame:
    """One row: action, severity, triggering features, from the rounded PSI of each feature."""
    bad, mild = F.col("psi") >= critical, (F.col("psi") >= warning) & (F.col("psi") < critical)
    names = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("feature"))))
    row = report.agg(names(bad).alias("bad"), names(mild).alias("mild"))
    is_bad, many, some = F.size("bad") > 0, F.size("mild") >= n_warnings, F.size("mild") > 0
    action = F.when(is_bad, "RETRAIN_IMMEDIATE").when(many, "RETRAIN_SCHEDULED").otherwise("CONTINUE_MONITORING")
    level = F.when(is_bad, "high").when(many, "medium").when(some, "low").otherwise("none")
    return row.select(action.alias("action"), level.alias("severity"), F.concat_ws(",", F.when(is_bad, F.col("bad")).otherwise(F.col("mild"))).alias("triggering_features"))


def js_severity(js: Column) -> Column:
    """The bands."""
    return F.when(js < 0.05, "none").when(js < 0.15, "low").when(js < 0.30, "medium").otherwise("high")


def _category_counts(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """Values of either side with both counts; a value that a side lacks counts 0 there."""
    side = lambda df, c: long_text(df, features).groupBy("feature", "value").agg(F.count("*").alias(c))
    return side(ref, "c0").join(side(cur, "c1"), ["feature", "value"], "full_outer").na.fill(0, ["c0", "c1"])


def categorical_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, js, severity, n_ref, n_cur (categories), n_new, new_categories.

    n_new counts the categories that ``ref`` lacks; new_categories names the
    NAMED most frequent of them (of equals the smallest), as value=count; all
    of them are rows of ``new_categories``. js is the Jensen-Shannon distance: the root of the divergence in natural
    logarithms, at most sqrt(ln 2). Features with an empty side are left out.
    """
    counts = _category_counts(ref, cur, features)
    n = counts.groupBy("feature").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1")).where("n0 > 0 and n1 > 0")
    p, q = F.col("c0") / F.col("n0"), F.col("c1") / F.col("n1")
    part = lambda x: F.when(x > 0, x * F.log(2 * x / (p + q))).otherwise(0.0)
    out = counts.join(F.broadcast(n), "feature").groupBy("feature").agg(
        F.sum((part(p) + part(q)) / 2).alias("div"), F.count_if(F.col("c0") > 0).alias("n_ref"), F.count_if(F.col("c1") > 0).alias("n_cur"), F.count_if(F.col("c0") == 0).alias("n_new")
    )
    out = out.join(_most_frequent(counts.where("c0 = 0")), "feature", "left")
    js = F.sqrt(F.greatest(F.lit(0.0), F.col("div")))
    return out.select("feature", F.round(js, 4).alias("js"), js_severity(js).alias("severity"), "n_ref", "n_cur", "n_new", F.coalesce("named", F.lit("")).alias("new_categories"))


def _most_frequent(new: DataFrame, k: int = NAMED, parts: int = 64) -> DataFrame:
    """(feature, named): the k most frequent values; the best of each of ``parts`` parts are compared, so no task sorts all."""
    by = lambda *keys: F.row_number().over(Window.partitionBy("feature", *keys).orderBy(F.desc("c1"), "value"))
    best = new.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts))).withColumn("r", by("part")).where(F.col("r") <= k)
    best = best.withColumn("r", by()).where(F.col("r") <= k)
    named = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("value", F.lit("="), F.col("c1").cast("string")).alias("s")))), lambda x: x["s"])
    return best.groupBy("feature").agg(F.array_join(named, ",").alias("named"))


def new_categories(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value) pairs of ``cur`` that ``ref`` lacks."""
    pairs = lambda df: long_text(df, features).select("feature", "value").distinct()
    return pairs(cur).join(pairs(ref), ["feature", "value"], "left_anti")
