"""Hand-computed cases and properties of the statistics."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendspark.functions import features, scoring, stats
from lendspark.functions.features import add_domain_features
from lendspark.operators import eda, portfolio, ranks, statistics
from lendspark.sources.scratch import scratch


def frame(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def psi_of(spark, a, b):
    rows = statistics.psi(frame(spark, a), frame(spark, b), ["x"]).collect()
    return rows[0]["psi"] if rows else 0.0


def test_psi_cases(spark):
    rng = np.random.default_rng(42)
    a = rng.normal(0, 1, 2000)
    assert psi_of(spark, a, a) == 0
    assert psi_of(spark, a, rng.normal(2, 1, 2000)) > 0.25
    assert psi_of(spark, [], [1, 2, 3]) == 0
    assert psi_of(spark, [1, 2, math.nan, 3, 4], [1, 2, 3, None, 4]) >= 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 20), min_size=5, max_size=40), st.lists(st.integers(0, 20), min_size=5, max_size=40))
def test_psi_and_ks_bounds(spark, a, b):
    assert psi_of(spark, a, b) >= 0
    row = statistics.ks_two_sample(frame(spark, a), frame(spark, b), ["x"]).first()
    want = max(abs(np.mean(np.array(a) <= v) - np.mean(np.array(b) <= v)) for v in {*a, *b})
    assert row["ks"] == pytest.approx(want) and 0 <= row["ks_p"] <= 1


def test_severities(spark):
    rows = spark.createDataFrame([(x,) for x in (0.01, 0.09, 0.10, 0.24, 0.25, 1.0)], "p double").select(statistics.psi_severity(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["none", "none", "moderate", "moderate", "significant", "significant"]


def test_tail_probabilities(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 3.84, 20.0, 144.83, 1371.48)], "h double").select(stats.chi2_1_tail(F.col("h")).alias("p"), "h").collect()
    for r in rows:
        assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["h"] / 2)), rel=1e-9)


def test_js_bounds(spark):
    a, b = spark.createDataFrame([("a",)] * 3, "c string"), spark.createDataFrame([("b",)] * 3, "c string")
    row = statistics.categorical_drift(a, b, ["c"]).first()
    assert row["js"] == pytest.approx(math.sqrt(math.log(2)), abs=1e-4) and (row["n_new"], row["new_categories"]) == (1, "b=3")
    assert statistics.categorical_drift(a, a, ["c"]).first()["js"] == 0


def test_many_new_categories_stay_one_short_row(spark):
    old = spark.createDataFrame([("a",)] * 3, "c string")
    new = spark.range(100_000).select(F.concat(F.lit("n"), F.col("id")).alias("c")).unionByName(spark.createDataFrame([("n7",), ("n9",), ("n9",)], "c string"))
    row = statistics.categorical_drift(old, new, ["c"]).first()
    assert row["n_new"] == 100_000 and row["new_categories"].split(",")[:3] == ["n9=3", "n7=2", "n0=1"] and len(row["new_categories"].split(",")) == statistics.NAMED
    assert statistics.new_categories(old, new, ["c"]).count() == 100_000


def test_categorical_columns_skip_what_has_many_values(spark):
    df = spark.range(30_000).select(
        F.col("id").cast("string").alias("many"), F.concat(F.lit("k"), F.col("id") % 20).alias("at most"), F.concat(F.lit("k"), F.col("id") % 21).alias("more"),
        F.when(F.col("id") % 2 == 0, "x").alias("half"), F.lit("one").alias("one"), F.lit(None).cast("string").alias("none"), "id",
    )
    out = features.categorical_columns(df)
    assert {tuple(r) for r in out.collect()} == {("at most", 20), ("half", 2)}
    assert "Expand" not in df.agg(F.collect_set("half"))._jdf.queryExecution().toString()
    assert features.categorical_columns(df.select("id")).count() == 0 and features.categorical_columns(df.where("false")).count() == 0


def test_correlations_of_a_wide_table(spark):
    """161 columns: nulls by pair, constant and empty columns, far-off means."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 161)) @ rng.normal(size=(161, 161)) + 1e7 * rng.integers(0, 3, 161)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5], x[:, 6] = 3.0, np.nan
    names = [f"c{k}" for k in range(161)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)) for r in x], ", ".join(f"{c} double" for c in names))
    got = {(r["a"], r["b"]): r["corr"] for r in eda.correlations(df, names).collect()}
    assert len(got) == 161 * 162 // 2 - 161  # pairs without common rows are left out
    for i, j in [(0, 1), (3, 160), (64, 63), (63, 64), (70, 128), (159, 160), (10, 10), (5, 9), (5, 5)]:
        if i <= j:
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = None if 5 in (i, j) else np.corrcoef(x[ok, i], x[ok, j])[0, 1]
            assert got[names[i], names[j]] == (want if want is None else pytest.approx(want, abs=1e-7))


def test_splits_and_samples_follow_the_key(spark):
    df = spark.range(20_000).withColumn("key", F.when(F.col("id") > 0, F.col("id")))
    split = {r["split"]: r["count"] for r in features.hash_split(df, "key").groupBy("split").count().collect()}
    assert split[0] == pytest.approx(14_000, rel=0.05) and split[1] == pytest.approx(3_000, rel=0.1) and sum(split.values()) == 20_000
    digest = int(hashlib.md5(b"7:42").hexdigest()[:8], 16)
    assert features.hash_split(df.where("id = 7"), "key").first()["split"] == next(k for k, e in enumerate((70, 85, 100)) if digest * 100 >> 32 < e)
    sample = {r["id"] for r in features.hash_sample(df, "key", 0.1).collect()}
    assert len(sample) == pytest.approx(2_000, rel=0.1) and sample == {r["id"] for r in features.hash_sample(df.repartition(7), "key", 0.1).collect()}
    assert sample <= {r["id"] for r in features.hash_sample(df, "key", 0.3).collect()}


def test_retraining(spark):
    def action(*psis):
        report = spark.createDataFrame([(f"f{k}", float(p)) for k, p in enumerate(psis)], "feature string, psi double")
        return tuple(statistics.retraining_decision(report).first())

    assert action(0.3, 0.1) == ("RETRAIN_IMMEDIATE", "high", "f0")
    assert action(0.1, 0.15, 0.2) == ("RETRAIN_SCHEDULED", "medium", "f0,f1,f2")
    assert action(0.1, 0.0) == ("CONTINUE_MONITORING", "low", "f0")
    assert action(0.0) == ("CONTINUE_MONITORING", "none", "")


def test_scoring_edges(spark):
    rows = spark.createDataFrame([(0.0999,), (0.10,), (0.20,), (0.35,), (None,), (math.nan,)], "pd double").select(scoring.risk_tier(F.col("pd")).alias("t"))
    assert [r["t"].split()[0] for r in rows.collect()] == ["Low", "Medium", "High", "Very", "Very", "Very"]
    df = spark.createDataFrame([(100.0, 0.0), (100.0, None), (None, 50.0), (100.0, 50.0)], "AMT_CREDIT double, AMT_INCOME_TOTAL double")
    assert [r[0] for r in add_domain_features(df).select("FEAT_DEBT_INCOME_RATIO").collect()] == [0.0, 0.0, None, 2.0]


def test_stress_is_monotone_and_whole(spark):
    book = spark.createDataFrame([(k, k / 100, 100.0 + k) for k in range(90)], "id int, pd_score double, AMT_CREDIT double")
    book = scoring.add_expected_loss(book).withColumn("risk_tier", scoring.risk_tier(F.col("pd_score")))
    totals = [r["total_el"] for r in portfolio.stress_test(book).orderBy("scenario_order").collect()]
    assert totals == sorted(totals)
    assert portfolio.segmentation(book).agg(F.sum("count")).first()[0] == 90
    nothing = portfolio.segmentation(book.where("false")).collect()
    assert len(nothing) == 4 and all(r["count"] == 0 for r in nothing)


def one_feature(spark, values, g=None):
    rows = [("x", float(v), 0 if g is None else int(g[k])) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, value double, g int")


def test_ranges_follow_the_values(spark, request):
    """One value far away from all others leaves the ranges as they are, and running counts are those of a sort."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    values = [float(k % 50_000) / 7 for k in range(50_000)] + [1e12]
    rng = np.random.default_rng(1)
    g = rng.integers(0, 2, len(values))
    written = []
    with scratch(spark) as area:
        area.written, write = lambda df: written.append(write(df)) or written[-1], area.written
        rows = ranks.running_counts(one_feature(spark, values, g), "g", area).orderBy("value").collect()
        parts = written[0].groupBy("part").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("part").collect()
    assert len(parts) > 1 and max(r["n"] for r in parts) < 2 * len(values) / len(parts)
    assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:], strict=False))
    order = np.argsort(values)
    ones = np.cumsum(g[order])
    assert [r["b1"] + r["c1"] for r in rows] == ones.tolist() and [r["b0"] + r["c0"] for r in rows] == (np.arange(1, len(values) + 1) - ones).tolist()
    assert {(r["n0"], r["n1"]) for r in rows} == {(len(values) - int(ones[-1]), int(ones[-1]))}


QUANTILES = [[1.0], [2.0, 2.0, 2.0], [0.5, -3.0, 8.0, 8.0, 1e12], list(range(101)), [k % 7 for k in range(60)], [(k * 7919 % 60_000) ** 1.5 for k in range(60_000)], [k % 5 for k in range(50_000)]]


@pytest.mark.parametrize("values", QUANTILES)
def test_quantiles_are_exact(spark, values):
    with scratch(spark) as area:
        counts, quantiles = ranks.quantile_counts(one_feature(spark, values), "g", 10, area)
        assert counts.agg(F.sum("c0")).first()[0] == len(values)
        assert len(values) < ranks.WHOLE or counts.count() < len(values) / 50  # few values are counted one by one
        got = statistics.quantile_edges(counts, quantiles).first()["edges"]
    assert got == pytest.approx(sorted(set(np.round(np.quantile(np.array(values, dtype=float), np.arange(11) / 10), 9))))


def test_a_bracket_that_misses_is_found_out(spark, monkeypatch):
    """Were a sketch wrong, its feature would be counted again as a whole."""
    values = [(k * 7919 % 30_000) / 3 for k in range(30_000)]
    monkeypatch.setattr(ranks, "SLACK", -0.01)
    with scratch(spark) as area:
        _, quantiles = ranks.quantile_counts(one_feature(spark, values), "g", 10, area)
    assert quantiles["x"] == pytest.approx(np.quantile(np.array(values), np.arange(11) / 10))


def test_psi_and_woe_beyond_whole_features(spark):
    """Bins from brackets are those of all values."""
    rng = np.random.default_rng(8)
    a, b = np.round(rng.normal(0, 1, 30_000), 3), np.round(rng.normal(0.3, 1, 20_000), 3)
    edges = np.unique(np.round(np.quantile(a, np.arange(11) / 10), 9))
    inner = [-np.inf, *edges[1:-1], np.inf]
    p, q = np.histogram(a, inner)[0] / len(a) + 1e-6, np.histogram(b, inner)[0] / len(b) + 1e-6
    assert psi_of(spark, a, b) == pytest.approx(float(np.sum((q - p) * np.log(q / p))), abs=1e-4)
    y = rng.integers(0, 2, len(a))
    df = spark.createDataFrame([(float(v), int(t)) for v, t in zip(a, y, strict=True)], "x double, y int")
    bins = np.maximum(1, np.searchsorted(edges, a, side="left"))
    assert {(r["bin"], r["n"], r["bad"]) for r in statistics.woe_numeric(df, ["x"], "y").collect()} == {(int(k), int((bins == k).sum()), int(y[bins == k].sum())) for k in set(bins.tolist())}


def test_scenarios_of_a_configuration(spark):
    scenarios = portfolio.scenarios_from({"calm": {}, "bad": {"pd_multiplier": "2", "lgd_multiplier": 1.2, "description": "x"}})
    assert scenarios == [("calm", 1.0, 1.0), ("bad", 2.0, 1.2)]
    book = scoring.add_expected_loss(spark.createDataFrame([(1, 0.1, 100.0)], "id int, pd_score double, AMT_CREDIT double"))
    assert {r["scenario"]: round(r["total_el"], 6) for r in portfolio.stress_test(book, scenarios).collect()} == {"calm": 4.5, "bad": 10.8}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "x double, y int")
    assert statistics.kruskal_ranking(none, ["x"], "y").count() == 0
    assert statistics.psi(none, none, ["x", "absent"]).count() == 0
    assert statistics.woe_numeric(none, ["x"], "y").count() == 0
