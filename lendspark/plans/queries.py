"""Queries over the given tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, scoring
from ..operators import aggregates, eda, ml, portfolio, statistics
from ..sources import tables as sources
from ..sources.kafka import decision_tally, decode, encode
from ..sources.scratch import scratch
from ..streaming import jobs
from . import loanbook

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NUMERIC = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "DAYS_BIRTH", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
CATEGORICAL = ["NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE"]
DRIFT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_shifted"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Sums and means differ in their last bits between engines; so values are rounded at the end."""
    return df.withColumns({c: F.round(c, digits) for c in names})


def as_decimals(df: DataFrame, *names: str) -> DataFrame:
    """Rounded to six digits as decimals, which have a middle between two results that all engines see alike."""
    return df.withColumns({c: F.round(F.col(c).cast("decimal(38,9)"), 6).cast("double") for c in names})


def _doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]


def _book(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_book(loanbook.loans(spark, d))


def _aggregate(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = aggregates.CHILDREN[name](loanbook.CHILDREN[name](spark, d))
        return as_decimals(out, *_doubles(out))

    return run


for _key, _name in {"agg_bureau": "bureau", "agg_previous": "previous_application", "agg_installments": "installments_payments", "agg_credit_card": "credit_card_balance", "agg_pos_cash": "pos_cash_balance"}.items():
    QUERIES[_key] = _aggregate(_name)


@query
def numeric_aggs(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.numeric_aggs(loanbook.table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice"), "l_returnflag")
    return rounded(out, 2, *_doubles(out))


@query
def tier_profile(spark: SparkSession, d: str) -> DataFrame:
    """Scored loans by tier."""
    return portfolio.tier_profile(_book(spark, d))


@query
def master_dataset(spark: SparkSession, d: str) -> DataFrame:
    """All five children on the anchor, and the ratio features."""
    children = {n: aggregates.CHILDREN[n](f(spark, d)) for n, f in loanbook.CHILDREN.items()}
    out = features.add_domain_features(aggregates.build_master(loanbook.loans(spark, d), children))
    names = ["SK_ID_CURR", "TARGET", "BUREAU_COUNT", "BUREAU_AMT_DEBT_SUM", "PREV_APPROVED_COUNT", "PREV_CNT_PAYMENT_MEAN", "INSTAL_DPD_MAX", "INSTAL_LATE_COUNT", "CC_UTILIZATION_MEAN", "POS_LATE_MONTHS", "FEAT_DEBT_INCOME_RATIO"]
    # Missing children leave nulls; so counts are given as doubles.
    out = out.select("SK_ID_CURR", "TARGET", *[F.col(c).cast("double").alias(c) for c in names[2:]])
    return as_decimals(out, *_doubles(out))


@query
def domain_features(spark: SparkSession, d: str) -> DataFrame:
    out = features.add_domain_features(loanbook.loans(spark, d))
    out = out.select("SK_ID_CURR", *[c for c in out.columns if c.startswith("FEAT_")])
    return rounded(out, 6, *_doubles(out))


@query
def split_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """The loans of a split that is given by its ids: those of urgent orders."""
    ids = loanbook.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("SK_ID_CURR"))
    return aggregates.restrict_to(loanbook.loans(spark, d).select("SK_ID_CURR", "TARGET", "AMT_CREDIT"), ids)


@query
def null_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.null_rates(loanbook.loans(spark, d)), 6, "null_rate")


@query
def null_rates_top(spark: SparkSession, d: str) -> DataFrame:
    """The 20 columns with most nulls: a top-k report."""
    rates = features.null_rates(loanbook.loans(spark, d)).select("feature", "n_null", "null_rate")
    return rounded(rates.orderBy(F.desc("n_null"), "feature").limit(20), 6, "null_rate")


@query
def categorical_columns(spark: SparkSession, d: str) -> DataFrame:
    return features.categorical_columns(loanbook.table(spark, d, "lineitem").join(loanbook.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.expr("l_orderkey = o_orderkey")))


@query
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    out = features.add_class_weights(loanbook.loans(spark, d), "TARGET")
    return out.groupBy("TARGET").agg(F.count("*").alias("n"), F.round(F.max("class_weight"), 6).alias("class_weight"))


@query
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows and positives of a 70 / 15 / 15 split by digest of the key."""
    return features.hash_split(loanbook.loans(spark, d), "SK_ID_CURR").groupBy("split").agg(F.count("*").alias("n"), F.sum("TARGET").alias("n_positive"))


@query
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the loans: a sampling operator."""
    return features.hash_sample(loanbook.loans(spark, d), "SK_ID_CURR", 0.1).select("SK_ID_CURR", "TARGET", "AMT_CREDIT")


@query
def random_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a seeded random split, 70 / 15 / 15."""
    parts = loanbook.loans(spark, d).select("SK_ID_CURR").randomSplit([0.7, 0.15, 0.15], seed=42)
    out = None
    for k, part in enumerate(parts):
        row = part.agg(F.lit(k).alias("part"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def heuristic_pd(spark: SparkSession, d: str) -> DataFrame:
    return loanbook.loans(spark, d).select("SK_ID_CURR", F.round(scoring.heuristic_pd(), 6).alias("pd_score"))


@query
def heuristic_pd_batch(spark: SparkSession, d: str) -> DataFrame:
    return loanbook.loans(spark, d).select("SK_ID_CURR", F.round(scoring.heuristic_pd(employment=False, no_income=0.0), 6).alias("pd_score"))


@query
def risk_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _book(spark, d).select("SK_ID_CURR", "risk_tier")


@query
def decisions(spark: SparkSession, d: str) -> DataFrame:
    return _book(spark, d).select("SK_ID_CURR", scoring.decision(F.col("risk_tier")).alias("decision"))


@query
def expected_loss(spark: SparkSession, d: str) -> DataFrame:
    return _book(spark, d).select("SK_ID_CURR", "lgd", F.round("ead", 2).alias("ead"), F.round("expected_loss", 2).alias("expected_loss"))


@query
def segmentation_summary(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.segmentation(_book(spark, d))


@query
def portfolio_overview(spark: SparkSession, d: str) -> DataFrame:
    out = portfolio.overview(_book(spark, d))
    return rounded(rounded(out, 2, "total_ead", "total_expected_loss", "unexpected_loss", "economic_capital"), 6, "avg_pd", "avg_lgd", "actual_default_rate", "el_rate")


@query
def tier_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.tier_breakdown(_book(spark, d))


@query
def stress_customer(spark: SparkSession, d: str) -> DataFrame:
    out = portfolio.stressed(_book(spark, d)).select("SK_ID_CURR", "scenario", "stressed_pd", "stressed_lgd", "stressed_el")
    return as_decimals(rounded(out, 9, "stressed_pd", "stressed_lgd"), "stressed_el")


@query
def stress_test(spark: SparkSession, d: str) -> DataFrame:
    out = portfolio.stress_test(_book(spark, d))
    return rounded(rounded(out, 2, "total_ead", "total_el", "capital_required"), 6, "avg_pd", "avg_lgd", "el_rate_pct")


@query
def stress_comparison(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.stress_comparison(portfolio.stress_test(_book(spark, d)))


@query
def woe_numeric(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.woe_numeric(loanbook.loans(spark, d), NUMERIC, "TARGET")
    return rounded(out, 4, "woe", "iv_part", "iv").withColumn("bin", F.col("bin").cast("int"))


@query
def woe_categorical(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.woe_categorical(loanbook.loans(spark, d), CATEGORICAL, "TARGET"), 4, "woe", "iv_part", "iv")


@query
def iv_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.iv_table(loanbook.loans(spark, d), NUMERIC, CATEGORICAL, "TARGET", least=0.0), 4, "iv")


@query
def kruskal_ranking(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.kruskal_ranking(loanbook.loans(spark, d), NUMERIC, "TARGET")
    return out.select("feature", "n", "h", "rank")


@query
def kruskal_significance(spark: SparkSession, d: str) -> DataFrame:
    """With p values: the features under 5 %."""
    return rounded(statistics.kruskal_ranking(loanbook.loans(spark, d), NUMERIC, "TARGET"), 9, "p_value")


@query
def psi_drift(spark: SparkSession, d: str) -> DataFrame:
    return statistics.psi(*loanbook.drift_pair(spark, d), DRIFT)


@query
def ks_drift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.ks_two_sample(*loanbook.drift_pair(spark, d), DRIFT).select("feature", "n_ref", "n_cur", "ks"), 6, "ks")


@query
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.drift_report(*loanbook.drift_pair(spark, d), DRIFT)
    return rounded(out, 4, "mean_ref", "mean_cur", "std_ref", "std_cur")


@query
def drift_summary(spark: SparkSession, d: str) -> DataFrame:
    return statistics.drift_summary(statistics.psi(*loanbook.drift_pair(spark, d), DRIFT))


@query
def retraining_decision(spark: SparkSession, d: str) -> DataFrame:
    return statistics.retraining_decision(statistics.psi(*loanbook.drift_pair(spark, d), DRIFT))


@query
def js_drift(spark: SparkSession, d: str) -> DataFrame:
    return statistics.categorical_drift(*loanbook.drift_pair(spark, d), ["l_returnflag", "l_linestatus"])


@query
def new_categories(spark: SparkSession, d: str) -> DataFrame:
    return statistics.new_categories(*loanbook.drift_pair(spark, d), ["l_returnflag", "l_linestatus"])


@query
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of the heuristic score, rounded, at a threshold of 0.2."""
    scored = loanbook.loans(spark, d).select("TARGET", F.round(scoring.heuristic_pd(), 6).alias("pd_score"))
    return statistics.classification_metrics(scored, "TARGET", "pd_score", 0.2)


@query
def table_overview(spark: SparkSession, d: str) -> DataFrame:
    return sources.table_overview({t: loanbook.table(spark, d, t) for t in TABLES})


@query
def target_distribution(spark: SparkSession, d: str) -> DataFrame:
    return eda.target_distribution(loanbook.loans(spark, d), "TARGET")


@query
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = loanbook.loans(spark, d).selectExpr("TARGET", "EXT_SOURCE_2", "-DAYS_BIRTH AS AGE_DAYS", "AMT_CREDIT")
    out = eda.class_histogram(rows, "TARGET", ["EXT_SOURCE_2", "AGE_DAYS", "AMT_CREDIT"])
    # The area under a class's bars is 1; densities of amounts are tiny.
    return rounded(out, 12, "density")


@query
def target_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.target_correlation(loanbook.loans(spark, d), "TARGET", NUMERIC), 6, "abs_corr")


@query
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(eda.correlations(loanbook.loans(spark, d), NUMERIC), 6, "corr")


@query
def default_rate_by_category(spark: SparkSession, d: str) -> DataFrame:
    return eda.default_rate_by_category(loanbook.loans(spark, d), CATEGORICAL, "TARGET")


@query
def windowed_stats(spark: SparkSession, d: str) -> DataFrame:
    """The batch twin of the streaming window, by day of the events."""
    scored = jobs.score_stream(loanbook.applications(spark, d), event_time="event_time")
    out = jobs.windowed_stats(scored, "1 day", late=None)
    return out.withColumns({"window_start": F.date_format("window_start", "yyyy-MM-dd"), "window_end": F.date_format("window_end", "yyyy-MM-dd")})


@query
def kafka_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Applications written as messages, decoded again, scored, encoded and tallied by decision."""
    rows = loanbook.applications(spark, d)
    messages = rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "event_time"])).cast("binary").alias("value"), F.col("event_time").alias("timestamp"), F.lit(0).alias("partition"), F.col("SK_ID_CURR").alias("offset"))
    scored = scoring.score_applications(decode(messages)).withColumn("scored_at", F.col("kafka_timestamp"))
    return decision_tally(encode(scored))


def _small_gbt() -> dict:
    return {"maxIter": 5, "maxDepth": 3, "subsamplingRate": 0.8}


@query
def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Size and sum of each loan's assembled vector."""
    from pyspark.ml.functions import vector_to_array

    _, out = ml.fit_and_transform(loanbook.loans(spark, d), NUMERIC, CATEGORICAL)
    v = vector_to_array("features")
    return out.select("SK_ID_CURR", F.size(v).alias("n_slots"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query
def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    loans = features.hash_split(loanbook.loans(spark, d), "SK_ID_CURR")
    model = ml.train(loans.where("split = 0"), NUMERIC, CATEGORICAL, "TARGET", "gbt", **_small_gbt())
    return ml.scores(model, loans.where("split <> 0")).select("SK_ID_CURR", F.round("pd_score", 6).alias("pd_score"))


@query
def train_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A logistic model on the held-out part, the best of the whole grid in cross-validation."""
    loans = features.hash_split(loanbook.loans(spark, d), "SK_ID_CURR")
    model = ml.train(loans.where("split = 0"), NUMERIC, CATEGORICAL, "TARGET", "logistic", grid=ml.GRIDS["logistic"])
    return ml.evaluate(ml.scores(model, loans.where("split = 2")), "TARGET")


@query
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Three models, stored and loaded again, by their area under the ROC curve."""
    loans = features.hash_split(loanbook.loans(spark, d), "SK_ID_CURR")
    part = loans.where("split = 0")
    params = {"logistic": {"maxIter": 10}, "random_forest": {"numTrees": 5, "maxDepth": 4}, "gbt": _small_gbt()}
    models = ml.train_several(part, NUMERIC, CATEGORICAL, {name: ml.classifier(name, "TARGET", **p) for name, p in params.items()})
    with scratch(spark) as area:
        stored = {name: ml.save_model(model, area.path, name) for name, model in models.items()}
        return ml.compare_models(stored, loans.where("split = 2"), "TARGET")


@query
def ablation(spark: SparkSession, d: str) -> DataFrame:
    """Logistic models with default parameters; what isn't held out is trained on."""
    children = {n: aggregates.CHILDREN[n](f(spark, d)) for n, f in loanbook.CHILDREN.items()}
    loans = features.hash_split(loanbook.loans(spark, d), "SK_ID_CURR")
    ids = loans.select("SK_ID_CURR", "split")
    return ml.ablation(loans.drop("split"), children, ids.where("split < 2").drop("split"), ids.where("split = 2").drop("split"), "TARGET", NUMERIC, "logistic")


@query
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    loans = loanbook.loans(spark, d)
    model = ml.train(loans, NUMERIC, CATEGORICAL, "TARGET", "gbt", **_small_gbt())
    return ml.feature_importance(model, model.transform(loans))


@query
def row_explanations(spark: SparkSession, d: str) -> DataFrame:
    """With fixed importances: the three main drivers of each loan."""
    weights = {"AMT_CREDIT": 0.4, "AMT_INCOME_TOTAL": 0.3, "DAYS_BIRTH": 0.2, "NAME_INCOME_TYPE": 0.1}
    out = ml.row_explanations(loanbook.loans(spark, d), "SK_ID_CURR", weights, ["AMT_CREDIT", "AMT_INCOME_TOTAL", "DAYS_BIRTH"], top_k=3)
    return rounded(out, 6, "impact")
