"""DuckDB SQL for each query that SQL can express."""

from __future__ import annotations

LOAN = """
loan AS (
  SELECT o_orderkey AS SK_ID_CURR, CAST(o_orderstatus = 'F' AS INT) AS TARGET, o_totalprice AS AMT_CREDIT, c_acctbal * 12 AS AMT_INCOME_TOTAL,
    o_totalprice / (12 + o_orderkey % 48) AS AMT_ANNUITY,
    CASE WHEN o_orderkey % 50 = 0 THEN 0::DOUBLE ELSE o_totalprice * 0.9::DOUBLE END AS AMT_GOODS_PRICE,
    o_orderpriority AS NAME_CONTRACT_TYPE, c_mktsegment AS NAME_INCOME_TYPE,
    CAST(-(7300 + (o_custkey * 37) % 17700) AS INT) AS DAYS_BIRTH,
    CAST(CASE WHEN o_custkey % 6 = 0 THEN 365243 ELSE -((o_orderkey * 13) % 8000) END AS INT) AS DAYS_EMPLOYED,
    CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 101) / 100::DOUBLE END AS EXT_SOURCE_1,
    CASE WHEN o_orderkey % 10 <> 0 THEN (o_custkey % 97) / 96::DOUBLE END AS EXT_SOURCE_2,
    CASE WHEN o_orderkey % 5 <> 0 THEN ((o_orderkey * 7) % 89) / 88::DOUBLE END AS EXT_SOURCE_3
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _pd(no_income: str, employment: bool) -> str:
    debt = f"(CASE WHEN AMT_INCOME_TOTAL > 0 THEN AMT_CREDIT / AMT_INCOME_TOTAL ELSE {no_income}::DOUBLE END)"
    ext = "((coalesce(EXT_SOURCE_1, 0.5::DOUBLE) + coalesce(EXT_SOURCE_2, 0.5::DOUBLE) + coalesce(EXT_SOURCE_3, 0.5::DOUBLE)) / 3::DOUBLE)"
    score = f"0.08::DOUBLE + CASE WHEN {debt} > 5 THEN 0.08::DOUBLE WHEN {debt} > 3 THEN 0.04::DOUBLE ELSE -0.02::DOUBLE END + (0.5::DOUBLE - {ext}) * 0.3::DOUBLE"
    if employment:
        score += " + CASE WHEN DAYS_EMPLOYED = 365243 THEN 0.12::DOUBLE WHEN DAYS_EMPLOYED > -365 THEN 0.04::DOUBLE ELSE -0.03::DOUBLE END"
    return f"greatest(0.001::DOUBLE, least(0.999::DOUBLE, {score}))"


PD = _pd("5.0", True)
TIER = "CASE WHEN pd_score < 0.10::DOUBLE THEN 'Low Risk' WHEN pd_score < 0.20::DOUBLE THEN 'Medium Risk' WHEN pd_score < 0.35::DOUBLE THEN 'High Risk' ELSE 'Very High Risk' END"
BOOK = f"""{LOAN}, scored AS (SELECT *, {PD} AS pd_score FROM loan),
book AS (SELECT *, {TIER} AS risk_tier, 0.45::DOUBLE AS lgd, AMT_CREDIT AS ead, pd_score * 0.45::DOUBLE * AMT_CREDIT AS expected_loss FROM scored)"""
TIERS = "tiers AS (SELECT * FROM (VALUES (0, 'Low Risk'), (1, 'Medium Risk'), (2, 'High Risk'), (3, 'Very High Risk')) t(tier_order, risk_tier))"
LINES = "lines AS (SELECT l.*, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"

AGGS = {
    "bureau": """SELECT l_orderkey AS SK_ID_CURR, count(*) AS BUREAU_COUNT, count(*) FILTER (l_linestatus = 'O') AS BUREAU_ACTIVE_COUNT,
      count(*) FILTER (l_linestatus = 'F') AS BUREAU_CLOSED_COUNT, CAST(round(CAST(avg(greatest(0, days - 60)) AS DECIMAL(38,9)), 6) AS DOUBLE) AS BUREAU_DAY_OVERDUE_MEAN,
      CAST(round(CAST(sum(l_extendedprice) AS DECIMAL(38,9)), 6) AS DOUBLE) AS BUREAU_AMT_CREDIT_SUM, CAST(round(CAST(sum(l_extendedprice * l_discount) AS DECIMAL(38,9)), 6) AS DOUBLE) AS BUREAU_AMT_DEBT_SUM,
      CAST(round(CAST(sum(l_extendedprice * l_tax) AS DECIMAL(38,9)), 6) AS DOUBLE) AS BUREAU_AMT_OVERDUE_SUM, CAST(round(CAST(avg(-days) AS DECIMAL(38,9)), 6) AS DOUBLE) AS BUREAU_DAYS_CREDIT_MEAN FROM lines GROUP BY 1""",
    "previous": """SELECT l_orderkey AS SK_ID_CURR, count(*) AS PREV_APP_COUNT, count(*) FILTER (l_returnflag = 'A') AS PREV_APPROVED_COUNT,
      count(*) FILTER (l_returnflag = 'R') AS PREV_REFUSED_COUNT, CAST(round(CAST(avg(l_extendedprice) AS DECIMAL(38,9)), 6) AS DOUBLE) AS PREV_AMT_APP_MEAN,
      CAST(round(CAST(avg(l_extendedprice * (1 - l_discount)) AS DECIMAL(38,9)), 6) AS DOUBLE) AS PREV_AMT_CREDIT_MEAN, CAST(round(CAST(avg(l_extendedprice * l_tax) AS DECIMAL(38,9)), 6) AS DOUBLE) AS PREV_DOWN_PAYMENT_MEAN,
      CAST(round(CAST(avg(-days) AS DECIMAL(38,9)), 6) AS DOUBLE) AS PREV_DAYS_DECISION_MEAN, CAST(round(CAST(avg(l_quantity) AS DECIMAL(38,9)), 6) AS DOUBLE) AS PREV_CNT_PAYMENT_MEAN FROM lines GROUP BY 1""",
    "installments": """SELECT l_orderkey AS SK_ID_CURR, count(*) AS INSTAL_COUNT, CAST(round(CAST(avg(days - 60) AS DECIMAL(38,9)), 6) AS DOUBLE) AS INSTAL_DPD_MEAN, CAST(max(days - 60) AS INT) AS INSTAL_DPD_MAX,
      count(*) FILTER (days - 60 > 0) AS INSTAL_LATE_COUNT, CAST(round(CAST(avg(l_extendedprice * (1 - l_discount + l_tax) - l_extendedprice) AS DECIMAL(38,9)), 6) AS DOUBLE) AS INSTAL_PAYMENT_DIFF_MEAN,
      count(*) FILTER (l_extendedprice * (1 - l_discount + l_tax) - l_extendedprice < 0) AS INSTAL_UNDERPAY_COUNT FROM lines GROUP BY 1""",
    "credit_card": """SELECT l_orderkey AS SK_ID_CURR, count(*) AS CC_MONTHS_COUNT, CAST(round(CAST(avg(l_extendedprice) AS DECIMAL(38,9)), 6) AS DOUBLE) AS CC_BALANCE_MEAN, CAST(round(CAST(avg(l_discount * 100000) AS DECIMAL(38,9)), 6) AS DOUBLE) AS CC_CREDIT_LIMIT_MEAN,
      CAST(round(CAST(avg(l_extendedprice / nullif(l_discount * 100000, 0)) AS DECIMAL(38,9)), 6) AS DOUBLE) AS CC_UTILIZATION_MEAN, CAST(round(CAST(avg(l_extendedprice * l_tax) AS DECIMAL(38,9)), 6) AS DOUBLE) AS CC_PAYMENT_MEAN,
      CAST(sum(greatest(0, days - 60)) AS BIGINT) AS CC_DPD_SUM FROM lines GROUP BY 1""",
    "pos_cash": """SELECT l_orderkey AS SK_ID_CURR, count(*) AS POS_MONTHS_COUNT, CAST(round(CAST(avg(l_quantity) AS DECIMAL(38,9)), 6) AS DOUBLE) AS POS_CNT_INSTALMENT_MEAN, CAST(round(CAST(avg(l_quantity - l_linenumber) AS DECIMAL(38,9)), 6) AS DOUBLE) AS POS_CNT_FUTURE_MEAN,
      CAST(max(greatest(0, days - 60)) AS INT) AS POS_DPD_MAX, count(*) FILTER (days - 60 > 0) AS POS_LATE_MONTHS FROM lines GROUP BY 1""",
}
ORACLES: dict[str, str] = {f"agg_{k}": f"WITH {LINES} {sql}" for k, sql in AGGS.items()}

ORACLES["numeric_aggs"] = "SELECT l_returnflag, " + ", ".join(
    f"{'round(avg(' + c + '), 2)' if k == 'MEAN' else ('round(sum(' + c + '), 2)' if c != 'l_linenumber' else 'CAST(sum(' + c + ') AS BIGINT)') if k == 'SUM' else k.lower() + '(' + c + ')'} AS {c}_{k}"
    for c in ("l_linenumber", "l_quantity", "l_extendedprice")
    for k in ("MEAN", "SUM", "MIN", "MAX")
) + " FROM lineitem GROUP BY 1"

ORACLES["tier_profile"] = f"WITH {BOOK} SELECT risk_tier, count(*) AS n, round(avg(pd_score), 4) AS avg_pd, round(sum(expected_loss), 0) AS total_el FROM book GROUP BY 1"

ORACLES["master_dataset"] = f"""WITH {LOAN}, {LINES}, b AS ({AGGS['bureau']}), p AS ({AGGS['previous']}), i AS ({AGGS['installments']}), c AS ({AGGS['credit_card']}), s AS ({AGGS['pos_cash']})
SELECT SK_ID_CURR, TARGET, BUREAU_COUNT::DOUBLE AS BUREAU_COUNT, BUREAU_AMT_DEBT_SUM, PREV_APPROVED_COUNT::DOUBLE AS PREV_APPROVED_COUNT, PREV_CNT_PAYMENT_MEAN, INSTAL_DPD_MAX::DOUBLE AS INSTAL_DPD_MAX,
  INSTAL_LATE_COUNT::DOUBLE AS INSTAL_LATE_COUNT, CC_UTILIZATION_MEAN, POS_LATE_MONTHS::DOUBLE AS POS_LATE_MONTHS,
  CAST(round(CAST(CASE WHEN AMT_INCOME_TOTAL > 0 THEN AMT_CREDIT / AMT_INCOME_TOTAL ELSE 0 END AS DECIMAL(38,9)), 6) AS DOUBLE) AS FEAT_DEBT_INCOME_RATIO
FROM loan LEFT JOIN b USING (SK_ID_CURR) LEFT JOIN p USING (SK_ID_CURR) LEFT JOIN i USING (SK_ID_CURR) LEFT JOIN c USING (SK_ID_CURR) LEFT JOIN s USING (SK_ID_CURR)"""

ORACLES["domain_features"] = f"""WITH {LOAN} SELECT SK_ID_CURR,
  round(CASE WHEN AMT_INCOME_TOTAL > 0 THEN AMT_CREDIT / AMT_INCOME_TOTAL ELSE 0 END, 6) AS FEAT_DEBT_INCOME_RATIO,
  round(CASE WHEN AMT_INCOME_TOTAL > 0 THEN AMT_ANNUITY * 12 / AMT_INCOME_TOTAL ELSE 0 END, 6) AS FEAT_ANNUITY_INCOME_RATIO,
  round(CASE WHEN AMT_GOODS_PRICE > 0 THEN AMT_CREDIT / AMT_GOODS_PRICE ELSE 1 END, 6) AS FEAT_CREDIT_GOODS_RATIO,
  round(CASE WHEN AMT_ANNUITY > 0 THEN AMT_CREDIT / AMT_ANNUITY ELSE 0 END, 6) AS FEAT_CREDIT_TERM,
  round(CASE WHEN DAYS_BIRTH < 0 AND DAYS_EMPLOYED <> 365243 THEN DAYS_EMPLOYED / DAYS_BIRTH::DOUBLE ELSE 0 END, 6) + 0::DOUBLE AS FEAT_EMPLOYMENT_RATIO,
  round((coalesce(EXT_SOURCE_1, 0.5::DOUBLE) + coalesce(EXT_SOURCE_2, 0.5::DOUBLE) + coalesce(EXT_SOURCE_3, 0.5::DOUBLE)) / 3, 6) AS FEAT_EXT_SOURCE_MEAN
FROM loan"""

ORACLES["split_semi_join"] = f"WITH {LOAN} SELECT SK_ID_CURR, TARGET, AMT_CREDIT FROM loan WHERE SK_ID_CURR IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"

LOAN_COLUMNS = "SK_ID_CURR TARGET AMT_CREDIT AMT_INCOME_TOTAL AMT_ANNUITY AMT_GOODS_PRICE NAME_CONTRACT_TYPE NAME_INCOME_TYPE DAYS_BIRTH DAYS_EMPLOYED EXT_SOURCE_1 EXT_SOURCE_2 EXT_SOURCE_3".split()
_NULLS = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_rate, (count(*) - count({c})) / count(*)::DOUBLE < 0.5 AS kept FROM loan" for c in LOAN_COLUMNS)
ORACLES["null_rates"] = f"WITH {LOAN} {_NULLS}"
ORACLES["null_rates_top"] = f"WITH {LOAN} SELECT feature, n_null, null_rate FROM ({_NULLS}) ORDER BY n_null DESC, feature LIMIT 20"

ORACLES["categorical_columns"] = "SELECT feature, n_distinct FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    for c in ("l_returnflag", "l_linestatus", "o_orderpriority")
) + ") WHERE n_distinct BETWEEN 2 AND 20"

ORACLES["class_weights"] = f"""WITH {LOAN}, n AS (SELECT count(*) AS a, count(*) FILTER (TARGET = 1) AS p, count(*) FILTER (TARGET = 0) AS q FROM loan)
SELECT TARGET, count(*) AS n, round(max(CASE WHEN p = 0 OR q = 0 THEN 1 ELSE a / (2.0::DOUBLE * CASE WHEN TARGET = 1 THEN p ELSE q END) END), 6) AS class_weight FROM loan, n GROUP BY 1"""

ORACLES["heuristic_pd"] = f"WITH {LOAN} SELECT SK_ID_CURR, round({PD}, 6) AS pd_score FROM loan"
ORACLES["heuristic_pd_batch"] = f"WITH {LOAN} SELECT SK_ID_CURR, round({_pd('0', False)}, 6) AS pd_score FROM loan"
ORACLES["risk_tiers"] = f"WITH {BOOK} SELECT SK_ID_CURR, risk_tier FROM book"
DECISION = "CASE WHEN risk_tier IN ('Low Risk', 'Medium Risk') THEN 'APPROVE' WHEN risk_tier = 'High Risk' THEN 'REVIEW' ELSE 'REJECT' END"
ORACLES["decisions"] = f"WITH {BOOK} SELECT SK_ID_CURR, {DECISION} AS decision FROM book"
ORACLES["expected_loss"] = f"WITH {BOOK} SELECT SK_ID_CURR, lgd, round(ead, 2) AS ead, round(expected_loss, 2) AS expected_loss FROM book"

_BY_TIER = f"{BOOK}, {TIERS}, c AS (SELECT risk_tier, count(*) AS n, sum(ead) AS ead, sum(expected_loss) AS el, avg(pd_score) AS pd FROM book GROUP BY 1), n AS (SELECT sum(n) AS n_all FROM c)"
ORACLES["segmentation_summary"] = f"WITH {_BY_TIER} SELECT tier_order, risk_tier, coalesce(n, 0) AS count, coalesce(round(n * 100::DOUBLE / n_all, 2), 0) AS pct FROM tiers LEFT JOIN c USING (risk_tier), n"
ORACLES["tier_breakdown"] = f"""WITH {_BY_TIER} SELECT tier_order, risk_tier, coalesce(n, 0) AS count, coalesce(round(n * 100::DOUBLE / n_all, 2), 0) AS pct_customers,
  round(coalesce(ead, 0) / 1e6, 2) AS ead_m, round(coalesce(el, 0) / 1e6, 2) AS el_m, CASE WHEN ead > 0 THEN round(el / ead * 100, 2) ELSE 0 END AS el_rate_pct, coalesce(round(pd, 4), 0) AS avg_pd
FROM tiers LEFT JOIN c USING (risk_tier), n"""
ORACLES["portfolio_overview"] = f"""WITH {BOOK}, a AS (SELECT count(*) AS n, sum(ead) AS ead, sum(expected_loss) AS el, avg(pd_score) AS pd, avg(lgd) AS lgd, avg(TARGET) AS dr FROM book)
SELECT n AS total_customers, round(ead, 2) AS total_ead, round(el, 2) AS total_expected_loss, round(pd, 6) AS avg_pd, round(lgd, 6) AS avg_lgd, round(dr, 6) AS actual_default_rate, round(el / ead, 6) AS el_rate,
  CASE WHEN el / ead < 0.01 THEN 'very healthy' WHEN el / ead < 0.03 THEN 'healthy' WHEN el / ead < 0.05 THEN 'moderate' WHEN el / ead < 0.10 THEN 'elevated' ELSE 'high' END AS el_band,
  round(3 * el, 2) AS unexpected_loss, round(4.5::DOUBLE * el, 2) AS economic_capital FROM a"""

_STRESS = f"""{BOOK}, sc AS (SELECT * FROM (VALUES (0, 'baseline', 1::DOUBLE, 1::DOUBLE), (1, 'mild_recession', 1.5::DOUBLE, 1.1::DOUBLE), (2, 'severe', 2.5::DOUBLE, 1.3::DOUBLE), (3, 'black_swan', 4::DOUBLE, 1.5::DOUBLE)) t(scenario_order, scenario, pd_multiplier, lgd_multiplier)),
st AS (SELECT *, least(1::DOUBLE, pd_score * pd_multiplier) AS stressed_pd, least(1::DOUBLE, lgd * lgd_multiplier) AS stressed_lgd FROM book, sc),
se AS (SELECT *, stressed_pd * stressed_lgd * ead AS stressed_el FROM st)"""
ORACLES["stress_customer"] = f"WITH {_STRESS} SELECT SK_ID_CURR, scenario, round(stressed_pd, 9) AS stressed_pd, round(stressed_lgd, 9) AS stressed_lgd, CAST(round(CAST(stressed_el AS DECIMAL(38,9)), 6) AS DOUBLE) AS stressed_el FROM se"
ORACLES["stress_test"] = f"""WITH {_STRESS} SELECT scenario_order, scenario, pd_multiplier, lgd_multiplier, count(*) AS n, round(sum(ead), 2) AS total_ead, round(sum(stressed_el), 2) AS total_el,
  round(avg(stressed_pd), 6) AS avg_pd, round(avg(stressed_lgd), 6) AS avg_lgd, count(*) FILTER (stressed_pd >= 0.20::DOUBLE) AS customers_high_risk, count(*) FILTER (stressed_pd >= 0.50::DOUBLE) AS customers_default_zone,
  round(sum(stressed_el) / sum(ead) * 100, 6) AS el_rate_pct, round(3 * sum(stressed_el), 2) AS capital_required FROM se GROUP BY ALL"""
ORACLES["stress_comparison"] = f"""WITH {_STRESS}, t AS (SELECT scenario, sum(stressed_el) AS el FROM se GROUP BY 1), b AS (SELECT el AS b FROM t WHERE scenario = 'baseline')
SELECT scenario, round(el / b, 2) AS el_ratio, round((el - b) / 1e6, 2) AS added_loss_m FROM t, b WHERE scenario <> 'baseline' AND b > 0"""

NUMERIC = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "DAYS_BIRTH", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
CATEGORICAL = ["NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE"]


def _long(source: str, features: list[str], kind: str, *keep: str) -> str:
    cols = "".join(f"{k}, " for k in keep)
    return " UNION ALL ".join(f"SELECT {cols}'{c}' AS feature, CAST({c} AS {kind}) AS value FROM {source} WHERE {c} IS NOT NULL" for c in features)


_EDGES = "list_sort(list_distinct(list_transform(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]), lambda x: round(x, 9))))"
_WOE = """w AS (SELECT *, n - bad AS good FROM bins), g AS (SELECT feature, sum(n - bad) AS tg, sum(bad) AS tb, count(*) AS k FROM bins GROUP BY 1),
r AS (SELECT w.*, g.k, greatest(good::DOUBLE, 0.5::DOUBLE) / (tg + 0.5::DOUBLE) AS pg, greatest(bad::DOUBLE, 0.5::DOUBLE) / (tb + 0.5::DOUBLE) AS pb FROM w JOIN g USING (feature)),
v AS (SELECT *, ln(pg / pb) AS woe0, (pg - pb) * ln(pg / pb) AS part0, sum((pg - pb) * ln(pg / pb)) OVER (PARTITION BY feature) AS iv0 FROM r)"""
_NUM_BINS = f"""{LOAN}, x AS ({_long('loan', NUMERIC, 'DOUBLE', 'TARGET')}), e AS (SELECT feature, {_EDGES} AS edges FROM x GROUP BY 1),
bins AS (SELECT feature, CAST(greatest(1, len(list_filter(edges, lambda t: t < round(value, 9)))) AS INT) AS bin, count(*) AS n, CAST(sum(TARGET) AS BIGINT) AS bad FROM x JOIN e USING (feature) GROUP BY 1, 2)"""
_CAT_BINS = f"{LOAN}, x AS ({_long('loan', CATEGORICAL, 'VARCHAR', 'TARGET')}), bins AS (SELECT feature, value AS bin, count(*) AS n, CAST(sum(TARGET) AS BIGINT) AS bad FROM x GROUP BY 1, 2)"
_WOE_OUT = "SELECT feature, bin, n, good, bad, round(woe0, 4) AS woe, round(part0, 4) AS iv_part, round(iv0, 4) AS iv FROM v"
ORACLES["woe_numeric"] = f"WITH {_NUM_BINS}, {_WOE} {_WOE_OUT}"
ORACLES["woe_categorical"] = f"WITH {_CAT_BINS}, {_WOE} {_WOE_OUT}"
ORACLES["iv_ranking"] = f"""SELECT feature, kind, n_bins, round(iv0, 4) AS iv,
  CASE WHEN iv0 < 0.02 THEN 'useless' WHEN iv0 < 0.10 THEN 'weak' WHEN iv0 < 0.30 THEN 'medium' WHEN iv0 < 0.50 THEN 'strong' ELSE 'suspicious' END AS strength,
  CAST(row_number() OVER (ORDER BY iv0 DESC, feature) AS INT) AS rank FROM (
  SELECT feature, 'numeric' AS kind, count(*) AS n_bins, any_value(iv0) AS iv0 FROM (WITH {_NUM_BINS}, {_WOE} SELECT * FROM v) GROUP BY 1
  UNION ALL SELECT feature, 'categorical', count(*), any_value(iv0) FROM (WITH {_CAT_BINS}, {_WOE} SELECT * FROM v) GROUP BY 1)"""

ORACLES["kruskal_ranking"] = f"""WITH {LOAN}, x AS ({_long('loan', NUMERIC, 'DOUBLE', 'TARGET')}),
c AS (SELECT feature, value, count(*) FILTER (TARGET = 0) AS c0, count(*) FILTER (TARGET = 1) AS c1 FROM x GROUP BY 1, 2),
k AS (SELECT *, (c0 + c1)::DOUBLE AS t, coalesce(sum(c0 + c1) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c),
s AS (SELECT feature, sum(c0)::DOUBLE AS n0, sum(c1)::DOUBLE AS n1, sum(c0 * (b + (t + 1) / 2)) AS r0, sum(c1 * (b + (t + 1) / 2)) AS r1, sum(t * t * t - t) AS ties FROM k GROUP BY 1),
h AS (SELECT feature, CAST(n0 + n1 AS BIGINT) AS n, round((12 / ((n0 + n1) * (n0 + n1 + 1)) * (r0 * r0 / n0 + r1 * r1 / n1) - 3 * (n0 + n1 + 1)) / (1 - ties / ((n0 + n1) * (n0 + n1) * (n0 + n1) - (n0 + n1))), 2) AS h FROM s WHERE n0 > 0 AND n1 > 0 AND n0 + n1 >= 30)
SELECT feature, n, h, CAST(row_number() OVER (ORDER BY h DESC, feature) AS INT) AS rank FROM h"""

DRIFT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_shifted"]
_PAIR = """pair AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN l_extendedprice ELSE l_extendedprice * 1.3::DOUBLE END AS price_shifted,
  CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' AND l_returnflag = 'R' THEN 'X' ELSE l_returnflag END AS l_returnflag, l_linestatus, CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 0 ELSE 1 END AS g FROM lineitem)"""
_PSI = f"""{_PAIR}, x AS ({_long('pair', DRIFT, 'DOUBLE', 'g')}), e AS (SELECT feature, {_EDGES} AS edges FROM x WHERE g = 0 GROUP BY 1),
b AS (SELECT feature, len(edges) AS k, len(list_filter(edges[2:len(edges) - 1], lambda t: t <= round(value, 9))) AS bin, count(*) FILTER (g = 0) AS c0, count(*) FILTER (g = 1) AS c1 FROM x JOIN e USING (feature) GROUP BY 1, 2, 3),
n AS (SELECT *, c0 / sum(c0) OVER w + 1e-6 AS p, c1 / sum(c1) OVER w + 1e-6 AS q FROM b WINDOW w AS (PARTITION BY feature)),
psi0 AS (SELECT feature, k, CASE WHEN k >= 3 THEN sum((q - p) * ln(q / p)) ELSE 0 END AS raw FROM n GROUP BY 1, 2),
psi AS (SELECT feature, CAST(CASE WHEN k >= 3 THEN k - 1 ELSE 0 END AS BIGINT) AS n_bins, round(raw, 4) AS psi, CASE WHEN raw < 0.10 THEN 'none' WHEN raw < 0.25 THEN 'moderate' ELSE 'significant' END AS severity FROM psi0)"""
ORACLES["psi_drift"] = f"WITH {_PSI} SELECT * FROM psi"
_KS = """c AS (SELECT feature, value, count(*) FILTER (g = 0) AS c0, count(*) FILTER (g = 1) AS c1 FROM x GROUP BY 1, 2),
f AS (SELECT feature, sum(c0) OVER a AS n_ref, sum(c1) OVER a AS n_cur, abs(sum(c0) OVER o / (sum(c0) OVER a)::DOUBLE - sum(c1) OVER o / (sum(c1) OVER a)::DOUBLE) AS gap FROM c WINDOW a AS (PARTITION BY feature), o AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, max(gap) AS ks FROM f GROUP BY 1, 2, 3)"""
ORACLES["ks_drift"] = f"WITH {_PAIR}, x AS ({_long('pair', DRIFT, 'DOUBLE', 'g')}), {_KS} SELECT feature, n_ref, n_cur, round(ks, 6) AS ks FROM ks"
_LAM = "(ks * sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)))"
ORACLES["drift_report"] = f"""WITH {_PSI}, {_KS}, m AS (SELECT feature, avg(value) FILTER (g = 0) AS mr, avg(value) FILTER (g = 1) AS mc, stddev_pop(value) FILTER (g = 0) AS sr, stddev_pop(value) FILTER (g = 1) AS sc FROM x GROUP BY 1)
SELECT psi.*, n_ref, n_cur, round(ks, 4) AS ks, round(CASE WHEN {_LAM} <= 0 THEN 1::DOUBLE WHEN {_LAM} < 1
    THEN 1 - sqrt(2 * pi()) / {_LAM} * list_sum([exp(-pow(2 * i - 1, 2) * pi() * pi() / (8 * {_LAM} * {_LAM})) for i in range(1, 61)])
    ELSE greatest(0, least(1, list_sum([(CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END) * exp(-2::DOUBLE * i * i * {_LAM} * {_LAM}) for i in range(1, 61)]))) END, 6) AS ks_p,
  round(mr, 4) AS mean_ref, round(mc, 4) AS mean_cur, round(sr, 4) AS std_ref, round(sc, 4) AS std_cur FROM psi JOIN ks USING (feature) JOIN m USING (feature)"""
_NAMES = "array_to_string(list_sort(list(feature) FILTER (severity = '{}'))[1:5], ', ')"
ORACLES["drift_summary"] = f"""WITH {_PSI}, a AS (SELECT count(*) AS n, count(*) FILTER (severity <> 'none') AS k, count(*) FILTER (severity = 'significant') AS s, count(*) FILTER (severity = 'moderate') AS m,
  {_NAMES.format('significant')} AS sn, {_NAMES.format('moderate')} AS mn FROM psi)
SELECT n AS n_features, k AS n_drifting, CASE WHEN s > 0 THEN 'significant' WHEN m > 0 THEN 'moderate' ELSE 'none' END AS overall,
  concat_ws('; ', CASE WHEN s > 0 THEN 'retrain and look at the sources of: ' || sn END, CASE WHEN m > 0 THEN 'watch: ' || mn END, CASE WHEN s = 0 AND m = 0 THEN 'go on monitoring' END) AS recommendation FROM a"""
ORACLES["retraining_decision"] = f"""WITH {_PSI}, a AS (SELECT count(*) FILTER (psi >= 0.25) AS b, count(*) FILTER (psi >= 0.10 AND psi < 0.25) AS m,
  array_to_string(list_sort(list(feature) FILTER (psi >= 0.25)), ',') AS bn, array_to_string(list_sort(list(feature) FILTER (psi >= 0.10 AND psi < 0.25)), ',') AS mn FROM psi)
SELECT CASE WHEN b > 0 THEN 'RETRAIN_IMMEDIATE' WHEN m >= 3 THEN 'RETRAIN_SCHEDULED' ELSE 'CONTINUE_MONITORING' END AS action,
  CASE WHEN b > 0 THEN 'high' WHEN m >= 3 THEN 'medium' WHEN m > 0 THEN 'low' ELSE 'none' END AS severity, coalesce(CASE WHEN b > 0 THEN bn ELSE mn END, '') AS triggering_features FROM a"""
_CATS = f"{_PAIR}, x AS ({_long('pair', ['l_returnflag', 'l_linestatus'], 'VARCHAR', 'g')}), c AS (SELECT feature, value, count(*) FILTER (g = 0) AS c0, count(*) FILTER (g = 1) AS c1 FROM x GROUP BY 1, 2)"
ORACLES["js_drift"] = f"""WITH {_CATS}, p AS (SELECT *, c0 / (sum(c0) OVER w)::DOUBLE AS p, c1 / (sum(c1) OVER w)::DOUBLE AS q FROM c WINDOW w AS (PARTITION BY feature)),
j AS (SELECT feature, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2))) AS js, count(*) FILTER (c0 > 0) AS n_ref, count(*) FILTER (c1 > 0) AS n_cur,
  count(*) FILTER (c0 = 0) AS n_new, coalesce(array_to_string(list(value || '=' || c1 ORDER BY c1 DESC, value) FILTER (c0 = 0)[1:20], ','), '') AS new_categories FROM p GROUP BY 1)
SELECT feature, round(js, 4) AS js, CASE WHEN js < 0.05 THEN 'none' WHEN js < 0.15 THEN 'low' WHEN js < 0.30 THEN 'medium' ELSE 'high' END AS severity, n_ref, n_cur, n_new, new_categories FROM j"""
ORACLES["new_categories"] = f"WITH {_CATS} SELECT feature, value FROM c WHERE c0 = 0"

ORACLES["classification_metrics"] = f"""WITH {LOAN}, s AS (SELECT TARGET, round({PD}, 6) AS v FROM loan), c AS (SELECT v, count(*) FILTER (TARGET = 0) AS c0, count(*) FILTER (TARGET = 1) AS c1 FROM s GROUP BY 1),
k AS (SELECT *, sum(c0) OVER o AS f0, sum(c1) OVER o AS f1, (sum(c0) OVER ())::DOUBLE AS n0, (sum(c1) OVER ())::DOUBLE AS n1 FROM c WINDOW o AS (ORDER BY v)),
m AS (SELECT n0, n1, sum(c1 * (f0 + f1 - c0 - c1 + (c0 + c1 + 1) / 2::DOUBLE)) AS r1, max(abs(f0 / n0 - f1 / n1)) AS ks, coalesce(sum(c1) FILTER (v >= 0.2::DOUBLE), 0) AS tp, coalesce(sum(c0) FILTER (v >= 0.2::DOUBLE), 0) AS fp FROM k GROUP BY 1, 2)
SELECT CAST(n0 + n1 AS BIGINT) AS n, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 4) AS roc_auc, round(ks, 4) AS ks_statistic, round((tp + n0 - fp) / (n0 + n1), 4) AS accuracy,
  round(tp / nullif((tp + fp)::DOUBLE, 0), 4) AS precision, round(tp / n1, 4) AS recall, round(2 * tp / (tp + fp + n1), 4) AS f1 FROM m"""

ORACLES["table_overview"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS n_columns" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
ORACLES["target_distribution"] = f"WITH {LOAN}, c AS (SELECT TARGET, count(*) AS n FROM loan GROUP BY 1) SELECT TARGET, n, round(n * 100::DOUBLE / sum(n) OVER (), 4) AS pct, round(max(n) OVER () / n::DOUBLE, 4) AS imbalance FROM c"
ORACLES["class_histogram"] = f"""WITH {LOAN}, h AS (SELECT TARGET, EXT_SOURCE_2, -DAYS_BIRTH AS AGE_DAYS, AMT_CREDIT FROM loan), x AS ({_long('h', ['EXT_SOURCE_2', 'AGE_DAYS', 'AMT_CREDIT'], 'DOUBLE', 'TARGET')}),
e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM x GROUP BY 1),
b AS (SELECT feature, TARGET AS class, (hi - lo) / 30 AS width, CAST(CASE WHEN hi > lo THEN least(30, floor((value - lo) / ((hi - lo) / 30)) + 1) ELSE 1 END AS INT) AS bin, count(*) AS n FROM x JOIN e USING (feature) GROUP BY 1, 2, 3, 4)
SELECT feature, class, bin, n, round(CASE WHEN width > 0 THEN n / (sum(n) OVER (PARTITION BY feature, class) * width) END, 12) AS density FROM b"""
ORACLES["target_correlation"] = f"WITH {LOAN} SELECT feature, abs_corr FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, TARGET)), 6) AS abs_corr FROM loan" for c in NUMERIC) + ") WHERE abs_corr IS NOT NULL ORDER BY abs_corr DESC, feature LIMIT 10"
ORACLES["correlation_matrix"] = f"WITH {LOAN} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM loan" for i, a in enumerate(NUMERIC) for b in NUMERIC[i:])
ORACLES["default_rate_by_category"] = f"WITH {LOAN}, x AS ({_long('loan', CATEGORICAL, 'VARCHAR', 'TARGET')}) SELECT feature, value AS category, round(avg(TARGET), 6) AS default_rate, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) > 100"

_APPS = f"""a AS (SELECT event_id AS SK_ID_CURR, ts, value * 1000 / 7 AS AMT_CREDIT, (user_id % 40)::DOUBLE * 1000 AS AMT_INCOME_TOTAL, CAST(CASE WHEN user_id % 6 = 0 THEN 365243 ELSE -((event_id * 13) % 8000) END AS INT) AS DAYS_EMPLOYED,
  CASE WHEN event_id % 3 <> 0 THEN (event_id % 101) / 100::DOUBLE END AS EXT_SOURCE_1, CASE WHEN event_id % 10 <> 0 THEN (user_id % 97) / 96::DOUBLE END AS EXT_SOURCE_2, CASE WHEN event_id % 5 <> 0 THEN ((event_id * 7) % 89) / 88::DOUBLE END AS EXT_SOURCE_3 FROM events),
b AS (SELECT *, {PD} AS pd_score FROM a), t AS (SELECT *, {TIER} AS risk_tier FROM b), s AS (SELECT *, {DECISION} AS decision, round(pd_score * 0.45::DOUBLE * AMT_CREDIT, 2) AS expected_loss FROM t)"""
ORACLES["windowed_stats"] = f"""WITH {_APPS} SELECT strftime(ts::DATE, '%Y-%m-%d') AS window_start, strftime(ts::DATE + 1, '%Y-%m-%d') AS window_end, count(*) AS total_applications, count(*) FILTER (decision = 'APPROVE') AS approved, count(*) FILTER (decision = 'REVIEW') AS review,
  count(*) FILTER (decision = 'REJECT') AS rejected, round(avg(pd_score), 4) AS avg_pd, round(sum(expected_loss), 2) AS total_el, round(avg(AMT_CREDIT), 0) AS avg_loan_amount FROM s GROUP BY 1, 2"""
ORACLES["kafka_round_trip"] = f"WITH {_APPS} SELECT decision, count(*) AS n, round(count(*) * 100::DOUBLE / sum(count(*)) OVER (), 2) AS share_pct FROM s GROUP BY 1"

_MEANS = "m AS (SELECT avg(AMT_CREDIT) AS m1, avg(AMT_INCOME_TOTAL) AS m2, avg(DAYS_BIRTH) AS m3 FROM loan)"
_IMPACTS = " UNION ALL ".join(
    [f"SELECT SK_ID_CURR, '{c}' AS feature, CASE WHEN {c} IS NULL OR {m} IS NULL OR {m} = 0 THEN {w} * 0.1::DOUBLE ELSE {w} * tanh(({c} - {m}) / abs({m})) END AS impact FROM loan, m" for c, m, w in (("AMT_CREDIT", "m1", "0.4::DOUBLE"), ("AMT_INCOME_TOTAL", "m2", "0.3::DOUBLE"), ("DAYS_BIRTH", "m3", "0.2::DOUBLE"))]
    + ["SELECT SK_ID_CURR, 'NAME_INCOME_TYPE', 0.1::DOUBLE * 0.05::DOUBLE FROM loan"]
)
ORACLES["row_explanations"] = f"""WITH {LOAN}, {_MEANS}, i AS ({_IMPACTS}), r AS (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(impact) DESC, feature) AS rank FROM i)
SELECT SK_ID_CURR, CAST(rank AS INT) AS rank, feature, round(impact, 6) AS impact, CASE WHEN impact > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction FROM r WHERE rank <= 3"""

_DIGEST = "CAST('0x' || substr(md5(SK_ID_CURR || ':42'), 1, 8) AS BIGINT)"
ORACLES["train_test_split"] = f"""WITH {LOAN}, s AS (SELECT CASE WHEN ({_DIGEST} * 100) >> 32 < 70 THEN 0 WHEN ({_DIGEST} * 100) >> 32 < 85 THEN 1 ELSE 2 END AS split, TARGET FROM loan)
SELECT split, count(*) AS n, CAST(sum(TARGET) AS BIGINT) AS n_positive FROM s GROUP BY 1"""
ORACLES["sample_rows"] = f"WITH {LOAN} SELECT SK_ID_CURR, TARGET, AMT_CREDIT FROM loan WHERE {_DIGEST} < {round(0.1 * 2**32)}"

# The upper tail of chi-square with one degree of freedom: a series for small arguments, a continued fraction for large ones.
_ERFC = """CASE WHEN z <= 0 THEN 1 WHEN z < 2.5 THEN 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 61), lambda k: list_reduce(list_prepend(z, list_transform(range(1, k + 1), lambda j: 2 * z * z / (2 * j + 1))), lambda a, b: a * b)))
  ELSE exp(-z * z) / (sqrt(pi()) * list_reduce(list_prepend(z, list_transform(range(80, 0, -1), lambda k: k::DOUBLE)), lambda acc, k: z + k / 2 / acc)) END"""
_H = ORACLES["kruskal_ranking"].replace("round((12 /", "((12 /").replace(", 2) AS h FROM s", ") AS h FROM s")
ORACLES["kruskal_significance"] = f"""WITH r AS ({_H}), z AS (SELECT feature, n, h AS raw, round(h, 2) AS h, sqrt(h / 2) AS z FROM r), p AS (SELECT feature, n, h, {_ERFC} AS p FROM z)
SELECT feature, n, h, round(p, 9) AS p_value, CAST(row_number() OVER (ORDER BY h DESC, feature) AS INT) AS rank, p < 0.05 AS significant FROM p"""

_SLOTS = " + ".join(f"coalesce({c}, m_{c}) / s_{c}" for c in NUMERIC)
_FILL = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NUMERIC)
_SPREAD = ", ".join(f"stddev_samp(coalesce({c}, m_{c})) AS s_{c}" for c in NUMERIC)
_HOT = ", ".join(f"k{i} AS (SELECT {c}, 1 / sqrt(count(*) / n::DOUBLE * (1 - count(*) / n::DOUBLE) * n / (n - 1)) AS v{i} FROM loan, (SELECT count(*) AS n FROM loan) GROUP BY {c}, n)" for i, c in enumerate(CATEGORICAL))
ORACLES["feature_vectors"] = f"""WITH {LOAN}, m AS (SELECT {_FILL} FROM loan), s AS (SELECT {_SPREAD} FROM loan, m), {_HOT},
w AS (SELECT {len(NUMERIC)} + {' + '.join(f'(SELECT count(DISTINCT {c}) FROM loan) + 1' for c in CATEGORICAL)} AS n_slots)
SELECT SK_ID_CURR, CAST(n_slots AS INT) AS n_slots, round({_SLOTS} + {' + '.join(f'v{i}' for i in range(len(CATEGORICAL)))}, 4) AS total
FROM loan {' '.join(f'JOIN k{i} USING ({c})' for i, c in enumerate(CATEGORICAL))} CROSS JOIN m CROSS JOIN s CROSS JOIN w"""
