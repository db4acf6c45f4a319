"""Metrics and statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import stats as st
from ..functions.fixed_values import PROBABILITY_EDGES
from ..operators import metrics as mt
from ..operators import panel as pn
from ..operators import splits as sp
from ..studies import sensitivity as se
from ..studies import summary as su
from .bind_windows import LABEL_CTE, SURGE_CTE, labelled
from .registry import register, rnd
from .tables import CUT, Tables, with_views

ES = "es AS (SELECT event_id, day(ts) AS day, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, least(value / 500.0, 1.0) AS score FROM events)"
LS = "ls AS (SELECT l_linestatus AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 10 AS score FROM lineitem)"


def points(source: str, keys: str = "") -> str:
    by = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""pt AS (SELECT *, sum(pos) OVER ({by} ORDER BY threshold DESC) AS tp, sum(neg) OVER ({by} ORDER BY threshold DESC) AS fp, sum(pos) OVER ({by}) AS p, sum(neg) OVER ({by}) AS n
 FROM (SELECT {k}score AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY {k}score))"""


AUC = "CAST(sum(pos * (n - fp + neg / 2.0)) AS DOUBLE) / max(p) / max(n)"
AP = "sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / max(p)"
YOUDEN = "arg_max(threshold, (tp * n - fp * p, threshold))"


def over(source: str, cte: str, query: str, keys: str = "") -> str:
    return f"WITH {cte}, {points(source, keys)} {query}"


_REG = "r AS (SELECT l_linestatus AS grp, l_extendedprice AS y, l_quantity * CAST(2100.7371 AS DOUBLE) * (1 - l_discount) AS p FROM lineitem)"


def _lines(t: Tables):
    return t.table("lineitem").select(F.col("l_linestatus").alias("grp"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"),
                                      (F.col("l_quantity") * 2100.7371 * (1 - F.col("l_discount"))).alias("p"))


@register("regression_metrics", f"""WITH {_REG} SELECT grp, {rnd('sqrt(avg((y - p) ** 2))', 3)} AS rmse, {rnd('avg(abs(y - p))', 3)} AS mae, {rnd('1 - avg((y - p) ** 2) / var_pop(y)', 3)} AS r2,
 {rnd('avg(CASE WHEN y > 0 THEN abs((y - p) / y) END) * 100', 3)} AS mape, count(*) AS n FROM r GROUP BY 1""", digits=3)
def _(t: Tables):
    return mt.regression_metrics(_lines(t), ["grp"], "y", "p")


@register("residual_diagnostics", f"""SELECT l_orderkey, l_linenumber, {rnd('y - p', 6)} AS residual, {rnd('(y - p) / sqrt(p * 1.447)', 6)} AS pearson_residual,
 {rnd('sqrt(abs((y - p) / sqrt(p * 1.447)))', 6)} AS sqrt_abs_residual, {rnd('abs((y - p) / CASE WHEN y > 0 THEN y ELSE 1.0 END) * 100', 6)} AS abs_pct_error
 FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * CAST(2100.7371 AS DOUBLE) * (1 - l_discount) AS p FROM lineitem)""", digits=6)
def _(t: Tables):
    return mt.residuals(_lines(t), "y", "p", 1.447).drop("grp", "y", "p")


def _horner(coefficients: list[float], x: str) -> str:
    text = f"CAST('{coefficients[0]!r}' AS DOUBLE)"
    for c in coefficients[1:]:
        text = f"({text} * {x} + CAST('{c!r}' AS DOUBLE))"
    return text


def _normal_quantile_sql() -> str:
    """The oracle's inverse normal over columns p, q = p - 0.5, r = q * q and the tail arguments lo, hi."""
    def tail(x: str) -> str:
        return f"{_horner(st._C, x)} / {_horner(st._D + [1.0], x)}"
    return f"CASE WHEN p < 0.02425 THEN {tail('lo')} WHEN p > 1 - 0.02425 THEN -({tail('hi')}) ELSE {_horner(st._A, 'r')} * q / {_horner(st._B + [1.0], 'r')} END"


@register("qq_points", f"""WITH s AS (SELECT (y - p) / sqrt(p * CAST(1.447 AS DOUBLE)) AS sample FROM (SELECT l_extendedprice AS y, l_quantity * CAST(2100.7371 AS DOUBLE) * (1 - l_discount) AS p FROM lineitem)),
o AS (SELECT sample, row_number() OVER (ORDER BY sample) AS place, count(*) OVER () AS n FROM s),
g AS (SELECT *, CAST(0.001 AS DOUBLE) + (place - 1) * (CAST(0.998 AS DOUBLE) / greatest(n - 1, 1)) AS p FROM o)
SELECT place, {rnd('sample', 6)} AS sample, {rnd(_normal_quantile_sql(), 6)} AS theoretical FROM (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(p)) AS lo, sqrt(-2 * ln(1 - p)) AS hi FROM g)""", digits=6)
def _(t: Tables):
    scaled = mt.residuals(_lines(t), "y", "p", 1.447)
    return mt.qq_points(scaled, [], "pearson_residual", [F.col("l_orderkey"), F.col("l_linenumber")])


@register("roc_curve", over("es", ES, f"SELECT {rnd('threshold', 9)} AS threshold, {rnd('fp / CAST(n AS DOUBLE)', 9)} AS fpr, {rnd('tp / CAST(p AS DOUBLE)', 9)} AS tpr FROM pt UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE"), digits=9)
def _(t: Tables):
    return mt.roc_curve(t.event_scores(), [], "y", "score")


@register("pr_curve", over("es", ES, f"SELECT {rnd('threshold', 9)} AS threshold, {rnd('tp / CAST(tp + fp AS DOUBLE)', 9)} AS precision, {rnd('tp / CAST(p AS DOUBLE)', 9)} AS recall FROM pt UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE"), digits=9)
def _(t: Tables):
    return mt.pr_curve(t.event_scores(), [], "y", "score")


@register("auc_roc", over("ls", LS, f"SELECT grp, {rnd(AUC, 9)} AS auc_roc FROM pt GROUP BY 1", "grp"), digits=9)
def _(t: Tables):
    return mt.rank_metrics(t.line_scores(), ["grp"], "y", "score").select("grp", "auc_roc")


@register("average_precision", over("ls", LS, f"SELECT grp, {rnd(AP, 9)} AS avg_precision FROM pt GROUP BY 1", "grp"), digits=9)
def _(t: Tables):
    return mt.rank_metrics(t.line_scores(), ["grp"], "y", "score").select("grp", "avg_precision")


@register("youden_threshold", over("es", ES, f"SELECT {rnd(YOUDEN, 9)} AS optimal_threshold FROM pt"), digits=9)
def _(t: Tables):
    return mt.rank_metrics(t.event_scores(), [], "y", "score").select("optimal_threshold")


@register("brier_score", f"WITH {ES} SELECT day, {rnd('avg((score - y) ** 2)', 8)} AS brier_score FROM es GROUP BY 1", digits=8)
def _(t: Tables):
    return mt.brier(t.event_scores(), ["day"], "y", "score")


_CONF = "count(*) FILTER (y = 0 AND score < 0.3) AS tn, count(*) FILTER (y = 0 AND score >= 0.3) AS fp, count(*) FILTER (y = 1 AND score < 0.3) AS fn, count(*) FILTER (y = 1 AND score >= 0.3) AS tp"


@register("confusion_matrix", f"WITH {LS} SELECT grp, {_CONF} FROM ls GROUP BY 1")
def _(t: Tables):
    return mt.confusion(t.line_scores(), ["grp"], "y", "score", 0.3)


@register("f1_at_threshold", f"WITH {ES} SELECT day, {rnd('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END', 9)} AS f1_score FROM (SELECT day, {_CONF} FROM es GROUP BY 1)", digits=9)
def _(t: Tables):
    return mt.f1(mt.confusion(t.event_scores(), ["day"], "y", "score", 0.3), ["day"])


@register("classification_report", f"""WITH {LS}, c AS (SELECT {_CONF.replace(' AS', '::DOUBLE AS')} FROM ls),
m AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS s1, (tn + tp) / (tn + fp + fn + tp) AS acc FROM c),
o AS (SELECT 'kept' AS class, p0 AS p, r0 AS r, f0 AS f, s0 AS s FROM m UNION ALL SELECT 'returned', p1, r1, f1, s1 FROM m UNION ALL SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM m
 UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM m
 UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM m)
SELECT class, {rnd('p', 8)} AS precision, {rnd('r', 8)} AS recall, {rnd('f', 8)} AS f1, {rnd('s', 8)} AS support FROM o""", digits=8)
def _(t: Tables):
    return mt.classification_report(mt.confusion(t.line_scores(), [], "y", "score", 0.3), ("kept", "returned"))


def _slot(op: str) -> str:
    return " + ".join(f"CASE WHEN score {op} CAST('{e!r}' AS DOUBLE) THEN 1 ELSE 0 END" for e in PROBABILITY_EDGES[1:-1])


@register("calibration_curve", f"""WITH {ES} SELECT row_number() OVER (ORDER BY slot) AS bin, {rnd('fp', 8)} AS fraction_positive, {rnd('mp', 8)} AS mean_predicted, n FROM
 (SELECT {_slot('>')} AS slot, avg(y) AS fp, avg(score) AS mp, count(*) AS n FROM es GROUP BY 1)""", digits=8)
def _(t: Tables):
    return mt.calibration_curve(t.event_scores(), [], "y", "score")


@register("expected_calibration_error", f"""WITH {LS} SELECT grp, {rnd('coalesce(sum(CASE WHEN slot IS NOT NULL THEN n * gap END), 0) / sum(n)', 8)} AS ece, {rnd('sum(sq) / sum(n)', 8)} AS brier_score FROM
 (SELECT grp, CASE WHEN score < 1 THEN {_slot('>=')} END AS slot, count(*) AS n, abs(avg(y) - avg(score)) AS gap, sum((score - y) ** 2) AS sq FROM ls GROUP BY 1, 2) GROUP BY 1""", digits=8)
def _(t: Tables):
    return mt.expected_calibration_error(t.line_scores(), ["grp"], "y", "score")


KS = ["total_disasters", "cum_disasters_3yr", "disaster_exposure_index", "avg_incident_duration", "total_population", "avg_claim_severity_lag1", "CPIAUCSL"]


@register("ks_two_sample", with_views(f"""SELECT feature, {rnd('max(abs(ca / ta - cb / tb))', 6)} AS ks_statistic, CAST(max(ta) AS BIGINT) AS n_train, CAST(max(tb) AS BIGINT) AS n_test, {', '.join(f"{rnd(f'max({c})', 6)} AS {c}" for c in ('train_mean', 'train_std', 'test_mean', 'test_std'))} FROM
 (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS ta, sum(b) OVER (PARTITION BY feature) AS tb FROM
 (SELECT feature, value, CAST(count(*) FILTER (tr = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (tr = 0) AS DOUBLE) AS b FROM u GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY value)) JOIN
 (SELECT feature, avg(value) FILTER (tr = 1) AS train_mean, stddev_pop(value) FILTER (tr = 1) AS train_std, avg(value) FILTER (tr = 0) AS test_mean, stddev_pop(value) FILTER (tr = 0) AS test_std FROM u GROUP BY 1) USING (feature) GROUP BY 1""", "pf",
    extra=f"""u AS (UNPIVOT (SELECT CASE WHEN year <= {CUT} THEN 1 ELSE 0 END AS tr, {', '.join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in KS)} FROM pf) ON {', '.join(f'"{c}"' for c in KS)} INTO NAME feature VALUE value)"""), digits=6)
def _(t: Tables):
    return mt.ks_two_sample(t.panel_features(), KS, F.col("year") <= CUT).drop("ks_pvalue", "significant_shift")


@register("distribution_shift_pvalues", digits=8)
def _(t: Tables):
    features = [f for f in fv.PREDICTIVE_FEATURES if f in t.panel_features().columns]
    return mt.ks_two_sample(t.panel_features(), features, F.col("year") <= CUT).select("feature", "ks_statistic", "ks_pvalue", "significant_shift")


@register("subset_performance", over("es", ES, f"""SELECT day, {rnd(AUC, 9)} AS auc_roc, CAST(max(p) + max(n) AS BIGINT) AS n_samples, {rnd('max(p) / CAST(max(p) + max(n) AS DOUBLE)', 9)} AS pos_rate
 FROM pt GROUP BY 1 HAVING max(p) >= 5 AND max(n) > 0""", "day"), digits=9)
def _(t: Tables):
    return mt.subset_performance(t.event_scores(), "day", "y", "score")


_FOLDS = "es5 AS (SELECT *, row_number() OVER (ORDER BY md5(event_id || '|42'), event_id) % 5 + 1 AS fold FROM es)"
_FOLD_ROWS = f"""fm AS (SELECT fold, {AUC} AS auc_roc, {AP} AS avg_precision FROM pt GROUP BY 1), fs AS (SELECT fold, avg(score) AS pred_mean, stddev_pop(score) AS pred_std FROM es5 GROUP BY 1)"""


@register("fold_summary", f"""WITH {ES}, {_FOLDS}, {points('es5', 'fold')}, {_FOLD_ROWS}
SELECT CAST(fold AS VARCHAR) AS fold, format('{{:.3f}}', auc_roc) AS auc_roc, format('{{:.3f}}', avg_precision) AS avg_precision, {rnd('pred_mean', 6)} AS pred_mean, {rnd('pred_std', 6)} AS pred_std FROM fm JOIN fs USING (fold)
UNION ALL SELECT 'mean±std', format('{{:.3f}}±{{:.3f}}', avg(auc_roc), stddev_samp(auc_roc)), format('{{:.3f}}±{{:.3f}}', avg(avg_precision), stddev_samp(avg_precision)), {rnd('avg(pred_mean)', 6)}, {rnd('avg(pred_std)', 6)} FROM fm JOIN fs USING (fold)""", digits=6)
def _(t: Tables):
    folds = mt.fold_metrics(sp.kfold(t.event_scores(), ["event_id"], 5), "fold", "y", "score")
    return mt.with_summary_row(folds, "fold", ["auc_roc", "avg_precision"], ["pred_mean", "pred_std"])


# ---- studies without fits -------------------------------------------------------------------------
def _sens(q: float) -> str:
    th = (f"(SELECT quantile_cont(avg_claim_severity, {q}) FROM pf WHERE year <= {CUT} AND avg_claim_severity > 0) AS ts, "
          f"(SELECT quantile_cont(cum_disasters_3yr, {q}) FROM pf WHERE year <= {CUT}) AS td, (SELECT quantile_cont(total_claims_paid, {q}) FROM pf WHERE year <= {CUT}) AS tc")
    return (f"SELECT CAST({q} AS DOUBLE) AS quantile, year, CASE WHEN avg_claim_severity >= ts THEN 1 ELSE 0 END + CASE WHEN cum_disasters_3yr >= td THEN 1 ELSE 0 END"
            f" + CASE WHEN ha_total_damage > 0 THEN 1 ELSE 0 END + CASE WHEN total_claims_paid >= tc THEN 1 ELSE 0 END AS k FROM pf, (SELECT {th})")


@register("sensitivity_thresholds", with_views(f"""SELECT quantile, m AS min_signals, {rnd(f'avg(CASE WHEN k >= m THEN 1 ELSE 0 END) FILTER (year <= {CUT})', 8)} AS pos_rate_train,
 {rnd(f'avg(CASE WHEN k >= m THEN 1 ELSE 0 END) FILTER (year > {CUT})', 8)} AS pos_rate_test, count(*) FILTER (k >= m AND year > {CUT}) AS positives_test,
 count(*) FILTER (year <= {CUT}) AS n_train, count(*) FILTER (year > {CUT}) AS n_test,
 count(*) FILTER (k >= m AND year > {CUT}) >= 30 AND avg(CASE WHEN k >= m THEN 1 ELSE 0 END) FILTER (year > {CUT}) BETWEEN 0.01 AND 0.5 AS usable
 FROM s JOIN (SELECT unnest([1, 2, 3, 4]) AS m) ON true GROUP BY 1, 2""", "pf", extra="s AS (" + " UNION ALL ".join(_sens(q) for q in (0.5, 0.6, 0.75, 0.9)) + ")"), digits=8)
def _(t: Tables):
    return se.usable(se.target_rates(t.panel_features(), cut=CUT))


@register("sensitivity_surge", with_views(f"""SELECT CAST(th AS DOUBLE) AS surge_threshold, {rnd(f'avg(CASE WHEN yoy > th THEN 1 ELSE 0 END) FILTER (year <= {CUT})', 8)} AS pos_rate,
 {rnd(f'avg(CASE WHEN yoy > th THEN 1 ELSE 0 END) FILTER (year > {CUT})', 8)} AS pos_rate_test, count(*) FILTER (year <= {CUT}) AS n_train, count(*) FILTER (year > {CUT}) AS n_test
 FROM sg JOIN (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS th) ON true WHERE {' AND '.join(f'"{c}" IS NOT NULL' for c in fv.SURGE_STUDY_FEATURES)} GROUP BY 1""", "pf", extra=SURGE_CTE), digits=8)
def _(t: Tables):
    return se.surge_rates(t.panel_features(), cut=CUT)


@register("cross_module_summary", f"""WITH {ES}, {points('es')}, {_REG} SELECT 2 AS module, 'Scaled quantity' AS model_name, 'Test RMSE' AS primary_metric, {rnd('sqrt(avg((y - p) ** 2))', 3)} AS metric_value, NULL::DOUBLE AS cv_metric, 'AIC=0.0' AS notes FROM r
 UNION ALL SELECT 3, 'Event value', 'AUC-ROC', {rnd(AUC, 3)}, NULL, 'Claims surge prediction' FROM pt""", digits=3)
def _(t: Tables):
    glm = mt.regression_metrics(_lines(t), [], "y", "p").select(F.lit("Scaled quantity").alias("model"), F.col("rmse").alias("test_rmse"), F.lit(0.0).alias("aic"))
    clf = mt.rank_metrics(t.event_scores(), [], "y", "score").select(F.lit("Event value").alias("model"), "auc_roc", F.lit("Claims surge prediction").alias("notes"))
    return su.cross_module({"glm": (2, glm), "classifier": (3, clf)}).select("module", "model_name", "primary_metric", "metric_value", "cv_metric", "notes")
