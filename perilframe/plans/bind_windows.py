"""Window features, ranks, top-k, splits and the composite label."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import fixed_values as fv
from ..models import features as ft
from ..operators import insurance as ins
from ..operators import panel as pn
from ..operators import reporting as rp
from ..operators import scoring as sc
from ..operators import splits as sp
from ..operators import summaries as sm
from ..operators import target as tg
from ..series import prepare as sr
from .bind_aggregates import NATIONAL, Q, rounded
from .registry import register, rnd
from .tables import _INT, CUT, END, START, Tables, with_views

W = "PARTITION BY county_fips ORDER BY year"


@register("rolling_sum_3", with_views(f"SELECT county_fips, year, CAST(sum(total_disasters) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_disasters_3yr FROM pf", "pf"))
def _(t: Tables):
    return t.panel_features().select(*pn.KEY, pn.rolling_sum("total_disasters").alias("cum_disasters_3yr"))


_LAGGED = ", ".join((f"lag({c}) OVER ({W})" if f"{c}_lag1" in _INT else rnd(f"lag({c}) OVER ({W})", 6)) + f" AS {c}_lag1" for c in pn.LAGS)


@register("lag_features", with_views(f"SELECT county_fips, year, {_LAGGED} FROM pf", "pf"), digits=6)
def _(t: Tables):
    return t.panel_features().select(*pn.KEY, *[pn.lagged(c).alias(f"{c}_lag1") for c in pn.LAGS])


_YOY = "(claim_count - lag(claim_count) OVER w) / CAST(lag(claim_count) OVER w AS DOUBLE)"


@register("yoy_change", with_views(f"""SELECT county_fips, year, {rnd(f'CASE WHEN lag(claim_count) OVER w > 0 THEN {_YOY} END', 6)} AS claims_change_yoy,
 {rnd('CASE WHEN lag(avg_premium) OVER w > 0 THEN (avg_premium - lag(avg_premium) OVER w) / lag(avg_premium) OVER w END', 6)} AS premium_change_yoy FROM pf WINDOW w AS ({W})""", "pf"), digits=6)
def _(t: Tables):
    return t.panel_features().select(*pn.KEY, pn.yoy_change("claim_count").alias("claims_change_yoy"), pn.yoy_change("avg_premium").alias("premium_change_yoy"))


SURGE_CTE = f"""sg AS (SELECT *, CASE WHEN yoy > 0.5 THEN 1 ELSE 0 END AS surge FROM (SELECT *, lag(claim_count) OVER w AS prev, {_YOY} AS yoy FROM pf WINDOW w AS ({W})) WHERE prev > 0)"""


@register("surge_flag", with_views("SELECT county_fips, year, surge FROM sg", "pf", extra=SURGE_CTE))
def _(t: Tables):
    from ..studies.sensitivity import surge_base
    return surge_base(t.panel_features()).select(*pn.KEY, pn.surge("claims_change_yoy", 0.5).alias("surge"))


@register("forward_fill", with_views(f"SELECT date, {rounded(*fv.MACRO_SERIES)} FROM macro", "macro"))
def _(t: Tables):
    return t.macro()


SERIES_CTE = f"""nat AS ({NATIONAL}),
ser AS (SELECT series, CAST(date AS DATE) AS date, CAST(coalesce(x, 0) AS BIGINT) AS disaster_count FROM (SELECT s.series, d.date FROM (SELECT disaster_category AS series, min(date) AS a, max(date) AS b FROM nat GROUP BY 1) s,
 LATERAL (SELECT unnest(generate_series(s.a, s.b, INTERVAL 1 MONTH)) AS date) d) LEFT JOIN
 (SELECT disaster_category AS series, date, sum(disaster_count) AS x FROM nat GROUP BY 1, 2) USING (series, date))"""
SERIES_ALL = SERIES_CTE + """,
ser1 AS (SELECT series, CAST(date AS DATE) AS date, CAST(coalesce(x, 0) AS BIGINT) AS disaster_count FROM (SELECT 'all' AS series, unnest(generate_series((SELECT min(date) FROM nat), (SELECT max(date) FROM nat), INTERVAL 1 MONTH)) AS date)
 LEFT JOIN (SELECT date, sum(disaster_count) AS x FROM nat GROUP BY 1) USING (date))"""


def category_series(t: Tables):
    return sr.prepare_series(t.series_month(), by_category=True)


@register("calendar_fill", with_views("SELECT * FROM ser", "ev", extra=SERIES_CTE))
def _(t: Tables):
    return category_series(t)


@register("prepare_series", with_views("SELECT * FROM ser1 UNION ALL SELECT * FROM ser WHERE series = 'Flood'", "ev", extra=SERIES_ALL))
def _(t: Tables):
    month = t.series_month()
    return sr.prepare_series(month).unionByName(sr.prepare_series(month, category="Flood"))


SW = "PARTITION BY series ORDER BY date"


@register("difference", with_views(f"SELECT series, date, disaster_count, disaster_count - lag(disaster_count) OVER ({SW}) AS diff_1, disaster_count - lag(disaster_count, 12) OVER ({SW}) AS diff_12 FROM ser", "ev", extra=SERIES_CTE))
def _(t: Tables):
    return sr.difference(category_series(t), "disaster_count")


@register("seasonal_decompose", with_views(f"""SELECT series, date, disaster_count, {rnd('trend')} AS trend, {rnd('seasonal')} AS seasonal, {rnd('disaster_count - trend - seasonal')} AS resid FROM tr JOIN
 (SELECT series, slot, s - avg(s) OVER (PARTITION BY series) AS seasonal FROM (SELECT series, slot, avg(disaster_count - trend) AS s FROM tr GROUP BY 1, 2)) USING (series, slot)""", "ev", extra=SERIES_CTE + f""",
tr AS (SELECT *, (place - 1) % 12 AS slot, CASE WHEN place > 6 AND n - place >= 6 THEN (a1 + a2) / 2 END AS trend FROM (SELECT *, row_number() OVER ({SW}) AS place, count(*) OVER (PARTITION BY series) AS n,
 avg(disaster_count) OVER ({SW} ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS a1, avg(disaster_count) OVER ({SW} ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING) AS a2 FROM ser))"""))
def _(t: Tables):
    return sr.decompose(category_series(t), "disaster_count")


@register("acf", with_views(f"""SELECT a.series, k AS lag, {rnd('sum(a.x * b.x) / any_value(v)', 6)} AS acf FROM c a JOIN (SELECT unnest(generate_series(0, 36)) AS k) ON true
 JOIN c b ON a.series = b.series AND a.place = b.place + k JOIN (SELECT series, sum(x * x) AS v FROM c GROUP BY 1) s ON s.series = a.series GROUP BY 1, 2""", "ev", extra=SERIES_CTE + f""",
c AS (SELECT series, row_number() OVER ({SW}) AS place, disaster_count - avg(disaster_count) OVER (PARTITION BY series) AS x FROM ser)"""), digits=6)
def _(t: Tables):
    return sr.acf(category_series(t), "disaster_count")


# ---- ranks and top-k ------------------------------------------------------------------------------
RISK_CTE = """rs AS (SELECT *, row_number() OVER (ORDER BY mean_risk DESC, county_fips, state) AS risk_rank FROM (SELECT county_fips, state, avg(disaster_exposure_index) AS mean_risk,
 max(disaster_exposure_index) AS max_risk, count(disaster_exposure_index) AS n_years FROM pf GROUP BY 1, 2))"""


def ranked(t: Tables):
    return sc.score_entities(t.panel_features(), ["county_fips", "state"], "disaster_exposure_index")


@register("score_rank", with_views(f"SELECT county_fips, state, {rounded('mean_risk', 'max_risk')}, n_years, risk_rank FROM rs", "pf", extra=RISK_CTE))
def _(t: Tables):
    return ranked(t)


@register("pct_rank_composite", with_views(f"""SELECT county_fips, state, {rounded('mean_severity')}, total_disasters, total_claims, years_with_claims, cum_disasters, {rnd('p(mean_severity) * 0.4 + p(total_disasters) * 0.3 + p(total_claims) * 0.3', 4)} AS risk_score FROM e""".replace(
    "p(mean_severity)", "(rank() OVER (ORDER BY mean_severity) + (count(*) OVER (PARTITION BY mean_severity) - 1) / 2) / (SELECT count(*) FROM e)").replace(
    "p(total_disasters)", "(rank() OVER (ORDER BY total_disasters) + (count(*) OVER (PARTITION BY total_disasters) - 1) / 2) / (SELECT count(*) FROM e)").replace(
    "p(total_claims)", "(rank() OVER (ORDER BY total_claims) + (count(*) OVER (PARTITION BY total_claims) - 1) / 2) / (SELECT count(*) FROM e)"), "pf",
    extra="""e AS (SELECT county_fips, state, avg(avg_claim_severity) AS mean_severity, CAST(sum(total_disasters) AS BIGINT) AS total_disasters, CAST(sum(claim_count) AS BIGINT) AS total_claims,
 count(claim_count) AS years_with_claims, max(cum_disasters_3yr) AS cum_disasters FROM pf WHERE avg_claim_severity > 0 GROUP BY 1, 2 HAVING count(claim_count) >= 3)"""))
def _(t: Tables):
    return sc.composite_rank(t.panel_features(), {"mean_severity": 0.4, "total_disasters": 0.3, "total_claims": 0.3})


@register("topk_filtered", with_views(f"""SELECT risk_rank AS "Rank", county_fips AS "FIPS", state AS "State", {rnd('mean_risk')} AS "Mean Risk", {rnd('max_risk')} AS "Max Risk", n_years AS "Years"
 FROM rs WHERE state IN ('NATION_2', 'NATION_3', 'NATION_5') AND mean_risk >= 1.5 ORDER BY mean_risk DESC, county_fips LIMIT 30""", "pf", extra=RISK_CTE))
def _(t: Tables):
    return sc.top_filtered(ranked(t), 30, ["NATION_2", "NATION_3", "NATION_5"], 1.5, {
        "risk_rank": "Rank", "county_fips": "FIPS", "state": "State", "mean_risk": "Mean Risk", "max_risk": "Max Risk", "n_years": "Years"})


@register("topk_n", "SELECT p_partkey, p_retailprice FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def _(t: Tables):
    return t.table("part").filter(F.col("p_size") > 10).orderBy(F.desc("p_retailprice"), "p_partkey").limit(15).select("p_partkey", "p_retailprice")


@register("argmin_argmax_row", f"""WITH m AS (SELECT o_orderpriority AS model, o_orderstatus AS grp, avg(o_totalprice) AS aic, max(o_totalprice) AS auc, count(*) % 2 = 0 AS converged FROM orders GROUP BY 1, 2)
(SELECT 'min_aic' AS pick, model, grp, {rnd('aic', 3)} AS value FROM m ORDER BY CASE WHEN converged THEN 0 ELSE 1 END, aic, model, grp LIMIT 1) UNION ALL
(SELECT 'max_auc', model, grp, {rnd('auc', 3)} FROM m ORDER BY auc DESC, model, grp LIMIT 1)""", digits=3)
def _(t: Tables):
    m = (t.table("orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("grp"))
         .agg(F.avg("o_totalprice").alias("aic"), F.max("o_totalprice").alias("auc"), (F.count(F.lit(1)) % 2 == 0).alias("converged")))
    low = rp.best_row(m, "aic", True, "converged", "model").select(F.lit("min_aic").alias("pick"), "model", "grp", F.col("aic").alias("value"))
    return low.unionByName(rp.best_row(m, "auc", False, None, "model").select(F.lit("max_auc").alias("pick"), "model", "grp", F.col("auc").alias("value")))


@register("union_by_name", f"""SELECT 'orders' AS source, year(o_orderdate) AS year, count(*) AS n, {rnd('avg(o_totalprice)', 3)} AS price, NULL::DOUBLE AS quantity FROM orders GROUP BY 2
 UNION ALL SELECT 'lines', year(l_shipdate), count(*), NULL, {rnd('avg(l_quantity)', 3)} FROM lineitem GROUP BY 2""", digits=3)
def _(t: Tables):
    a = t.table("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("price")).withColumn("source", F.lit("orders"))
    b = t.table("lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("quantity")).withColumn("source", F.lit("lines"))
    return a.unionByName(b, allowMissingColumns=True)


@register("pivot_grid", f"""SELECT n_regionkey AS quantile, {', '.join(f'''{rnd(f"avg(o_totalprice) FILTER (o_orderstatus = '{s}')", 3)} AS "{s}"''' for s in 'FOP')} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""", digits=3)
def _(t: Tables):
    return rp.grid(t.customer_orders().withColumnRenamed("n_regionkey", "quantile"), "quantile", "o_orderstatus", list("FOP"), "o_totalprice")


@register("transpose_metrics", f"""SELECT metric, {', '.join(f'''{rnd(f"max(value) FILTER (s = '{s}')", 3)} AS "{s}"''' for s in 'FOP')} FROM (SELECT o_orderstatus AS s, avg(o_totalprice) AS mean, max(o_totalprice) AS high, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)
 UNPIVOT (value FOR metric IN (mean, high, n)) GROUP BY 1""", digits=3)
def _(t: Tables):
    m = t.table("orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("high"), F.count(F.lit(1)).cast("double").alias("n"))
    return rp.transpose(m, "model", ["mean", "high", "n"], list("FOP"))


# ---- splits ---------------------------------------------------------------------------------------
@register("split_temporal", with_views(f"SELECT county_fips, year, CASE WHEN year <= {CUT} THEN 'train' ELSE 'test' END AS split FROM ev_year", "ev_year"))
def _(t: Tables):
    return sp.temporal(t.events_year().select(*pn.KEY), CUT)


@register("split_tail_months", with_views("SELECT series, date, disaster_count, CASE WHEN date <= max(date) OVER (PARTITION BY series) - INTERVAL 24 MONTH THEN 'train' ELSE 'test' END AS split FROM ser", "ev", extra=SERIES_CTE))
def _(t: Tables):
    return sp.tail_months(category_series(t), 24, keys=["series"])


_MED = ["total_population", "avg_premium", "claim_count_lag1", "avg_incident_duration"]


@register("impute_median", with_views("SELECT county_fips, year, " + ", ".join(
    rnd(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM pf WHERE year <= {CUT}))", 6) + f" AS {c}" for c in _MED) + " FROM pf", "pf"), digits=6)
def _(t: Tables):
    panel = t.panel_features()
    return ft.impute(panel, ft.medians(panel.filter(F.col("year") <= CUT), _MED)).select(*pn.KEY, *_MED)


@register("standardise", with_views("SELECT county_fips, year, " + ", ".join(
    rnd(f"({c} - (SELECT avg({c}) FROM pf WHERE year <= {CUT})) / (SELECT stddev_pop({c}) FROM pf WHERE year <= {CUT})") + f" AS {c}" for c in _MED) + " FROM pf", "pf"))
def _(t: Tables):
    panel = t.panel_features()
    return ft.standardise(panel, ft.moments(panel.filter(F.col("year") <= CUT), _MED)).select(*pn.KEY, *_MED)


@register("balanced_weights", f"""SELECT y, n_class, {rnd('(SELECT count(*) FROM lineitem) / 2.0 / n_class', 6)} AS weight FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, count(*) AS n_class FROM lineitem GROUP BY 1)""", digits=6)
def _(t: Tables):
    return ft.balanced_weights(t.line_scores(), "y")


_MD5 = "md5(o_orderkey || '|42')"


@register("kfold_assign", f"SELECT o_orderkey, row_number() OVER (ORDER BY {_MD5}, o_orderkey) % 5 + 1 AS fold FROM orders")
def _(t: Tables):
    return sp.kfold(t.table("orders").select("o_orderkey"), ["o_orderkey"], 5)


@register("stratified_kfold_assign", f"SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_MD5}, o_orderkey) % 5 + 1 AS fold FROM orders")
def _(t: Tables):
    return sp.kfold(t.table("orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 5, within=["o_orderstatus"])


@register("expanding_split", with_views(f"""SELECT series, date, disaster_count, fold, CASE WHEN place < n - (5 - fold) * (n // 6) THEN 'train' ELSE 'test' END AS split FROM
 (SELECT *, row_number() OVER ({SW}) - 1 AS place, count(*) OVER (PARTITION BY series) AS n FROM ser) JOIN (SELECT unnest(generate_series(0, 4)) AS fold) ON true WHERE place < n - (5 - fold) * (n // 6) + n // 6""", "ev", extra=SERIES_CTE))
def _(t: Tables):
    return sp.expanding(category_series(t), 5, keys=["series"])


LABEL_CTE = f"""th AS (SELECT (SELECT quantile_cont(avg_claim_severity, 0.75) FROM pf WHERE year <= {CUT} AND avg_claim_severity > 0) AS ts,
 (SELECT quantile_cont(cum_disasters_3yr, 0.75) FROM pf WHERE year <= {CUT}) AS td, (SELECT quantile_cont(total_claims_paid, 0.75) FROM pf WHERE year <= {CUT}) AS tc),
lb AS (SELECT *, CASE WHEN risk_signal_count >= 2 THEN 1 ELSE 0 END AS uninsurability_risk FROM (SELECT *, signal_high_severity + signal_high_disasters + signal_ha_damage + signal_high_claims_paid AS risk_signal_count FROM
 (SELECT pf.*, CASE WHEN avg_claim_severity >= ts THEN 1 ELSE 0 END AS signal_high_severity, CASE WHEN cum_disasters_3yr >= td THEN 1 ELSE 0 END AS signal_high_disasters,
 CASE WHEN ha_total_damage > 0 THEN 1 ELSE 0 END AS signal_ha_damage, CASE WHEN total_claims_paid >= tc THEN 1 ELSE 0 END AS signal_high_claims_paid FROM pf, th)))"""


def labelled(t: Tables):
    return t.stage("labelled", lambda: tg.composite_target(t.panel_features(), train_year_max=CUT))


@register("composite_target", with_views(f"SELECT county_fips, year, {', '.join(fv.SIGNALS)}, risk_signal_count, uninsurability_risk FROM lb", "pf", extra=LABEL_CTE))
def _(t: Tables):
    return tg.composite_target(t.panel_features(), train_year_max=CUT).select(*pn.KEY, *fv.SIGNALS, "risk_signal_count", "uninsurability_risk")


@register("signal_rates", with_views(" UNION ALL ".join(
    f"SELECT '{s}' AS signal, {rnd(f'avg({s})', 6)} AS overall, {rnd(f'avg({s}) FILTER (year <= {CUT})', 6)} AS train, {rnd(f'avg({s}) FILTER (year > {CUT})', 6)} AS test FROM lb"
    for s in [*fv.SIGNALS, "uninsurability_risk"]), "pf", extra=LABEL_CTE), digits=6)
def _(t: Tables):
    return tg.signal_rates(labelled(t), CUT)


@register("risk_rate_by_year", with_views(f"SELECT year, {rnd('avg(uninsurability_risk)', 6)} AS risk_rate, CAST(sum(uninsurability_risk) AS BIGINT) AS n_high_risk, count(DISTINCT county_fips) AS n_counties FROM lb GROUP BY 1", "pf", extra=LABEL_CTE), digits=6)
def _(t: Tables):
    return sm.flag_rates_by_year(labelled(t), "uninsurability_risk")


@register("leave_one_group_out", with_views(f"""SELECT fema_region, count(*) AS n_test, CAST(sum(uninsurability_risk) AS BIGINT) AS positives, {rnd('avg(uninsurability_risk)', 6)} AS pos_rate_test,
 (SELECT count(*) FROM lb WHERE year <= {CUT}) - count(*) AS n_train FROM lb WHERE year <= {CUT} AND fema_region > 0 GROUP BY 1
 HAVING count(*) >= 50 AND sum(uninsurability_risk) >= 10 AND sum(uninsurability_risk) < count(*)""", "pf", extra=LABEL_CTE), digits=6)
def _(t: Tables):
    train = labelled(t).filter(F.col("year") <= CUT)
    return sp.leave_one_out_sizes(train, "fema_region", "uninsurability_risk", held_out=F.col("fema_region") > 0)


@register("sample_fixed", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_MD5}, o_orderkey LIMIT 1000")
def _(t: Tables):
    return sp.sample(t.table("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 1000)
