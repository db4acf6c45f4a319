"""Joins, aggregates and pivots (the panel and the summaries around it)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import events as ev
from ..operators import insurance as ins
from ..operators import panel as pn
from ..operators import summaries as sm
from ..operators.dedup import first_per_key
from ..operators.events import count_column
from .registry import register, rnd
from .tables import CAT_COUNTS, DEMOGRAPHIC_SQL, END, FEATURE_SQL, PANEL_DOUBLES, PANEL_INTS, START, Tables, with_views

Q = '"{}"'.format


def rounded(*names: str, digits: int = 4) -> str:
    return ", ".join(f"{rnd(Q(n), digits)} AS {Q(n)}" for n in names)


# ---- event aggregates ---------------------------------------------------------------------------
_ENT = 'county_fips, "fipsStateCode", state, declaration_year AS year'


@register("agg_entity_month", with_views(f"""SELECT {_ENT}, declaration_month AS month, disaster_category, count("disasterNumber") AS disaster_count,
 count(DISTINCT "disasterNumber") AS unique_disasters, {rnd('avg(incident_duration_days)')} AS avg_duration_days FROM ev GROUP BY ALL""", "ev"))
def _(t: Tables):
    return ev.entity_month(t.events())


@register("agg_entity_quarter", with_views(f"""SELECT {_ENT}, declaration_quarter AS quarter, disaster_category, count("disasterNumber") AS disaster_count,
 count(DISTINCT "disasterNumber") AS unique_disasters, {rnd('avg(incident_duration_days)')} AS avg_duration_days FROM ev GROUP BY ALL""", "ev"))
def _(t: Tables):
    return ev.entity_quarter(t.events())


@register("agg_state_month", with_views("""SELECT "fipsStateCode", state, declaration_year AS year, declaration_month AS month, disaster_category,
 count("disasterNumber") AS disaster_count, count(DISTINCT "disasterNumber") AS unique_disasters FROM ev GROUP BY ALL""", "ev"))
def _(t: Tables):
    return ev.state_month(t.events())


NATIONAL = """SELECT declaration_year AS year, declaration_month AS month, disaster_category, count("disasterNumber") AS disaster_count,
 count(DISTINCT "disasterNumber") AS unique_disasters, count(DISTINCT state) AS states_affected,
 count(DISTINCT county_fips) AS counties_affected, make_date(declaration_year, declaration_month, 1) AS date FROM ev GROUP BY ALL"""


@register("agg_national_month", with_views(NATIONAL, "ev"))
def _(t: Tables):
    return ev.national_month(t.events())


@register("agg_claims_entity_year", with_views(
    f"""SELECT county_fips, year, claim_count, {rounded('total_claims_paid', 'avg_claim_severity', 'median_claim_severity', 'max_claim_severity',
    'total_damage_reported', 'avg_loss_ratio', 'avg_coverage', 'pct_primary_residence', digits=3)} FROM claims_year""", "claims_year"), digits=3)
def _(t: Tables):
    return ins.claims_entity_year(t.raw_claims(), START, END)


@register("agg_policies_entity_year", with_views(
    f"""SELECT "countyCode", "propertyState", year, n_records, {rounded('avg_premium', 'median_premium', 'total_premium', 'total_building_coverage',
    'total_contents_coverage', 'policy_count', digits=3)} FROM policies_year""", "policies_year"), digits=3)
def _(t: Tables):
    return ins.policies_entity_year(t.raw_policies())


@register("agg_assistance_entity_year", with_views(
    f"SELECT county_fips, year, {rounded(*ins.ASSISTANCE_AMOUNTS, digits=3)} FROM ha_year", "ha_year"), digits=3)
def _(t: Tables):
    return ins.assistance_entity_year(t.raw_assistance(), t.events())


@register("agg_events_entity_year", with_views(f"""SELECT {_ENT}, count(DISTINCT "disasterNumber") AS total_disasters,
 count(DISTINCT disaster_category) AS disaster_types, {rnd('avg(incident_duration_days)')} AS avg_incident_duration,
 {rnd('max(incident_duration_days)')} AS max_incident_duration FROM ev WHERE NOT is_statewide GROUP BY ALL""", "ev"))
def _(t: Tables):
    return ev.entity_year(t.events())


@register("pivot_type_counts", with_views(
    f"SELECT county_fips, declaration_year AS year, {CAT_COUNTS} FROM ev WHERE NOT is_statewide GROUP BY ALL", "ev"))
def _(t: Tables):
    return ev.category_counts(t.events())


@register("agg_macro_annual", with_views(f"SELECT year, {rounded(*fv.MACRO_SERIES)} FROM macro_year", "macro_year"))
def _(t: Tables):
    return pn.annual_means(t.macro(), START, END)


OVERVIEW = """SELECT declaration_year, count("disasterNumber") AS total_declarations,
 count(DISTINCT "disasterNumber") AS unique_events, count(DISTINCT county_fips) AS counties_affected FROM ev GROUP BY 1"""


@register("annual_overview", with_views(OVERVIEW, "ev"))
def _(t: Tables):
    return ev.annual_overview(t.events())


@register("trend_slope", with_views(
    f"""SELECT 'all' AS series, {rnd('regr_slope(n, y)')} AS slope, {rnd('regr_intercept(n, y)', 1)} AS intercept FROM
 (SELECT declaration_year AS y, count(*) AS n FROM ev GROUP BY 1)
 UNION ALL SELECT disaster_category, {rnd('regr_slope(n, y)')}, {rnd('regr_intercept(n, y)', 1)} FROM
 (SELECT disaster_category, declaration_year AS y, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1""", "ev"))
def _(t: Tables):
    by_type = sm.group_sizes(t.events(), ["disaster_category", "declaration_year"], "n")
    return sm.trend(by_type, "disaster_category", "declaration_year", "n").withColumn("intercept", F.round("intercept", 1))


@register("value_counts", with_views(
    "SELECT disaster_category, count(*) AS count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4", "ev"))
def _(t: Tables):
    return sm.value_counts(t.events(), "disaster_category", 4)


@register("type_by_year", with_views("""SELECT declaration_year, disaster_category, count(*) AS count FROM ev WHERE disaster_category IN
 (SELECT disaster_category FROM ev GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) GROUP BY 1, 2""", "ev"))
def _(t: Tables):
    return sm.sizes_of_top(t.events(), ["declaration_year", "disaster_category"], "disaster_category", 3)


@register("state_counts_for_year", with_views(
    "SELECT state, count(*) AS count FROM ev WHERE declaration_year = 1998 GROUP BY 1", "ev"))
def _(t: Tables):
    return sm.group_sizes(t.events().filter(F.col("declaration_year") == 1998), ["state"])


@register("pivot_month_type", with_views(
    f"SELECT declaration_month, {', '.join(f'''count(*) FILTER (disaster_category = '{c}') AS {Q(c)}''' for c in fv.CATEGORIES)} FROM ev GROUP BY 1", "ev"))
def _(t: Tables):
    return sm.count_matrix(t.events(), ["declaration_month"], "disaster_category", fv.CATEGORIES)


YEARS = list(range(START, END + 1))


@register("pivot_state_year", with_views(f"""SELECT *, row_number() OVER (ORDER BY total DESC, state) AS place FROM (SELECT state,
 {', '.join(f'''count(DISTINCT "disasterNumber") FILTER (declaration_year = {y}) AS "{y}"''' for y in YEARS)},
 {' + '.join(f'''count(DISTINCT "disasterNumber") FILTER (declaration_year = {y})''' for y in YEARS)} AS total FROM ev GROUP BY 1)""", "ev"))
def _(t: Tables):
    return sm.state_year_matrix(t.events(), YEARS)


@register("entity_totals_topk", with_views("""SELECT county_fips, state, "designatedArea", count(DISTINCT "disasterNumber") AS total_disasters
 FROM ev WHERE NOT is_statewide GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 3 LIMIT 20""", "ev"))
def _(t: Tables):
    return sm.top_totals(t.events().filter(~F.col("is_statewide")), ["county_fips", "state", "designatedArea"], 20)


@register("describe_by_group", with_views(f"""SELECT disaster_category, count(x) AS count, {rnd('avg(x)')} AS mean,
 {rnd('stddev_samp(x)')} AS std, {rnd('min(x)')} AS min, {rnd('quantile_cont(x, 0.25)')} AS q25,
 {rnd('quantile_cont(x, 0.5)')} AS q50, {rnd('quantile_cont(x, 0.75)')} AS q75, {rnd('max(x)')} AS max
 FROM (SELECT disaster_category, incident_duration_days AS x FROM ev WHERE incident_duration_days > 0) GROUP BY 1""", "ev"))
def _(t: Tables):
    return sm.describe(t.events().filter(F.col("incident_duration_days") > 0), ["disaster_category"], "incident_duration_days")


@register("box_stats", with_views(f"""SELECT g AS disaster_category, {rnd('q1')} AS q1, {rnd('q2')} AS median, {rnd('q3')} AS q3,
 {rnd('min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END)')} AS whisker_low, {rnd('max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END)')} AS whisker_high,
 count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers,
 row_number() OVER (ORDER BY q2 DESC, g) AS place
 FROM (SELECT disaster_category AS g, incident_duration_days AS x FROM ev WHERE incident_duration_days > 0 AND incident_duration_days < 365)
 JOIN (SELECT disaster_category AS g, quantile_cont(incident_duration_days, 0.25) AS q1, quantile_cont(incident_duration_days, 0.5) AS q2,
 quantile_cont(incident_duration_days, 0.75) AS q3 FROM ev WHERE incident_duration_days > 0 AND incident_duration_days < 365 GROUP BY 1) USING (g)
 GROUP BY g, q1, q2, q3""", "ev"))
def _(t: Tables):
    days = F.col("incident_duration_days")
    return sm.box_stats(t.events().filter((days > 0) & (days < 365)), "disaster_category", "incident_duration_days")


@register("histogram", f"""WITH s AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, least(value / 500.0, 1.0) AS score FROM events)
SELECT y, b AS bin, {rnd('b * CAST(0.02 AS DOUBLE)')} AS bin_start, count(*) AS n FROM (SELECT y, CASE WHEN score >= 1 THEN 49 ELSE CAST(floor(score * 50) AS BIGINT) END AS b FROM s)
GROUP BY 1, 2""")
def _(t: Tables):
    return sm.histogram(t.event_scores(), "score", 50, 0.0, 1.0, by=["y"])


@register("scalar_quantile", f"""SELECT {rnd('quantile_cont(l_extendedprice, 0.5)')} AS median, {rnd('quantile_cont(l_extendedprice, 0.75)')} AS q75,
 {rnd('quantile_cont(l_extendedprice, 0.95)')} AS q95 FROM lineitem""")
def _(t: Tables):
    return sm.quantiles(t.table("lineitem"), "l_extendedprice", {"median": 0.5, "q75": 0.75, "q95": 0.95})


@register("global_summary", with_views(f"""SELECT count(*) AS n_records, CAST(min("declarationDate") AS DATE) AS first_date, CAST(max("declarationDate") AS DATE) AS last_date,
 count(DISTINCT "disasterNumber") AS n_events, count(DISTINCT county_fips) AS n_entities, count(DISTINCT state) AS n_states,
 {rnd('avg(incident_duration_days)')} AS mean_duration, {rnd('stddev_samp(incident_duration_days)')} AS std_duration,
 {rnd('min(incident_duration_days)')} AS min_duration, {rnd('max(incident_duration_days)')} AS max_duration FROM ev""", "ev"))
def _(t: Tables):
    return sm.overview(t.events())


@register("dedup_first", with_views("""SELECT "disasterNumber", state, county_fips, year AS declaration_year FROM emap""", "emap"))
def _(t: Tables):
    return ins.event_entity_map(t.events())


# ---- joins and the panel ------------------------------------------------------------------------
@register("join_left_composite", with_views(f"""SELECT county_fips, year, total_disasters, claim_count, policy_count, {rounded('total_claims_paid', 'avg_premium', 'ha_total_damage', digits=3)}
 FROM ev_year LEFT JOIN claims_year USING (county_fips, year)
 LEFT JOIN (SELECT "countyCode" AS county_fips, year, avg_premium, policy_count FROM policies_year) USING (county_fips, year)
 LEFT JOIN ha_year USING (county_fips, year)""", "ev_year", "claims_year", "policies_year", "ha_year"), digits=3)
def _(t: Tables):
    spine, claims = t.events_year(), ins.claims_entity_year(t.raw_claims(), START, END)
    policies = ins.policies_entity_year(t.raw_policies()).withColumnRenamed("countyCode", "county_fips")
    return (spine.select(*pn.KEY, "total_disasters")
            .join(claims.select(*pn.KEY, "claim_count", "total_claims_paid"), pn.KEY, "left")
            .join(policies.select(*pn.KEY, "avg_premium", "policy_count"), pn.KEY, "left")
            .join(ins.assistance_entity_year(t.raw_assistance(), t.events()).select(*pn.KEY, "ha_total_damage"), pn.KEY, "left"))


@register("join_left_dim", with_views(f"SELECT county_fips, year, total_disasters, {rounded(*DEMOGRAPHIC_SQL)} FROM ev_year LEFT JOIN demo USING (county_fips)", "ev_year", "demo"))
def _(t: Tables):
    return (t.events_year().select(*pn.KEY, "total_disasters").join(t.demographics().drop("NAME"), "county_fips", "left"))


@register("join_left_time", with_views(f"SELECT county_fips, year, total_disasters, {rounded(*fv.MACRO_SERIES)} FROM ev_year LEFT JOIN macro_year USING (year)", "ev_year", "macro_year"))
def _(t: Tables):
    return t.events_year().select(*pn.KEY, "total_disasters").join(pn.annual_means(t.macro(), START, END), "year", "left")


@register("join_dedup_inner", with_views(f"""SELECT "disasterNumber", state, county_fips, year AS declaration_year, count(*) AS n_records, {rnd('sum(damage)', 3)} AS ha_total_damage
 FROM ha JOIN emap USING ("disasterNumber", state) GROUP BY ALL""", "ha", "emap"), digits=3)
def _(t: Tables):
    merged = ins.assistance_by_event(t.raw_assistance(), t.events())
    return merged.select("disasterNumber", "state", "county_fips", "declaration_year", "n_records", "ha_total_damage")


@register("join_agg_pivot", with_views(f"""SELECT county_fips, "fipsStateCode", state, year, total_disasters, disaster_types, {rounded('avg_incident_duration', 'max_incident_duration')},
 {', '.join(count_column(c) for c in fv.CATEGORIES)} FROM ev_year""", "ev_year"))
def _(t: Tables):
    return t.events_year()


@register("join_full_outer_multi", with_views(f"SELECT date, {rounded(*fv.MACRO_SERIES)} FROM macro_raw", "macro_raw"))
def _(t: Tables):
    return pn.align_series(t.macro_series())


@register("join_topk_context", with_views(f"""SELECT county_fips, state, {rnd('score')} AS score, {rnd('s.mean_severity')} AS mean_severity, total_disasters, total_claims, {rnd('population')} AS population FROM
 (SELECT county_fips, state, avg(disaster_exposure_index) AS score FROM pf GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 25) LEFT JOIN
 (SELECT county_fips, state, avg(avg_claim_severity) AS mean_severity, CAST(sum(total_disasters) AS BIGINT) AS total_disasters, CAST(sum(claim_count) AS BIGINT) AS total_claims,
 avg(total_population) AS population FROM pf GROUP BY 1, 2) s USING (county_fips, state)""", "pf"))
def _(t: Tables):
    panel = t.panel_features()
    ranked = panel.groupBy("county_fips", "state").agg(F.avg("disaster_exposure_index").alias("score"))
    return sm.top_with_context(ranked, panel, ["county_fips", "state"], "score", 25)


@register("panel_build", with_views(f"""SELECT county_fips, "fipsStateCode", state, year, {', '.join(Q(c) for c in PANEL_INTS)}, {rounded(*PANEL_DOUBLES, digits=3)} FROM panel""", "panel"), digits=3)
def _(t: Tables):
    return t.panel()


# ---- summaries of the panel ---------------------------------------------------------------------
@register("state_mean_score", with_views(f"SELECT state, {rnd('avg(disaster_exposure_index)')} AS mean_score FROM pf GROUP BY 1", "pf"))
def _(t: Tables):
    return t.panel_features().groupBy("state").agg(F.avg("disaster_exposure_index").alias("mean_score"))


@register("entity_severity", with_views(f"""SELECT county_fips, {rnd('avg(avg_claim_severity)')} AS mean_severity, CAST(sum(claim_count) AS BIGINT) AS total_claims,
 count(avg_claim_severity) AS years_with_claims FROM pf WHERE avg_claim_severity > 0 GROUP BY 1""", "pf"))
def _(t: Tables):
    return sm.entity_severity(t.panel_features())


@register("severity_by_year", with_views(f"""SELECT year, {rnd('avg(avg_claim_severity)')} AS mean_severity, {rnd('quantile_cont(avg_claim_severity, 0.5)')} AS median_severity,
 CAST(sum(claim_count) AS BIGINT) AS total_claims, count(DISTINCT county_fips) AS counties_with_claims FROM pf WHERE avg_claim_severity > 0 GROUP BY 1""", "pf"))
def _(t: Tables):
    return sm.severity_by_year(t.panel_features())


_LABELS = "CASE fema_region " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fv.REGION_LABEL.items()) + " END"


@register("region_summary", with_views(f"""SELECT label, {rnd('avg(s)')} AS mean, {rnd('quantile_cont(s, 0.5)')} AS median, count(*) AS count,
 row_number() OVER (ORDER BY avg(s) DESC, label) AS place FROM (SELECT {_LABELS} AS label, disaster_exposure_index AS s FROM pf) WHERE label IS NOT NULL GROUP BY 1""", "pf"))
def _(t: Tables):
    return sm.region_summary(t.panel_features(), "disaster_exposure_index")


@register("share_above", with_views(f"""SELECT count(*) FILTER (disaster_exposure_index > 2.0) AS n_above, {rnd('avg(CASE WHEN disaster_exposure_index > 2.0 THEN 1.0 ELSE 0.0 END)', 6)} AS share_above,
 count(disaster_exposure_index) AS n FROM pf""", "pf"), digits=6)
def _(t: Tables):
    return sm.share_above(t.panel_features(), "disaster_exposure_index", 2.0)
