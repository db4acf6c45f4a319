"""Scalar functions, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import fixed_values as fv
from ..operators import panel as pn
from ..operators import reporting as rp
from ..operators import summaries as sm
from ..operators.events import count_column
from .bind_aggregates import Q, rounded
from .registry import register, rnd
from .tables import END, START, Tables, _case, pad_sql, ratio_sql, with_views


@register("pad_code", f"""SELECT o_orderkey, {pad_sql("CASE WHEN o_orderstatus = 'P' THEN '0' ELSE CAST(o_custkey AS VARCHAR) END", 2)} AS code2,
 CASE WHEN o_orderstatus = 'P' THEN '000' ELSE {pad_sql('CAST(o_custkey AS VARCHAR)', 3)} END AS code3,
 CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {pad_sql('CAST(o_custkey AS VARCHAR)', 5)} END AS code5 FROM orders""")
def _(t: Tables):
    code = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string"))
    return t.table("orders").select("o_orderkey", fc.pad_code(F.coalesce(code, F.lit("0")), 2).alias("code2"),
                                    fc.pad_code(code, 3, "000").alias("code3"), fc.pad_code(code, 5).alias("code5"))


@register("compose_key", with_views("""SELECT o_orderkey, "fipsStateCode" || "fipsCountyCode" AS county_fips, "fipsCountyCode" = '000' AS is_statewide FROM raw_ev""", "raw_ev"))
def _(t: Tables):
    return t.raw_events().select("o_orderkey", fc.compose_key("fipsStateCode", "fipsCountyCode").alias("county_fips"),
                                 fc.is_statewide("fipsCountyCode").alias("is_statewide"))


@register("key_prefix", with_views("SELECT county_fips, substr(county_fips, 1, 2) AS state_code FROM demo", "demo"))
def _(t: Tables):
    return t.demographics().select("county_fips", fc.key_prefix("county_fips").alias("state_code"))


@register("map_category", with_views(f"""SELECT "incidentType", {_case('"incidentType"', fv.INCIDENT_CATEGORY, "'Other'")} AS disaster_category, count(*) AS n FROM raw_ev GROUP BY 1, 2""", "raw_ev"))
def _(t: Tables):
    mapped = t.raw_events().withColumn("disaster_category", fc.lookup("incidentType", fv.INCIDENT_CATEGORY, fv.DEFAULT_CATEGORY))
    return mapped.groupBy("incidentType", "disaster_category").agg(F.count(F.lit(1)).alias("n"))


@register("map_region", with_views(f"""SELECT county_fips, {_case('s', fv.STATE_REGION, '0')} AS region, {_case('s', fv.STATE_REGION, 'NULL')} AS region_or_null,
 {_case('s', fv.STATE_ABBREVIATION, 'NULL')} AS state_abbr FROM (SELECT county_fips, substr(county_fips, 1, 2) AS s FROM demo)""", "demo"))
def _(t: Tables):
    code = fc.key_prefix("county_fips")
    return t.demographics().select("county_fips", pn.region_of(code).alias("region"), fc.lookup(code, fv.STATE_REGION).alias("region_or_null"),
                                   fc.lookup(code, fv.STATE_ABBREVIATION).alias("state_abbr"))


_PROP = "regexp_extract(props, ': *([^}]*)\\}', 1)"


@register("safe_numeric", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), 0.0) END AS k,
 CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events""")
def _(t: Tables):
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.regexp_extract("props", "([0-9]+)", 1))
    value = F.when(F.col("event_type") == "view", ".").otherwise(F.col("value").cast("string"))
    return t.table("events").select("event_id", fc.number_or_zero(text).alias("k"), fc.number(value).alias("value"))


@register("safe_timestamp", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE epoch_us(o_orderdate) // 1000000 END AS seconds FROM orders""")
def _(t: Tables):
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("2024-02-30 at "), "o_orderpriority")).otherwise(F.col("o_orderdate").cast("string"))
    return t.table("orders").select("o_orderkey", F.unix_seconds(fc.timestamp(text)).alias("seconds"))


@register("date_parts", """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q,
 CAST(date_trunc('month', o_orderdate) AS DATE) AS ym FROM orders""")
def _(t: Tables):
    d = F.col("o_orderdate")
    return t.table("orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.quarter(d).alias("q"), F.trunc(d, "month").alias("ym"))


@register("make_month_date", "SELECT make_date(year(l_shipdate), month(l_shipdate), 1) AS date, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables):
    return (t.table("lineitem").groupBy(fc.month_start(F.year("l_shipdate"), F.month("l_shipdate")).alias("date"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("duration_days", with_views(f"SELECT o_orderkey, {rnd('round_even((epoch_us(e) - epoch_us(b)) / 1e6 / 86400.0, 1)')} AS days FROM raw_ev", "raw_ev"))
def _(t: Tables):
    return t.raw_events().select("o_orderkey", fc.duration_days(fc.timestamp("incidentBeginDate"), fc.timestamp("incidentEndDate")).alias("days"))


_LINE = "l_orderkey, l_linenumber"


@register("sum_components", f"""SELECT {_LINE}, {rnd('l_extendedprice * (1 - l_discount) + l_extendedprice * l_tax + CASE WHEN l_returnflag = chr(82) THEN 0 ELSE l_quantity END', 6)} AS paid FROM lineitem""", digits=6)
def _(t: Tables):
    price = F.col("l_extendedprice")
    parts = t.table("lineitem").withColumns({"building": price * (1 - F.col("l_discount")), "contents": price * F.col("l_tax"),
                                             "compliance": F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))})
    return parts.select("l_orderkey", "l_linenumber", fc.total("building", "contents", "compliance").alias("paid"))


@register("guarded_ratio", with_views(f"""SELECT county_fips, year, {rnd(ratio_sql('claim_count', 'policy_count'), 6)} AS claims_per_policy,
 {rnd(ratio_sql('claim_count', 'total_population'), 6)} AS claims_per_capita, {rnd(ratio_sql('ha_total_damage', 'total_population'), 6)} AS damage_per_capita,
 {rnd(ratio_sql('total_claims_paid', 'mean_household_income'), 6)} AS paid_per_income FROM pf""", "pf"), digits=6)
def _(t: Tables):
    return t.panel_features().select(
        *pn.KEY, fc.guarded_ratio("claim_count", "policy_count").alias("claims_per_policy"),
        fc.guarded_ratio("claim_count", "total_population").alias("claims_per_capita"),
        fc.guarded_ratio("ha_total_damage", "total_population").alias("damage_per_capita"),
        fc.guarded_ratio("total_claims_paid", "mean_household_income").alias("paid_per_income"))


@register("log1p_features", with_views(f"SELECT county_fips, year, {', '.join(f'''{rnd(f'ln(1 + {c})', 6)} AS log_{c}''' for c in pn.LOGS)} FROM pf", "pf"), digits=6)
def _(t: Tables):
    return t.panel_features().select(*pn.KEY, *[F.log1p(c).alias(f"log_{c}") for c in pn.LOGS])


@register("weighted_index", with_views(f"""SELECT county_fips, year, {rnd('total_disasters + flood_count * 0.5 + hurricane_count * 1.5 + wildfire_count')} AS exposure,
 {rnd('total_disasters + flood_count * 0.5')} AS partial_exposure FROM ev_year""", "ev_year"))
def _(t: Tables):
    e = t.events_year()
    return e.select(*pn.KEY, fc.weighted_index(e.columns, fv.EXPOSURE_WEIGHTS).alias("exposure"),
                    fc.weighted_index(["total_disasters", "flood_count"], fv.EXPOSURE_WEIGHTS).alias("partial_exposure"))


@register("null_to_zero", with_views("SELECT county_fips, year, coalesce(claim_count, 0) AS claim_count FROM ev_year LEFT JOIN claims_year USING (county_fips, year)", "ev_year", "claims_year"))
def _(t: Tables):
    from ..operators import insurance as ins
    counts = (ins.valid_claims(t.raw_claims(), START, END).groupBy("county_fips", F.col("yearOfLoss").alias("year"))
              .agg(F.count(F.lit(1)).alias("claim_count")))
    spine = t.events_year().select(*pn.KEY)
    return spine.join(counts, pn.KEY, "left").fillna(0, ["claim_count"])


@register("unit_scale", with_views(f"SELECT county_fips, year, {', '.join(f'''{rnd(f'{Q(c)} / {d}', 9)} AS {Q(c)}''' for c, d in fv.UNIT_DIVISORS.items())} FROM pf", "pf"), digits=9)
def _(t: Tables):
    from ..models.features import scale_units
    return scale_units(t.panel_features()).select(*pn.KEY, *fv.UNIT_DIVISORS)


@register("clip_values", f"SELECT {_LINE}, {rnd('least(greatest((l_extendedprice - 20000) * 300, 1), 1e7)', 3)} AS clipped FROM lineitem", digits=3)
def _(t: Tables):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", fc.clip((F.col("l_extendedprice") - 20000) * 300, 1.0, 1e7).alias("clipped"))


@register("one_hot", with_views(f"SELECT county_fips, year, {', '.join(f'CASE WHEN fema_region = {r} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fema_region_{r}' for r in fv.REGIONS)} FROM pf", "pf"))
def _(t: Tables):
    from ..models.features import region_dummies
    return region_dummies(t.panel_features()).select(*pn.KEY, *[f"fema_region_{r}" for r in fv.REGIONS])


@register("available_columns", with_views("SELECT county_fips, year, CAST(total_disasters AS DOUBLE) AS total_disasters, CAST(flood_count AS DOUBLE) AS flood_count, 0.0::DOUBLE AS not_landed FROM pf", "pf"))
def _(t: Tables):
    from ..models.features import with_all
    return with_all(t.panel_features(), ["total_disasters", "flood_count", "not_landed"]).select(*pn.KEY, "total_disasters", "flood_count", "not_landed")


@register("range_filter", with_views("SELECT county_fips, year, total_disasters FROM pf WHERE year BETWEEN 1996 AND 1999 AND county_fips <> '00000' AND avg_claim_severity > 0", "pf"))
def _(t: Tables):
    p = t.panel_features()
    return p.filter(F.col("year").between(1996, 1999) & (F.col("county_fips") != "00000") & (F.col("avg_claim_severity") > 0)).select(*pn.KEY, "total_disasters")


@register("bool_not_filter", with_views('SELECT county_fips, "disasterNumber" FROM ev WHERE NOT is_statewide', "ev"))
def _(t: Tables):
    return t.events().filter(~F.col("is_statewide")).select("county_fips", "disasterNumber")


@register("isin_filter", with_views("""SELECT county_fips, "disasterNumber", state, disaster_category FROM ev WHERE state IN ('NATION_1', 'NATION_7') AND disaster_category IN
 (SELECT disaster_category FROM ev GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)""", "ev"))
def _(t: Tables):
    events = t.events()
    return (sm.keep_top(events, "disaster_category", 3).filter(F.col("state").isin("NATION_1", "NATION_7"))
            .select("county_fips", "disasterNumber", "state", "disaster_category"))


@register("complete_rows", with_views("""SELECT county_fips, year FROM pf WHERE total_population IS NOT NULL AND avg_premium IS NOT NULL AND claim_count_lag1 IS NOT NULL""", "pf"))
def _(t: Tables):
    return t.panel_features().dropna("any", subset=["total_population", "avg_premium", "claim_count_lag1"]).select(*pn.KEY)


@register("prefix_filter", "SELECT p_type, p_brand, count(*) AS n FROM part WHERE NOT starts_with(p_brand, 'Brand#1') AND p_type <> 'ECONOMY' GROUP BY 1, 2")
def _(t: Tables):
    kept = t.table("part").filter(~F.col("p_brand").startswith("Brand#1") & (F.col("p_type") != "ECONOMY"))
    return kept.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@register("regex_extract_int", "SELECT p_partkey, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS brand_number FROM part")
def _(t: Tables):
    return t.table("part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("brand_number"))


_COUNTED = ", ".join(f"count(*) FILTER (disaster_category = '{c}') AS {count_column(c)}" for c in fv.CATEGORIES)


@register("normalise_colnames", with_views(f"SELECT state, {_COUNTED} FROM ev GROUP BY 1", "ev"))
def _(t: Tables):
    return rp.counted_columns(sm.count_matrix(t.events(), ["state"], "disaster_category", fv.CATEGORIES), ["state"])


@register("significance_band", f"""SELECT l_orderkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS sig,
 {rnd('(exp(b) - 1) * 100')} AS pct_effect, CASE WHEN b > 0.05 THEN 'red' WHEN b > 0.03 THEN 'orange' ELSE 'green' END AS ks_colour,
 CASE WHEN b < 0.02 THEN 'red' WHEN b < 0.04 THEN 'orange' ELSE 'green' END AS auc_colour
 FROM (SELECT l_orderkey, avg(l_discount) * CAST(1.0073 AS DOUBLE) AS p, avg(l_tax) * CAST(1.0073 AS DOUBLE) AS b FROM lineitem GROUP BY 1)""")
def _(t: Tables):
    per_order = t.table("lineitem").groupBy("l_orderkey").agg((F.avg("l_discount") * 1.0073).alias("p"), (F.avg("l_tax") * 1.0073).alias("b"))
    return per_order.select("l_orderkey", fc.significance("p").alias("sig"), fc.percent_effect(F.exp("b")).alias("pct_effect"),
                            fc.band("b", [(0.05, "red"), (0.03, "orange")], "green").alias("ks_colour"),
                            fc.band("b", [(0.02, "red"), (0.04, "orange")], "green", above=False).alias("auc_colour"))


@register("format_summary", """WITH m AS (SELECT o_orderpriority AS model_name, CASE WHEN o_orderstatus = 'P' THEN avg(o_totalprice) ELSE count(*) / 3001.0 / 5 END AS v,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE count(*) / 7001.0 END AS cv, o_orderstatus AS metric, sum(o_totalprice) AS s FROM orders GROUP BY o_orderpriority, o_orderstatus)
SELECT model_name AS "Model", metric AS "Metric", CASE WHEN v IS NULL THEN '—' WHEN v > 10 THEN format('{:,.1f}', v) ELSE format('{:.3f}', v) END AS "Test Score",
 CASE WHEN cv IS NULL THEN '—' ELSE format('{:.3f}', cv) END AS "CV Score",
 CASE metric WHEN 'P' THEN 'AIC = ' || format('{:,.0f}', s) WHEN 'F' THEN 'Brier = ' || format('{:.3f}', v) ELSE '—' END AS "Notes" FROM m""")
def _(t: Tables):
    status = F.col("o_orderstatus")
    m = (t.table("orders").groupBy("o_orderpriority", "o_orderstatus")
         .agg(F.avg("o_totalprice").alias("a"), F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s")))
    value = F.when(status == "P", F.col("a")).otherwise(F.col("n") / 3001.0 / 5)
    rows = m.select(F.lit(2).alias("module"), F.col("o_orderpriority").alias("model_name"), status.alias("primary_metric"), value.alias("metric_value"),
                    F.when(status != "O", F.col("n") / 7001.0).alias("cv_metric"), F.lit(None).cast("double").alias("cv_std"),
                    F.when(status == "P", F.concat(F.lit("AIC="), F.col("s").cast("string"))).when(status == "F", F.concat(F.lit("Brier="), value.cast("string"))).alias("notes"))
    return rp.summary_table(rows).select("Model", "Metric", "Test Score", "CV Score", "Notes")


_LABELS = "CASE fema_region " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fv.REGION_LABEL.items()) + " END"


@register("label_lookup", with_views(f"SELECT county_fips, year, {_LABELS} AS region_label FROM pf WHERE fema_region BETWEEN 1 AND 10", "pf"))
def _(t: Tables):
    return (t.panel_features().withColumn("region_label", fc.lookup("fema_region", fv.REGION_LABEL)).dropna(subset=["region_label"])
            .select(*pn.KEY, "region_label"))
