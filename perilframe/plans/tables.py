"""Domain views over the given tables.

Orders stand in for event declarations, line items for claims and assistance, orders of the year
before for policies, customers for demographics and shipping months for macro series. ``SQL`` holds
the same views as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as fc
from ..functions import fixed_values as fv
from ..operators import events as ev
from ..operators import insurance as ins
from ..operators import panel as pn
from ..operators.events import count_column
from ..operators.guard import JoinGuard
from ..session import SETTINGS, joins_by_part_of_key, scratch_path
from ..sources.sinks import write_stage

START, END, CUT = 1995, 2001, 1999

_RAW_INCIDENT = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Hurricane' WHEN '2-HIGH' THEN 'Flood'
 WHEN '3-MEDIUM' THEN 'Severe Storm(s)' WHEN '4-NOT SPECIFIED' THEN 'Fire'
 ELSE CASE WHEN o_totalprice > 250000 THEN 'Snow' ELSE 'Unlisted' END END"""

DEMOGRAPHIC_SQL = {
    "total_population": "CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE abs(c_acctbal) * 10.0 + 100.0 END",
    "median_household_income": "c_acctbal * 5.0 + 50000.0",
    "mean_household_income": "c_acctbal * 1.0",
    "median_home_value": "CAST(100000 + (c_custkey % 97) * 1500 AS DOUBLE)",
    "pct_occupied_housing": "CAST(50 + c_custkey % 41 AS DOUBLE)",
    "unemployment_rate": "CAST(4 + c_custkey % 13 AS DOUBLE) / 2",
}


class Tables:
    """Lazy views for one (session, folder); stage tables are written once and reused."""

    _cache: dict[tuple[int, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
            spark.conf.set(key, SETTINGS[key])
        self._stages: dict[str, DataFrame] = {}
        self._values: dict[str, object] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        key = (id(spark), spark.sparkContext.applicationId, sf_dir)
        if key not in cls._cache:
            cls._cache[key] = cls(spark, sf_dir)
        return cls._cache[key]

    def table(self, name: str) -> DataFrame:
        # The handle is kept so that the schema is read from the footers once.
        return self.once(f"table:{name}", lambda: self.spark.read.parquet(f"{self.dir}/{name}.parquet"))

    def stage(self, name: str, build) -> DataFrame:
        """Write a view to the shared scratch folder on first use; later queries read the files."""
        if name not in self._stages:
            self._stages[name] = write_stage(build(), scratch_path(self.spark, name))
        return self._stages[name]

    def once(self, name: str, build):
        """Remember a fitted model or another driver-side handle."""
        if name not in self._values:
            self._values[name] = build()
        return self._values[name]

    # ---- raw sources -------------------------------------------------------------------------
    def customers(self) -> DataFrame:
        return self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))

    def customer_orders(self) -> DataFrame:
        # Orders first: joining the two dimensions first would hide from the optimizer that they are small.
        return (self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
                .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")))

    def _shipped(self) -> DataFrame:
        """Lines of each order reduced to the end of the incident."""
        return self.table("lineitem").groupBy("l_orderkey").agg(
            F.max("l_shipdate").cast("timestamp").alias("last_ship"), F.max("l_quantity").alias("top_quantity"))

    def raw_events(self) -> DataFrame:
        joined = self.customer_orders().join(self._shipped(), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return joined.select(
            F.expr("o_orderkey div 8").alias("disasterNumber"),
            F.col("n_name").alias("state"),
            F.col("o_orderdate").cast("string").alias("declarationDate"),
            F.expr(_RAW_INCIDENT).alias("incidentType"),
            F.col("o_orderdate").cast("string").alias("incidentBeginDate"),
            F.expr("cast(last_ship + make_interval(0, 0, 0, 0, cast(top_quantity as int)) as string)").alias("incidentEndDate"),
            (F.col("n_nationkey") + 1).cast("string").alias("fipsStateCode"),
            F.expr("CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN NULL ELSE cast(o_custkey as string) END").alias("fipsCountyCode"),
            F.col("c_mktsegment").alias("designatedArea"),
            "o_orderkey", "o_totalprice")

    def events(self) -> DataFrame:
        return ev.clean_events(self.raw_events(), START, END, order=[F.col("o_orderkey")])

    def _county(self):
        return fc.compose_key((F.col("n_nationkey") + 1), F.col("o_custkey"))

    def raw_claims(self) -> DataFrame:
        # What is asked of a line alone is asked before the joins, whose shuffles then carry a number or a flag instead of text.
        asked = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_extendedprice", "l_tax", "l_discount", "l_quantity", F.year("l_shipdate").alias("yearOfLoss"),
            ((F.col("l_linenumber") == 7) & (F.col("l_tax") == 0)).alias("unreadable"),
            ((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 3)).alias("unplaced"), (F.col("l_returnflag") == "R").alias("primary"))
        # Parts come first: lines of one order are then together last, so that claims of one county are combined before they are dealt by it.
        lines = (asked.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
                 .join(self.customer_orders(), F.col("l_orderkey") == F.col("o_orderkey")))
        price = F.col("l_extendedprice")
        covered = F.col("l_quantity") >= 2
        return lines.select(
            "yearOfLoss",
            F.when(F.col("unplaced"), F.lit(None)).otherwise(self._county()).alias("countyCode"),
            F.col("n_name").alias("state"),
            F.when(F.col("unreadable"), "n/a").otherwise((price * 0.73291173).cast("string")).alias("amountPaidOnBuildingClaim"),
            (price * F.col("l_tax") * 0.31847331).alias("amountPaidOnContentsClaim"),
            (price * F.col("l_discount") * 0.11739117).alias("amountPaidOnIncreasedCostOfComplianceClaim"),
            F.when(covered, F.col("l_quantity") * F.col("p_retailprice") * 1.09371373).otherwise(0.0).alias("totalBuildingInsuranceCoverage"),
            F.when(covered, 500.0).otherwise(0.0).alias("totalContentsInsuranceCoverage"),
            (price * 1.01937719).alias("buildingDamageAmount"),
            (F.col("l_quantity") * 1.37291933).alias("contentsDamageAmount"),
            F.when(F.col("primary"), "Y").otherwise("N").alias("primaryResidenceIndicator"))

    def raw_policies(self) -> DataFrame:
        return self.customer_orders().select(
            F.col("n_name").alias("propertyState"),
            F.when((F.col("o_orderstatus") != "P") | (F.col("o_totalprice") >= 20000), self._county()).alias("countyCode"),
            (F.col("o_totalprice") * 0.0073291173).alias("totalInsurancePremiumOfThePolicy"),
            (F.col("o_totalprice") * 2.01937719).alias("totalBuildingInsuranceCoverage"),
            (F.col("o_totalprice") * 0.51937719).alias("totalContentsInsuranceCoverage"),
            F.expr("o_orderdate + interval 1 year").alias("policyEffectiveDate"),
            F.expr("1 + o_orderkey % 3").alias("policyCount"))

    def raw_assistance(self) -> DataFrame:
        asked = self.table("lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                              (F.col("l_returnflag") == "R").alias("returned"))
        lines = asked.join(self.customer_orders(), F.col("l_orderkey") == F.col("o_orderkey"))
        returned = F.col("returned")
        return lines.select(
            F.expr("o_orderkey div 8").alias("disasterNumber"), F.col("n_name").alias("state"),
            F.col("l_quantity").alias("totalInspected"),
            F.when(returned, F.col("l_extendedprice") * 1.01937719).otherwise(0.0).alias("totalDamage"),
            (F.col("l_extendedprice") * F.col("l_discount") * 1.09371373).alias("totalApprovedIhpAmount"),
            (F.col("l_extendedprice") * F.col("l_tax") * 1.37291933).alias("repairReplaceAmount"),
            (F.col("l_quantity") * 10.0).alias("rentalAmount"),
            F.lit(0.0).alias("otherNeedsAmount"),
            F.when(returned, 1.0).otherwise(0.0).alias("approvedForFemaAssistance"),
            F.lit(1.0).alias("validRegistrations"))

    def demographics(self) -> DataFrame:
        return self.customers().select(
            fc.compose_key(F.col("n_nationkey") + 1, F.col("c_custkey")).alias("county_fips"),
            F.col("c_name").alias("NAME"), *[F.expr(e).alias(n) for n, e in DEMOGRAPHIC_SQL.items()])

    def _daily_lines(self) -> DataFrame:
        """Sums and counts per day, from which all four macro series follow with one scan of the lines."""
        values = ("l_discount", "l_extendedprice", "l_quantity", "l_tax")
        return self.table("lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
            *[F.sum(v).alias(f"{v}_sum") for v in values], *[F.count(v).alias(f"{v}_n") for v in values])

    def macro_series(self) -> list[DataFrame]:
        """Four series of different frequency: monthly, monthly, monthly and weekly."""
        daily = self.stage("daily_lines", self._daily_lines)

        def series(unit: str, value: str, name: str, scale: float) -> DataFrame:
            mean = F.try_divide(F.sum(f"{value}_sum"), F.sum(f"{value}_n")) * F.lit(scale)
            return daily.groupBy(F.date_trunc(unit, "day").cast("date").alias("date")).agg(mean.alias(name))

        return [series("month", "l_discount", "FEDFUNDS", 100.0),
                series("month", "l_extendedprice", "CPIAUCSL", 0.0073117391),
                series("month", "l_quantity", "CSUSHPINSA", 7.3117391),
                series("week", "l_tax", "MORTGAGE30US", 100.0)]

    def macro(self) -> DataFrame:
        merged = pn.align_series(self.macro_series()).withColumn("series_set", F.lit("national"))
        return pn.forward_fill(merged, fv.MACRO_SERIES, "date", ["series_set"]).drop("series_set")

    # ---- stages ------------------------------------------------------------------------------
    def events_year(self) -> DataFrame:
        return ev.entity_year_with_types(self.events())

    def panel(self) -> DataFrame:
        """The panel: the columns of the feature panel that the joins gave."""
        return self.panel_features().select(*self._values["panel_columns"])

    def panel_features(self) -> DataFrame:
        """The feature panel as a stage table; the joins of the panel are counted while it is written.

        All sides of the joins are dealt by entity alone, as the features need them, so the wide rows of the panel are never
        shuffled, and the panel below the features is not written on its own.
        """
        def build() -> DataFrame:
            events, guard = self.clean_events_stage(), JoinGuard()
            joined = pn.build_panel(
                ev.entity_year_with_types(events), ins.claims_entity_year(self.raw_claims(), START, END),
                ins.assistance_entity_year(self.raw_assistance(), events), self.demographics(),
                pn.annual_means(self.macro(), START, END), ins.policies_entity_year(self.raw_policies()), guard=guard)
            with joins_by_part_of_key(self.spark):
                landed = write_stage(pn.engineer_features(joined), scratch_path(self.spark, "panel_features"))
            guard.verify()
            self._values["panel_columns"] = joined.columns
            return landed
        return self.once("panel_features", build)

    def clean_events_stage(self) -> DataFrame:
        return self.stage("events_clean", self.events)

    def series_month(self) -> DataFrame:
        """Monthly event counts per category, without the empty months."""
        return ev.national_month(self.clean_events_stage())

    # ---- (y, score) frames -------------------------------------------------------------------
    def event_scores(self) -> DataFrame:
        """Nearly continuous scores, grouped by day."""
        return self.table("events").select(
            "event_id", F.dayofmonth("ts").alias("day"), (F.col("event_type") == "purchase").cast("int").alias("y"),
            F.least(F.col("value") / 500.0, F.lit(1.0)).alias("score"))

    def line_scores(self) -> DataFrame:
        """Eleven distinct scores, so nearly everything is tied."""
        return self.table("lineitem").select(
            "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("grp"),
            (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("score"))


# ---- the same views for the oracle ---------------------------------------------------------------
def _case(expr: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else chr(39) + v + chr(39)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def pad_sql(expr: str, n: int) -> str:
    return f"CASE WHEN length({expr}) < {n} THEN lpad({expr}, {n}, '0') ELSE {expr} END"


def ratio_sql(n: str, d: str, other: str = "0.0") -> str:
    return f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE {other} END"


_COUNTY = (f"({pad_sql('CAST(n_nationkey + 1 AS VARCHAR)', 2)}) || ({pad_sql('CAST(o_custkey AS VARCHAR)', 3)})")
CAT_COUNTS = ", ".join(f"count(*) FILTER (disaster_category = '{c}') AS {count_column(c)}" for c in fv.CATEGORIES)

SQL: dict[str, str] = {}
SQL["co"] = """co AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SQL["raw_ev"] = f"""raw_ev AS (SELECT o_orderkey // 8 AS "disasterNumber", n_name AS state, o_orderdate AS "declarationDate",
 {_RAW_INCIDENT} AS "incidentType", o_orderdate AS b, last_ship + to_hours(CAST(top_quantity AS BIGINT)) AS e,
 {pad_sql('CAST(n_nationkey + 1 AS VARCHAR)', 2)} AS "fipsStateCode",
 CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN '000' ELSE {pad_sql('CAST(o_custkey AS VARCHAR)', 3)} END AS "fipsCountyCode",
 c_mktsegment AS "designatedArea", o_orderkey, o_totalprice
 FROM co LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship, max(l_quantity) AS top_quantity FROM lineitem GROUP BY 1)
 ON o_orderkey = l_orderkey)"""
SQL["ev"] = f"""ev AS (SELECT * FROM (SELECT *, "fipsStateCode" || "fipsCountyCode" AS county_fips,
 "fipsCountyCode" = '000' AS is_statewide, {_case('"incidentType"', fv.INCIDENT_CATEGORY, "'Other'")} AS disaster_category,
 year("declarationDate") AS declaration_year, month("declarationDate") AS declaration_month,
 quarter("declarationDate") AS declaration_quarter, date_trunc('month', "declarationDate") AS year_month,
 round_even((epoch_us(e) - epoch_us(b)) / 1e6 / 86400.0, 1) AS incident_duration_days FROM raw_ev
 WHERE year("declarationDate") BETWEEN {START} AND {END})
 QUALIFY row_number() OVER (PARTITION BY "disasterNumber", county_fips ORDER BY o_orderkey) = 1)"""
SQL["claims"] = f"""claims AS (SELECT *, CASE WHEN coverage > 0 THEN paid / coverage ELSE 0 END AS loss_ratio FROM (
 SELECT year(l_shipdate) AS year, CASE WHEN l_linestatus = 'F' AND l_quantity < 3 THEN '00000' ELSE
 ({pad_sql(_COUNTY, 5)}) END AS county_fips, n_name AS state,
 CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN 0.0 ELSE l_extendedprice * CAST(0.73291173 AS DOUBLE) END
 + l_extendedprice * l_tax * CAST(0.31847331 AS DOUBLE) + l_extendedprice * l_discount * CAST(0.11739117 AS DOUBLE) AS paid,
 CASE WHEN l_quantity >= 2 THEN l_quantity * p_retailprice * CAST(1.09371373 AS DOUBLE) + 500.0 ELSE 0.0 END AS coverage,
 l_extendedprice * CAST(1.01937719 AS DOUBLE) + l_quantity * CAST(1.37291933 AS DOUBLE) AS damage,
 CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS is_primary
 FROM lineitem JOIN co ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
 WHERE county_fips <> '00000' AND year BETWEEN {START} AND {END})"""
SQL["claims_year"] = """claims_year AS (SELECT county_fips, year, count(*) AS claim_count, sum(paid) AS total_claims_paid,
 avg(paid) AS avg_claim_severity, quantile_cont(paid, 0.5) AS median_claim_severity, max(paid) AS max_claim_severity,
 sum(damage) AS total_damage_reported, avg(loss_ratio) AS avg_loss_ratio, avg(coverage) AS avg_coverage,
 avg(is_primary) AS pct_primary_residence FROM claims GROUP BY 1, 2)"""
SQL["policies_year"] = f"""policies_year AS (SELECT county AS "countyCode", state AS "propertyState", year, avg(premium) AS avg_premium,
 quantile_cont(premium, 0.5) AS median_premium, sum(premium) AS total_premium, sum(bc) AS total_building_coverage,
 sum(cc) AS total_contents_coverage, CAST(sum(n) AS DOUBLE) AS policy_count, count(*) AS n_records FROM (
 SELECT CASE WHEN o_orderstatus <> 'P' OR o_totalprice >= 20000 THEN ({pad_sql(_COUNTY, 5)}) END AS county, n_name AS state,
 year(o_orderdate + INTERVAL 1 YEAR) AS year, o_totalprice * CAST(0.0073291173 AS DOUBLE) AS premium,
 o_totalprice * CAST(2.01937719 AS DOUBLE) AS bc, o_totalprice * CAST(0.51937719 AS DOUBLE) AS cc, 1 + o_orderkey % 3 AS n FROM co)
 WHERE county IS NOT NULL GROUP BY 1, 2, 3)"""
SQL["ha"] = """ha AS (SELECT o_orderkey // 8 AS "disasterNumber", n_name AS state, l_quantity AS q,
 CASE WHEN l_returnflag = 'R' THEN l_extendedprice * CAST(1.01937719 AS DOUBLE) ELSE 0.0 END AS damage,
 l_extendedprice * l_discount * CAST(1.09371373 AS DOUBLE) AS approved, l_extendedprice * l_tax * CAST(1.37291933 AS DOUBLE) AS repair,
 l_quantity * 10.0 AS rental, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS ok FROM lineitem JOIN co ON l_orderkey = o_orderkey)"""
SQL["emap"] = """emap AS (SELECT "disasterNumber", state, county_fips, declaration_year AS year FROM ev
 QUALIFY row_number() OVER (PARTITION BY "disasterNumber", state ORDER BY declaration_year, county_fips) = 1)"""
SQL["ha_year"] = """ha_year AS (SELECT county_fips, year, sum(q) AS ha_total_inspected, sum(damage) AS ha_total_damage,
 sum(approved) AS ha_total_approved, sum(repair) AS ha_repair_replace, sum(rental) AS ha_rental_amount,
 CAST(count(*) AS DOUBLE) AS ha_valid_registrations, sum(ok) AS ha_approved_count
 FROM ha JOIN emap USING ("disasterNumber", state) GROUP BY 1, 2)"""
SQL["ev_year"] = f"""ev_year AS (SELECT * FROM (SELECT county_fips, "fipsStateCode", state, declaration_year AS year,
 count(DISTINCT "disasterNumber") AS total_disasters, count(DISTINCT disaster_category) AS disaster_types,
 avg(incident_duration_days) AS avg_incident_duration, max(incident_duration_days) AS max_incident_duration
 FROM ev WHERE NOT is_statewide GROUP BY 1, 2, 3, 4) LEFT JOIN (SELECT county_fips, declaration_year AS year, {CAT_COUNTS}
 FROM ev WHERE NOT is_statewide GROUP BY 1, 2) USING (county_fips, year))"""
SQL["demo"] = f"""demo AS (SELECT ({pad_sql('CAST(n_nationkey + 1 AS VARCHAR)', 2)}) || ({pad_sql('CAST(c_custkey AS VARCHAR)', 3)}) AS county_fips,
 c_name AS "NAME", {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in DEMOGRAPHIC_SQL.items())}
 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
SQL["macro_raw"] = """macro_raw AS (SELECT date, f AS "FEDFUNDS", c AS "CPIAUCSL", h AS "CSUSHPINSA", m AS "MORTGAGE30US" FROM
 (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_discount * 100) AS f,
 avg(l_extendedprice * CAST(0.0073117391 AS DOUBLE)) AS c, avg(l_quantity * CAST(7.3117391 AS DOUBLE)) AS h FROM lineitem GROUP BY 1)
 FULL JOIN (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, avg(l_tax * 100) AS m FROM lineitem GROUP BY 1) USING (date))"""
SQL["macro"] = "macro AS (SELECT date, " + ", ".join(
    f'last_value("{c}" IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "{c}"'
    for c in fv.MACRO_SERIES) + " FROM macro_raw)"
SQL["macro_year"] = f"""macro_year AS (SELECT year(date) AS year, {', '.join(f'avg("{c}") AS "{c}"' for c in fv.MACRO_SERIES)}
 FROM macro WHERE year(date) BETWEEN {START} AND {END} GROUP BY 1)"""
SQL["panel"] = f"""panel AS (SELECT * REPLACE ({', '.join(f'coalesce({c}, 0) AS {c}' for c in pn.ZERO_FILLED)}) FROM ev_year
 LEFT JOIN claims_year USING (county_fips, year)
 LEFT JOIN (SELECT "countyCode" AS county_fips, year, {', '.join(pn.POLICY_COLUMNS)} FROM policies_year) USING (county_fips, year)
 LEFT JOIN ha_year USING (county_fips, year) LEFT JOIN (SELECT * EXCLUDE ("NAME") FROM demo) USING (county_fips)
 LEFT JOIN macro_year USING (year))"""

_INT = {"year", "total_disasters", "disaster_types", "claim_count", "n_records", "fema_region", "cum_disasters_3yr",
        "premium_surge_flag", "total_disasters_lag1", "claim_count_lag1",
        *[count_column(c) for c in fv.CATEGORIES]}
PANEL_DOUBLES = [
    "avg_incident_duration", "max_incident_duration", "total_claims_paid", "avg_claim_severity", "median_claim_severity",
    "max_claim_severity", "total_damage_reported", "avg_loss_ratio", "avg_coverage", "pct_primary_residence",
    "avg_premium", "median_premium", "total_premium", "total_building_coverage", "total_contents_coverage", "policy_count",
    *ins.ASSISTANCE_AMOUNTS, *DEMOGRAPHIC_SQL, *fv.MACRO_SERIES]
PANEL_INTS = ["total_disasters", "disaster_types", *[count_column(c) for c in fv.CATEGORIES], "claim_count", "n_records"]
FEATURE_SQL = {
    "fema_region": _case('"fipsStateCode"', fv.STATE_REGION, "0"),
    "cum_disasters_3yr": "CAST(sum(total_disasters) OVER (PARTITION BY county_fips ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT)",
    "disaster_exposure_index": " + ".join(f"{c} * CAST({w} AS DOUBLE)" for c, w in fv.EXPOSURE_WEIGHTS.items()),
    **{f"{c}_lag1": f"lag({c}) OVER w" for c in pn.LAGS},
    **{f"log_{c}": f"ln(1 + {c})" for c in pn.LOGS},
    "premium_change_yoy": "CASE WHEN lag(avg_premium) OVER w > 0 THEN (avg_premium - lag(avg_premium) OVER w) / lag(avg_premium) OVER w END",
    "premium_surge_flag": "CASE WHEN lag(avg_premium) OVER w > 0 AND (avg_premium - lag(avg_premium) OVER w) / lag(avg_premium) OVER w > 0.25 THEN 1 ELSE 0 END",
    "claims_per_policy": ratio_sql("claim_count", "policy_count"),
    "damage_per_capita": ratio_sql("ha_total_damage", "total_population"),
    "claims_per_capita": ratio_sql("claim_count", "total_population"),
}


def _q(name: str) -> str:
    return f'"{name}"'


SQL["pf"] = ("pf AS (SELECT county_fips, \"fipsStateCode\", state, year, "
             + ", ".join(_q(c) for c in PANEL_INTS) + ", "
             + ", ".join(_q(c) for c in PANEL_DOUBLES) + ", "
             + ", ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items())
             + " FROM panel WINDOW w AS (PARTITION BY county_fips ORDER BY year))")

_NEEDS = {
    "raw_ev": ["co"], "ev": ["raw_ev"], "claims": ["co"], "claims_year": ["claims"], "policies_year": ["co"], "ha": ["co"],
    "emap": ["ev"], "ha_year": ["ha", "emap"], "ev_year": ["ev"], "macro": ["macro_raw"], "macro_year": ["macro"],
    "panel": ["ev_year", "claims_year", "policies_year", "ha_year", "demo", "macro_year"], "pf": ["panel"],
}


def with_views(query: str, *views: str, extra: str = "") -> str:
    """Prefix ``query`` with the common table expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(view: str) -> None:
        for need in _NEEDS.get(view, []):
            visit(need)
        if view not in order:
            order.append(view)

    for view in views:
        visit(view)
    parts = [SQL[v] for v in order] + ([extra] if extra else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query
