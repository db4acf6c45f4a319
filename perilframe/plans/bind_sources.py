"""Readers and writers, exercised on files that Spark lands from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import events as ev
from ..operators import insurance as ins
from ..operators import metrics as mt
from ..operators import panel as pn
from ..session import scratch_path
from ..sources import readers as rd
from ..sources import sinks as sk
from ..sources.cache import cached
from ..sources.years import YearStore
from .bind_metrics import AP, AUC, LS, YOUDEN, over
from .registry import register, rnd
from .tables import END, START, Tables, pad_sql, with_views


def landed(t: Tables, name: str, write) -> str:
    """Write files once per session and return their path."""
    def build() -> str:
        path = scratch_path(t.spark, name)
        write(path)
        return path
    return t.once(f"landed:{name}", build)


@register("scan_csv_typed", "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS customer, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def _(t: Tables):
    raw = t.table("orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("customer"),
                                   F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
                                   F.col("o_orderdate").cast("date").alias("o_orderdate"))
    path = landed(t, "orders-csv", lambda p: raw.write.csv(p, header=True))
    return rd.read_csv(t.spark, path, "o_orderkey bigint, customer string, o_totalprice double, o_orderdate date", nullValue="n/a")


_RECORD = "o_orderkey: bigint, o_orderstatus: string, o_totalprice: double"


def _pages(t: Tables) -> str:
    """Orders as page documents of at most 1000 records, each announcing the total."""
    orders = t.table("orders")
    announced = orders.agg(F.count(F.lit(1))).scalar()
    pages = (orders.groupBy(F.expr("o_orderkey div 1000").alias("page"))
             .agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("Orders"))
             .select(F.struct(announced.alias("count")).alias("metadata"), "Orders"))
    return landed(t, "orders-pages", lambda p: pages.write.json(p))


@register("scan_paged_json", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t: Tables):
    return rd.read_pages(t.spark, _pages(t), "Orders", _RECORD)


@register("paged_json_completeness", "SELECT count(*) AS announced, count(*) AS delivered, true AS complete FROM orders")
def _(t: Tables):
    return rd.page_completeness(t.spark, _pages(t), "Orders", _RECORD)


_MATRIX_HEADER = ["NAME", "DP05_0001E", "DP03_0062E", "state", "county"]


@register("scan_json_matrix", f"""SELECT ({pad_sql('CAST(c_nationkey + 1 AS VARCHAR)', 2)}) || ({pad_sql('CAST(c_custkey AS VARCHAR)', 3)}) AS county_fips, c_name AS "NAME",
 CAST(c_custkey AS DOUBLE) AS total_population, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal END AS median_household_income FROM customer""")
def _(t: Tables):
    row = F.array(F.col("c_name"), F.col("c_custkey").cast("string"),
                  F.when(F.col("c_mktsegment") == "MACHINERY", "-").otherwise(F.col("c_acctbal").cast("string")),
                  (F.col("c_nationkey") + 1).cast("string"), F.col("c_custkey").cast("string"))
    header = F.array(*[F.lit(h) for h in _MATRIX_HEADER])
    documents = (t.table("customer").groupBy(F.expr("c_custkey div 200").alias("d")).agg(F.collect_list(row).alias("rows"))
                 .select(F.to_json(F.concat(F.array(header), F.col("rows"))).alias("value")))
    path = landed(t, "customer-matrix", lambda p: documents.write.text(p))
    names = {c: n for c, n in fv.DEMOGRAPHIC_VARIABLES.items() if c in _MATRIX_HEADER}
    matrix = rd.matrix_rows(t.spark.read.text(path), "value", _MATRIX_HEADER, names, ["NAME", "state", "county", *names.values()])
    return rd.demographics(matrix, list(names.values()))


@register("scan_macro_csv", f"""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CASE WHEN month(max(l_shipdate)) = 2 THEN NULL ELSE {rnd('avg(l_discount) * 100')} END AS "FEDFUNDS" FROM lineitem GROUP BY 1""")
def _(t: Tables):
    monthly = (t.table("lineitem").groupBy(F.trunc("l_shipdate", "month").alias("DATE"))
               .agg((F.avg("l_discount") * 100).alias("v"))
               .select("DATE", F.when(F.month("DATE") == 2, ".").otherwise(F.col("v").cast("string")).alias("FEDFUNDS")))
    path = landed(t, "macro-csv", lambda p: monthly.write.csv(p, header=True))
    return rd.read_macro_csv(t.spark, path, "FEDFUNDS")


@register("source_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1999-01-01'")
def _(t: Tables):
    d = F.col("o_orderdate")
    in_year = (d >= F.lit("1998-01-01").cast("timestamp_ntz")) & (d < F.lit("1999-01-01").cast("timestamp_ntz"))
    return rd.pushed_scan(t.spark, f"{t.dir}/orders.parquet", ["o_orderkey", "o_totalprice"], in_year)


@register("ingest_year_preagg", with_views(f"""SELECT "countyCode", "propertyState", year, n_records, {rnd('policy_count', 3)} AS policy_count, {rnd('total_premium', 3)} AS total_premium, {rnd('median_premium', 3)} AS median_premium
 FROM policies_year""", "policies_year"), digits=3)
def _(t: Tables):
    return t.spark.read.parquet(_policy_years(t)).select(
        "countyCode", "propertyState", "year", "n_records", "policy_count", "total_premium", "median_premium")


def _policy_years(t: Tables) -> str:
    def land(path: str) -> None:
        yearly = ins.policies_entity_year(t.raw_policies())
        sk.overwrite_years(yearly, path)
        # A later increment replaces its own years and leaves the rest alone.
        sk.overwrite_years(yearly.filter(F.col("year") == 1998), path)
    return landed(t, "policies-by-year", land)


@register("ingest_year_manifest", with_views(f"""SELECT "countyCode", "propertyState", year, n_records, {rnd('total_premium', 3)} AS total_premium, {rnd('median_premium', 3)} AS median_premium
 FROM policies_year""", "policies_year"), digits=3)
def _(t: Tables):
    """Policies by year in two increments; 1998 fails at first and is repaired, and a year without policies is listed."""
    premium_name = "totalInsurancePremiumOfThePolicy"

    def land(path: str) -> None:
        premium = F.col(premium_name)
        rows = t.raw_policies().filter(F.col("countyCode").isNotNull()).select(
            F.lpad("countyCode", F.greatest(F.length("countyCode"), F.lit(5)), F.lit("0")).alias("countyCode"), "propertyState", premium,
            F.year("policyEffectiveDate").alias("year"))
        years = [r["year"] for r in rows.select("year").distinct().orderBy("year").collect()]  # one row per year
        store = YearStore(t.spark, path, ["countyCode", "propertyState"], premium_name)
        for batch, chosen in (("small", premium < 1000), ("large", F.coalesce(premium >= 1000, F.lit(True)))):
            for year in [*years, years[-1] + 1]:
                wanted = rows.filter((F.col("year") == year) & chosen)
                if year == 1998 and batch == "small":
                    store.add(year, lambda wanted=wanted: wanted.select("never_landed"), batch)
                store.add(year, lambda wanted=wanted: wanted, batch)

    store = YearStore(t.spark, landed(t, "policy-manifest", land), ["countyCode", "propertyState"], premium_name)
    return store.figures().select("countyCode", "propertyState", "year", "n_records", F.col("total").alias("total_premium"),
                                  F.col("median").alias("median_premium"))


@register("read_year_partitions", with_views(f"""SELECT year, count(*) AS n_rows, CAST(sum(n_records) AS BIGINT) AS n_records
 FROM policies_year WHERE year BETWEEN 1997 AND 2000 GROUP BY 1""", "policies_year"))
def _(t: Tables):
    """Only the partitions of the named years are read."""
    return (sk.read_years(t.spark, _policy_years(t), [1997, 1998, 1999, 2000]).groupBy("year")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_records").alias("n_records")))


@register("optional_source", with_views("SELECT county_fips, year, total_disasters, NULL::DOUBLE AS avg_premium, NULL::DOUBLE AS premium_change_yoy, NULL::BIGINT AS premium_surge_flag, 0.0::DOUBLE AS claims_per_policy FROM ev_year", "ev_year"))
def _(t: Tables):
    absent = rd.optional_table(t.spark, scratch_path(t.spark, "never-landed"), "county_fips string, year int, avg_premium double")
    panel = t.events_year().join(absent, pn.KEY, "left").withColumns({"claim_count": F.lit(0), "avg_claim_severity": F.lit(0.0)})
    features = pn.engineer_features(panel.drop("avg_premium"))
    return features.join(panel.select(*pn.KEY, "avg_premium"), pn.KEY).select(
        *pn.KEY, "total_disasters", "avg_premium", "premium_change_yoy", "premium_surge_flag", "claims_per_policy")


@register("sink_stage_tables", with_views("""SELECT "fipsStateCode", state, declaration_year AS year, declaration_month AS month, disaster_category, count(*) AS disaster_count, count(DISTINCT "disasterNumber") AS unique_disasters FROM ev GROUP BY ALL""", "ev"))
def _(t: Tables):
    return sk.write_stage(ev.state_month(t.events()), scratch_path(t.spark, "state-month"), fmt="csv", header=True)


@register("sink_metric_tables", over("ls", LS, f"""SELECT grp, {rnd(AUC, 6)} AS auc_roc, {rnd(AP, 6)} AS avg_precision, {rnd(YOUDEN, 6)} AS optimal_threshold,
 CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives FROM pt GROUP BY 1""", "grp"), digits=6)
def _(t: Tables):
    curve = mt.roc_curve(t.line_scores(), ["grp"], "y", "score")
    metrics = mt.rank_metrics(t.line_scores(), ["grp"], "y", "score")
    sk.write_stage(curve, scratch_path(t.spark, "roc"))
    return sk.write_stage(metrics, scratch_path(t.spark, "metrics"))


@register("cached_inputs", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    def build():
        with cached(t.table("orders").select("o_orderdate")) as orders:
            by_year = orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
            # A result that outlives the scope is written inside it.
            return sk.write_stage(by_year, scratch_path(t.spark, "orders-by-year"))
    return t.once("orders by year", build)
