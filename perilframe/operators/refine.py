"""Exact quantiles of many groups: value counts for small groups, histogram refinement for large ones.

One aggregate gathers the sums of every group and counts up to ``FEW`` different values. A group with fewer of them is
done: its quantiles are looked up in the counts, and rows are combined before they are shuffled, whatever their bins. The
buffer of a group is bounded, so a hot group is only found to be large here; its rows alone are read again.

For these, a hash aggregate counts each group's values in logarithmic bins and keeps the least and the greatest value of every
bin. The wanted places of the order are then looked up in the bins: a place that is the first or the last one of its
bin, or lies in a bin of one value, is known from the bin alone. Only where a place falls inside a bin, the rows of
that bin are read again and put in order. The source is never written, and a group of any size or with any hot value
is reduced to its bins before the first shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path
from ..sources.sinks import write_stage
from .ordered import ordered_totals

#: Different values from which a group counts as large.
FEW = 256
#: Bins of one doubling of the value: about 1 % of width each.
BINS_PER_OCTAVE = 64
#: No finite double lies beyond these powers of two, so infinite values get bins of their own.
_OCTAVES = 1100


def log_bin(value: Column, per_octave: int = BINS_PER_OCTAVE) -> Column:
    """Number of the bin of a double: never falls as the value rises; 0 for zero, the highest bin for NaN, null for null."""
    size = F.greatest(F.least(F.log2(F.abs(value)), F.lit(float(_OCTAVES))), F.lit(float(-_OCTAVES)))
    place = F.floor(size * per_octave) + (_OCTAVES + 1) * per_octave
    return (F.when(value.isNull(), F.lit(None).cast("long")).when(F.isnan(value), F.lit(4 * _OCTAVES * per_octave).cast("long"))
            .when(value == 0, F.lit(0).cast("long")).when(value > 0, place).otherwise(-place))


def _places(quantiles: dict[str, float], n: Column) -> dict[str, Column]:
    """The two 0-based places between which each quantile lies."""
    out = {}
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (n - 1)
        out[f"lo_{name}"], out[f"hi_{name}"] = F.floor(at), F.ceil(at)
    return out


def binned_stats(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], sums: dict[str, Column]) -> DataFrame:
    """One row per group: its figures, and for every place the value or else the bin and the place inside it."""
    v = F.col(value).cast("double")
    bins = df.groupBy(*keys, log_bin(v).alias("_bin")).agg(
        F.count(v).alias("_c"), F.count(F.lit(1)).alias("_rows"), F.sum(v).alias("_sum"), F.min(v).alias("_low"), F.max(v).alias("_high"),
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    # A group has as many rows here as it has bins, whatever its size.
    group = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("_c").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = bins.withColumns({"_below": below, "_n": F.sum("_c").over(group)})
    picks = []
    for place, at in _places(quantiles, F.col("_n")).items():
        inside = at - F.col("_below")
        here = (inside >= 0) & (inside < F.col("_c"))
        known = (F.when((inside == 0) | (F.col("_low") == F.col("_high")), F.col("_low"))
                 .when(inside == F.col("_c") - 1, F.col("_high")))
        picks += [F.max(F.when(here, known)).alias(f"_v_{place}"),
                  F.max(F.when(here & known.isNull(), F.struct(F.col("_bin").alias("bin"), inside.alias("place")))).alias(f"_at_{place}")]
    return placed.groupBy(*keys).agg(
        F.sum("_rows").alias("n_rows"), F.sum("_c").alias("n"), F.sum("_sum").alias("total"), F.min("_low").alias("low"),
        F.max("_high").alias("high"), *picks, *[F.sum(f"_s_{n}").alias(n) for n in sums])


def counted_stats(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], sums: dict[str, Column],
                  few: int = FEW) -> DataFrame:
    """One row per group: its sums, and all else where it has fewer than ``few`` different values; where it has more, ``_many``.

    ``histogram_numeric`` joins neighbouring values only once it holds more than ``few``, and never falls below that number
    again, so a shorter one holds the values themselves. Equal values of different tasks are joined only then, so a group of
    few values in many tasks may be marked too, which costs a second look and changes nothing. NaN has no place in the order.
    """
    v = F.col(value).cast("double")
    # Count, sum and extremes of a small group follow from its values, so they are not shuffled beside them.
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.histogram_numeric(v, F.lit(few)).alias("_found"),
                                   *[F.sum(c).alias(n) for n, c in sums.items()])
    counts = F.coalesce("_found", F.array().cast("array<struct<x:double,y:double>>"))
    many = (F.size(counts) >= few) | F.exists(counts, lambda c: F.isnan(c["x"]))
    groups = groups.withColumns({"_counts": counts, "_many": many})
    n = F.aggregate("_counts", F.lit(0.0), lambda a, c: a + c["y"]).cast("long")
    total = F.aggregate("_counts", F.lit(0.0), lambda a, c: a + c["x"] * c["y"])

    def at(place: Column) -> Column:
        none = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("found"))
        return F.aggregate("_counts", none, lambda a, c: F.struct(
            (a["seen"] + c["y"]).alias("seen"),
            F.when(a["found"].isNull() & (a["seen"] + c["y"] > place), c["x"]).otherwise(a["found"]).alias("found")), lambda a: a["found"])

    figures = {"n": n, "total": F.when(n > 0, total), "low": F.try_element_at("_counts", F.lit(1))["x"],
               "high": F.try_element_at("_counts", F.lit(-1))["x"]}
    placed = groups.withColumns({name: F.when(~F.col("_many"), figure) for name, figure in figures.items()})
    picked = placed.withColumns({f"_v_{name}": at(place) for name, place in _places(quantiles, F.col("n")).items()})
    return picked.select(*keys, "n_rows", "n", "total", "low", "high", *[
        _between(F.col(f"_v_lo_{name}"), F.col(f"_v_hi_{name}"), q).alias(name) for name, q in quantiles.items()], *sums, "_many")


def _between(lo: Column, hi: Column, q: float) -> Column:
    at = F.lit(float(q)) * (F.col("n") - 1)
    return lo + (hi - lo) * (at - F.floor(at))


def refined_stats(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                  sums: dict[str, Column] | None = None, few: int = FEW) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key, with count, sum, extremes and further sums.

    Columns: ``keys``, ``n_rows`` (all rows), ``n`` (known values), ``total``, ``low``, ``high``, the quantiles, and one
    column per entry of ``sums``. Null keys are groups like any other. What is written has one row per group, and
    the rows of large groups' bins that hold an unknown place; both are read by the plan that is returned. Only where there
    are large groups is the source read again.
    """
    sums = sums or {}
    found = write_stage(counted_stats(df, keys, value, quantiles, sums, few), scratch_path(df.sparkSession, "counted"))
    large = found.filter("_many")
    if large.isEmpty():
        return found.drop("_many")
    # Structs with null fields are equal, so a struct stands for the key.
    key = F.struct(F.lit(0).alias("_all"), *keys)
    rows = df.withColumn("_group", key).join(large.select(key.alias("_group")), "_group", "left_semi").drop("_group")
    known = ["n", "total", "low", "high", *quantiles]
    late = binned_quantiles(rows, keys, value, quantiles).select(key.alias("_group"), *[F.col(name).alias(f"_late_{name}") for name in known])
    return found.withColumn("_group", key).join(late, "_group", "left").select(
        *keys, "n_rows", *[F.coalesce(name, f"_late_{name}").alias(name) for name in known], *sums)


def binned_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Known values, their sum and extremes, and the quantiles per key by way of bins, for groups of any size."""
    names = list(_places(quantiles, F.col("n")))
    found = write_stage(binned_stats(df, keys, value, quantiles, {}), scratch_path(df.sparkSession, "binned"))
    # Structs with null fields are equal, so a struct stands for the key.
    key = F.struct(F.lit(0).alias("_all"), *keys)
    asked = found.select(key.alias("_group"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("_place"), F.col(f"_at_{name}.bin").alias("_bin"), F.col(f"_at_{name}.place").alias("_inside"))
        for name in names])).alias("_a")).select("_group", "_a.*").filter(F.col("_bin").isNotNull())
    bins = asked.groupBy("_group", "_bin").agg(F.collect_list(F.struct("_place", "_inside")).alias("_asked"))
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).select(key.alias("_group"), log_bin(v).alias("_bin"), v.alias("_v"))
    counted = rows.join(bins.select("_group", "_bin"), ["_group", "_bin"], "left_semi").groupBy("_group", "_bin", "_v").agg(
        F.count(F.lit(1)).alias("_c"))
    # A bin of a hot group may hold many values, so they are ordered in ranges as well.
    placed = ordered_totals(counted, ["_group", "_bin"], "_v", ["_c"]).join(bins, ["_group", "_bin"])
    hit = placed.select("_group", "_v", "_c", "cum__c", F.inline("_asked")).filter(
        (F.col("cum__c") - F.col("_c") <= F.col("_inside")) & (F.col("_inside") < F.col("cum__c")))
    late = hit.groupBy("_group").agg(*[F.max(F.when(F.col("_place") == name, F.col("_v"))).alias(f"_late_{name}") for name in names])
    whole = found.withColumn("_group", key).join(late, "_group", "left")
    out = []
    for name, q in quantiles.items():
        lo, hi = (F.coalesce(f"_v_{side}_{name}", f"_late_{side}_{name}") for side in ("lo", "hi"))
        out.append(_between(lo, hi, q).alias(name))
    return whole.select(*keys, "n", "total", "low", "high", *out)
