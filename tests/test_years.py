"""A year that fails leaves the others; increments of one year add up; empty years are listed."""

import numpy as np
from pyspark.sql import functions as F

from perilframe.session import scratch_path
from perilframe.sources.years import YearStore


def test_years_commit_alone_and_merge(spark):
    raw = spark.createDataFrame([(k, y, float(v) if v % 7 else None) for k in ("a", "b", None) for y in (2001, 2002) for v in range(k == "a", 30 + y % 3)],
                                "k string, y int, v double")
    store = YearStore(spark, scratch_path(spark, "years"), ["k"], "v")

    def part(year, low):
        # Rows without a value belong to the lower half.
        half = F.coalesce(F.col("v"), F.lit(0.0)) < 15
        return raw.filter((F.col("y") == year) & (half if low else ~half))

    assert store.add(2001, lambda: part(2001, True), "low") == "loaded"
    assert store.add(2002, lambda: part(2002, True).select("nothing"), "low") == "failed"
    assert store.add(2003, lambda: part(2003, True), "low") == "empty"
    before = {r.k: r.n_records for r in store.figures().filter("year = 2001").collect()}
    assert store.figures().filter("year <> 2001").count() == 0 and len(before) == 3
    assert store.add(2001, lambda: part(2001, False), "high") == "loaded"
    assert [store.add(2002, lambda low=low: part(2002, low), name) for low, name in ((True, "low"), (False, "high"))] == ["loaded"] * 2
    assert store.add(2002, lambda: part(2002, True), "low") == "loaded"  # once more: replaced, not added
    status = {(r.year, r.batch): (r.status, r.seq) for r in store.manifest().collect()}
    assert status == {(2001, "low"): ("loaded", 0), (2001, "high"): ("loaded", 0), (2002, "low"): ("loaded", 2), (2002, "high"): ("loaded", 0), (2003, "low"): ("empty", 0)}
    assert "nothing" in store.manifest(latest=False).filter("status = 'failed'").first().error
    got = {(r.k, r.year): r for r in store.figures().collect()}
    frame = raw.toPandas()
    assert len(got) == 6
    for (k, y), g in frame.groupby(["k", "y"], dropna=False):
        r = got[(k if isinstance(k, str) else None, y)]
        assert r.n_records == len(g) and r.total == g.v.sum() and np.isclose(r["median"], g.v.median())
