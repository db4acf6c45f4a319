"""Registered queries against their SQL on the smallest tables.

SOME_QUERIES=1 runs a sample only.
"""

import os
import re

import pytest

import __spark_entry__ as entry
from compare import check, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ["agg_entity_month", "agg_claims_entity_year", "panel_build", "describe_by_group", "scan_paged_json", "scan_json_matrix",
          "ingest_year_preagg", "lag_features", "composite_target", "sensitivity_thresholds", "pct_rank_composite", "kfold_assign",
          "auc_roc", "ks_two_sample", "acf", "seasonal_decompose", "format_summary", "optional_source"]
#: Queries whose result is empty on the smallest tables.
EMPTY: set[str] = set()
NAMES = SAMPLE if os.environ.get("SOME_QUERIES") else sorted(entry.oracle_sql())
#: The corpus operators have tests of their own.
NAMES = [name for name in NAMES if not re.match(r"op\d+_", name)]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    status, _, note = check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert status == ("ok-EMPTY" if name in EMPTY else "ok"), note


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
