"""The registered queries: names, reference SQL, plans and a sample of results."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import plain
from cohort.plans import registry
from cohort.plans.fixtures import TABLES

FOLDER = "/root/testdata/sf0.001"
# Queries whose result depends on files or on text forms that SQL does not reproduce.
WITHOUT_SQL = {"snk12_table_inventory", "snk7_sensitivity_payloads"}
SAMPLE = ["hie1_closure", "coh8_area_totals", "mor7_propagated_survivors", "scn5_births", "nrm4_section_codes", "prf1_snapshot", "ctl2_section_summary", "reg2_parent_at_endpoint", "src18_page_links"]


def test_every_query_has_reference_sql():
    assert set(registry.callables()) - set(registry.oracle_sql()) == WITHOUT_SQL
    assert set(registry.callables()) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 30


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_equals_reference_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry_points.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    res = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in res.description]
    theirs = sorted(repr(plain(tuple(r[names.index(c)] for c in cols))) for r in res.fetchall())
    assert sorted(repr(plain(tuple(r))) for r in df.select(*cols).collect()) == theirs


@pytest.mark.parametrize("name", ["coh5_cohort_detail", "bnd1_band_summary", "scn6_nationality", "geo1_candidates", "ctl3_reconciliation", "reg3_comparison"])
def test_plans_have_no_cross_products(spark, name):
    plan = entry_points.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_date_filters_reach_the_scan(spark):
    plan = entry_points.queries()["coh2_age_shift"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_shipdate" in plan
