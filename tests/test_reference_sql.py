"""Queries beside their reference SQL on small tables of unlucky content."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import plain
from cohort.plans.fixtures import TABLES

SMALL = "/root/testdata/sf0.001"


def folder(path, **changed):
    """The smallest tables with some of them replaced by SQL over their originals."""
    con = duckdb.connect()
    for t in TABLES:
        if t in changed:
            con.execute(f"copy ({changed[t].format(old=f'{SMALL}/{t}.parquet')}) to '{path}/{t}.parquet' (format parquet)")
        else:
            os.symlink(f"{SMALL}/{t}.parquet", f"{path}/{t}.parquet")
    return str(path)


def both(spark, name, path):
    """Sorted rows of a query and of its SQL."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    df = entry_points.queries()[name](spark, path)
    cols = sorted(df.columns)
    res = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in res.description]
    theirs = sorted(repr(plain(tuple(r[names.index(c)] for c in cols))) for r in res.fetchall())
    return sorted(repr(plain(tuple(r))) for r in df.select(*cols).collect()), theirs


@pytest.fixture(scope="module")
def shared_barrio(tmp_path_factory):
    """Sections 14 and 15 merge; both name barrio N5 (15 as a moved one), in districts of their own (R1 and R0)."""
    return folder(
        tmp_path_factory.mktemp("barrio"), nation="select n_nationkey, n_name, cast(case n_nationkey when 5 then 1 else 0 end as int) as n_regionkey from '{old}'",
        supplier="select s_suppkey + 10 as s_suppkey, s_name, cast(case s_suppkey when 4 then 5 when 5 then 3 else s_nationkey end as int) as s_nationkey, s_acctbal from '{old}'",
        lineitem="select * replace (l_suppkey + 10 as l_suppkey) from '{old}'")


@pytest.mark.parametrize("name", ["par2_assessment", "par7_review_counts", "par8_exceptions", "snk9_boundary_review"])
def test_one_barrio_in_two_districts_is_two_parents(spark, shared_barrio, name):
    ours, theirs = both(spark, name, shared_barrio)
    assert ours == theirs and any("ambiguous_section_membership" in r for r in ours)


@pytest.mark.parametrize("name", ["src15_verified_payloads", "snk12_changed_payloads"])
def test_payloads_that_share_a_name(spark, tmp_path, name):
    path = folder(tmp_path, pages="select page_id, 'http://x/' || (page_id // 4) as url, html from '{old}'")
    ours, theirs = both(spark, name, path)
    assert ours == theirs
    pages = duckdb.sql(f"select count(*) from '{path}/pages.parquet'").fetchall()[0][0]
    assert name != "src15_verified_payloads" or len(ours) == pages


def test_key_coverage_reads_each_side_once(spark):
    from cohort.contracts import coverage_gaps

    keys = "a int, b string"
    have, want = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], keys), spark.createDataFrame([(1, "x"), (2, None), (4, None)], keys)
    gaps = coverage_gaps(have, want, ["a", "b"])
    assert sorted(map(tuple, gaps.collect())) == [(3, "z", "unexpected"), (4, None, "missing")]
    plan = entry_points.queries()["con1_key_coverage"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_pooled_hierarchy_overlays_once(spark, monkeypatch):
    from cohort.plans import zone_queries

    calls, whole = [], zone_queries.overlay
    monkeypatch.setattr(zone_queries, "overlay", lambda f: calls.append(f) or whole(f))
    entry_points.queries()["hie7_pooled_hierarchy"](spark, SMALL)
    assert len(calls) == 1


def test_components_contract_before_stars(spark, monkeypatch):
    from cohort.operators import graph

    def stars(edges):
        raise AssertionError("stars over all edges")

    pairs = spark.range(64).selectExpr("id * 2 as src", "id * 2 + 1 as dst")
    nodes = spark.range(130).withColumnRenamed("id", "node")
    chain = spark.range(129).selectExpr("id as src", "id + 1 as dst")
    assert set(map(tuple, graph.components(chain, nodes).collect())) == {(n, 0) for n in range(130)}
    monkeypatch.setattr(graph, "_large_star", stars)
    assert dict(map(tuple, graph.components(pairs, nodes).collect())) == {n: n - n % 2 for n in range(128)} | {128: 128, 129: 129}


def test_expected_sums_are_exact(spark):
    """Doubles would lose the smallest cell beside the large ones, and which digits they lose depends on their order."""
    from decimal import Decimal

    from cohort.operators import hierarchy, model
    from cohort.params import Params

    geographies = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", None)], "area_id string, parent_id string")
    start = spark.createDataFrame([("a", 30, "male", "ESP", 4 * 10**9), ("b", 30, "male", "ESP", 1), ("b", 30, "female", "ESP", 1)], "geography_id string, age int, sex string, nationality string, population bigint")
    chance = spark.createDataFrame([(30, "male", 0.75), (30, "female", 0.000000001)], "age int, sex string, survival double")
    got = {r.area_id: r.expected for r in model.exact_expected(start, chance, hierarchy.tree(geographies), Params()).collect()}
    assert got == {"a": Decimal(3 * 10**9), "b": Decimal("0.750000001"), "c": Decimal("3000000000.750000001")}


def test_area_payloads_equal_their_sql(spark):
    ours, theirs = both(spark, "snk7_area_payloads", "/root/testdata/sf0.01")
    assert ours == theirs and len(ours) > 30
