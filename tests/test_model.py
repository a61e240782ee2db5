"""Core arithmetic on tiny inputs."""

import pytest
from pyspark.sql import functions as F

from cohort.contracts import ContractError
from cohort.operators import hierarchy, model, mortality, qa, scenarios
from cohort.params import Params
from cohort.plans import project

from conftest import rows

TREE = "area_id string, name string, level string, parent_id string, boundary_status string"
CELLS = "geography_id string, age int, sex string, nationality string, population bigint"
P = Params(terminal_age=100, min_expected=20)


def tree(spark, statuses=("unchanged", "unchanged")):
    return spark.createDataFrame([
        ("s1", "One", "section", "b", statuses[0]), ("s2", "Two", "section", "b", statuses[1]),
        ("b", "B", "barrio", "d", "unchanged"), ("d", "D", "district", "c", "unchanged"), ("c", "C", "city", None, "unchanged")], TREE)


def qx(spark, value=0.01, ages=131):
    years = spark.range(2015, 2025).select(F.col("id").cast("int").alias("year"), F.explode(F.sequence(F.lit(0), F.lit(ages - 1))).alias("age"))
    return years.select("year", "age", F.explode(F.array(F.lit("male"), F.lit("female"))).alias("sex"), F.lit(value).alias("qx"))


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), CELLS)


def run(spark, start, end, geos=None, params=P, **kw):
    geos = geos if geos is not None else tree(spark)
    closure = hierarchy.tree(geos)
    detail = model.cohort_detail(start, end, qx(spark), closure, params, **kw)
    return detail, model.area_index(start, end, detail, geos, closure, params)


def test_survival_is_a_ten_year_product(spark):
    got = mortality.survival(qx(spark), 2015, 2025).filter("age = 30 and sex = 'male'").head().survival
    assert got == pytest.approx(0.99**10)


def test_half_age_averages_neighbouring_ages(spark):
    steep = qx(spark).withColumn("qx", F.col("age") / 1000.0)
    got = mortality.survival(steep, 2015, 2016, half_age=True).filter("age = 40 and sex = 'male'").head().survival
    assert got == pytest.approx(1 - 0.0405)


def test_residual_and_rates(spark):
    start = cells(spark, ("s1", 30, "male", "ESP", 1000), ("s2", 30, "male", "EXT", 100))
    end = cells(spark, ("s1", 40, "male", "ESP", 950), ("s2", 5, "female", "EXT", 7), ("s2", 100, "female", "ESP", 3))
    _, index = run(spark, start, end)
    got = {r.area_id: r for r in index.collect()}
    expected = 1100 * 0.99**10
    for area in ("b", "d", "c"):
        assert got[area].expected == pytest.approx(expected)
        assert got[area].residual == pytest.approx(950 - expected)
        assert got[area].observed_under_interval == 7 and got[area].observed_terminal == 3
        assert got[area].residual_per_1000 == pytest.approx(1000 * (950 - expected) / expected)
        assert got[area].annualised_residual_per_1000 == pytest.approx(100 * (950 - expected) / expected)


def test_missing_mortality_fails_only_where_needed(spark):
    short = qx(spark, ages=60)
    closure = hierarchy.tree(tree(spark))
    end = cells(spark, ("s1", 40, "male", "ESP", 1))
    free = cells(spark, ("s1", 55, "male", "ESP", 0), ("s1", 95, "male", "ESP", 9))
    assert model.cohort_detail(free, end, short, closure, P).count() > 0
    with pytest.raises(Exception, match="missing mortality"):
        model.cohort_detail(cells(spark, ("s1", 55, "male", "ESP", 1)), end, short, closure, P).collect()


def test_ineligible_ages_have_no_residual(spark):
    detail, _ = run(spark, cells(spark, ("s1", 95, "male", "ESP", 9)), cells(spark, ("s1", 3, "male", "ESP", 4)))
    for r in detail.filter("area_id = 'c'").collect():
        assert not r.cohort_eligible and r.expected is None and r.residual is None
    reasons = {r.age: r.exclusion_reason for r in detail.collect()}
    assert reasons == {105: "terminal_age", 3: "born_during_interval"}


def test_nationality_switch_cancels_in_the_total(spark):
    start = cells(spark, ("s1", 30, "male", "EXT", 100))
    end = cells(spark, ("s1", 40, "male", "ESP", 90))
    detail, index = run(spark, start, end)
    by_nat = {r.nationality: r.residual for r in detail.filter("area_id = 'c'").collect()}
    total = index.filter("area_id = 'c'").head().residual
    assert by_nat["ESP"] == pytest.approx(90) and by_nat["EXT"] == pytest.approx(-100 * 0.99**10)
    assert total == pytest.approx(by_nat["ESP"] + by_nat["EXT"])


def test_sparse_areas_hide_rates(spark):
    _, index = run(spark, cells(spark, ("s1", 30, "male", "ESP", 5)), cells(spark, ("s1", 40, "male", "ESP", 5)))
    row = index.filter("area_id = 's1'").head()
    assert row.rate_suppressed and row.residual_per_1000 is None and row.residual is not None
    empty = index.filter("area_id = 's2'").head()
    assert empty.expected == 0 and empty.residual_per_1000 is None and empty.affected_share == 0


def test_quality_is_inherited_upwards(spark):
    geos = tree(spark, ("unchanged", "unreliable"))
    start = cells(spark, ("s1", 30, "male", "ESP", 75), ("s2", 30, "male", "ESP", 25))
    _, index = run(spark, start, cells(spark, ("s1", 40, "male", "ESP", 70)), geos)
    got = {r.area_id: (r.boundary_status, r.affected_share, r.default_visible) for r in index.collect()}
    assert got["s1"] == ("unchanged", 0.0, True)
    assert got["c"] == ("unreliable", 0.25, False)


def test_invariants_hold_and_breaks_are_found(spark):
    start = cells(spark, ("s1", 30, "male", "ESP", 100), ("s2", 31, "female", "EXT", 50))
    detail, index = run(spark, start, cells(spark, ("s1", 40, "male", "ESP", 80)))
    assert qa.summary(qa.invariants(detail, index)).head().passed
    wrong = index.withColumn("actual", F.when(F.col("area_id") == "b", F.col("actual") + 1).otherwise(F.col("actual")))
    failed = {(r.area_id, r.check_name) for r in qa.invariants(detail, wrong).filter("not passed").collect()}
    assert ("b", "sex-nationality-sums") in failed and ("b", "hierarchy") in failed and ("d", "hierarchy") in failed


def test_unknown_geography_and_bad_cells_fail(spark):
    with pytest.raises(Exception, match="unknown geographies"):
        run(spark, cells(spark, ("zz", 30, "male", "ESP", 1)), cells(spark, ("s1", 40, "male", "ESP", 1)))[0].collect()
    with pytest.raises(Exception, match="contract: age"):
        run(spark, cells(spark, ("s1", 131, "male", "ESP", 1)), cells(spark, ("s1", 40, "male", "ESP", 1)))[0].collect()


def test_trees_of_any_depth(spark):
    chain = spark.range(300).selectExpr("concat('a', id) as area_id", "if(id = 0, null, concat('a', id - 1)) as parent_id")
    assert hierarchy.closure(chain).count() == 300 * 301 // 2
    assert hierarchy.unreachable(chain).isEmpty()
    looped = chain.withColumn("parent_id", F.when(F.col("area_id") == "a10", "a12").otherwise(F.col("parent_id")))
    assert rows(hierarchy.unreachable(looped), "area_id") == sorted((f"a{n}",) for n in range(10, 300))
    with pytest.raises(Exception, match="cycle"):
        hierarchy.closure(looped)
    with pytest.raises(Exception, match="cycle"):
        hierarchy.tree(looped)


def test_totals_and_intervals_of_deep_and_bushy_trees(spark):
    import random

    rng = random.Random(3)
    chain = {f"a{n:03}": f"a{n - 1:03}" if n else None for n in range(500)}
    bushy = {f"b{n:03}": f"b{rng.randrange(n):03}" if n else None for n in range(200)}
    parent = chain | bushy | {f"c{n:03}": "b000" for n in range(120)}
    made = hierarchy.tree(spark.createDataFrame(list(parent.items()), "area_id string, parent_id string"))
    assert len(made.steps) == 9 and sum(s.count() for s in made.steps[1:]) < 9 * len(parent)

    facts = [(rng.choice(list(parent)), rng.choice("xy"), rng.randint(1, 9)) for _ in range(700)]
    expected, below = {}, {a: [a] for a in parent}
    for area, key, n in facts:
        while area:
            expected[area, key] = expected.get((area, key), 0) + n
            area = parent[area]
    rolled = hierarchy.roll_up(spark.createDataFrame(facts, "geography_id string, k string, n long"), made, ["k"], ["n"])
    assert {(r.area_id, r.k): r.n for r in rolled.collect()} == expected
    with pytest.raises(Exception, match="unknown geographies"):
        hierarchy.roll_up(spark.createDataFrame([("zz", 1)], "geography_id string, n long"), made, [], ["n"]).collect()

    for area in parent:
        up = parent[area]
        while up:
            below[up].append(area)
            up = parent[up]
    place = {r.area_id: (r.low, r.high, r.depth) for r in hierarchy.intervals(made).collect()}
    at = {low: a for a, (low, _, _) in place.items()}
    assert sorted(at) == list(range(len(parent))) and place["a499"][2] == 499
    assert all({at[k] for k in range(low, high + 1)} == set(below[a]) for a, (low, high, _) in place.items())


def fertility(spark, rate=50.0):
    years = spark.range(2015, 2025).selectExpr("cast(id as int) as year")
    return years.crossJoin(spark.range(15, 50).selectExpr("cast(id as int) as age")).withColumn("asfr_per_1000", F.lit(rate))


def test_women_without_mortality_fail_the_births(spark):
    women = cells(spark, ("s1", 30, "female", "ESP", 100))
    assert scenarios.births(women, qx(spark), fertility(spark), P).count() == 10
    with pytest.raises(Exception, match="missing mortality"):
        scenarios.births(women, qx(spark).filter("age <> 30"), fertility(spark), P).collect()
    with pytest.raises(Exception, match="repeated fertility"):
        scenarios.births(women, qx(spark), fertility(spark).unionAll(fertility(spark)), P).collect()


def test_risks_outside_their_range_fail_everywhere(spark):
    wrong, women = qx(spark, 1.5), cells(spark, ("s1", 30, "female", "EXT", 100))
    hazards = qx(spark).select("year", "age", "sex", F.lit(0.5).alias("hazard"))
    closure = hierarchy.tree(tree(spark))
    snapshots = women.withColumn("year", F.lit(2015)).unionByName(women.withColumn("year", F.lit(2025)))
    for run_it in (
        lambda: scenarios.births(women, wrong, fertility(spark), P),
        lambda: scenarios.child_survival(wrong, P),
        lambda: scenarios.nationality(women, wrong, hazards, P, (1.0,)),
        lambda: mortality.survival(wrong, 2015, 2025),
        lambda: model.window_detail(snapshots, wrong, closure, [("w", 2015, 2025, 90)]),
    ):
        with pytest.raises(Exception, match="probability outside"):
            run_it().collect()


@pytest.mark.parametrize("parent, message", [("nowhere", "unknown parent"), ("s1", "cycle")])
def test_broken_trees_fail(spark, parent, message):
    geos = tree(spark).withColumn("parent_id", F.when(F.col("area_id") == "b", parent).otherwise(F.col("parent_id")))
    with pytest.raises(Exception, match=message):
        hierarchy.tree(geos)
    with pytest.raises(Exception, match=message):
        hierarchy.closure(geos).collect()
    assert not hierarchy.unreachable(geos).isEmpty()


def test_mixed_grain_and_duplicates_are_refused(spark):
    end = cells(spark, ("s1", 40, "male", "ESP", 1))
    with pytest.raises(ContractError, match="mixes leaves"):
        project.analyse(cells(spark, ("b", 30, "male", "ESP", 1)), end, qx(spark), tree(spark), P)
    with pytest.raises(ContractError, match="duplicate key"):
        project.analyse(cells(spark, ("s1", 30, "male", "ESP", 1), ("s1", 30, "male", "ESP", 2)), end, qx(spark), tree(spark), P)


def test_workflow_writes_a_checked_bundle(spark, tmp_path):
    start = cells(spark, ("s1", 30, "male", "ESP", 100), ("s2", 31, "female", "EXT", 50))
    end = cells(spark, ("s1", 40, "male", "ESP", 80), ("s2", 41, "female", "EXT", 60))
    published = spark.createDataFrame([(2015, "c", None, None, 150, 0), (2025, "c", 40, "ESP", 81, 1)],
                                      "year int, area_id string, age int, nationality string, population bigint, tolerance int")
    bundle = project.analyse(start, end, qx(spark), tree(spark), P, published=published, variants={"none": qx(spark, 0.0)})
    names = bundle.write(str(tmp_path / "out"))
    assert set(names) == {"cohort_detail", "area_index", "age_band_summary", "map_indicator", "composition", "sensitivities"}
    back = spark.read.parquet(str(tmp_path / "out" / "map_indicator"))
    assert back.filter("level = 'city' and preset = 'cohorts'").head().rank == 1
    assert all(r.passed for r in bundle.reports["reconciliation"].collect())
    none = bundle.tables["sensitivities"].filter("area_id = 'c' and scenario = 'none'").head()
    assert none.expected == pytest.approx(150)


def test_exact_tier_drops_unreliable_sections(spark):
    geos = tree(spark, ("unchanged", "unreliable"))
    start = cells(spark, ("s1", 30, "male", "ESP", 75), ("s2", 30, "male", "ESP", 25))
    both = project.tiers(start, start.withColumn("age", F.lit(40)), qx(spark), geos, P, half_age=False)
    city = {t: b.tables["area_index"].filter("area_id = 'c'").head() for t, b in both.items()}
    assert city["inclusive"].baseline == 100 and city["exact"].baseline == 75
    assert city["exact"].boundary_status == "unchanged"


def test_births_of_one_year(spark):
    params = Params(start_year=2015, end_year=2016, terminal_age=100)
    start = cells(spark, ("s1", 30, "female", "ESP", 100), ("s1", 30, "male", "ESP", 999), ("s1", 50, "female", "ESP", 50))
    fertility = spark.createDataFrame([(2015, a, 200.0) for a in range(15, 50)], "year int, age int, asfr_per_1000 double")
    none = qx(spark, 0.0)
    born = scenarios.births(start, none, fertility, params)
    assert born.head().births == pytest.approx(20)
    kids = {r.sex: r.expected for r in scenarios.children(born, none, params).collect()}
    assert kids["male"] == pytest.approx(20 * 0.512) and kids["female"] == pytest.approx(20 * 0.488)
    with pytest.raises(Exception, match="missing fertility"):
        scenarios.births(start, none, fertility.filter("age <> 30"), params).collect()


def test_transfers_survive_and_deplete(spark):
    params = Params(start_year=2015, end_year=2017, terminal_age=100)
    start = cells(spark, ("s1", 30, "male", "EXT", 100), ("s1", 30, "male", "ESP", 10))
    hazards = qx(spark).select("year", "age", "sex", F.lit(0.5).alias("hazard"))
    out = scenarios.nationality(start, qx(spark, 0.0), hazards, params, (1.0, 3.0))
    got = {r.multiplier: r for r in out.collect()}
    assert got[1.0].ext == pytest.approx(75) and got[1.0].esp == pytest.approx(-75) and got[1.0].age == 32
    assert got[3.0].ext == pytest.approx(100) and got[3.0].total == 0


def test_children_survival_matches_a_plain_loop(spark, medium):
    params = Params()
    got = {(r.year, r.sex): r for r in scenarios.child_survival(medium.mortality, params).collect()}
    q = {(r.year, r.age, r.sex): r.qx for r in medium.mortality.collect()}
    for year in range(2015, 2025):
        for sex, share in (("male", 0.512), ("female", 0.488)):
            alive = 1.0
            for step, later in enumerate(range(year + 1, 2025)):
                alive *= 1 - q[(later, 1 + step, sex)]
            assert got[(year, sex)].factor == pytest.approx(share * (1 - q[(year, 0, sex)]) ** 0.5 * alive)
            assert got[(year, sex)].age == 2024 - year


def test_transfers_match_a_plain_loop(spark, medium):
    q = {(r.year, r.age, r.sex): r.qx for r in medium.mortality.collect()}
    h = {(r.year, r.age, r.sex): r.hazard for r in medium.hazards.collect()}
    got = {(r.multiplier, r.age, r.sex): r.factor for r in scenarios.transfer_factors(medium.mortality, medium.hazards, Params(), (0.5, 1.5)).collect()}
    for m, age, sex in [(0.5, 0, "male"), (1.5, 44, "female"), (1.5, 80, "male")]:
        stock, total = 1.0, 0.0
        for i, year in enumerate(range(2015, 2025)):
            moved = stock * min(h[(year, age + i, sex)] * m, 1)
            alive = 1.0
            for j in range(i, 10):
                alive *= 1 - q[(2015 + j, age + j, sex)]
            total += moved * alive
            stock = (stock - moved) * (1 - q[(year, age + i, sex)])
        assert got[(m, age, sex)] == pytest.approx(total)


def test_documented_values(medium):
    """Totals worked out beforehand for the derived tables."""
    from cohort.plans.core_queries import index

    got = {r.area_id: r for r in index(medium).collect()}
    assert (got["ALL"].baseline, got["ALL"].actual) == (549037, 686971)
    assert got["ALL"].expected == pytest.approx(416666.682299, abs=1e-5)
    assert (got["ALL"].observed_under_interval, got["ALL"].observed_terminal) == (77367, 83787)
    assert got["R0"].expected == pytest.approx(55927.289481, abs=1e-5)


def test_variants_with_terminal_ages_of_their_own(spark):
    start = cells(spark, ("s1", 30, "male", "ESP", 100), ("s1", 82, "female", "ESP", 10), ("s2", 87, "female", "EXT", 4), ("s2", 95, "male", "ESP", 7))
    end = cells(spark, ("s1", 40, "male", "ESP", 90), ("s1", 92, "female", "ESP", 3), ("s2", 97, "male", "ESP", 2), ("s2", 103, "male", "ESP", 1))
    both = mortality.survival(qx(spark), 2015, 2025).withColumn("scenario", F.lit("a")).unionByName(mortality.survival(qx(spark, 0.0), 2015, 2025).withColumn("scenario", F.lit("b")))
    named = [scenarios.Variant(f"{s}{t}", s, t) for s in "ab" for t in (90, 95, 100)]
    together = scenarios.variant_totals(start, end, both, hierarchy.tree(tree(spark)), P, named)
    columns = ["scenario", "terminal_age", "area_id", "baseline", "expected", "actual", "residual"]
    alone = []
    for v in named:
        alone += scenarios.variant_totals(start, end, both, hierarchy.tree(tree(spark)), P, [v]).select(*columns).collect()
    assert rows(together, *columns) == sorted(map(tuple, alone))
    got = {(r.scenario, r.area_id): (r.baseline, r.expected, r.actual) for r in together.collect()}
    assert got["b90", "s1"] == (100, 100, 90) and got["b95", "s1"] == (110, 110, 93) and got["b100", "s2"] == (4, 4, 2)
    with pytest.raises(ValueError, match="repeated variant"):
        scenarios.variant_totals(start, end, both, hierarchy.tree(tree(spark)), P, ["a", "a"])
    with pytest.raises(Exception, match="missing mortality probability in a"):  # needed up to the highest of its terminal ages
        scenarios.variant_totals(start, end, both.filter("scenario = 'b' or age < 85"), hierarchy.tree(tree(spark)), P, named).collect()
    scenarios.variant_totals(start, end, both.filter("scenario = 'b' or age < 85"), hierarchy.tree(tree(spark)), P, [scenarios.Variant("x", "a", 95), "b"]).collect()
