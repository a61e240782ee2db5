"""Raw files, profiles, controls, parents, registry, payloads and writers."""

import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from cohort.contracts import ContractError
from cohort.functions import expressions as ex
from cohort.operators import controls, mortality, normalise, parents, profiling, registry
from cohort.params import Params
from cohort.plans import project
from cohort.sources import files, layers, sinks, tables

from conftest import rows

P = Params()
HEADER = "COD_DISTRITO;COD_DIST_BARRIO;COD_DIST_SECCION;COD_EDAD_INT;EspanolesHombres;EspanolesMujeres;ExtranjerosHombres;ExtranjerosMujeres\n"


def wide(spark, tmp_path, *lines):
    path = tmp_path / "raw.csv"
    path.write_text("﻿" + HEADER + "".join(line + "\n" for line in lines), encoding="utf-8")
    return tables.read_wide(spark, str(path))


def test_strict_mode(spark, tmp_path):
    raw = wide(spark, tmp_path, "1;101;1001; 30 ;1;2;3;4", "1;101;1001;100 o +;1;0;0;0", "1;101;1001;TOTAL;2;2;3;4")
    out = project.prepare(raw, P)
    assert out.facts.count() == 8 and out.excluded.count() == 1
    first = out.facts.filter("age = 30 and sex = 'female' and nationality = 'EXT'").head()
    assert (first.geography_id, first.barrio_code, first.population) == ("2807901001", "0101", 4)
    assert out.profile.head().total == 11


@pytest.mark.parametrize("line, message", [
    ("1;101;1001;30;;2;3;4", "blank"), ("1;101;1001;30;x;2;3;4", "population count"), ("1;201;1001;30;1;2;3;4", "barrio"),
    ("1;101;2001;30;1;2;3;4", "section"), ("1;101;1001;about 30;1;2;3;4", "age label"), ("1;101;1001;131;1;2;3;4", "age")])
def test_strict_mode_fails_closed(spark, tmp_path, line, message):
    with pytest.raises(Exception, match=message):
        normalise.to_long(wide(spark, tmp_path, line)).collect()


def test_audit_mode_keeps_unknowns(spark, tmp_path):
    raw = normalise.counts(wide(spark, tmp_path, "1;101;1001;30;;2;3;4", "1;101;;95;5;;;", "1;101;1001;100 o +;1;0;0;0"))
    audit = normalise.to_audit(raw, P, "2015-01-01", spark.createDataFrame([("2807901001",)], "id string"))
    assert audit.filter("population is null").count() == 4
    got = {(r.age_label, r.age_kind, r.cohort_status, r.geography_status, r.has_geometry) for r in audit.collect()}
    assert got == {("30", "single", "eligible", "coded", 1), ("95", "single", "excluded_terminal", "missing_section", 0), ("100 o +", "open_100_plus", "excluded_terminal", "coded", 1)}
    assert normalise.conservation(raw, audit).head().conserved
    filled = controls.checked_fill(audit, "zero-v1", 1)
    assert controls.fill_summary(filled).head().out_of_scope_blanks == 3
    with pytest.raises(Exception, match="inferred cell count"):
        controls.checked_fill(audit, "zero-v1", 2).collect()


def test_header_contract(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a;b\n1;2\n")
    with pytest.raises(ContractError, match="unreviewed header"):
        tables.read_wide(spark, str(tmp_path / "h.csv"), header={"a": "x", "c": "y"})
    with pytest.raises(ContractError, match="missing columns"):
        tables.read_text_table(spark, str(tmp_path / "h.csv"), ["z"], sep=";")


def test_profile_counts_each_issue(spark, tmp_path):
    raw = wide(spark, tmp_path, "1;101;1001;30;1;2;3;4", "1;102;1001;30;1;;3;4", "1;101;1001;100 o +;1;0;0;0", "9;101;1001;30;1;1;1;1",
               "1;101;;31;1;1;1;1", "1;101;;31;1;1;1;1", "1;0;1002;40;-2;0;0;5", "1;101;1003;old;0;0;0;0")
    p = profiling.snapshot(raw).head().asDict()
    want = {"rows": 8, "duplicate_section_age_rows": 2, "invalid_geography_rows": 3, "invalid_geography_known_population": 12, "special_geography_rows": 1,
            "special_geography_known_population": 5, "open_age_rows": 1, "invalid_ages": 1, "invalid_counts": 1, "sections": 3, "districts": 1,
            "sections_with_multiple_barrios": 1, "blank_espanolesmujeres": 1, "known_population_sum": 36, "status": "requires_review"}
    assert {k: p[k] for k in want} == want


def test_discontinuities(spark):
    df = spark.createDataFrame([("2014-01-01", 100, 5), ("2015-01-01", 104, 5), ("2016-01-01", 130, 7)], "reference_date string, total bigint, section_count bigint")
    got = rows(profiling.discontinuities(df), "to_date", "flagged", "section_count_change")
    assert got == [("2015-01-01", False, 0), ("2016-01-01", True, 2)]


def test_life_tables(spark):
    lx = spark.createDataFrame([(2015, a, "male", v) for a, v in ((0, 100.0), (1, 90.0), (2, 45.0), (4, 10.0))], "year int, age int, sex string, lx double")
    assert rows(mortality.to_qx(lx, "lx", "survivors"), "age", "qx") == [(0, pytest.approx(0.1)), (1, pytest.approx(0.5))]
    with pytest.raises(ValueError):
        mortality.to_qx(lx, "mx")
    national = spark.createDataFrame([(2015, a, "male", 0.1 + a / 100) for a in range(5)], "year int, age int, sex string, qx double")
    band = spark.createDataFrame([(2015, "male", 0, 4, 0.2)], "year int, sex string, age_lo int, age_hi int, nqx double")
    kept = 1.0
    for r in mortality.calibrate_bands(national, band).collect():
        kept *= 1 - r.qx
    assert kept == pytest.approx(0.8)
    with pytest.raises(Exception, match="zero hazard"):
        mortality.calibrate_bands(national.withColumn("qx", F.lit(0.0)), band).collect()
    start = spark.createDataFrame([("g", 0, "male", "ESP", 100)], "geography_id string, age int, sex string, nationality string, population bigint")
    two = lx.unionByName(lx.withColumn("year", F.lit(2016)))
    assert mortality.propagate_lx(start, two, 2015, 2017, 100).head().expected_lx == pytest.approx(45.0)


def test_canonical_codes(spark):
    cases = [("1", "1", "2807901001"), ("1", "01001", "2807901001"), ("1", "1001", "2807901001"), ("12", "2807912005", "2807912005"), ("2", "01001", None), ("2", "123456", None), ("x", "1", None)]
    df = spark.createDataFrame(cases, "d string, s string, want string")
    assert df.filter(~ex.canonical_section(F.col("d"), F.col("s")).eqNullSafe(F.col("want"))).isEmpty()
    row = spark.range(1).select(ex.canonical_parent(F.lit("7"), F.lit("73")).alias("good"), ex.canonical_parent(F.lit("7"), F.lit("83")).alias("bad"), ex.canonical_parent(F.lit("22")).alias("far")).head()
    assert (row.good, row.bad, row.far) == ("0703", None, None)


def test_parent_status_precedence(spark):
    zones = spark.createDataFrame([(z, ["o" + z], ["n" + z]) for z in "abcdef"], "zone_id string, old_ids array<string>, new_ids array<string>")
    m = [("old", "oa", "01", "0101"), ("new", "na", "01", "0101"), ("old", "ob", "01", "0101"), ("new", "nb", "01", "0102"), ("old", "oc", "01", "0000"), ("new", "nc", "01", "0101"),
         ("old", "od", "01", "0101"), ("old", "od", "01", "0102"), ("new", "nd", "01", "0101"), ("old", "oe", "01", "0101"), ("new", "nf", "01", "0101"), ("old", "of", "01", "0101")]
    got = dict(rows(parents.assess(zones, spark.createDataFrame(m, "vintage string, section_id string, district string, barrio string")), "zone_id", "raw_parent_status"))
    assert got == {"a": "stable_raw_parent_code_only", "b": "raw_parent_reassignment", "c": "unknown_raw_barrio", "d": "ambiguous_section_membership", "e": "missing_raw_membership", "f": "stable_raw_parent_code_only"}


def test_registry_dates_and_endpoints(spark):
    raw = spark.createDataFrame([
        (5, "s1", "p1", "p0", "19880101", "", "20171606.0"), (6, "s2", "p1", None, "19880101", "20150101", ""), (7, "s3", "p1", "p0", "20150101", "", "20171101"), (8, "s4", "p1", "p0", "", "", "")],
        "row_number int, section_id string, parent string, previous_parent string, created_raw string, closed_raw string, modified_raw string")
    records = registry.parsed(raw)
    assert records.filter("row_number = 5").head().modified.asDict() == {"raw": "20171606", "status": "invalid_date_year_only", "iso": None, "year": 2017}
    got = {(str(r.endpoint), r.row_number): (r.state, r.parent_then) for r in registry.at_endpoints(records, ["2015-01-01", "2017-06-01", "2025-01-01"]).collect()}
    assert [got[(d, 5)] for d in ("2015-01-01", "2017-06-01", "2025-01-01")] == [("active", "p0"), ("unresolved", None), ("active", "p1")]
    assert got[("2015-01-01", 6)] == ("inactive", None) and got[("2015-01-01", 7)] == ("active", "p0") and got[("2025-01-01", 7)] == ("active", "p1")
    assert got[("2025-01-01", 8)][0] == "unresolved"
    with pytest.raises(Exception, match="registry date"):
        registry.parsed(raw.withColumn("created_raw", F.lit("1 May 1999"))).collect()


def test_bank_responses_from_gzip(spark, tmp_path):
    record = {"distrito": {"VCodigo": "1"}, "VEdad": "30", "NHombresNac": 1, "NMujeresNac": 2, "NHombresExt": 3, "NMujeresExt": 4}
    body = {"status": "success", "errorTitulo": None, "mapaEpigrafesFiltros": {"Año: ": "2015"}, "listaConsulta": [record]}
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(json.dumps(body).encode()))
    responses = tables.read_bank(spark, str(tmp_path / "c.json.gz"))
    assert rows(tables.bank_controls(responses, {"Año: ": "2015"}), "sex", "nationality", "population") == [("female", "ESP", 2), ("female", "EXT", 4), ("male", "ESP", 1), ("male", "EXT", 3)]
    with pytest.raises(Exception, match="scope"):
        tables.bank_controls(responses, {"Año: ": "2016"}).collect()


def test_group_counts_and_fallback(spark):
    cell = "year int, age int, sex string, nationality string, population bigint"
    known = spark.createDataFrame([(2020, 1, "male", "ESP", 5), (2021, 1, "male", "ESP", 6)], cell)
    control = spark.createDataFrame([(2020, 1, "male", "ESP", 5), (2021, 1, "male", "ESP", 7)], cell)
    total = spark.createDataFrame([(2020, "male", "ESP", 5), (2021, "male", "ESP", 9)], "year int, sex string, nationality string, population bigint")
    keys = ["year", "age", "sex", "nationality"]
    matched = controls.match(known.withColumnRenamed("population", "known"), control, keys)
    with pytest.raises(Exception, match="control mismatch"):
        controls.verified(matched).collect()
    out = controls.with_fallback(known, controls.match_summary(matched, ["year"]), control, total)
    assert rows(out, "year", "age", "population", "source") == [(2020, 1, 5, "file"), (2021, 1, 7, "controls"), (2021, 100, 2, "controls")]
    with pytest.raises(Exception, match="negative open-age"):
        controls.with_fallback(known, controls.match_summary(matched, ["year"]), control, total.withColumn("population", F.lit(1).cast("bigint"))).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("geography_id,age,sex,nationality,population\ns1,30,male,ESP,4\n")
    assert tables.read_population(spark, str(tmp_path / "p.csv")).head().population == 4
    (tmp_path / "bad.csv").write_text("geography_id,age,sex,nationality,population\ns1,30,male,ESP,4\ns1,30,male,ESP,4\n")
    with pytest.raises(ContractError, match="duplicate key"):
        tables.read_population(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "g.csv").write_text("area_id,name,level,parent_id,boundary_status\na,A,section,b,unchanged\nb,B,city,,unchanged\n")
    assert rows(tables.read_geographies(spark, str(tmp_path / "g.csv")), "area_id", "parent_id") == [("a", "b"), ("b", None)]
    (tmp_path / "loop.csv").write_text("area_id,name,level,parent_id,boundary_status\na,A,section,b,unchanged\nb,B,city,a,unchanged\n")
    with pytest.raises(ContractError, match="hierarchy"):
        tables.read_geographies(spark, str(tmp_path / "loop.csv"))
    (tmp_path / "f.csv").write_text("year,age,asfr_per_1000\n2015,30,80\n")
    assert tables.read_fertility(spark, str(tmp_path / "f.csv")).head().asfr_per_1000 == 80.0
    (tmp_path / "h.csv").write_text("year,age,sex,hazard\n2015,30,male,0.02\n")
    assert tables.read_hazards(spark, str(tmp_path / "h.csv")).head().hazard == 0.02
    (tmp_path / "q.csv").write_text("year,age,sex,qx\n2015,30,male,1.5\n")
    with pytest.raises(Exception, match="qx"):
        tables.read_mortality(spark, str(tmp_path / "q.csv"))


def test_file_inventory_and_verification(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\r\n1,2\n")
    (tmp_path / "b.csv").write_bytes(b"z\n")
    found = files.file_inventory(spark, str(tmp_path))
    lock = found.withColumn("sha256", F.when(F.col("name") == "b.csv", "other").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("c.csv", "zz", 3)], "name string, sha256 string, bytes bigint"))
    assert dict(rows(files.verify(lock, found), "name", "passed")) == {"a.csv": True, "b.csv": False, "c.csv": False}
    assert dict(rows(files.changed(lock, found), "name", "problem")) == {"b.csv": "changed", "c.csv": "missing"}
    kinds = files.payloads(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("kind", F.lit("csv"))
    got = {r.name: (r.problem, r.detail) for r in files.sniff(kinds).collect()}
    assert got == {"a.csv": (None, b"x,y".hex()), "b.csv": (None, b"z".hex())}


def test_large_files_are_hashed_block_by_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE", 1000)
    content = {"a.csv": b"x" * 1000, "b c%20é.csv": bytes(range(256)) * 40, "c.csv.gz": gzip.compress(os.urandom(5000))}
    for name, body in content.items():
        (tmp_path / name).write_bytes(body)
    with open(tmp_path / "d.csv", "wb") as sparse:  # no value of Spark's can hold it
        sparse.truncate(2**31 + 5)
    found = files.file_inventory(spark, str(tmp_path))
    zeros = hashlib.sha256()
    for _ in range(2**11):
        zeros.update(bytes(2**20))
    zeros.update(bytes(5))
    expected = [(name, hashlib.sha256(body).hexdigest(), len(body)) for name, body in content.items()]
    assert rows(found, "name", "sha256", "bytes") == sorted([*expected, ("d.csv", zeros.hexdigest(), 2**31 + 5)])
    assert "LessThanOrEqual(length,1000)" in found._jdf.queryExecution().toString()
    (tmp_path / "e").mkdir()
    assert rows(files.path_inventory(spark, str(tmp_path), "a*"), "name") == [(f"file:{tmp_path}/a.csv",)]


def test_sniffing_kinds(spark):
    df = spark.createDataFrame([("j", "json", b"[1,2,3]"), ("o", "json", b'{"a":1}'), ("h", "csv", b"<!DOCTYPE HTML><p>"), ("p", "pdf", b"%PDF-1.4"), ("q", "pdf", b"PDF"), ("e", "csv", b"")], "path string, kind string, content binary")
    got = {r.name: (r.problem, r.detail) for r in files.sniff(df).collect()}
    assert got == {"j": (None, "3"), "o": (None, "1"), "h": ("HTML instead of data", None), "p": (None, None), "q": ("no PDF signature", None), "e": ("empty payload", None)}


def test_links_resolve_like_a_browser(spark):
    from urllib.parse import urljoin

    base = "https://host.example/a/b/page.html?x=1"
    hrefs = ["/data/file.csv", "file.csv", "../up/file.csv", "./here.csv?d=1#t", "https://other.example/r.zip", "//cdn.example/r.zip", "?download=1", "#resource", "../../../../top.csv", "sub/../file.rdf"]
    html = "".join(f'<a class="k" href="{h}">x</a>' for h in hrefs) + '<a href="/plain">no</a>'
    pages = spark.createDataFrame([(1, base, html)], "page_id bigint, url string, html string")
    assert rows(files.links(pages), "resource_url") == sorted((urljoin(base, h),) for h in hrefs)
    xml = spark.createDataFrame([(1, '<r a="https://x.example/1"><u> https://y.example/2 </u></r>')], "page_id bigint, xml string")
    assert rows(files.catalogue_links(xml), "resource_url") == [("https://x.example/1",), ("https://y.example/2",)]


def test_writers(spark, small, tmp_path):
    from cohort.plans.core_queries import results
    from cohort.operators import bands

    detail, profile, index = results(small)
    sinks.indicator_table(bands.indicators(profile, index, P), str(tmp_path / "ind"))
    plan = spark.read.parquet(str(tmp_path / "ind")).filter("level = 'city' and preset = 'born'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(level" in plan._jdf.queryExecution().executedPlan().toString()
    body = sinks.area_payloads(profile, index)
    sinks.write_payloads(body, str(tmp_path / "payloads"), parts=4)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "payloads")).select("value").collect()]
    assert len(lines) == index.count() and all("area_id" in x for x in lines)
    sinks.write_mortality(small.mortality, str(tmp_path / "qx"))
    assert spark.read.csv(str(tmp_path / "qx"), header=True).count() == small.mortality.count()
    with pytest.raises(ContractError):
        sinks.publish_checked(index, str(tmp_path / "no"), 10**9, "area_id")
    assert not (tmp_path / "no").exists()
    recorded = sinks.output_inventory(spark, str(tmp_path / "ind"))
    assert files.changed(recorded, sinks.output_inventory(spark, str(tmp_path / "ind"))).isEmpty() and recorded.count() > 1


def test_whole_table_rules(spark, tmp_path):
    with pytest.raises(Exception, match="duplicate key"):
        normalise.to_long(wide(spark, tmp_path, "1;101;1001;30;1;2;3;4", "1;101;1001;30;1;2;3;4")).collect()
    with pytest.raises(Exception, match="several parents"):
        normalise.to_long(wide(spark, tmp_path, "1;101;1001;30;1;2;3;4", "1;102;1001;31;1;2;3;4")).collect()
    plan = normalise.to_long(wide(spark, tmp_path, "1;101;1001;30;1;2;3;4"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    series = spark.createDataFrame([], "MetaData array<struct<Variable:struct<Codigo:string>,Codigo:string>>, Data array<struct<Anyo:int,Valor:double>>")
    codes = spark.createDataFrame([("A", 1)], "code string, age int")
    with pytest.raises(ContractError, match="no series"):
        tables.series_observations(series, {"3": "x"}, "1", "2", codes, codes.withColumnRenamed("age", "sex"), 2015, 2016)
    published = spark.createDataFrame([("M", s, "2015", str(n)) for s, n in (("Total", 3), ("Hombres", 1), ("Mujeres", 2))], "Municipios string, Sexo string, Periodo string, Total string")
    assert controls.published_totals(published, "M", [2015]).count() == 1
    with pytest.raises(ContractError, match="coverage"):
        controls.published_totals(published, "M", [2015, 2025])


def test_published_risks_are_complete(spark, small):
    assert mortality.national_extract(small.stat_rows, 2015, 2025).count() == 2000
    with pytest.raises(ContractError, match="coverage"):
        mortality.national_extract(small.stat_rows.filter("not (Edad = '30 años' and Periodo = '2016')"), 2015, 2025)
    with pytest.raises(ContractError, match="duplicate key"):
        mortality.national_extract(small.stat_rows.unionAll(small.stat_rows.filter("Edad = '30 años' and Periodo = '2016'")), 2015, 2025)


def test_sheets_and_layers_are_complete(spark):
    letters = list(tables.SHEET_COLUMNS)
    def sheet(*rows):
        return spark.createDataFrame([("2015", n, c, v) for n, values in enumerate(rows) for c, v in zip(letters, values) if v is not None], "sheet string, row int, col string, value string")
    counts = ["2", "1", "1", "2", "1", "1", "0", "0", "0", "0", "0", "0"]
    city, section = ["City", None, *counts], [None, "01001", *counts]
    assert tables.sheet_city(sheet(city, section), "City").count() == 1
    assert tables.sheet_sections(sheet(city, section), "28079").head().section_id == "2807901001"
    with pytest.raises(ContractError, match="coverage"):
        tables.sheet_city(sheet(section), "City")
    with pytest.raises(Exception, match="blank sheet count"):
        tables.sheet_sections(sheet(city, [*section[:5], None, *section[6:]]), "28079").collect()
    with pytest.raises(ContractError, match="duplicate key"):
        tables.sheet_sections(sheet(city, section, section), "28079")
    records = spark.createDataFrame([("1", "11"), ("1", "12")], "district string, barrio string")
    assert layers.parent_layer(records, 2).count() == 2
    for broken, found in ((records, 3), (records.limit(0), 2), (records.unionAll(records), 4)):
        with pytest.raises(ContractError):
            layers.parent_layer(broken, found)


def test_releases_are_replaced_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "release")
    old, new = spark.range(5).withColumn("name", F.lit("old")), spark.range(9).withColumn("name", F.when(F.col("id") > 2, "new"))
    assert sinks.write_bundle({"a": old, "b": old, "none": old.limit(0)}, folder) == ["a", "b"]
    broken = new.withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("planted"))).otherwise(F.col("id")))

    def failing():
        with sinks.release(spark, folder) as out:
            out.write("a", new)
            out.write("b", broken)

    def wrong():
        with sinks.release(spark, folder) as out:
            out.write("a", new)
            out.write("b", new, expected={"name": 5})

    for attempt, message in ((failing, "planted"), (wrong, "6 values, 5 verified")):
        with pytest.raises(Exception, match=message):
            attempt()
        assert rows(spark.read.parquet(f"{folder}/a"), "name") == rows(spark.read.parquet(f"{folder}/b"), "name") == [("old",)] * 5
        assert [p.name for p in tmp_path.iterdir()] == ["release"]
    with sinks.release(spark, folder) as out:
        out.write("a", new, expected={"name": 6, "*": 9}, partition_by=["name"])
        out.write("reports/c", old, form="json")
    assert spark.read.parquet(f"{folder}/a").count() == 9 and spark.read.json(f"{folder}/reports/c").count() == 5 and not (tmp_path / "release" / "b").exists()
    assert rows(sinks.manifest(spark, folder), "name", "column", "n") == [("a", "*", 9), ("a", "name", 6), ("reports/c", "*", 5)]
    assert [p.name for p in tmp_path.iterdir()] == ["release"]
