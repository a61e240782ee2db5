"""Small column expressions: numeric tests, codes, labels and tolerant dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort.contracts import must_fail
from cohort.params import DISTRICTS, SECTION_PREFIX, STATUSES, Params


def is_finite(value: Column) -> Column:
    """Spark treats NaN as equal to itself and above every number, so test it by name."""
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def is_close(a: Column, b: Column, rel: float = 1e-9, tol: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel, F.lit(tol))


def is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def divide(a: Column, b: Column) -> Column:
    """NULL on a zero denominator (ANSI mode would fail)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def status_rank(status: Column) -> Column:
    """0 for unchanged up to 3 for unreliable."""
    ladder = F.when(status == STATUSES[0], 0)
    for rank, name in enumerate(STATUSES[1:], 1):
        ladder = ladder.when(status == name, rank)
    return ladder


def rank_status(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUSES]), rank.cast("int") + 1)


def spanish_number(text: Column) -> Column:
    """``1.234,5`` to 1234.5; anything else to NULL."""
    return F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def single_age(label: Column) -> Column:
    """``7 años`` to 7, NULL for open or banded labels."""
    return F.regexp_extract(label, "^([0-9]+) años?$", 1).try_cast("int")


def canonical_section(district: Column, section: Column, prefix: str = SECTION_PREFIX) -> Column:
    """Full section id from the code widths seen in raw files; NULL when the codes disagree."""
    d, s = F.trim(district.cast("string")), F.trim(section.cast("string"))
    dd = F.lpad(d, 2, "0")
    five = F.when(F.length(s) == 4, F.lpad(s, 5, "0")).when(F.length(s) == 5, s)
    local = F.when(five.isNotNull(), F.when(F.substring(five, 1, 2) == dd, F.substring(five, 3, 3)))
    short = F.when(F.length(s) <= 3, F.lpad(s, 3, "0"))
    code = F.when(F.length(s) == 10, F.when(s.startswith(F.concat(F.lit(prefix), dd)), s)).otherwise(
        F.concat(F.lit(prefix), dd, F.coalesce(local, short))
    )
    return F.when(is_digits(d) & is_digits(s) & (F.length(d) <= 2), code)


def canonical_barrio(district: Column, barrio: Column, width: int = 4) -> Column:
    """Barrio code of the declared width led by its district; NULL when it disagrees."""
    dd = F.lpad(F.trim(district.cast("string")), 2, "0")
    raw = F.trim(barrio.cast("string"))
    code = F.lpad(raw, width, "0")
    fits = is_digits(raw) & (F.length(raw) <= width) & (F.substring(code, 1, 2) == dd)
    return F.when(fits & (F.substring(code, 3, width).try_cast("int") != 0), code)


def canonical_parent(district: Column, barrio: Column | None = None) -> Column:
    """Parent-layer code: ``dd`` or ``ddbb`` from a district and a one-digit unit."""
    d = F.trim(district.cast("string")).try_cast("int")
    good = d.between(1, DISTRICTS)
    if barrio is None:
        return F.when(good, F.lpad(d.cast("string"), 2, "0"))
    b = F.trim(barrio.cast("string")).try_cast("int")
    good = good & (F.floor(b / 10) == d) & (b % 10 >= 1)
    return F.when(good, F.concat(F.lpad(d.cast("string"), 2, "0"), F.lpad((b % 10).cast("string"), 2, "0")))


def section_id(section: Column, prefix: str = SECTION_PREFIX) -> Column:
    """Integer ``dssss`` code to the full id; NULL for a missing section."""
    d, s = F.floor(section / 1000), section % 1000
    return F.when(section.isNotNull(), F.concat(F.lit(prefix), F.lpad(d.cast("string"), 2, "0"), F.lpad(s.cast("string"), 3, "0")))


def age_fields(label: Column, year: Column, params: Params, low: int | None = None, high: int | None = None) -> Column:
    """Struct ``age, age_kind, cohort_status`` of a raw age label in a snapshot year.

    ``low`` and ``high`` bound the endpoint ages under study.
    """
    low = params.interval if low is None else low
    high = params.terminal_age - 1 if high is None else high
    age = label.try_cast("int")
    endpoint = age + F.when(year == params.start_year, params.interval).otherwise(0)
    open_label = label == "100 o +"
    in_domain = age.between(0, 130)
    kind = F.when(open_label, "open_100_plus").when(age.isNull(), "unknown").when(~in_domain, "outside_contract").otherwise("single")
    status = (
        F.when(open_label, "excluded_terminal")
        .when(age.isNull() | ~in_domain, "excluded_invalid_age")
        .when(endpoint > high, "excluded_terminal")
        .when(endpoint < low, "observed_born_during_interval")
        .otherwise("eligible")
    )
    return F.struct(age.alias("age"), kind.alias("age_kind"), status.alias("cohort_status"))


def registry_date(text: Column) -> Column:
    """Struct ``raw, status, iso, year``: an impossible day keeps its year; other encodings fail."""
    raw = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.0$", "")
    blank = raw == ""
    year = F.substring(raw, 1, 4).try_cast("int")
    readable = raw.rlike("^[0-9]{8}$") & year.between(1900, 2100)
    iso = F.try_to_date(F.when(readable, raw), "yyyyMMdd")
    status = (
        F.when(blank, "missing")
        .when(~readable, must_fail("unrecognised registry date"))
        .when(iso.isNull(), "invalid_date_year_only")
        .otherwise("valid")
    )
    return F.struct(raw.alias("raw"), status.alias("status"), iso.alias("iso"), F.when(~blank, year).alias("year"))


def parent_at_endpoint(current: Column, previous: Column, modified: Column, endpoint: Column) -> Column:
    """Struct ``parent, basis``: the parent in force at a date, from a dated or year-only change."""
    status, target = modified["status"], F.year(endpoint)
    dated = F.when(endpoint < modified["iso"], previous).otherwise(current)
    bracket = F.when(target < modified["year"], previous).when(target > modified["year"], current)
    year_only = status == "invalid_date_year_only"
    parent = F.when(previous.isNull(), current).when(status == "valid", dated).when(year_only, bracket)
    basis = (
        F.when(previous.isNull(), "no_previous_parent_recorded")
        .when(status == "valid", "dated_reassignment")
        .when(year_only & bracket.isNotNull(), "year_bracket_only")
        .otherwise("unresolved_modification_date")
    )
    return F.struct(parent.alias("parent"), basis.alias("basis"))


def product(values: Column) -> Column:
    """Left-to-right product of an array of doubles."""
    return F.aggregate(values, F.lit(1.0), lambda acc, x: acc * x)


def title_case(text: Column) -> Column:
    return F.initcap(F.trim(text))
