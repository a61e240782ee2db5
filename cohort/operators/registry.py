"""The section change registry against raw membership at given dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.functions.expressions import parent_at_endpoint, registry_date


def parsed(registry: DataFrame) -> DataFrame:
    """Raw date texts to ``created, closed, modified`` structs."""
    return registry.withColumns({c: registry_date(F.col(f"{c}_raw")) for c in ("created", "closed", "modified")})


def at_endpoints(records: DataFrame, endpoints: list[str]) -> DataFrame:
    """Each record at each endpoint: state active, inactive or unresolved, and its parent there.

    A record holds from its creation up to, not including, its closing date.
    """
    dates = F.array(*[F.lit(e).cast("date") for e in endpoints])
    r = records.withColumn("endpoint", F.explode(dates))
    dated = (F.col("created.status") == "valid") & F.col("closed.status").isin("valid", "missing")
    inside = (F.col("created.iso") <= F.col("endpoint")) & (F.col("closed.iso").isNull() | (F.col("closed.iso") > F.col("endpoint")))
    r = r.withColumn("_p", parent_at_endpoint(F.col("parent"), F.col("previous_parent"), F.col("modified"), F.col("endpoint")))
    state = F.when(~dated, "unresolved").when(~inside, "inactive").when(F.col("_p.parent").isNull(), "unresolved").otherwise("active")
    return r.select(
        "endpoint", "row_number", "section_id", state.alias("state"),
        F.when(state == "active", F.col("_p.parent")).alias("parent_then"), F.col("_p.basis").alias("basis"),
    )


def compare(states: DataFrame, membership: DataFrame) -> DataFrame:
    """Per endpoint and section: raw parents, registry parents and whether they agree.

    ``membership`` is (endpoint, section_id, barrio).
    """
    active = states.filter("state = 'active'").groupBy("endpoint", "section_id").agg(
        F.array_sort(F.collect_set("parent_then")).alias("registry_parents"))
    raw = membership.groupBy("endpoint", "section_id").agg(F.array_sort(F.collect_set("barrio")).alias("raw_parents"))
    joined = raw.join(active, ["endpoint", "section_id"], "full")
    none = F.array().cast("array<string>")
    kind = (
        F.when(F.col("raw_parents").isNull(), "registry_only")
        .when(F.col("raw_parents") == F.coalesce("registry_parents", none), "match")
        .otherwise("difference")
    )
    return joined.select(
        "endpoint", "section_id", kind.alias("outcome"),
        F.coalesce("raw_parents", none).alias("raw_parents"), F.coalesce("registry_parents", none).alias("registry_parents"),
    )


def summary(states: DataFrame, compared: DataFrame) -> DataFrame:
    """Per endpoint: active sections, matches, differences, registry-only ids, unresolved rows."""
    rows = states.groupBy("endpoint").agg(F.count_if(F.col("state") == "unresolved").alias("unresolved_rows"))
    counts = compared.groupBy("endpoint").agg(
        F.count_if(F.size("registry_parents") > 0).alias("active_sections"),
        *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("match", "matches"), ("difference", "differences"), ("registry_only", "registry_only"))],
    )
    return counts.join(rows, "endpoint")


def corroborated(zones: DataFrame, assessed: DataFrame, compared: DataFrame, old_endpoint: str, new_endpoint: str) -> DataFrame:
    """Unchanged zones with unstable parents, flagged when no registry difference touches them."""
    odd = zones.filter("classification = 'unchanged'").join(assessed.filter("not stable_parent").select("zone_id"), "zone_id", "left_semi")
    ids = F.explode(F.concat(
        F.transform("old_ids", lambda i: F.struct(F.lit(old_endpoint).cast("date").alias("endpoint"), i.alias("section_id"))),
        F.transform("new_ids", lambda i: F.struct(F.lit(new_endpoint).cast("date").alias("endpoint"), i.alias("section_id"))),
    ))
    sections = odd.select("zone_id", ids.alias("_s")).select("zone_id", "_s.*")
    issues = compared.filter("outcome = 'difference'").select("endpoint", "section_id", F.lit(1).alias("_i"))
    hit = sections.join(issues, ["endpoint", "section_id"], "left")
    return hit.groupBy("zone_id").agg((F.count("_i") == 0).alias("corroborated"))
