"""Writers. Results are columnar tables; text forms are for small published extracts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohort.contracts import ContractError
from cohort.sources import files
from cohort.sources.layers import collection
from cohort.sources.layers import vertices as layer_vertices

SMALL_AREA_COLUMNS = (
    "area_id", "name", "level", "parent_id", "boundary_status", "baseline", "expected", "actual", "residual",
    "residual_per_1000", "rate_suppressed",
)


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path, compression="zstd")


def write_text_table(df: DataFrame, path: str, *, order: Sequence[str] = ()) -> None:
    """CSV with a header; ``order`` sorts the rows across the written parts."""
    flat = df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])
    (flat.orderBy(*order) if order else flat).write.mode("overwrite").csv(path, header=True)


@dataclass
class Release:
    """A folder of tables that is replaced as a whole.

    Tables are written aside and counted while they are written. Only when every table is there and every stated count is met
    does the new folder take the place of the old one, by renames of the Hadoop file system; until then, and after any
    failure, readers find the old release untouched. The folder belongs to the release: what else is in it goes with the old one.
    """

    spark: SparkSession
    folder: str
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._aside = f"{self.folder.rstrip('/')}.next-{uuid.uuid4().hex}"

    def _path(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        return f"{self._aside}/{name}" if name else self._aside

    def write(
        self, name: str, df: DataFrame, *, expected: Mapping[str, int] | None = None, partition_by: Sequence[str] = (), form: str = "parquet"
    ) -> None:
        """Write one table aside; one without a name is the folder itself.

        ``expected`` states how many values of a column must not be null (``*``: how many rows there are). The counts are
        observed while the files are written, so they are those of what is published.
        """
        seen = Observation()
        columns = sorted({"*", *(expected or {})})
        marks = [F.count(F.lit(1) if c == "*" else F.col(c)).alias(f"n{k}") for k, c in enumerate(columns)]
        writer = df.observe(seen, *marks).write.partitionBy(*partition_by).format(form)
        (writer.option("compression", "zstd") if form == "parquet" else writer).save(self._at(name))
        self.counts[name] = {c: int(seen.get[f"n{k}"]) for k, c in enumerate(columns)}
        for column, n in (expected or {}).items():
            if self.counts[name][column] != n:
                raise ContractError(f"{name}, {column}: {self.counts[name][column]} values, {n} verified")

    def publish(self) -> list[str]:
        """Put the tables that have rows, and a ``_manifest`` of their counts, in the place of the old release."""
        for name in [n for n, c in self.counts.items() if n and not c["*"]]:
            path, fs = self._path(self._at(name))
            fs.delete(path, True)
        kept = {n: c for n, c in self.counts.items() if c["*"]}
        rows = [(name, column, n) for name, c in kept.items() for column, n in sorted(c.items())]
        self.spark.createDataFrame(rows, "name string, column string, n long").coalesce(1).write.json(self._at("_manifest"))
        new, fs = self._path(self._aside)
        target, _ = self._path(self.folder.rstrip("/"))
        old, _ = self._path(f"{self.folder.rstrip('/')}.old-{uuid.uuid4().hex}")
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"cannot move the old release of {self.folder}")
        if not fs.rename(new, target):
            if had:
                fs.rename(old, target)
            raise OSError(f"cannot move the new release of {self.folder}")
        if had:
            fs.delete(old, True)
        return list(kept)

    def discard(self) -> None:
        path, fs = self._path(self._aside)
        fs.delete(path, True)


@contextmanager
def release(spark: SparkSession, folder: str) -> Iterator[Release]:
    """A release that is published at the end of the block, or not at all."""
    made = Release(spark, folder)
    try:
        yield made
        made.publish()
    except BaseException:
        made.discard()
        raise


def write_bundle(frames: Mapping[str, DataFrame], folder: str) -> list[str]:
    """The analytical tables under their names as one release; empty ones are skipped."""
    spark = next(iter(frames.values())).sparkSession
    with release(spark, folder) as out:
        for name, df in frames.items():
            out.write(name, df)
    return [n for n, c in out.counts.items() if c["*"]]


def write_long(long: DataFrame, excluded: DataFrame, profile: DataFrame, folder: str) -> None:
    """Long facts as Parquet and CSV, with their profile and the rows that were set aside."""
    write_table(long, f"{folder}/facts")
    write_text_table(long, f"{folder}/facts_csv")
    write_table(excluded, f"{folder}/excluded")
    write_table(profile, f"{folder}/profile")


def write_mortality(qx: DataFrame, path: str) -> None:
    write_text_table(qx.select("year", "age", "sex", "qx"), path, order=("year", "age", "sex"))


def detail_with_quality(detail: DataFrame, index: DataFrame) -> DataFrame:
    """Cohort detail beside its area's status."""
    return detail.join(index.select("area_id", "name", "level", "boundary_status"), "area_id")


def indicator_table(indicators: DataFrame, path: str) -> None:
    """Partitioned by level and preset, so a reader of one preset opens only its files."""
    write_table(indicators, path, partition_by=("level", "preset"))


def write_zones(vertices: DataFrame, crosswalk: DataFrame, folder: str, *, version: str, crs: str = "EPSG:25830") -> None:
    """Crosswalk rows, and the zones' polygons as GeoJSON features with CRS and version."""
    write_table(crosswalk, f"{folder}/crosswalk")
    zones = collection(vertices).select(F.col("id").alias("zone_id"), "feature", F.lit(crs).alias("crs"), F.lit(version).alias("version"))
    write_table(zones, f"{folder}/zones")


def read_zones(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(zones, vertices)`` of :func:`write_zones`: id, CRS and version of each zone, and its polygons."""
    zones = spark.read.parquet(f"{folder}/zones")
    each = zones.select(F.from_json("feature", "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>").alias("f"))
    return zones.select("zone_id", "crs", "version"), layer_vertices(each.select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates")), "area_id")


def write_geojson(vertices: DataFrame, path: str) -> None:
    """One feature per line, sorted by id."""
    collection(vertices).orderBy("id").select("feature").write.mode("overwrite").text(path)


def _number(column: str) -> Column:
    return F.col(column).cast("decimal(18,6)")


def area_payloads(profile: DataFrame, index: DataFrame, comparison: DataFrame | None = None) -> DataFrame:
    """``(area_id, body, sha256, bytes)``: one JSON text per area with its profile and variants.

    A profile has at most 262 rows, so the nested list of an area stays small.
    """
    rows = F.struct("age", "nationality", _number("baseline").alias("baseline"), _number("expected").alias("expected"), _number("actual").alias("actual"))
    nested = profile.groupBy("area_id").agg(F.array_sort(F.collect_list(rows)).alias("profile"))
    base = index.select("area_id", "name", "level", "boundary_status", _number("expected").alias("expected"), _number("actual").alias("actual"))
    joined = base.join(nested, "area_id", "left")
    fields = ["area_id", "name", "level", "boundary_status", "expected", "actual", "profile"]
    if comparison is not None:
        variant = F.struct("scenario", _number("expected").alias("expected"), _number("residual").alias("residual"))
        joined = joined.join(comparison.groupBy("area_id").agg(F.array_sort(F.collect_list(variant)).alias("sensitivities")), "area_id", "left")
        fields.append("sensitivities")
    body = joined.select("area_id", F.to_json(F.struct(*fields)).alias("body"))
    return body.select("area_id", "body", F.sha2("body", 256).alias("sha256"), F.octet_length("body").alias("bytes"))


def write_payloads(payloads: DataFrame, path: str, parts: int = 64) -> None:
    """JSON lines spread over folders by the id's hash."""
    bucket = F.pmod(F.xxhash64("area_id"), F.lit(parts)).cast("int")
    payloads.select(bucket.alias("bucket"), "body").write.mode("overwrite").partitionBy("bucket").text(path)


def boundary_review(zones: DataFrame, assessed: DataFrame) -> DataFrame:
    """The review extract: zones with parents as ``|`` lists."""
    joined = zones.join(assessed.select("zone_id", "raw_parent_status", "stable_parent"), "zone_id")
    return joined.select(
        "zone_id", F.array_join("old_ids", "|").alias("old_ids"), F.array_join("new_ids", "|").alias("new_ids"),
        "classification", "symmetric_difference_ratio", "quality_status", "raw_parent_status", "stable_parent")


def small_areas(index: DataFrame) -> DataFrame:
    return index.filter("level = 'section'").select(*SMALL_AREA_COLUMNS)


def publish_checked(candidate: DataFrame, path: str, expected: int, column: str) -> None:
    """Replace the table only if the values of ``column`` that are written are as many as the verified ones."""
    with release(candidate.sparkSession, path) as out:
        out.write("", candidate, expected={column: expected})


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``name, column, n`` of a release: the rows (``*``) and checked values of each of its tables."""
    return spark.read.schema("name string, column string, n long").json(f"{folder}/_manifest")


def write_reports(reports: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def output_inventory(spark, folder: str) -> DataFrame:
    """Name, checksum and size of everything written below a folder."""
    return files.path_inventory(spark, folder).filter(~F.col("name").rlike("/[_.][^/]*$"))
