"""Raw payloads: inventories with checksums, verification, sniffing and link discovery."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that mark a link to a data resource.
LINK_TOKENS = ("download", "resource", ".zip", ".csv", ".rdf", "historico")
PAYLOAD = ["name", "sha256", "bytes"]
WHOLE = 64 << 20  # bytes of a file that may be one value
LARGEST = (1 << 31) - 1  # bytes of a value that Spark can hold
BLOCK = 4 << 20  # bytes of a larger file that are in memory at once


def payloads(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, content)`` of every file below a folder, one row per file.

    Spark leaves empty files out, so :func:`verify` reports a locked but empty file as failed.
    """
    return _listed(spark, folder, pattern).select("path", "content")


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def inventory(files: DataFrame, name: str = "path") -> DataFrame:
    """``(name, sha256, bytes)`` of binary or text payloads in ``content``."""
    return files.select(F.col(name).alias("name"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
                        F.octet_length("content").cast("bigint").alias("bytes"))


def path_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Inventory of a folder by path.

    A file of up to ``WHOLE`` bytes is read as one value. A larger one is hashed by the task that lists it, block by block, since
    SHA-256 runs from start to end. Its worker opens it with Arrow, which need not reach what Spark's reader does: outside of
    local or mounted folders only files too large for a value go that way.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*batch.to_pydict().values(), strict=True):
                digest, size = hashlib.sha256(), 0
                scheme, rest = path.split(":", 1)
                system, name = FileSystem.from_uri(f"{scheme}:{quote(rest)}")
                with system.open_input_stream(name, compression=None, buffer_size=0) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                        size += len(block)
                if size != length:
                    raise OSError(f"{path} has {length} bytes, and {size} were read")
                yield pa.RecordBatch.from_pylist([{"name": path, "sha256": digest.hexdigest(), "bytes": size}])

    listed = _listed(spark, folder, pattern)
    whole = WHOLE if all(p.startswith("file:") for p in listed.inputFiles()) else LARGEST
    small = inventory(listed.filter(F.col("length") <= whole))  # pushed into the scan, which then opens no larger file
    large = listed.filter(F.col("length") > whole).select("path", "length")
    return small.unionByName(large.mapInArrow(hashed, "name string, sha256 string, bytes bigint"))


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Inventory of a folder by file name."""
    return path_inventory(spark, folder, pattern).withColumn("name", F.regexp_extract("name", "([^/]+)$", 1))


def verify(lock: DataFrame, found: DataFrame) -> DataFrame:
    """Each locked source, once: passed when a payload of its name has its checksum and size.

    ``lock`` is (name, sha256, bytes) plus provenance columns; ``found`` is an inventory. A name may have several payloads.
    """
    have = found.select(*PAYLOAD).distinct().withColumn("passed", F.lit(True))
    joined = lock.join(have, PAYLOAD, "left")
    return joined.select("name", *[c for c in lock.columns if c != "name"], F.coalesce("passed", F.lit(False)).alias("passed"))


def changed(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded outputs that are gone or differ now, and files nobody recorded.

    Where a name has several payloads, each recorded one is looked for among all of the name: it is ``missing`` when none is
    left, ``changed`` when none equals it.
    """
    lost = recorded.join(found.select(*PAYLOAD).distinct(), PAYLOAD, "left_anti").select("name")
    named = found.select("name").distinct().withColumn("problem", F.lit("changed"))
    differ = lost.join(named, "name", "left").select("name", F.coalesce("problem", F.lit("missing")).alias("problem"))
    extra = found.join(recorded.select("name"), "name", "left_anti").select("name", F.lit("unrecorded").alias("problem"))
    return differ.unionByName(extra)


def sniff(files: DataFrame, name: str = "path", kind: str = "kind") -> DataFrame:
    """``(name, kind, problem, detail)``: what a payload shows against the kind it claims to be.

    Empty payloads and HTML in place of data are refused, a PDF needs its signature, a CSV gives
    the hex of its header line and JSON its number of entries.
    """
    raw = F.col("content").cast("binary")
    head = F.decode(F.substring(raw, 1, 2048), "ISO-8859-1")
    text = F.try_validate_utf8(raw.cast("string"))
    html = head.rlike(r"(?i)<!doctype html|<html[\s>]")
    k = F.col(kind)
    problem = (
        F.when(F.length(raw) == 0, "empty payload")
        .when((k != "html") & html, "HTML instead of data")
        .when((k == "pdf") & ~head.startswith("%PDF-"), "no PDF signature")
    )
    first_line = F.regexp_replace(F.split_part(F.decode(raw, "ISO-8859-1"), F.lit("\n"), F.lit(1)), "\r$", "")
    entries = F.coalesce(F.json_array_length(text), F.size(F.json_object_keys(text)))
    detail = F.when(k == "csv", F.lower(F.hex(F.encode(first_line, "ISO-8859-1")))).when(k == "json", entries.cast("string"))
    return files.select(F.col(name).alias("name"), k.alias("kind"), problem.alias("problem"), F.when(problem.isNull(), detail).alias("detail"))


def _resolved(base: Column, link: Column) -> Column:
    """Absolute form of a link found on a page (RFC 3986 reference resolution)."""
    scheme, host = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)//", 1), F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    origin = F.concat(scheme, F.lit("//"), host)
    target, tail = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    merged = F.when(target.startswith("/"), target).otherwise(
        F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1)), target))
    # Dot segments: ".." drops the segment before it, "." itself; a final one leaves a slash.
    parts = F.split(merged, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(p == ".", acc).otherwise(F.concat(acc, F.array(p))),
    )
    last_dot = F.element_at(parts, -1).isin(".", "..")
    clean = F.concat(F.array_join(kept, "/"), F.when(last_dot, "/").otherwise(""))
    return (
        F.when(link.rlike(r"^[a-zA-Z][\w+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .otherwise(F.concat(origin, clean, tail))
    )


def links(pages: DataFrame, tokens: Sequence[str] = LINK_TOKENS) -> DataFrame:
    """``(page_id, resource_url)``: distinct links of each page that name a resource."""
    href = r"""(?i)<[a-z][^<>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = [F.regexp_extract_all("html", F.lit(href), F.lit(i)) for i in (1, 2, 3)]
    each = pages.select("page_id", "url", F.explode(F.array_distinct(F.concat(*found))).alias("link")).filter("link <> ''")
    link = F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))
    hit = F.lit(False)
    for token in tokens:
        hit = hit | F.contains(F.lower(link), F.lit(token))
    return each.filter(hit).select("page_id", _resolved(F.col("url"), link).alias("resource_url")).distinct()


def catalogue_links(documents: DataFrame) -> DataFrame:
    """``(page_id, resource_url)``: https addresses in attributes or text of XML in ``xml``."""
    text = F.concat(F.regexp_extract_all("xml", F.lit(r""">\s*(https://[^<\s]+)\s*<"""), F.lit(1)),
                    F.regexp_extract_all("xml", F.lit(r"""=\s*["']\s*(https://[^"'\s]+)\s*["']"""), F.lit(1)))
    return documents.select("page_id", F.explode(F.array_distinct(text)).alias("resource_url"))
