"""Running a Python function over Arrow batches of a text table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

ROWS_AT_ONCE = 256


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as it is and ``text`` as a string, and no other column but those named, so extra columns cannot clash."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)


def over_batches(df: DataFrame, work: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: pa.Schema) -> DataFrame:
    """Apply ``work`` to the rows of each partition in small column batches.

    ``work`` gets an iterator of ``{column: list}`` and yields the same for the output columns. Memory is bounded by
    one batch of ``ROWS_AT_ONCE`` rows and what ``work`` itself keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[dict[str, list]]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(at, ROWS_AT_ONCE)
                    yield {name: column.to_pylist() for name, column in zip(part.schema.names, part.columns, strict=True)}

        for out in work(slices()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, from_arrow_schema(schema))
