"""The table of registered queries and their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.plans.fixtures import Fixtures, dependencies, duckdb_views

Query = Callable[[Fixtures], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARED: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, the SQL it must equal."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def shared(name: str, sql: str) -> None:
    """A common table expression that several oracles use."""
    SHARED[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: f(Fixtures(spark, folder))

    return {name: bind(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    known = {**duckdb_views(), **SHARED}

    def whole(text: str) -> str:
        names = dependencies(text, known)
        text = f"select * from ({text})" if names and text.lstrip().startswith("with ") else text
        parts = [f"{n} as ({known[n]})" for n in names]
        # A recursive expression carries its column list in the name.
        parts = [re.sub(r"^(\w+) as \(\s*/\*cols: (.*?)\*/", r"\1(\2) as (", p) for p in parts]
        return f"with recursive {', '.join(parts)} {text}" if parts else text

    return {name: whole(text) for name, text in ORACLES.items()}
