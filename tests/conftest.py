from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from check_oracle import session

    return session()


@pytest.fixture(scope="session")
def small(spark):
    from cohort.plans.fixtures import Fixtures

    return Fixtures(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def medium(spark):
    from cohort.plans.fixtures import Fixtures

    return Fixtures(spark, "/root/testdata/sf0.01")


def rows(df, *columns):
    """Sorted tuples of the named columns."""
    return sorted(tuple(r) for r in df.select(*columns).collect())
