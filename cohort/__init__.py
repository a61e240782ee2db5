"""Cohort accounting on small-area population tables, as Spark DataFrame jobs."""

from cohort.contracts import ContractError
from cohort.params import Params

__all__ = ["ContractError", "Params"]
