"""Cohort building, silo-wise model training and model comparison on Spark DataFrames."""

from .spec import DatasetSpec, RunConfig

__all__ = ["DatasetSpec", "RunConfig"]
