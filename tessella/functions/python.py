"""Functions written in Python, for what columns can't express: Arrow batches, never single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessella.functions.registry import registry


def scalar_function(name: str, returns: str, f: Callable[..., pd.Series]) -> Callable[..., Column]:
    """A function of series, registered under a name for ``function_call``."""
    made = F.pandas_udf(f, returns)
    registry.add(name, made)
    return made


def aggregate_function(name: str, returns: str, f: Callable[..., Any]) -> Callable[..., Column]:
    """A function from the series of a group to one value. A group is held in memory: use it on groups of known size."""

    def annotated(values: pd.Series) -> float:
        return f(values)

    made = F.pandas_udf(annotated, returns)
    registry.add(name, made)
    return made


def table_function(spark: SparkSession, name: str, returns: str, rows: Callable[..., Iterator[tuple]]) -> Callable[..., Any]:
    """A function that gives rows, callable from SQL and from Python."""

    class Rows:
        def eval(self, *args):
            yield from rows(*args)

    made = F.udtf(Rows, returnType=returns)
    spark.udtf.register(name, made)
    return made
