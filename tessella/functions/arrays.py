"""Array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.registry import scalar


@scalar
def array_append(array: Column, value: Column) -> Column:
    return F.array_append(array, value)
