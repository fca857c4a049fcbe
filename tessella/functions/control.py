"""Choices between values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.registry import registry, scalar

coalesce, nullif = scalar(F.coalesce), scalar(F.nullif)
#: Nulls are left out.
greatest, least = scalar(F.greatest), scalar(F.least)
if_null = coalesce
registry.add("ifnull", F.coalesce)
