"""Shaping of results: pick, drop, rename, defaults, JSON, instances."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def omit(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def with_defaults(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Nulls replaced, and columns added that aren't there."""
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(v)) if n in df.columns else F.lit(v) for n, v in values.items()})


def to_response(df: DataFrame, keep: list[str] | None = None, drop: tuple[str, ...] = (), names: dict[str, str] | None = None, defaults: dict[str, Any] | None = None) -> DataFrame:
    out = omit(pick(df, *keep) if keep else df, *drop)
    return rename(with_defaults(out, defaults or {}), names or {})


def as_json(df: DataFrame) -> DataFrame:
    """A row as one JSON text; dates in ISO form."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def materialize(df: DataFrame, cls: type) -> list[Any]:
    """Rows as instances of a dataclass; they come to the driver."""
    return [cls(**r.asDict(recursive=True)) for r in df.collect()]
