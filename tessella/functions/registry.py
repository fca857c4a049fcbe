"""Functions by name; a caller may add its own, as callables from columns to a column."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.expr import Expr, call


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Callable[..., Column]] = {}

    def add(self, name: str, make: Callable[..., Column]) -> None:
        self._known[name.lower()] = make

    def get(self, name: str) -> Callable[..., Column]:
        """What was added under the name, else Spark's own function of it."""
        return self._known.get(name.lower()) or (lambda *columns: F.call_function(name, *columns))

    def names(self) -> list[str]:
        return sorted(self._known)


registry = Registry()


def function_call(name: str, *args: Any) -> Expr:
    """A call by name."""
    return call(name.lower(), registry.get(name), *args)


def scalar(make: Callable[..., Column]) -> Callable[..., Expr]:
    """Register a function of columns, and give back a builder of expressions."""
    name = make.__name__.rstrip("_")
    registry.add(name, make)

    def build(*args: Any) -> Expr:
        return call(name, make, *args)

    build.__name__, build.__doc__ = make.__name__, make.__doc__
    return build
