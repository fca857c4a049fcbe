"""Mathematical functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.expr import Expr, call
from tessella.functions.registry import registry, scalar

abs_, acos, asin, atan, atan2 = scalar(F.abs), scalar(F.acos), scalar(F.asin), scalar(F.atan), scalar(F.atan2)
ceil, ceiling, floor = scalar(F.ceil), scalar(F.ceiling), scalar(F.floor)
cos, cot, sin, tan = scalar(F.cos), scalar(F.cot), scalar(F.sin), scalar(F.tan)
degrees, radians, exp, ln = scalar(F.degrees), scalar(F.radians), scalar(F.exp), scalar(F.ln)
log10, log2, cbrt, sqrt, sign = scalar(F.log10), scalar(F.log2), scalar(F.cbrt), scalar(F.sqrt), scalar(F.sign)
pi = scalar(F.pi)


@scalar
def log(x: Column) -> Column:
    """To base 10."""
    return F.log10(x)


def log_base(base: float, x: Any) -> Expr:
    return call(f"log_base{base}", lambda c: F.log(base, c), x)


@scalar
def mod(x: Column, y: Column) -> Column:
    """With the sign of x; null where y is zero."""
    return F.try_mod(x, y)


@scalar
def power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


@scalar
def pow_(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def random(seed: int | None = None) -> Expr:
    """In [0, 1); another value at each run where no seed is given."""
    return call(f"random{seed}", lambda: F.rand(seed))


rand = random


def round_(x: Any, digits: int = 0) -> Expr:
    """Halves away from zero."""
    return call(f"round{digits}", lambda c: F.round(c, digits), x)


def trunc(x: Any, digits: int = 0) -> Expr:
    """Towards zero."""
    scale = float(10**digits)
    return call(f"trunc{digits}", lambda c: F.when(c < 0, F.ceil(c * scale)).otherwise(F.floor(c * scale)) / scale, x)


truncate = trunc
registry.add("rand", F.rand)
registry.add("random", F.rand)
