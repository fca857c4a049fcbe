"""Value transformers and validators, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transformers by name.
TRANSFORMERS: dict[str, Callable[[Column], Column]] = {
    "trim": F.trim, "lower": F.lower, "upper": F.upper, "title": F.initcap,
    "capitalize": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1))),
}


def alphanumeric(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9]*$")


def email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def length_between(c: Column, low: int = 0, high: int | None = None) -> Column:
    n = F.length(c)
    return n.between(low, high) if high is not None else n >= low


def pattern(c: Column, regex: str) -> Column:
    return c.rlike(regex)


def _digits(c: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(c, "[^0-9]", ""), ""), lambda x: x.cast("int"))


def _check(digits: Column, weights: list[int]) -> Column:
    """The modulo-11 digit over the first digits."""
    total = sum((F.element_at(digits, i + 1) * w for i, w in enumerate(weights)), F.lit(0))
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def _numbers(c: Column, size: int, first: list[int]) -> Column:
    plain = F.regexp_replace(c, "[^0-9]", "")
    digits = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.substring(F.rpad(plain, size, "0"), i, F.lit(1)).cast("int"))
    ok = (F.length(plain) == size) & (F.size(F.array_distinct(digits)) > 1)
    second = [first[0] + 1 if first[0] < 11 and size == 11 else 6, *first] if size == 14 else [first[0] + 1, *first]
    return F.coalesce(ok & (F.element_at(digits, size - 1) == _check(digits, first)) & (F.element_at(digits, size) == _check(digits, second)), F.lit(False))


def cpf(c: Column) -> Column:
    """Eleven digits, marks left out; the last two are checks; not all equal."""
    return _numbers(c, 11, [10, 9, 8, 7, 6, 5, 4, 3, 2])


def cnpj(c: Column) -> Column:
    """Fourteen digits, the last two checks."""
    return _numbers(c, 14, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])


def cep(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{5}-?\d{3}$"), F.lit(False))


#: Validators of identifiers by country and name.
COUNTRY = {("BR", "cpf"): cpf, ("BR", "cnpj"): cnpj, ("BR", "cep"): cep}


def register_country(country: str, name: str, check: Callable[[Column], Column]) -> None:
    COUNTRY[country.upper(), name.lower()] = check


def country_check(country: str, name: str, c: Column) -> Column:
    if (country.upper(), name.lower()) not in COUNTRY:
        raise LookupError(f"no validator {name!r} of {country!r}")
    return COUNTRY[country.upper(), name.lower()](c)


def transform(df: DataFrame, steps: dict[str, list[str]]) -> DataFrame:
    """Transformers of each column, in order."""
    out = {}
    for name, some in steps.items():
        c = F.col(name)
        for s in some:
            c = TRANSFORMERS[s](c)
        out[name] = c
    return df.withColumns(out)


def invalid(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that fail a check, with the names of those failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return df.withColumn("failed", failed).where(F.size("failed") > 0)
