"""Expressions: small immutable objects that know the tables they read and become Spark columns when a query is built.

Literals are always ``F.lit``; nothing is put into SQL text. Comparisons have SQL's three-valued logic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expr:
    """``build(scope)`` gives the column; ``tables`` are those it reads; ``key`` identifies equal expressions."""

    build: Callable[[Any], Column]
    tables: frozenset[str]
    key: str
    aggregate: bool = False
    window: bool = False
    name: str | None = None

    def alias(self, name: str) -> Expr:
        return Expr(self.build, self.tables, self.key, self.aggregate, self.window, name)


@dataclass(frozen=True)
class Order:
    """A sort term; where the place of nulls isn't given, they are first ascending and last descending."""

    term: Expr
    descending: bool = False
    nulls: str | None = None
    collation: str | None = None


def col(name: str) -> Expr:
    """A column by ``table.column``, or by its name alone."""
    table, _, column = name.rpartition(".")
    return Expr(lambda s: s.column(table or None, column), frozenset([table] if table else []), f"col({name})", name=column)


outer = col  # within one query, an outer reference is resolved by the scope that it stands in


def outer_ref(name: str) -> Expr:
    """A column of the query around a scalar subquery, by ``alias.column``."""
    table, _, column = name.rpartition(".")
    return Expr(lambda s: F.col(f"`{table}`.`{column}`").outer(), frozenset(), f"outer({name})", name=column)


def alias_ref(name: str) -> Expr:
    """A reference to a name of the projection."""
    return Expr(lambda s: s.projected(name), frozenset(), f"alias({name})", name=name)


def lit(value: Any) -> Expr:
    return Expr(lambda s: F.lit(value), frozenset(), f"lit({value!r})")


def raw(text: str) -> Expr:
    """A column from Spark SQL text; for trusted text only."""
    return Expr(lambda s: F.expr(text), frozenset(), f"raw({text})", aggregate=any(f"{f}(" in text.lower() for f in ("count", "sum", "avg", "min", "max", "listagg")))


def to_expr(value: Any) -> Expr:
    """Expressions as they are, anything else as a literal."""
    return value if isinstance(value, Expr) else lit(value)


def call(name: str, make: Callable[..., Column], *args: Any, aggregate: bool = False) -> Expr:
    """``make`` over the columns of the arguments."""
    parts = [to_expr(a) for a in args]
    return Expr(
        lambda s: make(*[p.build(s) for p in parts]), frozenset().union(*[p.tables for p in parts]), f"{name}({','.join(p.key for p in parts)})",
        aggregate or any(p.aggregate for p in parts), any(p.window for p in parts), name,
    )


# comparisons ---------------------------------------------------------------------------------------------------------


def eq(a: Any, b: Any) -> Expr:
    return call("eq", lambda x, y: x == y, a, b)


def neq(a: Any, b: Any) -> Expr:
    return call("neq", lambda x, y: x != y, a, b)


def gt(a: Any, b: Any) -> Expr:
    return call("gt", lambda x, y: x > y, a, b)


def gte(a: Any, b: Any) -> Expr:
    return call("gte", lambda x, y: x >= y, a, b)


def lt(a: Any, b: Any) -> Expr:
    return call("lt", lambda x, y: x < y, a, b)


def lte(a: Any, b: Any) -> Expr:
    return call("lte", lambda x, y: x <= y, a, b)


def like(a: Any, pattern: str, escape: str = "\\") -> Expr:
    return call(f"like:{pattern}", lambda x: F.like(x, F.lit(pattern), F.lit(escape)), a) if escape else call(f"like:{pattern}", lambda x: F.like(x, F.lit(pattern), F.lit("\\u0001")), a)


def not_like(a: Any, pattern: str, escape: str = "\\") -> Expr:
    return not_(like(a, pattern, escape))


def and_(*terms: Any) -> Expr:
    """TRUE without terms."""
    return call("and", lambda *cs: _fold(cs, lambda x, y: x & y, True), *terms)


def or_(*terms: Any) -> Expr:
    """FALSE without terms."""
    return call("or", lambda *cs: _fold(cs, lambda x, y: x | y, False), *terms)


def _fold(columns: Iterable[Column], join: Callable, empty: bool) -> Column:
    out = None
    for c in columns:
        out = c if out is None else join(out, c)
    return F.lit(empty) if out is None else out


def not_(a: Any) -> Expr:
    return call("not", lambda x: ~x, a)


def is_null(a: Any) -> Expr:
    return call("is_null", lambda x: x.isNull(), a)


def is_not_null(a: Any) -> Expr:
    return call("is_not_null", lambda x: x.isNotNull(), a)


def in_list(a: Any, values: Iterable[Any]) -> Expr:
    """FALSE for no values."""
    values = list(values)
    return call(f"in{values!r}", lambda x: x.isin(values), a) if values else lit(False)


def not_in_list(a: Any, values: Iterable[Any]) -> Expr:
    """TRUE for no values."""
    values = list(values)
    return not_(in_list(a, values)) if values else lit(True)


def between(a: Any, low: Any, high: Any) -> Expr:
    return call("between", lambda x, y, z: x.between(y, z), a, low, high)


def not_between(a: Any, low: Any, high: Any) -> Expr:
    return not_(between(a, low, high))


def is_distinct_from(a: Any, b: Any) -> Expr:
    return call("distinct", lambda x, y: ~x.eqNullSafe(y), a, b)


def is_not_distinct_from(a: Any, b: Any) -> Expr:
    return call("not_distinct", lambda x, y: x.eqNullSafe(y), a, b)


# arithmetic ----------------------------------------------------------------------------------------------------------


def add(a: Any, b: Any) -> Expr:
    return call("add", lambda x, y: x + y, a, b)


def sub(a: Any, b: Any) -> Expr:
    return call("sub", lambda x, y: x - y, a, b)


def mul(a: Any, b: Any) -> Expr:
    return call("mul", lambda x, y: x * y, a, b)


def div(a: Any, b: Any) -> Expr:
    """A fraction also of whole numbers; null where the divisor is zero."""
    return call("div", F.try_divide, a, b)


def bit_and(a: Any, b: Any) -> Expr:
    return call("bit_and", lambda x, y: x.bitwiseAND(y), a, b)


def bit_or(a: Any, b: Any) -> Expr:
    return call("bit_or", lambda x, y: x.bitwiseOR(y), a, b)


def bit_xor(a: Any, b: Any) -> Expr:
    return call("bit_xor", lambda x, y: x.bitwiseXOR(y), a, b)


def shift_left(a: Any, n: int) -> Expr:
    return call(f"shl{n}", lambda x: F.shiftleft(x, n), a)


def shift_right(a: Any, n: int) -> Expr:
    return call(f"shr{n}", lambda x: F.shiftright(x, n), a)


# other nodes ---------------------------------------------------------------------------------------------------------


def case_when(branches: list[tuple[Any, Any]], otherwise: Any = None) -> Expr:
    """Searched CASE; null where no branch holds and there is no other value."""
    flat = [x for b in branches for x in b]

    def make(*cs: Column) -> Column:
        out = F.when(cs[0], cs[1])
        for i in range(2, len(cs) - 1, 2):
            out = out.when(cs[i], cs[i + 1])
        return out.otherwise(cs[-1])

    return call("case", make, *flat, otherwise)


#: SQL type names and what they are in Spark; a length or precision in brackets is passed on for decimals.
TYPES = {
    "int": "int", "integer": "int", "bigint": "bigint", "smallint": "smallint", "tinyint": "tinyint", "decimal": "decimal", "numeric": "decimal", "float": "float", "double": "double",
    "real": "float", "boolean": "boolean", "bool": "boolean", "varchar": "string", "char": "string", "text": "string", "string": "string", "uuid": "string", "enum": "string", "json": "string",
    "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "binary": "binary", "varbinary": "binary", "blob": "binary", "bytea": "binary",
    "vector": "array<float>", "halfvec": "array<float>",
}


def spark_type(name: str) -> str:
    base, _, rest = name.strip().lower().partition("(")
    if base.strip() not in TYPES:
        raise ValueError(f"unknown type {name!r}")
    kind = TYPES[base.strip()]
    return f"decimal({rest.rstrip(')')})" if kind == "decimal" and rest else "decimal(38,18)" if kind == "decimal" else kind


def cast(a: Any, to: str, safe: bool = False) -> Expr:
    """Cast to a SQL type; doubles lose their fraction on the way to whole numbers. safe: null for bad input."""
    kind = spark_type(to)
    return call(f"cast:{kind}", lambda x: x.try_cast(kind) if safe else x.cast(kind), a)


#: Collations by the names that databases give them.
COLLATIONS = {"nocase": "UTF8_LCASE", "utf8_lcase": "UTF8_LCASE", "binary": "UTF8_BINARY", "utf8_binary": "UTF8_BINARY", "unicode": "UNICODE", "unicode_ci": "UNICODE_CI", "utf8mb4_general_ci": "UTF8_LCASE"}


def collate(a: Any, name: str) -> Expr:
    if name.lower() not in COLLATIONS:
        raise ValueError(f"unknown collation {name!r}")
    return call(f"collate:{name}", lambda x: F.collate(x, COLLATIONS[name.lower()]), a)


def json_path(a: Any, path: str) -> Expr:
    """The text at a ``$`` path."""
    if not path.startswith("$"):
        raise ValueError("a JSON path starts with $")
    return call(f"json:{path}", lambda x: F.get_json_object(x, path), a)


def custom(name: str, make: Callable[..., Column], *args: Any) -> Expr:
    """A node of one's own."""
    return call(name, make, *args)


# aggregates ----------------------------------------------------------------------------------------------------------


def count(a: Any) -> Expr:
    return call("count", F.count, a, aggregate=True)


def count_all() -> Expr:
    return Expr(lambda s: F.count(F.lit(1)), frozenset(), "count(*)", True, name="count")


def count_distinct(a: Any, approximate: bool = False) -> Expr:
    return call(f"count_distinct{approximate}", F.approx_count_distinct if approximate else F.count_distinct, a, aggregate=True)


def sum_(a: Any) -> Expr:
    return call("sum", F.sum, a, aggregate=True)


def avg(a: Any) -> Expr:
    return call("avg", F.avg, a, aggregate=True)


def min_(a: Any) -> Expr:
    return call("min", F.min, a, aggregate=True)


def max_(a: Any) -> Expr:
    return call("max", F.max, a, aggregate=True)


def stddev(a: Any) -> Expr:
    """Of the sample."""
    return call("stddev", F.stddev_samp, a, aggregate=True)


def variance(a: Any) -> Expr:
    """Of the sample."""
    return call("variance", F.var_samp, a, aggregate=True)


def group_concat(a: Any, separator: str = ",", order_by: Any = None, descending: bool = False) -> Expr:
    """Values joined in the order of ``order_by`` (of the values, if none): the result doesn't hang on the rows' order."""

    def make(x: Column, o: Column) -> Column:
        pairs = F.sort_array(F.filter(F.collect_list(F.struct(o.alias("o"), x.cast("string").alias("x"))), lambda p: p["x"].isNotNull()), asc=not descending)
        return F.when(F.count(x) > 0, F.array_join(F.transform(pairs, lambda p: p["x"]), separator))

    return call(f"group_concat:{separator}{descending}", make, a, a if order_by is None else order_by, aggregate=True)


# windows -------------------------------------------------------------------------------------------------------------


def over(function: Expr, partition_by: Iterable[Any] = (), order_by: Iterable[Order | Expr] = ()) -> Expr:
    """A function over a window with SQL's default frame."""
    parts, orders = [to_expr(p) for p in partition_by], [o if isinstance(o, Order) else Order(o) for o in order_by]

    def build(s: Any) -> Column:
        w = Window.partitionBy(*[p.build(s) for p in parts])
        return function.build(s).over(w.orderBy(*[sort_column(o, s) for o in orders]) if orders else w)

    tables = frozenset().union(function.tables, *[p.tables for p in parts], *[o.term.tables for o in orders])
    return Expr(build, tables, f"{function.key}over({parts}{orders})", False, True, function.name)


def _ranking(name: str, make: Callable[[], Column], partition_by, order_by) -> Expr:
    if not order_by:
        raise ValueError(f"{name} needs an order")
    return over(Expr(lambda s: make(), frozenset(), f"{name}()", name=name), partition_by, order_by)


def row_number(partition_by=(), order_by=()) -> Expr:
    return _ranking("row_number", F.row_number, partition_by, order_by)


def rank(partition_by=(), order_by=()) -> Expr:
    return _ranking("rank", F.rank, partition_by, order_by)


def dense_rank(partition_by=(), order_by=()) -> Expr:
    return _ranking("dense_rank", F.dense_rank, partition_by, order_by)


def percent_rank(partition_by=(), order_by=()) -> Expr:
    return _ranking("percent_rank", F.percent_rank, partition_by, order_by)


def cume_dist(partition_by=(), order_by=()) -> Expr:
    return _ranking("cume_dist", F.cume_dist, partition_by, order_by)


def ntile(n: int, partition_by=(), order_by=()) -> Expr:
    return _ranking("ntile", lambda: F.ntile(n), partition_by, order_by)


def lag(a: Any, offset: int = 1, default: Any = None, partition_by=(), order_by=()) -> Expr:
    if not order_by:
        raise ValueError("lag needs an order")
    return over(call(f"lag{offset}{default!r}", lambda x: F.lag(x, offset, default), a), partition_by, order_by)


def lead(a: Any, offset: int = 1, default: Any = None, partition_by=(), order_by=()) -> Expr:
    if not order_by:
        raise ValueError("lead needs an order")
    return over(call(f"lead{offset}{default!r}", lambda x: F.lead(x, offset, default), a), partition_by, order_by)


def first_value(a: Any, partition_by=(), order_by=()) -> Expr:
    return over(call("first_value", F.first_value, a), partition_by, order_by)


def last_value(a: Any, partition_by=(), order_by=()) -> Expr:
    """Of the default frame: of the current row and its peers, where there is an order."""
    return over(call("last_value", F.last_value, a), partition_by, order_by)


def nth_value(a: Any, n: int, partition_by=(), order_by=()) -> Expr:
    return over(call(f"nth{n}", lambda x: F.nth_value(x, n), a), partition_by, order_by)


# order ---------------------------------------------------------------------------------------------------------------


def asc(term: Any, nulls: str | None = None, collation: str | None = None) -> Order:
    return Order(to_expr(term), False, nulls, collation)


def desc(term: Any, nulls: str | None = None, collation: str | None = None) -> Order:
    return Order(to_expr(term), True, nulls, collation)


def sort_column(order: Order, scope: Any, column: Column | None = None) -> Column:
    """The sort key, always with an explicit place of nulls. column: what stands for the term, if it was projected."""
    c = order.term.build(scope) if column is None else column
    if order.collation:
        c = F.collate(c, COLLATIONS[order.collation.lower()])
    first = order.nulls == "first" if order.nulls else not order.descending
    return {(False, True): c.asc_nulls_first, (False, False): c.asc_nulls_last, (True, True): c.desc_nulls_first, (True, False): c.desc_nulls_last}[order.descending, first]()
