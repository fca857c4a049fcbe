"""Declarative filters: ``{column: {operator: value}}`` and ``{relation: {some | none | every | is_empty | is_not_empty: ...}}``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from tessella.expr import Expr, and_, call, col, eq, gt, gte, in_list, is_null, lt, lte, neq, not_in_list
from tessella.plans.query import Scope, Select
from tessella.plans.relations import related_rows, root_key
from tessella.schema import TableDef


def _text(method: str, c: Expr, value: str, insensitive: bool) -> Expr:
    """Wildcards in the value stand for themselves."""
    return call(f"{method}:{value}:{insensitive}", lambda x: getattr(F, method)(F.lower(x) if insensitive else x, F.lit(value.lower() if insensitive else value)), c)


OPERATORS = {
    "equals": lambda c, v, i: is_null(c) if v is None else eq(c, v),
    "not": lambda c, v, i: call("not_null", lambda x: x.isNotNull(), c) if v is None else neq(c, v),
    "in": lambda c, v, i: in_list(c, v),
    "not_in": lambda c, v, i: not_in_list(c, v),
    "lt": lambda c, v, i: lt(c, v),
    "lte": lambda c, v, i: lte(c, v),
    "gt": lambda c, v, i: gt(c, v),
    "gte": lambda c, v, i: gte(c, v),
    "contains": lambda c, v, i: _text("contains", c, v, i),
    "starts_with": lambda c, v, i: _text("startswith", c, v, i),
    "ends_with": lambda c, v, i: _text("endswith", c, v, i),
}
#: The kinds of columns that an operator is for; none: all.
KINDS = {"lt": ("number", "date"), "lte": ("number", "date"), "gt": ("number", "date"), "gte": ("number", "date"), "contains": ("text",), "starts_with": ("text",), "ends_with": ("text",)}
RELATION_OPERATORS = ("some", "none", "every", "is_empty", "is_not_empty")


def field_condition(name: str, condition: Any) -> Expr:
    """A condition on a column; a plain value means equals. An unknown operator raises, lest it match all rows."""
    if not isinstance(condition, dict):
        return OPERATORS["equals"](col(name), condition, False)
    if unknown := [op for op in condition if op not in OPERATORS and op != "mode"]:
        raise ValueError(f"a filter on {name} has unknown operators {unknown}")
    insensitive = condition.get("mode") == "insensitive"
    return and_(*[OPERATORS[op](col(name), value, insensitive) for op, value in condition.items() if op != "mode"])


def apply_filter(query: Select, where: dict[str, Any]) -> Select:
    """The query with a filter; keys that are neither column nor relation are left out."""
    d = query.definition
    for name, condition in where.items():
        if name in d.relations:
            query = _relation(query, d, query.alias, name, condition)
        elif name in d.columns:
            query = query.where(field_condition(f"{query.alias}.{name}", condition))
    return query


def _matching(query: Select, definition: TableDef, name: str, where: dict[str, Any] | None, test: bool = False):
    """Related rows that meet a filter, nested relation filters included; or all of them with ``__ok``."""
    rows, target = related_rows(query, definition, name)
    where = where or {}
    fields = and_(*[field_condition(f"__child.{c}", v) for c, v in where.items() if c in target.columns])
    rows = rows.alias("__child")
    ok = F.coalesce(fields.build(Scope()), F.lit(False))
    deeper = {c: v for c, v in where.items() if c in target.relations}
    if not test or deeper:
        rows_ok = rows.where(ok)
        for c, v in deeper.items():
            rows_ok = _restrict(query, rows_ok, target, c, v)
        if not test:
            return rows_ok
        kept = rows_ok.select("__rel", target.key).distinct().withColumn("__ok", F.lit(True))
        return rows.join(kept, ["__rel", target.key], "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
    return rows.withColumn("__ok", ok)


def _restrict(query: Select, df, definition: TableDef, name: str, condition: dict[str, Any]):
    """df (with the definition's columns) by a relation filter."""
    if not isinstance(condition, dict) or not any(op in RELATION_OPERATORS for op in condition):
        raise ValueError(f"a filter on the relation {name} needs one of {', '.join(RELATION_OPERATORS)}")
    own = F.col(f"`{root_key(definition, definition.relation(name))}`")
    for op, value in condition.items():
        if op == "every":
            each = _matching(query, definition, name, value, test=True)
            keys = each.groupBy("__rel").agg(F.count(F.lit(1)).alias("__n"), F.count_if("__ok").alias("__m")).where("__n = __m")
        elif op in ("is_empty", "is_not_empty"):
            keys = _matching(query, definition, name, None)
        elif op in ("some", "none"):
            keys = _matching(query, definition, name, value)
        else:
            continue
        anti = op == "none" or op == "is_empty" and value is not False or op == "is_not_empty" and value is False
        keys = keys.select(F.col("__rel").alias("__key"))
        df = df.join(keys, own == F.col("__key"), "left_anti" if anti else "left_semi")
    return df


def _relation(query: Select, definition: TableDef, alias: str, name: str, condition: Any) -> Select:
    if not isinstance(condition, dict) or not any(op in RELATION_OPERATORS for op in condition):
        raise ValueError(f"a filter on the relation {name} needs one of {', '.join(RELATION_OPERATORS)}")
    return query._step(lambda df, s: _restrict(query, df, definition, name, condition))
