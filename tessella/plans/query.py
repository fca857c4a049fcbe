"""The fluent query: an immutable specification, made into a DataFrame at the end.

Each call returns a new query. The specification is kept, rather than a DataFrame changed step by step, because
paging before joins, counting distinct roots and relation filters need to look into it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.expr import Expr, Order, and_, col, eq, lit, outer_ref, raw, sort_column, to_expr
from tessella.schema import Relation, TableDef
from tessella.sources.catalog import Catalog
from tessella.sources.shared import shared_path, stored


@dataclass(frozen=True)
class Join:
    kind: str
    source: Any
    alias: str
    on: Expr | None


@dataclass(frozen=True)
class Include:
    name: str
    columns: tuple[str, ...] | None = None
    where: Expr | None = None
    kind: str = "left"
    pivot: tuple[str, ...] = ()
    include: tuple[Include, ...] = ()


@dataclass
class Scope:
    """Where names are looked up: aliases of joined tables, and names of the projection."""

    tables: dict[str, str] = field(default_factory=dict)
    projection: dict[str, Column] = field(default_factory=dict)

    def column(self, table: str | None, name: str) -> Column:
        return F.col(f"`{self.tables.get(table, table)}`.`{name}`") if table else F.col(f"`{name}`")

    def projected(self, name: str) -> Column:
        if name not in self.projection:
            raise KeyError(f"nothing is selected as {name!r}")
        return self.projection[name]


@dataclass(frozen=True)
class Select:
    catalog: Catalog
    source: Any
    alias: str
    definition: TableDef | None = None
    joins: tuple[Join, ...] = ()
    items: tuple[tuple[str, Expr], ...] = ()
    conditions: tuple[Expr, ...] = ()
    frame_steps: tuple[Callable[[DataFrame, Scope], DataFrame], ...] = ()
    groups: tuple[Expr, ...] = ()
    havings: tuple[Expr, ...] = ()
    orders: tuple[Order, ...] = ()
    is_distinct: bool = False
    limited: int | None = None
    skipped: int | None = None
    operands: tuple[tuple[str, Select], ...] = ()
    includes: tuple[Include, ...] = ()
    named: tuple[tuple[str, Any], ...] = ()

    # sources -----------------------------------------------------------------------------------------------------

    def as_(self, alias: str) -> Select:
        """Another name for the root table."""
        if self.definition is None:
            raise ValueError("only a table can be renamed")
        return replace(self, alias=alias)

    def with_(self, name: str, query: Select | DataFrame, columns: list[str] | None = None) -> Select:
        """A named query that joins and subqueries may read; it isn't run before it is needed."""
        return replace(self, named=(*self.named, (name, (query, tuple(columns or ())))))

    def with_recursive(self, name: str, anchor: Select | DataFrame, step: Callable[[DataFrame], DataFrame], levels: int = 100) -> Select:
        """A named query of an anchor and what ``step`` makes of each level, until a level is empty."""
        return replace(self, named=(*self.named, (name, (lambda q: recursive(q._frame_of(anchor), step, levels), ()))))

    def _frame_of(self, source: Any) -> DataFrame:
        if isinstance(source, Select):
            return replace(source, named=(*self.named, *source.named)).to_df()
        if isinstance(source, DataFrame):
            return source
        if isinstance(source, TableDef):
            source = source.name
        for name, (query, columns) in reversed(self.named):
            if name == source:
                outer = replace(self, named=tuple(x for x in self.named if x[0] != name))
                frame = query(outer) if callable(query) and not isinstance(query, (Select, DataFrame)) else outer._frame_of(query)
                return frame.toDF(*columns) if columns else frame
        return self.catalog.frame(source)

    # projection --------------------------------------------------------------------------------------------------

    def select(self, *names: str | Expr, **named: Any) -> Select:
        """Columns by name, and expressions by keyword; of one name the first counts."""
        items = dict(self.items)
        for n in names:
            e = n if isinstance(n, Expr) else col(n if "." in n else f"{self.alias}.{n}")
            items.setdefault(e.name or e.key, e)
        for n, e in named.items():
            items.setdefault(n, to_expr(e))
        return replace(self, items=tuple(items.items()))

    def select_raw(self, **texts: str) -> Select:
        """Spark SQL text by name; for trusted text only."""
        return self.select(**{n: raw(t) for n, t in texts.items()})

    def select_subquery(self, name: str, query: Select) -> Select:
        return self.select(**{name: scalar(query)})

    def distinct(self, *columns: str | Expr) -> Select:
        """Rows that are selected, each once. Columns may be named; they don't narrow what is compared: that is all that is selected."""
        return replace(self if self.items or not columns else self.select(*columns), is_distinct=True)

    # filters -----------------------------------------------------------------------------------------------------

    def where(self, *conditions: Expr) -> Select:
        return replace(self, conditions=(*self.conditions, *conditions))

    def _step(self, step: Callable[[DataFrame, Scope], DataFrame]) -> Select:
        return replace(self, frame_steps=(*self.frame_steps, step))

    def where_in(self, column: str, query: Select, negated: bool = False) -> Select:
        """IN a subquery. NOT IN is null-aware: nothing passes where the subquery has a null."""

        def step(df: DataFrame, s: Scope) -> DataFrame:
            sub = self._frame_of(query)
            sub = sub.select(F.col(f"`{sub.columns[0]}`").alias("__in"))
            own = col(column if "." in column else f"{self.alias}.{column}").build(s)
            if not negated:
                return df.join(sub, own == F.col("__in"), "left_semi")
            return df.join(sub, (own == F.col("__in")) | (own == F.col("__in")).isNull(), "left_anti")

        return self._step(step)

    def where_exists(self, query: Select, on: Expr | None = None, negated: bool = False) -> Select:
        """EXISTS, correlated by a condition on tables of both queries."""
        kind = "left_anti" if negated else "left_semi"

        def step(df: DataFrame, s: Scope) -> DataFrame:
            inner = replace(query, named=(*self.named, *query.named))
            sub, own = inner._joined()
            return df.join(inner._filtered(sub, own), on.build(Scope(s.tables | own.tables)) if on is not None else F.lit(True), kind)

        return self._step(step)

    def where_not_exists(self, query: Select, on: Expr | None = None) -> Select:
        return self.where_exists(query, on, True)

    def where_has(self, relation: str, where: Expr | None = None, negated: bool = False) -> Select:
        """Roots with a related row (that meets a condition): a semi-join, or an anti-join if negated."""
        from tessella.plans.relations import related_keys

        root_key = self._root_key(relation)

        def step(df: DataFrame, s: Scope) -> DataFrame:
            keys = related_keys(self, relation, where)
            return df.join(keys, col(f"{self.alias}.{root_key}").build(s) == F.col("__rel"), "left_anti" if negated else "left_semi")

        return self._step(step)

    def where_has_not(self, relation: str, where: Expr | None = None) -> Select:
        return self.where_has(relation, where, True)

    def _root_key(self, relation: str) -> str:
        r = self.definition.relation(relation)
        return r.foreign_key if r.kind == "belongs_to" else r.local_key or self.definition.key

    # joins -------------------------------------------------------------------------------------------------------

    def join(self, source: Any, on: Expr | None = None, kind: str = "inner", alias: str | None = None) -> Select:
        if kind not in ("inner", "left", "right", "cross"):
            raise ValueError(f"unknown join {kind!r}")
        name = alias or (source.name if isinstance(source, TableDef) else source if isinstance(source, str) else None)
        if name is None:
            raise ValueError("a derived table needs an alias")
        return replace(self, joins=(*self.joins, Join(kind, source, self._free(name) if alias is None else name, on)))

    def _free(self, name: str) -> str:
        taken, n = {self.alias, *(j.alias for j in self.joins)}, 2
        if name not in taken:
            return name
        while f"{name}_{n}" in taken:
            n += 1
        return f"{name}_{n}"

    def inner_join(self, source: Any, on: Expr, alias: str | None = None) -> Select:
        return self.join(source, on, "inner", alias)

    def left_join(self, source: Any, on: Expr, alias: str | None = None) -> Select:
        return self.join(source, on, "left", alias)

    def right_join(self, source: Any, on: Expr, alias: str | None = None) -> Select:
        return self.join(source, on, "right", alias)

    def cross_join(self, source: Any, on: Expr | None = None, alias: str | None = None) -> Select:
        """With a condition, an inner join."""
        return self.join(source, on, "cross" if on is None else "inner", alias)

    def lateral(self, explode: Callable[[Scope], Column], alias: str, columns: tuple[str, ...] = ("value",), ordinality: bool = False) -> Select:
        """Rows of an array column for each row: a table function. ordinality: counted from 1, as last column."""

        def step(df: DataFrame, s: Scope) -> DataFrame:
            own = explode(s)
            made = df.select("*", F.posexplode(own).alias("__pos", columns[0])).withColumn(columns[-1], F.col("__pos") + 1).drop("__pos") if ordinality else df.select("*", F.explode(own).alias(columns[0]))
            return made

        return self._step(step)

    def join_function(self, name: str, *arguments: Any, alias: str, columns: tuple[str, ...] = (), kind: str = "inner", on: Expr | None = None) -> Select:
        """Rows of a table-valued function of Spark for each row, whose columns are its arguments: a lateral join. kind: inner or left."""
        if kind not in ("inner", "left"):
            raise ValueError("a lateral join is inner or left")

        def step(df: DataFrame, s: Scope) -> DataFrame:
            made = getattr(self.catalog.spark.tvf, name)(*[to_expr(a).build(s).outer() for a in arguments])
            s.tables.setdefault(alias, alias)
            right = (made.toDF(*columns) if columns else made).alias(alias)
            return df.lateralJoin(right, on.build(s) if on is not None else F.lit(True), kind)

        return self._step(step)

    def nearest(self, column: str, vector: list[float], k: int, metric: str = "l2") -> Select:
        """The k rows whose vectors are nearest, nearest first, ties by the primary key."""
        from tessella.functions.vectors import vector_match

        return vector_match(self, column, vector, k, metric)

    def cached(self, cache: Any, key: str, ttl: str | float | None = None, tags: tuple[str, ...] = (), auto_invalidate: bool = True) -> DataFrame:
        """What a cache keeps under the key, else this query's rows, kept from now on; auto_invalidate: until one of its tables is written."""
        own = self.tables() if auto_invalidate else ()
        return cache.get(key, self.to_df, ttl, (*tags, *own))

    def tables(self) -> tuple[str, ...]:
        """Names of the tables that the query reads."""
        out: dict[str, None] = {}
        for source in (self.source, *[j.source for j in self.joins], *[o for _, o in self.operands]):
            if isinstance(source, Select):
                out |= dict.fromkeys(source.tables())
            elif not isinstance(source, DataFrame):
                out[source.name if isinstance(source, TableDef) else source] = None
        pending = [(self.definition, i) for i in self.includes]
        while pending:
            definition, i = pending.pop()
            r = definition.relation(i.name)
            out |= dict.fromkeys(x for x in (r.target, r.pivot) if x)
            pending += [(self.catalog.definition(r.target), x) for x in i.include]
        return tuple(out)

    def unnest(self, array: str, alias: str, column: str = "value", ordinality: str | None = None) -> Select:
        return self.lateral(lambda s: col(array).build(s), alias, (column, ordinality) if ordinality else (column,), ordinality is not None)

    def join_relation(self, name: str, kind: str = "inner", extra: Expr | None = None) -> Select:
        """Join by a relation; the target is known by the relation's name."""
        r = self.definition.relation(name)
        if r.kind == "morph_to":
            raise ValueError("a polymorphic owner has no single table to join")
        target, key, out = self.catalog.definition(r.target), self._root_key(name), self
        if r.pivot:
            out = out.join(r.pivot, eq(col(f"{self.alias}.{key}"), col(f"{name}_pivot.{r.foreign_key}")), kind, f"{name}_pivot")
            on = eq(col(f"{name}_pivot.{r.pivot_target_key}"), col(f"{name}.{target.key}"))
        elif r.kind == "belongs_to":
            on = eq(col(f"{self.alias}.{r.foreign_key}"), col(f"{name}.{r.local_key or target.key}"))
        else:
            on = eq(col(f"{name}.{r.foreign_key}"), col(f"{self.alias}.{key}"))
            if r.type_column:
                on = and_(on, eq(col(f"{name}.{r.type_column}"), lit(r.type_value)))
        return out.join(r.target, and_(on, extra) if extra is not None else on, kind, name)

    def match(self, relation: str, where: Expr | None = None) -> Select:
        """Roots with a related row, each once."""
        return self.where_has(relation, where)

    def include(self, name: str, columns: list[str] | None = None, where: Expr | None = None, kind: str = "left", pivot: tuple[str, ...] = (), include: list[Include] | None = None) -> Select:
        """Related rows as a nested column; ``where`` narrows them, not the roots, unless kind is inner."""
        self.definition.relation(name)
        kept = tuple(i for i in self.includes if i.name != name)  # a later call for a relation replaces the earlier
        return replace(self, includes=(*kept, Include(name, tuple(columns) if columns else None, where, kind, tuple(pivot), tuple(include or ()))))

    # aggregation, order, limits ----------------------------------------------------------------------------------

    def group_by(self, *terms: str | Expr) -> Select:
        return replace(self, groups=(*self.groups, *[t if isinstance(t, Expr) else col(t) for t in terms]))

    def having(self, condition: Expr) -> Select:
        return replace(self, havings=(*self.havings, condition))

    def order_by(self, *terms: str | Expr | Order) -> Select:
        return replace(self, orders=(*self.orders, *[t if isinstance(t, Order) else Order(t if isinstance(t, Expr) else col(t)) for t in terms]))

    def limit(self, n: int) -> Select:
        return replace(self, limited=n)

    def offset(self, n: int) -> Select:
        return replace(self, skipped=n)

    # set operations ----------------------------------------------------------------------------------------------

    def _operand(self, kind: str, other: Select) -> Select:
        if other.orders or other.limited is not None or other.skipped is not None:
            raise ValueError("an operand of a set operation can't be ordered or limited")
        return replace(self, operands=(*self.operands, (kind, other)))

    def union(self, other: Select) -> Select:
        return self._operand("union", other)

    def union_all(self, other: Select) -> Select:
        return self._operand("union_all", other)

    def intersect(self, other: Select) -> Select:
        return self._operand("intersect", other)

    def except_(self, other: Select) -> Select:
        return self._operand("except", other)

    # to DataFrames -----------------------------------------------------------------------------------------------

    def _joined(self) -> tuple[DataFrame, Scope]:
        df, scope = self._frame_of(self.source).alias(self.alias), Scope({self.alias: self.alias})
        if self.definition is not None:
            scope.tables.setdefault(self.definition.name, self.alias)
        for j in self.joins:
            scope.tables[j.alias] = j.alias
            right = self._frame_of(j.source).alias(j.alias)
            df = df.crossJoin(right) if j.on is None else df.join(right, j.on.build(scope), j.kind)
        return df, scope

    def _filtered(self, df: DataFrame, scope: Scope) -> DataFrame:
        for c in self.conditions:
            df = df.where(c.build(scope))
        for step in self.frame_steps:
            df = step(df, scope)
        return df

    def _projection(self) -> tuple[tuple[str, Expr], ...]:
        if self.items:
            return self.items
        if self.definition is not None and not self.joins:
            return tuple((n, col(f"{self.alias}.{n}")) for n in self.definition.columns)
        return ()

    def to_df(self) -> DataFrame:
        """The DataFrame; nothing is run, but for recursive queries."""
        if self.includes:
            from tessella.plans.relations import with_includes

            return with_includes(self)
        df, scope = self._joined()
        df = self._filtered(df, scope)
        items = self._projection()
        hidden = [f"__o{i}" for i in range(len(self.orders))]
        names = [n for n, _ in items]
        grouped = bool(self.groups or self.havings or any(e.aggregate for _, e in items))
        if grouped:
            df = self._aggregated(df, scope, items)
        elif items:
            made = {n: e.build(scope) for n, e in items}
            scope.projection = made
            if self.is_distinct and any(not (o.term.key.startswith("alias(") or any(o.term.key == e.key for _, e in items)) for o in self.orders):
                raise ValueError("with distinct, only what is selected can order")
            keys = [] if self.operands or self.is_distinct else [o.term.build(scope).alias(h) for o, h in zip(self.orders, hidden, strict=True)]
            df = df.select(*[c.alias(n) for n, c in made.items()], *keys)
        else:
            names = df.columns
        for kind, other in self.operands:
            right = replace(other, named=(*self.named, *other.named)).to_df()
            left = df if not self.is_distinct else df.distinct()
            df = {"union_all": lambda a, b: a.union(b), "union": lambda a, b: a.union(b).distinct(), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}[kind](left, right)
        if self.is_distinct and not self.operands:
            df = df.select(*[F.col(f"`{n}`") for n in names]).distinct()
        if self.orders:
            by = []
            for o, h in zip(self.orders, hidden, strict=True):
                same = next((n for n, e in items if e.key == o.term.key), None)
                own = o.term.key[6:-1] if o.term.key.startswith("alias(") else same or o.term.name
                by.append(sort_column(o, scope, F.col(h) if h in df.columns else F.col(f"`{own}`")) if items else sort_column(o, scope))
            df = df.orderBy(*by)
        if self.skipped:
            df = df.offset(self.skipped)
        if self.limited is not None:
            df = df.limit(self.limited)
        return df.select(*[F.col(f"`{n}`") for n in names]) if items else df

    def _aggregated(self, df: DataFrame, scope: Scope, items: tuple[tuple[str, Expr], ...]) -> DataFrame:
        """Groups; what is selected, but neither grouped nor aggregated, takes any value of its group."""
        by_alias = {n: e for n, e in items}
        groups = [by_alias[g.key[6:-1]] if g.key.startswith("alias(") else g for g in self.groups]
        keys = {g.key: f"__g{i}" for i, g in enumerate(groups)}
        pre = df.select("*", *[g.build(scope).alias(f"__g{i}") for i, g in enumerate(groups)]) if groups else df
        value = lambda e: F.col(keys[e.key]) if e.key in keys else e.build(scope) if e.aggregate or e.window or not e.tables and e.name is None else F.any_value(e.build(scope))
        made = {n: value(e) for n, e in items}
        scope.projection = made
        extra = [h.build(scope).alias(f"__h{i}") for i, h in enumerate(self.havings)]
        keys_of = [] if self.operands else [(scope.projected(o.term.key[6:-1]) if o.term.key.startswith("alias(") else value(o.term)).alias(f"__o{i}") for i, o in enumerate(self.orders)]
        values = [*[c.alias(n) for n, c in made.items()], *extra, *keys_of]
        # without groups a selection of aggregates is one row too, and may still refer to a query around it
        out = pre.groupBy(*[F.col(k) for k in keys.values()]).agg(*values) if keys or not any(x.aggregate for _, x in items) else pre.select(*values)
        for i in range(len(self.havings)):
            out = out.where(F.col(f"__h{i}"))
        return out.select(*[F.col(f"`{n}`") for n in made], *[F.col(f"__o{i}") for i in range(len(self.orders)) if not self.operands])

    # results -----------------------------------------------------------------------------------------------------

    def pluck(self, name: str) -> list[Any]:
        """One column as a list."""
        return [r[0] for r in replace(self, items=()).select(name).to_df().collect()]

    def rows(self) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.to_df().collect()]

    def first_or_fail(self) -> dict[str, Any]:
        found = self.limit(1).rows()
        if not found:
            raise LookupError("no row")
        return found[0]

    def count_frame(self) -> DataFrame:
        """Distinct roots, by primary key, without order and limit; rows, where the query is grouped or a set operation."""
        bare = replace(self, orders=(), limited=None, skipped=None, includes=())
        if self.definition is None or self.groups or self.havings or self.operands or self.is_distinct or any(e.aggregate for _, e in self.items):
            return bare.to_df().agg(F.count(F.lit(1)).alias("n"))
        for i in self.includes:
            if i.kind == "inner":
                bare = bare.where_has(i.name, i.where)
        df, scope = bare._joined()
        key = col(f"{self.alias}.{self.definition.key}").build(scope)
        return bare._filtered(df, scope).agg(F.count_distinct(key).alias("n"))

    def count(self) -> int:
        return self.count_frame().first()[0]

    def count_rows(self) -> int:
        """Rows, joined ones too."""
        bare = replace(self, orders=(), limited=None, skipped=None, includes=())
        for i in self.includes:
            bare = bare.join_relation(i.name, i.kind, i.where)
        return bare.to_df().count()


def select_from(catalog: Catalog, source: TableDef | str) -> Select:
    name = source.name if isinstance(source, TableDef) else source
    if isinstance(source, TableDef):
        catalog.definitions.setdefault(name, source)
    return Select(catalog, name, name, source if isinstance(source, TableDef) else catalog.definition(name))


def from_subquery(catalog: Catalog, query: Select | DataFrame, alias: str, columns: list[str] | None = None) -> Select:
    """A derived table."""
    if not alias:
        raise ValueError("a derived table needs an alias")
    frame = query.to_df() if isinstance(query, Select) else query
    return Select(catalog, frame.toDF(*columns) if columns else frame, alias)


def from_named(catalog: Catalog, name: str) -> Select:
    """A query on a named query of ``with_``."""
    return Select(catalog, name, name)


def from_range(catalog: Catalog, start: int, stop: int, step: int = 1, alias: str = "series", column: str = "value") -> Select:
    """Whole numbers from start to stop, both included."""
    return Select(catalog, catalog.spark.range(start, stop + (1 if step > 0 else -1), step).toDF(column), alias)


def from_function(catalog: Catalog, name: str, *arguments: Column, alias: str = "f", columns: list[str] | None = None) -> Select:
    """A table-valued function of Spark by name, such as explode, json_tuple or stack."""
    frame = getattr(catalog.spark.tvf, name)(*arguments)
    return Select(catalog, frame.toDF(*columns) if columns else frame, alias)


def scalar(query: Select) -> Expr:
    """The one value of a subquery; it may depend on the row of the outer query, by ``outer_ref``."""

    def build(s: Scope) -> Column:
        return query.to_df().scalar()

    steps = f",{id(query.frame_steps)}" if query.frame_steps else ""
    said = [e.key for _, e in query.items] + [e.key for e in (*query.conditions, *query.groups, *query.havings)] + [f"{j.kind} {j.alias} {j.on.key if j.on is not None else ''}" for j in query.joins]
    return Expr(build, frozenset(), f"scalar({query.alias}:{';'.join(said)}:{query.limited},{query.skipped},{query.is_distinct}{steps})", name="scalar")


def recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], levels: int = 100) -> DataFrame:
    """The anchor's rows and those that ``step`` makes of each level, until one is empty; more levels than allowed raise.

    Each level is written to the shared folder and read back, so no plan grows with their number; all are read as one table.
    """
    spark = anchor.sparkSession
    path = shared_path(spark, "levels")
    level = stored(anchor, "levels", f"{path}/level=0")
    for n in range(1, levels + 1):
        if level.isEmpty():
            return spark.read.schema(anchor.schema).option("recursiveFileLookup", "true").parquet(path)
        level = stored(step(level).select(*[F.col(f"`{c}`").cast(f.dataType).alias(c) for c, f in zip(level.columns, anchor.schema, strict=True)]), "levels", f"{path}/level={n}")
    if level.isEmpty():
        return spark.read.schema(anchor.schema).option("recursiveFileLookup", "true").parquet(path)
    raise RecursionError(f"not done after {levels} levels")


__all__ = ["Include", "Join", "Relation", "Scope", "Select", "from_function", "from_named", "from_range", "from_subquery", "outer_ref", "recursive", "scalar", "select_from"]
