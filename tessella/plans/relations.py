"""Relations in plans: keys for semi-joins, and nested rows.

Children are filtered and folded into arrays by their key before they meet their roots, so sibling relations don't
multiply one another, and a limit cuts roots before any child is read.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.expr import Expr
from tessella.plans.query import Include, Scope, Select
from tessella.schema import Relation, TableDef

#: Rows of the largest page whose keys are sent to the tasks that read its children.
SMALL_PAGE = 10_000


def _scope(target: str, definition: TableDef) -> Scope:
    return Scope({target: "__t", definition.name: "__t"})


def related_rows(query: Select, definition: TableDef, name: str, where: Expr | None = None) -> tuple[DataFrame, TableDef]:
    """Rows of a relation as ``__rel`` (what the root's key must equal), ``__piv_*`` (of the pivot) and the target's columns."""
    r = definition.relation(name)
    if r.kind == "morph_to":
        raise ValueError("a polymorphic owner is read by morph_owner")
    target = query.catalog.definition(r.target)
    rows = query._frame_of(r.target).alias("__t")
    if where is not None:
        rows = rows.where(where.build(Scope(_scope(name, target).tables)))
    own = [F.col(f"__t.`{c}`") for c in target.columns]
    if r.pivot:
        pivot = query._frame_of(r.pivot).alias("__p")
        joined = rows.join(pivot, F.col(f"__t.{target.key}") == F.col(f"__p.{r.pivot_target_key}"))
        return joined.select(F.col(f"__p.{r.foreign_key}").alias("__rel"), *[F.col(f"__p.`{c}`").alias(f"__piv_{c}") for c in pivot.columns], *own), target
    if r.type_column:
        rows = rows.where(F.col(f"__t.{r.type_column}") == r.type_value)
    key = r.local_key or target.key if r.kind == "belongs_to" else r.foreign_key
    return rows.select(F.col(f"__t.{key}").alias("__rel"), *own), target


def related_keys(query: Select, name: str, where: Expr | None = None) -> DataFrame:
    """``__rel`` of the related rows (that meet a condition)."""
    return related_rows(query, query.definition, name, where)[0].select("__rel")


def root_key(definition: TableDef, r: Relation) -> str:
    return r.foreign_key if r.kind == "belongs_to" else r.local_key or definition.key


def nested_rows(query: Select, definition: TableDef, i: Include, page: DataFrame | None = None) -> DataFrame:
    """``__rel`` and the nested value of a relation: a struct for one row, else an array in ascending order of the child's key.

    page: the roots, if they are few; then only their children are folded.
    """
    r = definition.relation(i.name)
    rows, target = related_rows(query, definition, i.name, i.where)
    if page is not None:
        keys = page.select(F.col(f"`{root_key(definition, r)}`").alias("__key"))
        rows = rows.join(F.broadcast(keys), F.col("__rel") == F.col("__key"), "left_semi")
    columns = list(i.columns or target.columns)
    if target.key in target.columns and target.key not in columns:
        columns.insert(0, target.key)  # the child's key is always there
    for deeper in i.include:
        rows = _attach(query, rows, target, deeper)
        columns.append(deeper.name)
    fields = [F.col(f"`{c}`") for c in columns]
    if r.pivot and i.pivot:
        fields.append(F.struct(*[F.col(f"__piv_{c}").alias(c) for c in i.pivot]).alias("_pivot"))
    first = [F.col(f"`{target.key}`").alias("__order")] if target.key in target.columns else []
    value = F.struct(*first, *fields)
    kept = F.array_sort(F.collect_list(value), lambda a, b: _by_key(a, b)) if first else F.collect_list(value)
    plain = lambda x: F.struct(*[x[f].alias(f) for f in [*columns, *(["_pivot"] if r.pivot and i.pivot else [])]])
    folded = rows.where(F.col("__rel").isNotNull()).groupBy("__rel").agg(F.transform(F.array_distinct(kept), plain).alias(i.name))
    return folded.select("__rel", F.col(i.name)[0].alias(i.name)) if r.single else folded


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["__order"] < b["__order"], -1).when(a["__order"] > b["__order"], 1).otherwise(0)


def _attach(query: Select, roots: DataFrame, definition: TableDef, i: Include, page: DataFrame | None = None) -> DataFrame:
    """roots with a relation as another column: null, or an empty array, where there is nothing."""
    r = definition.relation(i.name)
    nested = nested_rows(query, definition, i, page)
    joined = roots.join(nested.withColumnRenamed("__rel", f"__rel_{i.name}"), F.col(f"`{root_key(definition, r)}`") == F.col(f"__rel_{i.name}"), "inner" if i.kind == "inner" else "left").drop(f"__rel_{i.name}")
    return joined if r.single else joined.withColumn(i.name, F.coalesce(F.col(f"`{i.name}`"), F.array().cast(nested.schema[i.name].dataType)))


def with_includes(query: Select) -> DataFrame:
    """Roots, paged before their children are read, with each relation as a column; order is kept."""
    bare = replace(query, includes=())
    for i in query.includes:
        if i.kind == "inner":  # roots without such a row don't count for the page
            bare = bare.where_has(i.name, i.where)
    # a page in a full order is the same each time it is read: its keys, at most SMALL_PAGE, pick the children
    ordered = bool(query.orders) and query.limited is not None and query.limited <= SMALL_PAGE and query.definition.key in query.definition.columns
    if ordered:
        bare = bare.order_by(f"{query.alias}.{query.definition.key}")
    names = [n for n, _ in bare._projection()]
    needed = {root_key(query.definition, query.definition.relation(i.name)) for i in query.includes}
    roots = bare.select(*[f"{query.alias}.{n}" for n in dict.fromkeys([*([] if query.items else names), *sorted(needed - set(names))])]).to_df()
    page = roots if ordered else None
    if query.orders:
        roots = roots.withColumn("__at", F.monotonically_increasing_id()) if query.limited is None else _placed(roots)
    for i in query.includes:
        roots = _attach(query, roots, query.definition, i, page)
    if query.orders:
        roots = roots.orderBy("__at")
    return roots.select(*[F.col(f"`{n}`") for n in names], *[F.col(f"`{i.name}`") for i in query.includes])


def _placed(page: DataFrame) -> DataFrame:
    """A page's rows with their place: a page is small, and read by one task anyway."""
    return page.coalesce(1).withColumn("__at", F.monotonically_increasing_id())


def lazy_relation(query: Select, name: str, where: Expr | None = None) -> DataFrame:
    """The related rows of a query's roots, as a DataFrame of its own, without the roots."""
    r = query.definition.relation(name)
    rows, target = related_rows(query, query.definition, name, where)
    key = root_key(query.definition, r)
    roots = replace(query, items=(), includes=()).select(f"{query.alias}.{key}").to_df()
    return rows.join(roots.select(F.col(key).alias("__root")), F.col("__rel") == F.col("__root"), "left_semi").select(F.col("__rel").alias("root_key"), *target.columns)


def morph_owner(query: Select, name: str, columns: list[str]) -> DataFrame:
    """Roots of a query with the owner that a polymorphic relation names: a left join for each kind of owner."""
    r = query.definition.relation(name)
    if r.kind != "morph_to":
        raise ValueError(f"{name} isn't polymorphic")
    out, found = query.to_df(), []
    for kind, target in r.targets:
        t = query.catalog.definition(target)
        owner = query._frame_of(target)
        some = owner.select(F.col(t.key).cast("string").alias(f"__{kind}_key"), F.struct(F.lit(kind).alias("type"), *[F.col(c).cast("string").alias(c) if c in owner.columns else F.lit(None).cast("string").alias(c) for c in columns]).alias(f"__{kind}"))
        out = out.join(some, (F.col(r.type_column) == kind) & (F.col(r.foreign_key).cast("string") == F.col(f"__{kind}_key")), "left").drop(f"__{kind}_key")
        found.append(F.col(f"__{kind}"))
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"__{k}" for k, _ in r.targets])


def select_columns_deep(query: Select, columns: list[str], relations: dict[str, list[str]]) -> Select:
    """Root columns, and columns of relations."""
    out = query.select(*columns)
    for name, some in relations.items():
        out = out.include(name, columns=some)
    return out
