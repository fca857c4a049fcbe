"""Nested-set trees: each node spans the numbers lft to rght, its descendants lie between.

Queries are range conditions; questions about all nodes at once are answered by window functions over (scope, lft),
not by comparing nodes with nodes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.schema import TableDef, belongs_to, has_many
from tessella.sources.shared import shared_path, stored

#: Bounds that one task takes when a running value is computed.
BIN = 1 << 16


@dataclass(frozen=True)
class Tree:
    """The columns of a tree; scope: columns that part independent trees."""

    key: str = "id"
    parent: str = "parentId"
    left: str = "lft"
    right: str = "rght"
    depth: str | None = None
    scope: tuple[str, ...] = ()

    # declarations

    def declare(self, t: TableDef, parent: str = "parent", children: str = "children") -> TableDef:
        """A table as a tree: it knows its columns, and has the relations to a node's parent and children."""
        if missing := [c for c in (self.key, self.parent, self.left, self.right, *([self.depth] if self.depth else []), *self.scope) if c not in t.columns]:
            raise ValueError(f"{t.name} lacks the tree's columns {missing}")
        own = {parent: belongs_to(t.name, self.parent), children: has_many(t.name, self.parent)}
        return replace(t, tree=self, relations=t.relations | own)

    def entity(self, cls: type) -> type:
        """A decorator of dataclasses: their table is declared as this tree."""
        cls.__tree__ = staticmethod(self.declare)
        return cls

    # queries

    def within(self, df: DataFrame, **scope: Any) -> DataFrame:
        for c, v in scope.items():
            df = df.where(F.col(c).eqNullSafe(F.lit(v)))
        return df

    def ancestors(self, df: DataFrame, bounds: tuple[int, int], include_self: bool = True) -> DataFrame:
        a, b = bounds
        on = (F.col(self.left) <= a) & (F.col(self.right) >= b) if include_self else (F.col(self.left) < a) & (F.col(self.right) > b)
        return df.where(on).orderBy(self.left)

    def descendants(self, df: DataFrame, bounds: tuple[int, int]) -> DataFrame:
        return df.where((F.col(self.left) > bounds[0]) & (F.col(self.right) < bounds[1])).orderBy(self.left)

    def subtree(self, df: DataFrame, bounds: tuple[int, int]) -> DataFrame:
        return df.where((F.col(self.left) >= bounds[0]) & (F.col(self.right) <= bounds[1])).orderBy(self.left)

    def children(self, df: DataFrame, key: Any) -> DataFrame:
        return df.where(F.col(self.parent) == key).orderBy(self.left)

    def by_key(self, df: DataFrame, key: Any) -> DataFrame:
        return df.where(F.col(self.key) == key)

    def siblings(self, df: DataFrame, parent: Any, exclude: Any = None) -> DataFrame:
        """Roots are siblings too."""
        out = df.where(F.col(self.parent).eqNullSafe(F.lit(parent)))
        return (out if exclude is None else out.where(F.col(self.key) != exclude)).orderBy(self.left)

    def roots(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.parent).isNull()).orderBy(self.left)

    def leaves(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.right) - F.col(self.left) == 1).orderBy(self.left)

    def at_depth(self, df: DataFrame, n: int) -> DataFrame:
        if self.depth is None:
            raise ValueError("the tree has no depth column")
        return df.where(F.col(self.depth) == n).orderBy(self.left)

    def descendant_count(self) -> Column:
        return ((F.col(self.right) - F.col(self.left) - 1) / 2).cast("long")

    # all nodes at once

    def _events(self, df: DataFrame) -> DataFrame:
        """A row for each bound: +1 at lft, -1 at rght."""
        return df.select("*", F.explode(F.array(F.struct(F.col(self.left).alias("at"), F.lit(1).alias("step")), F.struct(F.col(self.right).alias("at"), F.lit(-1).alias("step")))).alias("__e"))

    def _before(self, df: DataFrame, at: str, value: str, fold, last: int, ties: tuple = ()) -> DataFrame:
        """df with ``__within`` and ``__start``: value folded over the rows of a tree up to one (``last`` 0), or before it (-1),
        by ``at`` and ``ties``: within the row's bin, and over the bins before.

        Bounds are dense whole numbers: they are dealt into bins of ``BIN``, folded within, and each bin takes on what
        the bins before it come to. No task has more than a bin, however large the tree.
        """
        binned = df.withColumn("__bin", F.floor(F.col(at) / BIN))
        here = Window.partitionBy(*self.scope, "__bin").orderBy(at, *ties)
        ahead = Window.partitionBy(*self.scope).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        totals = binned.groupBy(*self.scope, "__bin").agg(fold(value).alias("__t"))
        starts = totals.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(self.scope)], F.col("__bin").alias("__b"), fold("__t").over(ahead).alias("__start"))
        on = F.col("__bin") == F.col("__b")
        for i, c in enumerate(self.scope):
            on = on & F.col(c).eqNullSafe(F.col(f"__s{i}"))
        within = binned.withColumn("__within", fold(value).over(here.rowsBetween(Window.unboundedPreceding, last)))
        joined = within.join(starts, on, "left").drop("__b", "__bin", *[f"__s{i}" for i in range(len(self.scope))])
        return joined

    def with_depth(self, df: DataFrame, name: str = "depth") -> DataFrame:
        """Ancestors of each node: a running sum over the bounds."""
        events = self._events(df.drop(name) if name in df.columns else df)
        events = events.withColumns({"__at": F.col("__e.at"), "__step": F.col("__e.step")})
        summed = self._before(events, "__at", "__step", F.sum, 0).where("__step = 1")
        return summed.withColumn(name, (F.col("__within") + F.coalesce("__start", F.lit(0)) - 1).cast("int")).drop("__e", "__at", "__step", "__within", "__start")

    def listed(self, df: DataFrame, label: str, spacer: str = "__") -> DataFrame:
        """key and label in order, the label indented by depth."""
        deep = self.with_depth(df, "__depth")
        return deep.select(self.key, self.left, F.concat(F.repeat(F.lit(spacer), F.col("__depth")), F.col(label)).alias("label")).orderBy(self.left).select(self.key, "label")

    def validate(self, df: DataFrame) -> DataFrame:
        """key and problem of nodes that are at fault: bounds out of order, below 1, shared, or crossing another node's.

        Inside of a node that crosses none, every node that opens closes too: a sum over the bounds of hashes of their nodes,
        added at lft and taken off at rght, is the same at its two ends. So each crossing node is found, by running sums.
        """
        left, right = F.col(self.left), F.col(self.right)
        bad = df.select(self.key, F.when(left >= right, "lft must be below rght").when(left < 1, "lft must be 1 or more").alias("problem")).where("problem IS NOT NULL")
        events = self._events(df.where(left < right)).select(*self.scope, self.key, "__e.at", "__e.step", (left + right - F.col("__e.at")).alias("other"))
        same = events.groupBy(*self.scope, "at").agg(F.count(F.lit(1)).alias("__same"), F.collect_set(self.key).alias("__keys")).where("__same > 1")
        shared = same.select(F.explode("__keys").alias(self.key), F.lit("a bound is shared").alias("problem")).distinct()
        own = F.xxhash64(self.key).cast("decimal(38,0)")
        steps = events.withColumns({"__at": F.col("at"), "__step": F.col("step") * own, "__own": own})
        # where bounds are shared, what closes comes before what opens, and of both the narrower inside
        summed = self._before(steps, "__at", "__step", F.sum, 0, (F.col("step"), F.desc("other"))).withColumn("__sum", F.col("__within") + F.coalesce("__start", F.lit(0)))
        ends = summed.groupBy(*self.scope, self.key).agg(F.max(F.when(F.col("step") == 1, F.col("__sum") - F.col("__own"))).alias("__open"), F.max(F.when(F.col("step") == -1, F.col("__sum"))).alias("__close"))
        crossing = ends.where("__close != __open").select(self.key, F.lit("crosses another node").alias("problem"))
        return bad.union(shared).union(crossing)

    def recover(self, df: DataFrame, order: str | None = None, levels: int = 100) -> DataFrame:
        """lft, rght (and depth) anew from the parents, children by ``order`` (key, if none); unreachable nodes keep theirs.

        Levels are found from the roots down, the nodes below each node counted from the deepest level up, and bounds given
        from the roots down: from the parent's lft and the sizes of earlier siblings. Each step joins one level with the next,
        and is written to the shared folder: what is computed grows with the nodes, not with nodes times depth. Nothing sorts
        the whole tree, but the children of one node are ordered by one task. Keys must be unique, scope columns not null.
        """
        by, spark = order or self.key, df.sparkSession
        nodes = stored(df.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(self.scope)], F.col(self.key).alias("__k"), F.col(self.parent).alias("__p"), F.col(by).alias("__by")), "nodes")
        scope = [f"__s{i}" for i in range(len(self.scope))]
        upper = lambda d, *more: d.select(*scope, F.col("__k").alias("__p"), *more)
        found = [stored(nodes.where("__p IS NULL"), "level")]
        while len(found) <= levels:
            level = stored(nodes.join(upper(found[-1]), [*scope, "__p"]).select(*nodes.columns), "level")
            if level.isEmpty():
                break
            found.append(level)
        else:
            raise RecursionError(f"the tree is deeper than {levels} levels")
        sized = [stored(found[-1].withColumn("__n", F.lit(1).cast("long")), "sizes")]
        for level in reversed(found[:-1]):
            below = sized[-1].groupBy(*scope, F.col("__p").alias("__k")).agg(F.sum("__n").alias("__below"))
            sized.append(stored(level.join(below, [*scope, "__k"], "left").select(*nodes.columns, (F.coalesce("__below", F.lit(0)) + 1).alias("__n")), "sizes"))
        path, above = shared_path(spark, "bounds"), None
        beside = Window.partitionBy(*scope, "__p").orderBy(F.col("__by").asc_nulls_first(), "__k").rowsBetween(Window.unboundedPreceding, -1)
        for depth, level in enumerate(reversed(sized)):
            earlier = level.withColumn("__e", F.coalesce(F.sum("__n").over(beside), F.lit(0)))
            placed = earlier.withColumn("__l", 2 * F.col("__e") + 1) if above is None else earlier.join(upper(above, F.col("__l").alias("__up")), [*scope, "__p"]).withColumn("__l", F.col("__up") + 2 * F.col("__e") + 1)
            above = stored(placed.select(*scope, "__k", "__l", (F.col("__l") + 2 * F.col("__n") - 1).alias("__r"), F.lit(depth).alias("__d")), "bounds", f"{path}/level={depth}")
        new = spark.read.schema(above.schema).option("recursiveFileLookup", "true").parquet(path).select(F.col("__k").alias(self.key), "__l", "__r", "__d")
        values = {self.left: F.coalesce("__l", self.left), self.right: F.coalesce("__r", self.right)} | ({self.depth: F.coalesce("__d", self.depth)} if self.depth else {})
        kinds = {f.name: f.dataType for f in df.schema}
        return df.join(new, self.key, "left").select(*[values[c].cast(kinds[c]).alias(c) if c in values else F.col(c) for c in df.columns])

    def threaded(self, df: DataFrame) -> list[dict[str, Any]]:
        """Nested dictionaries with ``children``; the tree comes to the driver."""
        roots: list[dict[str, Any]] = []
        open_: list[dict[str, Any]] = []
        for r in df.orderBy(*self.scope, self.left).collect():
            node = r.asDict() | {"children": []}
            while open_ and (open_[-1][self.right] < node[self.left] or any(open_[-1][s] != node[s] for s in self.scope)):
                open_.pop()
            (open_[-1]["children"] if open_ else roots).append(node)
            open_.append(node)
        return roots

    # changes: each gives the new table; scope: values of the scope columns

    def _own(self, scope: dict[str, Any]) -> Column:
        out = F.lit(True)
        for c, v in scope.items():
            out = out & F.col(c).eqNullSafe(F.lit(v))
        return out

    def _set(self, df: DataFrame, left: Column, right: Column, **more: Column) -> DataFrame:
        values = {self.left: left, self.right: right} | more
        return df.select(*[values[c].cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])

    def _node(self, df: DataFrame, key: Any) -> dict[str, Any]:
        row = self.by_key(df, key).first()
        if row is None:
            raise LookupError(f"no node {key!r}")
        return row.asDict()

    def _end(self, df: DataFrame, scope: dict[str, Any]) -> int:
        return df.where(self._own(scope)).agg(F.coalesce(F.max(self.right), F.lit(0))).first()[0]

    def insert(self, df: DataFrame, row: dict[str, Any], parent: Any = None) -> DataFrame:
        """As the last child of a parent, or the last root."""
        scope = {c: row[c] for c in self.scope}
        depth = 0
        if parent is None:
            at = self._end(df, scope) + 1
        else:
            up = self._node(df, parent)
            at = up[self.right]
            depth = (up[self.depth] or 0) + 1 if self.depth else 0
            own, moved = self._own(scope), lambda c: F.col(c) >= at
            df = self._set(df, F.when(own & moved(self.left), F.col(self.left) + 2).otherwise(F.col(self.left)), F.when(own & moved(self.right), F.col(self.right) + 2).otherwise(F.col(self.right)))
        full = row | {self.parent: parent, self.left: at, self.right: at + 1} | ({self.depth: depth} if self.depth else {})
        return df.union(df.sparkSession.createDataFrame([tuple(full.get(c) for c in df.columns)], df.schema))

    def move(self, df: DataFrame, key: Any, parent: Any = None) -> DataFrame:
        """A node with all below it becomes the last child of a parent, or the last root."""
        n = self._node(df, key)
        a, b, scope = n[self.left], n[self.right], {c: n[c] for c in self.scope}
        width, left, right, own = b - a + 1, F.col(self.left), F.col(self.right), self._own(scope)
        up = self._node(df, parent) if parent is not None else None
        if up and a <= up[self.left] <= b:
            raise ValueError("a node can't move below itself")
        to = up[self.right] if up else self._end(df, scope) + 1
        inside = own & (left >= a) & (right <= b)
        shift = to - width - a if to > b else to - a

        def bound(c: Column) -> Column:
            closed = F.when(c > b, c - width).otherwise(c)  # as if the subtree weren't there
            gap = to - width if to > b else to
            return F.when(inside, c + shift).when(own, F.when(closed >= gap, closed + width).otherwise(closed)).otherwise(c)

        more: dict[str, Column] = {self.parent: F.when(F.col(self.key) == key, F.lit(parent)).otherwise(F.col(self.parent))}
        if self.depth:
            more[self.depth] = F.when(inside, F.col(self.depth) + ((up[self.depth] + 1 if up else 0) - n[self.depth])).otherwise(F.col(self.depth))
        return self._set(df, bound(left), bound(right), **more)

    def move_up(self, df: DataFrame, key: Any, down: bool = False) -> DataFrame:
        """Change places with the sibling before (after, if down); the first stays."""
        n = self._node(df, key)
        beside = F.col(self.left) == n[self.right] + 1 if down else F.col(self.right) == n[self.left] - 1
        scope = self._own({c: n[c] for c in self.scope})
        other = df.where(scope & beside & F.col(self.parent).eqNullSafe(F.lit(n[self.parent]))).first()
        if other is None:
            return df
        first, second = (n, other.asDict()) if down else (other.asDict(), n)
        wide = lambda x: x[self.right] - x[self.left] + 1
        left, right = F.col(self.left), F.col(self.right)
        one = scope & left.between(first[self.left], first[self.right])
        two = scope & left.between(second[self.left], second[self.right])
        bound = lambda c: F.when(one, c + wide(second)).when(two, c - wide(first)).otherwise(c)
        return self._set(df, bound(left), bound(right))

    def remove(self, df: DataFrame, key: Any) -> DataFrame:
        """The node's children take its place below its parent; the node itself becomes the last root."""
        n = self._node(df, key)
        a, b, scope = n[self.left], n[self.right], {c: n[c] for c in self.scope}
        own, end = self._own(scope), self._end(df, scope)
        me, inside = F.col(self.key) == key, own & (F.col(self.left) > a) & (F.col(self.right) < b)
        bound = lambda c: F.when(inside, c - 1).when(own & (c > b), c - 2).otherwise(c)
        more: dict[str, Column] = {self.parent: F.when(me, F.lit(None)).when(F.col(self.parent) == key, F.lit(n[self.parent])).otherwise(F.col(self.parent))}
        if self.depth:
            more[self.depth] = F.when(me, F.lit(0)).when(inside, F.col(self.depth) - 1).otherwise(F.col(self.depth))
        return self._set(df, F.when(me, F.lit(end - 1)).otherwise(bound(F.col(self.left))), F.when(me, F.lit(end)).otherwise(bound(F.col(self.right))), **more)

    def delete(self, df: DataFrame, key: Any) -> tuple[DataFrame, int]:
        """Without the node and all below it, and how many those are."""
        n = self._node(df, key)
        a, b, scope = n[self.left], n[self.right], {c: n[c] for c in self.scope}
        own, width = self._own(scope), b - a + 1
        left = df.where(~(own & (F.col(self.left) >= a) & (F.col(self.right) <= b)))
        bound = lambda c: F.when(own & (c > b), c - width).otherwise(c)
        return self._set(left, bound(F.col(self.left)), bound(F.col(self.right))), width // 2
