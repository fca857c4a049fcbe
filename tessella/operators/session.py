"""A session over a catalog: tracked changes of rows, transactions as snapshots, nested payloads, hooks and events.

Rows in hand live on the driver, as in any unit of work. What they change is gathered by table and applied as one join
for each table (and one for each relation whose children are pruned or cleared), however many rows there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import dml
from tessella.schema import Relation, TableDef
from tessella.sources.catalog import Catalog


@dataclass
class _Change:
    """Of one root's related rows: those that stay (all, if none are named), those that come, those that go."""

    kept: list[Any] | None = None
    more: list[Any] = field(default_factory=list)
    less: list[Any] = field(default_factory=list)


class _Graph:
    """Rows by table and key, and changes by relation and root."""

    def __init__(self) -> None:
        self.rows: dict[str, dict[Any, dict[str, Any]]] = defaultdict(dict)
        self.relations: dict[Relation, dict[Any, _Change]] = defaultdict(dict)

    def relate(self, r: Relation, key: Any, kept: list[Any] | None, more: list[Any], less: list[Any]) -> None:
        """One more change of a root's related rows, after those before."""
        c = self.relations[r].setdefault(key, _Change())
        if kept is not None:
            c.kept, c.less = list(kept), []
        c.more = [i for i in c.more if i not in less and (kept is None or i in kept)] + list(more)
        c.kept = c.kept if c.kept is None else [i for i in c.kept if i not in less] + [i for i in more if i not in c.kept]
        c.less = [i for i in c.less if i not in more] + list(less)


class Session:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self.spark = catalog, catalog.spark
        self.identities: dict[tuple[str, Any], dict[str, Any]] = {}
        self._clean: dict[tuple[str, Any], dict[str, Any]] = {}
        self._new: dict[str, list[dict[str, Any]]] = defaultdict(list)
        self._removed: dict[str, list[Any]] = defaultdict(list)
        self._hooks: dict[str, list[Callable]] = defaultdict(list)
        self._events: list[tuple[str, Any]] = []
        self._links: list[tuple] = []
        self._depth, self._broken = 0, False
        self.procedures: dict[str, Callable[..., list[dict[str, Any]]]] = {}

    # hooks and events: before_insert, after_insert, ... of rows; any other name is an event, sent after a commit

    def on(self, name: str, f: Callable) -> None:
        self._hooks[name].append(f)

    def raise_event(self, name: str, payload: Any) -> None:
        self._events.append((name, payload))

    def _tell(self, name: str, *args: Any) -> None:
        for f in self._hooks[name]:
            f(*args)

    # rows in hand

    def find(self, table: TableDef, key: Any) -> dict[str, Any] | None:
        """One object for each key, however often it is asked for."""
        if (table.name, key) not in self.identities:
            row = self.catalog.frame(table.name).where(F.col(table.key) == key).first()
            if row is None:
                return None
            self.identities[table.name, key] = row.asDict(recursive=True)
            self._clean[table.name, key] = row.asDict(recursive=True)
        return self.identities[table.name, key]

    def add(self, table: TableDef, row: dict[str, Any]) -> dict[str, Any]:
        self._new[table.name].append(row)
        self.identities[table.name, row.get(table.key)] = row
        return row

    def remove(self, table: TableDef, row: dict[str, Any]) -> None:
        self._removed[table.name].append(row[table.key])
        self.identities.pop((table.name, row[table.key]), None)

    def _frame(self, table: TableDef, rows: list[dict[str, Any]], names: list[str]) -> DataFrame:
        own = self.catalog.frame(table.name).schema
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], T.StructType([T.StructField(n, own[n].dataType) for n in names]))

    def _given(self, table: TableDef, rows: list[dict[str, Any]]) -> DataFrame:
        """Rows with different columns as one frame; ``__given`` names those that each row has."""
        own = self.catalog.frame(table.name).schema
        names = [n for n in own.names if any(n in r for r in rows)]
        kinds = T.StructType([*[T.StructField(n, own[n].dataType) for n in names], T.StructField("__given", T.ArrayType(T.StringType()))])
        return self.spark.createDataFrame([(*[r.get(n) for n in names], [n for n in names if n in r]) for r in rows], kinds)

    def _merge(self, table: TableDef, rows: list[dict[str, Any]]) -> None:
        """Rows, one for each key, into their table: one join."""
        self.catalog.put(table.name, dml.merge(self.catalog.frame(table.name), self._given(table, rows), [table.key], "__given"))

    def flush(self) -> None:
        """New, changed (their changed columns only) and removed rows, and changed relations, table by table."""
        names = {*self._new, *self._removed, *(t for t, _ in self._clean)}
        for name in sorted(names):
            table = self.catalog.definition(name)
            changed = []
            for (t, key), before in list(self._clean.items()):
                now = self.identities.get((t, key))
                if t == name and now is not None and any(now.get(c) != before[c] for c in before):
                    self._tell("before_update", table, now)
                    changed.append((now, {table.key: now[table.key]} | {c: now.get(c) for c in before if now.get(c) != before[c]}))
                    self._clean[t, key] = dict(now)
            if changed:
                self._merge(table, [diff for _, diff in changed])
            for now, _ in changed:
                self._tell("after_update", table, now)
            frame = self.catalog.frame(name)
            for r in self._new[name]:
                self._tell("before_insert", table, r)
            if self._new[name]:
                frame = dml.insert(frame, self._frame(table, self._new[name], frame.columns))
            for r in self._new.pop(name, []):
                self._clean[name, r.get(table.key)] = dict(r)
                self._tell("after_insert", table, r)
            if gone := self._removed.pop(name, []):
                self._tell("before_delete", table, gone)
                frame = dml.bulk_delete(frame, self._frame(table, [{table.key: k} for k in gone], [table.key]), table.key)
                self._tell("after_delete", table, gone)
            self.catalog.put(name, frame)
        links, self._links = self._links, []
        if links:
            graph = _Graph()
            for table, relation, key, kept, more, less in links:
                graph.relate(table.relation(relation), key, kept, more, less)
            self._apply(graph)

    def commit(self) -> None:
        self.flush()
        if self._depth == 0:
            events, self._events = self._events, []
            for name, payload in events:
                self._tell(name, payload)

    def rollback(self) -> None:
        self.identities.clear()
        self._clean.clear()
        self._new.clear()
        self._removed.clear()
        self._links.clear()
        self._events.clear()

    @contextmanager
    def transaction(self) -> Iterator[Session]:
        """All tables as they were, if the block fails. An inner block is a savepoint; if it fails, the outer can only fail too."""
        before, outermost = self.catalog.snapshot(), self._depth == 0
        self._depth += 1
        try:
            yield self
            if self._broken:
                raise RuntimeError("an inner transaction failed: it can only be rolled back")
            self.flush()
        except BaseException:
            self.catalog.restore(before)
            self.rollback()
            self._broken = not outermost
            raise
        finally:
            self._depth -= 1
            if outermost:
                self._broken = False
        if outermost:
            self.commit()

    # nested payloads and relations

    def save_graph(self, table: TableDef, payload: dict[str, Any], prune_missing: bool = False) -> Any:
        """Insert or update a row and, by its relations, nested rows; prune_missing: children that aren't in the payload are detached."""
        return self.save_graphs(table, [payload], prune_missing)[0]

    update_graph = save_graph

    def save_graphs(self, table: TableDef, payloads: list[dict[str, Any]], prune_missing: bool = False) -> list[Any]:
        """Several payloads at once; of several values for one column of one row the last counts."""
        graph = _Graph()
        keys = [self._gather(graph, table, p, prune_missing) for p in payloads]
        self._apply(graph)
        return keys

    def patch_graph(self, table: TableDef, payload: dict[str, Any]) -> Any:
        """Like save_graph, but a row that isn't there raises."""
        if self.catalog.frame(table.name).where(F.col(table.key) == payload.get(table.key)).isEmpty():
            raise LookupError(f"{table.name} has no {payload.get(table.key)!r}")
        return self.save_graph(table, payload)

    def _gather(self, graph: _Graph, table: TableDef, payload: dict[str, Any], prune: bool) -> Any:
        """The payload's rows and relations into a graph; the key of its outermost row."""
        columns = {k: v for k, v in payload.items() if k in table.columns}
        nested = {k: v for k, v in payload.items() if k in table.relations}
        for name, value in nested.items():
            r = table.relation(name)
            if r.kind == "belongs_to" and value is not None:
                columns[r.foreign_key] = self._gather(graph, self.catalog.definition(r.target), value, prune)
        key = columns.get(table.key)
        if key is None:
            raise ValueError(f"{table.name} needs {table.key}")
        graph.rows[table.name].setdefault(key, {}).update(columns)
        for name, value in nested.items():
            r = table.relation(name)
            if r.kind == "belongs_to":
                continue
            target = self.catalog.definition(r.target)
            children = [x for x in (value if isinstance(value, list) else [value]) if x is not None]
            own = {} if r.pivot else {r.foreign_key: key} | ({r.type_column: r.type_value} if r.type_column else {})
            ids = [c[target.key] if r.pivot and len(c) == 1 else self._gather(graph, target, c | own, prune) for c in children]
            if r.pivot or prune:
                graph.relate(r, key, ids if prune else None, ids if r.pivot else [], [])
        return key

    def _apply(self, graph: _Graph) -> None:
        for name, rows in graph.rows.items():
            self._merge(self.catalog.definition(name), list(rows.values()))
        for r, changes in graph.relations.items():
            (self._relink if r.pivot else self._detach)(r, changes)

    def _changes(self, r: Relation, frame: DataFrame, id_column: str, changes: dict[Any, _Change]) -> tuple[DataFrame, DataFrame, Any]:
        """A relation's rows beside the changes of their roots, and whether a row goes."""
        kinds = [frame.schema[n].dataType for n in (r.foreign_key, id_column)]
        schema = T.StructType([T.StructField("__root", kinds[0]), T.StructField("__kept", T.ArrayType(kinds[1])), T.StructField("__less", T.ArrayType(kinds[1]))])
        sent = self.spark.createDataFrame([(k, c.kept, c.less) for k, c in changes.items()], schema)
        met = frame.join(sent, F.col(r.foreign_key) == F.col("__root"), "left")
        goes = F.col("__kept").isNotNull() & ~F.coalesce(F.array_contains("__kept", F.col(id_column)), F.lit(False)) | F.coalesce(F.array_contains("__less", F.col(id_column)), F.lit(False))
        if r.type_column:
            goes = goes & (F.col(r.type_column) == r.type_value)
        return met, frame, F.coalesce(goes, F.lit(False))

    def _detach(self, r: Relation, changes: dict[Any, _Change]) -> None:
        """Children that go lose their root, or go altogether, as the relation cascades; children that are added get it."""
        target = self.catalog.definition(r.target)
        added = [{target.key: i, r.foreign_key: key} | ({r.type_column: r.type_value} if r.type_column else {}) for key, c in changes.items() for i in c.more]
        if any(c.kept is not None or c.less for c in changes.values()):
            met, frame, goes = self._changes(r, self.catalog.frame(target.name), target.key, changes)
            after = met.where(~goes) if r.cascade in ("all", "remove") else met.withColumn(r.foreign_key, F.when(~goes, F.col(r.foreign_key)))
            self.catalog.put(target.name, after.select(*frame.columns))
        if added:
            self._merge(target, added)

    def _relink(self, r: Relation, changes: dict[Any, _Change]) -> None:
        """Pivot rows that go, and new pairs; pairs that are there stay as they are."""
        pivot = self.catalog.frame(r.pivot)
        if any(c.kept is not None or c.less for c in changes.values()):
            met, _, goes = self._changes(r, pivot, r.pivot_target_key, changes)
            pivot = met.where(~goes).select(*pivot.columns)
        if pairs := list(dict.fromkeys((key, i) for key, c in changes.items() for i in c.more)):
            kinds = T.StructType([T.StructField(n, pivot.schema[n].dataType) for n in (r.foreign_key, r.pivot_target_key)])
            pivot = dml.upsert(pivot, self.spark.createDataFrame(pairs, kinds), [r.foreign_key, r.pivot_target_key], check=False)
        self.catalog.put(r.pivot, pivot)

    def attach(self, table: TableDef, relation: str, key: Any, ids: list[Any]) -> None:
        """Related rows more; applied at the next flush, like ``detach``, ``sync`` and ``clear``."""
        self._links.append((table, relation, key, None, list(ids), []))

    def detach(self, table: TableDef, relation: str, key: Any, ids: list[Any]) -> None:
        """Related rows less: pivot rows go; children lose their root, or go, as the relation cascades."""
        self._links.append((table, relation, key, None, [], list(ids)))

    def sync(self, table: TableDef, relation: str, key: Any, ids: list[Any]) -> None:
        """These related rows and no others."""
        self._links.append((table, relation, key, list(ids), list(ids), []))

    def clear(self, table: TableDef, relation: str, key: Any) -> None:
        self.sync(table, relation, key, [])

    # procedures

    def call_procedure(self, name: str, inputs: dict[str, Any] | None = None, outputs: tuple[str, ...] = ()) -> tuple[dict[str, Any], list[dict[str, Any]]]:
        """A registered callable; outputs are read from its first row."""
        if name not in self.procedures:
            raise LookupError(f"no procedure {name!r}")
        rows = self.procedures[name](self, **(inputs or {}))
        first = rows[0] if rows else {}
        if missing := [o for o in outputs if o not in first]:
            raise LookupError(f"{name} gave no {missing}")
        return {o: first[o] for o in outputs}, rows
