"""Differences between declared tables and tables as they are, and how to bring the latter up to date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.schema import ColumnDef, Relation, TableDef
from tessella.sources.catalog import Catalog


@dataclass(frozen=True)
class Change:
    """kind: create_table, drop_table, add_column, drop_column, alter_column, add_index or drop_index; safe: loses nothing."""

    kind: str
    table: str
    column: str | None = None
    safe: bool = True
    warning: str = ""


def diff_table(wanted: TableDef, frame: DataFrame, indexes: tuple[tuple[str, ...], ...] = ()) -> list[Change]:
    out = []
    there = {f.name: f for f in frame.schema}
    for n, c in wanted.columns.items():
        if n not in there:
            hard = not c.nullable and c.default is None
            out.append(Change("add_column", wanted.name, n, not hard, "no value for rows that are there" if hard else ""))
        elif there[n].dataType.simpleString() != c.spark.simpleString():
            out.append(Change("alter_column", wanted.name, n, False, f"{there[n].dataType.simpleString()} becomes {c.spark.simpleString()}"))
    out += [Change("drop_column", wanted.name, n, False, "its values are lost") for n in there if n not in wanted.columns]
    out += [Change("add_index", wanted.name, ",".join(i)) for i in wanted.indexes if i not in indexes]
    return out + [Change("drop_index", wanted.name, ",".join(i)) for i in indexes if i not in wanted.indexes]


def diff_schema(wanted: list[TableDef], there: dict[str, DataFrame]) -> list[Change]:
    out = []
    for t in dependency_order(wanted):
        out += diff_table(t, there[t.name]) if t.name in there else [Change("create_table", t.name)]
    names = {t.name for t in wanted}
    return out + [Change("drop_table", n, safe=False, warning="its rows are lost") for n in there if n not in names]


def dependency_order(tables: list[TableDef]) -> list[TableDef]:
    """Targets of foreign keys before those that refer to them; cycles stay in the order given."""
    names, done, out = {t.name: t for t in tables}, set(), []

    def visit(t: TableDef, path: frozenset[str]) -> None:
        if t.name in done or t.name in path:
            return
        for c in t.columns.values():
            if c.references and c.references[0] in names:
                visit(names[c.references[0]], path | {t.name})
        done.add(t.name)
        out.append(t)

    for t in tables:
        visit(t, frozenset())
    return out


def bring_up(wanted: TableDef, frame: DataFrame, allow_destructive: bool = False) -> DataFrame:
    """The table with missing columns added, by their defaults; casts and drops only if allowed."""
    for change in diff_table(wanted, frame):
        if change.kind == "add_column" and change.safe:
            c = wanted.columns[change.column]
            frame = frame.withColumn(change.column, F.lit(c.default).cast(c.spark))
        elif change.kind == "alter_column" and allow_destructive:
            frame = frame.withColumn(change.column, F.col(change.column).try_cast(wanted.columns[change.column].spark))
        elif change.kind == "drop_column" and allow_destructive:
            frame = frame.drop(change.column)
    return frame


def synchronise(catalog: Catalog, wanted: list[TableDef], there: dict[str, DataFrame], dry_run: bool = False, allow_destructive: bool = False) -> list[Change]:
    """Bring a catalog's tables up to date; the changes found."""
    changes = diff_schema(wanted, there)
    for t in [] if dry_run else wanted:
        frame = bring_up(t, there[t.name], allow_destructive) if t.name in there else catalog.spark.createDataFrame([], t.struct())
        catalog.define(t).put(t.name, frame)
    return changes


def create_table_sql(t: TableDef, location: str | None = None, buckets: int | None = None) -> str:
    """CREATE TABLE text for Spark's catalog: types, nulls, defaults and comments as columns; keys, checks and indexes, which
    Spark doesn't enforce on files, as properties. buckets: the table is bucketed by its first index, else by its key."""
    quoted = lambda text: "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"
    lines = []
    for n, c in t.columns.items():
        default = "" if c.default is None else f" DEFAULT {c.default if isinstance(c.default, (int, float)) and not isinstance(c.default, bool) else str(c.default).upper() if isinstance(c.default, bool) else quoted(c.default)}"
        lines.append(f"`{n}` {c.spark.simpleString()}{'' if c.nullable and not c.primary else ' NOT NULL'}{default}{f' COMMENT {quoted(c.comment)}' if c.comment else ''}")
    said = {"primary_key": ",".join(t.primary_key or [n for n, c in t.columns.items() if c.primary]), "unique": ",".join(n for n, c in t.columns.items() if c.unique)}
    said |= {f"foreign_key.{n}": ".".join(c.references) for n, c in t.columns.items() if c.references} | {f"check.{n}": c.check for n, c in t.columns.items() if c.check}
    said |= {f"check.{i}": x for i, x in enumerate(t.checks)} | {f"index.{i}": ",".join(x) for i, x in enumerate(t.indexes)}
    kept = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in said.items() if v)
    by = list(t.indexes[0]) if t.indexes else list(t.primary_key) or [t.key]
    clustered = f" CLUSTERED BY ({', '.join(f'`{n}`' for n in by)}) INTO {buckets} BUCKETS" if buckets else ""
    return f"CREATE TABLE IF NOT EXISTS `{t.name}` ({', '.join(lines)}) USING parquet{clustered}{f' LOCATION {quoted(location)}' if location else ''}{f' COMMENT {quoted(t.comment)}' if t.comment else ''}{f' TBLPROPERTIES ({kept})' if kept else ''}"


def create_all_sql(tables: list[TableDef]) -> list[str]:
    """CREATE TABLE texts, targets of foreign keys first."""
    return [create_table_sql(t) for t in dependency_order(tables)]


def table_source(t: TableDef) -> str:
    """Python source of a definition, for ``tessella.schema``'s names."""
    blank = ColumnDef("")
    columns = []
    for n, c in t.columns.items():
        options = "".join(f", {k}={v!r}" for k, v in vars(c).items() if k not in ("type", "name") and v != getattr(blank, k))
        columns.append(f"    {n!r}: column({c.type!r}{options}),")
    relations = [f"    {n!r}: Relation({r.kind!r}{''.join(f', {k}={v!r}' for k, v in vars(r).items() if k != 'kind' and v != getattr(Relation(r.kind), k))})," for n, r in t.relations.items()]
    more = "".join(f", {k}={getattr(t, k)!r}" for k in ("primary_key", "indexes", "checks", "comment", "schema_name") if getattr(t, k))
    return "\n".join([f"table({t.name!r}, {{", *columns, "}, {", *relations, f"}}{more})"])
