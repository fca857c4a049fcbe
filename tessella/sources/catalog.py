"""The catalog: tables by name, from files, Spark's own catalog, other databases, rows in hand or DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessella.schema import ColumnDef, TableDef, table


class Catalog:
    """What a query reads by name. A name in no definition still resolves, to a table of Spark's catalog."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root
        self.definitions: dict[str, TableDef] = {}
        self.listeners: list[Callable[[str], Any]] = []
        self._frames: dict[str, DataFrame] = {}

    def define(self, *tables: TableDef) -> Catalog:
        self.definitions |= {t.name: t for t in tables}
        return self

    def put(self, name: str, frame: DataFrame) -> Catalog:
        """Another snapshot of a table; whoever listens is told its name."""
        self._frames[name] = frame
        for f in self.listeners:
            f(name)
        return self

    def definition(self, name: str) -> TableDef:
        """As declared, else read off the table's schema."""
        if name not in self.definitions:
            self.definitions[name] = introspect(name, self.frame(name))
        return self.definitions[name]

    def frame(self, name: str) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        own = self.definitions.get(name)
        if self.root is not None and (own is not None or "." not in name):
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self.spark.table(f"{own.schema_name}.{name}" if own is not None and own.schema_name else name)

    def rows(self, definition: TableDef, rows: Iterable[dict[str, Any]]) -> Catalog:
        """A table of rows in hand; columns that a row lacks get their default."""
        names = list(definition.columns)
        data = [tuple(r.get(n, definition.columns[n].default) for n in names) for r in rows]
        return self.define(definition).put(definition.name, self.spark.createDataFrame(data, definition.struct()))

    def snapshot(self) -> dict[str, DataFrame]:
        return dict(self._frames)

    def restore(self, frames: dict[str, DataFrame]) -> None:
        changed = [n for n in self._frames | frames if self._frames.get(n) is not frames.get(n)]
        self._frames = dict(frames)
        for n in changed:
            for f in self.listeners:
                f(n)


def read_table(spark: SparkSession, kind: str, path: str, schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """A table of files: parquet, orc, json, csv or text."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: Any) -> DataFrame:
    """A table of another database, read in ranges of a key where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def write_jdbc(frame: DataFrame, url: str, name: str, mode: str = "append", partitions: int = 16, batch: int = 10_000, **options: Any) -> None:
    """A frame into a table of another database, by at most so many connections, in batches."""
    frame.coalesce(partitions).write.format("jdbc").mode(mode).options(url=url, dbtable=name, batchsize=batch, **options).save()


def write_table(frame: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: Iterable[str] = (), **options: Any) -> None:
    frame.write.format(kind).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def write_bucketed(frame: DataFrame, name: str, key: str, buckets: int, mode: str = "errorifexists") -> None:
    """A table whose joins on the key need no shuffle."""
    frame.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def insert_rows(frame: DataFrame, rows: list[dict[str, Any]]) -> DataFrame:
    """frame with rows; their columns are those of the first, and one that lacks a column raises."""
    names = list(rows[0]) if rows else []
    for r in rows:
        if set(r) != set(names):
            raise ValueError(f"row {r!r} doesn't have the columns {names}")
    schema = T.StructType([T.StructField(n, frame.schema[n].dataType, True) for n in names])
    new = frame.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    return frame.unionByName(new, allowMissingColumns=True)


def insert_select(frame: DataFrame, query: DataFrame) -> DataFrame:
    """frame with a query's rows, matched by position."""
    return frame.union(query.select(*[query[c].cast(f.dataType).alias(f.name) for c, f in zip(query.columns, frame.schema, strict=True)]))


#: SQL types of Spark's.
SQL_TYPES = {"int": "INT", "bigint": "BIGINT", "string": "TEXT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMPTZ", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB", "smallint": "SMALLINT", "tinyint": "TINYINT", "array<float>": "VECTOR"}


#: SQL types of an information_schema's.
FOREIGN_TYPES = {"integer": "INT", "int": "INT", "int4": "INT", "bigint": "BIGINT", "int8": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "double precision": "DOUBLE", "real": "FLOAT", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp without time zone": "TIMESTAMP", "timestamp with time zone": "TIMESTAMPTZ", "blob": "BLOB", "bytea": "BLOB"}


def introspect(name: str, frame: DataFrame, primary: str | None = None) -> TableDef:
    """A definition read off a table's schema: types, nulls, and the keys, checks, defaults and comments that its metadata holds."""
    made = {}
    for f in frame.schema:
        kind, meta = f.dataType.simpleString(), f.metadata or {}
        said = {k: meta[k] for k in ("unique", "check", "comment", "default", "on_delete", "on_update") if k in meta}
        if "references" in meta:
            said["references"] = tuple(meta["references"])
        key = f.name == primary if primary is not None else bool(meta.get("primary"))
        made[f.name] = ColumnDef(SQL_TYPES.get(kind, kind.upper() if kind.startswith("decimal") else "TEXT"), f.name, primary=key, nullable=f.nullable, **said)
    return table(name, made)


@dataclass(frozen=True)
class Introspected:
    """What a database holds: tables, views by name, and names of routines."""

    tables: dict[str, TableDef]
    views: dict[str, TableDef]
    routines: tuple[str, ...]


def introspect_database(spark: SparkSession, database: str | None = None) -> Introspected:
    """All tables and views of a database of Spark's catalog, and the functions that users added."""
    found: dict[bool, dict[str, TableDef]] = {False: {}, True: {}}
    for t in spark.catalog.listTables(database):
        full = t.name if t.isTemporary else ".".join([*(t.namespace or []), t.name])
        found[t.tableType in ("VIEW", "TEMPORARY")][t.name] = introspect(t.name, spark.table(full))
    routines = tuple(sorted(r[0] for r in spark.sql("SHOW USER FUNCTIONS").collect()))
    return Introspected(found[False], found[True], routines)


def introspect_all(spark: SparkSession, database: str | None = None) -> dict[str, TableDef]:
    """Definitions of all tables and views of Spark's catalog."""
    found = introspect_database(spark, database)
    return found.tables | found.views


def introspect_information_schema(columns: DataFrame, usage: DataFrame, constraints: DataFrame, references: DataFrame | None = None) -> dict[str, TableDef]:
    """Definitions from another database's information_schema, as read by ``read_jdbc``: its views ``columns``, ``key_column_usage``,
    ``table_constraints`` and ``referential_constraints``. A schema has few rows: they come to the driver."""
    low = lambda df: df.toDF(*[c.lower() for c in df.columns])
    kinds = {r["constraint_name"]: r["constraint_type"] for r in low(constraints).select("constraint_name", "constraint_type").collect()}
    uses = low(usage).select("constraint_name", "table_name", "column_name", "ordinal_position").orderBy("constraint_name", "ordinal_position").collect()
    by_name: dict[str, list[Any]] = {}
    for u in uses:
        by_name.setdefault(u["constraint_name"], []).append(u)
    targets = {r["constraint_name"]: r["unique_constraint_name"] for r in low(references).select("constraint_name", "unique_constraint_name").collect()} if references is not None else {}
    flags: dict[tuple[str, str], dict[str, Any]] = {}
    for name, own in by_name.items():
        for i, u in enumerate(own):
            said = flags.setdefault((u["table_name"], u["column_name"]), {})
            if kinds.get(name) == "PRIMARY KEY":
                said["primary"] = True
            elif kinds.get(name) == "UNIQUE" and len(own) == 1:
                said["unique"] = True
            elif kinds.get(name) == "FOREIGN KEY" and i < len(there := by_name.get(targets.get(name, ""), [])):
                said["references"] = (there[i]["table_name"], there[i]["column_name"])
    out: dict[str, dict[str, ColumnDef]] = {}
    for c in low(columns).select("table_name", "column_name", "data_type", "is_nullable", "ordinal_position").orderBy("table_name", "ordinal_position").collect():
        kind = FOREIGN_TYPES.get(c["data_type"].lower().partition("(")[0].strip(), "TEXT")
        out.setdefault(c["table_name"], {})[c["column_name"]] = ColumnDef(kind, c["column_name"], nullable=c["is_nullable"].upper() == "YES", **flags.get((c["table_name"], c["column_name"]), {}))
    return {t: table(t, cs) for t, cs in out.items()}
