"""Declared tables: columns, keys and relations. Keys and checks are declarations; Spark doesn't enforce them on files."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from types import SimpleNamespace
from typing import Any

from pyspark.sql import types as T

from tessella.expr import Expr, col, spark_type


@dataclass(frozen=True)
class ColumnDef:
    type: str
    name: str = ""
    primary: bool = False
    nullable: bool = True
    unique: bool = False
    default: Any = None
    check: str | None = None
    references: tuple[str, str] | None = None
    on_delete: str | None = None
    on_update: str | None = None
    autoincrement: bool = False
    comment: str = ""
    values: tuple[str, ...] = ()
    dimension: int | None = None
    element: str = "float32"

    @property
    def spark(self) -> T.DataType:
        return T._parse_datatype_string(spark_type(self.type)) if not self.type.startswith("struct<") else T._parse_datatype_string(self.type)


#: What a foreign key may do when its target changes.
ACTIONS = ("NO ACTION", "RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT")
#: Numbers that a vector may hold.
ELEMENTS = ("float32", "float16", "int8", "bit")


def column(kind: str, **options: Any) -> ColumnDef:
    """A column of a SQL type. Options as of ColumnDef."""
    spark_type(kind)
    for action in ("on_delete", "on_update"):
        if options.get(action) and options[action].upper() not in ACTIONS:
            raise ValueError(f"unknown action {options[action]!r}")
    if options.get("element", "float32") not in ELEMENTS:
        raise ValueError(f"unknown element type {options['element']!r}")
    return ColumnDef(kind, **options)


def custom_column(ddl: str, **options: Any) -> ColumnDef:
    """A column of any Spark type, as ``struct<...>`` text."""
    return ColumnDef(ddl, **options)


@dataclass(frozen=True)
class Relation:
    """kind: has_one, has_many, belongs_to, belongs_to_many, morph_one, morph_many or morph_to."""

    kind: str
    target: str = ""
    foreign_key: str = ""
    local_key: str | None = None
    pivot: str | None = None
    pivot_target_key: str = ""
    pivot_columns: tuple[str, ...] = ()
    type_column: str = ""
    type_value: str = ""
    targets: tuple[tuple[str, str], ...] = ()
    cascade: str = "none"

    @property
    def single(self) -> bool:
        return self.kind in ("has_one", "belongs_to", "morph_one", "morph_to")


def has_one(target: str, foreign_key: str, local_key: str | None = None, cascade: str = "none") -> Relation:
    return Relation("has_one", target, foreign_key, local_key, cascade=cascade)


def has_many(target: str, foreign_key: str, local_key: str | None = None, cascade: str = "none") -> Relation:
    return Relation("has_many", target, foreign_key, local_key, cascade=cascade)


def belongs_to(target: str, foreign_key: str, local_key: str | None = None) -> Relation:
    """foreign_key: of this table; local_key: of the target (its primary key, if none)."""
    return Relation("belongs_to", target, foreign_key, local_key)


def belongs_to_many(target: str, pivot: str, root_key: str, target_key: str, pivot_columns: tuple[str, ...] = (), local_key: str | None = None) -> Relation:
    """root_key and target_key: columns of the pivot table."""
    return Relation("belongs_to_many", target, root_key, local_key, pivot, target_key, tuple(pivot_columns))


def morph_one(target: str, id_column: str, type_column: str, type_value: str, local_key: str | None = None) -> Relation:
    return Relation("morph_one", target, id_column, local_key, type_column=type_column, type_value=type_value)


def morph_many(target: str, id_column: str, type_column: str, type_value: str, local_key: str | None = None) -> Relation:
    return Relation("morph_many", target, id_column, local_key, type_column=type_column, type_value=type_value)


def morph_to(id_column: str, type_column: str, targets: dict[str, str]) -> Relation:
    """targets: the table for each value of the type column."""
    return Relation("morph_to", foreign_key=id_column, type_column=type_column, targets=tuple(targets.items()))


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: dict[str, ColumnDef]
    relations: dict[str, Relation] = field(default_factory=dict)
    primary_key: tuple[str, ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    comment: str = ""
    schema_name: str | None = None
    tree: Any = None  #: the columns of a nested-set tree, if the table is one

    @property
    def key(self) -> str:
        """The column flagged primary, the first of a declared key, else ``id``."""
        return next((n for n, c in self.columns.items() if c.primary), self.primary_key[0] if self.primary_key else "id")

    @property
    def c(self) -> SimpleNamespace:
        """Columns as expressions by attribute; an unknown one raises."""
        return SimpleNamespace(**{n: col(f"{self.name}.{n}") for n in self.columns})

    def __getitem__(self, name: str) -> Expr:
        if name not in self.columns:
            raise KeyError(f"{self.name} has no column {name!r}")
        return col(f"{self.name}.{name}")

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise KeyError(f"{self.name} has no relation {name!r}")
        return self.relations[name]

    def struct(self) -> T.StructType:
        meta = lambda c: {k: list(v) if isinstance(v, tuple) else v for k in ("primary", "unique", "check", "comment", "references", "default", "on_delete", "on_update") if (v := getattr(c, k)) not in (None, False, "")}
        return T.StructType([T.StructField(n, c.spark, c.nullable and not c.primary, meta(c)) for n, c in self.columns.items()])

    def with_relations(self, **relations: Relation) -> TableDef:
        return replace(self, relations=self.relations | relations)


def table(name: str, columns: dict[str, ColumnDef | str], relations: dict[str, Relation] | None = None, **options: Any) -> TableDef:
    """A table; columns may be given as SQL types alone."""
    made = {n: replace(c if isinstance(c, ColumnDef) else column(c), name=n) for n, c in columns.items()}
    return TableDef(name, made, dict(relations or {}), **options)


#: SQL types of Python's.
PYTHON_TYPES = {"int": "BIGINT", "float": "DOUBLE", "str": "TEXT", "bool": "BOOLEAN", "bytes": "BLOB", "date": "DATE", "datetime": "TIMESTAMP", "Decimal": "DECIMAL"}


def entity_table(cls: type, name: str | None = None, primary: str = "id", relations: dict[str, Relation] | None = None) -> TableDef:
    """The table of a dataclass: its fields by their types, or by ``metadata={"column": ...}``."""
    if not is_dataclass(cls):
        raise TypeError("a dataclass is needed")
    made = {}
    for f in fields(cls):
        own = f.metadata.get("column")
        kind = (f.type if isinstance(f.type, str) else f.type.__name__).split("|")[0].strip()
        made[f.name] = own if own is not None else column(PYTHON_TYPES[kind], primary=f.name == primary)
    made_table = table(name or cls.__name__.lower(), made, relations)
    declared = getattr(cls, "__tree__", None)
    return made_table if declared is None else declared(made_table)
