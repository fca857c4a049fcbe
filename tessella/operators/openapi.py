"""OpenAPI schemas of tables, their filters and pages."""

from __future__ import annotations

from typing import Any

from tessella.plans.filters import KINDS as KINDS_OF
from tessella.plans.filters import OPERATORS, RELATION_OPERATORS
from tessella.schema import ColumnDef, TableDef

#: type and format by Spark type.
KINDS = {"int": ("integer", "int32"), "bigint": ("integer", "int64"), "float": ("number", "float"), "double": ("number", "double"), "boolean": ("boolean", None), "date": ("string", "date"), "timestamp": ("string", "date-time"), "timestamp_ntz": ("string", "date-time"), "binary": ("string", "binary")}


def column_schema(c: ColumnDef) -> dict[str, Any]:
    kind = c.spark.simpleString()
    base, form = KINDS.get(kind, ("array" if kind.startswith("array") else "number" if kind.startswith("decimal") else "string", "uuid" if c.type.lower() == "uuid" else None))
    out: dict[str, Any] = {"type": base} | ({"format": form} if form else {})
    if base == "array":
        out["items"] = {"type": "number"}
    if c.values:
        out["enum"] = list(c.values)
    if c.comment:
        out["description"] = c.comment
    return out | ({"nullable": True} if c.nullable and not c.primary else {})


def table_schema(t: TableDef, only: list[str] | None = None, without: tuple[str, ...] = ()) -> dict[str, Any]:
    names = [n for n in (only or t.columns) if n not in without]
    return {"type": "object", "properties": {n: column_schema(t.columns[n]) for n in names}, "required": [n for n in names if t.columns[n].primary or not t.columns[n].nullable]}


def create_schema(t: TableDef) -> dict[str, Any]:
    """What may be given for a new row: no generated keys; required is what has neither default nor null."""
    out = table_schema(t, [n for n, c in t.columns.items() if not c.autoincrement])
    return out | {"required": [n for n in out["properties"] if not t.columns[n].nullable and t.columns[n].default is None]}


def update_schema(t: TableDef) -> dict[str, Any]:
    """What may be changed of a row: all but its key, nothing required."""
    return table_schema(t, [n for n, c in t.columns.items() if not c.primary]) | {"required": []}


def nested_schema(t: TableDef, tables: dict[str, TableDef], relations: dict[str, Any]) -> dict[str, Any]:
    """A row with related rows. relations: for each relation, those below it."""
    out = table_schema(t)
    for name, below in relations.items():
        r = t.relation(name)
        inner = nested_schema(tables[r.target], tables, below or {})
        out["properties"] = out["properties"] | {name: inner | {"nullable": True} if r.single else {"type": "array", "items": inner}}
    return out


def _operand(op: str, own: dict[str, Any]) -> dict[str, Any]:
    return {"type": "array", "items": own} if op in ("in", "not_in") else own


def _kind(own: dict[str, Any]) -> str:
    return "number" if own["type"] in ("integer", "number") else "date" if own.get("format", "").startswith("date") else "text" if own["type"] == "string" else "other"


def filter_schema(t: TableDef, deep: int = 1, tables: dict[str, TableDef] | None = None) -> dict[str, Any]:
    """What ``apply_filter`` takes, from its own lists of operators."""
    out: dict[str, Any] = {}
    for n, c in t.columns.items():
        own = {k: v for k, v in column_schema(c).items() if k != "nullable"}
        said = {op: _operand(op, own) for op in OPERATORS if _kind(own) in KINDS_OF.get(op, (_kind(own),))}
        mode = {"mode": {"type": "string", "enum": ["default", "insensitive"]}} if "contains" in said else {}
        out[n] = {"type": "object", "properties": said | mode}
    for n, r in t.relations.items() if deep > 0 and tables else ():
        if r.target in tables:
            inner = filter_schema(tables[r.target], deep - 1, tables)
            out[n] = {"type": "object", "properties": {op: {"type": "boolean"} if op.startswith("is_") else inner for op in RELATION_OPERATORS}}
    return {"type": "object", "properties": out}


def page_schema(item: dict[str, Any]) -> dict[str, Any]:
    whole = {"type": "integer", "minimum": 0}
    return {"type": "object", "properties": {"items": {"type": "array", "items": item}} | {n: whole for n in ("totalItems", "page", "pageSize", "totalPages")} | {n: {"type": "boolean"} for n in ("hasNextPage", "hasPrevPage")}}


def tree_schema(node: dict[str, Any], name: str = "Node") -> dict[str, Any]:
    return node | {"properties": node["properties"] | {"children": {"type": "array", "items": {"$ref": f"#/components/schemas/{name}"}}}}


def document(title: str, version: str, schemas: dict[str, dict[str, Any]]) -> dict[str, Any]:
    return {"openapi": "3.0.3", "info": {"title": title, "version": version}, "paths": {}, "components": {"schemas": schemas}}
