"""Functions of JSON texts."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.expr import Expr, call
from tessella.functions.registry import scalar


def json_length(doc: Any, path: str = "$") -> Expr:
    """Elements of an array, keys of an object, 1 for a scalar; null where there is nothing."""

    def make(c: Column) -> Column:
        at = F.get_json_object(c, path)
        first = F.substring(F.ltrim(at), 1, 1)
        return F.when(first == "[", F.json_array_length(at)).when(first == "{", F.size(F.json_object_keys(at))).when(at.isNotNull(), 1)

    return call(f"json_length:{path}", make, doc)


def json_set(doc: Any, path: str, value: Any) -> Expr:
    """The object with the key at ``$.key`` (or ``$.a.b``) set to a value; other keys keep their types and order."""
    keys = path.removeprefix("$.").split(".")
    if not path.startswith("$.") or not all(k.isidentifier() for k in keys):
        raise ValueError("a path of names is needed, such as $.a.b")

    def put(c: Column, names: list[str]) -> Column:
        key = names[0]
        own = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
        raw = F.from_json(c, "map<string,variant>")
        new = F.lit(json.dumps(value)) if len(names) == 1 else put(F.coalesce(F.get_json_object(c, f"$.{key}"), F.lit("{}")), names[1:])
        said = lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.when(k == key, new).otherwise(F.to_json(F.element_at(raw, k))))
        every = F.when(F.array_contains(own, key), own).otherwise(F.array_append(own, key))
        return F.concat(F.lit("{"), F.array_join(F.transform(every, said), ","), F.lit("}"))

    return call(f"json_set:{path}{value!r}", lambda c: put(c, keys), doc)


def json_array_agg(value: Any) -> Expr:
    """A JSON array of the values, nulls included, in ascending order with nulls first."""

    def make(c: Column) -> Column:
        return F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(c.alias("v")))), lambda x: x["v"]))

    return call("json_array_agg", make, value, aggregate=True)


def json_contains(doc: Any, candidate: Any, path: str = "$") -> Expr:
    """Whether a scalar is in the array (or is the scalar) at the path, or all pairs of an object are there."""

    def make(c: Column) -> Column:
        at = F.get_json_object(c, path)
        if isinstance(candidate, dict):
            out = F.lit(True)
            for k, v in candidate.items():
                out = out & F.coalesce(F.get_json_object(at, f"$.{k}") == (v if isinstance(v, str) else json.dumps(v)), F.lit(False))
            return F.when(at.isNotNull(), out)
        said = candidate if isinstance(candidate, str) else json.dumps(candidate)
        items = F.from_json(at, "array<string>")
        return F.when(at.isNotNull(), F.when(F.ltrim(at).startswith("["), F.array_contains(items, said)).otherwise(at == said))

    return call(f"json_contains:{candidate!r}{path}", make, doc)


@scalar
def to_json(value: Column) -> Column:
    return F.to_json(value)
