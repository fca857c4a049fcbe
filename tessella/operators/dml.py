"""Changes as functions from a DataFrame to a DataFrame: files don't change, a new snapshot replaces them.

Each function gives the new table; those ending in ``_returning`` give the affected rows too.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _value(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _true(condition: Column | None) -> Column:
    """A condition with null as false; true without one."""
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def update(table: DataFrame, changes: dict[str, Any], where: Column | None = None) -> DataFrame:
    """Rows for which the condition is null stay as they are."""
    ok = _true(where)
    return table.withColumns({c: F.when(ok, _value(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def update_returning(table: DataFrame, changes: dict[str, Any], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    return update(table, changes, where), table.where(_true(where)).withColumns({c: _value(v).cast(table.schema[c].dataType) for c, v in changes.items()})


def update_from(table: DataFrame, source: DataFrame, keys: list[str], changes: dict[str, str], where: Column | None = None) -> DataFrame:
    """Set columns from a source's columns where the keys are equal; of several source rows the least counts."""
    taken = source.groupBy(*keys).agg(F.min(F.struct(*dict.fromkeys(changes.values()))).alias("__s")).withColumn("__hit", F.lit(True))
    joined = table.join(taken, keys, "left")
    ok = _true(where) & F.coalesce(F.col("__hit"), F.lit(False))
    return joined.select(*[F.when(ok, F.col(f"__s.{changes[c]}")).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows for which the condition is null stay."""
    return table.where(~_true(where))


def delete_returning(table: DataFrame, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    return delete(table, where), table.where(_true(where))


def delete_using(table: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Without the rows whose keys the source has."""
    return table.join(source.select(*keys), keys, "left_anti").select(*table.columns)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that the rows lack become null."""
    return table.unionByName(rows, allowMissingColumns=True)


def _met(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table beside new rows, by key, each read once: the table's columns, ``__new_*`` of the new rows, ``__there`` and ``__hit``.

    Null keys meet nothing.
    """
    new = rows.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in rows.columns if c not in keys], F.lit(True).alias("__hit"))
    return table.withColumn("__there", F.lit(True)).join(new, keys, "full_outer")


def _settled(table: DataFrame, rows: DataFrame, met: DataFrame, keys: list[str], changed: dict[str, Column], ok: Column) -> DataFrame:
    """The table's columns after the meeting: changed where a row is hit and ok, the new row's own where none was there."""
    fresh, hit = F.col("__there").isNull(), F.col("__hit").isNotNull() & ok
    out = []
    for c in table.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        kind = table.schema[c].dataType
        own = F.col(f"__new_{c}").cast(kind) if c in rows.columns else F.lit(None).cast(kind)
        kept = F.when(hit, changed[c].cast(kind)).otherwise(F.col(c)) if c in changed else F.col(c)
        out.append(F.when(fresh, own).otherwise(kept).alias(c))
    return met.select(*out)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], changes: dict[str, Any] | None = None, where: Column | None = None, check: bool = True) -> DataFrame:
    """Rows with new keys are inserted; where a key is there, ``changes`` are set (guarded by ``where``), not the row's own values.

    Without changes, rows that are there stay. Two new rows of one key raise; to tell, a job runs at once (unless check is false).
    """
    return upsert_returning(table, rows, keys, changes, where, check)[0]


def upsert_returning(table: DataFrame, rows: DataFrame, keys: list[str], changes: dict[str, Any] | None = None, where: Column | None = None, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows inserted or changed, as they are now, too."""
    if check and not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("several new rows have one key")
    met, changed, ok = _met(table, rows, keys), {c: _value(v) for c, v in (changes or {}).items()}, _true(where)
    touched = met.where(F.col("__there").isNull() | (F.col("__hit").isNotNull() & ok if changes else F.lit(False)))
    return _settled(table, rows, met, keys, changed, ok), _settled(table, rows, touched, keys, changed, ok)


def merge(table: DataFrame, rows: DataFrame, keys: list[str], given: str) -> DataFrame:
    """Rows replace those of their key, in the columns that their array ``given`` names; new keys are inserted. One row a key."""
    met = _met(table, rows, keys)
    changed = {c: F.when(F.array_contains(f"__new_{given}", c), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in rows.columns if c in table.columns and c not in keys}
    return _settled(table, rows, met, keys, changed, F.lit(True))


def bulk_insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """One distributed write takes the place of chunks."""
    return insert(table, rows)


def bulk_upsert(table: DataFrame, rows: DataFrame, keys: list[str], changes: list[str] | None = None) -> DataFrame:
    """Whole incoming rows replace those of their key; with ``changes``, their named columns only.

    Of several rows of one key the least counts; rows with a null key are inserted, each for itself.
    """
    names = changes if changes is not None else [c for c in rows.columns if c not in keys]
    rest = [c for c in rows.columns if c not in keys]
    lacking = F.coalesce(*[F.when(F.col(k).isNull(), F.monotonically_increasing_id()) for k in keys])
    one = rows.withColumn("__lacks", lacking).groupBy(*keys, "__lacks").agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]) if rest else rows.distinct()
    return _settled(table, one, _met(table, one, keys), keys, {c: F.col(f"__new_{c}") for c in names}, F.lit(True))


def bulk_update(table: DataFrame, rows: DataFrame, by: list[str], changes: list[str] | None = None) -> DataFrame:
    """One join on all keys in place of an update for each row; a row lacking a key column raises."""
    if missing := [k for k in by if k not in rows.columns]:
        raise ValueError(f"the rows lack {missing}")
    names = changes if changes is not None else [c for c in rows.columns if c not in by]
    return update_from(table, rows, by, {c: c for c in names})


def bulk_update_where(table: DataFrame, ids: DataFrame, key: str, changes: dict[str, Any]) -> DataFrame:
    """The same changes for all rows whose key is among the ids."""
    hit = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("__hit", F.lit(True))
    joined = table.join(hit, key, "left")
    return update(joined, changes, F.col("__hit")).select(*table.columns)


def bulk_delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return delete_using(table, ids.select(F.col(ids.columns[0]).alias(key)), [key])


bulk_delete_where = delete
