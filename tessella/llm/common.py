"""What the operators of this subpackage share: column picking, shared storage, row keys, Arrow row and word streams."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tessella"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where it is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(LOCAL_CHECKPOINTS)
    return LOCAL_CHECKPOINTS


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as compressed Parquet in the shared folder: its lineage is cut, its size is known to the planner, and a lost
    executor costs no recomputation of what came before."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the given types.

    Names are matched exactly, the first match wins, so further columns whose names differ in case only,
    or repeat, do no harm.
    """
    flat = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"__c{df.columns.index(c)}").cast(t).alias(c) for c, t in types.items()])


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by position, and the new name of each old one (of the first, where names repeat)."""
    flat = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return flat, {c: f"__c{df.columns.index(c)}" for c in df.columns}


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a (doc_id, text) pair; never null, equal for repeated rows."""
    return [
        F.xxhash64(F.lit(1), doc_id.isNull(), text.isNull(), doc_id, text).alias("__k1"),
        F.xxhash64(F.lit(2), text, text.isNull(), doc_id, doc_id.isNull()).alias("__k2"),
    ]


_KEPT: dict = {}


def worker_memory(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing at a time. A stage that asks for another lets the last go,
    so that the memories of stages that follow one another in one worker don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


@contextmanager
def without_collector() -> Iterator[None]:
    """Python's cycle collector off for a while: it walks large memories of strings again and again, and finds nothing
    where no cycles are made; what isn't used any more goes by its reference count."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def rows_of(batches: Iterator, step: int = 256) -> Iterator[list[list]]:
    """Python columns of small slices of Arrow batches, so that few texts are held as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [c.to_pylist() for c in part.columns]


#: Bytes of text that are handled at once, where a text isn't longer by itself.
SLICE = 2 << 20


def text_slices(batches: Iterator, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``size`` bytes in a text column, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def split_texts(texts: pa.Array, mark: str, pattern: bool = False) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts cut at a mark (at a pattern's matches): codes of all parts in order, the distinct parts, and where each text's parts end.

    Null texts count as empty.
    """
    cut = (pc.split_pattern_regex if pattern else pc.split_pattern)(pc.fill_null(texts, ""), mark)
    coded = cut.flatten().dictionary_encode()
    ends = cut.offsets.to_numpy()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), (ends[1:] - ends[0]).astype(np.int64)


def words_of(texts: pa.Array, not_word: str) -> tuple[np.ndarray, list[str], np.ndarray]:
    """``split_texts`` at a pattern, without empty parts."""
    codes, parts, ends = split_texts(texts, not_word, True)
    if "" in parts:
        kept = codes != parts.index("")
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        codes = codes[kept]
    return codes, parts, ends


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of lengths[i] items for each i, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
