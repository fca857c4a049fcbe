"""Exact top-k search by inner product: distributed histogram selection.

Vectors are quantised: each component x becomes floor(scale * x). Candidates are packed into blocks of ``ROWS`` and
queries into blocks of ``QUERIES``, each block one row; candidate blocks are dealt into cells, query blocks are sent to
every cell, and a join on the cell brings them together: no block of queries waits for another, and a task holds the
candidates of a cell while query blocks pass by. Every round scores everything by matrix products and counts, for each
query, the scores in ``BINS`` equal bins of the range in which its k-th score is known to lie. The bins of all tasks
are summed; the bin of the k-th score becomes the next range, until it holds one value. Then everything is scored
once more: scores above the k-th value stay, and of the scores equal to it the smallest ids, as many as are still
needed. From a pair of blocks a query needs at most the bins of its k highest scores there, and k rows: more are never
handed on, which loses nothing. The rounds depend on the range of scores alone, not on the number of queries.

Products are exact: in doubles while they are below 2**53, else in integers.

Defined results: vectors that are null, empty, or hold null, NaN or infinite components take no part, nor do rows
without id; vectors of different length don't meet. Every row counts, repeated ids and repeated rows too: a row is a
candidate of every query but itself, and each query row has its own result. Ties go to the smaller id; scores
outside of 64 bits are held at their ends; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import narrow, stored

K = 5
SCALE = 256
#: Queries and candidates in a block, and bins of a range: a comparison holds QUERIES x (ROWS + BINS) numbers.
QUERIES, ROWS, BINS = 512, 2048, 4096
#: Candidate blocks of a cell, and the most cells there are; beyond, cells have more blocks.
BLOCKS, CELLS = 4, 4096
_EXACT, _LONG = 1 << 53, (1 << 63) - 1


def usable_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v of the rows that take part."""
    v = F.col("v")
    return narrow(rows, **{vec_id: "long", vector: "array<double>"}).toDF("vec_id", "v").where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def _quantised(m: np.ndarray, scale: float) -> np.ndarray:
    """A matrix of whole numbers: doubles, or Python integers where doubles may be inexact in products."""
    with np.errstate(over="ignore"):
        q = np.floor(m * scale)
    top = float(np.abs(q).max(initial=0))
    if not math.isfinite(top) or top * top * m.shape[1] >= _EXACT:
        return np.array([[math.floor(scale * x) if math.isfinite(scale * x) else int(scale) * int(x) for x in v] for v in m.tolist()], object)
    return q


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, as doubles where they are exact, else as int64 held at the ends of 64 bits."""
    if q.dtype != object and c.dtype != object:
        top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
        if top < _EXACT:
            return q @ c.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(whole(q) @ whole(c).T, -_LONG - 1, _LONG).astype(np.int64)


def _widths(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """log2 of the width of the bins that cover lo to hi."""
    return np.array([max(0, (h - l).bit_length() - (BINS.bit_length() - 1)) for l, h in zip(lo.tolist(), hi.tolist(), strict=True)], np.int64)


def _bins(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The bin of each score, from 0; -1 out of lo to hi. Divisions by powers of two, so exact."""
    lo, hi, wide = lo[:, None], hi[:, None], wide[:, None]
    if s.dtype == np.float64 and (np.abs(lo) < _EXACT // 2).all() and (np.abs(hi) < _EXACT // 2).all():
        b = np.floor((s - lo) * np.ldexp(1.0, -wide)).astype(np.int64)
    else:
        s = s.astype(np.int64)
        b = ((np.where(s >= lo, s, lo).astype(np.uint64) - lo.astype(np.uint64)) >> wide.astype(np.uint64)).astype(np.int64)
    return np.where((s >= lo) & (s <= hi), b, -1)


def _matrix(values: pa.ListScalar, dims: int) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False).reshape(-1, dims)


def _packed(rows: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Blocks of at most about ``size`` rows of one length: dims, block, blocks (of the length), the columns as arrays and v flattened."""
    counts = F.broadcast(rows.groupBy("dims").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")))  # a row for each length of vectors
    dealt = rows.join(counts, "dims").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    lists = dealt.groupBy("dims", "blocks", "block").agg(F.collect_list(F.struct(*columns, "v")).alias("x"))
    return lists.select("dims", "blocks", "block", *[F.col(f"x.{c}").alias(c) for c in columns], F.flatten("x.v").alias("v"))


def _paired(state: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block of queries beside each block of candidates of its length."""
    cells = lambda n: F.least(F.ceil(n / BLOCKS), F.lit(CELLS)).cast("int")
    packed = _packed(state, QUERIES, ["row", "lo", "hi", "need"]).drop("blocks", "block").withColumnsRenamed({"row": "q_row", "v": "q_v"})
    sizes = F.broadcast(blocks.select("dims", cells(F.col("blocks")).alias("cells")).distinct())
    sent = packed.join(sizes, "dims").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    own = blocks.select("dims", F.pmod(F.col("block"), cells(F.col("blocks"))).alias("cell"), "row", "vec_id", F.col("v").alias("c_v"))
    return sent.hint("merge").join(own, ["dims", "cell"]).select("dims", "q_row", "lo", "hi", "need", "q_v", "row", "vec_id", "c_v")


def _compared(batches, scale: float):
    """Of each pair of blocks: queries' rows, lo, hi, need, candidates' ids, and scores (own rows marked by a mask)."""
    for batch in batches:
        for i in range(batch.num_rows):
            dims, *lists = (c[i] for c in batch.columns)
            q_row, lo, hi, need = (x.values.to_numpy() for x in lists[:4])
            row, ids = lists[5].values.to_numpy(), lists[6].values.to_numpy()
            s = _scores(_quantised(_matrix(lists[4], dims.as_py()), scale), _quantised(_matrix(lists[7], dims.as_py()), scale))
            yield q_row, lo, hi, need, ids, s, q_row[:, None] == row[None, :]


def _refined(state: DataFrame, blocks: DataFrame, k: int, scale: float) -> DataFrame:
    """The state after one round: lo, hi is the bin of the k-th score, need its place among the scores of that bin."""

    def count(batches):
        for q_row, lo, hi, need, _, s, own in _compared(batches, scale):
            wide = _widths(lo, hi)
            b = _bins(s, lo, hi, wide)
            b[own | (need == 0)[:, None]] = -1
            n = np.bincount((b + 1 + np.arange(len(lo))[:, None] * (BINS + 1)).ravel(), minlength=len(lo) * (BINS + 1)).reshape(len(lo), -1)[:, 1:]
            above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
            qi, bi = np.nonzero((n > 0) & (above < k))
            low = lo[qi] + (bi << wide[qi])
            yield pa.RecordBatch.from_arrays([pa.array(q_row[qi]), pa.array(low), pa.array(low + ((1 << wide[qi]) - 1)), pa.array(n[qi, bi])], names=["row", "lo", "hi", "n"])

    summed = _paired(state, blocks).mapInArrow(count, "row long, lo long, hi long, n long").groupBy("row", "lo", "hi").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("lo")))
    reached = summed.withColumn("upto", upto).select("row", F.col("lo").alias("new_lo"), F.col("hi").alias("new_hi"), "n", "upto")
    hit = state.select("row", F.col("need").alias("wanted")).join(reached, "row").where("upto >= wanted AND upto - n < wanted").select("row", "new_lo", "new_hi", (F.col("wanted") - F.col("upto") + F.col("n")).alias("new_need"))
    # a query that has fewer than k scores needs none: all stay
    found = F.col("new_need").isNotNull()
    new = lambda c: F.when(found, F.col(f"new_{c}"))
    return state.join(hit, "row", "left").select("row", "vec_id", "dims", "v", new("lo").otherwise(F.col("lo")).alias("lo"), F.when(found, F.least("new_hi", "hi")).otherwise(F.col("lo")).alias("hi"), F.coalesce("new_need", F.lit(0)).alias("need"))


def top_k(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", is_query: str = "vec_id % 50 = 0", k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates, all of them if fewer.

    ``is_query`` is a condition on ``vec_id``.
    """
    vectors = stored(usable_vectors(rows, vec_id, vector).withColumns({"row": F.monotonically_increasing_id(), "dims": F.size("v")}), "vectors")
    blocks = stored(_packed(vectors, ROWS, ["row", "vec_id"]), "blocks")
    widest = F.array_max(F.transform("v", F.abs)) * scale + 1
    tops = F.broadcast(vectors.groupBy("dims").agg(F.max(widest).alias("top")))  # a row for each length of vectors
    top = F.col("dims") * F.col("top") * widest * (1 + 1e-9) + 1
    end = F.when(top >= 9.2e18, F.lit(_LONG)).otherwise(F.least(top, F.lit(9.2e18)).cast("long"))
    state = stored(vectors.where(is_query).join(tops, "dims").select("row", "vec_id", "dims", "v", (-end - F.when(end == _LONG, 1).otherwise(0)).alias("lo"), end.alias("hi"), F.lit(k).cast("long").alias("need")), "state")
    while not state.where("need > 0 AND hi > lo").isEmpty():
        state = stored(_refined(state, blocks, k, scale), "state")

    def select(batches):
        for q_row, lo, _, need, ids, s, own in _compared(batches, scale):
            stays = ((s >= lo[:, None]) | (need == 0)[:, None]) & ~own
            qi, ci = np.nonzero(stays)
            score, names = s[qi, ci].astype(np.int64), ids[ci]
            order = np.lexsort((names, ~score, qi))
            qi, score, names = qi[order], score[order], names[order]
            kept = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            yield pa.RecordBatch.from_arrays([pa.array(q_row[qi[kept]]), pa.array(names[kept]), pa.array(score[kept])], names=["row", "vec_id", "score"])

    found = _paired(state, blocks).mapInArrow(select, "row long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.join(state.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.e) = len(q.e)),
n AS (SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 5
"""
