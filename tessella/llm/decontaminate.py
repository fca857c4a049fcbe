"""Benchmark decontamination by spaced-seed hashing.

Texts become words (runs of letters, digits and underscores, in lower case). A document and a benchmark item overlap
where a window of consecutive words of each agrees but for few of them. Windows have ``WINDOW`` words, or all words of
a shorter item; a window of n words may differ in ``allowed(n)`` of them, 2 of 13, 1 of 7 to 12, none of fewer. A window
is cut into parts, two more than may differ, and every mask looks at some of them and ignores the others: the masks are
all choices of two parts, so whichever positions differ, two parts are whole and the mask of those two hits: no overlap
is missed. Windows that may not differ have one mask, of all their words.

Test and training hashes meet in a join. Before it, a bit table of bounded size (``FILTER_BITS``), sent to all tasks,
drops windows whose hashes no item has; however many items there are, it only lets more windows through. Hits
carry the words of their window as 64-bit hashes, and the join verifies each distinct window once, whatever the items
that hold it; what is verified then meets all items of its window.

Defined results: null texts and texts without words overlap nothing; items with the same words are one, under their
smallest id; rows with equal doc_id and text are one document, several texts of one doc_id have results of their own;
null item ids are left out; further columns are ignored or passed on.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import narrow, positional, row_key, stored, text_slices, words_of, worker_memory

WINDOW = 13
SUBSTITUTIONS = 2
#: log2 of the bits of the table that windows pass first, about 64 for each hash of the items: 2 to 16 MB.
FILTER_BITS = (24, 27)
#: Words whose hash a worker remembers.
CACHE = 300_000
NOT_WORD = r"[^\p{L}\p{N}_]+"
_MIX = 0x9E3779B97F4A7C15


def allowed(size: int) -> int:
    """Words of a window that may differ."""
    return size * SUBSTITUTIONS // WINDOW


def masks(size: int) -> list[tuple[tuple[int, int], ...]]:
    """The masks of a window: the parts (first position and end) that each looks at."""
    if not allowed(size):
        return [((0, size),)]
    n = allowed(size) + 2
    cuts = [size * i // n for i in range(n + 1)]
    return list(itertools.combinations(list(zip(cuts, cuts[1:], strict=False)), 2))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def tokens(texts: pa.Array, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and where each text's words end; null texts count as empty."""
    codes, words, ends = words_of(pc.utf8_lower(pc.fill_null(texts, "")), NOT_WORD)
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))[codes], ends


def _run_hashes(t: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = len(t) - length + 1
    h = np.full(n, (salt + 1) * _MIX & (1 << 64) - 1, np.uint64)
    for i in range(length):
        h = (h ^ t[i : i + n]) * np.uint64(_MIX)
        h ^= h >> np.uint64(29)
    return h


def seeds(t: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[int, np.ndarray]]:
    """(words of the window, hash at each position) for each mask of each size."""
    out = []
    for size in sizes:
        n = len(t) - size + 1
        if n < 1:
            continue
        parts: dict[tuple[int, int], np.ndarray] = {}
        for mask in masks(size):
            h = np.full(n, size, np.uint64)
            for a, b in mask:
                if (a, b) not in parts:
                    parts[a, b] = _run_hashes(t[a : b - 1 + n], b - a, a)[:n]
                h = h * np.uint64(0xC2B2AE3D27D4EB4F) + parts[a, b]
            out.append((size, h ^ (h >> np.uint64(31))))
    return out


def _item_seeds(items: DataFrame) -> DataFrame:
    """item_id, whole (a hash of all its words), size (words of the window), h, words (the window's word hashes). items: item_id, text."""

    def run(batches):
        hashes = worker_memory(("hashes",), WordHashes)
        for batch in text_slices(batches, 1):
            out = {"item_id": [], "whole": [], "size": [], "h": [], "words": []}
            every, ends = tokens(batch.column(1), hashes)
            for item, a, b in zip(batch.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                t = every[a:b]
                signed = t.view(np.int64)
                whole = xxhash.xxh3_64_intdigest(t.tobytes()) >> 1
                for size, h in seeds(t, (min(len(t), WINDOW),) if len(t) else ()):
                    out["item_id"] += [item] * len(h)
                    out["whole"] += [whole] * len(h)
                    out["size"] += [size] * len(h)
                    out["h"] += h.view(np.int64).tolist()
                    out["words"] += [signed[i : i + size].tolist() for i in range(len(h))]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item_id", pa.int64()), ("whole", pa.int64()), ("size", pa.int32()), ("h", pa.int64()), ("words", pa.list_(pa.int64()))]))

    return items.mapInArrow(run, "item_id long, whole long, size int, h long, words array<long>")


def _bit_table(spark: SparkSession, item_seeds: DataFrame):
    """The table as a broadcast, and log2 of its bits; at most 2 ** 27 / 64 numbers come to the driver, whatever the items."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (64 * item_seeds.count()).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    words = item_seeds.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for row in words.toLocalIterator():
        table[row["w"]] = row["bits"]
    return spark.sparkContext.broadcast(table.view(np.uint64)), bits


def windows_of(benchmark: DataFrame) -> DataFrame:
    """item_id, whole, size, h, words, window (a hash of the words) of the items' windows."""
    items = narrow(benchmark, item_id="long", text="string").where("item_id IS NOT NULL")
    return stored(_item_seeds(items).withColumn("window", F.xxhash64("size", "words")), "windows")


def overlaps(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, __k1, __k2, window, at (the word at which an overlapping window starts), size, same (words that agree)."""
    spark = docs.sparkSession
    # one row for each distinct window and hash, so that equal passages of items aren't multiplied
    item_seeds = stored(windows.groupBy("h", "size", "words").agg(F.min("window").alias("window")), "seeds")
    sizes = tuple(sorted(r["size"] for r in item_seeds.select("size").distinct().collect()))  # at most WINDOW
    table, width = _bit_table(spark, item_seeds)
    kinds = pa.schema([("doc_id", pa.int64()), ("__k1", pa.int64()), ("__k2", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("h", pa.int64()), ("own", pa.list_(pa.int64()))])

    def run(batches):
        hashes, bits = worker_memory(("hashes",), WordHashes), table.value
        for batch in text_slices(batches, 3):
            t, ends = tokens(batch.column(3), hashes)
            begins = np.concatenate([[0], ends[:-1]])
            doc = np.repeat(np.arange(len(ends)), ends - begins)
            for size, h in seeds(t, sizes):
                at = h >> np.uint64(64 - width)
                hit = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
                # windows don't reach over the end of a text
                i = np.nonzero(hit & (doc[: len(h)] == doc[size - 1 :]))[0]
                own = t.view(np.int64)[(i[:, None] + np.arange(size)).ravel()]
                values = [*(batch.column(k).take(pa.array(doc[i])) for k in range(3)), pa.array(i - begins[doc[i]], pa.int32()), pa.array(np.full(len(i), size), pa.int32()), pa.array(h[i].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*values, pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * size, pa.int32()), pa.array(own))], schema=kinds)

    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    hits = rows.mapInArrow(run, "doc_id long, __k1 long, __k2 long, at int, size int, h long, own array<long>")
    same = F.aggregate(F.zip_with("own", "words", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    met = hits.join(item_seeds.withColumnRenamed("size", "its"), "h").where("size = its").withColumn("same", same)
    return met.where(F.col("size") - F.col("same") <= F.floor(F.col("size") * SUBSTITUTIONS / WINDOW)).select("doc_id", "__k1", "__k2", "window", "at", "size", "same")


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (starts of overlapping windows), first_word, last_word (from 0), most_same, for each document and item that overlap."""
    windows = windows_of(benchmark)
    # a window is hit by several masks: pre-aggregated by document and window before it meets its items
    place = F.struct("at", "size", "same")
    met = overlaps(narrow(docs, doc_id="long", text="string"), windows).groupBy("doc_id", "__k1", "__k2", "window").agg(F.collect_set(place).alias("places"))
    named = windows.groupBy("whole").agg(F.min("item_id").alias("item_id"))
    owners = stored(windows.select("whole", "window").distinct().join(named, "whole").select("window", "item_id").distinct(), "owners")
    key = ["doc_id", "__k1", "__k2", "item_id"]
    pairs = met.join(owners, "window").select(*key, F.explode("places").alias("p")).select(*key, "p.*")
    once = pairs.groupBy(*key, "at").agg(F.max("same").alias("same"), F.max("size").alias("size"))
    return once.groupBy(*key).agg(F.count("*").alias("n_windows"), F.min("at").alias("first_word"), F.max(F.col("at") + F.col("size") - 1).alias("last_word"), F.max("same").alias("most_same")).drop("__k1", "__k2")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that overlap a benchmark item."""
    flat, name = positional(docs)
    doc_id, text = F.col(name["doc_id"]).cast("long"), F.col(name["text"]).cast("string")
    bad = stored(overlaps(narrow(docs, doc_id="long", text="string"), windows_of(benchmark)).groupBy("__k1", "__k2").agg(F.lit(1).alias("__one")), "contaminated").select("__k1", "__k2")
    keyed = flat.withColumns(dict(zip(("__k1", "__k2"), row_key(doc_id, text), strict=True)))
    return keyed.join(bad, ["__k1", "__k2"], "left_anti").drop("__k1", "__k2").toDF(*docs.columns)
