"""SimHash near-deduplication by tiled exact comparison.

Fingerprints: A-Z in lower case, words are runs of other characters than blank, tab and line ends, shingles are
``words`` consecutive words joined by one blank (the whole sequence where it is shorter), each hashed by XXH64
with seed 42; a bit is set where over half of the hashes have it. A text without words has fingerprint zero.

Fingerprints link at ``radius`` or fewer differing bits. Equal fingerprints are one node, its id their smallest
doc_id. Nodes are dealt into cells by the population counts of the four 16-bit quarters, a cell into packs of at most
about ``PACK`` fingerprints, and a pack into tiles of ``TILE``. Differing bits are at least the sum of the differences of
those counts, so only cells whose counts differ by the radius or less in sum are compared: each pair of their packs
once, dealt out by the pair, tile by tile, by numpy exclusive-or and bit counts. A comparison returns a spanning forest of the links it finds, not the links themselves:
no component is lost, and a dense group costs as many rows as it has members. Components then come from rounds of
smallest-neighbour labels with pointer jumping, each round written to the shared folder.

The number of tile pairs compared still grows with the square of the number of distinct fingerprints, as the
method does; the counts of the quarters leave a few hundredths of them at radius 3. What is shuffled is that number
divided by the fingerprints in a pack.

Defined results: null text counts as empty; a null doc_id is larger than any other and is the component's id only
where the component has no other; repeated rows give repeated results; further columns are ignored or passed on.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import narrow, row_key, rows_of, stored

RADIUS = 3
WORDS = 3
#: Fingerprints in a tile: a comparison of two tiles holds TILE x TILE x 9 bytes; and in a pack of tiles that is dealt out.
TILE, PACK = 2048, 65_536
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: The bytes that part words.
SPACES = b" \t\n\x0b\x0c\r"
_TO_LOWER = bytes.maketrans(bytes(range(65, 91)) + SPACES, bytes(range(97, 123)) + b" " * len(SPACES))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split(b" ")
    parts = [p for p in parts if p]
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = iter([digest(joined, 42)])
        n = 1
    else:
        ends = list(itertools.accumulate([len(p) + 1 for p in parts]))
        starts = [0, *ends]
        hashes = (digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :], strict=False))
        n = len(parts) - words + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        h = np.fromiter(itertools.islice(hashes, CHUNK), dtype=np.uint64, count=min(CHUNK, n - at))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, __k1, __k2 (the row's key), fp (the fingerprint as a signed long) of each row. docs: doc_id, text."""

    def run(batches):
        for ids, k1, k2, texts in rows_of(batches):
            fps = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(fps)], names=["doc_id", "__k1", "__k2", "fp"])

    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    return rows.mapInArrow(run, "doc_id long, __k1 long, __k2 long, fp long")


def _near_cells(radius: int) -> list[tuple[int, ...]]:
    """Differences of the quarters' counts up to the radius in sum, one of each pair of opposites, and none at all."""
    near = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0, 0, 0, 0)]


def spanning_forest(ii: np.ndarray, jj: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that span the components of the links ii, jj among n nodes: each node and the least one that it reaches."""
    label = np.arange(n)
    while len(ii):
        low = np.minimum(label[ii], label[jj])
        new = label.copy()
        np.minimum.at(new, ii, low)
        np.minimum.at(new, jj, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    at = np.nonzero(label != np.arange(n))[0]
    return list(zip(at.tolist(), label[at].tolist(), strict=True))


def linked_forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs (of a, followed by b) that span the same components as all links between a and b."""
    ii, jj = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    return spanning_forest(ii, jj + len(a), len(a) + len(b))


def near_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links a, b (fingerprints) that span the components of all pairs at the radius or nearer. nodes: distinct fp."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    cell = counts[0] + 17 * counts[1] + 289 * counts[2] + 4913 * counts[3]
    placed = nodes.select("fp", cell.cast("long").alias("cell"))
    # packs of at most about PACK, by hash; their number per cell follows from the cell's own count. There are 17**4 cells at most
    sizes = stored(placed.groupBy("cell").agg(F.ceil(F.count("*") / (PACK // 2)).cast("int").alias("packs")), "cells")
    packed = placed.join(F.broadcast(sizes), "cell").withColumn("pack", F.pmod(F.xxhash64("fp"), F.col("packs")).cast("int"))
    packs = stored(packed.groupBy("cell", "pack").agg(F.array_sort(F.collect_list("fp")).alias("fps")), "packs")

    quarters = [F.floor(F.col("cell") / 17**q) % 17 for q in range(4)]
    others = F.broadcast(sizes.select(F.col("cell").alias("other"), F.col("packs").alias("others")))

    def sent(sign: int, own: str, their: str) -> DataFrame:
        """Each pack once for each pair of packs that it is in: this side's cell and pack, the other side's, and fps."""
        steps = F.array(*[F.struct(*[F.lit(sign * x).alias(f"d{q}") for q, x in enumerate(d)]) for d in _near_cells(radius)])
        reached = [quarters[q] + F.col(f"d.d{q}") for q in range(4)]
        inside = reached[0].between(0, 16) & reached[1].between(0, 16) & reached[2].between(0, 16) & reached[3].between(0, 16)
        near = packs.select("cell", "pack", "fps", F.explode(steps).alias("d")).where(inside).withColumn("other", reached[0] + 17 * reached[1] + 289 * reached[2] + 4913 * reached[3])
        each = near.join(others, "other").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        # two packs of one cell meet once
        once = (F.col("cell") != F.col("other")) | (F.col("pack") <= F.col("at") if sign > 0 else F.col("at") <= F.col("pack"))
        return each.where(once).select(F.col("cell").alias(f"c{own}"), F.col("pack").alias(f"p{own}"), F.col("other").alias(f"c{their}"), F.col("at").alias(f"p{their}"), F.col("fps").alias(f"f{own}"))

    # dealt by the pair of packs: no cell, however full, meets in one task
    pairs = sent(1, "1", "2").join(sent(-1, "2", "1"), ["c1", "p1", "c2", "p2"]).select("f1", "f2")

    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                for i in range(0, len(a), TILE):
                    for j in range(0, len(b), TILE):
                        p, q = a[i : i + TILE], b[j : j + TILE]
                        both = np.concatenate([p, q]).view(np.int64)
                        for s, t in linked_forest(p, q, radius):
                            if both[s] != both[t]:
                                out_a.append(int(both[s]))
                                out_b.append(int(both[t]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label for each end of a link: the smallest node that it reaches, by rounds until nothing changes."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    edges = stored(both, "links")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        low = stored(labels.join(seen, labels["node"] == seen["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
        jump = low.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = stored(low.join(jump, low["label"] == jump["at"], "left").select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label != old").isEmpty():
            return labels


def cluster(rows: DataFrame, radius: int) -> DataFrame:
    """rows (doc_id, fp and more) with component_id."""
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    label = components(near_links(nodes.select("fp"), radius))
    named = nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = stored(named.groupBy("label").agg(F.min("least").alias("component_id")), "ids")
    by_fp = stored(named.select("fp", "label").join(ids, "label").select(F.col("fp").alias("__fp"), "component_id"), "classes")
    return rows.join(by_fp, F.col("fp") == F.col("__fp")).drop("__fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of each row."""
    rows = stored(fingerprints(narrow(docs, doc_id="long", text="string"), words), "fingerprints")
    return cluster(rows, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
