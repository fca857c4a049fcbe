"""Near copies among documents: SimHash within a wide radius, verified exactly on five-word shingles.

Documents link where the similarity of their sets of five-word shingles is ``SIMILAR`` or more, computed from the
sets' 64-bit hashes. What is compared exactly are the pairs that a loose prefilter lets through: SimHash fingerprints
(of three-word shingles) that differ in at most ``RADIUS`` bits, and at least ``LOOSE`` of ``SIGNATURE`` one-byte
MinHash values in common. By the binomial law the signatures lose 2 in 100 million pairs at a similarity of 0.8, and
the fingerprints (bits taken as independent) 3 in 10,000 where a fifth of a text is cut off; fewer above.

Nodes are distinct sets (number of shingles, hash of the set). Similar sets have sizes alike, so nodes lie in
classes by the logarithm of their size to the base 1 / SIMILAR, and only a class and the next are compared. A class
is cut by hash into groups of at most about ``GROUP`` nodes; each pair of groups is one row with both groups' arrays,
dealt out by the pair, so no class, however large, meets in one task. In a pair of groups, nodes are sorted by
population count and compared in tiles by numpy exclusive-or and bit counts; pairs of tiles whose counts differ
beyond the radius are skipped.

What passes the prefilter is not listed pair by pair: a pair of groups gives a spanning forest of its candidates, and the
components of all forests are clusters, outside of which no pair passes. The distinct shingles of a cluster's nodes then
meet in blocks of about ``BLOCK`` hashes, in which every pair is decided exactly: a few pivots are compared with all
others, and of what they leave in several classes, the shingles in common are counted tile by tile, frequent ones in
bit maps, rare ones by their lists. A block gives a spanning forest too. Pairs within a cluster count even where they
don't pass the prefilter themselves. A cluster of more than one block is taken in two rounds: each block by itself,
beside some pivots of the cluster; then, of what several classes are left, the blocks of all smaller classes with one
another and with those of the largest. So no step makes a row for each pair, and no link is lost.

The comparisons still grow with the square of a class's nodes, and what is shuffled with that square divided by
``GROUP`` (in the second round, by the nodes in a block, for the part that the first leaves apart). Defined results: texts without words are copies of
one another; null text counts as empty; of each component the row with the smallest (doc_id, row key) stays, nulls
last; rows that repeat doc_id and text are one document, of which one row stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import narrow, positional, row_key, rows_of, spread, stored, worker_memory
from tessella.llm.decontaminate import WordHashes
from tessella.llm.simhash_dedup import components, fingerprint, spanning_forest

RADIUS = 20
SIMILAR = 0.8
SHINGLE = 5
SIGNATURE = 64
#: Values of the signature that a candidate pair has in common at least.
LOOSE = 32
GROUP = 131_072
TILE = 1024
#: Hashes of shingles in a block of a cluster, and nodes of a cluster that meet each of its blocks.
BLOCK, PIVOTS = 1 << 20, 4
#: Nodes of a block that are compared with all others before tiles are; nodes in such a tile.
TURNS, EXACT_TILE = 32, 256
#: Nodes that have a shingle, up to which it is rare; pairs that are listed at once for rare shingles.
RARE, LISTED = 8, 1 << 21
_LONGS = SIGNATURE // 8
_FACTORS = np.random.default_rng(5).integers(1, 2**63, SIGNATURE, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the five-word shingles (of the whole sequence, where it is shorter)."""
    words = (text or "").lower().split()
    t = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(t))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(t) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ t[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """A byte for each of SIGNATURE orders of the hashes, as longs."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[at : at + 4096, None] * _FACTORS).min(axis=0))
    least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (least >> np.uint64(56)).astype(np.uint8).view(np.int64)


def _signed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, __k1, __k2, node: [shingles, hash of the set, fingerprint, signature...]."""

    def run(batches):
        hashes = worker_memory(("hashes",), WordHashes)
        for ids, k1, k2, texts in rows_of(batches, 128):
            nodes = []
            for t in texts:
                h = shingle_hashes(t, hashes)
                whole, fp = xxhash.xxh3_64_intdigest(h.tobytes()), fingerprint(t)
                nodes.append([len(h), whole - (whole >> 63 << 64), fp - (fp >> 63 << 64), *signature(h).tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], names=["doc_id", "__k1", "__k2", "node"])

    return docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text").mapInArrow(run, "doc_id long, __k1 long, __k2 long, node array<long>")


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (the least place in each class) after links between places x and y."""
    own = np.arange(len(label))
    if forest := spanning_forest(label[x], label[y], len(label)):
        at, low = np.array(forest).T
        own[at] = low
    return own[label]


def candidate_forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids, tile by tile, that span the components of all pairs of rows [id, n, set, fp, signature...] of a and b that have
    near fingerprints and LOOSE signature values in common."""
    same = len(a) == len(b) and np.array_equal(a[:, 0], b[:, 0])
    a, b = (x[np.argsort(np.bitwise_count(x[:, 3].view(np.uint64)), kind="stable")] for x in (a.copy(), b.copy()))
    fa, fb = (np.ascontiguousarray(x[:, 3]).view(np.uint64) for x in (a, b))
    ca, cb = np.bitwise_count(fa).astype(int), np.bitwise_count(fb).astype(int)
    sa, sb = (np.ascontiguousarray(x[:, 4:]).view(np.uint8).reshape(len(x), -1) for x in (a, b))
    for i in range(0, len(a), TILE):
        p = slice(i, i + TILE)
        for j in range(i if same else 0, len(b), TILE):
            q = slice(j, j + TILE)
            if ca[p][0] > cb[q][-1] + RADIUS or cb[q][0] > ca[p][-1] + RADIUS:
                continue
            x, y = np.nonzero(np.bitwise_count(fa[p][:, None] ^ fb[q][None, :]) <= RADIUS)
            ids = np.concatenate([a[p, 0], b[q, 0]])
            # a row that is on both sides is one class from the start
            _, place, inverse = np.unique(ids, return_index=True, return_inverse=True)
            first = label = place[inverse]
            y = y + len(fa[p])
            for at in range(0, len(x), 65536):
                s, t = x[at : at + 65536], y[at : at + 65536]
                apart = label[s] != label[t]
                s, t = s[apart], t[apart]
                common = (sa[i + s] == sb[j + t - len(fa[p])]).sum(axis=1) >= LOOSE
                label = joined(label, s[common], t[common])
            at = np.nonzero(label != first)[0]
            if len(at):
                yield ids[at], ids[label[at]]


def _candidates(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of ids that span the components of all pairs that pass the prefilter. nodes: id, node."""
    size = F.when(F.element_at("node", 1) > 0, F.floor(F.log(F.element_at("node", 1).cast("double")) / math.log(1 / SIMILAR) + 1e-9)).otherwise(-2)
    placed = nodes.withColumn("class", size.cast("int"))
    groups = stored(placed.groupBy("class").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")), "classes")
    # at most a few hundred classes, as many as logarithms of text lengths
    count = {r["class"]: r["groups"] for r in groups.collect()}
    of = F.create_map(*[F.lit(x) for k, g in count.items() for x in (k, g)]) if count else F.create_map(F.lit(0), F.lit(1))
    dealt = placed.withColumn("g", F.pmod(F.xxhash64("id"), F.element_at(of, F.col("class"))).cast("int"))
    packed = stored(dealt.groupBy("class", "g").agg(F.flatten(F.collect_list(F.concat(F.array("id"), "node"))).alias("rows")), "groups")
    own, after = F.element_at(of, F.col("class")), F.coalesce(F.try_element_at(of, F.col("class") + 1), F.lit(0))
    before = F.coalesce(F.try_element_at(of, F.col("class") - 1), F.lit(0))
    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda c1, g1, c2, g2: F.struct(c1.alias("c1"), g1.alias("g1"), c2.alias("c2"), g2.alias("g2"))
    c, g, zero = F.col("class"), F.col("g"), F.lit(0)
    first = F.concat(F.transform(upto(g, own), lambda x: pair(c, g, c, x)), F.transform(upto(zero, after), lambda x: pair(c, g, (c + 1), x)))
    second = F.concat(F.transform(F.sequence(zero, g), lambda x: pair(c, x, c, g)), F.transform(upto(zero, before), lambda x: pair((c - 1), x, c, g)))
    key = ["c1", "g1", "c2", "g2"]
    left = packed.select(F.explode(first).alias("k"), "rows").select(*[f"k.{x}" for x in key], F.col("rows").alias("r1"))
    right = packed.select(F.explode(second).alias("k"), "rows").select(*[f"k.{x}" for x in key], F.col("rows").alias("r2"))
    both = left.join(right, key).select("r1", "r2")
    width = 4 + _LONGS

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy(zero_copy_only=False).reshape(-1, width) for c in batch.columns)
                for p, q in candidate_forest(x, y):
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _rare_in_common(p: np.ndarray, m: int, row: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each of the rows p and each of all m rows, how many codes they share. row, codes: rows and their codes, by code."""
    starts = np.nonzero(np.diff(codes, prepend=-1))[0]
    sizes = np.diff(starts, append=len(codes))
    place = np.full(m, -1)
    place[p] = np.arange(len(p))
    mine = np.nonzero(place[row] >= 0)[0]
    run = np.searchsorted(starts, mine, "right") - 1
    both = np.zeros(len(p) * m, np.int64)
    ends = np.cumsum(sizes[run])
    at = 0
    while at < len(mine):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LISTED, "right")))
        others = row[spread(starts[run[at:stop]], sizes[run[at:stop]])]
        both += np.bincount(np.repeat(place[row[mine[at:stop]]], sizes[run[at:stop]]) * m + others, minlength=len(both))
        at = stop
    return both.reshape(len(p), m)


def similar_classes(flat: np.ndarray, n: np.ndarray, left: int, label: np.ndarray) -> np.ndarray:
    """``label`` (the least place in each class) joined by the similar pairs among sets of distinct hashes: of all pairs
    where ``left`` is their number, else at least of the first ``left`` sets with the others. flat: the sets one after
    another; n: their sizes."""
    m = len(n)
    row = np.repeat(np.arange(m), n)
    codes = np.unique(flat, return_inverse=True)[1]
    shared = np.bincount(codes) > 1  # what one set has alone isn't in common with any
    kept = shared[codes]
    row, codes = row[kept], (np.cumsum(shared) - 1)[codes[kept]]
    count, starts = np.bincount(codes), np.searchsorted(row, np.arange(m + 1))
    todo = np.ones(m, bool)
    for turn in range(TURNS + 1):
        undone = np.nonzero(todo)[0]
        names, first, sizes = np.unique(label[undone], return_index=True, return_counts=True)
        if len(names) < 2:  # pairs of different classes have been compared, all of them
            return label
        if turn == TURNS:
            break
        p = undone[first[sizes.argmin()]]
        todo[p] = False
        has = np.zeros(len(count), bool)
        has[codes[starts[p] : starts[p + 1]]] = True
        both = np.bincount(row[has[codes]], minlength=m)
        # both / (one + other - both) >= 4 / 5
        near = np.nonzero(both * 9 >= (n + n[p]) * 4)[0]
        label = joined(label, near, np.full(len(near), p))
    often = count > RARE + m // 64
    width = -(-int(often.sum()) // 64) * 64
    place, frequent = np.cumsum(often) - 1, often[codes]
    bits = np.zeros((width // 64, m), np.uint64)
    for at in range(0, m, EXACT_TILE):
        s = slice(*starts[[at, min(m, at + EXACT_TILE)]])
        each = np.zeros((min(m, at + EXACT_TILE) - at, width), bool)
        each[row[s][frequent[s]] - at, place[codes[s][frequent[s]]]] = True
        bits[:, at : at + EXACT_TILE] = np.packbits(each, axis=1).view(np.uint64).T
    by_code = np.nonzero(~frequent)[0]
    by_code = by_code[np.argsort(codes[by_code], kind="stable")]
    rare = row[by_code], codes[by_code]
    undone = undone[np.argsort(n[undone], kind="stable")]
    one, other = (undone, undone) if left == m else (undone[undone < left], undone[undone >= left])
    for i in range(0, len(one), EXACT_TILE):
        p, few = one[i : i + EXACT_TILE], None
        for j in range(i if left == m else 0, len(other), EXACT_TILE):
            q = other[j : j + EXACT_TILE]
            # the smaller has four fifths of the larger's shingles at least
            if n[p[-1]] * 5 < n[q[0]] * 4 or n[q[-1]] * 5 < n[p[0]] * 4 or (label[p] == label[p[0]]).all() and (label[q] == label[p[0]]).all():
                continue
            few = _rare_in_common(p, m, *rare) if few is None else few
            both = few[:, q]
            for x in bits:
                u, v = x[p], x[q]
                if u.any() and v.any():
                    both += np.bitwise_count(u[:, None] & v[None, :])
            s, t = np.nonzero(both * 9 >= (n[p][:, None] + n[q][None, :]) * 4)
            label = joined(label, p[s], q[t])
    return label


def _shingles(members: DataFrame, docs: DataFrame) -> DataFrame:
    """id, cluster, shingles. members: id, cluster, __k1, __k2; docs: doc_id, text."""
    texts = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text").join(members, ["__k1", "__k2"]).select("id", "cluster", "text")

    def run(batches):
        hashes = worker_memory(("hashes",), WordHashes)
        for ids, clusters, words in rows_of(batches, 128):
            sets = [shingle_hashes(t, hashes).view(np.int64) for t in words]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clusters, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "cluster", "shingles"])

    return texts.mapInArrow(run, "id long, cluster long, shingles array<long>").dropDuplicates(["id"])


def _block_forest(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids that, with the links that made the labels, span the classes of a block. block: other, id, label, shingles, others last."""
    block = block.combine_chunks()
    sets, ids = block["shingles"].combine_chunks(), block["id"].to_numpy()
    flat, n = sets.flatten().to_numpy(zero_copy_only=False), sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, first, inverse = np.unique(block["label"].to_numpy(), return_index=True, return_inverse=True)
    others = int(np.sum(block["other"].to_numpy()))
    before = first[inverse]
    label = similar_classes(flat, n, len(n) - others, before)
    at = np.nonzero((before == np.arange(len(n))) & (label != before))[0]
    return ids[at], ids[label[at]]


def _similar(rows: DataFrame) -> DataFrame:
    """Links a, b that span, beside those that made the labels, the components of the similar pairs in each block:
    between rows that are ``other`` and such that aren't, or of all rows where none is. rows: cluster, i, j (these name a
    block), other, id, label, shingles."""
    dealt = rows.select("cluster", "i", "j", "other", "id", "label", "shingles").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "other")

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = np.array([batch.column(k).to_numpy() for k in range(3)], np.int64)
            cuts = [*np.nonzero(np.diff(keys, prepend=keys[:, :1] - 1).any(axis=0))[0].tolist(), batch.num_rows]
            found = []
            for a, b in pairwise(cuts):
                if held and tuple(keys[:, a]) != key:
                    found.append(_block_forest(pa.Table.from_batches(held)))
                    held = []
                key = tuple(keys[:, a])
                held.append(batch.slice(a, b - a))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _block_forest(pa.Table.from_batches(held))], names=["a", "b"])

    return stored(dealt.mapInArrow(run, "a long, b long"), "similar")


def _links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links a, b between ids of nodes whose components are those of all similar pairs of a cluster. nodes: id, node, place."""
    clusters = components(_candidates(nodes)).select(F.col("node").alias("__id"), F.col("label").alias("cluster"))
    members = nodes.join(clusters, F.col("id") == F.col("__id")).select("id", "cluster", F.element_at("node", 1).alias("n"), "place.__k1", "place.__k2")
    members = stored(members, "members")
    # clusters of several blocks are few: all of them have more than BLOCK hashes
    pivots = F.array_distinct(F.array(*[F.min_by("id", F.xxhash64(F.lit(k), "id")) for k in range(PIVOTS)]))
    large = stored(members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), pivots.alias("pivots")).where("blocks > 1"), "large")
    sets = _shingles(members.select("id", "cluster", "__k1", "__k2"), docs)
    if large.isEmpty():
        return _similar(sets.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("other"), F.col("id").alias("label")))
    dealt = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "id"), parts).cast("int")
    sets = stored(sets, "shingles").join(F.broadcast(large), "cluster", "left").withColumn("i", dealt("first", F.coalesce("blocks", F.lit(1))))
    inside = sets.select("cluster", "i", F.explode(F.when(F.array_contains("pivots", F.col("id")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("i"))).alias("at"), "id", "shingles")
    first = _similar(inside.select("cluster", F.col("at").alias("i"), F.col("at").alias("j"), F.lit(False).alias("other"), "id", F.col("id").alias("label"), "shingles"))
    label = components(first).select(F.col("node").alias("__id"), "label")
    named = sets.where("blocks IS NOT NULL").join(label, F.col("id") == F.col("__id"), "left").select("cluster", "id", F.coalesce("label", "id").alias("label"), "shingles")
    named = stored(named, "named")
    classes = named.groupBy("cluster", "label").agg(F.sum(F.size("shingles")).alias("n")).groupBy("cluster")
    largest = classes.agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("classes")).where("classes > 1")
    blocks = lambda x: F.greatest(F.ceil(x / BLOCK), F.lit(1)).cast("int")
    largest = stored(largest.select("cluster", F.col("most.label").alias("largest"), blocks(F.col("n") - F.col("most.n")).alias("small"), blocks(F.col("most.n")).alias("large")), "largest")
    placed = named.join(F.broadcast(largest), "cluster").withColumn("g", F.when(F.col("label") == F.col("largest"), F.col("small") + dealt("second", F.col("large"))).otherwise(dealt("second", F.col("small"))))
    upto = F.when(F.col("g") < F.col("small"), F.col("small") + F.col("large")).otherwise(F.col("small"))
    pairs = placed.withColumn("x", F.explode(F.sequence(F.lit(0), upto - 1))).withColumns({"i": F.least("g", "x"), "j": F.greatest("g", "x")})
    return first.union(_similar(pairs.withColumn("other", (F.col("i") != F.col("j")) & (F.col("g") == F.col("j")))))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of copies and near copies."""
    flat, name = positional(docs)
    doc_id, text = F.col(name["doc_id"]).cast("long"), F.col(name["text"]).cast("string")
    own = narrow(docs, doc_id="long", text="string")
    rows = stored(_signed_rows(own), "signed")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "__k1", "__k2")
    # one node for each set: equal numbers of shingles and equal hashes of the set
    nodes = rows.groupBy(F.slice("node", 1, 2)).agg(F.min(F.struct(place.alias("place"), "node")).alias("least")).select("least.*")
    nodes = stored(nodes.select(F.xxhash64("place.__k1", "place.__k2").alias("id"), "node", "place"), "nodes")
    label = components(_links(nodes, own))
    named = nodes.join(label, nodes["id"] == label["node"], "left").select(nodes["place"], F.coalesce("label", "id").alias("label"))
    kept = stored(named.groupBy("label").agg(F.min("place").alias("place")).select("place.__k1", "place.__k2"), "kept")
    keyed = flat.withColumns(dict(zip(("__k1", "__k2"), row_key(doc_id, text), strict=True)))
    # repeated rows have one key: they are told apart by nothing, so one of each kept key is taken
    return keyed.join(kept, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2").toDF(*docs.columns)
