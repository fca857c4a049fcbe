"""Toxicity scores from the nearest labelled examples, by exact TF-IDF cosine over block-max inverted indexes.

Learning. Labelled documents whose crc32(doc_id as text) mod 4 is not 2 are examples; at most ``EXAMPLES`` of their
texts (the smallest by a hash: this bounds the model, and is a sample of the labelled rows only) are used. Copies, which
would pass for independent witnesses, are one: texts with equal values of ``SIGNATURE`` MinHash orders of their
five-word shingles count once, as toxic if one of them is. Units are words in lower case and their beginnings of
``PREFIX`` letters; a unit that a text has n times gives the terms (unit, 1) to (unit, n), up to ``LEVELS``. All terms
of ``LEAST`` or more examples make up the vocabulary. A term's weight is its idf times its log-likelihood ratio
against the label, less the 1 that chance gives on average; so terms that tell nothing weigh little or nothing, at
every size of the sample. A text's vector has the weights of its terms, at length 1.

Scoring. Examples lie in blocks of ``BLOCK``, alike ones (by their heaviest term) next to one another; the index holds
for each term its examples and weights, block by block, and its largest weight in each block. The blocks with the
highest bounds are scored first; then all those whose bound reaches the ``NEIGHBOURS``-th best cosine so far (all at
once, where most do): so the neighbours are exact, ties by the example's number. Their labels vote with weight cosine squared, together with a
prior of one vote (the share of toxic examples). A logistic curve turns votes into probabilities; it is fitted to the
votes that examples get from models of the other folds, whose weights they had no part in. The nearest examples are
passed on as evidence.

Texts are scored whole, in one pass without shuffle; the model is sent to the tasks, its size bounded by the examples'
terms. Defined results: null and empty texts have no term and get the prior's score; without examples of both labels
every score is 0; a row gives a row; null ids are not held out; several labels of one id: toxic if one says so; null
labels don't count; further columns are ignored or passed on.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import narrow, positional, rows_of, spread, stored, text_slices, words_of, worker_memory

EXAMPLES = 4096
#: Examples that must have a term.
LEAST = 3
BLOCK = 64
#: Blocks that are scored first.
FIRST = 2
NEIGHBOURS = 15
EVIDENCE = 3
FOLDS = 5
THRESHOLD = 0.3
SHINGLE = 5
SIGNATURE = 4
#: Letters of the beginnings of words that are units too.
PREFIX = 5
LEVELS = 3
#: Words whose units a worker remembers.
CACHE = 100_000
#: What parts words.
NOT_WORD = r"[^\p{L}\p{N}_]+"


def units_of(word: str) -> tuple[str, ...]:
    return (word, f"{word[:PREFIX]}*") if len(word) > PREFIX else (word,)


def term_weights(examples: list[np.ndarray], toxic: np.ndarray, terms: int) -> np.ndarray:
    """idf times the log-likelihood ratio of each term, as far as that is above what chance gives."""
    of = np.repeat(toxic, list(map(len, examples)))
    flat = np.concatenate(examples) if examples else np.zeros(0, np.int64)
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], np.float64)
    seen = np.stack([np.bincount(flat[of == k], minlength=terms) for k in (0, 1)]).astype(np.float64)
    both, total = seen.sum(axis=0), n.sum()
    ratio = np.zeros(terms)
    for k in (0, 1):
        for have, share in ((seen[k], both), (n[k] - seen[k], total - both)):
            there = have > 0
            ratio[there] += 2 * have[there] * np.log(have[there] * total / (n[k] * share[there]))
    return (np.log((1 + total) / (1 + both)) + 1) * np.maximum(ratio - 1, 0)


@dataclass
class Model:
    vocabulary: dict[str, tuple[int, int]]  #: of each unit: its first term and how many levels it has
    weight: np.ndarray  #: of each term
    ids: np.ndarray  #: doc_id of each example
    toxic: np.ndarray
    starts: np.ndarray  #: postings of each term and block: terms x blocks, flat, and the end
    examples: np.ndarray  #: postings: numbers of examples, ascending in a term
    weights: np.ndarray
    block_max: np.ndarray  #: terms x blocks
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)  #: tells models apart in a worker

    def vector(self, terms: np.ndarray) -> np.ndarray:
        """Weights at length 1 of ascending terms."""
        w = self.weight[terms]
        return w / (math.sqrt(float(w @ w)) or 1.0)

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray | None = None) -> np.ndarray:
        """Cosines of the examples of some blocks, zero elsewhere; of all, if none are given."""
        width = self.block_max.shape[1]
        if blocks is None:
            first, last = self.starts[terms * width], self.starts[(terms + 1) * width]
        else:
            cells = (terms[:, None] * width + blocks).ravel()
            first, last, weights = self.starts[cells], self.starts[cells + 1], np.repeat(weights, len(blocks))
        at = spread(first, last - first)
        return np.bincount(self.examples[at], np.repeat(weights, last - first) * self.weights[at], len(self.ids))

    def neighbours(self, terms: np.ndarray) -> list[tuple[float, int]]:
        """The best (cosine, example) with a cosine over 0, best first; ties in ascending order of the example. terms: ascending."""
        terms = terms[self.weight[terms] > 0]
        if not len(terms) or not len(self.ids):
            return []
        weights = self.vector(terms)
        bound = np.einsum("t,tb->b", weights, self.block_max[terms]) * (1 + 1e-5)
        order = np.argsort(-bound, kind="stable")
        scores = self._scores(terms, weights, np.sort(order[:FIRST]))
        least = np.partition(scores, -NEIGHBOURS)[-NEIGHBOURS] if len(scores) > NEIGHBOURS else 0.0
        rest = order[FIRST:]
        rest = np.sort(rest[(bound[rest] >= least) & (bound[rest] > 0)])
        if len(rest) * 3 > len(order):
            scores = self._scores(terms, weights)
        elif len(rest):
            scores += self._scores(terms, weights, rest)
        cut = np.partition(scores, -NEIGHBOURS)[-NEIGHBOURS] if len(scores) > NEIGHBOURS else 0.0
        some = np.nonzero((scores >= cut) & (scores > 0))[0]
        best = some[np.lexsort((some, -scores[some]))][:NEIGHBOURS]
        return [(float(scores[x]), int(x)) for x in best]

    def vote(self, near: list[tuple[float, int]]) -> float:
        return (sum(c * c * self.toxic[x] for c, x in near) + self.prior) / (sum(c * c for c, _ in near) + 1)

    def score(self, near: list[tuple[float, int]]) -> float:
        z = self.slope * _logit(self.vote(near)) + self.shift
        return float(1 / (1 + math.exp(-z)))

    def terms(self, units: np.ndarray) -> np.ndarray:
        """Ascending terms of a text's units: numbers of first terms, with the level count in the low bits, one for each use."""
        found, times = np.unique(units, return_counts=True)
        return spread(found // (LEVELS + 1), np.minimum(times, found % (LEVELS + 1)))

    def terms_of(self, texts: pa.Array, memory: dict[str, np.ndarray]) -> list[np.ndarray]:
        """The terms of each text. memory: the units of words met before, as numbers."""
        codes, words, ends = words_of(pc.utf8_lower(pc.fill_null(texts, "")), NOT_WORD)
        if len(memory) > CACHE:
            memory.clear()
        get, own = memory.get, []
        for w in words:
            units = get(w)
            if units is None:
                units = memory[w] = np.array([first * (LEVELS + 1) + n for u in units_of(w) if (x := self.vocabulary.get(u)) for first, n in (x,)], np.int64)
            own.append(units)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.concatenate([np.zeros(0, np.int64), *own])
        units = flat[spread((np.cumsum(sizes) - sizes)[codes], sizes[codes])]
        cuts = np.concatenate([[0], np.cumsum(sizes[codes])])[ends].tolist()
        return [self.terms(units[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _signature(words: list[str]) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    shingles = {" ".join(words[i : i + SHINGLE]).encode() for i in range(max(1, len(words) - SHINGLE + 1))}
    return [min(digest(x, seed) for x in shingles) >> 1 for seed in range(SIGNATURE)]


def _example_units(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, units, counts of the examples, EXAMPLES rows at most."""
    own = narrow(labels, doc_id="long", toxic="int").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    learn = own.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = stored(learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES), "sample")
    # no more than EXAMPLES rows of two numbers are sent
    texts = narrow(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id")
    # several texts of one id: the bound holds for texts too
    texts = stored(texts.orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "doc_id").limit(EXAMPLES), "sampled")

    def run(batches):
        for batch in text_slices(batches, 1):
            codes, words, ends = words_of(pc.utf8_lower(pc.fill_null(batch.column(1), "")), NOT_WORD)
            out = {"doc_id": batch.column(0), "toxic": batch.column(2), "near": [], "units": [], "counts": []}
            for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                found = [words[c] for c in codes[a:b].tolist()]
                n: Counter[str] = Counter()
                for w, times in Counter(found).items():
                    for u in units_of(w):
                        n[u] += times
                out["near"].append(_signature(found))
                out["units"].append(list(n))
                out["counts"].append([min(x, LEVELS) for x in n.values()])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("near", pa.list_(pa.int64())), ("units", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))]))

    each = stored(texts.repartition(8).mapInArrow(run, "doc_id long, toxic int, near array<long>, units array<string>, counts array<int>"), "units")
    return each.groupBy("near").agg(F.min_by(F.struct("doc_id", "units", "counts"), F.struct("doc_id", F.hash("units"))).alias("x"), F.max("toxic").alias("toxic")).select("x.doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), "x.units", "x.counts")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of the labelled rows that aren't held out."""
    rows = stored(_example_units(docs, labels), "examples")
    pairs = rows.select(F.explode(F.arrays_zip(F.col("units").alias("unit"), F.col("counts").alias("n"))).alias("p")).select("p.unit", "p.n")
    # how many levels of a unit LEAST examples have; the units of EXAMPLES texts at most come to the driver
    levels = pairs.groupBy("unit").agg(*[F.count_if(F.col("n") >= k).alias(f"l{k}") for k in range(1, LEVELS + 1)])
    levels = levels.select("unit", sum((F.col(f"l{k}") >= LEAST).cast("int") for k in range(1, LEVELS + 1)).alias("levels")).where("levels > 0")
    vocabulary: dict[str, tuple[int, int]] = {}
    terms = 0
    for unit, n in sorted(map(tuple, levels.collect())):
        vocabulary[unit] = terms, n
        terms += n
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = sent.value
        for ids, toxic, units, counts in rows_of(batches, 64):
            own = [sorted(known[u][0] + k for u, n in zip(us, ns, strict=True) if u in known for k in range(min(n, known[u][1]))) for us, ns in zip(units, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    found = sorted(map(tuple, rows.select("doc_id", "toxic", "units", "counts").mapInArrow(run, "doc_id long, toxic int, terms array<int>").collect()))
    sent.unpersist()
    ids, toxic = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
    return fitted(vocabulary, terms, ids, toxic, [np.array(x[2], np.int64) for x in found])


def fitted(vocabulary: dict[str, tuple[int, int]], terms: int, ids: np.ndarray, toxic: np.ndarray, examples: list[np.ndarray]) -> Model:
    """The model of examples, calibrated on votes of models that the example had no part in."""
    weight = term_weights(examples, toxic, terms)
    # units without any weight go, so that what is sent to the tasks is small
    kept: dict[str, tuple[int, int]] = {}
    new, n_kept = np.full(terms, -1, np.int64), 0
    for unit, (first, n) in vocabulary.items():
        if (weight[first : first + n] > 0).any():
            kept[unit] = n_kept, n
            new[first : first + n] = np.arange(n_kept, n_kept + n)
            n_kept += n
    model = indexed(kept, n_kept, ids, toxic, [np.sort(new[x][new[x] >= 0]) for x in examples])
    if len(np.unique(toxic)) < 2:
        model.shift = -math.inf
        return model
    fold = np.array([zlib.crc32(f"fold {i} {n}".encode()) % FOLDS for n, i in enumerate(ids.tolist())])
    x = np.zeros(len(ids))
    for f in range(FOLDS):
        rest, own = np.nonzero(fold != f)[0], np.nonzero(fold == f)[0]
        other = indexed(vocabulary, terms, ids[rest], toxic[rest], [examples[i] for i in rest])
        x[own] = [_logit(other.vote(other.neighbours(examples[i]))) for i in own]
    # logistic curve by Newton's method, with a little shrinkage towards the identity
    slope, shift = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - toxic) * x).sum() + (slope - 1), (p - toxic).sum() + shift])
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = max(0.05, float(slope)), float(shift)
    return model


def indexed(vocabulary: dict[str, tuple[int, int]], terms: int, ids: np.ndarray, toxic: np.ndarray, examples: list[np.ndarray]) -> Model:
    """The block-max index of examples (ascending terms of each), not calibrated."""
    weight = term_weights(examples, toxic, terms)
    examples = [x[weight[x] > 0] for x in examples]
    vectors = []
    for x in examples:
        w = weight[x]
        vectors.append(w / (math.sqrt(float(w @ w)) or 1.0))
    heaviest = np.array([x[int(v.argmax())] if len(x) else -1 for x, v in zip(examples, vectors, strict=True)], np.int64)
    order = np.lexsort((np.arange(len(examples)), heaviest))
    blocks = max(1, -(-len(examples) // BLOCK))
    number = np.repeat(np.arange(len(order)), [len(examples[i]) for i in order]) if len(order) else np.zeros(0, np.int64)
    term = np.concatenate([np.zeros(0, np.int64), *[examples[i] for i in order]])
    value = np.concatenate([np.zeros(0), *[vectors[i] for i in order]]).astype(np.float32)
    at = np.lexsort((number, term))
    number, term, value = number[at], term[at], value[at]
    cell = term * blocks + number // BLOCK
    block_max = np.zeros(terms * blocks, np.float32)
    np.maximum.at(block_max, cell, value)
    starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=terms * blocks))])
    prior = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.0
    return Model(vocabulary, weight, ids[order], toxic[order], starts.astype(np.int32), number.astype(np.int16), value, block_max.reshape(terms, blocks), float(prior))


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score", evidence: str = "evidence") -> DataFrame:
    """docs with the score of each row and the doc_ids of its nearest examples, best first, as last columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(evidence, T.ArrayType(T.LongType()))])

    def run(batches):
        m, memory = sent.value, worker_memory(("units", sent.value.name), dict)
        for batch in text_slices(batches, at):
            scores, why = [], []
            for terms in m.terms_of(batch.column(at), memory):
                near = m.neighbours(terms)
                scores.append(0.0 if m.shift == -math.inf else m.score(near))
                why.append([int(m.ids[x]) for _, x in near[:EVIDENCE]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(why, pa.list_(pa.int64()))], names=[*batch.schema.names, score, evidence])

    return docs.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of each row."""
    rows = narrow(docs, doc_id="long", text="string")
    scored = score_documents(rows, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    flat, name = positional(docs)
    scored = score_documents(flat, fit(docs, labels), name["text"], "__score", "__evidence")
    return scored.where(F.col("__score") < threshold).drop("__score", "__evidence").toDF(*docs.columns)
