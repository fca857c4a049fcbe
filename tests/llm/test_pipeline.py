"""The corpus pipeline as a whole against plain versions of its stages."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_native import dedup
from test_texts import REFERENCE
from test_vectors_and_copies import overlapping

from tessella.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
BAD = ["vile", "awful", "nasty", "rotten"]


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def without_copies(rows):
    """One row of each component of texts whose five-word shingles are similar to 0.8 or more; copies are one."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[j], label[i]
                label = [a if x == b else x for x in label]
    return [rows[k] for k in sorted({label.index(x) for x in label})]


def written(spark, path, docs, labels, benchmark):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5) for i, t in docs], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def corpus():
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 500))
    passage = [word() for _ in range(20)]
    docs, labels = [], []
    for i in range(220):
        lines = [" ".join(word() for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(4, 12))]
        if i % 5 == 0:
            lines[0] += " " + " ".join(rng.choice(BAD) for _ in range(4))
        if i % 7 == 1:
            lines[2:2] = ["shared header", "of many documents", "in three lines"]
        if i % 11 == 2:
            lines.append(" ".join([*passage[:9], "other", *passage[10:]]))
        docs.append((i, "\n".join(lines)))
        if i < 150:
            labels.append((i, 1, int(i % 5 == 0)))
    for i in range(0, 200, 9):  # near copies: a few words at the end go, and line ends are blanks
        docs.append((300 + i, " ".join(docs[i][1].replace("\n", " ").split()[:-3])))
    docs += [(500, None), (501, ""), (502, "w " * 30000), (None, "nobody's text of a few words"), (3, docs[3][1]), (3, docs[3][1])]
    return docs, labels, [(1, " ".join(passage)), (2, None), (None, "a b c d e f"), (3, "unique words " * 9)]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    docs, labels, benchmark = corpus()
    path = written(spark, str(tmp_path), docs, labels, benchmark)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, path).where("doc_id IS NOT NULL").collect())
    read = lambda t: spark.read.parquet(f"{path}/{t}.parquet")
    toxic = {(r["doc_id"]) for r in toxicity.toxicity_scores(read("documents"), read("labels")).where("predicted = 1").collect()}
    assert len(toxic & set(range(0, 220, 5))) >= 40 and len(toxic - set(range(0, 220, 5)) - set(range(300, 520))) <= 4
    kept = [(i, t) for i, t in docs if i not in toxic]
    cut = dedup(kept)
    kept = without_copies([(i, t if t is None else cut[i, t]) for i, t in kept])
    bad = {d for d, _ in overlapping(kept, benchmark)}
    want = []
    for i, t in kept:
        if i not in bad and i is not None:
            ids = REFERENCE.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want) and 100 < len(want) < 200


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs, labels, benchmark = corpus()
    path = written(spark, str(tmp_path), docs[:12], labels, benchmark)
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for some in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, path)
            assert out.columns == (frame.columns if name != "byte_bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            rows = out.collect()
            assert bool(rows) == (some is frame)


def test_near_copy_recall_against_all_pairs(spark):
    """Texts changed in a random share of words, all pairs compared exactly: every link is found."""
    from tessella.llm import near_copies

    rng = random.Random(22)
    rows = []
    for g in range(60):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 900)) for _ in range(rng.randint(30, 260))]
        rows.append(" ".join(base))
        for _ in range(4):
            w, share = list(base), rng.choice([0.002, 0.01, 0.02, 0.03])
            for k in range(len(w)):
                if rng.random() < share:
                    w[k] = "changed" + str(rng.randint(0, 9))
            rows.append(" ".join(w[: len(w) - rng.randint(0, len(w) // 8)]))
    rows = list(enumerate(rows))
    got = sorted(r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [i for i, _ in without_copies(rows)] and len(got) < 250
    assert public_tokenizers.PATTERN  # the pipeline's own pattern is there


def similar_group(rng, n, size, changes):
    """n texts of about ``size`` words, each of which differs from one base in ``changes`` words of its own."""
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 900)) for _ in range(size)]
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(size), changes(i)):
            w[k] = f"own{i}x{k}"
        yield " ".join(w)


@pytest.mark.parametrize("block", [1 << 20, 9000, 1500])
def test_no_rows_for_pairs_of_a_large_group(spark, monkeypatch, block):
    """A group whose texts are alike, but mostly below the bound: links are those of all pairs, and no step has a row for each pair."""
    from tessella.llm import near_copies, simhash_dedup

    rng = random.Random(23)
    texts = [*similar_group(rng, 90, 120, lambda i: 3 + i % 3), *similar_group(rng, 60, 100, lambda i: i % 4), *similar_group(rng, 3, 80, lambda i: 1)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_copies, "BLOCK", block, raising=False)
    monkeypatch.setattr(near_copies, "TURNS", 6, raising=False)
    monkeypatch.setattr(near_copies, "EXACT_TILE", 16, raising=False)
    counts = {}
    for module in (near_copies, simhash_dedup):

        def counted(df, kind, stored=module.stored):
            out = stored(df, kind)
            counts[kind] = max(counts.get(kind, 0), out.count())
            return out

        monkeypatch.setattr(module, "stored", counted)
    got = sorted(r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [i for i, _ in without_copies(rows)] and 20 < len(got) < 120
    # links both ways; some nodes in every block
    assert max(counts.values()) <= 6 * len(rows), counts


def test_similar_classes_are_those_of_all_pairs():
    """Bit maps of frequent shingles, lists of rare ones and pivots give what plain sets give, of all pairs or across two sides."""
    from tessella.llm import near_copies

    rng = np.random.default_rng(24)
    for case in range(60):
        base = rng.integers(0, 1 << 60, 40 + 10 * (case % 5))
        sets = [np.unique(np.concatenate([rng.permutation(base)[: len(base) - rng.integers(0, 9)], rng.integers(0, 50 if case % 2 else 1 << 60, rng.integers(0, 9))])) for _ in range(5 + 3 * case)]
        m = len(sets)
        left = m if case % 3 else m // 3
        plain = [frozenset(s.tolist()) for s in sets]
        links = [(i, j) for i in range(m) for j in range(i) if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]) and (left == m or (j < left <= i))]
        least = near_copies.joined(np.arange(m), *np.array(links, np.int64).reshape(-1, 2).T)
        more = [(i, j) for i in range(m) for j in range(i) if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])]
        most = near_copies.joined(np.arange(m), *np.array(more, np.int64).reshape(-1, 2).T)
        near_copies.TURNS, turns = case % 4, near_copies.TURNS
        try:
            got = near_copies.similar_classes(np.concatenate(sets), np.array(list(map(len, sets))), left, np.arange(m))
        finally:
            near_copies.TURNS = turns
        # every link that is asked for is there, and none that isn't similar
        assert (got[got] == got).all() and (got[least] == got).all() and (most[got] == most).all()
