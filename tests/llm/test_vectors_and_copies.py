"""Top-k search, SimHash classes, near copies and decontamination, against brute force."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessella.llm import decontaminate, near_copies, simhash_dedup, topk_search


def best(rows, k=5):
    q = [(i, [math.floor(256 * x) if math.isfinite(256 * x) else 256 * int(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, (i, v) in enumerate(q):
        if i % 50 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for c, (j, w) in enumerate(q) if c != r and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("big", [1.0, 1e10, 1e200])
def test_top_k(spark, big, monkeypatch):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) * big for _ in range(4)]
    same = vec()
    rows = [(i, same if 100 < i < 130 else vec()) for i in range(220)]
    rows += [(7, rows[7][1]), (50, [5.0 * big, *rows[50][1][1:]]), (100, rows[100][1]), (1, rows[1][1]), (1, vec()), (300, None), (301, [1.0, None, 2.0, 3.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (None, vec()), (350, [1.0, 2.0]), (400, []), (-50, vec())]
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    monkeypatch.setattr(topk_search, "ROWS", 16)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, v int").repartition(3)
    assert sorted(tuple(r) for r in topk_search.top_k(df).collect()) == best(rows)
    assert topk_search.top_k(df.limit(0)).collect() == []


def test_top_k_equals_its_sql(spark):
    """Repeated ids and rows, ties and odd vectors, by the SQL that the driver compares with."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(2)
    rows = [(i % 120, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(300)] + [(0, [1.0, 1.0, 1.0])] * 3 + [(50, None), (51, []), (52, [1.0, None, 0.0]), (None, [1.0, 1.0, 1.0])]
    embeddings = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))})  # noqa: F841
    want = sorted(duckdb.connect().execute(topk_search.ORACLE).fetchall())
    got = sorted(tuple(r) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    key = lambda rs: sorted((q, n, v, s) for q, n, v, s in rs)
    assert key(got) == key(want) and len(got) > 15


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(fps, ids, radius):
    label = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius and label[a] != label[b]:
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
    return [min((i for i, m in zip(ids, label) if m == l and i is not None), default=None) for l in label]


def words(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randint(0, 300)) for _ in range(n)]


def test_simhash_classes(spark):
    rng = random.Random(2)
    rows = []
    for g in range(30):
        base = words(rng, rng.randint(1, 400))
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
            rows.append(rng.choice([" ", "\n", "\t \x0b"]).join(w))
    rows += ["", None, " \n ", "One", "one", "ÀB c", "x " * 40000]
    rows = list(enumerate(rows)) + [(3, rows[3]), (None, "nobody else"), (None, rows[5])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], classes(fps, [i for i, _ in rows], 3)), key=repr)
    got = sorted((tuple(r) for r in simhash_dedup.near_duplicates(df).collect()), key=repr)
    assert got == want
    assert simhash_dedup.near_duplicates(df.limit(0)).collect() == []


def test_tiles_find_all_links(spark, monkeypatch):
    """Random fingerprints near one another, over several tiles of a cell."""
    monkeypatch.setattr(simhash_dedup, "TILE", 8)
    monkeypatch.setattr(simhash_dedup, "PACK", 32)
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            f ^= 1 << rng.randrange(64) if rng.random() < 0.8 else 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    label = {r["node"] & (2**64 - 1): r["label"] for r in simhash_dedup.components(simhash_dedup.near_links(df, 3)).collect()}
    want = classes(fps, list(range(len(fps))), 3)
    groups = lambda ls: sorted(sorted(i for i, x in enumerate(ls) if x == l) for l in set(ls))
    assert groups([str(label.get(f, f"own {f}")) for f in fps]) == groups([str(w) for w in want])


def jaccard(a, b):
    s = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "GROUP", 8)
    rng = random.Random(6)
    clean = [" ".join(words(rng, rng.randint(40, 300))) for _ in range(60)]
    copies = []
    for t in clean[:25]:
        w = t.split()
        w[len(w) // 2] = "changed"
        copies.append(" ".join(w))
        assert jaccard(t, copies[-1]) >= 0.75
    rows = list(enumerate(clean + [c for c, t in zip(copies, clean) if jaccard(c, t) >= 0.85] + clean[:3])) + [(900, ""), (901, None), (0, clean[0]), (None, clean[1])]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, id string, node long")
    got = near_copies.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [*range(60), 900]
    assert near_copies.drop_near_copies(df.limit(0)).collect() == []


def test_near_copies_are_verified_at_the_bound(spark):
    """80 of 100 shingles in common: one goes; 79: both stay."""
    rng = random.Random(16)
    rows, want = [], []
    for i in range(80):
        w = words(rng, 104)
        short = w[: 84 - i % 2]
        assert (jaccard(" ".join(w), " ".join(short)) >= 0.8) == (i % 2 == 0)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(short))]
        want += [2 * i] if i % 2 == 0 else [2 * i, 2 * i + 1]
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want


@pytest.mark.parametrize("size", range(1, decontaminate.WINDOW + 1))
def test_masks_miss_no_pattern(size):
    """Whichever positions of a window differ, as many as may, one mask ignores them all."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, size, dtype=np.uint64)
    own = [h[0] for _, h in decontaminate.seeds(a, (size,))]
    for n in range(decontaminate.allowed(size) + 1):
        for at in itertools.combinations(range(size), n):
            b = a.copy()
            b[list(at)] += np.uint64(1)
            assert any(x == h[0] for x, (_, h) in zip(own, decontaminate.seeds(b, (size,))))


def overlapping(docs, items):
    import re

    tok = lambda t: re.findall(r"\w+", (t or "").lower())
    first = {}
    for i, t in items:
        if i is not None:
            first.setdefault(tuple(tok(t)), []).append(i)
    out = set()
    for d, t in docs:
        w = tok(t)
        for item, ids in first.items():
            n = len(item)
            size = min(n, 13)
            allowed = size * 2 // 13
            if n and any(sum(x != y for x, y in zip(w[i : i + size], item[j : j + size])) <= allowed for i in range(len(w) - size + 1) for j in range(n - size + 1)):
                out.add((d, min(ids)))
    return out


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([5, 8, 12, 13, 20, 30, 4, 0, 1, 2, 3, 6, 7, 9, 10, 11])] + [(50, None), (None, "a b c d e f g")]
    items += [(90, items[4][1]), (91, items[4][1] + " and more of it"), (92, " ".join(items[5][1].split()[5:22]) + " other"), (93, items[2][1] + " x")]
    docs = []
    for d in range(160):
        w = words(rng, rng.randint(0, 80))
        if d % 2:
            part = items[d % 16][1].split()
            for _ in range(rng.randint(0, 2)):
                if part:
                    part[rng.randrange(len(part))] = "swap"
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((d, " ".join(w).upper() if d % 5 == 0 else ", ".join(w)))
    docs += [(200, None), (201, ""), (1, docs[1][1]), (None, items[5][1]), (202, "z " * 30000 + items[5][1])]
    df = spark.createDataFrame([(i, t, "en", 3) for i, t in docs], "doc_id long, text string, lang string, size int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    want = overlapping(docs, items)
    got = decontaminate.contaminations(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    bad = {d for d, _ in want}
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([d for d, _ in docs if d not in bad], key=repr)
    assert decontaminate.contaminations(df, bench.limit(0)).collect() == []
    assert decontaminate.contaminations(df.limit(0), bench).collect() == []


def test_items_that_share_windows_are_all_reported(spark):
    rng = random.Random(8)
    shared, a, b, c = (words(rng, n) for n in (15, 10, 10, 20))
    bench = spark.createDataFrame([(1, " ".join(shared + a)), (2, " ".join(shared + b)), (3, " ".join(c)), (4, " ".join(shared + a))], "item_id long, text string")
    df = spark.createDataFrame([(10, " ".join(shared)), (11, " ".join(shared + b))], "doc_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminations(df, bench).collect()}
    # a window may differ in two words: of item 1, those reach two words into item 2's own part
    assert got == {(10, 1, 3, 0, 14, 13), (10, 2, 3, 0, 14, 13), (11, 1, 5, 0, 16, 13), (11, 2, 13, 0, 24, 13)}
