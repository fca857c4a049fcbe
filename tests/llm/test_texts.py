"""Byte-level BPE, token shards, secrets and toxicity."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import byte_bpe, secret_scan, token_pack, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
CODEC = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
LONG = "Wörter and more words, " * 20_000
TEXTS = [LONG, None, "Hello world", "don't  stop\n\n now ", "é" * 70 + "ß😀", "a" * 3000, "x1y22z333 <|endoftext|> <|startoftext|>", "tab\t\x1c　end", "Ünïcödé, words. and\nlines", " lead", "###$$$%%% ### ..., !?", ""]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbtheé ßñ\n\t\r'sdll 12²_!😀한́　\x1c")), max_size=60))
def test_bpe_is_tiktokens(text):
    texts = [text, f"{text}  {text}", "", text]
    got = CODEC.encode_all(texts)
    assert got == [REFERENCE.encode_ordinary(t) for t in texts]
    assert CODEC.decode(got[1]) == texts[1].encode()


def test_other_patterns_split_whole_texts():
    other = byte_bpe.Codec(RANKS, r"\S+|\s+")
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=CODEC.ranks, special_tokens={})
    assert CODEC.parted and not other.parted
    for t in ("a b  c", " lead and  trail \n", "don't", ""):
        assert other.encode_all([t]) == [own.encode_ordinary(t)]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=90))
def test_both_segment_trees_agree(data):
    want = byte_bpe.merge_bytes(data, CODEC.ranks)
    if 2 <= len(data) <= 64:
        size = max(4, 1 << (len(data) - 1).bit_length())
        assert list(byte_bpe.merge_many([data], size, CODEC.byte_ids, CODEC.pairs)[0]) == want
    assert b"".join(CODEC.tokens[i] for i in want) == data


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "n", "ids") for i, t in enumerate(texts)] + [(None, "nobody", None, None), (1, texts[2], "n", "ids"), (1, texts[2], "n", "ids")], "doc_id long, text string, n string, ids string").repartition(3)


def test_round_trip(spark):
    df = docs(spark, TEXTS)
    rows = byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 3
    by = {r["doc_id"]: r for r in rows if r["doc_id"] != 1}
    for i, t in enumerate(TEXTS):
        if i != 1:
            ids = REFERENCE.encode_ordinary(t or "")
            assert (by[i]["n_tokens"], by[i]["ids_sha256"], by[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {bytes(r["data"]).decode() for r in back.collect()} == {t or "" for t in TEXTS} | {"nobody"}
    assert byte_bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_packing(bits, tmp_path):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 3 * token_pack.BLOCK + 17)
    assert len(token_pack.pack(ids, bits)) == (len(ids) * bits + 7) // 8
    assert (token_pack.unpack(token_pack.pack(ids, bits), bits, len(ids)) == ids).all()
    path = tmp_path / "x.tpk"
    with path.open("wb") as out:
        writer = token_pack.ShardWriter(out, bits)
        writer.add(pa.array([3]), np.array([10]), ids[:10])
        writer.add(pa.array([None, 5], pa.int64()), np.array([len(ids) - 30, 20]), ids[10:])
        assert writer.close() == 3
    shard = token_pack.Shard(str(path))
    assert shard.doc_ids.to_pylist() == [3, None, 5] and shard.lengths.tolist() == [10, len(ids) - 30, 20] and shard.n_ids == len(ids)
    for a, b in [(0, len(ids)), (0, 0), (5, 6), (token_pack.BLOCK - 1, token_pack.BLOCK + 1), (4000, 13000), (len(ids) - 1, len(ids))]:
        b = min(b, len(ids))
        assert (shard.read(a, b) == ids[a:b]).all()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbThe,. \n\t'sdll é É ß ñ12_!😀한́　İ")), max_size=60))
def test_parts_are_whole_texts(text):
    e = ENCODER
    assert e.by_parts
    lengths, ids = e.encode(pa.array([text, None, "the end", text]))
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", "the end", text)]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


ENCODER = token_pack.Encoder(WORDS)


def whole(texts):
    """Lengths and ids of whole texts, by the library."""
    each = [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    return list(map(len, each)), sum(each, [])


class Asked:
    """The library's tokenizer, and what it was asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_the_library_gets_each_word_and_each_run_of_marks_once():
    e = token_pack.Encoder(WORDS)
    e.tokenizer = asked = Asked(e.tokenizer)
    marks, words = ["", "(", '"', "***", ".&&&", "[\\]"], ["Word", "wörter", "ÉTÉ", *(f"x{chr(97 + i)}y" for i in range(26))]
    texts = [f"{a}{w.upper() if i % 2 else w}{b}" for w in words for i, a in enumerate(marks) for b in marks]
    rows = [" ".join(texts[k::9]) for k in range(9)]
    for _ in range(2):
        lengths, ids = e.encode(pa.array(rows))
        assert (lengths.tolist(), ids.tolist()) == whole(rows)
    pieces = " ".join(asked.texts).split()
    assert len(asked.texts) <= 4 and sorted(pieces) == sorted({w.lower() for w in words} | set(marks) - {""})


def test_what_is_remembered_is_bounded(monkeypatch):
    for name, value in (("CACHE", 40), ("PARTS", 7), ("IDS", 5), ("JOINED", 30)):
        monkeypatch.setattr(token_pack, name, value)
    e = token_pack.Encoder(WORDS)
    for k in range(5):
        texts = ["y" * 100 + "! don't <|endoftext|> 3.5", "", " ".join(f"W{chr(97 + (k * 9 + i) % 26)}o, w{i}" for i in range(30)), "\n  the end  ", "<|startoftext|>"]
        lengths, ids = e.encode(pa.array(texts))
        assert (lengths.tolist(), ids.tolist()) == whole(texts)
        known = e.pieces.to_pylist()
        assert known[0] == "" and 10 < len(known) <= 40 and max(map(len, known)) <= token_pack.LONGEST and e.sizes.sum() == len(e.ids)
    assert [len(x) for x in e.encode(pa.array([], pa.string()))] == [0, 0]
    # a piece that is a whole text by itself has no other ids among others
    lengths, ids = e.encode(pa.array([" ".join(known)]))
    assert ids.tolist() == whole([" ".join(known)])[1]


def test_an_added_token_like_a_word_is_found(tmp_path):
    spec = json.loads(open(WORDS, encoding="utf-8").read())
    spec["added_tokens"].append({**spec["added_tokens"][-1], "id": 49408, "content": "Hello."})
    path = tmp_path / "added.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    e = token_pack.Encoder(str(path))
    assert not e.by_parts and e.encode(pa.array(["Say Hello. now"], pa.large_string()))[1].tolist() == e.tokenizer.encode("Say Hello. now", add_special_tokens=False).ids
    assert ENCODER.by_parts and ENCODER.encode(pa.array(["Say Hello. now", None], pa.large_string()))[1].tolist() == whole(["Say Hello. now"])[1]


def test_short_batches_are_gathered():
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": ["x" * 100]}) for i in range(50)]
    got = list(token_pack.gathered(iter(batches), 1000))
    assert len(got) <= 6 and [i for b in got for i in b.column(0).to_pylist()] == list(range(50))
    assert list(token_pack.gathered(iter([]), 1000)) == []


def test_shards(spark):
    df = docs(spark, TEXTS * 3)
    tok = Tokenizer.from_file(WORDS)
    rows = token_pack.pack_documents(df, WORDS, shards=5).collect()
    assert len(rows) == len(TEXTS) * 3 + 3
    start = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    known = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert known == sorted(known, key=lambda d: (d is not None, d or 0))
    for r in rows:
        if r["doc_id"] not in (None, 1):
            ids = [*tok.encode(TEXTS[r["doc_id"] % len(TEXTS)] or "", add_special_tokens=False).ids, 2]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert token_pack.pack_documents(df.limit(0), WORDS).collect() == []


def test_secrets(spark):
    rng = random.Random(1)
    key = "".join(rng.choice("ABCDEFGHijklmnop0123456789xyzQRS") for _ in range(40))
    texts = [
        'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "PASSWORD:hunter2", "Secret=abcdefgh api-key=nothing api_key: 'A1b2C3d4E5'", f"AKIA{'X' * 12} AKIAX é {'a1' * 16} {'a1' * 15}",
        f"Authorization: Bearer {key}", "authorization: client_id_private_key_default_value1", "", None, "word " * 30000 + f"password={key}",
    ]
    rows = {r["doc_id"]: r for r in secret_scan.scan_secrets(docs(spark, texts)).where("doc_id != 1 OR doc_id IS NULL").collect()}
    assert (rows[0]["n_assign"], rows[0]["n_hex"], rows[0]["spans"]) == (1, 1, "assign:2:51,hex:11:51")
    assert rows[2]["spans"] == "assign:0:15,assign:32:52" and rows[3]["n_access"] == 1 and rows[3]["n_hex"] == 1
    assert rows[4]["n_novel"] == 1 and rows[4]["spans"] == f"novel:22:{22 + len(key)}"
    assert rows[5]["n_novel"] == 0 and rows[6]["spans"] == rows[7]["spans"] == ""
    assert rows[8]["n_assign"] == 1 and rows[8]["spans"].startswith("assign:150000:")
    assert rows[0]["base_sha256"] == hashlib.sha256(b"assign:2:51,hex:11:51").hexdigest()
    for i, t in enumerate(texts):
        if i != 1:
            plain = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A) if len(m[2]) >= 8]
            plain += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
            assert secret_scan.base_spans(t or "") == sorted(plain)
    assert secret_scan.scan_secrets(docs(spark, texts).limit(0)).collect() == []


def test_every_sensitive_word_opens_a_window():
    key = "q8Zr71LmPx02VtKd93Ws"
    for text in (f"Authorization header sent by this client: Bearer {key}", f"The key and the token, then in the same line the login of a client as {key}"):
        at = text.index(key)
        assert secret_scan.novel_spans(text, []) == [(at, 3, at + len(key))]
    assert secret_scan.novel_spans(f"Authorization header\n sent by this client {key}", []) == []


@pytest.mark.parametrize(("letters", "size"), [("0123456789abcdef", 20), ("0123456789abcdef", 31), ("abcdefghijklmnopqrstuvwxyz0123456789", 20), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20)])
def test_random_keys_are_novel_at_every_distance(letters, size):
    rng = random.Random(size)
    prose = " ".join("".join(rng.choices("etaoinshrdlcumw", k=rng.randint(2, 8))) for _ in range(600))
    for distances in (range(0, 60), range(60, 120), range(120, 200), range(200, 2400, 20)):
        found = 0
        for d in distances:
            key = "k" + "".join(rng.choices(letters, k=size - 2)) + "7"
            text = f"{prose[:d]} private key: {key}"
            found += secret_scan.novel_spans(text, []) == [(len(text) - size, 3, len(text))]
        assert found >= 0.95 * len(distances)


def toxic_corpus(n):
    rng = random.Random(9)
    bad = ["vile", "awful", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.randint(5, 60))]
        y = i % 5 == 0
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", 0.5))
        labels.append((i, 1, int(y), "x"))
    return rows, labels


def test_toxicity_learns_and_index_is_exact(spark):
    rows, labels = toxic_corpus(600)
    rows += [(1000, "", "en", 0.1), (1001, None, "en", 0.1), (None, "vile nasty awful", "en", 0.1), (0, rows[0][1], "en", 0.5), (1002, "plain " * 40000, "en", 0.0)]
    labels += [(5, 1, None, "x"), (None, 1, 1, "x"), (7777, 0, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    out = toxicity.toxicity_scores(df, lab).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: y for i, _, y, _ in labels if y is not None}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held) and len(held) > 50
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert {r["predicted"] for r in out if r["doc_id"] is None} == {1} and {r["predicted"] for r in out if r["doc_id"] in (1000, 1001, 1002)} == {0}
    model = toxicity.fit(df, lab)
    # scores again, with dense vectors and all examples
    width, got = model.block_max.shape[1], {r["doc_id"]: r for r in out}
    dense = np.zeros((len(model.ids), len(model.weight)), np.float64)
    for t in range(len(model.weight)):
        s = slice(model.starts[t * width], model.starts[(t + 1) * width])
        dense[model.examples[s], t] = model.weights[s]
    assert {round(float(x), 4) for x in np.linalg.norm(dense, axis=1)} <= {0.0, 1.0}
    for doc, text, *_ in [*rows[:120], (1000, "")]:
        n = Counter(u for w in re.findall(r"\w+", (text or "").lower()) for u in toxicity.units_of(w))
        terms = sorted(model.vocabulary[u][0] + k for u, x in n.items() if u in model.vocabulary for k in range(min(x, model.vocabulary[u][1])) if model.weight[model.vocabulary[u][0] + k] > 0)
        near = []
        if terms:
            q = np.zeros(len(model.weight))
            q[terms] = model.weight[terms] / math.sqrt(sum(model.weight[t] ** 2 for t in terms))
            cos = dense @ q
            near = sorted(((-c, i) for i, c in enumerate(cos) if c > 0))[: toxicity.NEIGHBOURS]
            found = model.neighbours(np.array(terms))
            assert np.allclose([c for c, _ in found], [-c for c, _ in near], atol=1e-9)
        vote = (sum(c * c * model.toxic[i] for c, i in near) + model.prior) / (sum(c * c for c, _ in near) + 1)
        logit = math.log(min(max(vote, 1e-4), 1 - 1e-4) / (1 - min(max(vote, 1e-4), 1 - 1e-4)))
        assert abs(got[doc]["score"] - 1 / (1 + math.exp(-(model.slope * logit + model.shift)))) < 1e-6
    kept = toxicity.drop_toxic(df, lab)
    assert kept.columns == df.columns and kept.where("doc_id = 10").isEmpty() and kept.where("doc_id = 11").count() == 1
    nothing = toxicity.toxicity_scores(df, lab.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in nothing} == {(0.0, 0)}
    assert toxicity.toxicity_scores(df.limit(0), lab).collect() == []


def test_toxicity_learns_from_few_labels(spark):
    rows, labels = toxic_corpus(60)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit(df, lab)
    assert set(model.vocabulary) & {"vile", "awful", "nasty", "rotten"}
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(df, lab).collect()}
    assert sum(found[i] for i in range(0, 60, 5)) >= 9 and sum(found[i] for i in range(60) if i % 5) <= 5


def test_neighbours_tie_by_number():
    """Equal examples have equal cosines: the first ones count, in order, whichever blocks they are in."""
    examples = [np.array([0, 1])] * 300 + [np.array([2, 3]), np.array([1, 3]), np.array([], np.int64)]
    toxic = np.array([i % 2 for i in range(303)])
    model = toxicity.indexed({}, 4, np.arange(303), toxic, examples)
    model.weight[:] = 1.0
    near = model.neighbours(np.array([0, 1]))
    numbers = [x for _, x in near]
    assert numbers == sorted(numbers) and len(near) == toxicity.NEIGHBOURS and len({c for c, _ in near}) == 1
    assert {len(examples[int(model.ids[x])]) for x in numbers} == {2} and model.neighbours(np.array([], np.int64)) == []


def test_examples_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EXAMPLES", 5)
    rows = [(i % 10, f"text {i} of many") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    assert toxicity._example_units(df, lab).count() <= 5


@pytest.mark.parametrize(
    ("text", "secret"),
    [
        ("the key of the service, as always, by bearer of the letter: {}", "kq8Zr71LmPx02VtKd93WsQe55RtY7uIa"), ("bearer {}", "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=30))),
        ("pin of the login: {}", "".join(random.Random(5).choices("0123456789", k=28))), ("the session is {} until noon", "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=15))),
        ("{} is the private one, and again {}", "Zr71LmPx02VtKd93"), ("x" + " word" * 400 + " key " + "word " * 400 + "{}", "q8Zr71LmPx02VtKd93Ws"),
    ],
)
def test_added_spans(text, secret):
    whole = text.format(secret, secret) if text.count("{}") > 1 else text.format(secret)
    want = [(m.start(), 3, m.end()) for m in re.finditer(re.escape(secret), whole)]
    assert secret_scan.novel_spans(whole, []) == want
    assert secret_scan.novel_spans(whole, [(s, 0, e) for s, _, e in want]) == []


def test_known_names_are_no_secrets():
    text = "private static final SessionTokenProvider sessionTokenProvider = new SessionTokenProvider(maxConnectionsPerHost);\nint maxConnectionsPerHost = 12; // internationalization of login\nuser_access_token_lifetime = 3600\n"
    assert secret_scan.novel_spans(text, []) == []


def test_added_spans_equal_brute_force():
    """Every token of every sensitive line, measured by itself."""
    rng = random.Random(12)
    for n in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.choice(["key", "monkey", "word", "login_name", "AuthHeader", "x=1", "".join(rng.choices("abcXYZ019", k=rng.randint(3, 30)))]) for _ in range(rng.randint(1, 12))]
            lines.append(" ".join(w))
        text = "\n".join(lines)
        taken = [(3, 0, 20)] if n % 3 == 0 and len(text) > 20 else []
        at, cands = 0, []
        for line in lines:
            if any(k in line.lower() for k in secret_scan.SENSITIVE):
                cands += [(at + m.start(), at + m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]+={0,2}", line) if len(m[0]) >= 8]
            at += len(line) + 1
        cands = [(s, e) for s, e in cands if not any(a < e and s < b for a, _, b in taken)]
        own = {text[s:e] for s, e in cands}
        squeezer = secret_scan._squeezer(secret_scan.COMMON + secret_scan.names_of(text, own | {w for c in own for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]{3,}", c)})) if cands else None
        want = []
        for s, e in cands:
            t = text[s:e]
            around = text[max(0, s - 1024) : s].replace(t, ""), text[e : e + 1024].replace(t, "")
            t = t.lower() if t.isalpha() and t.isupper() else t
            if secret_scan.marginal_bits(squeezer, around[0], t, around[1]) >= max(72, 1.15 * secret_scan.random_bits(t)):
                want.append((s, 3, e))
        assert secret_scan.novel_spans(text, taken) == want
