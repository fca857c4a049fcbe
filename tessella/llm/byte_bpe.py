"""Byte-level BPE encoding and decoding from a file of merge ranks.

A text is split by the file's pattern; a piece that is a token as a whole is that token. Else its bytes are merged:
a segment tree over byte positions holds, for the pair that starts at each live position, its rank, and at each
inner node the leftmost position of the smallest rank below. A merge takes the root, and
changes the pairs at the merged position and at its live neighbours: three updates of logarithmic length, so that a
piece of n bytes takes n log n steps, however long.

Pieces of up to ``MANY`` bytes are merged together, with their segment trees as rows of one array; longer ones by
themselves, in a tree of ``FAN`` children a node. A worker keeps one codec, with the ids of what it met lately, about
``2 * (CACHE + PIECES)`` entries at most. With the patterns of ``PARTED`` texts are cut at blanks by Arrow, and each distinct part is
looked up once; with any other pattern whole texts are split. Nothing is shuffled.

Defined results: null text counts as empty: no ids, decoded to nothing; a row gives a row; null ids of documents
and further columns are passed on or ignored. Special tokens do not exist: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tessella.llm.common import narrow, rows_of, split_texts, spread, text_slices, without_collector, worker_memory

#: Entries of a generation of a worker's memory: parts of texts, and pieces.
CACHE, PIECES = 150_000, 75_000
#: Characters of the longest piece that is remembered.
LONGEST = 48
#: Bytes of the longest piece that is merged together with others.
MANY = 64
#: Children of an inner node of the segment tree.
FAN = 32
NONE = 1 << 90
NO_RANK = 1 << 40
_UNIT = re.compile(r" (?=\S)")
#: Patterns (fixed values) whose pieces never reach over a blank before another character from its left.
PARTED = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece, by lowest rank first and leftmost first."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    get = ranks.get
    # a key is rank * n + position: the smallest is the lowest rank, and of equal ones the leftmost
    keys = [NONE if (r := get(piece[i : i + 2])) is None else r * n + i for i in range(n - 1)]
    keys.append(NONE)
    levels = [keys]  # levels[k + 1][i] is the least of the FAN nodes below it in levels[k]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    above, top = levels[1:], levels[-1]

    def put(i: int, key: int) -> None:
        keys[i] = key
        below = keys
        for level in above:
            i //= FAN
            level[i] = min(below[i * FAN : i * FAN + FAN])
            below = level

    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a position; where the part before starts
    while (low := min(top)) < NONE:
        i = low % n
        j = end[i]  # merge the part at i with the part at j
        stop = end[i] = end[j]
        put(j, NONE)
        key = NONE
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                key = r * n + i
        put(i, key)
        if (h := before[i]) >= 0:
            r = get(piece[h:stop])
            put(h, NONE if r is None else r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Ranks of joined pairs of tokens, looked up for many pairs at once: a hash table with open addressing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        keys, values = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        bits = max(4, (4 * len(found)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int64), 0
        while len(keys):
            slot = (self._home(keys) + self.probes) & self.mask
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.nonzero(free)[0][first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, values, self.probes = keys[left], values[left], self.probes + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        slot = self._home(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NO_RANK)
        at = np.nonzero((out == NO_RANK) & (self.keys[slot] >= 0))[0]
        for probe in range(1, self.probes):
            if not len(at):
                break
            there = self.keys[(slot[at] + probe) & self.mask]
            out[at] = np.where(there == keys[at], self.values[(slot[at] + probe) & self.mask], NO_RANK)
            at = at[(there >= 0) & (there != keys[at])]
        return out


def merge_many(pieces: list[bytes], size: int, byte_ids: np.ndarray, pairs: Pairs) -> list[tuple[int, ...]]:
    """``merge_bytes`` for many pieces of 2 to ``size`` bytes (a power of two), a binary segment tree for each.

    All trees take their root and update their paths in step; pieces that are done leave.
    """
    m = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, m)
    data = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    at = np.arange(size)
    ids = np.where(at < lengths[:, None], byte_ids[data], -1)
    after = np.broadcast_to(np.arange(1, size + 1), (m, size)).copy()  # where the part after the one at a position starts
    before = np.broadcast_to(np.arange(-1, size - 1), (m, size)).copy()
    tree = np.full((m, 2 * size), NO_RANK * size, np.int64)
    rows, cols = np.nonzero(at[: size - 1] < lengths[:, None] - 1)
    tree[rows, size + cols] = pairs(ids[rows, cols], ids[rows, cols + 1]) * size + cols
    for k in range(size.bit_length() - 2, -1, -1):
        below = tree[:, 2 << k : 4 << k]
        tree[:, 1 << k : 2 << k] = np.minimum(below[:, ::2], below[:, 1::2])

    def put(rows: np.ndarray, cols: np.ndarray, keys: np.ndarray) -> None:
        k = size + cols
        tree[rows, k] = keys
        while k[0] > 1:
            tree[rows, k >> 1] = np.minimum(tree[rows, k], tree[rows, k ^ 1])
            k = k >> 1

    least = NO_RANK * size
    live = np.nonzero(tree[:, 1] < least)[0]
    while len(live):
        low = tree[live, 1]
        i, rank = low % size, low // size
        j = after[live, i]
        stop = after[live, j]
        ids[live, i], ids[live, j], after[live, i] = rank, -1, stop
        put(live, j, np.full(len(live), least))
        has = stop < lengths[live]
        key = np.full(len(live), least)
        r, s = live[has], stop[has]
        before[r, s] = i[has]
        key[has] = pairs(rank[has], ids[r, s]) * size + i[has]
        put(live, i, np.where(key < least, key, least))
        h = before[live, i]
        has = h >= 0
        if has.any():
            r, h = live[has], h[has]
            key = pairs(ids[r, h], rank[has]) * size + h
            put(r, h, np.where(key < least, key, least))
        live = live[tree[live, 1] < least]
    kept = ids >= 0
    flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


class Recent(dict):
    """A mapping of at most about ``2 * size`` entries, in two generations: what was asked for lately stays."""

    def __init__(self, size: int = CACHE) -> None:
        self.size, self.old = size, {}

    def recall(self, keys: set) -> tuple[dict, set]:
        """Of keys that the young generation lacks: those of the old one, young again from now on, and the unknown ones."""
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        old = self.old
        back = {k: old[k] for k in keys if k in old}
        self.update(back)
        return back, keys.difference(back) if back else keys


class Codec:
    """Encodes texts and decodes ids; keeps the ids of what it met lately, so that a frequent piece is merged once.

    Texts are cut at blanks before characters that aren't white space. No piece of the pattern reaches over such a
    place from its left, and whether a piece ends before it doesn't hang on what follows; so the pieces of a text
    are those of its units.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        size = max(self.ranks.values()) + 1
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.token_bytes = pa.array([self.tokens.get(i) for i in range(size)], pa.binary())
        self.names = pa.array([str(i) for i in range(size)])
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = Pairs(self.ranks)
        self.find = regex.compile(pattern).findall
        self.parted = pattern in PARTED
        self.pieces, self.units = Recent(PIECES), Recent(CACHE)

    def _learn_pieces(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pieces that the young generation lacks."""
        found, unknown = self.pieces.recall(pieces)
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in unknown:
            data = piece.encode("utf-8")
            if (whole := self.ranks.get(data)) is not None:
                found[piece] = (whole,)
            elif len(data) > MANY:
                found[piece] = tuple(merge_bytes(data, self.ranks))
            else:
                by_size.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for size, some in by_size.items():
            found.update(zip([p for p, _ in some], merge_many([d for _, d in some], size, self.byte_ids, self.pairs), strict=True))
        self.pieces.update({p: i for p, i in found.items() if len(p) <= LONGEST})
        return found

    def _ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts given as pieces, as little-endian 32-bit numbers."""
        get = self.pieces.get
        pieces = {p for x in texts for p in x}
        known = {p: i for p in pieces if (i := get(p)) is not None}
        known |= self._learn_pieces(pieces.difference(known))
        flat = np.array(list(chain.from_iterable(known[p] for x in texts for p in x)), "<i4").tobytes()
        ends = np.cumsum([4 * sum(len(known[p]) for p in x) for x in texts]).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn_units(self, units: set[str]) -> dict[str, bytes]:
        """The ids of units that the young generation lacks, each after a blank."""
        found, unknown = self.units.recall(units)
        split = [[" " + u] if u.isalpha() and u.isascii() else self.find(" " + u) for u in unknown]
        found |= zip(unknown, self._ids(split), strict=True)
        self.units.update({u: i for u, i in found.items() if len(u) <= LONGEST})
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids, one text after another; null texts count as empty."""
        if not self.parted:
            each = self._ids([self.find(t or "") for t in texts.to_pylist()])
            return np.array([len(x) // 4 for x in each], np.int64), np.frombuffer(b"".join(each), "<i4")
        codes, parts, ends = split_texts(texts, " ")
        first = np.concatenate([[0], ends[:-1]])
        # a part that is empty or begins with white space belongs to the one before: such texts are split as a whole
        glued = np.fromiter((not p or p[0].isspace() for p in parts), bool, len(parts))[codes]
        glued[first] = False
        whole = np.logical_or.reduceat(glued, first)
        own = [t or "" if w else parts[codes[f]] for t, w, f in zip(texts.to_pylist() if whole.any() else [None] * len(first), whole.tolist(), first.tolist(), strict=True)]
        ids = list(map(self.units.get, parts))
        rest = np.ones(len(codes), bool)
        rest[first] = False
        used = np.zeros(len(parts), bool)
        used[codes[rest & ~np.repeat(whole, np.diff(ends, prepend=0))]] = True
        lacking = {p for p, i, u in zip(parts, ids, used.tolist(), strict=True) if i is None and u}
        found = self._learn_units(lacking)
        ids = [found.get(p, b"") if i is None else i for p, i in zip(parts, ids, strict=True)]
        ids += self._ids([list(chain.from_iterable(map(self.find, self._units(t)))) if w else self.find(t) for t, w in zip(own, whole.tolist(), strict=True)])
        codes = codes.astype(np.int64)
        codes[first] = len(parts) + np.arange(len(first))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        each = sizes[codes]
        each[rest & np.repeat(whole, np.diff(ends, prepend=0))] = 0
        upto = np.concatenate([[0], np.cumsum(each)])[ends]
        return np.diff(upto, prepend=0), np.frombuffer(b"".join(ids), "<i4")[spread((np.cumsum(sizes) - sizes)[codes], each)]

    @staticmethod
    def _units(text: str) -> list[str]:
        """The text cut before blanks that another character follows."""
        head, *rest = _UNIT.split(text)
        return [head, *(" " + u for u in rest)]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        lengths, ids = self.encode(pa.array(texts, pa.string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []

    def joined(self, of: pa.Array, lengths: np.ndarray, ids: np.ndarray, mark: bytes | str) -> pa.Array:
        """For each text, what ``of`` has for its ids, joined by a mark."""
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), of.take(pa.array(ids))), mark)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec_of(path: str, pattern: str) -> Codec:
    """A worker's codec: what it has met in one task serves the next."""
    return worker_memory(("bytes", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of each row."""

    def run(batches):
        codec = codec_of(path, pattern)
        for batch in text_slices(batches, 1):
            lengths, ids = codec.encode(batch.column(1))
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "ids"])

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary) from doc_id, ids; null ids give empty data."""

    def run(batches):
        codec = codec_of(path, pattern)
        for doc_ids, ids in rows_of(batches, 128):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([codec.decode(x or []) for x in ids], pa.binary())], names=["doc_id", "data"])

    return narrow(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by blanks) and decoded_sha256 (of the bytes decoded from them)."""

    def run(batches):
        codec = codec_of(path, pattern)
        digest = lambda xs: pa.array([hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in xs], pa.string())
        with without_collector():
            for batch in text_slices(batches, 1):
                lengths, ids = codec.encode(batch.column(1))
                said, data = codec.joined(codec.names, lengths, ids, " "), codec.joined(codec.token_bytes, lengths, ids, b"")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), digest(said), digest(data)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
