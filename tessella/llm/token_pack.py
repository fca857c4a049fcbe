"""Token-ID output: fixed-width bit packing of a corpus's token ids into shard files.

A shard file holds, little-endian: a head (the magic ``TPK2``, bits an id, the least that hold the vocabulary, and ids a
block); the packed blocks of ``BLOCK`` ids, each id in ``bits`` bits, lowest bit first; then each document's id and
number of ids, and the byte offset of each block (one more for the end); then a tail that says how many documents, ids
and blocks there are and where the document table begins. So a shard is written as it is encoded, block by block, and
any range of ids is read by its blocks alone and unpacked by numpy at once.

Shards follow one another in ascending doc_id order (null first; equal ids by a hash of their texts): a range
partitioning deals the documents out, a task encodes its shard, writes it under a name of its own and renames it,
so that a task that is run again after a loss replaces its file by the same. Files go to the folder that the cluster
shares, by Arrow's file systems (file, hdfs, s3, gs). A task holds a slice of texts, a block, and 17 bytes a document.

Texts are encoded by the tokenizers library. Where the tokenizer's file drops white space and splits words from all
else (as ``word_bpe_49k.json`` does), Arrow cuts texts at blanks and line ends, and the distinct parts into pieces: a
word in lower case, and the marks before and behind it. The library encodes each distinct piece that a worker hasn't met
lately, many in one text; the ids are put together by numpy. Parts of another form are pieces as a whole, and any other
tokenizer gets whole texts.

Defined results: null text counts as empty and holds the end id alone; a row gives a row, repeated rows too; further
columns are ignored; an empty table writes no shard and gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import SLICE as WHOLE
from tessella.llm.common import narrow, rows_of, shared_path, spread, stored, text_slices, without_collector, worker_memory

MAGIC = b"TPK2"
HEAD = struct.Struct("<4sIQ")
TAIL = struct.Struct("<QQQQ4s")
#: Ids in a block.
BLOCK = 4096
#: Bytes of text that a shard aims at.
SHARD_BYTES = 24 << 20
#: Ids that are read at once; shards whose ids are summed by one task.
READ, SHARDS = 1 << 20, 4096
#: Bytes of text whose distinct parts are looked up at once: most of a shard's, as a rule.
SLICE = 16 << 20
#: Pieces of texts whose ids a worker remembers.
CACHE = 600_000
#: Bytes of the longest piece that is remembered.
LONGEST = 64
#: Bytes of pieces that the library encodes at once; parts, and ids, that are put together at once.
JOINED, PARTS, IDS = 1 << 16, 1 << 18, 1 << 20
END_ID = 2
#: Splits words from digits, digits from one another and both from other characters: see the tokenizer's file.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters whose lower case is plain, and marks that neither begin a contraction nor an added token: "'" and "<" aren't among them.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~"
#: A part that is marks, a word and marks, each of which may be lacking; and one such piece.
_PLAIN, _PIECE = f"^(?P<before>[{_MARK}]*)(?P<word>[{_LETTER}]*)(?P<behind>[{_MARK}]*)$", f"^([{_LETTER}]+|[{_MARK}]+)$"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(np.pad(each, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


class ShardWriter:
    """Writes a shard file to a stream, block by block."""

    def __init__(self, out: BinaryIO, bits: int) -> None:
        self.out, self.bits = out, bits
        self.rest, self.offsets, self.n_ids = np.zeros(0, np.uint32), [HEAD.size], 0
        self.known: list[np.ndarray] = []
        self.named: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        out.write(HEAD.pack(MAGIC, bits, BLOCK))

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Some documents, with the ids of all of them."""
        self.known.append(doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.named.append(pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.lengths.append(lengths.astype("<u8"))
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            self._block(ids[at : at + BLOCK])
        self.rest = ids[whole:]

    def close(self) -> int:
        """Writes what is left; the number of documents."""
        if len(self.rest):
            self._block(self.rest)
        table = self.offsets[-1]
        for parts in (self.known, self.named, self.lengths):
            for part in parts:
                self.out.write(part.tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        docs = sum(map(len, self.known))
        self.out.write(TAIL.pack(docs, self.n_ids, len(self.offsets) - 1, table, MAGIC))
        return docs


class Shard:
    """A shard file, opened for reading: the document table, and any range of ids."""

    def __init__(self, path: str) -> None:
        system, name = _system(path)
        self.file = system.open_input_file(name)
        magic, self.bits, self.block = HEAD.unpack(self.file.read(HEAD.size))
        size = self.file.size()
        docs, self.n_ids, blocks, table, end = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} isn't a token shard")
        data = self.file.read_at(size - TAIL.size - table, table)
        known, named = np.frombuffer(data, np.uint8, docs), np.frombuffer(data, "<i8", docs, docs)
        self.doc_ids = pa.array(named, pa.int64(), mask=known == 0)
        self.lengths = np.frombuffer(data, "<u8", docs, 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, 17 * docs).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the shard, from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        first = int(self.offsets[a])
        data = self.file.read_at(int(self.offsets[b + 1]) - first, first)
        sizes = [min(self.block, self.n_ids - k * self.block) for k in range(a, b + 1)]
        cuts = [int(self.offsets[k]) - first for k in range(a, b + 2)]
        return np.concatenate([unpack(data[x:y], self.bits, n) for (x, y), n in zip(pairwise(cuts), sizes, strict=True)])[start - a * self.block : stop - a * self.block]


def _steps(pieces: pa.Array) -> list[int]:
    """Where to cut pieces, ends included, so that about JOINED bytes lie between."""
    ends = np.cumsum(pc.binary_length(pieces).to_numpy(), dtype=np.int64) + np.arange(len(pieces))
    return [0, *(np.nonzero(np.diff(ends // JOINED))[0] + 1).tolist(), len(pieces)]


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids that begin at each of some starts, a few at a time."""
    ends, out, at = np.cumsum(sizes), [ids[:0]], 0
    while at < len(ends):
        stop = min(at + PARTS, max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + IDS, "right"))))
        out.append(ids[spread(starts[at:stop], sizes[at:stop])])
        at = stop
    return np.concatenate(out)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Encoder:
    """Texts to ids by a tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        norm = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        added = [t["content"] for t in spec["added_tokens"]]
        self.by_parts = norm == ["NFC", "Replace", "Lowercase"] and split[:1] == [_SPLIT] and spec["post_processor"] is None and not any(" " in t["content"] or t["normalized"] for t in spec["added_tokens"])
        # no added token may lie within a plain part
        self.by_parts = self.by_parts and all(re.search(f"[^{_LETTER}{_MARK}]", t) for t in added)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.vocabulary)])
        self.by_parts = self.by_parts and bool(suffix)
        #: Bytes of text to encode at once.
        self.slice = SLICE if self.by_parts else WHOLE
        # what is remembered: pieces (the first is empty), how many ids each has, and all their ids
        self.pieces, self.sizes, self.ids = pa.array([""]), np.zeros(1, np.int64), np.zeros(0, self.kind)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the texts has by itself, and all ids."""
        each = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, each), np.int64, len(each)), np.concatenate([np.zeros(0, self.kind), *each])

    def _words(self, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Plain pieces, many encoded as one text and parted after tokens that end a word."""
        cuts = _steps(words)
        for text, (a, b) in zip(pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), " "), pairwise(cuts), strict=True):
            ids = np.array(self.tokenizer.encode_batch_fast([text.as_py()], add_special_tokens=False)[0].ids, self.kind)
            ends = np.nonzero(self.ends_word[ids])[0] + 1
            if len(ends) == b - a and (a == b or ends[-1] == len(ids)):
                yield np.diff(ends, prepend=0), ids
            else:
                yield self._each(words[a:b].to_pylist())

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some unknown pieces has, and all ids."""
        plain = pc.match_substring_regex(pieces, _PIECE)
        found = list(self._words(pieces.filter(plain)))
        other = pieces.filter(pc.invert(plain))
        found += [self._each(other[a:b].to_pylist()) for a, b in pairwise(_steps(other))]
        got = np.concatenate([np.zeros(0, np.int64), *(n for n, _ in found)])
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        sizes, starts = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        sizes[order], starts[order] = got, np.cumsum(got) - got
        return sizes, _gather(np.concatenate([np.zeros(0, self.kind), *(x for _, x in found)]), starts, sizes)

    def _known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of pieces, how many ids each code stands for, and the ids of all codes; unknown pieces are learnt."""
        coded = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        every, codes = coded.dictionary, coded.indices.to_numpy()[len(self.pieces) :]
        sizes, ids = self._learn(every[len(self.pieces) :])
        sizes, ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        kept = pc.binary_length(every).to_numpy() <= LONGEST
        if len(every) > CACHE:  # what these texts don't have is forgotten
            used = np.zeros(len(every), bool)
            used[codes] = used[0] = True
            kept &= used
            kept &= np.cumsum(kept) <= CACHE
        if kept.all():
            self.pieces, self.sizes, self.ids = every, sizes, ids
        else:
            self.pieces, self.sizes, self.ids = every.filter(pa.array(kept)), sizes[kept], ids[np.repeat(kept, sizes)]
        return codes, sizes, ids

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some parts of texts has, and all ids."""
        cut = pc.extract_regex(parts, _PLAIN)  # null for a part of another form, which is a piece as it is
        before, behind = (pc.fill_null(pc.struct_field(cut, k), "") for k in (0, 2))
        word = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, 1)), parts)
        codes, sizes, ids = self._known(pa.concat_arrays([before, word, behind]))
        codes = codes.reshape(3, -1).T
        each = sizes[codes]
        return each.sum(axis=1), _gather(ids, (np.cumsum(sizes) - sizes)[codes.ravel()], each.ravel())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids, one text after another; null texts count as empty."""
        if not self.by_parts:
            return self._each([t or "" for t in texts.to_pylist()])
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        codes, ends = coded.indices.to_numpy(), cut.offsets.to_numpy()
        ends = (ends[1:] - ends[0]).astype(np.int64)
        del cut
        sizes, ids = self._parts(coded.dictionary)
        starts, upto, out, n = np.cumsum(sizes) - sizes, np.zeros(len(ends), np.int64), [ids[:0]], 0
        for at in range(0, len(codes), PARTS):
            some = codes[at : at + PARTS]
            each = sizes[some]
            a, b = np.searchsorted(ends, [at, at + PARTS], "right")  # texts that end here
            upto[a:b] = n + np.cumsum(each)[ends[a:b] - at - 1]
            out.append(_gather(ids, starts[some], each))
            n += len(out[-1])
        return np.diff(upto, prepend=0), np.concatenate(out)


def encoder_of(path: str) -> Encoder:
    """A worker's encoder: what it has met in one task serves the next."""
    return worker_memory(("words", path), lambda: Encoder(path))


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together to ``size`` bytes or more: texts are short, and Spark's batches bounded in rows."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, held_bytes = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _shard_count(docs: DataFrame) -> int:
    """About SHARD_BYTES of text for each shard, by a pass over the texts' lengths."""
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1), F.lit(0))).first()[0]
    return max(1, -(-size // SHARD_BYTES))


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the shards below ``path`` (a fresh shared folder, if none); returns their list: shard, file, n_docs, n_ids, start."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    bits = bits_for(encoder_of(tokenizer).vocabulary)
    rows = narrow(docs, doc_id="long", text="string")
    # equal rows are told apart too, so that no range has to hold many
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("__at").asc()]
    dealt = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(shards or _shard_count(docs), *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def write(batches):
        encoder, context = encoder_of(tokenizer), TaskContext.get()
        system, folder = _system(path)
        name = f"{folder}/shard-{context.partitionId():07d}.tpk"
        own, writer = f"{name}.{context.taskAttemptId()}", None
        with without_collector():
            for batch in text_slices(gathered(batches, encoder.slice), 1, encoder.slice):
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    writer = ShardWriter(system.open_output_stream(own), bits)
                lengths, ids = encoder.encode(batch.column(1))
                ended = np.insert(ids, np.cumsum(lengths), end_id)
                writer.add(batch.column(0), lengths + 1, ended)
        if writer is None:
            return
        docs = writer.close()
        writer.out.close()
        system.move(own, name)
        yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "n_docs": [docs], "n_ids": [writer.n_ids]}, schema=pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    listed = stored(dealt.mapInArrow(write, "shard long, n_docs long, n_ids long"), "shards").withColumn("bin", F.floor(F.col("shard") / SHARDS))
    file = F.format_string(f"{path.rstrip('/').replace('%', '%%')}/shard-%07d.tpk", "shard")
    # ids before a shard: those of earlier shards of its bin, and those of earlier bins, of which there are few
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bins = listed.groupBy("bin").agg(F.sum("n_ids").alias("ids")).select("bin", F.coalesce(F.sum("ids").over(earlier(Window.orderBy("bin"))), F.lit(0)).alias("base"))
    here = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("bin").orderBy("shard"))), F.lit(0))
    return listed.withColumn("here", here).join(bins, "bin").select("shard", file.alias("file"), "n_docs", "n_ids", (F.col("base") + F.col("here")).alias("start"))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit numbers), from the files."""

    def run(batches):
        for files, starts in rows_of(batches):
            for file, start in zip(files, starts, strict=True):
                shard = Shard(file)
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                at = 0
                while at < len(ends):  # documents of about READ ids at a time
                    stop = max(at + 1, int(np.searchsorted(ends, begins[at] + READ, "right")))
                    ids = shard.read(int(begins[at]), int(ends[stop - 1])).astype("<u4")
                    cut = (begins[at:stop] - begins[at]).tolist()
                    crc = [zlib.crc32(ids[i : i + n]) for i, n in zip(cut, shard.lengths[at:stop].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([shard.doc_ids.slice(at, stop - at), pa.array(begins[at:stop] + start), pa.array(shard.lengths[at:stop]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = stop

    each = shards.select("file", "start", "shard")
    return each.repartitionByRange(max(1, each.count()), "shard").select("file", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the documents' shards, and read them back."""
    return read_shards(write_shards(docs, tokenizer, path, end_id, shards))
