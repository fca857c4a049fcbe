"""Secret scans: fixed patterns, and the novelty of candidates by dictionary-primed zstandard compression.

Patterns find assignments, access keys and long hexadecimal runs. The method adds candidates that stand in a
sensitive context, a line with a word such as key, auth or bearer: whole tokens of ``SHORTEST`` or more characters. For
each, the text around it, before and behind, is compressed without and with the candidate, with a dictionary of common
identifiers and words and of the document's own identifiers (tokens that repeat or look like names in code; no
candidates). Other places where the candidate itself stands don't count as surroundings. Where it costs ``BITS`` or
more, and per character ``NOVELTY`` times what a random character of its alphabet has (letters of either case, digits,
other signs, as far as it uses them), it repeats neither code nor identifiers and is reported. Both texts begin with
the same letters (``FILL``), so many that literals are always Huffman-coded, by the frequencies of prose: otherwise a
candidate that tips the compressor from raw to coded literals would shrink the text before it as well, and look
cheap. Candidates that overlap a pattern's span are no candidates.

Whole texts are searched. Defined results: null text counts as empty and has no span; a row gives a row; further
columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessella.llm.common import narrow, rows_of

#: The fixed patterns, in order, and the least length of what must be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
#: An assignment has one of these, whatever the case.
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make a context sensitive, in lower case.
SENSITIVE = ("key", "auth", "bearer", "credential", "private", "pwd", "passphrase", "secret", "token", "login", "signature", "session")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
SHORTEST = 8
#: Code points on each side of a candidate that count as its surroundings, besides the document's identifiers.
AROUND = 1024
#: Marginal compressed bits: in all, and for each bit of a random string of the candidate's alphabet.
BITS, NOVELTY = 72, 1.15
#: The alphabets and their sizes.
ALPHABETS = ((re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[0-9]"), 10), (re.compile("[+/_=-]"), 5))
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")
_CODE = re.compile(r"[0-9_]|[a-z][A-Z]")
#: Identifiers and words that code is full of: the dictionary's content.
COMMON = """
import from return class function public private static const void string integer boolean default value values index
length count number object array result response request header headers content type application json xml http https
www example com org net localhost username password passwd secret token access_key secret_key api_key client_id
client_secret authorization bearer basic session cookie signature private_key public_key certificate config settings
environment variable production development staging database connection host port user admin root server client
message error exception warning debug info log logger test tests data file path name key id uuid hash sha256 md5
base64 encode decode encrypt decrypt abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef
getValue setValue createElement addEventListener undefined null true false self this that the and with for changeme
""".encode()
#: Letters of words that mean nothing, about as frequent as in prose, so that nothing repeats and all are literals.
FILL = "".join(random.Random(1).choices("      etaoinshrdlcumwfgypbvk", [5] * 6 + [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 2, 1, 1, 1], k=512)).encode()


def _squeezer(words: bytes = COMMON) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bits(squeezer: zstandard.ZstdCompressor, before: str, candidate: str, after: str) -> int:
    """Compressed bits that the candidate adds to its surroundings."""
    head, tail = FILL + before.encode("utf-8", "surrogatepass"), after.encode("utf-8", "surrogatepass")
    return 8 * (len(squeezer.compress(head + candidate.encode() + tail)) - len(squeezer.compress(head + tail)))


def random_bits(candidate: str) -> float:
    """Bits of a random string of the candidate's alphabet and length."""
    return len(candidate) * math.log2(sum(n for signs, n in ALPHABETS if signs.search(candidate)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what the fixed patterns find."""
    low, found = text.lower(), []
    if any(w in low for w in ASSIGNED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the tokens of lines with a sensitive word that are long enough and overlap no span of taken."""
    out, upto = [], 0
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return out
    for m in _SENSITIVE.finditer(text):
        if m.start() < upto:
            continue
        first = max(upto, text.rfind("\n", 0, m.start()) + 1)
        upto = text.find("\n", m.end())
        upto = len(text) if upto < 0 else upto
        out += [c.span() for c in _CANDIDATE.finditer(text, first, upto) if c.end() - c.start() >= SHORTEST]
    if not out or not taken:
        return out
    # taken is ascending by start; of the spans that start before a candidate's end, one may reach into it
    reach, starts = list(accumulate((e for *_, e in taken), max)), [s for s, *_ in taken]
    return [(s, e) for s, e in out if (k := bisect_left(starts, e)) == 0 or reach[k - 1] <= s]


def names_of(text: str, without: set[str]) -> bytes:
    """The document's identifiers."""
    found = Counter(_NAME.findall(text))
    return " ".join(w for w, n in found.items() if (n > 1 or _CODE.search(w)) and w not in without).encode()


def novel_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what only the method finds; taken: spans that it may not overlap, in order."""
    spans = candidates(text, taken)
    if not spans:
        return []
    own = {text[s:e] for s, e in spans}
    # a candidate's own parts aren't known from elsewhere
    squeezer = _squeezer(COMMON + names_of(text, own | {w for c in own for w in _NAME.findall(c)}))
    found = []
    for s, e in spans:
        t = text[s:e]
        before, after = text[max(0, s - AROUND) : s].replace(t, ""), text[e : e + AROUND].replace(t, "")
        t = t.lower() if t.isalpha() and t.isupper() else t  # capitals throughout tell nothing
        if marginal_bits(squeezer, before, t, after) >= max(BITS, NOVELTY * random_bits(t)):
            found.append((s, 3, e))
    return found


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans of each row."""

    def run(batches):
        for doc_ids, texts in rows_of(batches):
            out = {"doc_id": doc_ids, "n_assign": [], "n_access": [], "n_hex": [], "n_novel": [], "base_sha256": [], "spans": []}
            for t in texts:
                base = base_spans(t or "")
                more = novel_spans(t or "", base)
                kinds = [k for _, k, _ in base]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(kinds.count(k))
                out["n_novel"].append(len(more))
                out["base_sha256"].append(hashlib.sha256(_said(base).encode()).hexdigest())
                out["spans"].append(_said(sorted(base + more)))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())]))

    return narrow(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
