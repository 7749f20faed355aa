"""Byte-pair encoding over a contiguous array of ranks, and decoding.

Reads the public JSON vocabulary; normalising (NFC, white space, lower case) and splitting follow what the file says.
Characters that are unassigned in this Python's Unicode tables count as neither letters nor digits.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 30
#: Chunks remembered with their ids, twice over (a younger and an older half), and the longest that is.
REMEMBERED, LONGEST = 1 << 18, 64
#: Bytes of a word up to which its ranks are one flat array.
SHORT = 192
#: Below this, every Unicode version assigns the same letters.
SETTLED = "\u0370"
#: Str.split() cuts at these, the vocabulary's white space doesn't hold them.
NOT_SPACE = re.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Remembered(dict):
    """word -> bytes of its ids (what holds several words is put together anew).  When the younger half is full it becomes the older, which is forgotten."""

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        raw = self.older.get(chunk)
        if raw is None:
            raw, single = self.encode(chunk)
            if not single:
                return raw
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[chunk] = raw
        return raw


class WordBpe:
    """encode(text) -> ids and decode(ids) -> text for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = self.vocab | self.special
        self.text_of = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.text_of[i] = name
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain_words, self.words = regex.compile(split), regex.compile(known_letters(split), regex.V1)
        self.between = regex.compile("|".join(map(regex.escape, self.special)))
        self.alphabet = byte_alphabet()
        #: left id << 32 | right id -> rank, and the id that the merge of each rank makes
        self.rank = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = [self.vocab[a + b] for a, b in model["merges"]]
        self.byte_id = [self.vocab[self.alphabet[b]] for b in range(256)]
        self.last_id = [self.vocab[self.alphabet[b] + self.suffix] for b in range(256)]
        self.known = Remembered(self._chunk)

    def encode_word(self, word: str) -> list[int]:
        """Parts, and the ranks of adjacent parts, in two flat lists: the least rank goes first, its boundary is deleted, its neighbours' ranks are looked up anew."""
        raw = word.encode()
        if len(raw) > SHORT:
            return self._encode_long(raw)
        ids, rank = self.byte_id, self.rank.get
        parts = [ids[b] for b in raw]
        parts[-1] = self.last_id[raw[-1]]
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = new = self.merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 32 | new, NONE)
            if at < len(ranks):
                ranks[at] = rank(new << 32 | parts[at + 1], NONE)
        return parts

    def _encode_long(self, raw: bytes) -> list[int]:
        """The same merges for a long word, where scanning for the least rank each time would be quadratic: a heap of (rank, boundary) over linked parts."""
        rank, merged, n = self.rank.get, self.merged, len(raw)
        parts = [self.byte_id[b] for b in raw]
        parts[-1] = self.last_id[raw[-1]]
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])] + [NONE]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | at for at, r in enumerate(ranks) if r != NONE]
        heapify(heap)
        while heap:
            least, at = divmod(heappop(heap), 1 << 32)
            if ranks[at] != least:
                continue  # an end of this boundary has been merged since
            gone = after[at]
            parts[at] = new = merged[least]
            ranks[gone], parts[gone] = NONE, -1
            after[at] = right = after[gone]
            ranks[at] = NONE
            if right < n:
                before[right] = at
                ranks[at] = r = rank(new << 32 | parts[right], NONE)
                if r != NONE:
                    heappush(heap, r << 32 | at)
            if (left := before[at]) >= 0:
                ranks[left] = r = rank(parts[left] << 32 | new, NONE)
                if r != NONE:
                    heappush(heap, r << 32 | left)
        return [p for p in parts if p >= 0]

    def _chunk(self, chunk: str) -> tuple[bytes, bool]:
        words = (self.plain_words if max(chunk, default="") < SETTLED else self.words).findall(chunk)
        if len(words) == 1:
            return array("I", self.encode_word(words[0])).tobytes(), words[0] == chunk
        return b"".join(map(self.known.__getitem__, words)), False

    def _plain(self, text: str) -> bytes:
        text = lower(unicodedata.normalize("NFC", text))
        if NOT_SPACE.search(text):
            return self._chunk(text)[0]
        return b"".join(map(self.known.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; the strings of special tokens are those tokens."""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.between.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The file has no decoder: the strings of the tokens are joined by spaces."""
        return " ".join(map(self.text_of.__getitem__, memoryview(ids).cast("I")))


def known_letters(pattern: str) -> str:
    """``pattern`` with its classes kept to what this Python's Unicode tables assign (the regex module's are newer)."""
    newer = regex.compile(r"[\p{L}\p{N}]")
    points = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and newer.match(chr(c))]
    ranges, at = [], 0
    while at < len(points):
        to = at
        while to + 1 < len(points) and points[to + 1] == points[to] + 1:
            to += 1
        ranges.append(f"\\U{points[at]:08x}-\\U{points[to]:08x}")
        at = to + 1
    if not ranges:
        return pattern
    left = "".join(ranges)
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{left}])").replace(r"[\p{L}]", rf"[\p{{L}}--[{left}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{left}]]")


def lower(text: str) -> str:
    """Lower case character by character (a final sigma is no exception)."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded, decoded_sha256.

    Texts are encoded whole.  A null, empty or white text has no ids and decodes to an empty text.  Null ids and
    repeated rows pass through; other columns are not read.
    """

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(text.as_py() or "")
                decoded = bpe.decode(ids)
                out.append((key, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), decoded, hashlib.sha256(decoded.encode()).hexdigest()))
                if len(out) == 256:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    schema = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
