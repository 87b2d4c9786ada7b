"""BPE encoding and decoding with a vocabulary of word pieces.

A text is normalised and split into words by the rules of the vocabulary file; each word is merged on its
own. A short word is held as contiguous arrays: where its parts begin, their ids and the rank of each pair of
neighbours. The smallest rank is looked for by a scan, the boundary between its two parts is deleted
and the ranks beside it are looked up anew. In words of over ``SHORT`` bytes, where scans would cost the square of
the length, the same merges are taken from a heap. Words are remembered in two bounded generations.

The vocabulary is one of public_tokenizers of this kind: NFC, lower case, contractions, runs of letters,
single numbers and runs of other signs as words, white space dropped, bytes as symbols and a word-end suffix.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.session import read_table, ship

VOCABULARY = "word_bpe_49k"
#: Bytes up to which a word is merged by scans.
SHORT = 128
#: Words in one generation of remembered ones, and the characters of the longest of them.
REMEMBERED, LONGEST = 200_000, 48
_NONE = 1 << 30
#: Fixed by the vocabulary's own splitting rule; for texts of ASCII and for others.
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes for the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, short: int = SHORT):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, suffix = file["model"], file["model"].get("end_of_word_suffix") or ""
        ids = model["vocab"]
        self.short = short
        self.tokens = {i: t for t, i in ids.items()} | {x["id"]: x["content"] for x in file["added_tokens"]}
        self.first = [ids[s] for s in byte_symbols()]
        self.last = [ids[s + suffix] for s in byte_symbols()]
        self.rank, self.merged = {}, []
        for k, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(ids[a] << 32 | ids[b], k)
            self.merged.append(ids[a + b])
        special = {x["content"]: struct.pack("<I", x["id"]) for x in file["added_tokens"]}
        self.special, self.by_special = special, re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.library = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # merging one word

    def parts(self, word: bytes) -> tuple[list[int], list[int]]:
        """Where the parts of a short word begin, and their ids."""
        rank, merged = self.rank.get, self.merged
        ids = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        bounds = list(range(len(word)))
        near = [rank(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while near:
            best = min(near)
            if best == _NONE:
                break
            k = near.index(best)
            ids[k] = merged[best]
            del bounds[k + 1], ids[k + 1], near[k]
            if k:
                near[k - 1] = rank(ids[k - 1] << 32 | ids[k], _NONE)
            if k < len(near):
                near[k] = rank(ids[k] << 32 | ids[k + 1], _NONE)
        return bounds, ids

    def parts_of_long(self, word: bytes) -> list[int]:
        """The same ids from a heap of pairs; a pair counts only while both its parts are what they were."""
        rank, merged, n = self.rank.get, self.merged, len(word)
        ids = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank(ids[k] << 32 | ids[k + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            m = after[k]
            if ids[k] != a or m >= n or ids[m] != b:
                continue
            ids[k], ids[m] = merged[r], -1
            after[k] = after[m]
            if after[k] < n:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (new := rank(ids[left] << 32 | ids[right], _NONE)) != _NONE:
                    heapq.heappush(heap, (new, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def __getitem__(self, word: str) -> bytes:
        """A word's ids as little-endian unsigned 32-bit integers."""
        got = self.young.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                raw = word.encode()
                ids = self.parts(raw)[1] if len(raw) <= self.short else self.parts_of_long(raw)
                got = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= LONGEST:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[word] = got
        return got

    # texts

    def words(self, text: str) -> list[str]:
        """The words of a stretch of text without special tokens."""
        if text.isascii():
            return _ASCII_WORD.findall(text.lower())
        if "Σ" in text or any(unicodedata.category(c) == "Cn" for c in set(text)):
            # Final sigma, and characters that this Python's tables do not know: the library's own tables.
            text = self.library.normalizer.normalize_str(text)
            return _words_by_library(self.library, text)
        return _WORD.findall(unicodedata.normalize("NFC", text).lower())

    def encode(self, text: str) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        young = self.young.get
        if self.by_special is None or not self.by_special.search(text):
            words = self.words(text)
            return b"".join([young(w) or self[w] for w in words])
        out, at = [], 0
        for m in self.by_special.finditer(text):
            out += [self[w] for w in self.words(text[at : m.start()])]
            out.append(self.special[m[0]])
            at = m.end()
        return b"".join([*out, *(self[w] for w in self.words(text[at:]))])

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, special ones too, joined by a space: what a file without a decoder gives."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _words_by_library(library, text: str) -> list[str]:
    back = {ord(s): b for b, s in enumerate(byte_symbols())}
    return [w.translate(back).encode("latin-1").decode() for w, _ in library.pre_tokenizer.pre_tokenize_str(text)]


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    """vocabulary: a name of the public_tokenizers package, or the path of such a file."""
    import public_tokenizers

    return Codec(vocabulary if os.sep in vocabulary else public_tokenizers.path(f"{vocabulary}.json"))


def _mapped(vocabulary: str, name: str, kind: pa.DataType, method: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = getattr(codec(vocabulary), method)
        empty = "" if method == "encode" else b""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = pa.array([call(x.as_py() or empty) for x in b.column(b.num_columns - 1)], kind)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], name])

    return rows


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text): binary, little-endian unsigned 32-bit integers.

    Whole texts, however long; null and empty ones, and those of white space alone, have no ids. Rows that repeat
    stay, in no order, a null doc_id stays null, other columns are left out. No rows give no rows. Ids are those of the tokenizers
    library with add_special_tokens=False: a special token's own string in a text is that token.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_mapped(vocabulary, "ids", pa.binary(), "encode"), "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids and decoded, the text that the ids stand for, of each row of encoded (doc_id, ids): as the
    tokenizers library's decode(ids, skip_special_tokens=False). Null ids are none; other columns are left out."""
    ship(encoded.sparkSession)
    own = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", F.col("ids").alias("decoded"))
    return own.mapInArrow(_mapped(vocabulary, "decoded", pa.string(), "decode"), "doc_id long, ids binary, decoded string")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(read_table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
