"""Cross-tokenizer alignment: which tokens of one vocabulary stand for which of another.

Side A is a byte-level vocabulary, side B one of sentencepiece. Both cut the same bytes; where both cut at
once a group ends, and an A and a B token that share bytes are linked. How often each pair of ids is linked in all
documents is counted in dense matrices, one for each stripe of B ids: links are first added up within a chunk of
documents, the chunks' sums go to their stripe and np.add.at puts them into its block. A block's row maxima say which
A id is each B id's best. Scoring happens beside the same stripes: the chunks' links, still told
apart by document, follow their stripe's counts through the same partition, and what comes back is one
number a document and stripe.

Nothing grows unbounded in a task: one block of ``STRIPE`` rows, one chunk's arrays. Sums of many chunks are
taken in rounds of ``FAN``, and links of one stripe are dealt over as many tasks as they need, each with the
stripe's counts.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import stored
from cuelake.session import read_table, ship

SIDE_A, SIDE_B = "byte_bpe_50k", "piece_bpe_32k"
#: B ids in one stripe; a block has so many rows, and as many columns as A has ids.
STRIPE = 250
#: Characters and documents of a chunk; a longer document is one of its own.
CHUNK_CHARS, CHUNK_DOCS = 2_000_000, 4_096
#: Chunks whose sums one task adds to a stripe's block, and chunks whose links of a stripe one task scores.
FAN, SCORED = 2_000, 100
#: White space of this many characters in a row is left to the tokenizers library.
_BLANK = re.compile(r"\s{10000}")


class Sides:
    """Both vocabularies: encoders of texts, and the bytes of each id."""

    def __init__(self, side_a: str, side_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        def at(name: str, ending: str) -> str:
            return f"{name}{ending}" if os.sep in name else public_tokenizers.path(f"{name}{ending}")

        with open(at(side_a, ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._slow = Tokenizer.from_file(at(side_a, ".json"))
        self._slow.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=at(side_b, ".model"))
        self.bytes_a = [b""] * self._slow.get_vocab_size()
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        n = max(len(self.bytes_a), len(self.bytes_b))
        # An id as text with what follows it: , | within and at the end of A's part of a group, , ; of B's.
        self.written = np.array([f"{i}{end}" for end in ",|,;" for i in range(n)], dtype=object)
        self.n = n

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides, none where the bytes of either differ from a space and the text."""
        if not text:
            return [], []
        own = " " + text
        a = self._slow.encode(own, add_special_tokens=False).ids if len(text) >= 10_000 and _BLANK.search(own) else self._fast(own)
        b = self._b.encode(text)
        raw = own.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return [], []
        return a, b


@lru_cache(maxsize=2)
def sides(side_a: str, side_b: str) -> Sides:
    return Sides(side_a, side_b)


def _chunks(batches: Iterator[pa.RecordBatch], chars: int, docs: int) -> Iterator[list[tuple[int | None, str]]]:
    out, size = [], 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py() or ""
            if out and (size + len(t) > chars or len(out) == docs):
                yield out
                out, size = [], 0
            out.append((i, t))
            size += len(t)
    if out:
        yield out


def link_chunk(own: Sides, texts: list[str], with_groups: bool):
    """Of a chunk of documents: n_a, n_b, n_groups, n_links, groups_sha256 and groups of each; and all links as
    sorted keys B id, A id, document with how often each comes."""
    ids = [tuple(np.array(x, dtype=np.int32) for x in own.encode(t)) for t in texts]
    n_a, n_b = (np.array([len(x[k]) for x in ids], dtype=np.int64) for k in (0, 1))
    a, b = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in ids)]).astype(np.int64) for k in (0, 1))
    del ids
    end_a, end_b = np.cumsum(own.length_a[a]), np.cumsum(own.length_b[b])
    cut = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, dtype=np.uint8)
    cut[end_a] |= 1
    cut[end_b] |= 2
    # Each stretch between neighbouring cuts of either side belongs to one token of each: one link.
    kind = cut[np.flatnonzero(cut)]
    is_a, is_b, both = kind & 1 != 0, kind & 2 != 0, kind == 3
    at_a, at_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
    group_a, group_b = (np.cumsum(both) - both)[is_a], (np.cumsum(both) - both)[is_b]
    # Tokens in the order of groups, A before B within one.
    total = int(both.sum())
    sum_a, sum_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=total)))) for g in (group_a, group_b))
    code = np.empty(len(a) + len(b), dtype=np.int64)
    last_a, last_b = (np.concatenate((g[1:] != g[:-1], [True]))[: len(g)] for g in (group_a, group_b))
    code[np.arange(len(a)) + sum_b[group_a]] = a + own.n * last_a
    code[np.arange(len(b)) + sum_a[group_b + 1]] = b + own.n * (2 + last_b)
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    groups_of = np.diff(np.concatenate(([0], _ended(group_a, stop_a))))
    n_links = n_a + n_b - groups_of
    shas, texts_of, lo = [], [], 0
    for hi in (stop_a + stop_b).tolist():
        joined = "".join(own.written[code[lo:hi]])[:-1]
        shas.append(hashlib.sha256(joined.encode()).hexdigest() if hi > lo else "")
        if with_groups:
            texts_of.append(joined)
        lo = hi
    doc = np.repeat(np.arange(len(texts)), n_links)
    key = (b[at_b] * len(own.bytes_a) + a[at_a]) * len(texts) + doc
    keys, times = np.unique(key, return_counts=True)
    return (n_a, n_b, groups_of, n_links, shas, texts_of), keys, times


def _ended(group: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many groups end by each document's last token."""
    return np.array([group[s - 1] + 1 if s else 0 for s in stop.tolist()], dtype=np.int64)


_DOC = "chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BLOCK = "stripe int, pairs binary, sums binary, n_docs binary, docs binary, times binary"


def _linked(side_a: str, side_b: str, with_groups: bool, stripe: int, chars: int, docs: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = sides(side_a, side_b), TaskContext.get().partitionId() << 32
        width = stripe * len(own.bytes_a)
        for k, part in enumerate(_chunks(batches, chars, docs)):
            (n_a, n_b, n_groups, n_links, shas, groups), keys, times = link_chunk(own, [t for _, t in part], with_groups)
            n, chunk = len(part), first + k
            pair, place = keys // n, keys % n
            heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)])
            pairs, per_pair = pair[heads], np.diff(np.concatenate((heads, [len(pair)])))
            sums = np.add.reduceat(times, heads) if len(heads) else times
            by = pairs // width
            starts = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))[: len(by)]).tolist()
            found = []
            for lo, hi in zip(starts, [*starts[1:], len(by)]):
                x, y = heads[lo], heads[hi] if hi < len(heads) else len(pair)
                s = int(by[lo])
                packed = ((pairs[lo:hi] - s * width).astype("<u4"), sums[lo:hi].astype("<i8"), per_pair[lo:hi].astype("<u4"), place[x:y].astype("<u4"), times[x:y].astype("<u4"))
                found.append((s, *(p.tobytes() for p in packed)))
            m = len(found)
            columns = [
                pa.array(np.full(n + m, chunk)),
                pa.array([*range(n), *[None] * m], pa.int32()),
                pa.array([*(i for i, _ in part), *[None] * m], pa.int64()),
                *(pa.array([*x.tolist(), *[None] * m], pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
                pa.array([*shas, *[None] * m], pa.string()),
                pa.array([None] * n + [f[0] for f in found], pa.int32()),
                *(pa.array([None] * n + [f[c] for f in found], pa.binary()) for c in range(1, 6)),
            ]
            if with_groups:
                columns.append(pa.array([*groups, *[None] * m], pa.string()))
            names = [c.split()[0] for c in f"{_DOC}, {_BLOCK}{', groups string' * with_groups}".split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(column.to_pylist() for column in b.columns))


def _summed(stripe: int, n_a: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = np.zeros(stripe * n_a, dtype=np.int64), None

        def done() -> pa.RecordBatch:
            used = np.flatnonzero(block)
            out = [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([used.astype("<u4").tobytes()], pa.binary()), pa.array([block[used].tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(out, names=["stripe", "chunk", "pairs", "sums"])

        for s, part, pairs, sums in _rows(batches):
            if at != (s, part):
                if at is not None:
                    yield done()
                    block.fill(0)
                at = (s, part)
            np.add.at(block, np.frombuffer(pairs, "<u4").astype(np.int64), np.frombuffer(sums, "<i8"))
        if at is not None:
            yield done()

    return rows


def stripe_counts(blocks: DataFrame, chunks: int, stripe: int, n_a: int, fan: int = FAN) -> DataFrame:
    """stripe, pairs and sums, one row a stripe, of blocks (stripe, chunk, pairs, sums) of at most ``chunks`` chunks. In each round a
    task adds up at most about ``fan`` rows of a stripe, so a stripe is never one task's work alone."""
    sums = blocks.select("stripe", "chunk", "pairs", "sums")
    while True:
        parts = -(-chunks // fan)
        dealt = sums.withColumn("chunk", F.pmod(F.xxhash64("chunk"), F.lit(parts)))
        ordered = dealt.repartition("stripe", "chunk").sortWithinPartitions("stripe", "chunk")
        sums = ordered.mapInArrow(_summed(stripe, n_a), "stripe int, chunk long, pairs binary, sums binary")
        if parts == 1:
            return sums.drop("chunk")
        chunks = parts


def _scored(stripe: int, n_a: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = np.zeros(stripe * n_a, dtype=np.int64), np.zeros(stripe, dtype=np.int64)
        for _, chunk, pairs, sums, n_docs, docs, times in _rows(batches):
            pair = np.frombuffer(pairs, "<u4").astype(np.int64)
            if chunk is None:  # the counts of the stripe, before its links
                block.fill(0)
                block[pair] = np.frombuffer(sums, "<i8")
                best = block.reshape(stripe, n_a).max(axis=1)
                continue
            each = np.frombuffer(n_docs, "<u4").astype(np.int64)
            count = block[pair]
            first = np.repeat(count == best[pair // n_a], each)
            place, n = np.frombuffer(docs, "<u4").astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64)
            places, own = np.unique(place, return_inverse=True)
            n_best, total = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
            np.add.at(n_best, own, n * first)
            np.add.at(total, own, n * np.repeat(count, each))
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (places.astype("<u4"), n_best, total)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *packed], names=["chunk", "places", "n_best", "count_sum"])

    return rows


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, sums = None, np.zeros((2, 0), dtype=np.int64)

    def done() -> pa.RecordBatch:
        n = sums.shape[1]
        out = [pa.array(np.full(n, at)), pa.array(np.arange(n, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])]
        return pa.RecordBatch.from_arrays(out, names=["chunk", "place", "n_best", "count_sum"])

    for chunk, places, n_best, total in _rows(batches):
        if at != chunk:
            if at is not None:
                yield done()
            at, sums = chunk, np.zeros((2, 0), dtype=np.int64)
        place = np.frombuffer(places, "<u4").astype(np.int64)
        if len(place) and place[-1] >= sums.shape[1]:
            sums = np.pad(sums, ((0, 0), (0, int(place[-1]) + 1 - sums.shape[1])))
        sums[0, place] += np.frombuffer(n_best, "<i8")
        sums[1, place] += np.frombuffer(total, "<i8")
    if at is not None:
        yield done()


def link_documents(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, with_groups: bool = False, stripe: int = STRIPE, chars: int = CHUNK_CHARS, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """Documents and their chunks' links of docs (doc_id, text) as one written table: rows with a place are documents, rows
    with a stripe links. Call it within scratch() to have it deleted."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = f"{_DOC}, {_BLOCK}" + ", groups string" * with_groups
    return stored(own.mapInArrow(_linked(side_a, side_b, with_groups, stripe, chars, chunk_docs), schema))


def pair_counts(linked: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, stripe: int = STRIPE, fan: int = FAN) -> DataFrame:
    """b_id, a_id, count and best of every pair of ids that is linked anywhere in linked (from link_documents): how
    often, and whether no other A id is linked with the B id more often."""
    n_a = len(sides(side_a, side_b).bytes_a)
    counts = stripe_counts(linked.where("stripe is not null"), _chunk_count(linked), stripe, n_a, fan)

    def rows(batches):
        for s, pairs, sums in _rows(batches):
            pair, n = np.frombuffer(pairs, "<u4").astype(np.int64), np.frombuffer(sums, "<i8")
            b = pair // n_a
            top = np.zeros(stripe, dtype=np.int64)
            np.maximum.at(top, b, n)
            columns = [pa.array((b + s * stripe).astype(np.int32)), pa.array((pair % n_a).astype(np.int32)), pa.array(n), pa.array(n == top[b])]
            yield pa.RecordBatch.from_arrays(columns, names=["b_id", "a_id", "count", "best"])

    return counts.mapInArrow(rows, "b_id int, a_id int, count long, best boolean")


def _chunk_count(linked: DataFrame) -> int:
    return max(1, linked.where("place = 0").count())


def align(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, with_groups: bool = False, stripe: int = STRIPE, chars: int = CHUNK_CHARS, chunk_docs: int = CHUNK_DOCS, fan: int = FAN, scored_chunks: int = SCORED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256,
    and with_groups the groups themselves as ``a1,a2|b1;a3|b2,b3``.

    n_best are the links whose pair is counted as often as any of its B id in all documents (ties included), count_sum is the sum of
    the counts over all links. Null and empty texts, and those that either vocabulary does not give back byte by byte, have no
    tokens: zeros and an empty text. Texts are whole, however long. Rows that repeat count as often as they come, a null doc_id
    is a document like any other, other columns are left out. No rows give no rows.
    """
    linked = link_documents(docs, side_a, side_b, with_groups, stripe, chars, chunk_docs)
    n_a, chunks = len(sides(side_a, side_b).bytes_a), _chunk_count(linked)
    parts = -(-chunks // scored_chunks)
    links = linked.where("stripe is not null").select("stripe", F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part"), "chunk", "pairs", F.lit(None).cast("binary").alias("sums"), "n_docs", "docs", "times")
    none = [F.lit(None).cast("binary").alias(c) for c in ("n_docs", "docs", "times")]
    counts = stripe_counts(linked.where("stripe is not null"), chunks, stripe, n_a, fan)
    counts = counts.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(None).cast("long").alias("chunk"), "pairs", "sums", *none)
    beside = links.unionByName(counts).repartition("stripe", "part").sortWithinPartitions("stripe", "part", F.col("chunk").asc_nulls_first())
    scored = beside.drop("part").mapInArrow(_scored(stripe, n_a), "chunk long, places binary, n_best binary, count_sum binary")
    each = scored.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_per_document, "chunk long, place int, n_best long, count_sum long")
    own = linked.where("place is not null").join(each, ["chunk", "place"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256", *["groups"] * with_groups)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents"))
