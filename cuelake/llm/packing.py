"""Best-fit packing of tokenised documents with large-item matching.

A document is its token ids and a closing id. Documents over the capacity are cut from the end into
full pieces, so that only the first can be shorter. Lengths are whole numbers up to the capacity, so the
packing is planned on their histogram alone, which has at most ``capacity`` rows however many documents
there are: pieces above a third of the capacity are matched greedily, the longest with the longest that
still fits, so at most two share a sequence; shorter ones then go, longest first, to the tightest gap.
The plan is a table of slot runs by length; a piece takes the slot of its rank among equal lengths.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake.session import cut, read_table, ship

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
#: White space of this many characters in a row is left to the tokenizers library.
LONG = 10_000
#: Rows that one ranking group of a length should have.
RANKED = 20_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """text -> ids, as the tokenizers library gives them with add_special_tokens=False.

    vocabulary: a name of the public_tokenizers package, or a path without its ending; the file of
    ranks and the one of the tokenizers library hold the same vocabulary. tiktoken merges several times
    faster with equal ids. Two kinds of text go to the tokenizers library itself: those with a special
    token's string, which only it knows, and those with very long runs of white space, on which the
    other's pattern would run out of stack.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    base = vocabulary if os.sep in vocabulary else None
    full, ranked = (f"{base}{x}" if base else public_tokenizers.path(f"{vocabulary}{x}") for x in (".json", ".tiktoken"))
    with open(ranked, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    slow = Tokenizer.from_file(full)
    with open(full, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f).get("added_tokens", [])]

    blank = re.compile(rf"\s{{{LONG}}}")

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or len(text) >= LONG and blank.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def _pieces(vocabulary: str, capacity: int, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                    lo, k = 0, 0
                    hi = len(ids) % capacity or capacity
                    while lo < len(ids):
                        part = ids[lo:hi]
                        doc.append(i), piece.append(k), start.append(lo), length.append(len(part)), crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                        lo, hi, k = hi, hi + capacity, k + 1
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each row of docs."""
    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(vocabulary, capacity, with_ids), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, copies in each)]) groups that hold ``counts`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(n: int, items: list[tuple[int, int]], gap: int) -> None:
        if n:
            if gap not in by_gap:
                by_gap[gap] = []
                insort(gaps, gap)
            by_gap[gap].append((n, items))

    for a in reversed(large):
        while left[a]:
            fit = bisect_left(large, capacity - a + 1) - 1  # the longest large piece that fits beside a
            while fit >= 0 and not left[large[fit]]:
                fit -= 1
            b = large[fit] if fit >= 0 else None
            if b is None or b == a and left[a] < 2 and fit == 0:
                put(left[a], [(a, 1)], capacity - a)
                left[a] = 0
            elif b == a and left[a] >= 2:
                put(left[a] // 2, [(a, 2)], capacity - 2 * a)
                left[a] %= 2
            else:
                if b == a:  # one piece of a is left: the next shorter one
                    fit -= 1
                    while fit >= 0 and not left[large[fit]]:
                        fit -= 1
                    b = large[fit] if fit >= 0 else None
                n = min(left[a], left[b]) if b is not None else left[a]
                put(n, [(a, 1), (b, 1)] if b is not None else [(a, 1)], capacity - a - (b or 0))
                left[a] -= n
                if b is not None:
                    left[b] -= n

    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[a]
        while c:
            at = bisect_left(gaps, a)
            if at == len(gaps):
                k = capacity // a
                put(c // k, [(a, k)], capacity - k * a)
                put(int(c % k > 0), [(a, c % k)], capacity - c % k * a)
                break
            gap = gaps[at]
            n, items = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[at]
            k = gap // a
            if c >= k:
                full = min(n, c // k)
                put(full, [*items, (a, k)], gap - k * a)
                put(n - full, items, gap)
                c -= full * k
            else:
                put(1, [*items, (a, c)], gap - c * a)
                put(n - 1, items, gap)
                c = 0
    return [group for gap in gaps for group in by_gap[gap]]


def slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Runs of slots, sorted: length, first rank, first sequence, copies in each sequence, offset."""
    rows, taken, first = [], {}, 0
    for n, items in groups:
        offset = 0
        for length, copies in items:
            rows.append((length, taken.get(length, 0), first, copies, offset))
            taken[length] = taken.get(length, 0) + n * copies
            offset += length * copies
        first += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(table):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, copies, offset = table.value.T
        # The last run at or below (length, rank); ranks stay far below 2 ** 48.
        keys = (length << 48) + rank
        for b in batches:
            own, r = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            at = np.searchsorted(keys, (own << 48) + r, side="right") - 1
            k = r - rank[at]
            sequence, place = first[at] + k // copies[at], offset[at] + k % copies[at] * own
            kept = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(sequence), pa.array(place)], names=[*kept, "sequence_id", "offset"])

    return rows


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces (checkpointed, as pieces() gives them) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    groups = max(32, sum(counts.values()) // RANKED)
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    # Rank among equal lengths: the rank within (length, salt), after all rows of smaller salts.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    offsets = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    columns = cut_pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema) + ", sequence_id long, offset long"
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    return ranked.select(*columns, F.col("rank").cast("long").alias("rank")).mapInArrow(_place(table), schema)


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and with_ids the ids themselves.

    A null or empty text is the closing id alone; very long ones are cut into as many pieces as they need. Rows that repeat are packed as often as they come, a
    null doc_id like any other; other columns are ignored. No rows give no rows.
    """
    return pack(cut(pieces(docs, capacity, vocabulary, with_ids)), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
