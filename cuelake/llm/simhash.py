"""SimHash near-duplicates, compared bit-sliced.

A text's fingerprint has bit b set if more than half of its word shingles' XXH64 values have it set.
Fingerprints that differ in at most RADIUS bits are linked, and linked documents form components.

Candidates come from a pigeonhole split: 64 bits in five blocks, of which at most three can differ,
so two of them agree; each of the ten pairs of blocks is one table keyed by those 25 or 26 bits.
Within a key the fingerprints are held as vertical bit planes, 64 lanes to a machine word. A query
fingerprint is compared with 64 lanes by one XOR per plane, added up by carry-save counters, and a
(query, word) pair is abandoned as soon as no lane of it can still be within the radius.

Identical fingerprints are merged before the search, so exact copies cost one row. A key with more
than CHUNK fingerprints is dealt out as pairs of chunks over many tasks, so that a ball of near copies
neither lands in one task nor sends out its pairs: each block pair returns a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake.llm.common import join_unique, row_key
from cuelake.session import broadcast_if_small, cut, read_table, ship

RADIUS = 3
SHINGLE = 3
#: Bits of the five blocks; any two give 25 or 26 bits.
BLOCKS = (13, 13, 13, 13, 12)
CHUNK = 1024
#: (query, word) pairs that are compared at a time: some MB of counters.
SLICE = 1 << 15
_BITS = np.arange(64, dtype=np.uint64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    # Joined once: a shingle is a slice of the joined text from its first word to its last.
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):  # unpacked bits of a slice: 256 KB, however long the text
        votes += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((votes * 2 > n).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = np.fromiter((fingerprint(t.as_py()) for t in b.column(2)), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h.view(np.int64))], names=["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (XXH64 of the text) and fp, a signed 64-bit fingerprint, of each row."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text").mapInArrow(_fingerprints, "doc_id long, row_key long, fp long")


def _within(fp: np.ndarray, run_end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < run_end[i], of fingerprints within the radius, in slices."""
    n = len(fp)
    words = -(-n // 64)
    padded = np.zeros(words * 64, dtype=np.uint64)
    padded[:n] = fp
    # planes[b][w]: bit b of the 64 fingerprints of word w.
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    rows = np.flatnonzero(run_end > np.arange(n) + 1)
    first, last = (rows + 1) // 64, (run_end[rows] - 1) // 64
    spans = last - first + 1
    cum = np.concatenate(([0], np.cumsum(spans)))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, int(cum[-1]), SLICE):
        k = np.arange(at, min(at + SLICE, int(cum[-1])))
        r = np.searchsorted(cum, k, side="right") - 1
        q, w = rows[r], first[r] + (k - cum[r])
        # Lanes outside (q, run_end) count as exceeded from the start.
        lo = np.clip(q + 1 - w * 64, 0, 64).astype(np.uint64)
        hi = np.clip(run_end[q] - w * 64, 0, 64).astype(np.uint64)
        below = np.where(lo >= 64, full, (np.uint64(1) << np.minimum(lo, np.uint64(63))) - np.uint64(1))
        upto = np.where(hi >= 64, full, (np.uint64(1) << np.minimum(hi, np.uint64(63))) - np.uint64(1))
        over = below | ~upto
        # Counters by weight 1, 2, 4 ...; what carries out of the last one, or passes the radius, is over.
        counters = [np.zeros(len(q), dtype=np.uint64) for _ in range(radius.bit_length())]
        for b in range(64):
            own = np.uint64(0) - ((fp[q] >> np.uint64(b)) & np.uint64(1))
            carry = planes[b][w] ^ own
            for c in counters:
                c ^= carry
                carry &= ~c
            over |= carry
            if b % 8 == 7:
                alive = over != full
                if not alive.all():
                    q, w, over = q[alive], w[alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not len(q):
                    break
        if not len(q):
            continue
        if radius + 1 != 1 << radius.bit_length():  # counts above the radius that the counters can hold
            total = np.zeros((len(q), 64), dtype=np.int64)
            for s, c in enumerate(counters):
                total += np.unpackbits(c.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64) << s
            over |= np.ascontiguousarray(np.packbits(total > radius, axis=1, bitorder="little")).view(np.uint64).ravel()
        p, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield q[p], w[p] * 64 + lane


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of label that the pairs join; a label is the smallest position of its set."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def _forest(radius: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input sorted by (key, part). A run of equal (key, part) may go on in the next batch."""
        key, part, fp = (np.empty(0, dtype=np.int64) for _ in range(3))

        def links(key, part, fp):
            n = len(fp)
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            run_end = np.repeat(np.r_[new[1:], n], np.diff(np.r_[new, n]))
            label = np.arange(n)
            for a, b in _within(fp.view(np.uint64), run_end, radius):
                label = _union(label, a, b)
            child = np.flatnonzero(label != np.arange(n))
            return pa.RecordBatch.from_arrays([pa.array(fp[label[child]]), pa.array(fp[child])], names=["a", "b"])

        for b in batches:
            got = [np.asarray(b.column(i)) for i in range(3)]
            key, part, fp = (np.concatenate((x, y)) for x, y in zip((key, part, fp), got))
            if len(key) < 2:
                continue
            same = (key == key[-1]) & (part == part[-1])
            done = int(len(key) - same[::-1].argmin()) if not same.all() else 0
            if done:
                yield links(key[:done], part[:done], fp[:done])
                key, part, fp = key[done:], part[done:], fp[done:]
        if len(key):
            yield links(key, part, fp)

    return rows


def near_links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``distinct`` (column fp) within the radius: for each
    key and pair of chunks a spanning forest, so at most as many rows as the search reads."""
    shift, blocks, keys = 0, [], []
    for width in BLOCKS:
        blocks.append(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1))
        shift += width
    # Of five blocks radius can differ; what agrees is 5 - radius of them.
    for t, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - radius)):
        value = F.lit(t).cast("long")
        for i in chosen:
            value = F.shiftleft(value, BLOCKS[i]).bitwiseOR(blocks[i])
        keys.append(value)
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = cut(keyed.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))
    dealt = keyed.join(broadcast_if_small(hot), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # Chunk c meets every chunk, itself included with any other: the pairs (low, high), low < high, or the one chunk.
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: (F.col("chunks") == 1) | (c != F.col("own"))))
    dealt = dealt.withColumn("own", own).select("key", "fp", "chunks", "own", other.alias("other"))
    part = F.least("own", "other").cast("long") * F.col("chunks") + F.greatest("own", "other")
    dealt = dealt.select("key", part.alias("part"), "fp")
    ship(distinct.sparkSession)
    found = dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_forest(radius), "a long, b long")
    return found.distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links reach, for every node with a link.

    Alternating large-star and small-star steps; each replaces a node's neighbours' links by links to
    the smallest one, and every step is a grouped minimum and a join in which a hub's links are dealt over tasks.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        seen = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_unique(both.where("v > u"), least.drop("n"), ["u"], least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_unique(large, least.drop("n"), ["u"], least).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def fingerprint_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id, keep_key for each distinct fingerprint of ``prints`` (checkpointed
    doc_id, row_key, fp): the smallest doc_id of its component, and the row_key of that row."""
    distinct = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")))
    roots = components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(firsts, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("keep_key"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint, component_id.

    A null or empty text has fingerprint 0 and is linked like any other, long ones are read whole. Rows that repeat are returned
    as often as they come; a null doc_id is never a component's id unless all its ids are null. Other
    columns are ignored. No rows give no rows.
    """
    prints = cut(fingerprints(docs))
    parts = fingerprint_components(prints, radius)
    return prints.select("doc_id", "fp").join(parts.select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, of several with that id the one whose
    text has the smallest hash. All columns are kept as they are, whatever their names.

    Of rows that repeat id and text the one whose columns, as JSON, come first stays, so that a recomputed task keeps the
    same. Null and empty texts are near-duplicates of each other; a null doc_id stays only where a component has no
    other; long texts are read whole; no rows give no rows. Texts move at most once: what goes is known by id and hash.
    """
    prints = cut(fingerprints(docs))
    parts = fingerprint_components(prints, radius)
    own = prints.groupBy("fp", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    judged = own.join(parts, "fp").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("keep_key")))
    judged = cut(judged.select("doc_id", "row_key", "n", "stays"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"), row_key().alias("_key"))

    def same(t: DataFrame, how: str) -> DataFrame:
        t = broadcast_if_small(t.select(F.col("doc_id").alias("_i"), F.col("row_key").alias("_k")))
        return row.join(t, row._id.eqNullSafe(F.col("_i")) & (row._key == F.col("_k")), how)

    repeated = judged.where("stays and n > 1")
    out = same(judged.where("not stays or n > 1"), "left_anti").select("row")
    if repeated.limit(1).count():  # few, if ids are what their name says
        first = Window.partitionBy("_id", "_key").orderBy(F.to_json("row"))
        out = out.unionByName(same(repeated, "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1").select("row"))
    return out.select("row.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
