"""Approximate nearest neighbours by inner product with additive quantisation.

A vector is coded as a sum of one word from each of M full-dimensional codebooks. The codebooks are
fitted one after another on what the ones before leave of a bounded sample; encoding keeps a beam of the
best partial sums and stores the codes with the norm of what they leave over. A query is scored against
a block of codes by one table of inner products per codebook. The exact rerank starts from the best
scores and goes on to every row whose score, given its stored norm, could still reach the 20th exact one.

Rows are dealt by the nearest of some coarse centres, each into blocks of bounded size. A query goes only to the
centres that are likely to hold its neighbours: how many, is measured on the sample, so that few are looked
at where vectors form clusters and most where they have no structure. A row goes to one block, however many
queries there are (up to QUERY_BLOCK), and only a block's best rows leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import FloatType

from cuelake.session import cut, read_table, ship

TOP = 20
CODEBOOKS, WORDS, BEAM = 16, 256, 4
#: Rows that the codebooks are fitted on, at most: those whose id has the smallest hash.
SAMPLE = 4096
#: Queries and rows of a block, at most; a block has its codes, its vectors and a slice of scores in memory.
QUERY_BLOCK, ROW_BLOCK = 8192, 16_384
#: Queries scored at a time within a block.
QUERY_SLICE = 256
#: Coarse centres: one for so many rows, but no more than this.
CENTRE_ROWS, CENTRES = 2048, 256
#: Share of the sample's neighbours that the centres a query goes to must hold.
REACHED = 0.98
#: A row is reranked if its score is within so many deviations of the score that it needs.
DEVIATIONS = 3.0
#: Rows scored at a time within a block.
SLICE = 1024


def usable(embedding: str = "embedding"):
    """Neither null nor empty nor zero, and without null or non-finite parts."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def fit_codebooks(sample: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = 6) -> np.ndarray:
    """(codebooks, words, dimensions): k-means on the residuals, codebook by codebook."""
    rng = np.random.default_rng(0)
    left = sample.astype(np.float32).copy()
    words = min(words, len(left))
    books = np.empty((codebooks, words, left.shape[1]), dtype=np.float32)
    for m in range(codebooks):
        c = left[rng.choice(len(left), words, replace=False)].copy()
        for _ in range(rounds):
            near = ((c * c).sum(1) - 2 * left @ c.T).argmin(1)
            n = np.bincount(near, minlength=words)
            sums = (near[None, :] == np.arange(words)[:, None]).astype(np.float32) @ left
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        near = ((c * c).sum(1) - 2 * left @ c.T).argmin(1)
        left -= c[near]
        books[m] = c
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """codes (n, M) and the norm of what they leave of each vector, by beam search."""
    n, m = len(x), len(books)
    norms = (books * books).sum(2)
    codes = np.zeros((n, 1, m), dtype=np.uint8)
    left = x.astype(np.float32)[:, None, :]
    for k in range(m):
        # |left - word|^2 of each beam and word; the beam of the smallest goes on.
        cost = (left * left).sum(2)[:, :, None] - 2 * left @ books[k].T + norms[k]
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        parent, word = best // len(norms[k]), best % len(norms[k])
        rows = np.arange(n)[:, None]
        codes, left = codes[rows, parent], left[rows, parent] - books[k][word]
        codes[:, :, k] = word
    over = (left * left).sum(2)
    first = over.argmin(1)
    return codes[np.arange(n), first], np.sqrt(over[np.arange(n), first])


def fit_centres(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n centres of the sample, by k-means."""
    return fit_codebooks(sample, 1, n)[0]


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x.astype(np.float32) @ centres.T).argmin(1)


def centre_order(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each query the centres, the likeliest to hold large inner products first."""
    return np.argsort(-(q.astype(np.float32) @ centres.T), axis=1, kind="stable")


def centres_to_visit(sample: np.ndarray, centres: np.ndarray, top: int, reached: float = REACHED, queries: int = 512) -> int:
    """How many centres, in the order of centre_order, hold ``reached`` of the ``top`` nearest rows of the sample. In
    all rows the nearest lie further out than in a sample of them, so the share there is larger."""
    q = sample[:queries].astype(np.float32)
    score = q @ sample.astype(np.float32).T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argpartition(-score, min(top, len(sample)) - 1, axis=1)[:, :top]
    place = np.argsort(centre_order(q, centres), axis=1)  # the rank of each centre
    ranks = np.sort(np.take_along_axis(place, nearest_centre(sample, centres)[best], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(reached * len(ranks))))]) + 1 if len(ranks) else len(centres)


def _first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Which rows, sorted by keys, are the first with theirs."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _once(sure: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """sure (queries, rows) with -inf but for the best row of each id, where ids (of the same shape) repeat."""
    order = np.lexsort((-sure, ids), axis=1)
    own = np.take_along_axis(ids, order, axis=1)
    again = np.zeros_like(order, dtype=bool)
    again[:, 1:] = own[:, 1:] == own[:, :-1]
    out = sure.copy()
    rows, k = np.nonzero(again)
    out[rows, order[rows, k]] = -np.inf
    return out


def search(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, codes: np.ndarray, rest: np.ndarray, books: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query index, row index and exact score of the best ``top`` ids of a block for each query. An id of several
    rows has one place, that of its best row, and is counted once in what a row must reach."""
    q32 = q.astype(np.float32)
    tables = np.einsum("mwd,qd->mwq", books, q32)  # a row of scores over the queries for each code word
    score = np.empty((len(x), len(q)), dtype=np.float32)
    for at in range(0, len(x), SLICE):
        part = codes[at : at + SLICE]
        s = tables[0][part[:, 0]]
        for m in range(1, len(books)):
            s += tables[m][part[:, m]]
        score[at : at + SLICE] = s
    score[x_id[:, None] == q_id[None, :]] = -np.inf  # a query is no candidate of its own
    exact = lambda rows, qi: (x[rows] * q[qi]).sum(axis=1)  # noqa: E731  the same order of additions for every pair
    # How far a score may be off: what the codes leave over has a random direction, and scores are
    # single precision.
    doubt = DEVIATIONS * rest / np.sqrt(q.shape[1]) + 1e-5 * np.sqrt((x * x).sum(1))
    size = np.sqrt((q * q).sum(1))
    start = min(3 * top, len(x))
    first = np.argpartition(-score, start - 1, axis=0)[:start].T
    sure = exact(first.ravel(), np.repeat(np.arange(len(q)), start)).reshape(len(q), start)
    sure[~np.isfinite(score[first, np.arange(len(q))[:, None]])] = -np.inf
    if len(np.unique(x_id)) < len(x_id):
        sure = _once(sure, x_id[first])
    need = -np.partition(-sure, min(top, start) - 1, axis=1)[:, min(top, start) - 1]
    doubt, size, need = (a.astype(np.float32) for a in (doubt, size, need))
    found = []
    for at in range(0, len(x), SLICE):
        part = score[at : at + SLICE]
        r, k = np.nonzero(part + doubt[at : at + SLICE, None] * size >= need)
        alive = np.isfinite(part[r, k])
        found.append((r[alive] + at, k[alive]))
    rows, qi = map(np.concatenate, zip(*found))
    value = np.concatenate([exact(rows[i : i + 65536], qi[i : i + 65536]) for i in range(0, len(rows), 65536)] or [np.empty(0)])
    order = np.lexsort((-value, x_id[rows], qi))
    order = order[_first_of_each(qi[order], x_id[rows[order]])]
    order = order[np.lexsort((x_id[rows[order]], -value[order], qi[order]))]
    rows, qi, value = rows[order], qi[order], value[order]
    new = np.r_[True, qi[1:] != qi[:-1]] if len(qi) else np.empty(0, dtype=bool)
    place = np.arange(len(qi)) - np.maximum.accumulate(np.where(new, np.arange(len(qi)), 0)) if len(qi) else np.empty(0, dtype=int)
    best = place < top
    return qi[best], rows[best], value[best]


def _matrix(column: pa.Array, n: int, dtype: str) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=dtype).reshape(n, -1)


def _pack_queries(centres, visit: int, dtype: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), b.num_rows, dtype)
                order = centre_order(x, centres.value)[:, :visit].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(order.tolist(), pa.list_(pa.int32()))], names=["vec_id", "vector", "centres"])

    return rows


def _encode_rows(books, centres, dtype: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = _matrix(part.column(1), part.num_rows, dtype)
                codes, rest = encode(x, books.value)
                columns = [part.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest.astype(np.float32)), pa.array(nearest_centre(x, centres.value).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "codes", "rest", "centre"])

    return rows


def _search_blocks(books, top: int, dtype: str):
    def block(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        whole = lambda t: np.frombuffer(b"".join(t["vector"]), dtype=dtype).reshape(len(t), -1).astype(np.float64)
        x, x_id = whole(rows), rows["vec_id"].to_numpy()
        codes, rest = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(x), -1), rows["rest"].to_numpy()
        found = []
        for at in range(0, len(queries), QUERY_SLICE):
            part = queries.iloc[at : at + QUERY_SLICE]
            q_id = part["vec_id"].to_numpy()
            qi, ri, score = search(whole(part), q_id, x, x_id, codes, rest, books.value, top)
            found.append(pd.DataFrame({"query_id": q_id[qi], "vec_id": x_id[ri], "score": score}))
        return pd.concat(found)

    return block


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, embedding) its ``top`` nearest rows
    of vectors with another vec_id, by inner product in double precision, ties to the smaller vec_id.

    Rows whose vec_id is null, or whose vector is null, empty, zero, of another length than most of the
    sample, or holds null or non-finite parts, take no part. Vectors of doubles are kept as doubles. Rows that repeat a
    vec_id with an equal vector are one from the start, however many they are; with other vectors, the best one counts and
    takes one place. A query id that repeats asks with each of its vectors, and the best score counts. Other columns are
    ignored; where nothing is left there are no rows.
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    single = all(t.schema["embedding"].dataType.elementType == FloatType() for t in (vectors, queries))
    kind, dtype = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    clean = lambda t: t.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(usable() & F.col("vec_id").isNotNull())
    vectors, queries = cut(clean(vectors).distinct()), clean(queries).distinct()
    result = "query_id long, rank int, vec_id long, score double"
    drawn = vectors.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).collect()  # at most ``sample`` rows
    if not drawn:
        return spark.createDataFrame([], result)
    lengths = [len(r["embedding"]) for r in drawn]
    size = max(sorted(set(lengths)), key=lengths.count)
    vectors, queries = (t.where(F.size("embedding") == size) for t in (vectors, queries))
    few = np.array([r["embedding"] for r in drawn if len(r["embedding"]) == size])
    n_rows, n_queries = vectors.count(), queries.count()  # without repeats
    points = fit_centres(few, max(1, min(CENTRES, n_rows // CENTRE_ROWS, len(few) // 8)))
    books, centres = spark.sparkContext.broadcast(fit_codebooks(few)), spark.sparkContext.broadcast(points)
    coded = cut(vectors.mapInArrow(_encode_rows(books, centres, dtype), "vec_id long, vector binary, codes binary, rest float, centre int"))
    visit = centres_to_visit(few, points, top)
    asked = cut(queries.mapInArrow(_pack_queries(centres, visit, dtype), "vec_id long, vector binary, centres array<int>"))
    # Each centre's rows in blocks: at least 32 blocks in all, so that there is work for many tasks.
    wanted = max(1, min(ROW_BLOCK, -(-n_rows // 32)))
    blocks = {r["centre"]: -(-r["count"] // wanted) for r in coded.groupBy("centre").count().collect()}  # at most CENTRES rows
    parts = spark.createDataFrame(sorted(blocks.items()), "centre int, blocks int")
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    number = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.withColumn("qb", number(F.lit(query_blocks))).select("vec_id", "vector", "qb", F.explode("centres").alias("centre"))
    left = left.join(F.broadcast(parts), "centre").withColumn("rb", every(F.col("blocks"))).drop("blocks")
    right = coded.join(F.broadcast(parts), "centre").withColumn("rb", number(F.col("blocks"))).drop("blocks").withColumn("qb", every(F.lit(query_blocks)))
    keys = ["centre", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search_blocks(books, top, dtype), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
