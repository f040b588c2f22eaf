"""Nearest neighbours by additive quantisation, with an exact rerank.

``BOOKS`` codebooks of full-dimensional codewords, whose sum stands for a vector, are fitted on a
bounded sample (``SAMPLE`` vectors by hash order of the id): residual k-means first, then rounds of
beam-search encoding and a least-squares update of all codewords at once. Every vector is
encoded by beam search and stored as one byte per codebook, with its norm as a correction of the
length of its approximation and with the length of what the approximation leaves open. A query's
inner products with all codewords make a lookup table, and a candidate's score is the sum of its
table entries times its correction.

The exact inner product of a candidate lies within the query's length times the length left open
of that score (Cauchy-Schwarz). The best ``RERANK`` codes of a query are reranked first, which gives
it a least score; then every vector whose bound reaches that score is reranked too. So no neighbour
is lost at any number of vectors: codes save work only where they are close enough to exclude rows.

Queries go out in groups of a bounded size, each in two passes over the written codes, which are
read where they lie and never shuffled. The first pass scans one block in ``SCOUT`` and gives every query
the least score that its answers must reach; the second scans all blocks and gives out only what reaches
it, so what is shuffled is in proportion to the queries, whatever the number of vectors or tasks.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have another
length than most, take no part, nor do null ids; a query with fewer candidates than asked gets
all; ties go to the smaller id; repeated rows with one id count as one vector (the one of the
least components); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, written

by_value(__name__)

BOOKS, WORDS, BEAM, SAMPLE, ROUNDS, RERANK = 8, 256, 8, 12_000, 2, 200
#: Rows of a block, queries that are scored together, bytes of the queries of a group, and blocks of which one is scanned first.
CODE_BLOCK, QUERY_SLICE, GROUP_BYTES, SCOUT = 4096, 512, 2 << 20, 16


def valid(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>) of vectors that take part, one of each id."""
    v = F.col(value).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (dims[0] if dims else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            s = np.bincount(near, weights=x[:, d], minlength=k)
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Beam search over the codebooks in turn: the codes with the least error found."""
    m, k, d = books.shape
    flat = books.reshape(m * k, d)
    gram = flat @ flat.T
    norm = np.diag(gram)
    out = np.empty((len(x), m), dtype=np.uint8)
    for i in range(0, len(x), 256):
        part = x[i : i + 256]
        dots = part @ flat.T
        n = len(part)
        codes = np.zeros((n, 1, 0), dtype=np.int64)
        err = np.zeros((n, 1), dtype=np.float32)
        for b in range(m):
            cols = slice(b * k, (b + 1) * k)
            gain = err[:, :, None] + (norm[cols] - 2 * dots[:, cols])[:, None, :]
            for j in range(b):
                gain += 2 * gram[codes[:, :, j] + j * k, cols]
            wide = gain.reshape(n, -1)
            keep = min(beam if b < m - 1 else 1, wide.shape[1])
            best = np.argpartition(wide, keep - 1, axis=1)[:, :keep] if keep < wide.shape[1] else np.tile(np.arange(keep), (n, 1))
            err = np.take_along_axis(wide, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None].repeat(b, 2), 1) if b else np.zeros((n, keep, 0), np.int64), (best % k)[:, :, None]], axis=2)
        out[i : i + 256] = codes[:, 0]
    return out


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Codebooks (books, words, dimensions) from a sample."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    k = max(1, min(words, len(x) // 2 or 1))
    residual, c = x.copy(), np.zeros((books, k, x.shape[1]), dtype=np.float32)
    for b in range(books):
        c[b] = kmeans(residual, k, rng)
        residual -= c[b][((c[b] ** 2).sum(1) - 2 * (residual @ c[b].T)).argmin(1)]
    for _ in range(rounds):
        codes = encode(x, c).astype(np.int64) + np.arange(books) * k
        gram = np.zeros((books * k, books * k), dtype=np.float64)
        for a in range(books):
            for b in range(books):
                np.add.at(gram, (codes[:, a], codes[:, b]), 1.0)
        right = np.zeros((books * k, x.shape[1]))
        for a in range(books):
            np.add.at(right, codes[:, a], x)
        # pulled towards the old codewords, which settles what the sample leaves open
        pull = 0.5
        c = np.linalg.solve(gram + pull * np.eye(books * k), right + pull * c.reshape(books * k, -1)).reshape(c.shape).astype(np.float32)
    return c


def train(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    return fit(np.stack(picked.to_list())) if len(picked) else None


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def compact(x: np.ndarray) -> bytes:
    """As 4-byte floats where that loses nothing, else as 8-byte floats."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return (small if (small == x).all() else x.astype(np.float64)).tobytes()


def expanded(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * rows * dims else np.float64
    return np.frombuffer(data, dtype=kind).reshape(rows, dims).astype(np.float64)


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Written blocks of codes: block, ids, codes, corrections, lengths left open and vectors as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        from pyspark import TaskContext

        books = shared.value
        held, count, number, task = [], 0, 0, TaskContext.get().partitionId()
        lengths = np.sqrt((books.astype(np.float64) ** 2).sum(2))
        # what 4-byte sums over the dimensions and codebooks can be off by, as a share of the lengths
        blur = 2.0**-22 * (books.shape[2] + len(books) + 8)

        def flush():
            ids, codes, fix, left, x = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + number], pa.int64()), *[pa.array([b], pa.binary()) for b in (ids.tobytes(), codes.tobytes(), fix.tobytes(), left.tobytes(), compact(x))]], names=["block", "ids", "codes", "fix", "open", "vs"])

        for batch in batches:
            for i in range(0, batch.num_rows, CODE_BLOCK):
                part = batch.slice(i, CODE_BLOCK)
                x = matrix(part.column(1))
                codes = encode(x.astype(np.float32), books)
                near = sum(books[m][codes[:, m]].astype(np.float64) for m in range(len(books)))
                size, full = np.sqrt((near * near).sum(1)), np.sqrt((x * x).sum(1))
                fix = np.clip(np.where(size > 0, full / np.maximum(size, 1e-30), 1.0), 0.5, 2.0).astype(np.float32)
                sums = sum(lengths[m][codes[:, m]] for m in range(len(books)))
                left = np.sqrt(((x - fix[:, None] * near) ** 2).sum(1)) + blur * (fix * sums + full)
                held.append((part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), codes, fix, left, x))
                count += part.num_rows
                if count >= CODE_BLOCK:
                    yield flush()
                    held, count, number = [], 0, number + 1
        if held:
            yield flush()

    return written(rows.mapInArrow(run, "block long, ids binary, codes binary, fix binary, open binary, vs binary"), "codes")


class Best:
    """The ``top`` best (query, id, score) of each of n queries, and the least score that still counts."""

    def __init__(self, n: int, top: int, least: np.ndarray | None = None):
        self.top, self.least = top, np.full(n, -np.inf) if least is None else least.copy()
        self.q, self.i, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        q, i, s = np.concatenate([self.q, q]), np.concatenate([self.i, i]), np.concatenate([self.s, s])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.top
        self.q, self.i, self.s = q[keep], i[keep], s[keep]
        last = place == self.top - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Inner products of rows i of a and rows j of b; a pair's value depends on nothing else."""
    out = np.empty(len(i))
    for k in range(0, len(i), step):
        out[k : k + step] = (a[i[k : k + step]] * b[j[k : k + step]]).sum(axis=1)
    return out


def rerank_block(best: Best, at: np.ndarray, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, score: np.ndarray, left: np.ndarray, rerank: int) -> None:
    """All of a block that can be among the best of queries ``at``; score: (rows, queries) by code."""
    top = best.top
    sizes, longest = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    with np.errstate(over="ignore", invalid="ignore"):
        reach = score + left[:, None] * sizes[None, :]
    own = ids[:, None] == qids[None, :]
    least = best.least[at].copy()
    first = np.flatnonzero(least == -np.inf)
    if len(first) and len(ids) > rerank >= top:
        for k in first:
            c = np.argpartition(-np.where(own[:, k], -np.inf, score[:, k]), rerank - 1)[:rerank]
            c = c[~own[c, k]]
            if len(c) >= top:
                least[k] = np.partition(x[c] @ q[k], len(c) - top)[len(c) - top]
    # the matrix product rounds otherwise than products(), and nothing may hang on that
    blur = 2.0**-50 * (x.shape[1] + 8) * (longest.max(initial=0.0) * sizes)
    can = ~own & ~(reach < (least - blur)[None, :])
    rows = np.flatnonzero(can.any(axis=1))
    if not len(rows):
        return
    exact = np.where(can[rows], x[rows] @ q.T, -np.inf)
    if len(rows) > top:
        least = np.maximum(least, np.partition(exact, len(rows) - top, axis=0)[len(rows) - top])
    r, k = np.nonzero(can[rows] & (exact >= (least - 2 * blur)[None, :]))
    best.add(at[k], ids[rows[r]], products(q, x, k, rows[r]))


def scanned(codes: DataFrame, books, asked, top: int, rerank: int) -> DataFrame:
    """query_id, vec_id, score: each task's best of every query, as far as they reach the least scores in asked. books, asked (ids, vectors, least scores or None): broadcast."""

    def run(batches):
        cb, (ids_q, vq, floor) = books.value, asked.value
        m, _, d = cb.shape
        best, tables = Best(len(ids_q), top, floor), {}
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for ids, code, fix, left, vs in zip(*cols):
                ids, c = np.frombuffer(ids, dtype=np.int64), np.frombuffer(code, dtype=np.uint8).reshape(-1, m)
                x, left, fix = expanded(vs, len(ids), d), np.frombuffer(left, dtype=np.float64), np.frombuffer(fix, dtype=np.float32)[:, None]
                for i in range(0, len(ids_q), QUERY_SLICE):
                    part = slice(i, i + QUERY_SLICE)
                    at = np.arange(len(ids_q))[part]
                    if i not in tables:
                        tables[i] = np.ascontiguousarray(np.einsum("mkd,qd->mkq", cb, vq[part].astype(np.float32), optimize=True))
                    score = np.zeros((len(ids), len(at)), dtype=np.float32)
                    for b in range(m):
                        score += tables[i][b][c[:, b]]
                    score *= fix
                    rerank_block(best, at, ids_q[part], vq[part], ids, x, score, left, rerank)
        yield pa.RecordBatch.from_arrays([pa.array(ids_q[best.q]), pa.array(best.i), pa.array(best.s)], names=["query_id", "vec_id", "score"])

    return codes.select("ids", "codes", "fix", "open", "vs").mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, rerank: int = RERANK, books: np.ndarray | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score. vectors, queries: as from ``valid``; a query skips its own id."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    vectors = written(vectors, "vectors")
    if books is None:
        books = train(vectors)
    if books is None:
        return spark.createDataFrame([], out)
    codes, dims = encoded(vectors, books), books.shape[2]
    size = max(1, group_bytes // (8 * dims))
    groups = max(1, -(-queries.count() // size))
    asked = written(queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), "queries")
    shared = spark.sparkContext.broadcast(books)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    scouts = codes.where(F.pmod(F.xxhash64("block"), F.lit(SCOUT)) == 0)
    found = None
    for g in range(groups):
        rows = asked.where(F.col("g") == g).select("vec_id", "v").orderBy("vec_id").collect()  # a group of queries
        if not rows:
            continue
        qids, qv = np.array([r.vec_id for r in rows], dtype=np.int64), np.array([r.v for r in rows], dtype=np.float64)
        first = spark.sparkContext.broadcast((qids, qv, None))
        seen = scanned(scouts, shared, first, top, rerank).withColumn("rank", rank).where(F.col("rank") == top).select("query_id", "score").collect()  # one number a query at most
        least = np.full(len(qids), -np.inf)
        for r in seen:
            least[np.searchsorted(qids, r.query_id)] = r.score
        one = written(scanned(codes, shared, spark.sparkContext.broadcast((qids, qv, least)), top, rerank), "found")
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], out)
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
