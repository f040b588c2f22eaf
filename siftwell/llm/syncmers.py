"""Document fingerprints of closed syncmers.

Of all k-mers of code points those are anchors whose least s-mer (by hash) is their first or
last: a choice that no text around the k-mer can change. A fingerprint holds every anchor of the
whole text (about one in twelve places), as its hash and the position of its first occurrence, in
ascending order of the hashes. Two fingerprints are compared by the anchors they share, as far as
their positions ascend in both (the longest such chain): the chain's length as Dice's coefficient,
2 * chain / (anchors of one + anchors of the other).

The query pairs each text with its edited text and with the next document. Documents are dealt
into ranges of doc_id, so that neighbours meet in one task; each range also gets the next
range's first document.

Edge cases: null text counts as empty; texts too short for an anchor have one anchor, the hash of
the whole text, and the empty text has none (its fingerprint is ''); equal fingerprints have
likeness 1, an empty one with any other 0; rows with equal ids are ordered by text, null ids come
last; the only row is its own next; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, text_bytes

by_value(__name__)

K, S = 29, 6
#: Bytes of text in one range of documents, and the most ranges (their first ids are held by the driver).
RANGE_BYTES, MOST_RANGES = 16 << 20, 20_000
_U = np.uint64
_LAST = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: ascending distinct 32-bit hashes of its anchors, and their first positions."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    none = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    out = [none] * len(texts)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(cp) >= K:
        n = len(cp) - S + 1
        s = np.zeros(n, dtype=np.uint64)
        for j in range(S):
            s *= _U(0x9E3779B1)
            s += cp[j : j + n]
        s = mixed(s)
        span = K - S + 1  # s-mers in a k-mer
        m = s
        width = 1
        while width * 2 <= span:
            m = np.minimum(m[: len(m) - width], m[width:])
            width *= 2
        m = np.minimum(m[: len(s) - span + 1], m[span - width : span - width + len(s) - span + 1])
        closed = (m == s[: len(m)]) | (m == s[span - 1 : span - 1 + len(m)])
        at = np.flatnonzero(closed)
        doc = np.searchsorted(ends, at, side="right")
        inside = at + K <= ends[np.minimum(doc, len(ends) - 1)]
        at, doc = at[inside], doc[inside]
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(K):
            h *= _U(0x100000001B3)
            h += cp[at + j]
        h = (mixed(h) >> _U(32)).astype(np.uint32)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in np.unique(doc).tolist():
            a, b = cuts[i], cuts[i + 1]
            mine, pos = h[a:b], at[a:b] - begin[i]
            hashes, first = np.unique(mine, return_index=True)
            out[i] = (hashes, pos[first])
    for i, (t, x) in enumerate(zip(texts, out)):
        if t and not len(x[0]):
            whole = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big")
            out[i] = (np.array([whole], np.uint32), np.zeros(1, np.int64))
    return out


def to_string(x: tuple[np.ndarray, np.ndarray]) -> str:
    """Hex: eight digits of hash and eight of position for each anchor."""
    both = np.empty(len(x[0]) * 2, dtype=">u4")
    both[0::2], both[1::2] = x[0], np.minimum(x[1], 0xFFFFFFFF)
    return both.tobytes().hex()


def from_string(s: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(bytes.fromhex(s), dtype=">u4")
    return both[0::2].astype(np.uint32), both[1::2].astype(np.int64)


def likeness(x, y) -> float:
    """0 to 1; x and y as from ``anchors``."""
    (hx, px), (hy, py) = x, y
    if len(hx) == len(hy) and (hx == hy).all():
        return 1.0
    if not len(hx) or not len(hy):
        return 0.0
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    order = np.lexsort((py[j], px[i]))
    tails: list[int] = []
    for v in py[j][order].tolist():  # longest ascending chain of positions
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
        else:
            tails[k] = v
    return 2 * len(tails) / (len(hx) + len(hy))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each text."""

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_string(x) for x in anchors(texts)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("fingerprint", "string"))


def _rows(batches):
    """Rows sorted by (bucket, key, text, sentinel) -> results; a row waits for the one after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None  # (bucket, doc_id, text, sentinel, anchors)
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(4)]
        i = 0
        while i < len(cols[0]):
            j, size = i, 0
            while j < len(cols[0]) and (j == i or size < 400_000):
                size += len(cols[2][j] or "")
                j += 1
            texts = [x or "" for x in cols[2][i:j]]
            rows = list(zip(cols[0][i:j], cols[1][i:j], texts, cols[3][i:j], anchors(texts)))
            i = j
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            ready = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3] and a[0] == b[0]]
            if not ready:
                continue
            edited = [a[2][: len(a[2]) - len(a[2]) // 2] + b[2][: len(a[2]) // 2] for a, b in ready]
            marks = anchors(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[1] for a, _ in ready], batch.schema.field(1).type), pa.array([len(a[2]) for a, _ in ready], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]), pa.array([to_string(a[4]) for a, _ in ready]),
                    pa.array([to_string(m) for m in marks]), pa.array([likeness(a[4], m) for (a, _), m in zip(ready, marks)], pa.float64()), pa.array([likeness(a[4], b[4]) for a, b in ready], pa.float64()),
                ],
                names=names,
            )


def _place(key, marks: list[int]):
    """How many of the ascending marks are less than key, by two levels of steps."""
    if not marks:
        return F.lit(0)
    step = math.isqrt(len(marks)) + 1
    blocks = [marks[i : i + step] for i in range(0, len(marks), step)]
    below = lambda xs: F.size(F.filter(xs, lambda m: m < key))
    # blocks whose last mark is less than key count whole
    whole = below(F.array(*[F.lit(b[-1]).cast("long") for b in blocks]))
    inside = F.element_at(F.array(*[F.array(*[F.lit(m).cast("long") for m in b]) for b in blocks]), F.least(whole + 1, F.lit(len(blocks))))
    return (F.when(whole == len(blocks), F.lit(len(marks))).otherwise(whole * step + below(inside))).cast("int")


def fingerprints_with_neighbours(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The fingerprints of texts, of edited texts, and their likenesses; one row per input row."""
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(_LAST)).cast("long").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, min(MOST_RANGES, -(-text_bytes(docs) // range_bytes)))
    marks = rows.select(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()[0] if parts > 1 else None
    marks = sorted(set(marks or []))  # fewer numbers than ranges
    rows = rows.withColumn("bucket", _place(F.col("key"), marks))
    firsts = [(r.bucket, r.key) for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()]
    if not firsts:
        return rows.select("doc_id").mapInArrow(lambda batches: iter(()), _schema(docs))
    # the first row of each range stands again at the end of the range before it
    spark = docs.sparkSession
    before = spark.createDataFrame([(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)], "key long, bucket int")
    guests = rows.drop("bucket").join(F.broadcast(before), "key").groupBy("key", "doc_id", "bucket").agg(F.min("text").alias("text"))
    every = rows.select("bucket", "key", "doc_id", "text", F.lit(False).alias("guest")).union(guests.select("bucket", "key", "doc_id", "text", F.lit(True)))
    dealt = every.repartitionById(len(marks) + 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", "key", "text")
    return dealt.select("bucket", "doc_id", "text", "guest").mapInArrow(_rows, _schema(docs))


def _schema(docs: DataFrame):
    schema = docs.select("doc_id").schema
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        schema = schema.add(name, kind)
    return schema
