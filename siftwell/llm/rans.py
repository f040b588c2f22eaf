"""Token files by a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by all blocks. A block holds whole
documents; its ids are dealt over interleaved lanes, each with a 64-bit state that gives off
32-bit words, so numpy codes a step of all lanes at once. Blocks are independent of each other;
a block also keeps checkpoints (the lanes' states and the place in the words every
``EVERY`` steps), from which any part can be decoded alone, and checksums of all that follows its
header and of its ids.

A block is bytes: magic, header, documents' ids and sizes, checkpoints, words. On a cluster the
blocks are rows of a written table (``blocks``), which Spark's writer commits, so a lost
executor's blocks are written again; ``write_file`` and ``read_file`` hold them in a plain file.

Edge cases: null and empty texts hold just the end id; a null id comes after all others;
repeated rows are kept each, in any order among themselves; an empty table gives no blocks and
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, text_bytes, written
from .tokens import text_slices, worker_encoder

by_value(__name__)

PRECISION, LOW, EVERY, LANES, SYMBOLS, END = 20, 1 << 31, 256, 1024, 1 << 19, 0
#: Bytes of text in one range of documents, and the most ranges (their sums are held by the driver).
RANGE_BYTES, MOST_RANGES = 32 << 20, 20_000
MAGIC, HEADER = b"rANS1\n", "<QIIQIIII"
NULL_ID = -(1 << 63)


class Table:
    """Frequencies that sum to 2**PRECISION; every id that occurs has at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        total, size = int(counts.sum()), 1 << PRECISION
        if not total:
            out = np.zeros(max(1, len(counts)), dtype=np.int64)
            out[0] = size
            return out
        out = np.where(counts > 0, np.maximum(1, np.floor(counts / total * size).astype(np.int64)), 0)
        over = int(out.sum()) - size
        for i in np.argsort(-out, kind="stable"):  # take from, or give to, the most frequent
            if not over:
                break
            step = min(over, int(out[i]) - 1) if over > 0 else over
            out[i] -= step
            over -= step
        return out


def encode_block(ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray, start: int, table: Table) -> bytes:
    """ids of whole documents -> one block. start: ids of all documents before the block."""
    n = len(ids)
    lanes = LANES
    while lanes > 1 and n < lanes * 64:
        lanes //= 2
    steps = -(-n // lanes)
    sym = np.full(steps * lanes, ids[0] if n else 0, dtype=np.int64)
    sym[:n] = ids
    sym = sym.reshape(steps, lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words, marks = [None] * steps, {}
    p, w32, limit = np.uint64(PRECISION), np.uint64(32), np.uint64(63 - PRECISION)
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[sym[t]], table.cum[sym[t]]
        full = x >= (f << limit)
        words[t] = x[full].astype(np.uint32)
        x[full] >>= w32
        q = x // f
        x = (q << p) + (x - q * f) + c
        if t and t % EVERY == 0:
            marks[t] = x.copy()
    marks[0] = x
    place = np.cumsum([0, *(len(w) for w in words)])
    body = np.concatenate(words).astype("<u4").tobytes() if steps else b""
    points = b"".join(struct.pack("<IQ", t, int(place[t])) + marks[t].astype("<u8").tobytes() for t in sorted(marks))
    rest = docs.astype("<i8").tobytes() + sizes.astype("<i8").tobytes() + points + body
    return MAGIC + struct.pack(HEADER, n, lanes, steps, start, len(docs), len(marks), zlib.crc32(rest), zlib.crc32(ids.astype("<u4").tobytes())) + rest


def decode_block(block: bytes, table: Table, first_step: int = 0, last_step: int | None = None):
    """(start, documents' ids, sizes, ids); with steps given, only ids of those steps, from the nearest checkpoint."""
    if block[: len(MAGIC)] != MAGIC:
        raise ValueError("not a block")
    at = len(MAGIC)
    n, lanes, steps, start, n_docs, n_marks, crc_rest, crc_ids = struct.unpack_from(HEADER, block, at)
    at += struct.calcsize(HEADER)
    if zlib.crc32(memoryview(block)[at:]) != crc_rest:
        raise ValueError("the block is damaged")
    docs = np.frombuffer(block, "<i8", n_docs, at)
    sizes = np.frombuffer(block, "<i8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    points = []
    for _ in range(n_marks):
        t, place = struct.unpack_from("<IQ", block, at)
        points.append((t, place, np.frombuffer(block, "<u8", lanes, at + 12)))
        at += 12 + 8 * lanes
    words = np.frombuffer(block, "<u4", offset=at).astype(np.uint64)
    t0, place, x = max((p for p in points if p[0] <= first_step), key=lambda p: p[0])
    last = steps if last_step is None else min(last_step, steps)
    x, out = x.astype(np.uint64), np.empty((max(0, last - t0), lanes), dtype=np.uint32)
    mask, p, w32, low = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32), np.uint64(LOW)
    for t in range(t0, last):
        slot = x & mask
        s = table.slot[slot]
        out[t - t0] = s
        x = table.freq[s] * (x >> p) + slot - table.cum[s]
        need = np.flatnonzero(x < low)
        if len(need):
            x[need] = (x[need] << w32) | words[place : place + len(need)]
            place += len(need)
    if first_step or last_step is not None:
        return start, docs, sizes, out[first_step - t0 :].reshape(-1)[: max(0, n - first_step * lanes)]
    ids = out.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("the block's ids are damaged")
    return start, docs, sizes, ids


def write_file(path: str, blocks: list[bytes], freq: np.ndarray) -> None:
    """A plain file: the table, an index of the blocks, the blocks."""
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<II", len(freq), len(blocks)) + freq.astype("<u4").tobytes() + np.array([len(b) for b in blocks], dtype="<u8").tobytes())
        f.writelines(blocks)


def read_file(path: str) -> tuple[list[bytes], np.ndarray]:
    with open(path, "rb") as f:
        data = f.read()
    n, k = struct.unpack_from("<II", data, len(MAGIC))
    at = len(MAGIC) + 8
    freq = np.frombuffer(data, "<u4", n, at)
    sizes = np.frombuffer(data, "<u8", k, at + 4 * n)
    at += 4 * n + 8 * k
    ends = at + np.cumsum(sizes).astype(np.int64)
    return [data[e - int(s) : e] for e, s in zip(ends.tolist(), sizes)], freq


def tokenised(docs: DataFrame, tokenizer: str, blank_leads: bool = True, end: int = END, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A written table (bucket, doc_id, before, n_tokens, ids): ids as little-endian uint32, each bucket ascending.

    Buckets are ascending ranges of doc_id (nulls last) of about ``range_bytes`` of text; rows that
    share an id may be parted. before: ids of the documents of the bucket that stand before it.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    names = ["bucket", "doc_id", "n_tokens", "ids", "before"]

    def run(batches):
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer, shared.value, blank_leads)
        bucket, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in text_slices(batch, 1):
                ids, n = encoder.encode(part.column(1))
                ids = np.insert(ids, np.cumsum(n), np.uint32(end))
                n = n + 1
                wide = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
                raw, width, ends = ids.astype(wide).tobytes(), int(wide[-1]), np.cumsum(n)
                cut = [raw[(e - k) * width : e * width] for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(n), pa.int32()), part.column(0), pa.array(n), pa.array(cut, pa.binary()), pa.array(before + ends - n)], names=names)
                before += int(ends[-1]) if len(ends) else 0

    parts = max(1, min(MOST_RANGES, -(-text_bytes(docs) // range_bytes)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("rid"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("rid")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ranged.mapInArrow(run, "bucket int, doc_id long, n_tokens long, ids binary, before long"), "token-ids")


def unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents (as many numbers as the vocabulary has ids)."""

    def run(batches):
        counts = np.zeros(1 << 10, dtype=np.int64)
        for batch in batches:
            for raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.bincount(unpack(raw, n))
                if len(c) > len(counts):
                    counts = np.pad(counts, (0, len(c) - len(counts)))
                counts[: len(c)] += c
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["id", "n"])

    rows = tokens.select("ids", "n_tokens").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, dtype=np.int64)
    out[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def blocks(tokens: DataFrame, freq: np.ndarray) -> DataFrame:
    """The written blocks: (start, n_docs, n_tokens, block), each with documents in ascending order."""
    spark = tokens.sparkSession
    sums = tokens.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect()  # one row per range
    ahead, total = {}, 0
    for r in sums:
        ahead[r.bucket], total = total, total + r.n
    shared = spark.sparkContext.broadcast((freq, ahead))

    def run(batches):
        freq, ahead = shared.value
        table = Table(freq)
        held, docs, sizes, count, start, follows = [], [], [], 0, 0, None

        def flush():
            ids = np.concatenate(held)
            raw = encode_block(ids, np.array(docs, dtype=np.int64), np.array(sizes, dtype=np.int64), start, table)
            return pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())], names=["start", "n_docs", "n_tokens", "block"])

        for batch in batches:
            for bucket, doc, n, raw, before in zip(*(batch.column(i).to_pylist() for i in range(5))):
                at = ahead[bucket] + before
                if held and (count >= SYMBOLS or at != follows):  # a block's documents follow each other
                    yield flush()
                    held, docs, sizes, count = [], [], [], 0
                if not held:
                    start = at
                held.append(unpack(raw, n))
                docs.append(NULL_ID if doc is None else doc)
                sizes.append(n)
                count += n
                follows = at + n
        if held:
            yield flush()

    return written(tokens.select("bucket", "doc_id", "n_tokens", "ids", "before").mapInArrow(run, "start long, n_docs long, n_tokens long, block binary"), "blocks")


def read_back(written_blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the blocks."""
    shared = written_blocks.sparkSession.sparkContext.broadcast(freq)

    def run(batches):
        table = Table(shared.value)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                start, docs, sizes, ids = decode_block(raw, table)
                ends = np.cumsum(sizes)
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([None if d == NULL_ID else d for d in docs.tolist()], pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return written_blocks.select("block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
