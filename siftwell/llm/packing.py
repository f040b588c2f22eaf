"""Cost-balanced packing into sequences of a fixed number of tokens.

Documents are tokenised where they are read and gathered into cells of some millions of
tokens; each cell is packed by itself, so nothing is shuffled and memory is bounded by the
cell (or a single larger document). A piece of n tokens costs n + n * n / ``context``. Pieces
(documents, and what is left of longer ones after cutting off whole sequences) are taken in
descending order and go to the sequence of least cost that still has room for all of them;
what fits nowhere whole is cut over the sequences with room, those of least cost first.

A cell has as many sequences as its tokens fill, and the rest goes to sequences of powers of
two, which need no padding; so nothing is padded at all.

Edge cases: null and empty texts hold just the end id; a null id is carried like any other;
repeated rows are packed each; an empty table gives an empty result; extra columns are ignored.
Cells follow the partitions of the input, so equal input splits give equal sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_value, release
from .tokens import Encoder, text_slices

by_value(__name__)

LENGTH, CELL, END = 2048, 4_000_000, 1


def capacities(total: int, length: int) -> np.ndarray:
    """Whole sequences, then the rest as descending powers of two."""
    rest = total % length
    return np.array([length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)


def pack(sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that place every token once."""
    room = capacities(int(sizes.sum()), length)
    cost, used = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64)
    out = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, int(used[seq])))
        used[seq] += n
        room[seq] -= n
        cost[seq] += n + n * n / length

    rests, seq = [], 0
    for doc, n in enumerate(sizes.tolist()):  # whole sequences out of long documents
        for k in range(n // length):
            put(doc, k * length, length, seq)
            seq += 1
        if n % length:
            rests.append((n % length, doc, n - n % length))
    rests.sort(key=lambda x: (-x[0], x[1]))
    homeless = []
    for n, doc, start in rests:
        fits = np.where(room >= n, cost, np.inf)
        s = int(fits.argmin()) if len(fits) else 0
        if len(fits) and np.isfinite(fits[s]):
            put(doc, start, n, s)
        else:
            homeless.append((doc, start, n))
    order = iter(np.argsort(cost, kind="stable").tolist())
    s = next(order, None)
    for doc, start, n in homeless:
        while n:
            while room[s] == 0:
                s = next(order)
            part = int(min(n, room[s]))
            put(doc, start, part, s)
            start, n = start + part, n - part
    return np.array(out, dtype=np.int64).reshape(-1, 5)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, cell: int = CELL, end: int = END, blank_leads: bool = False, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves. tokenizer: path of the tokenizer file."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T._parse_datatype_string(SCHEMA)
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    names = schema.names

    def run(batches):
        from pyspark import TaskContext

        encoder = None  # made for the task and gone with it: what it remembers is large, and workers outlive their tasks
        task = TaskContext.get().partitionId()
        held, sizes, owners, count, number = [], [], [], 0, 0

        def flush(number):
            ids, n, doc = np.concatenate(held), np.concatenate(sizes), pa.concat_arrays(owners)
            begin = np.cumsum(n) - n
            p = pack(n, length)
            at = begin[p[:, 0]] + p[:, 1]
            crc = [zlib.crc32(ids[a : a + k].astype("<u4").tobytes()) for a, k in zip(at.tolist(), p[:, 2].tolist())]
            cols = [doc.take(pa.array(p[:, 0])), pa.array(p[:, 1]), pa.array(p[:, 2]), pa.array(crc, pa.int64()), pa.array(n[p[:, 0]]), pa.array((task << 40) + (number << 20) + p[:, 3]), pa.array(p[:, 4])]
            if with_ids:
                cols.append(pa.array([ids[a : a + k].astype(np.int64).tolist() for a, k in zip(at.tolist(), p[:, 2].tolist())], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(cols, names=names)

        try:
            for batch in batches:
                encoder = encoder or Encoder(shared.value, blank_leads)
                for part in text_slices(batch, 1):
                    ids, n = encoder.encode(part.column(1))
                    ends = np.cumsum(n)
                    held.append(np.insert(ids, ends, np.uint32(end)))
                    sizes.append(n + 1)
                    owners.append(part.column(0).cast(pa.int64()))
                    count += len(ids) + len(n)
                    if count >= cell:
                        yield flush(number)
                        held, sizes, owners, count, number = [], [], [], 0, number + 1
            if count:
                yield flush(number)
        finally:  # also where the reader stops early
            encoder = batch = part = ids = held = sizes = owners = None
            release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
