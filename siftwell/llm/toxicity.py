"""Toxicity by compression distance.

A text (lower case, white space as single blanks) is cut into overlapping windows of some words,
about ``WINDOW`` bytes long. Two zstandard dictionaries are made: one of ordinary text, and one of
toxic windows with the same ordinary text after them. A window's margin is its compressed length
under the ordinary dictionary less that under the toxic one: what only toxic text has makes it
positive, whatever both have leaves it near 0.

Labels mark documents, not windows, so the toxic dictionary is learned in rounds, by compressed
lengths alone. Toxic documents are dealt into two halves. zstandard's trainer makes a dictionary of
each half's windows, each half is scored by the other half's dictionary, and the windows whose
margin reaches a threshold (a quantile of the margins of ordinary documents that no dictionary
holds) are what the next round's dictionaries are trained on. A window that the other half holds
nearly whole is a copied passage, no recurring expression, and has margin 0 (``COPY``).

zstandard spends some five bytes on a match in a large dictionary, about what a short word takes.
So every byte is written as two (itself and a fixed other one), in the dictionaries as in the
windows, and each window follows a heading that both dictionaries hold, so that no window falls
under the least gain for which zstandard compresses at all.

A document's features are how many of its windows reach margins of several sizes, the sum and the
largest of them, and the number of its windows; a logistic function of them, fitted on training
documents (toxic ones as scored by the other half's dictionary) and set to the share of toxic
documents among all labelled ones, is its score.

Bound of the training sample: ``MAX_DOCS`` toxic and as many ordinary documents, by hash order
of the id. Their texts are read whole, as are all texts that are scored.

Edge cases: null and empty texts have no windows and get the score of no evidence; labels
that are null are not learned from; without labels of both kinds every score is 0; repeated
rows get equal scores; an empty table gives an empty result; extra columns are carried along, and
one of the name given to the score is overwritten.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, held_out, release

by_value(__name__)

MAX_DOCS = 1500
#: Bytes of a window, rounds of learning, quantile of ordinary margins that a toxic window must
#: reach, share of a window from which its gain means a copy, and steps of the margins' counts.
WINDOW, ROUNDS, QUANTILE, COPY, STEPS = 40, 4, 0.99, 0.45, (2, 4, 6, 9, 13)
THRESHOLD = 0.3
_OTHER = bytes((i * 151 + 77) % 256 for i in range(256))
_HEADING = bytes(range(128, 176))


def spread(b: bytes) -> bytes:
    """Each byte as two."""
    out = bytearray(2 * len(b))
    out[::2] = b
    out[1::2] = b.translate(_OTHER)
    return bytes(out)


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows of whole words, spread; each begins and ends with a blank."""
    b = re.sub(rb"\s+", b" ", b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" ")
    if len(b) < 2:
        return []
    wide, n, out, i = spread(b), len(b), [], 0
    while True:
        j = b.find(b" ", i + WINDOW)
        if j < 0:
            j = n - 1
        out.append(wide[2 * i : 2 * j + 2])
        if j == n - 1:
            return out
        k = b.find(b" ", i + WINDOW // 2)
        i = k if k < j else j


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """content: text as ``windows`` gives it, the nearest last."""
    params = zstandard.ZstdCompressionParameters(window_log=25, hash_log=21, chain_log=21, search_log=4, min_match=6, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_checksum=0, write_content_size=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + _HEADING, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def lengths(c: zstandard.ZstdCompressor, ws: list[bytes]) -> np.ndarray:
    compress = c.compress
    return np.array([len(compress(_HEADING + w)) for w in ws], dtype=np.int32)


def margins(ordinary: np.ndarray, toxic: np.ndarray, ws: list[bytes]) -> np.ndarray:
    m = ordinary - toxic
    return np.where(m > COPY * np.array([len(w) for w in ws]), 0, m)


def trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's trainer over windows; too few windows for it stand for themselves."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def features(ms: list[np.ndarray]) -> np.ndarray:
    """One row per document from the margins of its windows."""
    cols = [np.ones(len(ms))]
    cols += [np.array([np.log1p((m >= k).sum()) for m in ms]) for k in STEPS]
    cols.append(np.array([np.log1p(m[m >= STEPS[0]].sum()) for m in ms]))
    cols.append(np.array([min(int(m.max(initial=0)), 30) / 10 for m in ms]))
    cols.append(np.log(np.array([len(m) for m in ms]) + 1.0))
    return np.stack(cols, axis=1)


def fit(toxic: list[str], ordinary: list[str], share: float | None = None) -> dict | None:
    """Dictionaries and logistic weights. share: toxic documents among all labelled ones."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    if not toxic or not ordinary:
        return None
    # half of the ordinary documents make the dictionary, the others tell what margins ordinary text has
    base = b"".join(spread(re.sub(rb"\s+", b" ", b" " + t.lower().encode("utf-8", "surrogatepass"))) for t in ordinary[::2])
    rest = [windows(t) for t in ordinary[1::2] or ordinary]
    plain = compressor(base)
    halves = [[windows(t) for t in toxic[i::2]] for i in (0, 1)]
    seen = [[lengths(plain, ws) for ws in half] for half in halves]
    calm = [lengths(plain, ws) for ws in rest]
    chosen, at, made = halves, [[], []], [b"", b""]
    for _ in range(ROUNDS):
        sizes = [sum(len(w) for ws in half for w in ws) for half in chosen]
        step = [trained([w for ws in half for w in ws], max(16_000, int(0.8 * n) if chosen is not halves else n // 8)) for half, n in zip(chosen, sizes)]
        tools = [compressor(t + base) for t in step]
        at = [[margins(s, lengths(tools[1 - i], ws), ws) for s, ws in zip(seen[i], halves[i])] for i in (0, 1)]
        clean = np.concatenate([margins(s, lengths(tools[k % 2], ws), ws) for k, (s, ws) in enumerate(zip(calm, rest))] or [np.zeros(0, np.int32)])
        bar = max(STEPS[0], int(np.quantile(clean, QUANTILE))) if len(clean) else STEPS[0]
        new = [[[w for w, m in zip(ws, ms) if m >= bar] for ws, ms in zip(half, scores)] for half, scores in zip(halves, at)]
        made = step
        if not any(new[0]) or not any(new[1]):
            break
        chosen = new
    picked = [w for half in chosen for ws in half for w in ws]
    marks = trained(picked, max(16_000, int(0.8 * sum(map(len, picked))))) if chosen is not halves else made[0] + made[1]
    tool = compressor(marks + base)
    x = features([*at[0], *at[1], *[margins(s, lengths(tool, ws), ws) for s, ws in zip(calm, rest)]])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(rest))]
    w = logistic(x, y)
    if share is not None:
        odds = np.log(len(toxic) / len(rest)) - np.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6)))
        w[0] -= odds
    return {"ordinary": base, "toxic": marks, "weights": w.tolist()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.diag([0.01] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (p - y) + keep @ w)
    return w


class Scorer:
    """A model's compressors, and the scores of texts."""

    def __init__(self, model: dict):
        self.plain, self.toxic = compressor(model["ordinary"]), compressor(model["toxic"] + model["ordinary"])
        self.weights = np.array(model["weights"])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        ms = []
        for t in texts:
            ws = windows(t)
            ms.append(margins(lengths(self.plain, ws), lengths(self.toxic, ws), ws))
        return 1 / (1 + np.exp(-np.clip(features(ms) @ self.weights, -30, 30))) if ms else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> dict | None:
    """Fit on at most ``max_docs`` toxic and as many ordinary training documents."""
    spark = docs.sparkSession
    marks = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r.toxic): r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    picks = None
    for t in (0, 1):
        ids = marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        picks = ids if picks is None else picks.unionByName(ids)
    ids = picks.collect()  # at most 2 * max_docs numbers
    chosen = spark.createDataFrame([(r.doc_id, int(r.toxic)) for r in ids], "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").collect()
    texts: dict[int, list[str]] = {}
    for r in rows:
        texts.setdefault(r.toxic, []).append(r.text)
    n = counts.get(0, 0) + counts.get(1, 0)
    return fit(texts.get(1, []), texts.get(0, []), counts.get(1, 0) / n if n else None)


def score(docs: DataFrame, model: dict | None, name: str = "toxicity") -> DataFrame:
    """All columns and ``name``, a score from 0 to 1, of whole texts."""
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scorer = None  # made for the task and gone with it: its tables are large
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer(part.column(at).to_pylist()))], names=[*part.schema.names, name])
        scorer = None
        release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def slices(batch: pa.RecordBatch, rows: int = 512):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
