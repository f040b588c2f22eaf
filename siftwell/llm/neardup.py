"""Near-duplicate classes by a MinHash signature-coordinate inverted join.

1. Words are hashed in bulk (numpy), shingles are five words, a document's set is its distinct
   shingle hashes (64 bits). Documents with equal sets form a class; one row of each class goes on.
2. A signature has ``COORDS`` coordinates. Each coordinate-value pair is a token under which
   classes are posted. Two classes that share at least m tokens share one among the
   ``COORDS - m + 1`` rarest of either (prefix filtering by ascending frequency), so only
   those are joined, and a class whose rare tokens are all its own is skipped at once. m is the
   most for which a pair at the threshold is missed with a probability of ``MISS`` at most.
3. Short posting lists (``SHORT`` or less) are self-joined; pairs count collisions over whole
   signatures, and those at the threshold are confirmed on full sets.
4. Long lists are merged by skipping. In ``ROUNDS`` rounds some classes of each list are hubs:
   each is compared with the list's other classes, and what is linked is contracted, so a group of
   many thousands of near copies costs a few comparisons a copy. Lists that then lie in one
   component are done. In the others, all classes outside the largest component are compared with
   all others, in pairs of blocks, by a union-find that skips what is connected already. No pair of
   different components at or over the threshold is left unchecked.
5. Components by minimum labels with pointer jumping over written tables.

The links kept are exact (100 * common >= percent * union on full sets).

Edge cases: null or wordless texts have an empty set and are linked with nothing; texts with
fewer than five words have the whole sequence as their one shingle; repeated rows fall into one
class; rows with a null id are never linked, their component is null and they are kept; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, parallelism, release, written

by_value(__name__)

COORDS, SHINGLE, SHORT, BLOCK, HUBS, ROUNDS = 48, 5, 16, 768, 4, 2
PERCENT, MISS = 85, 1e-6
_U = np.uint64


def least_matches(percent: int, miss: float = MISS) -> int:
    """The most coordinates of which a pair at the threshold has as many in common but for a probability of ``miss``."""
    p, below = percent / 100, 0.0
    for m in range(COORDS + 1):
        below += math.comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)
        if below > miss:
            return max(1, m)
    return COORDS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (invertible, spreads all bits)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def constants():
    lut = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    for a, b in ((65, 97),):  # A-Z as a-z
        lut[a : a + 26] = lut[b : b + 26]
    sep = np.zeros(256, dtype=bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    add = mix(np.arange(1000, 1000 + COORDS, dtype=np.uint64))
    return lut, sep, add


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text.

    A word's hash is the mixed polynomial of its byte values, taken from running sums: with an
    odd base every power has an inverse modulo 2**64.
    """
    lut, sep, _ = constants()
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    blank = sep[buf]
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1]
    start = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= blank[1:]
    end = np.flatnonzero(last) + 1
    base, back = _U(0xD6E8FEB86659FD93), _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    n = len(buf)
    powers = np.empty(n, dtype=np.uint64)
    powers[:1] = 1
    powers[1:] = base
    np.multiply.accumulate(powers, out=powers)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(lut[buf] * powers, out=sums[1:])
    inverse = np.empty(n, dtype=np.uint64)
    inverse[:1] = 1
    inverse[1:] = back
    np.multiply.accumulate(inverse, out=inverse)
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.r_[0, np.searchsorted(start, ends)])
    return h, counts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    if not texts:
        return []
    h, counts = word_hashes(texts)
    out, at = [], 0
    if len(h) >= SHINGLE:
        s = np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
        for j in range(SHINGLE):
            s = mix(s + h[j : len(h) - SHINGLE + 1 + j] + _U(j + 1))
    for c in counts.tolist():
        if c >= SHINGLE:
            out.append(np.unique(s[at : at + c - SHINGLE + 1]))
        elif c:
            x = _U(c)
            with np.errstate(over="ignore"):
                for j in range(c):
                    x = mix(np.array([x + h[at + j] + _U(100 + j)], dtype=np.uint64))[0]
            out.append(np.array([x], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += c
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDS) tokens: the coordinate's least hash, mixed with the coordinate. No set may be empty."""
    _, _, add = constants()
    sizes = np.array([len(x) for x in sets])
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    out = np.empty((len(sets), COORDS), dtype=np.uint64)
    for i in range(COORDS):
        out[:, i] = mix(np.minimum.reduceat(mix(flat + add[i]), starts) + _U(i))
    return out


def pieces(batch: pa.RecordBatch, at: int, limit: int = 1_000_000):
    """Slices of a batch with about ``limit`` bytes of text, and those texts."""
    texts = [(x or "").encode() for x in batch.column(at).to_pylist()]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield batch.slice(i, j - i), texts[i:j]
        i = j


def _digests(batches):
    import hashlib

    for batch in batches:
        for part, texts in pieces(batch, 1):
            sets = shingle_sets(texts)
            some = [i for i, x in enumerate(sets) if len(x)]
            digest = [None] * len(sets)
            tokens = [None] * len(sets)
            if some:
                sig = signatures([sets[i] for i in some]).view(np.int64)
                for i, row in zip(some, sig):
                    digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    tokens[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(tokens, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sig"],
            )
    release()


def _explode(batches):
    """(node, sig) -> node and each token."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
        node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), COORDS)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(sig)], names=["node", "token"])


def _sets(batches):
    import hashlib

    for batch in batches:
        for part, texts in pieces(batch, 1):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["node", "digest", "members"],
            )
    release()


def _collide(matches):
    """(a, b, sig_a, sig_b) -> pairs with enough collisions."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.int64).reshape(-1, COORDS) for i in (2, 3))
            keep = (x == y).sum(axis=1) >= matches
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = [linked(np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64), percent) for p, q in zip(x, y)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def forest(nodes: list[int], side: np.ndarray, comps: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int, matches: int) -> list[tuple[int, int]]:
    """Confirmed links that connect what the block pair's links connect.

    Within one block (all of side 0) every pair counts, else pairs across sides. A pair already
    connected (by comps from the start) is skipped; the others are compared on full sets if their
    signatures allow it.
    """
    n = len(nodes)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    two = side.any()
    label = np.unique(comps, return_inverse=True)[1]  # component of each, kept flat
    mark = np.zeros(len(vocabulary), dtype=bool)
    out = []
    for i in range(n):
        rest = np.flatnonzero(side == 1) if two else np.arange(i + 1, n)
        if two and side[i]:
            break
        rest = rest[label[rest] != label[i]]
        lo, hi = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[100 * lo >= percent * hi]
        if not len(rest):
            continue
        rest = rest[(sigs[rest] == sigs[i]).sum(axis=1) >= matches]
        if not len(rest):
            continue
        mine = codes[starts[i] : starts[i] + sizes[i]]
        mark[mine] = True
        where = np.repeat(starts[rest] - (np.cumsum(sizes[rest]) - sizes[rest]), sizes[rest]) + np.arange(sizes[rest].sum())
        common = np.add.reduceat(mark[codes[where]].astype(np.int64), np.cumsum(sizes[rest]) - sizes[rest])
        mark[mine] = False
        for j in rest[100 * common >= percent * (sizes[rest] + sizes[i] - common)].tolist():
            if label[j] != label[i]:
                out.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return out


def _blocks(percent, matches):
    """Rows of a block pair, sorted by (token, pair) -> links. One block pair is held at a time."""

    def run(batches):
        key, rows = None, []

        def flush():
            if len(rows) < 2:
                return [], []
            seen, keep = set(), []
            for r in rows:
                if (r[0], r[1]) not in seen:
                    seen.add((r[0], r[1]))
                    keep.append(r)
            links = forest(
                [r[0] for r in keep], np.array([r[1] for r in keep]), np.array([r[2] for r in keep], dtype=np.int64),
                np.frombuffer(b"".join(r[3] for r in keep), dtype=np.int64).reshape(-1, COORDS),
                [np.frombuffer(r[4], dtype=np.uint64) for r in keep], percent, matches,
            )
            return [x for x, _ in links], [y for _, y in links]

        def table(ab):
            return pa.RecordBatch.from_arrays([pa.array(ab[0], pa.int64()), pa.array(ab[1], pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for token, p, q, node, side, comp, sig, members in zip(*cols):
                if (token, p, q) != key:
                    if rows:
                        yield table(flush())
                    key, rows = (token, p, q), []
                rows.append((node, side, comp, sig, members))
        if rows:
            yield table(flush())
        rows = []
        release()

    return run


def compared(spread: DataFrame, sigs: DataFrame, full: DataFrame, percent: int, matches: int) -> DataFrame:
    """spread(token, p, q, node, side, comp): the links of each block pair (token, p, q)."""
    keys = ["token", "p", "q"]
    rows = spread.join(sigs.select("node", "sig"), "node").join(full, "node").select(*keys, "node", "side", "comp", "sig", "members")
    rows = rows.repartition(parallelism(spread.sparkSession), *keys).sortWithinPartitions(*keys, "side", "node")
    return rows.mapInArrow(_blocks(percent, matches), "a long, b long")


def unsettled(long: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(token, node, comp, rest): classes of the lists that lie in several components yet; rest: outside the list's largest one."""
    if labels is None:
        return long.select("token", "node", F.col("node").alias("comp"), F.lit(True).alias("rest"))
    rows = long.join(labels, "node", "left").select("token", "node", F.coalesce("component", "node").alias("comp"))
    sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"))
    # written, so that the join below has two plain sides and a hot list's rows can be split
    return rows.join(written(sizes.where("comps > 1"), "list-sizes"), "token").select("token", "node", "comp", (F.col("comp") != F.col("main")).alias("rest"))


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Block pairs of each list's hubs (``HUBS`` classes of its rest, the same for all lists as far as they hold them) with its other classes."""
    turn = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("node"), "node"))
    hubs = rows.where("rest").withColumn("turn", turn).where(F.col("turn") <= HUBS).select("token", F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    pairs = rows.join(written(hubs, "hubs"), "token").where("comp != hub_comp").select("hub", "hub_comp", "node", "comp").distinct()
    width = pairs.groupBy("hub", "hub_comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    ends = pairs.join(width.select("hub", "blocks"), "hub").select(F.col("hub").alias("token"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("p"), F.lit(0).alias("q"), "node", F.lit(1).alias("side"), "comp")
    heads = width.select(F.col("hub").alias("token"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"), F.lit(0).alias("q"), F.col("hub").alias("node"), F.lit(0).alias("side"), F.col("hub_comp").alias("comp"))
    return heads.union(ends)


def block_pairs(rows: DataFrame) -> DataFrame:
    """Block pairs of each list's rest among itself, and with its largest component."""
    width = rows.groupBy("token").agg(F.ceil(F.count_if("rest") / BLOCK).cast("int").alias("rb"), F.ceil(F.count_if(~F.col("rest")) / BLOCK).cast("int").alias("mb"))
    dealt = rows.join(written(width, "list-widths"), "token").withColumn("block", F.when(F.col("rest"), F.pmod(F.xxhash64("node"), F.col("rb"))).otherwise(F.col("rb") + F.pmod(F.xxhash64("node"), F.col("mb"))).cast("int"))
    last = F.when(F.col("rest"), F.col("rb") + F.col("mb") - 1).otherwise(F.col("rb") - 1)
    mates = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q"), (F.col("block") > o).cast("int").alias("side")))
    return dealt.select("token", "node", "comp", F.explode(mates).alias("m")).select("token", "m.p", "m.q", "node", "m.side", "comp")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(a, b) links -> node, component (least node reachable), over linked nodes only."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        # pointer jumping: take the label of one's label
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, "component").select("node", "old", F.least("component", "further").alias("component"))
        step = written(step, "labels")
        labels = step.select("node", "component")
        if step.where("old != component").limit(1).count() == 0:
            return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row."""
    spark, matches = docs.sparkSession, least_matches(percent)
    base = written(docs.select("doc_id", "text").mapInArrow(_digests, docs.select(F.col("doc_id")).schema.add("n_shingles", "long").add("digest", "binary").add("sig", "binary")), "shingled")
    named = base.where("digest is not null and doc_id is not null")
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")
    posted = classes.select("node", "sig").mapInArrow(_explode, "node long, token long")
    common = posted.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1")
    ranked = posted.join(common, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("t"))
    # tokens that a class shares with none come first in its prefix
    left = F.lit(COORDS - matches + 1) - (F.lit(COORDS) - F.size("t"))
    prefix = ranked.where(left > 0).select("node", F.explode(F.slice("t", F.lit(1), F.greatest(left, F.lit(1)))).alias("x")).select("node", "x.token", "x.freq")
    prefix = written(prefix, "prefix")
    wanted = written(prefix.select("node").distinct(), "wanted")
    sigs = written(classes.select("node", "sig", "n_shingles", "digest").join(wanted, "node", "left_semi"), "wanted-classes")

    short = prefix.where(F.col("freq") <= SHORT).select("node", "token")
    sized = short.join(sigs, "node")
    pairs = sized.select("token", F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na")).join(sized.select("token", F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb")), "token")
    fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = pairs.where((F.col("a") < F.col("b")) & fit).select("a", "b", "sa", "sb").mapInArrow(_collide(matches), "a long, b long").distinct()
    # full sets of the classes that are candidates at all, from a second scan
    texts = docs.select(F.col("doc_id").alias("node"), "text").where("node is not null").join(wanted, "node", "left_semi")
    full = texts.mapInArrow(_sets, "node long, digest binary, members binary").join(sigs.select("node", "digest"), ["node", "digest"]).groupBy("node").agg(F.first("members").alias("members"))
    full = written(full, "sets")
    checked = pairs.join(full.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    links = written(checked.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"), "short-links")

    long, labels = prefix.where(F.col("freq") > SHORT).select("token", "node"), None
    if long.limit(1).count():
        for turn in range(ROUNDS + 1):
            rows = written(unsettled(long, labels), "unsettled")
            spread = block_pairs(rows) if turn == ROUNDS else hub_pairs(rows)
            links = links.union(written(compared(spread, sigs, full, percent, matches), "long-links"))
            labels = components(spark, links)
    else:
        labels = components(spark, links)
    reps = classes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "digest").join(reps, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
