"""Edge cases and brute-force comparisons of the document operators on small fixtures."""

import hashlib
import random
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm import langid, licenses, mixing, neardup, packing, rans, sharding, syncmers, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, size string, target string, shard_id string, rank string"


def frame(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with results."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30000))
    rows = [(1, "one two three four five six seven", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \t\n ", "fr", "a"), (5, long, "en", "c"), (1, "one two three four five six seven", "en", "a"), (None, "no id here but words", "de", "b"), (7, "été 中文 \U0001f600", "fr", None), (8, "1234 5678", None, "a"), (9, "ONE two three four five six seven", "en", "d")]
    return frame(spark, rows), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix(spark, odd, empty):
    df, rows = odd
    got = mixing.weighted_fair_mix(df).collect()
    assert len(got) == len(rows)
    assert all(r.taken == r.copies * r["size"] and r.taken <= 3 * r["size"] for r in got)
    assert {r.doc_id: r["size"] for r in got}[5] == 30000 and {r.doc_id: r["size"] for r in got}[2] == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.weighted_fair_mix(df.repartition(3)).collect()))
    assert mixing.weighted_fair_mix(empty).count() == 0
    stream = mixing.mixed_stream(df)
    want = {}
    for r in got:
        if r.copies:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert stream.columns == df.columns and mixing.mixed_stream(empty).count() == 0
    seen = [r.doc_id for r in stream.collect()]
    assert {i: seen.count(i) for i in set(seen)} == want
    # the order is that of the finish times, whatever the number of ranges
    finish = sorted((r.finish + k * r.source_size / r.target, r.doc_id or 0) for r in got for k in range(r.copies))
    mixing.PART_BYTES, kept = 20_000, mixing.PART_BYTES
    try:
        ids, at = [r.doc_id or 0 for r in mixing.mixed_stream(df).collect()], 0
        for f in sorted({f for f, _ in finish}):
            same = sorted(i for g, i in finish if g == f)
            assert sorted(ids[at : at + len(same)]) == same
            at += len(same)
    finally:
        mixing.PART_BYTES = kept


def test_mix_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", s) for i in range(600) for s in [["a", "b", "c", "d", None][min(i % 11, 4)]]]
    got = mixing.weighted_fair_mix(frame(spark, rows)).collect()
    total = sum(r["size"] for r in got)
    sizes, targets, taken = {}, {}, {}
    for r in got:
        sizes[r.source], targets[r.source] = r.source_size, r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    # iterative resharing as the contract says it
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, free, left = {}, set(sizes), float(total)
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            want |= {s: level * weights[s] for s in free}
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
        free -= over
        left -= sum(want[s] for s in over)
    assert {k: round(v, 6) for k, v in want.items()} == {k: round(v, 6) for k, v in targets.items()}
    assert all(abs(taken[s] - targets[s]) <= 8 for s in sizes)


def test_shards(spark, odd, empty):
    df, rows = odd
    got = sharding.shard_table(df, 60).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard_id, []).append(r)
    for group in by.values():
        assert sum(r.n_bytes for r in group) == group[0].shard_bytes
        assert group[0].shard_bytes <= 60 or len(group) == 1 and group[0].oversize
    assert sharding.shard_table(empty, 60).count() == 0
    # a third of the rows repeat one row: bits of the row number part them
    many = sharding.shard_table(frame(spark, [(1, "same text", "en", "a")] * 300 + [(i, "t" * (i % 9), "en", "a") for i in range(600)]), 100).collect()
    sums = {}
    for r in many:
        sums[r.shard_id] = sums.get(r.shard_id, 0) + r.n_bytes
    assert len(many) == 900 and max(sums.values()) <= 100


def test_write_shards(spark, tmp_path, empty):
    rows = [(1, "one", "en", "a"), (1, "another text", "en", "a"), (None, "no id", "en", "b"), (None, None, None, None), (2, "", "en", "a"), (2, "", "en", "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    sharding.write_shards(docs, f"{tmp_path}/shards", 12)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(str, ((r.doc_id, r.text, r.lang, r.source) for r in back.collect()))) == sorted(map(str, rows))
    sizes = {r.shard_id: r.n for r in back.groupBy("shard_id").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert max(x or 0 for x in sizes.values()) <= 12
    table = sharding.directory(sharding.shard_table(docs, 12)).collect()
    assert len(table) == len(sizes) and all(r.shard_bytes == (sizes[r.shard_id] or 0) and not r.oversize for r in table) and sum(r.shard_docs for r in table) == 6
    sharding.write_shards(empty, f"{tmp_path}/none", 12)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {i: [shingles(r[1]) for r in rows if r[0] == i] for i in ids}
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 85 * len(x | y) and x and y for x in sets[a] for y in sets[b]):
                ra, rb = root[a], root[b]
                if ra != rb:
                    low, high = min(ra, rb), max(ra, rb)
                    root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_near_duplicates(spark, odd, empty, monkeypatch):
    df, rows = odd
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {(r[0], len(shingles(r[1])), brute(rows).get(r[0]), r[0] is None or brute(rows)[r[0]] == r[0]) for r in rows}
    assert (9, 3, 1, False) in got
    assert neardup.near_duplicates(empty).count() == 0
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):  # one chain of near copies with more and more edits, and strangers
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "a"))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))), "en", "b") for i in range(40)]
    # the second sends all through many pairs of blocks, the third through hubs first
    for short, block, rounds in ((16, 768, 2), (4, 8, 0), (4, 8, 2)):
        monkeypatch.setattr(neardup, "ROUNDS", rounds)
        monkeypatch.setattr(neardup, "SHORT", short)
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()}
        assert got == brute(rows)


def test_syncmers(spark, odd, empty):
    df, rows = odd
    got = syncmers.fingerprints_with_neighbours(df).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    order = sorted(rows, key=key)
    want = []
    for a, b in zip(order, order[1:] + order[:1]):
        t, u = a[1] or "", b[1] or ""
        n = len(t) // 2
        want.append((a[0], len(t), hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    assert syncmers.fingerprints_with_neighbours(empty).count() == 0
    one = syncmers.fingerprints_with_neighbours(frame(spark, [(1, "a single document of some length, its own next", "en", "a")])).first()
    assert one.near_next == 1.0


def slow_anchors(text):
    """Closed syncmers by definition: {k-mer: first position}."""
    h = lambda x: int(syncmers.mixed(np.array([sum(c * pow(0x9E3779B1, len(x) - 1 - i, 1 << 64) for i, c in enumerate(map(ord, x))) % (1 << 64)], dtype=np.uint64))[0])
    out = {}
    for p in range(len(text) - syncmers.K + 1):
        kmer = text[p : p + syncmers.K]
        inner = [h(kmer[i : i + syncmers.S]) for i in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(kmer, p)
    return out


def slow_likeness(x, y):
    if x == y:
        return 1.0
    shared = sorted((x[k], y[k]) for k in x.keys() & y.keys())
    best = []
    for i, (_, v) in enumerate(shared):
        best.append(1 + max((best[j] for j in range(i) if shared[j][1] < v), default=0))
    return 2 * max(best, default=0) / (len(x) + len(y)) if x and y else 0.0


def test_syncmers_brute_force(spark):
    """Fingerprints and both likenesses by definition, over several ranges of ids."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghij é") for _ in range(500))
    rows = []
    for i in range(30):
        cut = rng.randrange(400)
        rows.append((i * 7, rng.choice([base, base[cut:] + base[:cut], base[:cut] + "zz" + base[cut:], "".join(rng.choice("klmnopq") for _ in range(200))]), "en", "a"))
    got = sorted(syncmers.fingerprints_with_neighbours(frame(spark, rows), range_bytes=2000).collect(), key=lambda r: r.doc_id)
    assert len(got) == 30
    for i, r in enumerate(got):
        t, u = rows[i][1], rows[(i + 1) % 30][1]
        n = len(t) // 2
        mine, edited, after = slow_anchors(t), slow_anchors(t[: len(t) - n] + u[:n]), slow_anchors(u)
        assert sorted(syncmers.from_string(r.fingerprint)[1].tolist()) == sorted(mine.values())
        assert sorted(syncmers.from_string(r.edited_fingerprint)[1].tolist()) == sorted(edited.values())
        assert abs(r.near_edited - slow_likeness(mine, edited)) < 1e-12 and abs(r.near_next - slow_likeness(mine, after)) < 1e-12
    plain = {r.doc_id: r.fingerprint for r in syncmers.fingerprint(frame(spark, rows)).collect()}
    assert plain == {r.doc_id: r.fingerprint for r in got}


def test_range_places(spark):
    for marks in ([], [5], [1, 4, 4 + 5, 20, 21, 30, 99]):
        rows = spark.range(110).select("id", syncmers._place(F.col("id"), marks).alias("p")).collect()
        assert all(r.p == sum(m < r.id for m in marks) for r in rows)


def test_syncmers_are_context_free_and_closed():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij ") for _ in range(2000))
    hashes, first = syncmers.anchors([text])[0]
    moved = syncmers.anchors(["zz" + text])[0]
    shared = set(hashes.tolist()) & set(moved[0].tolist())
    assert len(shared) == len(hashes) > 100
    assert all(dict(zip(*moved))[h] == dict(zip(hashes, first))[h] + 2 for h in shared)
    half = syncmers.anchors([text[:1000] + "".join(rng.choice("klmnopq") for _ in range(1000))])[0]
    assert 0.35 < syncmers.likeness((hashes, first), half) < 0.65
    assert syncmers.likeness(*[syncmers.from_string(syncmers.to_string((hashes, first)))] * 2) == 1.0
    far = syncmers.anchors(["".join(rng.choice("rstuvw") for _ in range(2000))])[0]
    assert syncmers.likeness((hashes, first), far) == 0.0


def test_langid(spark, odd, empty):
    df, rows = odd
    assert [r.lang_pred for r in langid.identify(df, None).collect()] == ["und"] * len(rows)
    rng = random.Random(3)
    words = {"en": ["the", "thing", "with", "when"], "fr": ["le", "été", "où", "être"], "de": ["der", "über", "nicht", "straße"]}
    docs = [(i, " ".join(rng.choice(words[x]) for _ in range(40)), x, "a") for i in range(240) for x in [["en", "fr", "de"][i % 3]]]
    model = langid.train(frame(spark, docs))
    got = langid.identify(frame(spark, docs + rows), model).collect()
    held = [r for r in got[:240] if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    by = {r.text: r for r in got[240:]}
    assert all(by[t].lang_pred == "und" and by[t].score == 0 for t in (None, "", " \t\n ", "1234 5678"))
    assert all(0 <= r.score <= 1 for r in got) and langid.identify(empty, model).count() == 0


def test_gru_gradients():
    """Backpropagation through time against finite differences, in both directions."""
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.init(3, 4, rng).items()}
    codes, label = rng.integers(97, 100, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    mask = np.ones((5, 6))
    _, g = langid.gradients(codes, label, mask, p)
    for k in ("Uzf", "Urb", "Ucf", "Wb", "bias", "Ecb"):
        i = tuple(0 if k[0] != "E" or n else 98 for n in range(p[k].ndim))
        eps = 1e-3
        p[k][i] += eps
        up, _ = langid.gradients(codes, label, mask, p)
        p[k][i] -= 2 * eps
        down, _ = langid.gradients(codes, label, mask, p)
        p[k][i] += eps
        assert abs((up - down) / (2 * eps) - g[k][i]) < 1e-3


def test_toxicity(spark, odd, empty):
    df, rows = odd
    assert {r.s for r in toxicity.score(df, None, "s").collect()} == {0.0}
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeioutnrs") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["grumblefoot", "zonkhead", "wixl"])
        docs.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(i % 4 == 0)))
    labels += [(None, 1, 1), (5, 0, None)]
    model = toxicity.train(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.s for r in toxicity.score(frame(spark, docs), model, "s").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    marked, calm = [i for i in held if i % 4 == 0], [i for i in held if i % 4]
    assert sum(got[i] >= 0.3 for i in marked) >= 0.95 * len(marked) and sum(got[i] >= 0.3 for i in calm) <= 0.05 * len(calm)
    assert toxicity.score(df, model, "s").count() == len(rows) and toxicity.score(empty, model, "s").count() == 0


def test_toxicity_windows_and_lengths():
    """Windows cover the whole text, and lengths are those of plain zstandard with the same dictionary."""
    import zstandard

    rng = random.Random(6)
    text = "\n".join(" ".join(rng.choice(["Alpha", "be", "gamma-ray", "été", "x" * 90]) + f"{i}.{j}" for j in range(30)) for i in range(8))
    ws = toxicity.windows(text)
    flat = b" " + " ".join(text.lower().split()).encode() + b" "
    plain = [w[::2] for w in ws]
    at, end = 0, 0
    for w, wide in zip(plain, ws):
        at = flat.index(w, at)
        assert at <= end and w[:1] == w[-1:] == b" " and wide == toxicity.spread(w)
        end = at + len(w)
    assert end == len(flat) and max(map(len, plain)) < 2 * 99 + toxicity.WINDOW
    assert toxicity.windows("") == toxicity.windows(None) == toxicity.windows(" \n ") == []
    content = toxicity.spread(b" gamma-ray be alpha " * 40)
    tool = toxicity.compressor(content)
    got = toxicity.lengths(tool, ws)
    back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content + toxicity._HEADING, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    for w, n in zip(ws, got):
        z = tool.compress(toxicity._HEADING + w)
        assert len(z) == n and back.decompress(z, max_output_size=1 << 20) == toxicity._HEADING + w
    # a score is the logistic function of the features of brute-force margins
    model = {"ordinary": content, "toxic": toxicity.spread(b" zonkhead "), "weights": [-1.0, 0.3, 0.2, 0.1, 0.5, 0.1, 0.2, 0.4, -0.1]}
    docs = [text, "be zonkhead gamma-ray and zonkhead", "", None]
    for t, p in zip(docs, toxicity.Scorer(model)(docs)):
        m = []
        for w in toxicity.windows(t):
            a, b = (len(toxicity.compressor(c).compress(toxicity._HEADING + w)) for c in (content, model["toxic"] + content))
            m.append(a - b if a - b <= toxicity.COPY * len(w) else 0)
        x = [1.0, *[np.log1p(sum(v >= k for v in m)) for k in toxicity.STEPS], np.log1p(sum(v for v in m if v >= toxicity.STEPS[0])), min(max(m, default=0), 30) / 10, np.log(len(m) + 1)]
        assert abs(p - 1 / (1 + np.exp(-np.dot(x, model["weights"])))) < 1e-9


def test_licenses(spark, odd, empty):
    df, rows = odd
    assert licenses.license_scan(df).count() == len(rows) and licenses.license_scan(empty).count() == 0
    grant = next(s for s, i in licenses.SENTENCES.items() if i == "BSD_GRANT")
    parts = [next(s for s, i in licenses.SENTENCES.items() if i == x) for x in ("BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")]
    texts = {
        1: "Intro.\nReleased under the MIT License.\nAll rights reserved.", 2: ". ".join([grant, *parts]) + ".", 3: ". ".join([grant, *parts[:2]]),
        4: ". ".join([parts[0], grant]), 5: "Licensed under the\nApache License, Version 2.0.", 6: "The MIT license is mentioned only.",
    }
    got = {r.doc_id: r.licenses for r in licenses.license_scan(frame(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert got == {1: "MIT-reference,all-rights-reserved", 2: "BSD-3-Clause", 3: "BSD-2-Clause", 4: "", 5: "", 6: ""}
    got = {r.doc_id: r.licenses for r in licenses.license_scan(frame(spark, [(5, texts[5], "en", "a")]), unwrap=True).collect()}
    assert got == {5: "Apache-2.0-reference"}


TRICKY = ["", " ", "a  b", "a \n b", "tabs\t\tand  runs   of    blanks ", " lead", "don't we'll I'm", "<|endoftext|> x", "été 中文 😀 x 　y", "a  b", "x\r\n\r\n y", "1 22 333", "ÀÉ ΣΑΣ Σ", "é ́a", "word " * 50, "Straße ÉCOLE naïve Ǆ ﬁn İstanbul", "e\u0301te\u0301 a\u0300b", "x,y;z.\nÀ-b 'quoted' it's o'neill'll", "\x01cut \ue000", "中文字,かな 한글", "a1b22c"]


PARTS = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\x85", "\u2028", "\x1c", "\u0301", "\u0327", "\u093e", "\u0345", "'", "'s", "'ll", "'re", "\u2019",
    "a", "bc", "the", "World", "\u00c9", "\u00df", "\u00f1", "\u0130", "\u01c5", "\u03a3", "\u03c2", "\ufb01", "\u4e2d", "\u304b", "\ud55c", "1", "22", "\u0663", "\u00bd", "\u00b2",
    "<|endoftext|>", "<|startoftext|>", "<|", "|>", ".", ",", "!", "-", "--", "_", "$", "\u20ac", "\U0001f600", "\u200d", "\ufeff", "\x00", "\x01", "\u2260", "\u02b0", "\u2163", "\u00aa", "\u0378",
]


@pytest.mark.parametrize(("file", "leads"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_random(file, leads):
    """20,000 strings over white space, marks, digits and special tokens, against the library as it is."""
    import pyarrow as pa

    path, rng = public_tokenizers.path(file), random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    texts += ["Hello.\n\nWorld", "Title\n\nBody text here.\n\n- item\n\nEnd", "price\u00a0\u00a0EUR", "hi <|endoftext|> there"]
    with open(path, encoding="utf-8") as f:
        ids, n = tokens.Encoder(f.read(), leads).encode(pa.array(texts))
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


@pytest.mark.parametrize(("file", "leads"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(file, leads):
    import pyarrow as pa

    path = public_tokenizers.path(file)
    plain = Tokenizer.from_file(path)  # as it is
    with open(path, encoding="utf-8") as f:
        fast = tokens.Encoder(f.read(), leads)
    for _ in range(2):
        ids, n = fast.encode(pa.array([*TRICKY, None]))
        cut = np.split(ids, np.cumsum(n)[:-1])
        assert [x.tolist() for x in cut] == [plain.encode(t, add_special_tokens=False).ids for t in [*TRICKY, ""]]


def test_token_files(spark, odd, empty, tmp_path):
    df, rows = odd
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = rans.tokenised(df, path)
    freq = rans.Table.scaled(rans.count_ids(t))
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in rans.read_back(rans.blocks(t, freq), freq).collect())
    plain = Tokenizer.from_file(path)
    at = 0
    want = []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), r[0]))
        at += len(ids)
    assert got == want
    none = rans.tokenised(empty, path)
    assert rans.read_back(rans.blocks(none, freq), rans.Table.scaled(rans.count_ids(none))).count() == 0
    stored = [r.block for r in rans.blocks(t, freq).collect()]
    rans.write_file(tmp_path / "x.rans", stored, freq)
    blocks, again = rans.read_file(tmp_path / "x.rans")
    assert blocks == stored and (again == freq).all()


def test_rans_blocks():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 3), (70_000, 50_000), (600_000, 300)):
        ids = np.minimum(rng.geometric(4 / top if top > 4 else 0.5, n) - 1, top - 1).astype(np.uint32)
        table = rans.Table(rans.Table.scaled(np.bincount(ids, minlength=top)))
        block = rans.encode_block(ids, np.array([7]), np.array([n]), 3, table)
        start, docs, sizes, back = rans.decode_block(block, table)
        assert start == 3 and docs.tolist() == [7] and sizes.tolist() == [n] and (back == ids).all()
        lanes = rans.LANES
        while lanes > 1 and n < lanes * 64:
            lanes //= 2
        if n > 300_000:  # from a checkpoint
            _, _, _, part = rans.decode_block(block, table, 300, 310)
            assert (part == ids[300 * lanes : 310 * lanes]).all()
            entropy = -sum(c / n * np.log2(c / n) for c in np.bincount(ids) if c) * n / 8
            assert len(block) < 1.06 * entropy
        damaged = bytearray(block)
        damaged[-1] ^= 1
        with pytest.raises(ValueError):
            rans.decode_block(bytes(damaged), table)


def test_packing(spark, odd, empty):
    df, rows = odd
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(df, path, with_ids=True).collect()
    plain = Tokenizer.from_file(path)
    want = sorted(([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows), key=str)
    docs, seqs = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        seqs.setdefault(r.sequence_id, []).append(r)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in got) == sum(map(len, want))
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    pieces = [[x for r in sorted(p, key=lambda r: (r.start, r.sequence_id)) for x in r.ids] for k, p in docs.items() if k != (1, 8)]  # doc 1 stands twice
    assert sorted(pieces, key=str) == sorted([[*plain.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows if r[0] != 1], key=str)
    assert packing.packed(empty, path).count() == 0


def test_packing_leaves_no_encoder_in_workers(spark, tmp_path):
    path = shutil.copy(public_tokenizers.path("word_bpe_49k.json"), tmp_path)  # a path of its own: other tests' encoders don't count
    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(400)], "doc_id long, text string").repartition(4)

    def kept(batches):
        import gc
        import sys

        for _ in batches:
            pass
        others = {id(v) for k, v in sys.__dict__.get("_siftwell_cache", {}).items() if k[1] != path}
        n = sum(type(x).__name__ == "Encoder" and type(x).__module__ == tokens.__name__ and id(x) not in others for x in gc.get_objects())
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    assert len(packing.packed(df, path).collect()) >= 400
    packing.packed(df, path).limit(1).collect()  # a reader that stops early
    assert [r.n for r in df.mapInArrow(kept, "n long").collect()] == [0] * 4


def test_pack_balances_costs():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1500, 900)
    p = packing.pack(sizes)
    cost = {}
    for _, _, n, seq, _ in p.tolist():
        cost[seq] = cost.get(seq, 0) + n + n * n / 2048
    whole = [c for s, c in cost.items() if p[p[:, 3] == s, 2].sum() == 2048]
    assert p[:, 2].sum() == sizes.sum() and np.std(whole) < 0.2 * np.mean(whole)
