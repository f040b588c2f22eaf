"""The vector search on small tables, with everything that takes no part."""

import numpy as np

from siftwell.llm import ann


def brute(rows, queries, top):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for q in queries:
        s = x @ x[ids == q][0]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:top]
        out[q] = [(int(ids[k]), float(s[k])) for k in order]
    return out


def test_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).round(2).tolist()) for i in range(800)]
    rows[7] = (7, rows[3][1])  # a tie
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [float("inf")] * 16), (906, [1.0] * 3), (None, [9.0] * 16), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, rank int, score string")
    good = ann.valid(df)
    assert good.count() == 800
    got = {}
    for r in ann.search(good, good.where("vec_id % 20 = 0"), top=5, rerank=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    rows = [(i, np.array(v, dtype=np.float32).tolist()) for i, v in rows]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 5)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert all(abs(s - exact[i] @ exact[q]) < 1e-9 for i, s in found) and found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = ann.valid(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0])], schema))
    got = ann.search(few, few.where("vec_id % 20 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 4.0), (0, 2, 2, 3.0)]
    none = ann.valid(spark.createDataFrame([], schema))
    assert ann.search(none, none).count() == 0


def test_encoding_gets_close():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 12)).astype(np.float32)
    books = ann.fit(x, books=4, words=32)
    codes = ann.encode(x, books)
    error = x - sum(books[m][codes[:, m]] for m in range(4))
    greedy = ann.encode(x, books, beam=1)
    rough = x - sum(books[m][greedy[:, m]] for m in range(4))
    assert (error**2).mean() < 0.4 * (x**2).mean() and (error**2).mean() < (rough**2).mean()


def test_coarse_codes_lose_no_neighbour(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 16))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    good = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    books = ann.fit(x[:400], books=2, words=16)
    got = {}
    for r in ann.search(good, good.where("vec_id % 200 = 0"), top=20, rerank=30, books=books).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, range(0, 6000, 200), 20)
    assert got == {q: [i for i, _ in found] for q, found in want.items()}


def test_equal_vectors_give_the_smallest_ids(spark):
    rng = np.random.default_rng(8)
    same = rng.standard_normal(12).round(3).tolist()
    rows = [(i, same) for i in range(1000, 2000)] + [(i, rng.standard_normal(12).round(3).tolist()) for i in range(300)]
    good = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    got = {}
    for r in ann.search(good, good.where("vec_id in (1000, 1020, 1900)"), group_bytes=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i in range(1000, 2000) if i != q][:20] for q in (1000, 1020, 1900)}


def test_query_settings_equal_brute_force(spark):
    """Top 20 with the query's own settings, over several blocks, groups and scout passes."""
    rng = np.random.default_rng(10)
    x = rng.standard_normal((10_000, 24)).astype(np.float32).astype(float)
    good = ann.valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6))
    got = {}
    for r in ann.search(good, good.where("vec_id % 100 = 0"), group_bytes=24 * 8 * 40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(list(enumerate(x.tolist())), range(0, 10_000, 100), 20)
    assert got == {q: [i for i, _ in found] for q, found in want.items()}
