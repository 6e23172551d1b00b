"""Exact top-k against SQL and brute force."""

import numpy as np

from cartulary.llm import topk
from tests.oracle import compare, connect, spark_bag, sql_bag


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert compare(spark_bag(topk.exact_top_k(vectors)), sql_bag(connect(folder), topk.ORACLE)) is None


def test_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(900, 8)) * np.array([9, 4, 1, 1, 1, 1, 1, 1])
    grid[100:160] = grid[100]
    rows = [(i, v.tolist()) for i, v in enumerate(grid)] + [(20, grid[3].tolist())]
    odd = [(None, grid[0].tolist()), (1000, None), (1020, [1.0] * 7 + [float("nan")]), (1040, [1.0] * 7 + [None]), (1060, [float("inf")] * 8), (1080, []), (1100, [1e15] * 3), (1101, [1e15] * 3)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, score int").repartition(4)
    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows] + [(1100, [64 * 10**15] * 3), (1101, [64 * 10**15] * 3)]
    found = {}
    for r in topk.exact_top_k(frame.where("vec_id not in (1100, 1101) or vec_id is null"), k=5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for own, values in ints[:900]:
        if own % 20 == 0 and own != 20:
            best = sorted((-sum(a * b for a, b in zip(values, v)), i) for i, v in ints if i != own and len(v) == 8)[:5]
            assert sorted(found[own]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(found) == {i for i in range(0, 900, 20)}
    assert topk.exact_top_k(frame.limit(0)).count() == 0


def test_bounds_end_early():
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.exponential(size=(4000, 6)) ** 3 * 64).astype(np.int64)
    ids = np.arange(4000)
    for own, found, scores in topk.bounded_top(vectors[:30], ids[:30], vectors, ids, 20):
        full = vectors @ vectors[own]
        order = sorted((-full[i], i) for i in ids if i != own)[:20]
        assert [(-s, i) for s, i in order] == [(int(s), i) for s, i in zip(scores, found)]


def test_lists_are_deepened_in_steps(monkeypatch):
    import numpy as np

    from cartulary.llm import topk

    random, met, best = np.random.default_rng(6), [], topk._best
    vectors, ids = random.integers(-20, 21, (2000, 64)), np.arange(2000)
    monkeypatch.setattr(topk, "_best", lambda scores, *rest: met.append(len(scores)) or best(scores, *rest))
    found = {q: (list(i), list(s)) for q, i, s in topk.bounded_top(vectors[:50], ids[:50], vectors, ids, 20)}
    assert len(met) == 50 and max(met) <= 160
    for q in range(50):
        ranked = sorted((-int(vectors[i] @ vectors[q]), i) for i in range(2000) if i != q)[:20]
        assert found[q] == ([i for _, i in ranked], [-s for s, _ in ranked])
