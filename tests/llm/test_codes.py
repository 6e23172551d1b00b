"""Product codes against SQL and a plain integer search."""

import hashlib
import math

import numpy as np
import pytest

from cartulary.llm import codes
from tests.oracle import compare, connect, spark_bag, sql_bag


def _brute(rows, entries, rounds):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[math.floor(1024 * x) if abs(x) < 2**40 else int(x) * 1024 for x in v] for _, v, _ in kept]
    whole = [v + [0] * (-len(v) % 4) for v in whole]
    width = len(whole[0]) // 4
    cut = [[v[p * width : (p + 1) * width] for p in range(4)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            own = [near(v[p], books[p])[1] for v in cut]
            for e in range(len(books[p])):
                members = [v[p] for v, i in zip(cut, own) if i == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    last = [[near(v[p], books[p]) for p in range(4)] for v in cut]
    errors = [sum(d for d, _ in found) for found in last]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    labels = {}
    for (_, _, label), error in zip(kept, errors):
        labels[label] = labels.get(label, 0) + (error if error < 2**63 else 0)
    return sorted(
        ((r[0], "".join(f"{i:02x}" for _, i in found), e if e < 2**63 else None, labels[r[2]] if labels[r[2]] < 2**63 else None, digest) for r, found, e in zip(kept, last, errors)), key=str
    )


def _rows(spark, rows, **settings):
    frame = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    return sorted((tuple(r) for r in codes.product_codes(frame, **settings).collect()), key=str)


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark_bag(codes.product_codes(spark.read.parquet(f"{folder}/embeddings.parquet"))), sql_bag(connect(folder), codes.ORACLE)) is None


@pytest.mark.parametrize("dims", [4, 12, 20, 7])
def test_equals_plain_search(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(int(i), [float(x) for x in v], int(i) % 3 if i % 5 else None) for i, v in enumerate(np.round(rng.normal(size=(120, dims)), 2))]
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[9][1], 2), (500, rows[9][1], 2)]
    rows += [(501, None, 1), (502, [], 1), (503, [1.0] * (dims - 1) + [None], 1), (504, [float("nan")] * dims, 1), (505, [float("-inf")] * dims, 1), (506, [1.0] * (dims + 1), 1)]
    assert _rows(spark, rows, entries=16, rounds=4) == _brute(rows, 16, 4)


def test_components_of_any_finite_size(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v * 10.0 ** rng.integers(-3, 12)], 1) for i, v in enumerate(rng.normal(size=(40, 8)))]
    rows += [(100, [1e300] * 8, 2), (101, [-1.5e305] * 8, 2), (102, [5e-324] * 8, 2), (103, [-5e-324] * 8, 2)]
    assert _rows(spark, rows, entries=8, rounds=2) == _brute(rows, 8, 2)


def test_empty_and_few(spark):
    assert _rows(spark, []) == []
    rows = [(1, [1.0, 2.0, 3.0, 4.0], None), (2, [1.0, 2.0, 3.0, 4.5], None)]
    assert _rows(spark, rows) == _brute(rows, 256, 4)


def test_elimination_is_exact():
    rng = np.random.default_rng(4)
    parts, entries = rng.integers(-40, 40, (300, 16)), rng.integers(-40, 40, (64, 16))
    entries[40] = entries[5]
    parts[:64] = entries
    index, sums = codes.nearest(codes.transform(parts), codes.transform(entries))
    plain = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == plain.argmin(axis=1)).all() and (sums == 16 * plain.min(axis=1)).all()


def test_sequency_counts_sign_changes():
    signs = codes.transform(np.eye(16, dtype=np.int64)).T
    assert [int((np.diff(row) != 0).sum()) for row in signs] == list(range(16))
