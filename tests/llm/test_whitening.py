import math

import numpy as np
import pytest

from pagelode.llm import whitening as W
from pagelode.llm.queries import QUERIES
from pagelode.llm.spectrum import Spread

SHAPES = ["normal", "whole", "low rank", "one value", "one hot", "scales", "offset", "two rows"]


def sample(name, d, seed=0):
    r = np.random.default_rng(seed)
    return {
        "normal": lambda: r.normal(size=(250, d)),
        "whole": lambda: np.floor(r.normal(size=(250, d)) * 3),
        "low rank": lambda: np.floor(r.normal(size=(150, max(1, d // 3))) * 40)
        @ np.floor(r.normal(size=(max(1, d // 3), d)) * 3),
        "one value": lambda: np.full((40, d), 7.0),
        "one hot": lambda: np.eye(d)[r.integers(0, d, 150)] * 100,
        "scales": lambda: np.floor(r.normal(size=(250, d)) * 10.0 ** r.integers(0, 6, d)),
        "offset": lambda: 1e4 + np.floor(r.normal(size=(250, d)) * 5),
        "two rows": lambda: np.floor(r.normal(size=(2, d)) * 9),
    }[name]()


def scatter(x):
    return (x - x.mean(0)).T @ (x - x.mean(0))


def holds(spread, wanted):
    scale = max(np.abs(wanted).max(), 1e-300)
    q = spread.vectors
    np.testing.assert_allclose(q.T @ q, np.eye(len(q)), atol=1e-12)
    np.testing.assert_allclose(q * spread.values @ q.T / scale, wanted / scale, atol=1e-9)
    np.testing.assert_allclose(spread.values / scale, np.linalg.eigvalsh(wanted) / scale, atol=1e-9)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
@pytest.mark.parametrize("name", SHAPES)
def test_rank_one_updates_and_merges_equal_the_scatter(name, d):
    x = sample(name, d)
    parts = []
    for rows in np.array_split(x, 3):
        parts.append(Spread(d))
        for row in rows:
            parts[-1].add(row)
    total = Spread(d)
    for part in parts:
        total.merge(part)
    assert total.n == len(x)
    holds(total, scatter(x))


def brute(rows, components=4, scale=256):
    """The contract in exact numbers, its components by numpy's own solver."""
    kept = [
        (i, [math.floor(scale * float(c)) for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], dtype=float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        far = [n * a - s for a, s in zip(x, sums)]
        y = np.array(far, dtype=float) / n @ vectors
        out[i] = (sum(a * a for a in far), [
            (k + 1, y[k] / math.sqrt(values[k]), values[k] / values.sum()) for k in range(min(components, d))
        ])
    return n, out


def compare(got, n, wanted):
    signs = {}
    seen = set()
    for r in got:
        far, parts = wanted[r.vec_id]
        k, white, explained = parts[r.component - 1]
        assert (r.n, r.deviation) == (n, far)
        if abs(white) > 1e-6:
            sign = math.copysign(1, white) * math.copysign(1, r.whitened)
            assert signs.setdefault(k, sign) == sign
        assert abs(abs(r.whitened) - abs(white)) < 1e-8 * max(1, abs(white))
        assert abs(r.explained - explained) < 1e-9 * explained
        assert r.identity_error <= 1e-9
        seen.add((r.vec_id, k))
    assert seen == {(i, k) for i, (_, parts) in wanted.items() for k, *_ in parts}


@pytest.mark.parametrize("part_rows", [40, 2048])
def test_query_equals_brute_force(spark, tiny_dir, monkeypatch, part_rows):
    monkeypatch.setattr(W, "PART_ROWS", part_rows)
    monkeypatch.setattr(W, "FAN_IN", 3)
    rows = spark.read.parquet(f"{tiny_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(QUERIES["op11_whitening"](spark, tiny_dir).collect(), *brute([tuple(r) for r in rows]))


def test_odd_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(c) for c in r.normal(size=5)]) for i in range(30)]
    rows += [(30 + i, rows[i][1]) for i in range(10)] + [(31, rows[1][1])] * 3  # repeated
    odd = [(90, None), (91, []), (92, [1.0, None, 1.0, 2.0, 3.0]), (93, [float("nan")] * 5),
           (94, [1.0, 2.0, float("-inf"), 0.0, 0.0])]
    df = spark.createDataFrame(
        [(i, v, "a", 1) for i, v in rows + odd],
        "vec_id long, embedding array<double>, _x string, whitening int",
    )
    models = W.fit_whitening(df)
    got = W.whiten(df, models)
    assert got.columns == ["vec_id", "embedding", "_x", "whitening"]
    n, wanted = brute(rows)
    found = got.selectExpr(
        "vec_id", "whitening.n", "whitening.deviation", "whitening.identity_error",
        "inline(whitening.components)",
    ).collect()
    compare(found, n, wanted)
    assert len(found) == 4 * len(rows) and n == 30


def test_empty_few_dimensions_and_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert W.fit_whitening(empty) == {} and W.whiten(empty, {}).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], schema)
    rows = W.whiten(same, W.fit_whitening(same)).collect()
    assert len(rows) == 3
    for row in rows:
        assert (row.whitening.n, row.whitening.deviation, row.whitening.identity_error) == (1, 0, None)
        assert [tuple(c) for c in row.whitening.components] == [(1, None, None), (2, None, None)]
    flat = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(6)], schema)
    parts = W.whiten(flat, W.fit_whitening(flat)).first().whitening.components
    assert parts[0].explained == 1.0 and parts[1].whitened is None and parts[1].explained == 0.0


def test_each_length_has_its_own_components(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in r.normal(size=3 + i % 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    models = W.fit_whitening(df)
    assert sorted(models) == [3, 4]
    found = W.whiten(df, models).selectExpr(
        "vec_id", "whitening.n", "whitening.deviation", "whitening.identity_error",
        "inline(whitening.components)",
    )
    for size in (3, 4):
        part = [x for x in rows if len(x[1]) == size]
        ids = {i for i, _ in part}
        compare([x for x in found.collect() if x.vec_id in ids], *brute(part))


def test_numbers_beyond_longs(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.whitening for r in W.whiten(df, W.fit_whitening(df)).collect()}
    assert all(w.n == 4 and w.deviation is None for w in found.values())
    few = df.filter("vec_id in (2, 3)")
    near = {r.vec_id: r.whitening.deviation for r in W.whiten(few, W.fit_whitening(few)).collect()}
    assert near == {2: 2 * 256**2, 3: 2 * 256**2}
