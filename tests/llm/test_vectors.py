"""Vector links and whitening against plain numpy and exact fractions."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from profilelab.llm import vector_dups, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, id long, key string, e string, v string, ball long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 1, 1, "k", "e", "v", 1) for i, x in rows], SCHEMA)


def unit(a):
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def mates(rng, x, cosine):
    n = rng.normal(size=x.shape)
    n -= (n * x).sum(1, keepdims=True) * x
    return cosine * x + math.sqrt(1 - cosine**2) * unit(n)


def brute(ids, e, cosine=0.9):
    u = unit(np.asarray(e, float))
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    comp, left = {}, set(range(len(ids)))
    for i in sorted(left, key=lambda k: ids[k]):
        todo = [i] if i in left else []
        left.discard(i)
        while todo:
            x = todo.pop()
            comp[x] = ids[i]
            near = [y for y in np.flatnonzero(hit[x]) if y in left]
            left.difference_update(near)
            todo += near
    return hit.sum(1), [comp[k] for k in range(len(ids))]


def links(df):
    return sorted((r.v, r.n_links, r.component, r.kept) for r in df.collect())


def test_links_equal_brute_force_on_crowds(spark):
    """Tight crowds become balls, wide ones are compared member by member, balls that face each other are decided in blocks."""
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(1500, 32)))
    parts = [x, mates(rng, x[:100], 0.93), mates(rng, np.repeat(x[200:201], 700, 0), 0.99), mates(rng, np.repeat(x[300:301], 150, 0), 0.951)]
    near = mates(rng, x[200:201], 0.92)  # the centre of a second crowd, partly within reach of the first
    parts += [near, mates(rng, np.repeat(near, 600, 0), 0.985)]
    e = np.vstack(parts)
    ids = rng.permutation(len(e)).tolist()
    n, comp = brute(ids, e)
    got = {r[0]: r[1:] for r in links(vector_dups.link_vectors(vectors(spark, zip(ids, e.tolist(), strict=True))))}
    found = sum(got[i][0] for i in ids)
    assert all(got[i][0] <= k for i, k in zip(ids, n, strict=True))
    assert found >= 0.99 * n.sum()
    assert np.mean([got[i][1] == c for i, c in zip(ids, comp, strict=True)]) > 0.98
    assert all(got[i][2] == (got[i][1] == i) for i in ids)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(3000, 64)))
    e = np.vstack([x, mates(rng, x[:800], 0.901)])
    got = {r[0]: r[1] for r in links(vector_dups.link_vectors(vectors(spark, enumerate(e.tolist()))))}
    n, _ = brute(list(range(len(e))), e)
    assert sum(got.values()) >= 0.9 * n.sum() and all(got[i] <= n[i] for i in got)


def test_links_of_odd_rows(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 2.0, 0.0]
    rows = [(5, one), (3, one), (None, one), (7, [9.0, 0.0]), (8, [0.0, 0.0, 0.0]), (9, None), (10, []), (11, [1.0, None, 0.0]), (12, [float("nan"), 1.0, 1.0]),
            (13, [float("inf"), 1.0, 1.0]), (14, two), (14, two), (15, [-1.0, 0.0, -0.0]), (None, None), (16, [1e200, 0.0, 1e190]), (17, [1e-300, 0.0, 0.0])]
    last = 2**63 - 1
    got = links(vector_dups.link_vectors(vectors(spark, rows)))
    alone = [(i, 0, i, True) for i in (8, 9, 10, 11, 12, 13, 15, last)]
    group = [(3, 5, 3, True), (5, 5, 3, False), (7, 5, 3, False), (16, 5, 3, False), (17, 5, 3, False), (last, 5, 3, False)]
    assert got == sorted([*alone, *group, (14, 1, 14, True), (14, 1, 14, True)])
    assert vector_dups.link_vectors(vectors(spark, [])).count() == 0
    assert links(vector_dups.link_vectors(vectors(spark, [(1, None), (2, [0.0])]))) == [(1, 0, 1, True), (2, 0, 2, True)]
    kept = vector_dups.keep_one(vectors(spark, rows))
    assert sorted(r.vec_id for r in kept.collect() if r.vec_id is not None) == [3, 8, 9, 10, 11, 12, 13, 14, 14, 15]
    assert kept.columns == vectors(spark, []).columns


def test_copies_cost_no_pairs(spark):
    """Nine tenths of the rows are one vector: a class with a count."""
    rng = np.random.default_rng(4)
    e = unit(rng.normal(size=(300, 16))).tolist()
    rows = list(enumerate(e)) + [(1000 + i, e[7]) for i in range(2700)]
    got = {r[0]: r for r in links(vector_dups.link_vectors(vectors(spark, rows).repartition(13)))}
    n, comp = brute([i for i, _ in rows], [x for _, x in rows])
    assert [got[i][1:3] for i, _ in rows] == [(int(k), c) for k, c in zip(n, comp, strict=True)]


def test_polynomial_roots_and_null_vectors(spark):
    rng = np.random.default_rng(6)
    b = rng.integers(-50, 50, (9, 6)).astype(object)
    m = (b @ b.T).tolist()  # rank 6: three roots are zero
    poly = whitening.characteristic_polynomial(spark, m)
    lead = lambda k: sum(_det([[m[i][j] for j in s] for i in s]) for s in itertools.combinations(range(9), k))
    assert poly == [(-1) ** (9 - i) * lead(9 - i) for i in range(10)]
    roots = whitening.leading_roots(poly, 9)
    assert sum(k for _, k in roots) == 6
    assert np.allclose([float(r) for r, _ in roots], np.linalg.eigvalsh(np.array(m, float))[::-1][:6], rtol=1e-12)
    for root, _ in roots:
        v = whitening.null_vectors(m, root, 1)[0]
        off = [sum(m[i][j] * v[j] for j in range(9)) - root * v[i] for i in range(9)]
        assert max(abs(x) for x in off) < Fraction(1, 10**20) and abs(sum(x * x for x in v) - 1) < Fraction(1, 10**30)


def _det(m):
    m, out = [[Fraction(x) for x in r] for r in m], Fraction(1)
    for c in range(len(m)):
        at = next((r for r in range(c, len(m)) if m[r][c]), None)
        if at is None:
            return 0
        if at != c:
            m[c], m[at], out = m[at], m[c], -out
        out *= m[c][c]
        for r in range(c + 1, len(m)):
            f = m[r][c] / m[c][c]
            m[r] = [x - f * y for x, y in zip(m[r], m[c], strict=True)]
    return int(out)


def test_repeated_roots_have_orthogonal_vectors(spark):
    m = [[7 if i == j == 0 else 5 if i == j else 0 for j in range(5)] for i in range(5)]
    roots = whitening.leading_roots(whitening.characteristic_polynomial(spark, m), 5)
    assert [(round(float(r), 9), k) for r, k in roots] == [(7, 1), (5, 4)]
    v = np.array([[float(x) for x in y] for y in whitening.null_vectors(m, roots[1][0], 4)])
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-14) and np.allclose(v[:, 0], 0, atol=1e-14)


@pytest.mark.parametrize("size", [1.0, 1e9, 2.0**45])
def test_scatter_is_exact(spark, size):
    rng = np.random.default_rng(8)
    e = rng.normal(size=(500, 4)) * size
    y = [[int(math.floor(1024 * x)) + 100_000 for x in row] for row in e.tolist()]
    got = whitening.scatter(whitening.usable(vectors(spark, enumerate(e.tolist())), "vec_id", "embedding"), 4, 1024, 100_000)
    s = [sum(r[i] for r in y) for i in range(4)]
    assert (got.n, got.sums) == (500, s)
    assert got.matrix == [[500 * sum(r[i] * r[j] for r in y) - s[i] * s[j] for j in range(4)] for i in range(4)]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(9)
    e = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12)]
    df = vectors(spark, [*enumerate(e.tolist()), *bad])
    model = whitening.fit(df)
    x = np.floor(1024 * e)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    want = (x - x.mean(0)) @ axes[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    got = {r.v: r for r in whitening.whiten(df, model).collect()}
    assert sorted(got) == list(range(400))
    w = np.array([got[i].whitened for i in range(400)])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-10
    assert np.allclose(model.explained, values[::-1][:8] / values.sum(), rtol=1e-12)
    total = x.sum(0)
    assert [got[i].deviation for i in range(400)] == [int(((400 * x[i] - total) ** 2).sum()) for i in range(400)]
    assert whitening.identity_error(whitening.usable(df, "vec_id", "embedding"), model) < 1e-12


def test_whitening_of_odd_rows(spark):
    assert whitening.fit(vectors(spark, [])) is None
    assert whitening.fit(vectors(spark, [(1, [1.0, 2.0])])) is None
    assert whitening.fit(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)])) is None
    assert whitening.fit(vectors(spark, [(1, []), (2, [])])) is None
    short = vectors(spark, [(1, [1.0]), (2, [1.0, 2.0]), (None, []), (2, [1.0, 2.0])])  # ended by zeros; repeats count
    model = whitening.fit(short)
    assert model.n == 4 and len(model.values) == 2
    assert sorted((r.v or 0) for r in whitening.whiten(short, model).collect()) == [0, 1, 2, 2]
    flat = vectors(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(10)])  # one direction varies
    assert len(whitening.fit(flat).values) == 1
    far = whitening.fit(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0])]))  # set to the bounds
    assert far is not None and whitening.whiten(vectors(spark, [(1, [1e300, 0.0])]), far).first().deviation is None


def test_limbs_of_large_integers():
    y = np.array([[2**62, -(2**62)], [-(2**62), 3], [12345678901234567, -1]], np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(2)] for i in range(2)]
    assert whitening._exact_products(y).tolist() == want
    assert whitening.integers(pa.array([[1.5], [], [-0.0001, 2.0]], pa.list_(pa.float64())), 2, 1024).tolist() == [[1536, 0], [0, 0], [-1, 2048]]


def test_pivots_come_block_by_block(spark, monkeypatch):
    """The same pivots as from the whole sample at once, with no more of it on the driver than a block."""
    monkeypatch.setattr(vector_dups, "SAMPLE_BLOCK", 8)
    rng = np.random.default_rng(11)
    e = np.concatenate([rng.normal(size=(60, 4)), np.ones((40, 4))])
    table = vectors(spark, [(i, [float(x) for x in v]) for i, v in enumerate(e)])
    rows = vector_dups.clean(table, "vec_id", "embedding").select("*", *vector_dups._digests())
    first = {(r.d2, r.d1): list(r.e) for r in rows.collect()}
    want = []
    for _, v in sorted(first.items())[: 4 * 10]:
        one = unit(np.array([v]))[0]
        if len(want) < 10 and all(one @ w <= 0.7 for w in want):
            want.append(one)
    got = vector_dups.choose_pivots(rows, 4, 10)
    assert got.shape == (len(want), 4) and np.allclose(got, want)
