"""Exact top-k search and hard negatives against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialscope.llm import hard_negatives as hn
from trialscope.llm.ball_tree import BallTree, top_products
from trialscope.llm.vectors import Pack, best

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int, score int"


def frame(spark, rows):
    """Embeddings with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, e, label, "r", 1, 2) for i, e, label in rows], SCHEMA).coalesce(2)


def whole(e):
    if e is None or any(x is None or not math.isfinite(x) for x in e):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in e]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def order(x):
    return (-x[0], math.inf if x[1] is None else x[1])


def plain_top(rows, every=50, k=5):
    valid = [(n, i, whole(e)) for n, (i, e, _) in enumerate(rows) if whole(e) is not None]
    out = []
    for n, i, q in valid:
        if i is not None and i % every == 0:
            ranked = sorted(((product(q, v), j) for m, j, v in valid if m != n), key=order)[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(ranked)]
    return sorted(map(repr, out))


def plain_negatives(rows, every=50, positives=5, negatives=3):
    valid = [(n, i, label, whole(e)) for n, (i, e, label) in enumerate(rows) if whole(e) is not None and label is not None]
    out = []
    for n, i, label, q in valid:
        if i is None or i % every:
            continue
        ranked = sorted(((product(q, v), j, other) for m, j, other, v in valid if m != n), key=order)
        for ps, p, _ in [x for x in ranked if x[2] == label][:positives]:
            window = [x for x in ranked if x[2] != label and 50 * ps <= 100 * x[0] <= 95 * ps][:negatives]
            out += [(i, p, r + 1, j, ps, s) for r, (s, j, _) in enumerate(window)]
    return sorted(map(repr, out))


def clustered(n, d=16, seed=0, equal=0):
    """Vectors in clusters, some opposite to each other, `equal` of them the same."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, d))
    centres[4:] = -centres[:4]
    v = centres[rnd.integers(8, size=n)] + 0.6 * rnd.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:equal] = v[0]
    return [(i, [float(x) for x in e], int(label)) for i, (e, label) in enumerate(zip(v, rnd.integers(5, size=n), strict=True))]


EDGE = [(0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (50, None, 1), (100, [], 2), (150, [float("nan"), 1.0], 1), (200, [1.0, None], 1), (250, [float("inf"), 0.0], 2), (None, [0.5, 0.3], 2), (None, [0.5, 0.25], 1), (300, [0.1, 0.2, 0.3], None), (350, [-0.5, -0.25], 1), (400, [3e38, 0.0], 3), (7, [0.0, 0.0], 2), (1, [0.5], 2)]


def test_top_products_equal_brute_force(spark):
    for rows, shard, block in ((clustered(900), 100, 8), (clustered(700, seed=1, equal=250), 64, 5)):
        got = top_products(frame(spark, rows), shard=shard, block=block).collect()
        assert sorted(repr((r.query_id, r.rank, r.vec_id, r.score)) for r in got) == plain_top(rows)


def test_top_products_edge_cases(spark):
    # The clipped component of 3e38 is compared by itself: floor(256 * 3e38) is no long.
    rows = [r for r in EDGE if r[0] != 400]
    got = top_products(frame(spark, rows)).collect()
    assert sorted(repr((r.query_id, r.rank, r.vec_id, r.score)) for r in got) == plain_top(rows)
    assert top_products(frame(spark, [])).count() == 0 and top_products(frame(spark, [(50, [1.0], 1)])).count() == 0
    huge = top_products(frame(spark, [(50, [3e38], 1), (1, [1.0], 1)])).collect()
    assert [r.score for r in huge] == [256 << 26]


def test_a_query_skips_balls_below_its_kth_score():
    rows = clustered(4000, d=8, seed=2)
    v = np.array([whole(e) for _, e, _ in rows], np.int32)
    pack = Pack(0, np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), v)
    tree, queries = BallTree.grow(pack), pack.take(np.arange(0, 4000, 50))
    assert {tuple(x) for x in tree.pack.v.tolist()} == {tuple(x) for x in v.tolist()} and (tree.nodes[:, 2] < 0).sum() > 40
    opened = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                opened.append(at.stop - at.start)
            return super().__getitem__(at)

    tree.pack.rows = tree.pack.rows.view(Counted)
    none = np.full(len(queries.ids), np.iinfo(np.int64).min)
    who, at, score = tree.search(queries, none, 5)
    full = len(opened)
    s = v[::50].astype(np.int64) @ v.T.astype(np.int64)
    s[np.arange(80), np.arange(0, 4000, 50)] = np.iinfo(np.int64).min
    want = np.sort(s, axis=1)[:, ::-1][:, :5]
    assert (score.reshape(80, 5) == want).all()
    opened.clear()
    # With the kth scores of others known, fewer leaves are opened, and nothing better is lost.
    again = tree.search(queries, want[:, 4].astype(np.int64), 5)
    assert (again[2].reshape(80, 5) == want).all() and len(opened) <= full


def test_hard_negatives_equal_brute_force(spark):
    for rows, shard, block in ((clustered(900, seed=4), 100, 8), (clustered(700, seed=5, equal=250), 64, 5)):
        got = hn.hard_negatives(frame(spark, rows), shard=shard, block=block).collect()
        assert sorted(repr(tuple(r)) for r in got) == plain_negatives(rows) and len(got) > 50


def test_hard_negatives_edge_cases(spark):
    rows = [r for r in EDGE if r[0] != 400]
    got = hn.hard_negatives(frame(spark, rows)).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_negatives(rows)
    assert hn.hard_negatives(frame(spark, [])).count() == 0
    few = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.7], 2)]
    assert sorted(repr(tuple(r)) for r in hn.hard_negatives(frame(spark, few)).collect()) == plain_negatives(few)
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    told = [(i, e, (label + 1) % 10 if i % 7 == 0 else label) for i, e, label in clustered(300, seed=6)]
    got = hn.hard_negatives(frame(spark, clustered(300, seed=6)), shifted).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_negatives(told)


@pytest.mark.parametrize("share", [-1.0, 0.05, 0.3, 0.7])
def test_suffix_index_finds_all_pairs_above_a_threshold(share):
    rows = clustered(600, d=40, seed=8)
    v = np.array([whole(e) for _, e, _ in rows], np.int32)
    pack = Pack(0, np.arange(600), np.arange(600), np.zeros(600, np.int64), v)
    queries = pack.take(np.arange(0, 600, 20))
    index = hn.SuffixIndex(pack)
    least = share * 65536 * np.linspace(0.8, 1.2, 30)
    least[3] = np.inf
    who, at, score = index.join(queries, least)
    s = v[::20].astype(np.int64) @ v.T.astype(np.int64)
    want = {(a, b, s[a, b]) for a, b in zip(*np.nonzero(s >= least[:, None]), strict=True)}
    assert set(zip(who.tolist(), at.tolist(), score.tolist(), strict=True)) == want
    lengths = index.lengths(share * 256)
    assert (lengths == 40).all() if share < 0 else (lengths < 40).any()


def test_best_keeps_order_and_ties():
    q, s, ids = np.array([1, 0, 0, 0, 1]), np.array([5, 7, 9, 7, 5]), np.array([3, 8, 1, 2, 2])
    assert best(q, s, ids, np.arange(5), 2).tolist() == [2, 3, 4, 0]
