"""Vector codes beside plain Lloyd rounds."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from firnline.llm import vector_codes

DDL = "vec_id long, embedding array<float>, label int, code string, part long"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, label, code, error) and the codebooks, with Python's whole numbers."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(4096 * float(np.float32(x))) for x in v], label))
    if not kept:
        return [], []
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    each = len(first[0][1]) // parts
    cut = lambda v, p: v[p * each : (p + 1) * each]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                held[p, nearest(cut(v, p), p)[1]].append(cut(v, p))
        for (p, k), some in held.items():
            books[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    out = []
    for i, v, label in kept:
        found = [nearest(cut(v, p), p) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def vectors(seed, n, width, scale=0.2):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.normal(0, scale, width) + (i % 5)).astype("f4").tolist(), int(i % 3)) for i in rng.permutation(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], DDL).repartition(3)


@pytest.mark.parametrize("settings", [{}, {"chunk_rows": 50, "leaf": 2}, {"entries": 5, "rounds": 1}, {"parts": 4, "leaf": 1}])
def test_codes(spark, settings):
    nan, inf = float("nan"), float("inf")
    same = [0.25] * 16
    rows = vectors(1, 300, 16) + [
        (900, None, 1), (901, [nan] + [0.0] * 15, 1), (902, [0.0] * 15 + [inf], None), (903, [None] + [1.0] * 15, 1),
        (904, same, None), (905, same, None), (904, same, 2), (None, [-0.1] * 16, None), (None, [-0.1] * 16, 1), (-5, [0.0] * 16, 1),
    ]
    coded, books = vector_codes.vector_codes(frame(spark, rows), **settings)
    few = {k: v for k, v in settings.items() if k in ("entries", "rounds", "parts")}
    want, want_books = plain(rows, **few)
    assert Counter((r.vec_id, r.label, r.code, r.error) for r in coded.collect()) == Counter(want)
    assert books.tolist() == want_books


def test_few_rows_and_none(spark):
    rows = vectors(2, 3, 8)
    coded, books = vector_codes.vector_codes(frame(spark, rows))
    assert books.shape == (8, 3, 1) and {r.error for r in coded.collect()} == {0}
    coded, _ = vector_codes.vector_codes(frame(spark, rows).limit(0))
    assert vector_codes.with_group_sum(coded, "label", "error", "label_error").count() == 0


def test_unfit_vectors_are_errors(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(frame(spark, [(1, [0.5] * 9, 1)]))
    with pytest.raises(ValueError, match="has not"):
        vector_codes.vector_codes(frame(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)]))
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(frame(spark, [(1, [1e30] * 8, 1)]))


@pytest.mark.parametrize("clusters,leaf,k", [(3, 8, 16), (40, 4, 16), (1, 32, 1), (9, 1, 7)])
def test_whole_nodes_equal_single_points(clusters, leaf, k):
    rng = np.random.default_rng(clusters)
    points = (rng.integers(-4000, 4000, (clusters, 4))[rng.integers(0, clusters, 500)] + rng.integers(-3, 4, (500, 4)))
    entries = np.concatenate([points[: k // 2], points[: k - k // 2]])  # ties
    tree = vector_codes.Tree.over(points, leaf)
    chosen, counts, sums = vector_codes.assign(tree, entries, leaf)
    away = ((tree.points[:, None] - entries) ** 2).sum(axis=2)
    assert (chosen == away.argmin(axis=1)).all()
    assert (counts == np.bincount(chosen, minlength=k)).all()
    assert all((sums[e] == tree.points[chosen == e].sum(axis=0)).all() for e in range(k))


@pytest.mark.parametrize("hot", [1, 1000])
def test_group_sums_with_hot_and_null_groups(spark, hot, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_LABELS", hot)
    rows = [(i, [None, 1, 1, 1, 2, 3][i % 6], i) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, label int, error long")
    got = vector_codes.with_group_sum(df, "label", "error", "total").collect()
    total = Counter()
    for _, label, e in rows:
        total[label] += e
    assert sorted((r.vec_id, r.total) for r in got) == [(i, total[label]) for i, label, _ in rows]
