"""Cover trees, product codes and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from playlens.llm import codes, covertree, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, VECTOR string, error int, row int"


@pytest.mark.parametrize("n, width, spread", [(1, 3, 5), (2, 1, 1), (300, 2, 40), (500, 16, 3), (400, 8, 1000)])
def test_tree(n, width, spread):
    rng = np.random.default_rng(n)
    points = np.unique(rng.integers(-spread, spread, (n, width)), axis=0).astype(float)
    tree = covertree.build(points)
    points = points[tree.order]
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    assert sorted([0, *tree.child.tolist()]) == list(range(len(points))), "every point has one parent"

    def below(node: int) -> set[int]:
        found = {int(tree.point[node])}
        stack = [node]
        while stack:
            at = stack.pop()
            for p in tree.children(np.array([at]))[0].tolist():
                found.add(p)
                if tree.entry[p] >= 0:
                    stack.append(int(tree.entry[p]))
            if tree.follow[at] >= 0:
                stack.append(int(tree.follow[at]))
        return found

    sums = tree.sums(points)
    for node in range(len(tree.point)):
        found = sorted(below(node))
        far = np.sqrt(((points[found] - points[tree.point[node]]) ** 2).sum(1))
        assert far.max() == pytest.approx(tree.radius[node]) and (sums[node] == points[found].sum(0)).all()
    if len(points) > 1:
        assert len(below(int(tree.entry[0]))) == len(points)


def vectors(n: int, width: int = 8, seed: int = 3, scale: float = 0.3) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        rows.append((i * 3, [c + rng.gauss(0, scale / 4) for c in centre], rng.randrange(4)))
    hot = rows[5][1]
    rows += [(10_000 + i * 10, hot, i % 3) for i in range(80)]                     # many copies of one vector
    rows += [(7, rows[0][1], None), (None, rows[1][1], 2), (None, rows[2][1], None), (9, rows[3][1], 1), (9, rows[3][1], 1)]
    rows += [(1, None, 1), (2, [], 1), (4, [math.nan] * width, 1), (5, [math.inf] + [0.0] * (width - 1), 1)]
    rows += [(8, [0.1] * (width - 1) + [None], 1), (10, [0.1] * (width + 4), 1), (11, [0.0] * width, 0), (200, [-0.5] * width, 3)]
    return [(*r, "x", 1, 2) for r in rows]


def whole(rows: list[tuple], scale: int, width: int = 8) -> list[tuple]:
    found = []
    for r in rows:
        v = r[1]
        if v and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            found.append((r[0], tuple(math.floor(float(np.float32(x)) * scale) for x in v), r[2]))
    return found


@pytest.mark.parametrize("block", [2048, 50])
def test_codes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "ENTRIES", 24)
    rows = vectors(400)
    got = codes.digest(spark.createDataFrame(rows, SCHEMA).repartition(6), block).collect()
    kept = sorted(whole(rows, 1024), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[list(r[1][2 * p:2 * p + 2]) for r in kept[:24]] for p in range(4)]

    def nearest(part, book):
        return min(range(len(book)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(part, book[i])), i))

    for _ in range(4):
        for p in range(4):
            sums = defaultdict(list)
            for _, v, _ in kept:
                sums[nearest(v[2 * p:2 * p + 2], books[p])].append(v[2 * p:2 * p + 2])
            for i, some in sums.items():
                books[p][i] = [sum(x) // len(some) for x in zip(*some)]
    expected, of_label = [], defaultdict(int)
    for i, v, label in kept:
        best = [nearest(v[2 * p:2 * p + 2], books[p]) for p in range(4)]
        error = sum((a - b) ** 2 for p in range(4) for a, b in zip(v[2 * p:2 * p + 2], books[p][best[p]]))
        of_label[label] += error
        expected.append((i, "".join(f"{b:02x}" for b in best), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    expected = [(i, code, error, of_label[label], digest) for i, code, error, label in expected]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_most_subtrees_are_assigned_whole():
    """Well separated clusters: the walk compares few points with all entries."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-20000, 20000, (16, 4))
    values = np.concatenate([c + rng.integers(-40, 40, (100, 4)) for c in centres])
    part = codes.Part(values)
    whole_nodes, single = part.assign(covertree.exact(centres))
    assert sum(len(points) for points, _ in single) < 0.05 * len(part.points)
    exact = covertree.squares(covertree.exact(values), covertree.exact(centres)).argmin(1)
    assert (part.nearest(covertree.exact(centres)) == exact).all()
    assert part.totals(covertree.exact(centres))[:, -1].tolist() == np.bincount(exact, minlength=16).tolist()


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = codes.digest(empty)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and found.count() == 0
    one = codes.digest(spark.createDataFrame([(None, [0.5, -0.25, 0.0, 1.0], None, "", 0, 0)], SCHEMA)).collect()
    assert [tuple(r)[:4] for r in one] == [(None, "00000000", 0, 0)]
    with pytest.raises(ValueError):
        codes.digest(spark.createDataFrame([(1, [0.5, 0.5], 1, "", 0, 0)], SCHEMA))


def brute_force(rows: list[tuple]) -> list[tuple]:
    kept = []
    for i, v, label in whole(rows, negatives.SCALE):
        if label is not None:
            kept.append((i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    found = []
    for at, (anchor, q, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scores = [(sum(a * b for a, b in zip(q, v)), i, other) for j, (i, v, other) in enumerate(kept) if j != at]
        for p, positive, _ in sorted((s for s in scores if s[2] == label), key=order)[:5]:
            window = [s for s in scores if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p]
            for rank, (n, negative, _) in enumerate(sorted(window, key=order)[:10], 1):
                found.append((anchor, positive, rank, negative, p, n))
    return found


@pytest.mark.parametrize("block, group", [(2048, 1 << 20), (64, 40)])
def test_negatives_against_brute_force(spark, monkeypatch, block, group):
    """Once as it is, once in many small trees and many groups of anchors."""
    monkeypatch.setattr(negatives, "GROUP", group)
    rows = vectors(500) + [(300, vectors(500)[100][1], 2, "x", 1, 2)] * 2
    got = negatives.digest(spark.createDataFrame(rows, SCHEMA).repartition(4), block).collect()
    expected = brute_force(rows)
    assert len(expected) > 300
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


@pytest.mark.parametrize("opened", [2, 64])
def test_descent_skips_nodes(monkeypatch, opened):
    """Separated clusters: few of the scores are computed, and the result is that of all scores."""
    monkeypatch.setattr(negatives, "OPEN", opened)
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 300, (30, 12))
    vectors = np.concatenate([c + rng.integers(-6, 7, (60, 12)) for c in centres])
    n = len(vectors)
    ids = np.arange(n)
    shelf = negatives.Shelf(ids, np.zeros(n, bool), ["a"] * n, ids, vectors, 11)
    asked = vectors[::90].astype(float)
    every = np.full((len(asked), 1), np.inf)
    walkers = negatives.Walkers(ids[::90], np.array(["b"] * len(asked)), asked, -every, every, False, 10)
    scored = walkers.visit(shelf)
    assert scored < 0.5 * n * len(asked)
    best = [sorted(range(n), key=lambda j: (-(asked[a] @ vectors[j]), j)) for a in range(len(asked))]
    best = [[j for j in some if j != ids[::90][a]][:10] for a, some in enumerate(best)]
    assert walkers.found[4].reshape(-1, 10).tolist() == best


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.digest(empty).columns == names and negatives.digest(empty).count() == 0
    alone = negatives.digest(spark.createDataFrame([(100, [1.0, 0.0], 1, "", 0, 0)], SCHEMA))
    assert alone.columns == names and alone.count() == 0
    none_asks = negatives.digest(spark.createDataFrame([(101, [1.0, 0.0], 1, "", 0, 0)], SCHEMA))
    assert none_asks.count() == 0
    zero = negatives.digest(spark.createDataFrame([(i, [0.0, 0.0], i % 3, "", 0, 0) for i in range(1, 400)], SCHEMA))
    assert zero.count() == 3 * 5 * 10
