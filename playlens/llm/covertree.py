"""Cover trees over a bounded block of points, built and walked with numpy.

Points are taken farthest first: each has the greatest distance to those before it. All points
with a distance above some scale then form a net, and the nets of shrinking scales are
prefixes of that order: they are nested, their points are apart by more than the scale, and
they cover all points within it. A point's parent is the nearest one in the net before the one
that it enters with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Points of a block, and by how much the scale shrinks from one net to the next.
BLOCK = 2048
BASE = 1.5
#: Integers below this are exact in a double, sums and differences of squares included.
EXACT = 2.0**51


@dataclass
class Tree:
    """Points in the order they were taken, and nodes: a point with its children at one scale.

    A point is in as many nodes as it has scales with children. A node stands for its point and all
    that lies below it at its own and smaller scales.
    """

    order: np.ndarray   # number of each point in the given order
    point: np.ndarray   # of a node; the nodes of a point are neighbours, widest first
    level: np.ndarray   # of a node: the net that its children enter with
    radius: np.ndarray  # of a node: distance to the furthest point below it
    follow: np.ndarray  # the next node of the same point, or -1
    first: np.ndarray   # node i has the children child[first[i]:first[i + 1]], which are points
    child: np.ndarray
    entry: np.ndarray   # the widest node of a point, or -1 for a leaf

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, position of the parent in `nodes`) of the children of all `nodes`."""
        sizes = self.first[nodes + 1] - self.first[nodes]
        owner = np.repeat(np.arange(len(nodes)), sizes)
        shift = self.first[nodes] - np.r_[0, np.cumsum(sizes)[:-1]]
        return self.child[np.arange(len(owner)) + shift[owner]], owner

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per node the sum of `values` (rows by point) over all that it stands for."""
        below = values.copy()  # of each point: itself and the nodes summed so far
        total = np.zeros((len(self.point), *values.shape[1:]), values.dtype)
        for level in sorted(set(self.level.tolist()), reverse=True):
            at = np.flatnonzero(self.level == level)
            points, owner = self.children(at)
            np.add.at(below, self.point[at][owner], below[points])
            total[at] = below[self.point[at]]
        return total

    def spread(self, of_node: np.ndarray, of_point: np.ndarray) -> None:
        """Hand the values of nodes (-1: none) down to all the points below them."""
        for level in sorted(set(self.level.tolist())):
            at = np.flatnonzero((self.level == level) & (of_node >= 0))
            of_point[self.point[at]] = of_node[at]
            follow = self.follow[at]
            of_node[follow[follow >= 0]] = of_node[at][follow >= 0]
            points, owner = self.children(at)
            of_point[points] = of_node[at][owner]
            inner = self.entry[points] >= 0
            of_node[self.entry[points[inner]]] = of_node[at][owner[inner]]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` to all of `b`; exact for integers within EXACT."""
    found = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.maximum(found, 0, out=found)


def build(points: np.ndarray, base: float = BASE) -> Tree:
    """The tree of different points, one per row, in doubles. Takes n * n * d steps, n numbers at a time."""
    n = len(points)
    norms = (points * points).sum(1)
    order, gap, near, at = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, np.inf), 0
    for i in range(n):
        order[i], gap[i] = at, near[at]
        np.minimum(near, norms + norms[at] - 2 * (points @ points[at]), out=near)
        near[at] = -np.inf
        at = int(near.argmax())
    gap = np.minimum.accumulate(gap)
    points, norms = points[order], norms[order]
    # The nets: how many points each has.
    nets, scale = [1], gap[1] if n > 1 else 0.0
    while nets[-1] < n:
        scale /= base * base
        size = int((gap > scale).sum()) if scale > 1e-12 else n
        if size > nets[-1]:
            nets.append(size)
    level, parent = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(nets, nets[1:]), 1):
        level[a:b] = i
        for start in range(a, b, 512):
            stop = min(b, start + 512)
            parent[start:stop] = (norms[:a] - 2 * (points[start:stop] @ points[:a].T)).argmin(1)
    child = np.lexsort((np.arange(n), level, parent))
    child = child[child != 0]
    change = np.ones(max(0, n - 1), bool)
    change[1:] = (parent[child][1:] != parent[child][:-1]) | (level[child][1:] != level[child][:-1])
    first = np.flatnonzero(change)
    point, node_level = parent[child][first], level[child][first]
    follow, entry = np.full(len(point), -1, np.int64), np.full(n, -1, np.int64)
    same = np.flatnonzero(point[1:] == point[:-1])
    follow[same] = same + 1
    entry[point[::-1]] = np.arange(len(point))[::-1]
    # The distance to the furthest point below, by walking all points up net by net.
    radius, ancestor = np.zeros(len(point)), np.arange(n)
    for i in range(len(nets) - 1, 0, -1):
        ancestor = np.where(ancestor >= nets[i - 1], parent[ancestor], ancestor)
        far = np.zeros(n)
        np.maximum.at(far, ancestor, np.sqrt(((points - points[ancestor]) ** 2).sum(1)))
        nodes = node_level == i
        radius[nodes] = far[point[nodes]]
    return Tree(order, point, node_level, radius, follow, np.r_[first, n - 1], child, entry)


def exact(values: np.ndarray) -> np.ndarray:
    """Integers as doubles; refuses those whose squared distances would be rounded."""
    found = values.astype(np.float64)
    if found.size and (found * found).sum(1).max() >= EXACT / 2:
        raise ValueError("components are too large for exact distances")
    return found


def rows_of(column: pa.ListArray) -> np.ndarray:
    """A list column whose lists have one length, as a table of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def kept(embeddings: DataFrame, scale: int, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v): rows whose vector is whole, with floor(scale * x) for each component.

    A vector is whole if it isn't null or empty, and no component is null, infinite or not a number.
    The number of components is that of the row with the smallest vec_id, null last; vectors of another
    length are dropped. Rows that repeat stay; other columns don't matter.
    """
    x = F.col("embedding")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(
        "vec_id", (F.col("label") if label is None else label).alias("label"),
        F.when(whole, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))).alias("v"),
    ).where("v IS NOT NULL")
    length = rows.agg(F.min_by(F.size("v"), F.struct(F.col("vec_id").isNull(), "vec_id", "v"))).first()[0]
    return rows.where(F.size("v") == (length or 0))
