"""Hard negatives by inner product, searched in cover trees over norm-augmented vectors.

A further component lifts all vectors of a block to one norm, so that an inner product depends on
the angle alone. A node of the cover tree over the lifted vectors covers a radius, that is
an angle around its point, which bounds the inner products of an anchor with all that lies below
the node. Descent opens an anchor's best nodes first and skips nodes that lie outside all
windows of scores, or below the scores found already; what is reached is scored exactly.

Trees stand for blocks of vectors and stay where they were built. Anchors, which are many on a large
table, are dealt out in groups of bounded size, and each group meets each share of the trees in a
task of its own.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from playlens.llm import covertree
from playlens.llm.common import save, spread

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative has between LOW and HIGH per cent of the positive's score.
LOW, HIGH = 30, 90
#: Numbers in the vectors of a group of anchors; anchors that walk a tree together; nodes opened at once.
GROUP, TOGETHER, OPEN = 1 << 20, 256, 64
NO_ID = np.iinfo(np.int64).max  # orders null ids last
NEVER = -np.inf


class Shelf:
    """A block of vectors as a searchable tree: different vectors, and who has them."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, labels: list[str], rows: np.ndarray, vectors: np.ndarray, keep: int):
        points, spot = np.unique(vectors, axis=0, return_inverse=True)
        points = covertree.exact(points)
        norms = (points * points).sum(1)
        self.norm = float(np.sqrt(norms.max()))
        lifted = np.concatenate([points, np.sqrt(norms.max() - norms)[:, None]], 1)
        self.tree = covertree.build(lifted)
        self.points = points[self.tree.order]
        place = np.empty(len(points), np.int64)
        place[self.tree.order] = np.arange(len(points))
        spot = place[spot.ravel()]
        self.labels, number = np.unique(np.array(labels, dtype=object).astype(str), return_inverse=True)
        # Of equal vectors with equal labels only the `keep` smallest ids can ever be asked for.
        order = np.lexsort((rows, ids, missing, number, spot))
        change = np.ones(len(order), bool)
        change[1:] = (np.diff(spot[order]) != 0) | (np.diff(number[order]) != 0)
        start = np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))
        order = order[np.arange(len(order)) - start < keep]
        self.ids, self.missing, self.rows, self.label = ids[order], missing[order], rows[order], number[order]
        self.first = np.searchsorted(spot[order], np.arange(len(points) + 1))
        self.has = np.zeros((len(points), len(self.labels)), bool)
        self.has[spot, number] = True
        self.angle = 2 * np.arcsin(np.minimum(1.0, self.tree.radius / max(2 * self.norm, 1e-300)))

    def admissible(self, labels: np.ndarray, same: bool) -> np.ndarray:
        """anchors x points: whether a vector has an owner with the anchor's label, or with another."""
        at = np.searchsorted(self.labels, labels)
        known = (at < len(self.labels)) & (self.labels[np.minimum(at, len(self.labels) - 1)] == labels)
        own = np.where(known, self.has[:, np.minimum(at, len(self.labels) - 1)], False).T
        return own if same else self.has.sum(1) > own


class Walkers:
    """Anchors that search together, the windows of each, and the best rows found so far."""

    def __init__(self, rows, labels, vectors, low, high, same: bool, best: int):
        self.rows, self.labels, self.vectors = rows, labels, vectors
        self.low, self.high, self.same, self.best = low, high, same, best
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.least = np.full(low.shape, NEVER)  # the last of the best scores, once there are enough
        none = np.zeros(0, np.int64)
        self.found = (none, none, np.zeros(0), np.zeros(0, bool), none)  # anchor, window, score, id is null, id

    def visit(self, shelf: Shelf) -> int:
        """Search one tree; returns how many scores were computed."""
        tree, ok = shelf.tree, shelf.admissible(self.labels, self.same)
        here = np.flatnonzero(ok.any(1) & (self.low <= self.high).any(1))
        if not len(here):
            return 0
        scores = np.full((len(here), len(shelf.points)), NEVER)
        upper = np.full((len(here), len(tree.point)), NEVER)
        lower = np.full((len(here), len(tree.point)), np.inf)
        seen = np.ones((len(here), 1), bool)
        self._score(shelf, here, ok, scores, np.zeros(1, np.int64), seen)
        self._reach(shelf, here, scores, upper, lower, tree.entry[:1], seen)
        total = len(here)
        while True:
            open_ = self._open(here, upper, lower)
            nodes = np.flatnonzero(open_.any(0))
            if not len(nodes):
                return total
            upper[open_] = NEVER
            points, owner = tree.children(nodes)
            seen = open_[:, nodes]
            self._score(shelf, here, ok, scores, points, seen[:, owner])
            total += int(seen[:, owner].sum())
            inner = tree.entry[points] >= 0
            self._reach(shelf, here, scores, upper, lower, tree.entry[points[inner]], seen[:, owner[inner]])
            follow = tree.follow[nodes]
            self._reach(shelf, here, scores, upper, lower, follow[follow >= 0], seen[:, follow >= 0])

    def _open(self, here, upper, lower) -> np.ndarray:
        """anchors x nodes: the best nodes of each anchor, of those that may hold a row it wants."""
        wanted = np.zeros(upper.shape, bool)
        for w in range(self.low.shape[1]):
            floor = np.maximum(self.low[here, w], self.least[here, w])[:, None]
            wanted |= (upper >= floor) & (lower <= self.high[here, w][:, None])
        wanted &= upper > NEVER
        upper[~wanted] = NEVER
        if upper.shape[1] > OPEN:
            edge = np.partition(upper, upper.shape[1] - OPEN, 1)[:, [upper.shape[1] - OPEN]]
            wanted &= upper >= edge
        return wanted

    def _reach(self, shelf, here, scores, upper, lower, nodes, seen) -> None:
        """Bound the inner products of `nodes` by the angles that they cover."""
        if not len(nodes) or nodes[0] < 0:
            return
        reach = np.maximum(self.norms[here] * shelf.norm, 1e-300)[:, None]
        angle = np.arccos(np.clip(scores[:, shelf.tree.point[nodes]] / reach, -1, 1))
        slack = 1e-6 * reach + 1e-6
        high = reach * np.cos(np.maximum(0, angle - shelf.angle[nodes])) + slack
        low = reach * np.cos(np.minimum(np.pi, angle + shelf.angle[nodes])) - slack
        upper[:, nodes] = np.where(seen, high, upper[:, nodes])
        lower[:, nodes] = np.where(seen, low, lower[:, nodes])

    def _score(self, shelf, here, ok, scores, points, seen) -> None:
        """Exact scores of `points`, and those that are among the best in a window."""
        got = self.vectors[here] @ shelf.points[points].T
        scores[:, points] = np.where(seen, got, scores[:, points])
        fits = seen & ok[np.ix_(here, points)]
        more = self.best + 1  # the anchor itself may be among them
        parts = []
        for w in range(self.low.shape[1]):
            floor = np.maximum(self.low[here, w], self.least[here, w])[:, None]
            inside = fits & (got >= floor) & (got <= self.high[here, w][:, None])
            if len(points) > more:
                edge = np.partition(np.where(inside, got, NEVER), len(points) - more, 1)[:, [len(points) - more]]
                inside &= got >= edge
            anchor, point = np.nonzero(inside)
            sizes = shelf.first[points[point] + 1] - shelf.first[points[point]]
            pair = np.repeat(np.arange(len(anchor)), sizes)
            member = np.arange(len(pair)) - np.r_[0, np.cumsum(sizes)[:-1]][pair] + shelf.first[points[point]][pair]
            of = here[anchor[pair]]
            right = (shelf.labels[shelf.label[member]] == self.labels[of]) == self.same
            right &= shelf.rows[member] != self.rows[of]
            pair, member, of = pair[right], member[right], of[right]
            parts.append((of, np.full(len(of), w), got[anchor[pair], point[pair]], shelf.missing[member], shelf.ids[member]))
        if sum(len(part[0]) for part in parts):
            self._keep(parts)

    def _keep(self, parts) -> None:
        anchor, window, score, missing, ids = (np.concatenate(c) for c in zip(self.found, *parts))
        order = np.lexsort((ids, missing, -score, window, anchor))
        key = (anchor * self.low.shape[1] + window)[order]
        start = np.searchsorted(key, key)
        rank = np.arange(len(key)) - start
        order, key, rank = order[rank < self.best], key[rank < self.best], rank[rank < self.best]
        self.found = tuple(c[order] for c in (anchor, window, score, missing, ids))
        full = rank == self.best - 1
        self.least.ravel()[key[full]] = score[order][full]


def shelves(rows: DataFrame, keep: int, block: int = covertree.BLOCK) -> DataFrame:
    """(shelf): the blocks of `rows` (row, vec_id, label, v) as pickled trees."""
    def build(batches):
        for batch in batches:
            for some in covertree.blocks(batch, block):
                ids = some.column(1)
                made = Shelf(
                    ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                    some.column(2).to_pylist(), some.column(0).to_numpy(), covertree.rows_of(some.column(3)), keep,
                )
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["shelf"])

    return save(rows.select("row", "vec_id", "label", "v").mapInArrow(build, "shelf binary"), "shelves")


def search(anchors: DataFrame, trees: DataFrame, size: int, same: bool, best: int) -> DataFrame:
    """(row, of, score, id): the best rows for each anchor and each of its windows.

    `anchors` has row, label, v and windows, an array<struct<of, low, high>> of scores; `size` is the number
    of components. Rows have the anchor's label or, if not `same`, another.
    """
    groups = max(1, -(-anchors.count() * size // GROUP))
    tasks = 2 * int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, min(trees.count(), -(-tasks // groups)))
    left = anchors.select(
        F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("s"),
        "row", "label", "v", "windows", F.lit(None).cast("binary").alias("shelf"),
    )
    right = trees.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("a"), F.pmod(F.xxhash64("shelf"), F.lit(shares)).cast("int").alias("s"),
        *(F.lit(None).cast(left.schema[n].dataType).alias(n) for n in ("row", "label", "v", "windows")), "shelf",
    )
    # Within a task the anchors come before the trees, which stream past them.
    dealt = spread(left.unionByName(right), F.col("a"), F.col("s")).sortWithinPartitions("a", "s", F.col("row").asc_nulls_last())

    def walk(batches):
        task, waiting, walkers = None, [], []
        for batch in batches:
            where, asks = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), batch.column(2).is_valid().to_pylist()
            for i in range(batch.num_rows):
                if where[i] != task:
                    yield from results(walkers)
                    task, waiting, walkers = where[i], [], []
                if asks[i]:
                    waiting.append(batch.slice(i, 1))
                    continue
                if waiting:
                    walkers, waiting = gathered(waiting), []
                if walkers:
                    shelf = pickle.loads(batch.column(6)[i].as_py())
                    for some, _ in walkers:
                        some.visit(shelf)
        yield from results(walkers)

    def gathered(waiting):
        table = pa.Table.from_batches(waiting).combine_chunks().sort_by([("label", "ascending"), ("row", "ascending")])
        made = []
        for at in range(0, len(table), TOGETHER):
            some = table.slice(at, TOGETHER).combine_chunks()
            windows = some.column("windows").to_pylist()
            width = max(1, max(map(len, windows)))
            low, high = np.full((len(some), width), np.inf), np.full((len(some), width), NEVER)
            for i, found in enumerate(windows):
                for w, window in enumerate(found):
                    low[i, w], high[i, w] = window["low"], window["high"]
            vectors = np.array(some.column("v").to_pylist(), np.int64)
            labels = np.array(some.column("label").to_pylist(), dtype=object).astype(str)
            rows = some.column("row").to_numpy()
            made.append((Walkers(rows, labels, covertree.exact(vectors), low, high, same, best), windows))
        return made

    def results(walkers):
        for some, windows in walkers:
            anchor, window, score, missing, ids = some.found
            if len(anchor):
                of = [windows[a][w]["of"] for a, w in zip(anchor.tolist(), window.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some.rows[anchor]), pa.array(of, pa.int32()), pa.array(score.astype(np.int64)),
                    pa.array(ids, mask=missing),
                ], names=["row", "of", "score", "id"])

    found = dealt.mapInArrow(walk, "row long, of int, score long, id long")
    order = Window.partitionBy("row", "of").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def mined(embeddings: DataFrame, anchor: Column, label: Column, block: int = covertree.BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` says which rows of `embeddings` (vec_id, embedding) ask, `label` gives their labels. Rows without
    a label or with a broken vector (`covertree.kept`) take no part. Every row is one of its own: one that
    repeats an anchor may be its positive, and an anchor that repeats asks again. Ties go to smaller ids, null
    last. A positive with a negative score has no negatives, since its window is empty. Components beyond some
    thousands can't be scored exactly and are an error. An empty table, or one without anchors, gives no row.
    """
    spark = embeddings.sparkSession
    rows = covertree.kept(embeddings, SCALE, label.cast("string")).where("label IS NOT NULL")
    rows = rows.withColumn("asks", F.coalesce(anchor, F.lit(False))).select(F.col("vec_id").cast("bigint"), "label", "v", "asks")
    # Neighbours by label make trees of few labels, so that most hold no positive of an anchor.
    rows = rows.sortWithinPartitions("label").withColumn("row", F.monotonically_increasing_id())
    rows = save(rows, "candidates")
    some = rows.select(F.size("v")).first()
    if some is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    trees = shelves(rows, max(POSITIVES, NEGATIVES) + 1, block)
    asking = rows.where("asks")
    everything = F.array(F.struct(F.lit(0).alias("of"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    positives = search(asking.withColumn("windows", everything), trees, some[0], True, POSITIVES)
    score = F.col("score")
    window = F.struct(
        F.col("rank").alias("of"), F.ceil(score * LOW / 100).cast("double").alias("low"), F.floor(score * HIGH / 100).cast("double").alias("high"),
        F.col("id"), score.alias("score"),
    )
    windows = save(positives.groupBy("row").agg(F.sort_array(F.collect_list(window)).alias("windows")), "positives")
    asking = asking.join(windows, "row")
    negatives = search(asking, trees, some[0], False, NEGATIVES)
    return negatives.join(asking.select("row", F.col("vec_id").alias("anchor_id"), "windows"), "row").withColumn(
        "p", F.get("windows", F.col("of") - 1)
    ).select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def digest(embeddings: DataFrame, block: int = covertree.BLOCK) -> DataFrame:
    """Hard negatives of every hundredth row; labels of every seventh are shifted by one of ten."""
    i, label = F.col("vec_id"), F.col("label")
    return mined(embeddings, i % 100 == 0, F.when(i % 7 == 0, (label + 1) % 10).otherwise(label), block)
