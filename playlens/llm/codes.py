"""Product codes of vectors, fitted by Lloyd's rounds over cover trees.

Each partition cuts its vectors into parts and builds cover trees over blocks of them, once. A node
knows its radius and, cumulated over all below it, the sum and number of its vectors. A round
walks the trees from the top: where the triangle inequality leaves one entry of the
codebook for a whole subtree, its sum goes to that entry at once; only ambiguous nodes are opened,
down to exact comparisons. What a task hands on are sums per entry.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from playlens.llm import covertree
from playlens.llm.common import save

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: On top of distances that are rounded.
SLACK = 1e-9


class Part:
    """One part of a block of vectors: its different values as a cover tree."""

    def __init__(self, values: np.ndarray):
        points, self.spot, times = np.unique(values, axis=0, return_inverse=True, return_counts=True)
        points = covertree.exact(points)
        self.tree = covertree.build(points)
        place = np.empty(len(points), np.int64)
        place[self.tree.order] = np.arange(len(points))
        self.spot = place[self.spot.ravel()]  # point of each vector
        self.points = points[self.tree.order]
        self.weighted = np.concatenate([self.points, np.ones((len(points), 1))], 1) * times[self.tree.order, None]
        self.sums = self.tree.sums(self.weighted)  # of nodes; the last column counts

    def assign(self, entries: np.ndarray) -> tuple[list, list]:
        """([(nodes, entry)], [(points, entry)]): subtrees and leaves with their nearest entry.

        `entries` are different, in the order in which ties are decided.
        """
        tree, distance = self.tree, np.empty((len(self.points), len(entries)))
        distance[0] = covertree.squares(self.points[:1], entries)
        if tree.entry[0] < 0:
            return [], [(np.zeros(1, np.int64), distance[:1].argmin(1))]
        whole, single = [], []
        nodes, may = tree.entry[:1], np.ones((1, len(entries)), bool)
        while len(nodes):
            found = np.where(may, distance[tree.point[nodes]], np.inf)
            best = found.argmin(1)
            # Beyond this, an entry is further than the best one from all points of the node.
            limit = np.sqrt(found[np.arange(len(nodes)), best]) + 2 * tree.radius[nodes]
            may = np.sqrt(found) <= (limit * (1 + SLACK) + SLACK)[:, None]
            clear = may.sum(1) == 1
            whole.append((nodes[clear], best[clear]))
            nodes, may, best = nodes[~clear], may[~clear], best[~clear]
            points, owner = tree.children(nodes)
            distance[points] = covertree.squares(self.points[points], entries)
            leaf = tree.entry[points] < 0
            single.append((points[leaf], np.where(may[owner[leaf]], distance[points[leaf]], np.inf).argmin(1)))
            last = tree.follow[nodes] < 0
            single.append((tree.point[nodes[last]], best[last]))
            nodes = np.concatenate([tree.follow[nodes[~last]], tree.entry[points[~leaf]]])
            may = np.concatenate([may[~last], may[owner[~leaf]]])
        return whole, single

    def totals(self, entries: np.ndarray) -> np.ndarray:
        """Per entry the sum of its vectors, and their number in the last column."""
        total = np.zeros((len(entries), self.weighted.shape[1]))
        whole, single = self.assign(entries)
        for nodes, best in whole:
            np.add.at(total, best, self.sums[nodes])
        for points, best in single:
            np.add.at(total, best, self.weighted[points])
        return total

    def nearest(self, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of each vector of the block."""
        of_node, of_point = np.full(len(self.tree.point), -1), np.full(len(self.points), -1)
        whole, single = self.assign(entries)
        for nodes, best in whole:
            of_node[nodes] = best
        self.tree.spread(of_node, of_point)
        for points, best in single:
            of_point[points] = best
        return of_point[self.spot]


class Codebook:
    """Entries of one part; equal entries are compared once, the first stands for them."""

    def __init__(self, entries: np.ndarray):
        _, first = np.unique(entries, axis=0, return_index=True)
        self.number = np.sort(first)
        self.entries = covertree.exact(entries[self.number])


def trees(rows: DataFrame, parts: int = PARTS, block: int = covertree.BLOCK) -> DataFrame:
    """One row per block of `rows` (vec_id, label, v): vec_id and label as arrays, and the pickled parts."""
    def build(batches):
        for batch in batches:
            for some in covertree.blocks(batch, block):
                made = [Part(values) for values in np.split(covertree.rows_of(some.column(2)), parts, 1)]
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([pickle.dumps(made)], pa.binary())], names=["ids", "labels", "parts"])

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(kinds["vec_id"])), T.StructField("labels", T.ArrayType(kinds["label"])),
        T.StructField("parts", T.BinaryType()),
    ])
    return save(rows.select("vec_id", "label", "v").mapInArrow(build, schema), "code-trees")


def improved(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry of `books` (part, entry, component) moves to the floor of its vectors' mean."""
    parts, size, width = books.shape
    used = [Codebook(book) for book in books]

    def count(batches):
        total = np.zeros((parts, size, width + 1))
        for batch in batches:
            for blob in batch.column(0):
                for i, part in enumerate(pickle.loads(blob.as_py())):
                    total[i, used[i].number] += part.totals(used[i].entries)
        part, entry = np.nonzero(total[:, :, -1])
        sums = total[part, entry].astype(np.int64)
        columns = [pa.array(part), pa.array(entry), *(pa.array(c) for c in sums.T.copy())]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "entry", *(f"s{i}" for i in range(width)), "n"]
    found = table.select("parts").mapInArrow(count, ", ".join(f"{n} long" for n in names))
    sums = found.groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names[2:])).toArrow()
    moved = books.copy()
    columns = [sums.column(n).to_numpy() for n in names]
    if len(columns[0]):
        moved[columns[0], columns[1]] = np.floor_divide(np.stack(columns[2:-1], 1), columns[-1][:, None])
    return moved


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the first rows by vec_id, null last, then by components; at most `entries` rows."""
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    found = [row["v"] for row in rows.orderBy(*order).limit(entries).select("v").collect()]
    return np.stack(np.split(np.array(found, np.int64), parts, 1))


def coded(embeddings: DataFrame, block: int = covertree.BLOCK) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, codes, error) per kept row, codebooks). `codes` has a byte per part.

    Rows are dropped as `covertree.kept` says; repeated rows and null ids are coded each. Vectors are
    bounded: components beyond some thousands can't be compared exactly and are an error. With
    fewer rows than entries, the codebooks have as many entries as there are rows. The number of
    components must be a multiple of the number of parts.
    """
    rows = save(covertree.kept(embeddings, SCALE), "vectors")
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, codes binary, error long"
    some = rows.select(F.size("v")).first()
    if some is None:
        return rows.sparkSession.createDataFrame([], schema), np.zeros((PARTS, 0, 0), np.int64)
    if some[0] % PARTS:
        raise ValueError(f"{some[0]} components can't be cut into {PARTS} equal parts")
    table = trees(rows, PARTS, block)
    books = first_books(rows, PARTS, ENTRIES)
    for _ in range(ROUNDS):
        books = improved(table, books)
    used = [Codebook(book) for book in books]

    def code(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parts = pickle.loads(batch.column(2)[i].as_py())
                codes, error = [], 0
                for part, book in zip(parts, used):
                    best = part.nearest(book.entries)
                    error = error + ((part.points[part.spot] - book.entries[best]) ** 2).sum(1).astype(np.int64)
                    codes.append(book.number[best].astype(np.uint8))
                data = np.stack(codes, 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i].values, batch.column(1)[i].values,
                    pa.array([row.tobytes() for row in data], pa.binary()), pa.array(error),
                ], names=["vec_id", "label", "codes", "error"])

    return table.mapInArrow(code, schema), books


def digest(embeddings: DataFrame, block: int = covertree.BLOCK) -> DataFrame:
    """Per kept row: vec_id, code, error, the error of its label, and the checksum of the codebooks."""
    rows, books = coded(embeddings, block)
    rows = save(rows, "codes")
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    checksum = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.join(labels, rows["label"].eqNullSafe(labels["of"])).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(checksum).alias("codebooks_sha256")
    )
