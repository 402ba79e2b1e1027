"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Equal sets are one class of copies, and only
one text per class goes on. Bands of MinHash values bring candidates together; a pair is
compared a few values at a time and dropped as soon as the posterior probability that its
similarity reaches the threshold falls below a tolerance. What survives is verified on
the exact sets.

No step writes a pair, neither as a row nor in a list. A bucket of any size is cut into blocks, bounded by rows
and by shingles, and a task compares two blocks. A first pass on MinHash values alone tells which texts
have any candidate in which task. Only those texts are shingled again, once, and dealt to those
tasks, where the same pruning is repeated and what survives is verified at once. Links
leave as counts per text and as the few edges that hold a block's components together.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.components import components
from playlens.llm.common import fresh, release, save, spread, text_hash

SHINGLE = 5
THRESHOLD = 0.8
#: Bands of ROWS values each. A pair at the threshold shares no band with probability 3e-6.
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
#: A pair is dropped when its chance of reaching the threshold is below TOLERANCE.
TOLERANCE = 1e-6
STEP = 16
#: Texts and shingles of a block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
_RNG = np.random.default_rng(20240501)  # fixed seed: all executors use the same functions
_FACTORS = _RNG.integers(1, 2**63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 2**63, VALUES, np.uint64)
_WEIGHTS = _RNG.integers(1, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Word -> 64-bit hash, for one batch of texts."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, memory: dict | None = None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of all words if there are fewer, of none if none."""
    memory = _Words() if memory is None else memory
    words = text.encode("utf-8", "surrogatepass").split()
    hashes = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    if not len(words):
        return hashes
    n = max(1, len(words) - SHINGLE + 1)
    total = np.full(n, len(words) if len(words) < SHINGLE else 0, np.uint64)
    for i, weight in enumerate(_WEIGHTS[: len(words)]):
        total += _mixed(hashes[i:i + n] + weight) * weight
    return np.unique(_mixed(total))


def signature(found: np.ndarray) -> bytes:
    """VALUES MinHash values of 16 bits."""
    least = np.full(VALUES, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        part = found[at:at + 4096]
        for i in range(VALUES):
            least[i] = min(least[i], (part * _FACTORS[i] + _TERMS[i]).min())
    return (_mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


@functools.lru_cache(maxsize=None)
def fewest_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The least number of equal values among `compared` with which a pair goes on.

    With a flat prior the similarity given m matches is Beta(m+1, compared-m+1); its mass
    above the threshold is the posterior probability of reaching it. The mass equals the
    probability that a Binomial(compared+1, threshold) is at most m.
    """
    n = compared + 1
    mass = 0.0
    for m in range(n):
        mass += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if mass >= tolerance:
            return m
    return n


def _profile(text: Column) -> Column:
    """struct(key, n, bands, sig): the class of equal sets, their size, band keys, MinHash values."""
    @F.arrow_udf("key binary, n long, sig binary")
    def profiles(texts: pa.Array) -> pa.Array:
        memory = _Words()
        keys, sizes, sigs = [], [], []
        for value in texts:
            found = shingles(value.as_py() or "", memory)
            if len(memory) > 200_000:
                memory.clear()
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            sigs.append(signature(found) if len(found) else b"")
        arrays = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())]
        return pa.StructArray.from_arrays(arrays, names=["key", "n", "sig"])

    return profiles(text)


def _bands(sig: Column) -> Column:
    """array<struct(band, value)> of a signature."""
    width = 2 * ROWS
    return F.array(*(
        F.struct(F.lit(i).alias("band"), F.substring(sig, 1 + i * width, width).alias("value")) for i in range(BANDS)
    ))


def _dealt(rows: DataFrame, blocks: Column, member: Column) -> DataFrame:
    """Each row once per pair of blocks that its block takes part in.

    A bucket has `blocks` blocks. Column task is struct(i, j) with i <= j, side is 0 where
    the row belongs to block i and 1 where it belongs to block j.
    """
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(
        F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), (own > other).cast("int").alias("side")
    ))
    return rows.withColumn("t", F.explode(tasks)).select(
        *rows.columns, F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.side").alias("side")
    )


def _groups(batches, key_columns: int):
    """The rows of each task, as one RecordBatch; they come sorted by the first `key_columns` columns."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for i in range(key_columns):
            column = batch.column(i)
            differs = pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1))
            change[1:] |= differs.to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)
        rest = batch.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


#: What names a task: the bucket, and the two blocks of it.
TASK = ("band", "value", "i", "j")


def candidates(sigs: DataFrame) -> DataFrame:
    """(band, value, i, j, side, key): the texts that pruning leaves a partner, per task.

    `sigs` has (key, n, sig). A pair counts in the first band that it shares only.
    """
    bands = sigs.select("key", "n", F.explode(_bands(F.col("sig"))).alias("b")).select("b.band", "b.value", "key", "n")
    rows_, shingles_ = F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)
    full = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1").select(
        "band", "value", F.greatest(rows_, F.least(shingles_, F.col("m"))).cast("int").alias("blocks")
    )
    rows = bands.drop("n").join(full, ["band", "value"]).join(sigs.select("key", "sig"), "key")
    dealt = _dealt(rows, F.col("blocks"), F.col("key")).select(*TASK, "side", "key", "sig")
    dealt = spread(dealt, *map(F.col, TASK)).sortWithinPartitions(*TASK)
    schema = "band int, value binary, i int, j int, side int, key binary"

    def prune(batches):
        for group in _groups(batches, len(TASK)):
            if group.num_rows < 2:
                continue
            some = np.zeros(group.num_rows, bool)
            for a, found in _pairs(group):
                some[a] = True
                some[found] = True
            at = pa.array(np.flatnonzero(some))
            if len(at):
                yield group.select([*TASK, "side", "key"]).take(at)

    return dealt.mapInArrow(prune, schema)


def _pairs(group: pa.RecordBatch):
    """(a, partners) of a task: positions of the texts that pruning leaves as candidates, each pair once."""
    band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
    values = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(group.num_rows, VALUES)
    side = group.column("side").to_numpy(zero_copy_only=False)
    needed = [fewest_matches(n) for n in range(STEP, VALUES + 1, STEP)]
    right = np.flatnonzero(side == 1)
    for a in range(group.num_rows):
        if i != j and side[a]:
            continue
        found = _likely(values, a, right if i != j else np.arange(a + 1, group.num_rows), band, needed)
        if len(found):
            yield a, found


def _likely(values: np.ndarray, a: int, b: np.ndarray, band: int, needed: list[int]) -> np.ndarray:
    """Of texts `b`, those that share no earlier band with `a` and survive each comparison."""
    if band and len(b):
        before = (values[b, : band * ROWS] == values[a, : band * ROWS]).reshape(len(b), band, ROWS)
        b = b[~before.all(2).any(1)]
    matches = np.zeros(len(b), int)
    for step, least in enumerate(needed):
        if not len(b):
            break
        at = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (values[b, at] == values[a, at]).sum(1)
        stays = matches >= least
        b, matches = b[stays], matches[stays]
    return b


def hashed(texts: DataFrame) -> DataFrame:
    """(key, copies, sig, found): the sorted hashes of the shingles, eight bytes each, of `texts` (key, copies, sig, text)."""
    @F.arrow_udf("binary")
    def arrays(column: pa.Array) -> pa.Array:
        memory = _Words()
        return pa.array([shingles(t.as_py() or "", memory).astype("<u8").tobytes() for t in column], pa.binary())

    return texts.select("key", "copies", "sig", arrays(F.col("text")).alias("found"))


def verified(found: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, links, copies): exact links per task.

    `found` are `candidates`, `sets` their `hashed` texts. A row with b null adds `links` other texts and
    `copies` documents to text a; a row with b is an edge of the task's spanning forest.
    """
    rows = found.join(sets, "key").select(*TASK, "side", "key", "copies", "sig", "found")
    rows = spread(rows, *map(F.col, TASK)).sortWithinPartitions(*TASK)

    def verify(batches):
        for group in _groups(batches, len(TASK)):
            names = group.column("key").to_pylist()
            copies = group.column("copies").to_pylist()
            blobs = group.column("found").to_pylist()
            sizes = np.array([len(blob) // 8 for blob in blobs])
            edges = np.cumsum(np.r_[0, sizes])
            ranks = np.unique(np.frombuffer(b"".join(blobs), "<u8"), return_inverse=True)[1].astype(np.int32)
            del blobs
            inside = np.zeros(int(ranks.max()) + 1, bool)
            root = list(range(len(names)))
            links, linked, forest = [0] * len(names), [0] * len(names), []
            for a, b in _pairs(group):
                own = ranks[edges[a]:edges[a + 1]]
                inside[own] = True
                # The smaller set must be `threshold` of the larger one at least.
                b = b[np.minimum(sizes[b], sizes[a]) >= threshold * np.maximum(sizes[b], sizes[a]) - 1e-9]
                common = np.array([np.count_nonzero(inside[ranks[edges[x]:edges[x + 1]]]) for x in b.tolist()], np.int64)
                inside[own] = False
                for x in b[common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9].tolist():
                    for one, other in ((a, x), (x, a)):
                        links[one] += 1
                        linked[one] += copies[other]
                    ra, rx = _root(root, a), _root(root, x)
                    if ra != rx:
                        root[rx] = ra
                        forest.append((names[a], names[x]))
            found = [(names[i], None, links[i], linked[i]) for i in range(len(names)) if links[i]]
            found += [(a, b, 0, 0) for a, b in forest]
            if found:
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["a", "b", "links", "copies"]
                )

    return rows.mapInArrow(verify, "a binary, b binary, links long, copies long")


def _root(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def linked(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, key, rank, copies, n_links, component) for each distinct document.

    Documents are told apart by doc_id and text; rows that agree in both are one, counted by
    `rows`. `copies` counts the rows whose sets of shingles are equal, `n_links` the other
    rows whose similarity is `threshold` or more, copies included. `component` is the class of
    all that links connect, and `first` its first document by doc_id, null last. A text
    without a word has no shingle and no link; each is a class of its own. An empty table gives no row,
    and a text of any length is compared whole. The bands are laid out for THRESHOLD: a
    lower `threshold` would lose pairs and is refused.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the bands find pairs of similarity {THRESHOLD} or more")
    rows = docs.select("doc_id", text_hash().alias("text_key"), _profile(F.col("text")).alias("p"))
    rows = save(rows.select("doc_id", "text_key", "p.*"), "shingled")
    alone = F.concat(F.lit("-").cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.col("text_key").cast("binary"))
    docs_once = rows.groupBy("doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("key").alias("key")
    ).withColumn("key", F.when(F.col("n") > 0, F.col("key")).otherwise(alone))
    docs_once = save(docs_once, "documents-once")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    classes = save(docs_once.groupBy("key").agg(F.sum("rows").alias("copies"), F.min(order).alias("first")), "classes")
    sigs = save(rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("sig").alias("sig")), "signatures")
    release(rows)
    found = save(candidates(sigs), "candidates")
    involved = found.select("key").distinct().join(classes, "key").join(sigs, "key").select(
        "key", "copies", "sig", F.col("first.doc_id").alias("of"), F.col("first.text_key").alias("of_key")
    )
    texts = docs.select("doc_id", "text", text_hash().alias("text_key")).join(
        involved, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))
    )
    sets = save(hashed(texts).dropDuplicates(["key"]), "shingle-sets")
    links = save(verified(found, sets, threshold), "links-found")
    release(found, sets, sigs)
    degrees = links.where("b IS NULL").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "key")
    groups = components(links.where("b IS NOT NULL").select("a", "b"))
    members = classes.join(groups.withColumnRenamed("node", "key"), "key", "left").join(degrees, "key", "left").select(
        "key", "copies", "first", F.coalesce("component", "key").alias("component"), F.coalesce("others", F.lit(0)).alias("others")
    )
    members = save(members, "members")
    release(classes, links)
    firsts = members.groupBy("component").agg(F.min("first").alias("head"))
    return docs_once.join(members.drop("first").join(firsts, "component"), "key").select(
        "doc_id", "text_key", "rows", "copies", (F.col("copies") - 1 + F.col("others")).alias("n_links"), "component", "head"
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the class's first doc_id), n_links, copies."""
    found = linked(docs)
    return found.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        "doc_id", F.col("head.doc_id").alias("class_id"), "n_links", "copies"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first document of each class, with the columns of `docs`."""
    heads = linked(docs).select(F.col("head.doc_id").alias("h"), F.col("head.text_key").alias("k")).distinct()
    key, of, of_key = (fresh(docs, n) for n in ("text_key", "head_id", "head_key"))
    left = docs.withColumn(key, text_hash())
    heads = heads.select(F.col("h").alias(of), F.col("k").alias(of_key))
    both = left.join(heads, left["doc_id"].eqNullSafe(heads[of]) & (left[key] == heads[of_key]), "left_semi")
    return both.dropDuplicates(["doc_id", key]).select(*(F.col(f"`{c}`") for c in docs.columns))
