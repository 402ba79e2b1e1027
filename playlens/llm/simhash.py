"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within a radius meet at some value between them: one reaches it by changing half of
the radius, the other by changing the rest. So every distinct fingerprint emits all variants
within half of the radius, variants are shuffled, and fingerprints that collide are linked.
A variant's group holds only distinct fingerprints around it, at most 65 at radius 2, whatever
the number of documents; each group hands on a star, not its pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from playlens.llm.common import save
from playlens.llm.components import components

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
#: Shingles hashed at once, so that a very long text takes bounded memory.
CHUNK = 1 << 16
_BYTES = np.uint64(0x0101010101010101)


def hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every run of three words, repeats included; of all words if there are fewer."""
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def set_bits(values: np.ndarray) -> np.ndarray:
    """How many of `values` have each bit, lowest bit first.

    A bit of each byte at a time is added up in all eight bytes at once; 255 values can't
    make a byte overflow.
    """
    padded = np.concatenate([values, np.zeros(-len(values) % 255, np.uint64)]).reshape(-1, 255)
    counts = np.zeros((8, 8), np.int64)  # byte, bit of the byte
    for bit in range(8):
        sums = ((padded >> np.uint64(bit)) & _BYTES).sum(1, dtype=np.uint64)
        counts[:, bit] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return counts.ravel()


def simhash(text: str) -> int:
    """The fingerprint of a text: bits that over half of its shingles' hashes have; 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total, n = np.zeros(BITS, np.int64), 0
    for at in range(0, max(1, len(words) - SHINGLE + 1), CHUNK):
        found = hashes(words[at:at + CHUNK + SHINGLE - 1])
        total += set_bits(found)
        n += len(found)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column) -> Column:
    """The fingerprint as a long that has the same 64 bits; a null text counts as empty."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        values = np.fromiter((simhash(t.as_py() or "") for t in texts), np.uint64, len(texts))
        return pa.array(values.view(np.int64), pa.int64())

    return of(text)


def variants(radius: int, bits: int = BITS) -> list[int]:
    """All patterns of `bits` bits with at most `radius` ones, as signed numbers, none first."""
    found = [sum(1 << b for b in some) for n in range(radius + 1) for some in itertools.combinations(range(bits), n)]
    return [v - (1 << bits) if v >> (bits - 1) else v for v in found]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect just the fingerprints that differ in `radius` bits or fewer.

    `fingerprints` has distinct longs f. A pair within the radius collides in a variant that is
    within the lower half of one and the upper half of the other; there both are tied to
    the least fingerprint of the lower half, from which none in the group is further than the
    radius. Each link is verified; what is returned are enough links to connect all that
    are within the radius, not all pairs. Variants grow with 64 to the power of the upper
    half, so radii above 4 are refused.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the radius is 0 to 4 bits")
    near, far = radius // 2, (radius + 1) // 2
    patterns = F.array(*map(F.lit, variants(far)))
    inner = len(variants(near))
    rows = fingerprints.select("f", F.posexplode(patterns).alias("i", "flip")).select(
        F.col("f").bitwiseXOR(F.col("flip")).alias("v"), "f", *([] if near == far else [(F.col("i") < inner).alias("near")])
    )
    middle = F.col("f") if near == far else F.when(F.col("near"), F.col("f"))
    met = rows.withColumn("a", F.min(middle).over(Window.partitionBy("v"))).select("a", F.col("f").alias("b"))
    met = met.where(F.col("a").isNotNull() & (F.col("a") != F.col("b")))
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def linked(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs`, which needs doc_id and text.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Rows that repeat are
    returned each. component_id is the least doc_id that links reach, null if there are
    null ids only. A text of any length is read whole; an empty table gives no row.
    """
    rows = save(docs.select("doc_id", fingerprint(F.col("text")).alias("f")), "simhashes")
    classes = save(rows.groupBy("f").agg(F.min("doc_id").alias("first")), "fingerprints")
    ties = save(links(classes.select("f"), radius), "ties")
    groups = components(ties).withColumnRenamed("node", "f")
    members = classes.join(groups, "f", "left").select("f", "first", F.coalesce("component", "f").alias("component"))
    members = save(members, "members")
    heads = members.groupBy("component").agg(F.min("first").alias("component_id"))
    found = members.join(heads, "component").select("f", "component_id")
    return rows.join(found, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), BITS // 4, "0")).alias("fingerprint"), "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The fingerprint and the component of every document."""
    return linked(docs)
