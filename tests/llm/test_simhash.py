"""SimHash near-duplicates against all pairs in plain Python."""

from __future__ import annotations

import itertools
import random
import re

import pytest
import xxhash

from playlens.llm import simhash
from tests.llm import frames

SCHEMA = "doc_id long, text string"


def plain(text: str | None) -> int:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    found = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def classes(prints: list[int], radius: int = 2) -> list[int]:
    """Number of the first member of each one's class."""
    root = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def test_against_all_pairs(spark):
    base = frames.prose(3, 400)
    rows = [(i, frames.changed(base, i, 1 + i % 3)) for i in range(60)]
    rows += [(100 + i, frames.prose(100 + i, 3 + i)) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "One two"), (204, "one  TWO"), (205, "ÀÉ\x85 x\x1cy A")]
    got = {r["doc_id"]: r for r in simhash.digest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    prints = [plain(t) for _, t in rows]
    assert [got[i]["fingerprint"] for i, _ in rows] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i, _ in rows] == [rows[r][0] for r in classes(prints)]
    assert len({r["component_id"] for r in got.values()}) < len(set(prints)), "some different fingerprints are linked"
    assert got[200]["fingerprint"] == "0" * 16 and got[202]["component_id"] == 200


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_of_planted_fingerprints(spark, radius):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(15)} | {0, 1, 1 << 63, (1 << 64) - 1, 3, 7, 0x8000000000000003}
    for _ in range(40):
        prints.add(rng.choice(sorted(prints)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    rows = simhash.links(spark.createDataFrame([(p,) for p in signed], "f long"), radius).collect()
    root = {p: p for p in signed}
    for a, b in rows:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= radius
        low, high = sorted((root[a], root[b]))
        root = {p: low if r == high else r for p, r in root.items()}
    unsigned = [p & (2**64 - 1) for p in signed]
    assert [root[p] for p in signed] == [signed[r] for r in classes(unsigned, radius)]


def test_groups_have_a_bound(spark):
    """A ball full of fingerprints: a group holds at most 65, and a star per group leaves it."""
    centre = 0x0123456789ABCDEF
    ball = [centre ^ v for v in (p & (2**64 - 1) for p in simhash.variants(2))]
    signed = [p - (1 << 64) if p >> 63 else p for p in ball]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "f long"))
    assert found.count() <= 64 * len(ball)


def test_very_long_text():
    text = frames.prose(5, 200_000)
    assert simhash.simhash(text) == plain(text)


def test_odd_rows(spark):
    docs = frames.documents(spark)
    rows = simhash.digest(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in frames.texts())
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert simhash.digest(frames.no_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(docs.selectExpr("doc_id AS f"), 5)


def test_null_ids_alone(spark):
    rows = simhash.digest(spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], SCHEMA)).collect()
    assert [r["component_id"] for r in rows] == [None, None] and len({r["fingerprint"] for r in rows}) == 1
