"""Jaccard join, components, fingerprints, mixing and URLs against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare
from playlens.llm import fingerprints, jaccard, mixing, urls
from playlens.llm.components import components
from playlens.llm.oracles import oracles
from tests.llm import frames


def shingles(text: str | None) -> set:
    words = (text or "").encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(5))))


def likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def joined(rows: dict) -> tuple[dict, dict]:
    """Links and class of each document."""
    sets = {i: shingles(t) for i, t in rows.items()}
    links, root = dict.fromkeys(rows, 0), {i: i for i in rows}
    for a, b in itertools.combinations(sorted(rows), 2):
        if sets[a] and sets[b] and likeness(sets[a], sets[b]) >= 0.8:
            links[a] += 1
            links[b] += 1
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return links, root


def near_copies(n: int) -> dict[int, str | None]:
    base = frames.prose(7, 150)
    rows: dict[int, str | None] = {i: frames.changed(base, i, i % 7) for i in range(n)}
    rows |= {1000 + i: frames.prose(1000 + i, 120) for i in range(30)}
    rows |= {2000: "", 2001: None, 2002: " ", 2003: "one two", 2004: "one two", 2005: "one  two\n"}
    return rows


@pytest.mark.parametrize("block, shingles_", [(16, 1 << 19), (256, 1000)])
def test_join_against_all_pairs(spark, monkeypatch, block, shingles_):
    rows = near_copies(80)
    monkeypatch.setattr(jaccard, "BLOCK", block)  # many blocks per bucket
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles_)
    got = jaccard.digest(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)).collect()
    links, root = joined(rows)
    assert {r["doc_id"]: r["n_links"] for r in got} == links
    assert {r["doc_id"]: r["class_id"] for r in got} == root


def test_no_row_per_pair(spark):
    """A bucket of m texts is dealt out m * blocks times, not m * m times."""
    rows = spark.range(5000).selectExpr("cast(id as string) AS key", f"{-(-5000 // jaccard.BLOCK)} AS blocks")
    dealt = jaccard._dealt(rows, rows["blocks"], rows["key"])
    assert dealt.count() == 5000 * -(-5000 // jaccard.BLOCK)
    tasks = dealt.groupBy("i", "j").count()
    assert tasks.count() == 20 * 21 // 2
    assert tasks.agg({"count": "max"}).first()[0] < 4 * jaccard.BLOCK


def test_candidates_are_no_pairs(spark):
    """A cluster of near copies: a row per text and task, not a list of its pairs; long texts get blocks of their own."""
    base = frames.prose(7, 400)
    rows = [(i, frames.changed(base, i, 3)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(jaccard._profile(F.col("text")).alias("p")).select("p.*")
    found = jaccard.candidates(docs)
    assert "array" not in dict(found.dtypes).values()
    tasks = found.groupBy("band", "value", "i", "j").count().collect()
    assert found.count() <= 120 * jaccard.BANDS and max(r["count"] for r in tasks) <= 120


def test_lower_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        jaccard.linked(frames.documents(spark), 0.7)


def test_pruning_is_the_beta_posterior():
    for compared in (16, 48, 96):
        least = jaccard.fewest_matches(compared)
        grid = np.linspace(0, 1, 200001)[1:-1]
        for matches, expected in ((least, True), (least - 1, False)):
            if matches < 0:
                continue
            density = np.exp(matches * np.log(grid) + (compared - matches) * np.log(1 - grid) - (compared * np.log(0.5)))
            tail = density[grid >= jaccard.THRESHOLD].sum() / density.sum()
            assert (tail >= jaccard.TOLERANCE) == expected


def test_repeated_rows_and_ids(spark):
    docs = frames.documents(spark)
    got = jaccard.digest(docs)
    pairs = sorted((str(r["doc_id"]), r["copies"]) for r in got.where("doc_id = 17 OR doc_id = 1").collect())
    assert pairs == [("1", 4), ("17", 1), ("17", 4), ("17", 4)]
    kept = jaccard.one_of_each(docs).select("doc_id", "text").collect()
    assert len([r for r in kept if r["text"] == frames.prose(1, 200)]) == 1
    assert {r["doc_id"] for r in kept} >= {1, 5, 7, 8, 9, 10, 11, None, -5} and 2 not in {r["doc_id"] for r in kept}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)],
    [(9, 5), (5, 9), (7, 7), (8, 3), (3, 2), (100, 101), (101, 99)], [(None, 4), (4, 5)],
])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges if None not in e for n in e}
    for a, b in ((a, b) for e in edges for a, b in [e] if None not in e):
        low, high = sorted((root[a], root[b]))
        root = {n: low if r == high else r for n, r in root.items()}
    assert got == root


# Fingerprints

def test_fingerprints(spark):
    base = frames.prose(1, 400)
    rows = {i: frames.prose(50 + i, 20 + 40 * i) for i in range(20)} | {30: base, 31: base, 32: frames.changed(base, 1, 6), 40: None, 41: "", 42: "one"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in fingerprints.digest(docs).collect()}
    ids = sorted(rows, reverse=True)
    errors = []
    for i, after in zip(ids, ids[1:] + ids[:1]):
        text, follow = rows[i] or "", rows[after] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i]["near_edited"] - likeness(shingles(text), shingles(edited)), got[i]["near_next"] - likeness(shingles(text), shingles(follow))]
    assert got[30]["fingerprint"] == got[31]["fingerprint"] != got[32]["fingerprint"]
    assert got[31]["near_next"] == 1.0 and got[41]["near_next"] == 1.0 and got[42]["near_next"] == 0.0
    assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.02


def test_one_document_is_its_own_next(spark):
    row = fingerprints.digest(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0
    assert row["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()


# Mixing

def shared_out(sizes: dict, cap: float = 2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in stopped]
        level = (total - sum(cap * sizes[s] for s in stopped)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= over


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, frames.prose(i, rng.choice([3, 30, 60, 200])), rng.choice(["a", "a", "a", "b", "Z", "é", None, ""])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.digest(docs).collect()
    again = mixing.digest(docs.repartition(2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {i: s for i, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    goals = shared_out(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goals[s]) < 1e-6
        assert abs(taken[s] - goals[s]) <= 110, "within half of a document"
    # The rows of the mix are the copies that the digest counts.
    words = mixing.mixed(docs).select(mixing.size(docs["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    assert words == sum(taken.values())


def test_repeated_rows_are_taken_up_to_the_target(spark):
    """A source that is mostly one row, many times: its target is met within half a row."""
    rows = [(1, "w " * 60, "a")] * 500 + [(10 + i, frames.prose(i, 40), "a") for i in range(98)]
    rows += [(2000 + i, frames.prose(i, 100), "b") for i in range(90)] + [(3000 + i, frames.prose(i, 90), "c") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for name in "abc":
        some = [r for r in got if r["source"] == name]
        assert abs(sum(r["size"] * r["copies"] for r in some) - some[0]["target"]) <= 50 + 1e-6
    equal = {r["copies"] for r in got if r["doc_id"] == 1}
    assert len(equal) == 2 and max(equal) - min(equal) == 1, "the sample ends among the equal rows"
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    problems, n = compare(mixing.digest(docs), con, oracles()["op6_pareto_mixing"])
    assert not problems and n == len(rows)
    words = mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.size(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in words} == {
        name: sum(r["size"] * r["copies"] for r in got if r["source"] == name) for name in "abc"
    }


def test_one_document_in_two_sources(spark):
    """Each source takes its own share of a row that is in both."""
    text = "w " * 80
    rows = [(1, text, "a"), (1, text, "b")] + [(10 + i, frames.prose(i, 80), "a") for i in range(40)] + [(100 + i, frames.prose(i, 80), "b") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {(r["source"], r["doc_id"]): r["copies"] for r in mixing.mix(docs).collect()}
    counted = {(r["source"], r["doc_id"]): r["n"] for r in mixing.mixed(docs).groupBy("source", "doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {k: n for k, n in copies.items() if n}


def test_inclusion_probabilities(spark):
    """Over many seeds a document is taken as often as its expected copies say."""
    rows = [(i, "w " * (20 if i % 2 else 80), "s") for i in range(60)] + [(1000 + i, "w " * 100, "t") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seeds = 12
    got = [r["copies"] for seed in range(seeds) for r in mixing.mix(docs, seed).where("source_size = 3000 AND size = 80").collect()]
    rest = [r["copies"] for seed in range(seeds) for r in mixing.mix(docs, seed).where("source_size = 3000 AND size = 20").collect()]
    assert abs(np.mean(got) - min(2, 2 * np.mean(rest))) < 0.25, "fragments weigh half"


# URLs

def test_verdicts(spark):
    rows = {(r["page_id"], r["path"]): r for r in urls.digest(frames.pages(spark)).collect()}
    assert rows[(1, "/es/1")]["rule"] == "example.org/es/" and rows[(1, "/es/1")]["verdict"] == "block"
    assert rows[(2, "/copy")]["verdict"] == "block" and rows[(3, "/x")]["verdict"] == "block", "aliases follow, over two steps"
    assert rows[(13, "/y/")]["verdict"] == "block" and rows[(12, "/x")]["verdict"] == "block", "redirects too"
    assert rows[(7, "/de/9")]["verdict"] == "block" and rows[(8, "/fr/9")]["verdict"] == "allow", "own rules win"
    assert rows[(9, "/z")]["verdict"] == "allow", "an explicit allow in the class keeps the unruled"
    assert rows[(10, "/en/12")]["verdict"] == "block" and rows[(11, "")]["rule"] is None
    assert (rows[(6, "/fr/1")]["host"], rows[(6, "/fr/1")]["rule"]) == ("www.example.com", "com/fr/")
    assert (rows[(4, "")]["host"], rows[(4, "")]["verdict"]) == ("", "allow") == (rows[(5, "")]["host"], rows[(5, "")]["verdict"])


def test_redirects_to_pages_never_crawled(spark):
    pages = spark.createDataFrame([(1, "http://a.net/1", None), (2, "http://b.net/2", None)], "page_id long, url string, html string")
    edges = spark.createDataFrame([("http://a.net/1", "http://x.example.org/es/5"), ("http://b.net/2", None)], "source string, target string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, edges).collect()}
    assert got == {1: "block", 2: "allow"}


@pytest.mark.parametrize("base, link, expected", [
    ("http://A.net/x/y?q#f", "?page=2", "http://a.net/x/y?page=2"), ("http://a.net/x/y", "../c", "http://a.net/c"),
    ("http://a.net/x/y", "./c/../d?e=/../f", "http://a.net/x/d?e=/../f"), ("http://a.net/x/y/", "..", "http://a.net/x/"),
    ("http://a.net/x", "../../../c", "http://a.net/c"), ("http://a.net", "c", "http://a.net/c"), ("https://a.net/x", "//b.net/z", "https://b.net/z"),
    ("http://a.net/x", "/z/./w", "http://a.net/z/w"), ("http://a.net/x", "HTTP://b.net/z", "HTTP://b.net/z"), ("http://a.net/x", "mailto:me", None),
    ("http://a.net/x/y", "#top", "http://a.net/x/y#top"), ("http://a.net/x", "/r?to=http://b.net", "http://a.net/r?to=http://b.net"),
])
def test_links_are_resolved(spark, base, link, expected):
    row = spark.createDataFrame([(base, link)], "b string, l string").select(urls.resolved(F.col("b"), F.col("l")).alias("r")).first()
    assert row["r"] == expected


def test_references_are_decoded(spark):
    for text, expected in {
        "a&amp;b&#38;c&#x26;d&sol;e&#47;": "a&b&c&d/e/", "&#x1F642;&#8364;": "\U0001F642€", "&&amp;amp;&nix;&#0;&#xD800;&#9999999;&amp": "&&amp;&nix;&#0;&#xD800;&#9999999;&amp",
        "": "", "plain": "plain", "a&b=c;d": "a&b=c;d",
    }.items():
        assert spark.createDataFrame([(text,)], "t string").select(urls.decoded(F.col("t")).alias("r")).first()["r"] == expected


LINKED_PAGES = {
    1: ("http://a.example.net/b/1", "<link href='http://x.example.org/es/1' rel='alternate canonical'>", "block"),
    2: ("http://a.example.net/b/2", "<link rel=canonical href='/own'><p><LINK REL = \"Canonical\" HREF=\"http://x.example.org/es/2\" />", "block"),
    3: ("http://x.example.org/es/b/3", "<meta http-equiv='Refresh' content=\"0; URL='../../c/3'\">", "block"),
    4: ("http://x.example.org/c/3/", "<p>target of 3</p>", "allow"),
    5: ("http://a.example.net/b/5", "<!-- <link rel=canonical href='http://x.example.org/es/5'> --><p>x", "allow"),
    6: ("http://a.example.net/b/6", "<script>'<link rel=canonical href=\"http://x.example.org/es/6\">'</script>", "allow"),
    7: ("http://a.example.net/b/7?page=1", "<link rel='canonical' href='?page=2'>", "block"),
    8: ("http://a.example.net/b/7?page=2", "<link rel='canonical' href='http:&#47;&#x2F;x.example.org&sol;es/8'>", "block"),
    9: ("http://a.example.net/b/9", "<link data-rel='canonical' href='http://x.example.org/es/9'><link rel='canonicals' href='http://x.example.org/es/9'>", "allow"),
    10: ("http://a.example.net/b/10", "<meta name=refresh content='0; url=http://x.example.org/es/9'><a rel=canonical href='http://x.example.org/es/9'>", "allow"),
    11: ("http://a.example.net/b/11", "<link rel=canonical href='http://x.example.org/es/11' cut off", "block"),
    12: ("http://a.example.net/b/12", "<link rel='canonical' href='javascript:x'><link rel=canonical href=''><link rel=canonical>", "allow"),
    13: ("http://a.example.net/b/13", "<meta http-equiv=refresh content='5;//x.example.org/es/1'><meta content='1,url = \"http://x.example.org/en/1\"' http-equiv=refresh>", "block"),
}


def test_declared_links(spark):
    pages = spark.createDataFrame([(i, url, page) for i, (url, page, _) in LINKED_PAGES.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.digest(pages).collect()}
    assert got == {i: verdict for i, (_, _, verdict) in LINKED_PAGES.items()}
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    problems, n = compare(urls.digest(pages), con, oracles()["op10_url_filters"])
    assert not problems and n == len(LINKED_PAGES)


def test_plan_of_links_stays_small(spark, monkeypatch):
    """No step repeats the expression of the step before: such a plan took megabytes, all in the driver's memory."""
    plans, save = [], urls.save

    def seen(df, purpose):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(df, purpose)

    monkeypatch.setattr(urls, "save", seen)
    assert urls.digest(frames.pages(spark)).count() == frames.pages(spark).count()
    assert len(plans) == 1 and "regexp_extract_all" in plans[0] and len(plans[0]) < 50_000


def test_references_and_links_of_odd_values(spark):
    rows = [
        ("http://a.net/x/y", "<link rel=canonical href='&#47;&sol;b.net&#x2F;..&sol;c&amp;amp;d&#0;&nix;&'>", ["http://b.net/../c&amp;d&#0;&nix;&"]),
        ("no scheme", "<link rel=canonical href='c/../d'><meta http-equiv=refresh content='0;url=//e'><link rel=canonical href='mailto:x'>", ["/d", "//e"]),
        ("http://a.net/é", "<link rel=canonical href='\t\n'><link rel='canonical' href=' ?q=&#233; '>", ["http://a.net/é?q=é"]),
        (None, "<link rel=canonical href='http://b.net'>", []), ("http://a.net", None, []), ("", "<link rel=canonical href='http://b.net'>", ["http://b.net"]),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "url string, html string")
    got = sorted((r["source"], r["target"]) for r in urls.aliases(pages).collect())
    assert got == sorted((url, target) for url, _, targets in rows for target in targets)


def test_broken_elements_take_linear_time(spark):
    rows = [(1, "http://a.net/1", "<link " * 200_000), (2, "http://a.net/2", "<script " * 150_000), (3, "http://a.net/3", "<link rel=canonical href='" + "../" * 3000 + "x'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    began = time.perf_counter()
    assert urls.digest(pages).count() == 3
    assert time.perf_counter() - began < 60
