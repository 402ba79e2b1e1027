"""Packing, language model and pipeline."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from playlens.llm import jaccard, lines, lm, mixing, packing, quality
from playlens.llm.common import tokenizer_path
from tests.conftest import DATA
from tests.llm import frames


def test_plan_places_every_piece_once():
    rng = random.Random(1)
    for counts in ({}, {1024: 3}, {1: 5000}, {513: 7, 512: 3}, dict(Counter(rng.choices(range(1, 1025), k=20000))), {300: 10**9, 700: 10**9}):
        runs = packing.plan(counts)
        placed = Counter()
        for run in runs:
            assert 0 < sum(run.lengths) <= 1024 and run.count > 0
            for length in run.lengths:
                placed[length] += run.count
        assert placed == Counter({k: n for k, n in counts.items() if n})
        bound = -(-sum(k * n for k, n in counts.items()) // 1024)
        if len(counts) > 10:
            assert sum(run.count for run in runs) <= bound * 1.01 + 2
    assert sum(run.count for run in packing.plan({300: 10**9, 700: 10**9})) == 10**9


def test_groups_have_equal_cardinality_and_round_up():
    groups = packing.linear_groups({900: 5, 800: 3, 700: 4}, 3)
    assert [sum(n for _, n in g) for g in groups] == [4, 4, 4]
    assert [g[0][0] for g in groups] == [900, 900, 700] and all(g[0][0] >= length for g in groups for length, _ in g)


def test_configurations_solve_the_program():
    found = packing.configurations([600, 400, 340], [100, 100, 90], 1024)
    assert sum(n for n, _ in found) <= 130 and all(sum([600, 400, 340][j] for j in items) <= 1024 for _, items in found)
    assert sum(n for n, items in found if sorted(items) == [0, 1]) == 100


def check_sequences(rows, expected: dict):
    """Gapless sequences of at most 1024 ids, and pieces that add up to each document."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[str(r["doc_id"])].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert {k: sorted(v) for k, v in documents.items()} == expected
    return len(sequences)


def expected_pieces(rows: list[tuple]) -> dict:
    encode = Tokenizer.from_file(tokenizer_path()).encode
    result = defaultdict(list)
    for i, text in rows:
        ids = encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        starts = [0, *range(first, len(ids), 1024)]
        for number, start in enumerate(starts):
            part = ids[start:starts[number + 1]] if number + 1 < len(starts) else ids[start:]
            result[str(i)].append((number, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return {k: sorted(v) for k, v in result.items()}


def test_pack(spark):
    rows = packing.pack(frames.documents(spark)).collect()
    n = check_sequences(rows, expected_pieces(frames.texts()))
    assert n <= sum(r["length"] for r in rows) // 1024 + 2


# Language model

def tiny_model(states=3, classes=5):
    rng = np.random.default_rng(2)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    return lm.Model(norm(rng.random(states), 0), norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def all_paths(model, seq):
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        yield path, p


def test_forward_is_the_sum_over_all_paths():
    model = tiny_model()
    seqs = [np.array(s, np.int32) for s in ([0], [1, 2, 3, 0], [4, 4, 0], [2, 1, 0, 3, 4, 0])]
    expected = [math.log10(sum(p for _, p in all_paths(model, s))) for s in seqs]
    assert np.allclose(lm.log_likelihoods(model, seqs), expected)


def test_expected_counts_are_those_of_all_paths():
    model = tiny_model()
    seqs = [np.array(s, np.int32) for s in ([1, 2, 3, 0], [4, 0])]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for seq in seqs:
        paths = list(all_paths(model, seq))
        total = sum(p for _, p in paths)
        for path, p in paths:
            start[path[0]] += p / total
            for t, s in enumerate(path):
                emit[seq[t], s] += p / total
                if t:
                    move[path[t - 1], s] += p / total
    got = lm.expected(model, seqs)
    assert np.allclose(got[0], start) and np.allclose(got[1], move) and np.allclose(got[2], emit)
    assert np.isclose(got[3] / math.log(10), lm.log_likelihoods(model, seqs).sum())


def test_segments_count_like_whole_texts():
    """Cut texts give the counts of whole ones: each token and move is counted once, and the context carries the states."""
    model = tiny_model()
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 7, 64, 200, 1000, 64, 65)]
    whole = lm.expected(model, seqs, length=2000)
    cut = lm.expected(model, seqs, length=64, context=16)
    assert np.isclose(whole[3] / math.log(10), lm.log_likelihoods(model, seqs).sum())
    assert np.allclose(cut[2].sum(), sum(map(len, seqs))) and np.allclose(cut[1].sum(), sum(len(s) - 1 for s in seqs))
    assert np.allclose(cut[0], whole[0], atol=1e-6)
    for a, b in zip(cut[1:3], whole[1:3]):
        assert np.allclose(a, b, rtol=1e-4)
    alone = sum(lm.expected(model, [s], length=2000)[2] for s in seqs)
    assert np.allclose(alone, whole[2])


def test_very_long_texts_keep_their_probability():
    model = tiny_model()
    seq = np.random.default_rng(0).integers(0, 5, 100_000).astype(np.int32)
    value = lm.log_likelihoods(model, [seq, seq[:10]])
    assert np.isfinite(value).all() and value[0] < 1000 * value[1]


def test_scores(spark):
    rng = random.Random(8)
    tongues = [[f"{a}{i}" for i in range(300)] for a in "xyz"]
    rows = [(i, " ".join(rng.choices(tongues[i % 3], k=rng.randint(20, 200))).upper()) for i in range(300)] + [(None, "X1 y2"), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm.digest(docs).collect()}
    words = {i: (t or "").lower().split() + [""] for i, t in rows}
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    c = Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9)
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
    held = [r for r in got.values() if r["held_out"]]
    gain = (sum(r["score"] for r in held) - sum(r["base_score"] for r in held)) / sum(r["n_tokens"] for r in held)
    assert gain > 0.25, "the states tell the tongues apart"


def test_every_pass_sees_all_training_texts(spark, monkeypatch):
    rng = random.Random(9)
    tongues = [[f"{a}{i}" for i in range(100)] for a in "xyz"]
    rows = [(i, " ".join(rng.choices(tongues[i % 3], k=rng.randint(20, 60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    passes, one_pass = [], lm.trained

    def watched(texts, *rest):
        result = one_pass(texts, *rest)
        passes.append((texts.count(), result[1]))
        return result

    monkeypatch.setattr(lm, "trained", watched)
    got = {r["doc_id"]: r["score"] for r in lm.digest(docs.repartition(2)).collect()}
    assert {n for n, _ in passes} == {sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows)}
    gains = [(b - a) / abs(b) for (_, a), (_, b) in itertools.pairwise(passes)]
    assert len(gains) > 1 and min(gains[:-1]) > lm.GAIN >= gains[-1], "ended by the likelihood"
    again = {r["doc_id"]: r["score"] for r in lm.digest(docs.repartition(5)).collect()}
    assert all(math.isclose(got[i], again[i], rel_tol=1e-6) for i in got), "another partitioning gives the same scores"


def test_probabilities_within_a_class_add_up(spark):
    """Within each hashed class the words that training saw and an unknown one share the whole."""
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(12))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm.word_counts(docs)
    v = lm.vocabulary(counts, known=12, own=6)
    assert v.own <= 6 and len(v.words) <= 12 and v.total == 40 * 13 and v.distinct == 24
    known = [(r["word"], r["c"]) for r in counts.where("word <> ''").collect()]
    for k in range(lm.HASHED):
        inside = [c for w, c in known if v.hashed_class(w.encode()) == 1 + v.own + k and w not in v.words[: v.own]]
        shares = [(c + 0.5) / 10 ** v.hashed_log()[k] for c in [*inside, 0]]  # the last: any unknown word
        assert math.isclose(sum(shares), 1)


# Pipeline

def acceptable(text: str) -> bool:
    n, chars, symbols, lines, duplicates, repeats, stutters = quality.measure(text)
    return (
        n >= 10 and repeats <= 0.2 * n and symbols <= 0.1 * n and duplicates <= 0.5 * lines and 2 * n <= chars <= 15 * n
        and stutters <= 0.2 * n
    )


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    kept = quality.kept(docs)
    good = {r["doc_id"] for r in kept.collect()}
    assert good == {r["doc_id"] for r in docs.collect() if acceptable(r["text"])}
    clean = {r["doc_id"]: r["text"] for r in lines.cleaned(kept).collect()}
    assert set(clean) <= good
    single = jaccard.one_of_each(spark.createDataFrame(list(clean.items()), "doc_id long, text string"))
    sets = {r["doc_id"]: frozenset(zip(*(r["text"].encode().split()[i:] for i in range(5)))) for r in single.collect()}
    for a, b in itertools.combinations([s for s in sets.values() if s], 2):
        assert min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or len(a & b) / len(a | b) < 0.8
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    copies = Counter()
    texts = {}
    mixed = mixing.mixed(jaccard.one_of_each(lines.cleaned(quality.kept(docs)))).collect()
    for r in mixed:
        copies[r["doc_id"]] += 1
        texts[r["doc_id"]] = r["text"]
    once = expected_pieces(list(texts.items()))
    want = {k: sorted(v * copies[int(k)]) for k, v in once.items()}
    check_sequences(rows, want)
