"""A hidden Markov language model.

Latent states emit classes of words: frequent words have a class each, all others share a
fixed number of hashed classes, in which a word has its smoothed share of the class's count. So
the parameters have a bound, while word counts follow the corpus and are joined. Training is
Baum-Welch: each pass sums expected counts per partition and adds them up by class.
Scores are exact: scaled forward recursion over the whole text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from playlens.llm.common import save

STATES = 8
#: Words that every executor knows (at most), and those of them with a class of their own.
KNOWN, OWN = 100_000, 16_000
HASHED = 1024
#: Training ends when a pass gains less than this share of the log likelihood.
GAIN = 5e-4
#: Training cuts longer texts into segments of so many tokens, each seen with CONTEXT tokens on either side. The
#: forward and backward values come through the context; only a segment's own tokens and moves are counted.
SEGMENT, CONTEXT = 512, 32
#: Pseudo-counts that tie a state's emissions to the frequencies of the classes.
PRIOR = 200.0
#: Of the recursions within a pass; their sums, and scoring, are double.
REAL = np.float32
FLUSH = 300_000
END = ""
#: A class as it is stored; there are 1 + OWN + HASHED at most.
CLASS = np.dtype("<u2")


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the documents, by the CRC-32 of the id as text; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case; the end token is left to the caller."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all texts of `train`; the empty word is the end token."""
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py() or ""))
            seen[b""] += batch.num_rows
            if len(seen) > FLUSH:
                yield rows(seen)
                seen.clear()
        if seen:
            yield rows(seen)

    def rows(seen):
        words = pa.array(list(seen), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    counted = train.select("text").mapInArrow(count, "word string, c long")
    return save(counted.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


@dataclass
class Vocabulary:
    """What executors need to know about words; its size has a bound."""

    words: list[str]          # known words, most frequent first
    counts: np.ndarray        # their counts
    own: int                  # so many of them have a class of their own
    ends: int                 # count of the end token
    total: int                # tokens in training
    distinct: int             # different tokens in training
    class_counts: np.ndarray  # count per class: end, own words, hashed
    class_words: np.ndarray   # different words per hashed class

    @property
    def classes(self) -> int:
        return 1 + self.own + HASHED

    @property
    def base_log(self) -> float:
        return math.log10(self.total + 0.5 * (self.distinct + 1))

    def hashed_log(self) -> np.ndarray:
        """log10 of what a word's count + 0.5 is divided by within its hashed class."""
        return np.log10(self.class_counts[1 + self.own:] + 0.5 * (self.class_words + 1))

    def hashed_class(self, word: bytes) -> int:
        return 1 + self.own + zlib.crc32(word) % HASHED


def vocabulary(counts: DataFrame, known: int = KNOWN, own: int = OWN) -> Vocabulary:
    """Totals, the known words and the hashed classes of `counts`.

    How rare a known word may be is read from a histogram of counts on a fine logarithmic scale, so
    no task sorts all words. At most `known` words, HASHED classes and some
    thousand steps of the histogram come to the driver.
    """
    words = counts.where(F.col("word") != END)
    step = F.floor(F.log2("c") * 64)
    steps = {row["step"]: row["n"] for row in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, room = None, known
    for at in sorted(steps, reverse=True):
        room -= steps[at]
        if room < 0:
            break
        least = at
    rows = words.where(step >= least).collect() if least is not None else []
    rows = sorted(((row["word"], row["c"]) for row in rows), key=lambda r: (-r[1], r[0]))
    own = min(own, len(rows))
    shared = words
    if own:
        last, c = rows[own - 1]
        shared = words.where((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > last)))
    number = (F.crc32(F.col("word").cast("binary")) % HASHED).cast("int")
    class_counts = np.array([0.0] + [c for _, c in rows[:own]] + [0.0] * HASHED)
    class_words = np.zeros(HASHED)
    for row in shared.groupBy(number.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        class_counts[1 + own + row["k"]] = row["c"]
        class_words[row["k"]] = row["n"]
    totals = counts.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    ends = totals["ends"] or 0
    class_counts[0] = ends
    return Vocabulary(
        [w for w, _ in rows], np.array([c for _, c in rows], float), own, ends, totals["c"] or 0, totals["n"], class_counts, class_words
    )


class _Numbers(dict):
    """Word -> number, -1 for unknown ones."""

    def __missing__(self, word: bytes) -> int:
        return -1


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """The table of texts as classes: one row per row of `docs`.

    Columns: row (a number of its own), doc_id, held_out, n_tokens, n_known, known_log and shared_log
    (sums of log10(count + 0.5) over known words and the end, and over those in hashed classes),
    hashed_log (what the hashed classes divide by), seq (classes, two bytes each), rare (words not known).
    """
    if v.classes > 1 << 8 * CLASS.itemsize:
        raise ValueError(f"{v.classes} classes don't fit {CLASS}")
    log_count, end_log, hashed = np.log10(v.counts + 0.5), math.log10(v.ends + 0.5), v.hashed_log()
    number = _Numbers((word.encode(), i) for i, word in enumerate(v.words))
    of_known = np.array(
        [1 + i if i < v.own else v.hashed_class(w.encode()) for i, w in enumerate(v.words)] + [0], np.int32
    )

    def encode(batches):
        at = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                part = some.column(3)[0].as_py()
                out = []
                for i, text in enumerate(some.column(1)):
                    words = tokens(text.as_py() or "")
                    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                    seq = of_known[ids]
                    missing = np.flatnonzero(ids < 0).tolist()
                    rare = [words[j] for j in missing]
                    seq[missing] = [v.hashed_class(w) for w in rare]
                    logs = log_count[ids[ids >= 0]]
                    out.append((
                        (part << 40) + at, len(words) + 1, len(words) - len(rare) + (v.ends > 0),
                        float(logs.sum()) + end_log, float(log_count[ids[ids >= v.own]].sum()),
                        float(hashed[seq[seq > v.own] - 1 - v.own].sum()), np.append(seq, 0), rare,
                    ))
                    at += 1
                row, n, known, log, shared, divided, seqs, rares = zip(*out)
                edges = np.cumsum([0, *map(len, rares)]).astype(np.int32)
                flat = pa.array([w for ws in rares for w in ws], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([
                    pa.array(row, pa.int64()), some.column(0), some.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(log), pa.array(shared), pa.array(divided),
                    pa.array([s.astype(CLASS).tobytes() for s in seqs], pa.binary()), pa.ListArray.from_arrays(edges, flat),
                ], names=names)

    fields = [
        ("row", T.LongType()), ("doc_id", docs.schema["doc_id"].dataType), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()),
        ("n_known", T.LongType()), ("known_log", T.DoubleType()), ("shared_log", T.DoubleType()), ("hashed_log", T.DoubleType()),
        ("seq", T.BinaryType()), ("rare", T.ArrayType(T.StringType())),
    ]
    names = [name for name, _ in fields]
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])
    given = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.spark_partition_id())
    return save(given.mapInArrow(encode, schema), "encoded")


@dataclass
class Model:
    """start: of a text; inside: where the context of a segment starts within one; move: state to state; emit: class x state."""

    start: np.ndarray
    inside: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, frequency: np.ndarray, states: int = STATES, seed: int = 7) -> "Model":
        """States that last, and emissions that differ by chance, so that texts choose sides."""
        noise = np.exp(np.random.default_rng(seed).normal(size=(len(frequency), states)))
        emit = frequency[:, None] * noise
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        even = np.full(states, 1 / states)
        return cls(even, even, move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def improved(self, start, move, emit, frequency: np.ndarray) -> "Model":
        """The model of greatest posterior given expected counts."""
        states = len(self.start)
        emit = emit + PRIOR * frequency[:, None]
        move = move + 1 / states
        start = start + 1 / states
        inside = emit.sum(0)
        return Model(start / start.sum(), inside / inside.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Rows:
    """Texts and segments of longer ones, longest first, as places in one array of classes."""

    flat: np.ndarray
    start: np.ndarray   # place of the first token
    length: np.ndarray
    first: np.ndarray   # whether the row starts a text
    low: np.ndarray     # tokens low <= i < high of the row are its own, the others context
    high: np.ndarray


def rows_of(seqs: list[np.ndarray], length: int = SEGMENT, context: int = CONTEXT) -> Rows:
    """Texts whole, longer ones in segments of `length` tokens with `context` tokens around them."""
    rows, at = [], 0
    for seq in seqs:
        for low in range(0, len(seq), length):
            high = min(low + length, len(seq))
            a, b = max(0, low - context), min(len(seq), high + context)
            rows.append((at + a, b - a, low == 0, low - a, high - a))
        at += len(seq)
    start, size, first, low, high = (np.array(c) for c in zip(*sorted(rows, key=lambda r: (-r[1], r[0]))))
    return Rows(np.concatenate(seqs), start, size, first, low, high)


def expected(
    model: Model, seqs: list[np.ndarray], length: int = SEGMENT, context: int = CONTEXT
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions, and the log likelihood, of some texts.

    All rows take a step at once; the longest come first, so those still going are a prefix.
    """
    r = rows_of(seqs, length, context)
    n, steps, states = len(r.start), int(r.length[0]), len(model.start)
    going = n - np.searchsorted(r.length[::-1], np.arange(steps), side="right")
    # Tokens by step, then by row; rows that have ended take no part.
    step = np.repeat(np.arange(steps, dtype=np.int32), going)
    first = np.r_[0, np.cumsum(going)]
    row = np.arange(first[-1], dtype=np.int32) - first[step].astype(np.int32)
    classes = r.flat[r.start[row] + step]
    own = (step >= r.low[row]) & (step < r.high[row])
    cut = not own.all()  # some row has context
    emit, move, ones = model.emit.astype(REAL), model.move.astype(REAL), np.ones(states, REAL)
    likely = emit[classes]
    alpha, scale = np.empty_like(likely), np.empty(len(likely), REAL)
    now = np.where(r.first[:, None], model.start, model.inside).astype(REAL) * likely[:n]
    for t in range(steps):
        at, k = slice(first[t], first[t + 1]), going[t]
        if t:
            now = now[:k] @ move
            now *= likely[at]
        total = scale[at] = now @ ones
        now /= total[:, None]
        alpha[at] = now
    likely /= scale[:, None]
    back, moves = np.ones((n, states), REAL), np.zeros((states, states))
    for t in range(steps - 1, 0, -1):
        at, k = slice(first[t], first[t + 1]), going[t]
        ahead = likely[at]
        ahead *= back[:k]
        alpha[at] *= back[:k]
        before = alpha[first[t - 1]:first[t - 1] + k]
        moves += before.T @ (ahead * own[at, None] if cut else ahead)
        back[:k] = ahead @ move.T
    alpha[:n] *= back
    weights = np.ascontiguousarray((alpha[own] if cut else alpha).T, dtype=np.float64)
    classes = classes[own] if cut else classes
    emitted = np.stack([np.bincount(classes, weights[s], len(emit)) for s in range(states)], 1)
    log = np.log(scale[own], dtype=np.float64).sum()
    return alpha[:n][r.first].sum(0, dtype=np.float64), moves * model.move, emitted, float(log)


def trained(texts: DataFrame, model: Model, frequency: np.ndarray) -> tuple[Model, float]:
    """One Baum-Welch pass over `texts` (seq): expected counts are summed per partition, then by class.

    Returns the new model, and the logarithm of what training raises, of the model before: likelihood times prior.
    """
    classes, states = len(frequency), len(model.start)

    def count(batches):
        start, moves, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), np.zeros(states)
        for seqs in _bunches(batches):
            got = expected(model, seqs)
            start, moves, emit = start + got[0], moves + got[1], emit + got[2]
            log[0] += got[3]
        hit = np.flatnonzero(emit.sum(1))
        table = np.concatenate([emit[hit], moves, start[None], log[None]])
        ids = np.concatenate([hit, classes + np.arange(states + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c) for c in table.T.copy())], names=names)

    names = ["id", *(f"s{i}" for i in range(states))]
    sums = texts.select("seq").mapInArrow(count, "id long, " + ", ".join(f"{n} double" for n in names[1:]))
    rows = sums.groupBy("id").agg(*(F.sum(n).alias(n) for n in names[1:])).toArrow()
    table = np.zeros((classes + states + 2, states))
    table[rows.column(0).to_numpy()] = np.stack([rows.column(n).to_numpy() for n in names[1:]], 1)
    prior = PRIOR * (frequency[:, None] * np.log(model.emit)).sum() + (np.log(model.start).sum() + np.log(model.move).sum()) / states
    return model.improved(table[-2], table[classes:-2], table[:classes], frequency), float(table[-1, 0] + prior)


def _bunches(batches, tokens_at_once: int = 150_000):
    """Whole texts in lists of about `tokens_at_once` tokens."""
    bunch, size = [], 0
    for batch in batches:
        for seq in batch.column(0):
            bunch.append(np.frombuffer(seq.as_buffer(), CLASS))
            size += len(bunch[-1])
            if size >= tokens_at_once:
                yield bunch
                bunch, size = [], 0
    if bunch:
        yield bunch


def log_likelihoods(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence, by scaled forward recursion over its whole length.

    Sequences advance together, longest first, so that those still going are always a prefix.
    """
    lengths = np.array([len(s) for s in seqs])
    order = np.argsort(-lengths, kind="stable")
    flat, starts = np.concatenate(seqs), np.cumsum(np.r_[0, lengths[:-1]])[order]
    ends = np.sort(lengths)
    result = np.zeros(len(seqs))
    state = np.tile(model.start, (len(seqs), 1))
    for t in range(int(lengths.max())):
        going = len(seqs) - int(np.searchsorted(ends, t, side="right"))
        state = state[:going]
        if t:
            state = state @ model.move
        state = state * model.emit[flat[starts[:going] + t]]
        total = state.sum(1)
        result[:going] += np.log10(total)
        state /= total[:, None]
    back = np.empty(len(seqs))
    back[order] = result
    return back


def fitted(table: DataFrame, v: Vocabulary) -> Model:
    """Baum-Welch from a fixed start over all training texts, until a pass gains next to nothing."""
    frequency = v.class_counts + 0.5
    frequency = frequency / frequency.sum()
    model = Model.first(frequency)
    train = table.where(~F.col("held_out"))
    before = -math.inf
    while True:
        model, log = trained(train, model, frequency)
        if not log - before > GAIN * abs(log):
            return model
        before = log


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of `docs`.

    Null and blank texts are one token, the end. Rows that repeat are scored each. With no
    training text every token is unknown, and scores are still defined. A null id is not held out.
    """
    counts = word_counts(docs.where(~held_out(F.col("doc_id"))))
    v = vocabulary(counts)
    table = encoded(docs, v)
    model = fitted(table, v)

    @F.arrow_udf("double")
    def forward(seqs: pa.Array) -> pa.Array:
        parts = [np.frombuffer(seq.as_buffer(), CLASS) for seq in seqs]
        out = [log_likelihoods(model, parts[i:i + 2000]) for i in range(0, len(parts), 2000)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    rare = table.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    found = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.log10(found + 0.5)).alias("rare_log"), F.sum((found > 0).cast("long")).alias("rare_known"))
    rows = table.select("row", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "shared_log", "hashed_log", forward("seq").alias("hmm"))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return rows.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("known_log") + rare_log - F.col("n_tokens") * F.lit(v.base_log)).alias("base_score"),
        (F.col("hmm") + F.col("shared_log") + rare_log - F.col("hashed_log")).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The scores of every document."""
    return scored(docs)
