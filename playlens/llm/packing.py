"""Packing token pieces into sequences by linear grouping.

Texts are tokenized and cut in one pass. What remains is how many pieces there are of each
length, at most `capacity` numbers however large the corpus is. The packing is worked out
on those: lengths above a share of the capacity are rounded up within groups of equal
cardinality, a linear program over configurations of the few rounded sizes is solved by
column generation, actual lengths take the places of the rounded ones, and what is left
goes best-fit into the gaps. The plan, ranges of piece numbers per length, is then
applied to the pieces in parallel.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from playlens.llm.common import fresh, save, tokenizer_path
from playlens.llm.tokens import PATTERN, byte_characters

CAPACITY = 1024
END = 2
WIDTH = 4  # bytes of an id
#: The pre-tokenizer of a vocabulary that both libraries read alike (fixed values).
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Ids:
    """Ids of texts as the `tokenizers` library gives them, as little-endian unsigned 32-bit integers.

    Most texts are encoded by tiktoken, several times as fast, on the same vocabulary. Both merge the
    lowest-ranked pair again and again. tiktoken takes any two neighbours that make up a token
    for a pair, the library only those in its list of merges. The two can't differ if every token of the
    vocabulary, given as a text, is merged into that one token: two neighbours in a longer text
    that make up a token but are no listed pair would also be where the token on its own gets
    stuck. That is checked when the vocabulary is read; one that fails is left to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [token["content"] for token in spec.get("added_tokens", ())]
        #: Texts for the library: with an added token, or so much white space that a regex runs out of stack.
        self.odd = re.compile("|".join([*map(re.escape, added), r"\s{500}"]))
        self.fast = self._fast(spec, set(added))

    def _fast(self, spec: dict, added: set[str]):
        """A tiktoken encoder that gives the same ids, or None."""
        import tiktoken

        vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in added}
        byte_of = {c: b for b, c in byte_characters().items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", ()))
        made = [vocab.get(left + right, -1) for left, right in merges]
        usual = (
            spec["pre_tokenizer"] == BYTE_LEVEL and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
            and all(set(token) <= byte_of.keys() for token in vocab) and all(b in vocab for b in byte_of)
            and all(a < b for a, b in zip([max((vocab[b] for b in byte_of), default=0), *made], made))
            and all(len(self.tokenizer.model.tokenize(token)) == 1 for token in vocab)
        )
        if not usual:
            return None
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, texts: list[str]) -> list[bytes]:
        return [self._packed(self._one(text)) for text in texts]

    def _one(self, text: str) -> list[int]:
        if self.fast and not self.odd.search(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return numbers.tobytes()


@functools.lru_cache(maxsize=2)
def ids(path: str) -> Ids:
    """One per worker process and vocabulary."""
    return Ids(path)


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids; the first may be shorter."""
    first = (total - 1) % capacity + 1
    return [(0, first), *((start, capacity) for start in range(first, total, capacity))]


def pieces_of(docs: DataFrame, key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """One row per piece: (key, piece, start, length, ids_crc32, part, place).

    `place` counts the pieces of one length within the input partition `part`, so that
    (length, part, place) names a piece. Null texts count as empty and give one piece, the
    end id; a long text gives as many as it needs. Rows that repeat are packed each.
    """
    def work(batches):
        encode = ids(vocabulary or tokenizer_path()).of
        seen = defaultdict(int)
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                at_row, rows = [], []
                encoded = encode([t.as_py() or "" for t in some.column(1)])
                for i, data in enumerate(encoded):
                    data += END.to_bytes(WIDTH, "little")
                    for number, (start, length) in enumerate(cut(len(data) // WIDTH)):
                        crc = zlib.crc32(data[start * WIDTH:(start + length) * WIDTH])
                        at_row.append(i)
                        rows.append((number, start, length, crc, part, seen[length]))
                        seen[length] += 1
                columns = [some.column(0).take(pa.array(at_row, pa.int32()))]
                kinds = (pa.int32(), *(pa.int64(),) * 3, pa.int32(), pa.int64())
                columns += [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        # Workers live on from stage to stage; read again, the vocabulary costs a third of a second.
        ids.cache_clear()

    names = [key, "piece", "start", "length", "ids_crc32", "part", "place"]
    kinds = [docs.schema[key].dataType, T.IntegerType(), *[T.LongType()] * 3, T.IntegerType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return docs.select(key, "text", F.spark_partition_id()).mapInArrow(work, schema)


# The plan: works on counts per length alone.

@dataclass
class Run:
    """`count` sequences that all hold pieces of `lengths`."""

    count: int
    lengths: list[int]


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Large lengths, longest first, in groups of about equal cardinality; [(length, count)]."""
    total = sum(counts.values())
    result: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                result.append([])
                room = -(-total // groups)
            take = min(room, left)
            result[-1].append((length, take))
            room -= take
            left -= take
    return result


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The multiset of sizes within `capacity` of greatest value, by dynamic programming over
    the number of pieces. Sizes are large, so there are few pieces."""
    best = np.zeros(capacity + 1)
    choice = []
    for _ in range(capacity // int(sizes.min())):
        nexts = np.full((len(sizes) + 1, capacity + 1), -1.0)
        for j, (size, value) in enumerate(zip(sizes, values)):
            nexts[j, size:] = best[: capacity + 1 - size] + value
        nexts[-1] = best
        pick = nexts.argmax(0)
        choice.append(pick)
        best = nexts[pick, np.arange(capacity + 1)]
    items, room = [], capacity
    for pick in reversed(choice):
        if pick[room] < len(sizes):
            items.append(int(pick[room]))
            room -= int(sizes[pick[room]])
    return float(best[capacity]), items


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(whole multiplicity, group numbers) that solve the linear program, rounded down."""
    s, d = np.array(sizes), np.array(demand, float)
    columns = [[j] * (capacity // sizes[j]) for j in range(len(sizes))]
    inverse = np.diag([1.0 / len(c) for c in columns])
    amount = d / np.array([len(c) for c in columns])
    for _ in range(60 * len(sizes)):
        value, items = _best_configuration(s, inverse.sum(0), capacity)
        if value <= 1 + 1e-7:
            break
        column = np.bincount(items, minlength=len(sizes)).astype(float)
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, amount / step, np.inf)
        leave = int(ratio.argmin())
        amount = np.maximum(amount - ratio[leave] * step, 0)
        amount[leave] = ratio[leave]
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
        columns[leave] = items
    return [(int(a + 1e-6), c) for a, c in zip(amount, columns) if a >= 1 - 1e-6]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 200, large: float = 0.3) -> list[Run]:
    """Runs of sequences that hold every piece exactly once. Takes counts per length."""
    left = {length: n for length, n in counts.items() if n}
    runs = [Run(left.pop(capacity), [capacity])] if capacity in left else []
    tall = {length: n for length, n in left.items() if length > large * capacity}
    if tall:
        grouped = linear_groups(tall, groups)
        # Equal rounded sizes are one size with the demand of both.
        sizes = [group[0][0] for group in grouped]
        merged: dict[int, list[tuple[int, int]]] = {}
        for size, group in zip(sizes, grouped):
            merged.setdefault(size, []).extend(group)
        stock = [list(group) for group in merged.values()]
        demand = [sum(n for _, n in group) for group in stock]
        for times, items in configurations(list(merged), demand, capacity):
            for run in _substitute(times, items, stock):
                runs.append(run)
                for length in run.lengths:
                    left[length] -= run.count
    return _best_fit(runs, {length: n for length, n in left.items() if n > 0}, capacity)


def _substitute(times: int, items: list[int], stock: list[list[tuple[int, int]]]) -> list[Run]:
    """`times` sequences with actual lengths in the places of groups `items`; takes them from
    `stock`. A group that has run out leaves its place empty."""
    lanes = []
    for item in items:
        lane, need = [], times
        while need and stock[item]:
            length, n = stock[item].pop(0)
            take = min(n, need)
            lane.append((length, take))
            need -= take
            if n > take:
                stock[item].insert(0, (length, n - take))
        lanes.append(lane)
    runs = []
    while times and any(lanes):
        step = min([times, *(lane[0][1] for lane in lanes if lane)])
        runs.append(Run(step, [lane[0][0] for lane in lanes if lane]))
        for lane in lanes:
            if lane:
                length, n = lane.pop(0)
                if n > step:
                    lane.insert(0, (length, n - step))
        times -= step
    return runs


def _best_fit(runs: list[Run], left: dict[int, int], capacity: int) -> list[Run]:
    """Longest first, each remaining piece goes where least room is left; equal pieces and
    equal sequences are treated together."""
    open_runs: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        open_runs[capacity - sum(run.lengths)].append(run)
    done: list[Run] = []
    for length in sorted(left, reverse=True):
        need = left[length]
        while need:
            room = min((r for r, some in open_runs.items() if some and r >= length), default=None)
            if room is None:
                each = min(capacity // length, need)
                opened = need // each
                open_runs[capacity - each * length].append(Run(opened, [length] * each))
                need -= opened * each
                continue
            run = open_runs[room].pop()
            each = min(room // length, need)
            filled = min(run.count, need // each)
            if run.count > filled:
                open_runs[room].append(Run(run.count - filled, list(run.lengths)))
            run = Run(filled, run.lengths + [length] * each)
            need -= filled * each
            rest = room - each * length
            (open_runs[rest] if rest else done).append(run)
    return done + [run for some in open_runs.values() for run in some]


def blocks(runs: list[Run]) -> dict[int, np.ndarray]:
    """Per length the rows (first piece number, sequence, offset, pieces per sequence), by number."""
    result = defaultdict(list)
    next_number: dict[int, int] = defaultdict(int)
    sequence = 0
    for run in runs:
        offset = 0
        for length in sorted(set(run.lengths), reverse=True):
            each = run.lengths.count(length)
            result[length].append((next_number[length], sequence, offset, each))
            next_number[length] += each * run.count
            offset += each * length
        sequence += run.count
    return {length: np.array(rows, np.int64) for length, rows in result.items()}


def pack(docs: DataFrame, key: str = "doc_id", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of `docs` with its sequence_id and offset.

    Returns (key, piece, start, length, ids_crc32, sequence_id, offset). An empty table gives
    no sequence. The driver sees one count per length, at most `capacity` numbers.
    """
    cuts = save(pieces_of(docs, key, vocabulary), "pieces")
    per_part = cuts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {row["length"]: row["n"] for row in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = blocks(plan(counts, capacity))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        lengths, numbers = length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for value in np.unique(lengths):
            at = np.flatnonzero(lengths == value)
            rows = table[int(value)]
            row = rows[np.searchsorted(rows[:, 0], numbers[at], side="right") - 1]
            turn, copy = np.divmod(numbers[at] - row[:, 0], row[:, 3])
            sequence[at], offset[at] = row[:, 1] + turn, row[:, 2] + copy * value
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    numbered = cuts.join(base, ["length", "part"]).withColumn("number", F.col("base") + F.col("place"))
    name = fresh(numbered, "placed")
    return numbered.withColumn(name, place("length", "number")).select(
        key, "piece", "start", "length", "ids_crc32", f"{name}.sequence_id", f"{name}.offset"
    )
