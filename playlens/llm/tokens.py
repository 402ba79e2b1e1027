"""Token counts by rank-synchronous merging in arrays.

Pre-tokens are rows of one ragged array of symbols. In every round each row looks up the
ranks of its neighbouring pairs and merges its lowest one, all rows at once; a row that has
no known pair left is done, and the symbols it still has are its tokens.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.bpe import Recent, piece, pieces
from playlens.llm.common import tokenizer_path

LIMIT = 1024
#: The pre-tokenizer's pattern (a fixed value of the byte-level BPE vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1) << 40
#: Pieces gathered before the unknown ones are merged together.
BATCH = 100_000


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary file: visible ones for
    themselves, the others by the characters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Merges:
    """The merge table of a byte-level BPE file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order.astype(np.int64), NO_RANK)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        chars = byte_characters()
        self.of_byte = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where it is no merge."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each pre-token; none of them is empty."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        result = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        rows = np.repeat(np.arange(len(tokens)), lengths)
        while len(symbols) > 1:
            rank = np.full(len(symbols), NO_RANK)
            inside = rows[:-1] == rows[1:]
            rank[:-1][inside] = self.lookup(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            done = lowest == NO_RANK
            result[rows[starts[done]]] = counts[done]
            if done.all():
                break
            merge = (rank == np.repeat(lowest, counts)) & (rank < NO_RANK)
            at = _apart(np.flatnonzero(merge))
            symbols[at] = self.made[rank[at]]
            stays = np.repeat(~done, counts)
            stays[at + 1] = False
            symbols, rows = symbols[stays], rows[stays]
            if not len(symbols):
                break
        else:
            result[rows] = len(symbols)
        return result


def _apart(at: np.ndarray) -> np.ndarray:
    """Of runs of adjacent positions, the first, third, fifth...: `aaa` merges from the left."""
    new = np.r_[True, np.diff(at) > 1]
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    return at[place % 2 == 0]


class Counter:
    """Counts tokens of texts, remembering those of pieces seen before."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.split = regex.compile("|".join(map(regex.escape, self.merges.special)) or r"(?!)")
        self.pattern = regex.compile(PATTERN)
        self.known = Recent(self._count_pieces, 1_000_000)

    def _count_pieces(self, new: list[str]) -> list[int]:
        counts = np.zeros(len(new), np.int64)
        tokens, owners = [], []
        for i, key in enumerate(new):
            # A special token's string is one token, and nothing merges across it.
            parts = self.split.split(piece(key))
            counts[i] = len(parts) - 1
            for part in parts:
                for token in self.pattern.findall(part):
                    tokens.append(token.encode("utf-8", "surrogatepass"))
                    owners.append(i)
        if tokens:
            counts += np.bincount(owners, self.merges.count(tokens), len(new)).astype(np.int64)
        return counts.tolist()

    def count(self, texts: list[str]) -> list[int]:
        result, waiting, size = [], [], 0
        for text in texts:
            waiting.append(pieces(text))
            size += len(waiting[-1])
            if size >= BATCH:
                result += self._flush(waiting)
                waiting, size = [], 0
        return result + self._flush(waiting)

    def _flush(self, waiting: list[list[str]]) -> list[int]:
        self.known.learn(waiting)
        return [sum(map(self.known.__getitem__, cut)) for cut in waiting]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process and vocabulary."""
    return Counter(path)


def counted(text: Column, vocabulary: str | None = None) -> Column:
    """struct(n_bytes, n_tokens) of a text; `vocabulary` is a path valid on every executor.

    Null counts as empty, and an empty text has no token. A text of any length is counted
    whole; special strings in it count as the one token that the vocabulary has for them.
    """
    @F.arrow_udf("n_bytes long, n_tokens long")
    def count(texts: pa.Array) -> pa.Array:
        values = [t.as_py() or "" for t in texts]
        tokens = counter(vocabulary or tokenizer_path()).count(values)
        size = [len(v.encode("utf-8", "surrogatepass")) for v in values]
        return pa.StructArray.from_arrays(
            [pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], names=["n_bytes", "n_tokens"]
        )

    return count(text)


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. Repeated rows are counted each."""
    got = docs.select("doc_id", counted(F.col("text"), vocabulary).alias("got"))
    return got.select("doc_id", "got.n_bytes", "got.n_tokens", (F.col("got.n_tokens") > LIMIT).alias("over_limit"))
