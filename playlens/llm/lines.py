"""Removing repeated runs of lines by winnowing over line hashes.

A document is the sequence of its lines' hashes. A window is the shortest run of lines with
GUARANTEE words that ends at a line, or that starts at one. Each window selects its least line as a
fingerprint: that depends on the window alone, so a repeated run of GUARANTEE words has its
fingerprints wherever it stands. Fingerprints are few and most are unique in the corpus; only windows whose
fingerprint is found elsewhere go on. Each is joined with the first position of its own content: the
line alone may have come first in some other place, the whole window leads to a true source. From
there the match is extended both ways, line by line, and the later run is deleted. Of equal lines the
very first always stays.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.common import SPACES, fresh, release, save

GUARANTEE = 20
#: Of the polynomial over the hashes of a window's lines.
PRIME, BASE = 2**127 - 1, 0x5D2C9A7E31F4B6880E6F13D7A94C25B3
#: Bytes of a line's hash, and of a window in a fingerprint: its key, start and stop.
LINE, PACKED = 16, 24


def split(text: str) -> list[str]:
    return text.split("\n")


def line_hash(line: str) -> int:
    """128 bits of a line without the white space around it; 0 for a line without a word."""
    line = line.strip(SPACES)
    return xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass")) if line else 0


def windows(words: list[int], guarantee: int = GUARANTEE) -> list[tuple[int, int]]:
    """[start, stop) of the shortest windows with `guarantee` words that end at a line or start at one, in order.

    Neither start nor stop ever goes back. Every line of a run with `guarantee` words is in a window within the run.
    """
    found: dict[tuple[int, int], None] = {}
    start, total = 0, 0
    for end, n in enumerate(words):
        total += n
        while total - words[start] >= guarantee:
            total -= words[start]
            start += 1
        if total >= guarantee:
            found[start, end + 1] = None
    stop, total = len(words), 0
    for start in range(len(words) - 1, -1, -1):
        total += words[start]
        while total - words[stop - 1] >= guarantee:
            stop -= 1
            total -= words[stop]
        if total >= guarantee:
            found[start, stop] = None
    return sorted(found)


def winnow(hashes: list[int], words: list[int], places: list[tuple[int, int]]) -> list[int]:
    """The position of the least line of each window in `places`, which are in order.

    Least is the line with the most binary digits in its number of words, then the smallest
    hash, then the last.
    """
    order = [(-n.bit_length(), h) for n, h in zip(words, hashes)]
    chosen, queue, seen = [], deque(), 0  # the queue holds candidates, least first
    for start, stop in places:
        for at in range(seen, stop):
            while queue and order[queue[-1]] >= order[at]:
                queue.pop()
            queue.append(at)
        seen = max(seen, stop)
        while queue[0] < start:
            queue.popleft()
        chosen.append(queue[0])
    return chosen


def window_keys(hashes: list[int], places: list[tuple[int, int]]) -> list[bytes]:
    """128 bits that stand for the lines of each window; the time does not depend on their number."""
    before, power = [0], [1]
    for h in hashes:
        before.append((before[-1] * BASE + h) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    values = ((before[stop] - before[start] * power[stop - start]) % PRIME for start, stop in places)
    return [xxhash.xxh3_128_digest(v.to_bytes(16, "little"), stop - start) for v, (start, stop) in zip(values, places)]


def fingerprints(text: str, guarantee: int = GUARANTEE) -> tuple[bytes, dict[int, bytes]]:
    """(hashes of all lines, {position of a selected line: its windows, packed}) of a text."""
    rows = split(text)
    words = [len(row.encode("utf-8", "surrogatepass").split()) for row in rows]
    hashes = [line_hash(row) for row in rows]
    places = windows(words, guarantee)
    found: dict[int, list[bytes]] = {}
    for at, key, (start, stop) in zip(winnow(hashes, words, places), window_keys(hashes, places), places):
        found.setdefault(at, []).append(key + start.to_bytes(4, "little") + stop.to_bytes(4, "little"))
    return b"".join(h.to_bytes(LINE, "little") for h in hashes), {at: b"".join(packed) for at, packed in found.items()}


def profile(text: Column, guarantee: int = GUARANTEE) -> Column:
    """struct(lines, chosen array<struct(line, windows)>): the lines of a text and its fingerprints."""
    @F.arrow_udf("lines binary, chosen array<struct<line:long,windows:binary>>")
    def profiles(texts: pa.Array) -> pa.Array:
        blobs, line, packed, edges = [], [], [], [0]
        for value in texts:
            hashes, found = fingerprints(value.as_py() or "", guarantee)
            # A text without a window can be no source either.
            blobs.append(hashes if found else b"")
            line += [int.from_bytes(hashes[at * LINE:at * LINE + 8], "little", signed=True) for at in found]
            packed += found.values()
            edges.append(len(line))
        chosen = pa.StructArray.from_arrays([pa.array(line, pa.int64()), pa.array(packed, pa.binary())], names=["line", "windows"])
        return pa.StructArray.from_arrays(
            [pa.array(blobs, pa.binary()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), chosen)], names=["lines", "chosen"]
        )

    return profiles(text)


def _text_key(text: str = "text") -> Column:
    """128 bits that stand for a text, none for null."""
    return F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b""))


def _unpacked(chosen: DataFrame) -> DataFrame:
    """(doc, key, start, stop): the windows of fingerprints (doc, windows)."""
    def unpack(batches):
        kind = np.dtype([("key", f"V{LINE}"), ("start", "<i4"), ("stop", "<i4")])
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            flat = np.frombuffer(b"".join(blobs), kind)
            owner = np.repeat(np.arange(len(blobs)), [len(b) // PACKED for b in blobs])
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LINE), len(flat), [None, pa.py_buffer(np.ascontiguousarray(flat["key"]))])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner)), keys.cast(pa.binary()),
                pa.array(flat["start"].astype(np.int32)), pa.array(flat["stop"].astype(np.int32)),
            ], names=["doc", "key", "start", "stop"])

    doc = chosen.schema["doc"].dataType.simpleString()
    return chosen.select("doc", "windows").mapInArrow(unpack, f"doc {doc}, key binary, start int, stop int")


def extended(lines: bytes, source: bytes, matches: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs [start, stop) of lines that stand in `source` as well, from matches (start, stop, place in `source`).

    Each match is verified and extended to both sides as long as lines are equal, up to lines that are in a run
    already: what lies beyond them has matches of its own.
    """
    n, m = len(lines) // LINE, len(source) // LINE
    taken = np.zeros(n + 1, bool)

    def equal(at: int, there: int) -> bool:
        return lines[at * LINE:at * LINE + LINE] == source[there * LINE:there * LINE + LINE]

    for start, stop, there in sorted(matches):
        if taken[start:stop].all() or lines[start * LINE:stop * LINE] != source[there * LINE:(there + stop - start) * LINE]:
            continue
        a, b = start, there
        while a and b and not taken[a - 1] and equal(a - 1, b - 1):
            a, b = a - 1, b - 1
        c, d = stop, there + stop - start
        while c < n and d < m and not taken[c] and equal(c, d):
            c, d = c + 1, d + 1
        taken[a:c] = True
    change = np.flatnonzero(np.diff(np.concatenate([[False], taken]).astype(np.int8)))
    return list(zip(change[::2].tolist(), change[1::2].tolist()))


def _runs(lines: Column, source: Column, matches: Column) -> Column:
    """array<struct(start, stop)>: what `extended` gives."""
    @F.arrow_udf("array<struct<start:int,stop:int>>")
    def extend(lines: pa.Array, sources: pa.Array, matches: pa.Array) -> pa.Array:
        starts, stops, edges = [], [], [0]
        for own, other, some in zip(lines, sources, matches):
            places = some.values
            found = extended(own.as_py(), other.as_py(), list(zip(*(places.field(n).to_pylist() for n in ("start", "stop", "there")))))
            starts += [a for a, _ in found]
            stops += [b for _, b in found]
            edges.append(len(starts))
        runs = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["start", "stop"])
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs)

    return extend(lines, source, matches)


def repeated_runs(docs: DataFrame, guarantee: int = GUARANTEE) -> DataFrame:
    """(doc_id, text_key, runs): the runs of lines [start, stop) to delete, per document; they may overlap.

    Documents follow each other by doc_id, null last, then by the hash of the text. Rows that
    agree in both are one document. Documents without a repeated run are absent. A hot line or window is combined
    on the map side or split by AQE in a join; no step gathers where it stands.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    rows = docs.select("doc_id", _text_key().alias("text_key"), profile(F.col("text"), guarantee).alias("p"))
    rows = save(rows.select(order.alias("doc"), "p.lines", "p.chosen"), "fingerprints")
    chosen = rows.select("doc", F.explode("chosen").alias("c")).select("doc", "c.*")
    common = chosen.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line")
    found = save(_unpacked(chosen.join(common, "line", "left_semi")), "windows")
    # Rows of one document have the same places, so none of them comes before another.
    first = found.groupBy("key").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    matched = found.join(first.select("key", "first"), "key").where(F.col("first") < F.struct("doc", "start"))
    pairs = matched.select("doc", F.col("first.doc").alias("source"), F.struct("start", "stop", F.col("first.start").alias("there")).alias("m"))
    pairs = save(pairs.groupBy("doc", "source").agg(F.collect_set("m").alias("matches")), "matches")
    texts = pairs.select("doc").unionByName(pairs.select(F.col("source").alias("doc"))).distinct()
    lines = save(rows.select("doc", "lines").join(texts, "doc", "left_semi").dropDuplicates(["doc"]), "lines")
    release(rows, found)
    both = pairs.join(lines, "doc").join(lines.select(F.col("doc").alias("source"), F.col("lines").alias("there")), "source")
    runs = both.select("doc", F.explode(_runs(F.col("lines"), F.col("there"), F.col("matches"))).alias("run"))
    return runs.groupBy("doc").agg(F.collect_set("run").alias("runs")).select(
        F.col("doc.doc_id").alias("doc_id"), F.col("doc.text_key").alias("text_key"), "runs"
    )


def _without(text: Column, runs: Column) -> Column:
    """struct(text, n_lines, n_deleted) of a text without the lines in `runs`."""
    def delete(texts: pa.Array, runs: pa.Array) -> pa.Array:
        result, lines_before, deleted = [], [], []
        for value, found in zip(texts, runs):
            text = value.as_py()
            lines = split(text or "")
            gone = np.zeros(len(lines), bool)
            if found.is_valid:
                change = np.zeros(len(lines) + 1, np.int64)
                np.add.at(change, found.values.field("start").to_numpy(), 1)
                np.add.at(change, found.values.field("stop").to_numpy(), -1)
                gone = np.cumsum(change)[:-1] > 0
            n = int(gone.sum())
            result.append("\n".join(line for line, out in zip(lines, gone) if not out) if n else text)
            lines_before.append(len(lines) if text else 0)
            deleted.append(n)
        arrays = [pa.array(result, pa.string()), pa.array(lines_before, pa.int64()), pa.array(deleted, pa.int64())]
        return pa.StructArray.from_arrays(arrays, names=["text", "n_lines", "n_deleted"])

    # Else a filter on its result would run it a second time.
    return F.arrow_udf(delete, "text string, n_lines long, n_deleted long").asNondeterministic()(text, runs)


def deduplicated(docs: DataFrame, guarantee: int = GUARANTEE) -> tuple[DataFrame, str]:
    """`docs` with one more column, struct(text, n_lines, n_deleted), and its name.

    Every row of `docs` comes back. Null and empty texts have no line and stay as they are;
    a text of any length is handled whole, and so is an empty table.
    """
    key, of, of_key, runs, name = (fresh(docs, n) for n in ("text_key", "run_id", "run_key", "runs", "without"))
    found = repeated_runs(docs, guarantee).select(F.col("doc_id").alias(of), F.col("text_key").alias(of_key), F.col("runs").alias(runs))
    left = docs.withColumn(key, _text_key())
    both = left.join(found, left["doc_id"].eqNullSafe(found[of]) & (left[key] == found[of_key]), "left")
    return both.withColumn(name, _without(F.col("text"), F.col(runs))).select(*(f"`{c}`" for c in docs.columns), name), name


def cleaned(docs: DataFrame) -> DataFrame:
    """`docs` without repeated runs of lines; a text that has nothing left but blanks goes. Adapts n_chars."""
    rows, name = deduplicated(docs)
    rows = rows.where((F.col(f"{name}.n_deleted") == 0) | F.col(f"{name}.text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col(f"{name}.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{name}.n_deleted") == 0, F.col("n_chars")).otherwise(
            F.char_length(f"{name}.text")
        ).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(new).select(*(f"`{c}`" for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_deleted and the text that stays."""
    rows, name = deduplicated(docs)
    return rows.select("doc_id", f"{name}.n_lines", f"{name}.n_deleted", f"{name}.text")
