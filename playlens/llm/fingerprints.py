"""Document fingerprints by one-permutation MinHash.

A text's five-word shingles are hashed once. The leading bits of a hash name its bin, and each bin
keeps its least hash. Empty bins borrow from a full one by optimal densification:
each tries bins in an order of its own. Of each bin a few low-order bits are
packed into the fingerprint; the chance agreement of so few bits is taken out of the
likeness. Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHINGLE = 5
#: 2^BIN_BITS bins of CODE_BITS bits each.
BIN_BITS, CODE_BITS = 8, 8
BINS = 1 << BIN_BITS
#: Tries of an empty bin before it takes, of all full bins, the one of least hash with its own.
TRIES = 8
EMPTY = ""
#: Documents are ordered in so many ranges per shuffle partition, to find each one's next.
RANGES = 8


def words(text: Column) -> Column:
    """The words of a text as an array; none for null or blank ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(docs: DataFrame, text: str, to: str) -> DataFrame:
    """`docs` with column `to`: the packed codes of `text`, array<bigint>; empty without a word.

    Each step has a column of its own, so that Spark computes it once per row.
    """
    w, h, least, codes, full, dense = (f"{to}_{part}" for part in ("words", "hashes", "least", "codes", "full", "dense"))
    hashes = F.col(h)
    first = F.filter(
        hashes, lambda v, i: (i == 0) | (F.shiftright(v, 64 - BIN_BITS) != F.shiftright(F.get(hashes, F.greatest(i - 1, F.lit(0))), 64 - BIN_BITS))
    )
    full_bins = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(F.col(codes), i).isNotNull() & (F.size(codes) > 0))
    return (
        docs.withColumn(w, words(F.col(text)))
        .withColumn(h, F.array_sort(F.concat(_shingle_hashes(F.col(w)), F.lit(_GREATEST))))
        .withColumn(least, first)
        .withColumn(codes, F.transform(least, _code))
        .withColumn(full, full_bins)
        .withColumn(dense, F.when(F.size(full) > 0, _densified(F.col(codes), F.col(full))))
        .withColumn(to, F.when(F.col(dense).isNull(), F.array().cast("array<bigint>")).otherwise(_packed(F.col(dense))))
        .drop(w, h, least, codes, full, dense)
    )


#: The greatest hash of each bin: sorted among a text's hashes, it comes first in a bin that has none.
_GREATEST = [((b - BINS // 2) << (64 - BIN_BITS)) + (1 << (64 - BIN_BITS)) - 1 for b in range(BINS)]


def _shingle_hashes(words: Column) -> Column:
    """Hashes of the runs of five words; of all words together if there are fewer."""
    many = F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE),
        lambda i: F.xxhash64(*(F.get(words, i + F.lit(k)) for k in range(SHINGLE))),
    )
    return (
        F.when(F.size(words) >= SHINGLE, many)
        .when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _code(value: Column) -> Column:
    """Low-order bits of a bin's least hash; null for an empty bin."""
    mask = (1 << (64 - BIN_BITS)) - 1
    bits = F.shiftrightunsigned(value, 8).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    return F.when(value.bitwiseAND(F.lit(mask)) != mask, bits)


def _densified(codes: Column, full: Column) -> Column:
    """`codes` with empty bins filled: from the first full bin among TRIES that the bin's own hash
    names, else from the full bin of least hash with it."""
    def fill(code: Column, i: Column) -> Column:
        tries = (F.get(codes, F.xxhash64(i, F.lit(t)).bitwiseAND(F.lit(BINS - 1)).cast("int")) for t in range(TRIES))
        rest = F.array_min(F.transform(full, lambda j: F.struct(F.xxhash64(i, j), F.get(codes, j).alias("code"))))
        return F.coalesce(code, *tries, rest["code"])

    return F.when(F.size(full) == BINS, codes).otherwise(F.transform(codes, fill))


def _packed(codes: Column) -> Column:
    """The codes, eight to a bigint."""
    def word(j: Column) -> Column:
        packed = F.lit(0).cast("bigint")
        for k in range(8):
            packed = packed.bitwiseOR(F.shiftleft(F.get(codes, j * 8 + F.lit(k)), 8 * k))
        return packed

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), word)


def printed(packed: Column) -> Column:
    """A fingerprint as a string of hexadecimal digits; empty for a text without a word."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two packed fingerprints, 0 to 1.

    Codes of different hashes agree with probability 2^-CODE_BITS; that is taken out. Two texts
    without a word are alike, and unlike any other.
    """
    def differing(x: Column) -> Column:
        for shift, mask in ((4, 0x0F), (2, 0x03), (1, 0x01)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(int.from_bytes(bytes([mask]) * 8, "big")))
        return F.bit_count(x)

    off = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-CODE_BITS
    corrected = ((BINS - off) / BINS - chance) / (1 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.least(F.greatest(corrected, F.lit(0.0)), F.lit(1.0)))
    )


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` with next_<column> of the next document by descending doc_id; after the last, of the first.

    Needs doc_id (integer) and text. Null ids come last, equal ids in the order of their texts' hashes.
    Rows are dealt by ranges of ids, found from approximate quantiles, and the first row of each
    range goes to the range before it as well. So texts are shuffled once, and no task sees more than
    a range; only the bounds, as many as ranges, pass through the driver.
    """
    spark = rows.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("doc_id", quantiles, 20 * n)).first()[0]
    bounds = sorted(set(found or ()), reverse=True)
    place = F.struct(
        F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("id"), F.xxhash64("text").alias("hash")
    )
    ranged = rows.withColumn("place", place).withColumn("range", _range(F.col("doc_id"), bounds))
    heads = ranged.groupBy("range").agg(F.min("place").alias("head"))
    order = Window.orderBy("range")
    last = F.max("range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("head", F.coalesce(F.lag("range").over(order), last).alias("before"))
    # As many rows as there are ranges, so the broadcast is bounded.
    both = ranged.join(F.broadcast(heads), ranged["place"] == heads["head"], "left")
    places = F.when(F.col("before").isNull(), F.array("range")).otherwise(F.array("range", "before"))
    dealt = both.select(*rows.columns, "place", F.posexplode(places).alias("copy", "range"))
    window = Window.partitionBy("range").orderBy("copy", "place")
    nexts = [F.lead(c).over(window).alias(f"next_{c}") for c in columns]
    return dealt.select(*rows.columns, "copy", *nexts).where("copy = 0").drop("copy")


def _range(value: Column, bounds: list[int]) -> Column:
    """Number of `bounds`, a falling list, that are `value` or greater, by bisection; all for null."""
    if not bounds:
        return F.lit(0)
    table, top = F.lit(bounds), len(bounds)
    steps = F.sequence(F.lit(1), F.lit(top.bit_length()))
    state = F.struct(F.lit(0).alias("low"), F.lit(top).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.get(table, middle) >= value
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(
            F.when(right, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(right, s["high"]).otherwise(middle).alias("high"),
        ))

    return F.when(value.isNull(), F.lit(top)).otherwise(F.aggregate(steps, state, halve, lambda s: s["low"]))


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text has its last half replaced by the first as many code points of the next document.
    Null texts count as empty. Texts of any length are taken whole; an empty table gives no row.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(sketch(rows, "text", "own"), ["text", "own"])
    length = F.char_length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), length - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", length.cast("bigint").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = sketch(rows, "edited", "new")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"), printed(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
