"""Mixing sources to target weights by Pareto order sampling.

Every document of a source gets the whole copies that are certain; for the rest, each
has an inclusion probability, and documents are ranked by random odds divided by inclusion
odds. The first in that order are taken up to the size that is still needed. Draws
depend on the document alone, so a rerun takes the same. Rows that repeat share their draw; where the
sample ends among them, as many as are needed are taken. Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playlens.llm.common import WORD, fresh, save, text_hash

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: (least size, weight) of documents: fragments are half as likely to be repeated or kept.
CLASSES = ((0, 0.5), (50, 1.0))
#: Bits of a rank, and of the part that one step of the search for the cut resolves.
RANK_BITS, STEP_BITS = 48, 12
DRAW_DIGITS = 13  # hex digits of md5: 52 bits


def size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, number): one row per source, numbered from 0 by code point, null last.

    A source is counted within its range of names; the ranges, as many as partitions, are then
    counted on, so that no task sees all sources.
    """
    totals = save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranged = save(
        totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "ranges"
    )
    place = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return ranged.withColumn("place", F.row_number().over(place) - 1).join(bases, "range").select(
        "source", "source_size", (F.col("base") + F.col("place")).alias("number")
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) per source of `sizes` (source, size).

    Targets are proportional to the weights until one would pass `cap` times its source's
    size; it stops there, and the others share what is left, again and again.
    """
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("number") % len(weights)).cast("int"))
    rows = save(numbered_sources(sizes).withColumn("weight", weight), "weights")
    limit = F.lit(cap) * F.col("source_size")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, above = None, F.lit(False)
    while True:  # each turn stops at least one source more, or ends
        got = rows.agg(
            F.sum(F.when(above, limit).otherwise(0.0)).alias("stopped"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.when(above, 1).otherwise(0)).alias("n"),
        ).first()
        if not got["open"] or level is not None and got["n"] == stopped:
            break
        stopped, level = got["n"], (share * total - got["stopped"]) / got["open"]
        above = F.col("weight") * F.lit(level) > limit
    goal = F.when(above, limit).otherwise(F.col("weight") * F.lit(level or 0.0))
    return rows.select("source", "source_size", F.least(goal, limit).alias("target"))


def _rank(draw: Column, probability: Column) -> Column:
    """Random odds over inclusion odds, on a scale of RANK_BITS bits that keeps the order."""
    odds = draw / (1 - draw) * (1 - probability) / probability
    return F.least(F.floor(odds / (1 + odds) * 2.0**RANK_BITS), F.lit(2**RANK_BITS - 1)).cast("bigint")


def cuts(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cut, before, need): per group the rank in which sizes in order of ranks reach `need`, and their sum before it.

    `ranked` has the keys, need, rank and size. Sizes are summed per slice of the ranks, the
    slice in which the need is met is found and cut into slices again: no task sees the
    rows of a group, whatever its share, only 2^STEP_BITS sums per group and step.
    """
    found = None
    for shift in range(RANK_BITS - STEP_BITS, -1, -STEP_BITS):
        rows = ranked
        if found is not None:
            rows = _inside(ranked, found, keys).where(F.shiftright("rank", shift + STEP_BITS) == F.col("slice"))
        else:
            rows = ranked.withColumn("before", F.lit(0).cast("bigint"))
        sums = rows.groupBy(*keys, "need", "before", F.shiftright("rank", shift).alias("slice")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy(*keys).orderBy("slice")
        running = F.col("before") + F.sum("size").over(order)
        nexts = F.lead("slice").over(order)
        steps = sums.withColumn("running", running).withColumn("last", nexts.isNull()).withColumn(
            "start", F.col("running") - F.col("size")
        )
        # The first slice whose sum reaches the need, or the last one there is.
        hit = (F.col("start") < F.col("need")) & ((F.col("running") >= F.col("need")) | F.col("last"))
        found = save(steps.where(hit).select(*keys, "slice", F.col("start").alias("before"), "need"), "cuts")
    return found.select(*keys, F.col("slice").alias("cut"), "before", "need")


def _inside(ranked: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    same = [ranked[k].eqNullSafe(found[k]) for k in keys]
    joined = ranked.join(found, same)
    return joined.select(*(ranked[k] for k in keys), ranked["need"], found["before"], ranked["rank"], ranked["size"], found["slice"])


def class_of(size: Column, classes: tuple[tuple[int, float], ...] = CLASSES) -> Column:
    """Number of the last class whose least size is reached."""
    number = F.lit(0)
    for i, (least, _) in enumerate(classes[1:], 1):
        number = F.when(size >= least, F.lit(i)).otherwise(number)
    return number


def ratios(sizes: DataFrame, goals: DataFrame, classes: tuple[tuple[int, float], ...] = CLASSES, cap: float = CAP) -> DataFrame:
    """(of, source_size, target, ratios, need): the expected copies of a document per class.

    Within a source they are proportional to the weights of the classes, stop at `cap`, and add
    up to the target. `need` is the part of the target that no whole copy covers.
    """
    weights = [w for _, w in classes]
    sums = sizes.groupBy("source").agg(*(
        F.sum(F.when(F.col("class") == i, F.col("size")).otherwise(0)).alias(f"s{i}") for i in range(len(classes))
    ))
    rows = sums.join(goals, sums["source"].eqNullSafe(goals["of"])).drop("source")
    stopped = [F.lit(False)] * len(classes)
    for turn in range(len(classes)):  # each turn stops one class more, or changes nothing
        full = sum(F.when(x, cap * F.col(f"s{i}")).otherwise(0.0) for i, x in enumerate(stopped))
        open_ = sum(F.when(x, 0.0).otherwise(w * F.col(f"s{i}")) for (i, x), w in zip(enumerate(stopped), weights))
        rows = rows.withColumn(f"level{turn}", F.when(open_ > 0, (F.col("target") - full) / open_).otherwise(0.0))
        stopped = [x | (w * F.col(f"level{turn}") > cap) for x, w in zip(stopped, weights)]
    last = F.col(f"level{len(classes) - 1}")
    got = [F.when(x, F.lit(cap)).otherwise(F.least(w * last, F.lit(cap))) for x, w in zip(stopped, weights)]
    need = sum((r - F.floor(r)) * F.col(f"s{i}") for i, r in enumerate(got))
    return rows.select("of", "source_size", "target", F.array(*got).alias("ratios"), need.alias("need"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with a number from 1 on within equal `key`, as column `name`.

    Needs key, part and at: where a row was stored. Rows are counted per part and the parts are counted
    on, so that no task sees all rows of a key.
    """
    counts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("at"))
    return rows.withColumn("place", place).join(bases, ["key", "part"]).withColumn(name, F.col("base") + F.col("place")).drop("base", "place")


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """`rows` saved with part and at, the place of each."""
    return save(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), purpose)


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, copies) for each row of `docs`.

    Needs doc_id, text and source. The whole part of a document's expected copies is certain, the
    rest is its inclusion probability in the sample, whose total size comes within half
    of one document to what is needed. Rows that agree in source, id and text share their draw; if
    the sample ends among them, some are taken and others are not. Documents without a word have size 0 and take
    nothing; an empty table has no source and no row.
    """
    key = F.concat_ws(":", F.col("doc_id").cast("string"), "text_key", F.lit(str(seed)))
    draw = (F.conv(F.substring(F.md5(key), 1, DRAW_DIGITS), 16, 10).cast("bigint") + 0.5) / 2.0 ** (4 * DRAW_DIGITS)
    rows = docs.select("doc_id", "source", text_hash().alias("text_key"), size(F.col("text")).alias("size"))
    rows = stored(rows.withColumn("draw", draw).withColumn("class", class_of(F.col("size"))), "sizes")
    goals = targets(rows).select(F.col("source").alias("of"), "source_size", "target")
    goals = save(ratios(rows, goals), "targets")
    joined = rows.join(goals, rows["source"].eqNullSafe(goals["of"])).withColumn("ratio", F.get("ratios", F.col("class")))
    joined = joined.withColumn("certain", F.floor("ratio")).withColumn("chance", F.col("ratio") - F.floor("ratio")).drop("of")
    asks = (F.col("chance") > 0) & (F.col("size") > 0)
    joined = joined.withColumn("rank", F.when(asks, _rank(F.col("draw"), F.col("chance"))))
    cut = cuts(joined.where("rank IS NOT NULL").select("source", "need", "rank", "size"), ["source"])
    cut = cut.select(F.col("source").alias("of"), "cut", "before")
    ranked = joined.join(cut, joined["source"].eqNullSafe(cut["of"]), "left").drop("of")
    at_cut = F.coalesce(F.col("rank") == F.col("cut"), F.lit(False))
    clear = ranked.where(~at_cut).withColumn("more", F.coalesce(F.col("rank") < F.col("cut"), F.lit(False)))
    # Where the sample ends: the rows of one document, or, by chance, of a few with equal ranks.
    last = ranked.where(at_cut).withColumn("key", F.struct("source", "doc_id", "text_key"))
    groups = last.groupBy("key").agg(F.sum("size").alias("total"))
    order = Window.partitionBy("key.source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("key", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("ahead"))
    last = numbered(last, "number").join(groups, "key")
    reached = F.col("before") + F.col("ahead") + (F.col("number") - 1) * F.col("size")
    last = last.withColumn("more", F.col("size") <= 2 * (F.col("need") - reached))
    columns = [
        "doc_id", "source", "text_key", "size", "source_size", "target",
        (F.col("certain") + F.col("more").cast("int")).cast("bigint").alias("copies"),
    ]
    return clear.select(*columns).unionByName(last.select(*columns))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words that the mix takes of it."""
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with the columns of `docs`.

    Rows that agree in source, id and text are one document: they share what is taken of all of them as evenly
    as whole copies allow. A row that the mix takes nothing of is left out. Null ids and sources are values like any other;
    an empty table gives no row.
    """
    key, of, total, n = (fresh(docs, name) for name in ("key", "mix_of", "mix_total", "mix_n"))
    identity = F.struct(F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    copies = mix(docs).groupBy(identity.alias(of)).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(n)).where(F.col(total) > 0)
    left = docs.withColumn(key, F.struct(F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), text_hash().alias("text_key")))
    both = left.join(copies, left[key] == copies[of]).drop(of)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    even = both.where(F.col(total) % F.col(n) == 0)
    even = even.withColumn(n, F.explode(F.sequence(F.lit(1), (F.col(total) / F.col(n)).cast("int")))).select(*columns)
    # Only the documents among which the samples end, one for each source at most.
    odd = both.where(F.col(total) % F.col(n) != 0).select(
        F.struct(*columns).alias("row"), F.col(key).alias("key"), F.col(total).alias("total"), F.col(n).alias("n")
    )
    odd = numbered(stored(odd, "odd-copies"), "number")
    times = F.floor(F.col("total") / F.col("n")) + (F.col("number") <= F.col("total") % F.col("n")).cast("int")
    odd = odd.withColumn("times", times.cast("int")).where("times > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return even.unionByName(odd.select("row.*"))
