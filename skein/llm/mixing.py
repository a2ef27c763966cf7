"""Mixing sources to target weights with a low-discrepancy schedule.

The mix has 2**SLOT_BITS slots of equal length. Slot i's van der Corput point (i with
its bits reversed) falls into one source's stretch of the cumulative targets; the
slots of a source are ranked, and rank k takes block k mod n of the source's n blocks
of equal token counts, cut from the source's documents in shuffled order. Since the
points of a full period are a permutation, a source gets its target to within one slot.
A source whose target is less than LEAST_SLOTS such slots halves them until it holds as
many, or until a slot is no longer than a word: its slots have a longer van der Corput
number, whose leading bits say in which of the others' slots they stand.

Blocks cut through documents, so a source meets its target whatever the length of its
documents. Sources of any size spread over buckets of the shuffle order; slots are
bounded in number by SLOT_BITS and some LEAST_SLOTS a source, not by the words.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.ordering import fresh, ranked, running_start
from skein.plans.runtime import prepare, stage

#: 131,072 slots: at 100 TB a slot is about 2e8 words, at the smallest test size 3.
SLOT_BITS = 17
#: A source's target is at least so many slots, or its slots are words.
LEAST_SLOTS = 64
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1:"
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, th (the text's hash) and h, the shuffle key; null texts have size 0. Written once, as all later steps need it.

    The key is a hash of the doc_id, or of the text where there is none, so that such rows spread as well.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("th"), F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))).cast("binary")).alias("h"),
    )
    return stage(rows.withColumn("bucket", F.substring("h", 1, 3)), "mix-sized")


def targets(rows: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """sid, source, source_size, target of every source: shares by weight of all words, none above MAX_EPOCHS times its size.

    The level of the shares is found by rounds of one aggregate over the sources; the driver sees two sums a round.
    Sources are ordered by code point, null last, and weighed by the repeating list.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = ranked(sums, [F.col("source").asc_nulls_last()], "sid")
    src = stage(src.withColumn("weight", F.array(*map(F.lit, weights))[(F.col("sid") % len(weights)).cast("int")].cast("long")), "mix-sources")
    total, level, cap = src.agg(F.sum("source_size")).first()[0] or 0, 0.0, F.lit(MAX_EPOCHS) * F.col("source_size")
    while True:
        full = cap.cast("double") < F.lit(level) * F.col("weight")
        kept, open_weight = src.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        nxt = (total - kept) / open_weight if open_weight else level
        if nxt == level:
            break
        level = nxt
    return src.select("sid", "source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _levels(goal: DataFrame, slot_bits: int) -> tuple[DataFrame, int, str]:
    """goal with n, the number of slots the whole mix has at the source's level; all words; the type that holds products of the two."""
    total = goal.agg(F.sum("source_size")).first()[0] or 0
    most = max(slot_bits, math.ceil(math.log2(max(1, total))))
    halvings = F.ceil(F.log2(F.lit(float(LEAST_SLOTS * total)) / (F.col("target") * F.lit(1 << slot_bits)))).cast("int")
    bits = F.when(F.col("target") > 0, F.greatest(F.lit(slot_bits), F.least(F.lit(most), halvings + slot_bits))).otherwise(slot_bits)
    goal = goal.withColumn("bits", bits).withColumn("n", F.expr("shiftleft(1L, bits)"))
    wide = total << most >= 1 << 61 and goal.agg(F.max(F.col("source_size").cast("double") * F.col("n"))).first()[0] + total >= 1 << 61
    return goal, total, "decimal(38,0)" if wide else "bigint"


def schedule(goal: DataFrame, slot_bits: int = SLOT_BITS) -> DataFrame:
    """slot, sid, block, epoch, at for every slot of the mix; goal as targets() returns it.

    at: the position in the mix, in slots of slot_bits; slot: its whole part, which slots of finer levels share.
    """
    goal, total, big = _levels(goal, slot_bits)
    if not total:
        return goal.sparkSession.createDataFrame([], "slot long, sid long, block long, epoch long, at double")
    lay = running_start(goal.withColumn("all", F.lit(1)).withColumn("part", F.floor(F.col("sid") / 4096)), "all", "part", ["sid"], "target", "lo")
    at = lambda c: F.least(F.col("n"), F.round(c * F.col("n") / F.lit(total)).cast("long"))
    lay = lay.select("sid", "source_size", "bits", "n", at(F.col("lo")).alias("a"), at(F.col("lo") + F.col("target")).alias("b")).where("a < b")
    points = lay.select("sid", "source_size", "bits", "n", F.explode(F.sequence("a", F.col("b") - 1)).alias("point"))
    turned = points.withColumn("turned", F.expr("cast(conv(reverse(lpad(bin(point), bits, '0')), 2, 10) as bigint)"))
    slots = turned.withColumn("slot", F.expr(f"shiftright(turned, bits - {slot_bits})")).withColumn("one", F.lit(1))
    slots = running_start(slots.withColumn("bucket", F.shiftright("slot", 10)), "sid", "bucket", ["turned"], "one", "k")
    slots = slots.withColumn("blocks", F.expr(f"cast(source_size - 1 as {big}) * n div {total} + 1"))
    place = F.col("turned") / F.col("n") * F.lit(1 << slot_bits)
    return slots.select("slot", "sid", (F.col("k") % F.col("blocks")).alias("block"), F.expr("k div blocks").alias("epoch"), place.alias("at")).where(F.col("epoch") < MAX_EPOCHS)


def laid_out(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows with the columns of goal and start, the words of the source before it in shuffled order."""
    placed = rows.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return running_start(placed, "sid", "bucket", ["h", "doc_id", "size", "th"], "size", "start")


def _by_block(goal: DataFrame, slot_bits: int) -> DataFrame:
    return schedule(goal, slot_bits).groupBy("sid", "block").agg(F.count("*").alias("times"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, slot_bits: int = SLOT_BITS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs.

    taken: words of the document in the blocks that the schedule takes, times the number of times (at most MAX_EPOCHS).
    Nulls: a null text has size 0 and takes nothing; a null source is a source of its own, the last. Repeated rows are
    separate documents. All sizes zero, or no rows: nothing is taken. Ties in the shuffle order go by doc_id, then size.
    """
    rows = sized(docs)
    goal = targets(rows, weights)
    goal, total, big = _levels(goal, slot_bits)
    out = stage(laid_out(rows, goal), "mix-laid")
    keep = ["doc_id", "source", "size", "source_size", "target"]
    none = out.where("size = 0").select(*keep, F.lit(0).cast("long").alias("taken"))
    if not total:
        return none
    cut = out.where("size > 0").withColumn("end", F.col("start") + F.col("size"))
    cut = cut.withColumn("block", F.explode(F.expr(f"sequence(cast(start as {big}) * n div {total}, cast(end - 1 as {big}) * n div {total})")))
    first = lambda b: f"(cast({b} as {big}) * {total} + n - 1) div n"
    cut = cut.withColumn("part", F.expr(f"least(end, {first('block + 1')}) - greatest(start, {first('block')})"))
    got = cut.join(_by_block(goal, slot_bits), ["sid", "block"], "left")
    # start tells documents of a source apart, as each of them has words
    taken = got.groupBy("sid", "start", *keep).agg(F.sum(F.coalesce(F.col("times"), F.lit(0)) * F.col("part")).alias("taken"))
    return taken.select(*keep, "taken").unionByName(none)


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, slot_bits: int = SLOT_BITS) -> DataFrame:
    """docs as the mix takes them, whole: a row as often as the schedule takes the block of its first word (0 to MAX_EPOCHS).

    A source's words differ from its target by less than a document. Documents without words, null texts among them, are
    kept once. Rows equal in doc_id, source and text are one document and share its number; rows that share a doc_id, or
    have none, but differ in source or text are documents of their own. All words zero, or no rows: docs as they are.
    """
    rows = sized(docs).groupBy("doc_id", "source", "th", "h", "bucket").agg(F.sum("size").alias("size"))
    goal = targets(rows, weights)
    goal, total, big = _levels(goal, slot_bits)
    if not total:
        return docs
    placed = laid_out(rows, goal).withColumn("block", F.when(F.col("size") > 0, F.expr(f"cast(start as {big}) * n div {total}")))
    got = placed.join(_by_block(goal, slot_bits), ["sid", "block"], "left")
    taken = F.when(F.col("size") == 0, 1).otherwise(F.coalesce(F.col("times"), F.lit(0))).cast("int")
    id_, source, th, n, own, copy = fresh(docs, "_id", "_source", "_th", "_times", "_own", "_copy")
    times = stage(got.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("th").alias(th), taken.alias(n)), "mix-times")
    keyed = docs.withColumn(own, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(times[id_]) & keyed["source"].eqNullSafe(times[source]) & (keyed[own] == times[th])
    out = keyed.join(times, same).where(F.col(n) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
