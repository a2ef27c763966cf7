"""AGG10: how well predicted chunks agree with gold spans: token IoU, excerpt precision, Pk, WindowDiff, boundary similarity.

Texts are never expanded to a row a unit. Pk and WindowDiff slide a window of k units; how many boundaries it holds changes
only where one enters or leaves, so a document is a few events with running sums between which nothing changes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def token_spans(docs: DataFrame, spans: DataFrame, key: str, pattern: str = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+") -> DataFrame:
    """spans (key, start, end in characters and further columns) with start and end in tokens: how many token ends, the text's start among them, lie before.

    pattern: what a token is; the default is a word with the white space before it. Spans of null texts have no rows.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields)
    each = spans.groupBy(key).agg(F.collect_list(F.struct(*spans.columns)).alias("spans"))
    names, find = spans.columns, re.compile(pattern)

    def run(frames):
        for pdf in frames:
            rows = []
            for text, own in zip(pdf["text"], pdf["spans"], strict=True):
                ends = [0, *accumulate(len(m) for m in find.findall(text))]
                rows += [tuple(bisect_left(ends, r[c]) if c in ("start", "end") else r[c] for c in names) for r in own]
            yield pd.DataFrame(rows, columns=names)

    return docs.where("text is not null").select(key, "text").join(each, key).select("text", "spans").mapInPandas(run, kinds)


def span_scores(gold: DataFrame, predicted: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """key, span_no, iou, precision of every gold span: the best intersection over hull, and the share of the chunk that overlaps it most (ties: the first chunk) that lies in it.

    gold: key, span_no, start, end; predicted: key, chunk_no, start, end. Spans and chunks meet by bins of width positions.
    """
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    g = gold.where("end > start").select(key, "span_no", "start", "end", bins().alias("bin"))
    p = predicted.where("end > start").select(key, "chunk_no", F.col("start").alias("ps"), F.col("end").alias("pe"), bins().alias("bin"))
    both = g.join(p, [key, "bin"]).where("start < pe and ps < end")
    over = F.least("end", "pe") - F.greatest("start", "ps")
    best = both.withColumn("over", over).groupBy(key, "span_no").agg(
        F.max(F.col("over") / (F.greatest("end", "pe") - F.least("start", "ps"))).alias("iou"),
        F.max(F.struct("over", (-F.col("chunk_no")).alias("no"), (F.col("over") / (F.col("pe") - F.col("ps"))).alias("share")))["share"].alias("precision"),
    )
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c)
    return gold.select(key, "span_no").join(best, [key, "span_no"], "left").select(key, "span_no", zero("iou"), zero("precision"))


def _inner(cuts: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """key, n, at: the distinct boundaries inside the documents."""
    return cuts.select(key, "at").join(lengths.select(key, "n"), key).where("at > 0 and at < n").distinct()


def window_scores(gold: DataFrame, predicted: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """key, k, pk, windowdiff of every document of lengths (key, n units), from boundaries (key, at) of both sides.

    k is half the mean length of a gold segment, rounded half to even, and 2 at least. Pk is the share of the n - k windows
    whose ends lie in one segment on one side only, WindowDiff that of windows with different numbers of boundaries; both
    are 0 where no window fits.
    """
    g, p = _inner(gold, lengths, key), _inner(predicted, lengths, key)
    size = lengths.select(key, "n").join(g.groupBy(key).agg(F.count("*").alias("cuts")), key, "left")
    size = size.select(key, "n", F.greatest(F.lit(2), F.bround(F.col("n") / (F.coalesce("cuts", F.lit(0)) + 1) / 2).cast("long")).alias("k"))
    sides = g.select(key, "at", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(p.select(key, "at", F.lit(0).alias("g"), F.lit(1).alias("p")))
    moves = F.explode(F.array(F.struct(F.greatest(F.lit(0), F.col("at") - F.col("k")).alias("pos"), F.lit(1).alias("d")), F.struct(F.col("at").alias("pos"), F.lit(-1).alias("d")))).alias("m")
    events = sides.join(size, key).select(key, F.col("m.pos").alias("pos") if False else moves, "g", "p").select(key, "m.pos", (F.col("g") * F.col("m.d")).alias("g"), (F.col("p") * F.col("m.d")).alias("p"))
    events = events.unionByName(size.select(key, F.lit(0).cast("long").alias("pos"), F.lit(0).alias("g"), F.lit(0).alias("p")))
    events = events.groupBy(key, "pos").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    by = W.partitionBy(key).orderBy("pos")
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    held = events.select(key, "pos", F.sum("g").over(so_far).alias("g"), F.sum("p").over(so_far).alias("p"), F.lead("pos").over(by).alias("next")).join(size, key)
    span = F.greatest(F.lit(0), F.least(F.coalesce("next", F.col("n") - F.col("k")), F.col("n") - F.col("k")) - F.col("pos"))
    sums = held.withColumn("span", span).groupBy(key).agg(
        F.max("k").alias("k"), F.max(F.col("n") - F.col("k")).alias("windows"),
        F.sum(F.when((F.col("g") == 0) != (F.col("p") == 0), F.col("span")).otherwise(0)).alias("pk"), F.sum(F.when(F.col("g") != F.col("p"), F.col("span")).otherwise(0)).alias("wd"),
    )
    share = lambda c: F.when(F.col("windows") > 0, F.round(F.col(c) / F.col("windows"), 6)).otherwise(0.0)
    return sums.select(key, "k", share("pk").alias("pk"), share("wd").alias("windowdiff"))


def boundary_edits(gold: list[int], predicted: list[int], near: int = 2) -> tuple[int, list[int], int]:
    """(equal boundaries, distances of near misses, boundaries of one side only): the alignment of two sets of positions with the most near misses.

    A near miss is a pair less than near units apart of boundaries that have no equal. In the merged order a boundary is
    paired with the earliest one of the other side that still waits within reach, which leaves the fewest alone.
    """
    g, p = set(gold), set(predicted)
    waiting: list[tuple[int, bool]] = []
    missed, alone = [], 0
    for at, side in sorted([(x, False) for x in g - p] + [(x, True) for x in p - g]):
        while waiting and at - waiting[0][0] >= near:
            waiting.pop(0)
            alone += 1
        if waiting and waiting[0][1] != side:
            missed.append(at - waiting.pop(0)[0])
        else:
            waiting.append((at, side))
    return len(g & p), missed, alone + len(waiting)


def boundary_similarity(gold: DataFrame, predicted: DataFrame, lengths: DataFrame, key: str, near: int = 2) -> DataFrame:
    """key, similarity: one less the edits for each boundary, by boundary_edits; a near miss at distance d is d / near of an edit.

    Documents without any boundary inside have 1.
    """
    g, p = _inner(gold, lengths, key), _inner(predicted, lengths, key)
    kind = lengths.schema[key].dataType.simpleString()
    sides = g.select(key, "at", F.lit(True).alias("gold")).unionByName(p.select(key, "at", F.lit(False).alias("gold")))
    lists = sides.groupBy(key).agg(F.collect_list(F.when(F.col("gold"), F.col("at"))).alias("g"), F.collect_list(F.when(~F.col("gold"), F.col("at"))).alias("p"))

    def run(frames):
        for pdf in frames:
            rows = []
            for k, own, other in zip(pdf[key], pdf["g"], pdf["p"], strict=True):
                same, missed, alone = boundary_edits([int(x) for x in own], [int(x) for x in other], near)
                rows.append((k, round(1 - (alone + sum(missed) / near) / (same + len(missed) + alone), 6)))
            yield pd.DataFrame(rows, columns=[key, "similarity"])

    found = lists.mapInPandas(run, f"{key} {kind}, similarity double")
    return lengths.select(key).join(found, key, "left").select(key, F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
