"""Evaluation: retrieval and ranking metrics, assembly, chunking, groundedness, drift, distributions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.quantiles import with_percentiles
from skein.operators.search import small
from skein.plans.runtime import prepare, stage


def retrieval_rows(ranked: DataFrame, relevant: DataFrame, q: str, item: str, k: int) -> DataFrame:
    """AGG5: per question recall and precision of the first k, and the reciprocal rank over the whole list.

    relevant: q, item. Precision divides by k even for short lists; a repeated item counts again, so recall can pass 1.
    """
    hits = ranked.join(relevant.select(q, item).withColumn("_rel", F.lit(1)), [q, item], "left")
    total = relevant.groupBy(q).agg(F.countDistinct(item).alias("_n"))
    per = hits.groupBy(q).agg(F.sum(F.when(F.col("rank") <= k, F.coalesce("_rel", F.lit(0))).otherwise(0)).alias("hits"), F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("first"))
    out = per.join(total, q, "left")
    return out.select(q, F.coalesce(F.round(F.col("hits") / F.col("_n"), 6), F.lit(1.0)).alias("recall"), F.round(F.col("hits") / k, 6).alias("precision"), F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("mrr"))


def ndcg(ranked: DataFrame, q: str, gain: str, k: int) -> DataFrame:
    """AGG7: dcg, ideal and ndcg of the first k by rank (from 1), with gain 2^rel - 1; the ideal is of the list itself."""
    discounted = lambda r: (F.pow(F.lit(2.0), F.col(gain)) - 1) / F.log2(F.col(r) + 1)
    w = W.partitionBy(q).orderBy(F.col(gain).desc(), "rank")
    rows = ranked.withColumn("_ideal", F.row_number().over(w))
    out = rows.groupBy(q).agg(F.sum(F.when(F.col("rank") <= k, discounted("rank")).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("_ideal") <= k, discounted("_ideal")).otherwise(0.0)).alias("ideal"))
    return out.select(q, F.round("dcg", 6).alias("dcg"), F.round("ideal", 6).alias("ideal"), F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"))


def size_stats(chunks: DataFrame, by: str, n: str, text: str, most_chars: int = 6000, most_tokens: int = 3800, least_chars: int = 50) -> DataFrame:
    """AGG3/AGG4: sizes by group; exact, linearly interpolated percentiles, and counts of odd sizes."""
    out = chunks.groupBy(by).agg(
        F.count("*").alias("n"), F.min(n).alias("min"), F.max(n).alias("max"), F.round(F.avg(n), 1).alias("mean"),
        F.count_if(T.strip(text) == "").alias("empty"), F.count_if(F.col(n) > most_chars).alias("oversized"),
        F.count_if(F.ceil(F.col(n) / 4) > most_tokens).alias("over_tokens"), F.count_if(F.col(n) < least_chars).alias("tiny"),
    )
    names = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    return with_percentiles(out, chunks.select(by, n), [by], n, names).withColumns({c: F.round(c, 4) for c in names})


def groundedness(claims: DataFrame, evidence: DataFrame, key: str, threshold: float = 0.3) -> DataFrame:
    """AGG22: per key the claims, those supported by some text, and the mean of the best overlaps.

    claims: key, claim_no, claim; evidence: key, text. Overlap: the share of the claim's tokens that a text has.
    """
    c = claims.select(key, "claim_no", T.token_set("claim").alias("ct"))
    e = evidence.select(key, T.token_set("text").alias("et"))
    best = c.join(e, key, "left").groupBy(key, "claim_no").agg(F.max(F.when(F.size("ct") > 0, F.size(F.array_intersect("ct", "et")) / F.size("ct")).otherwise(0.0)).alias("o"))
    return best.groupBy(key).agg(F.count("*").alias("claims"), F.count_if(F.col("o") >= threshold).alias("supported"), F.round(F.avg(F.coalesce("o", F.lit(0.0))), 4).alias("score"))


def token_f1(a: Column, b: Column) -> Column:
    """AGG23: harmonic mean of the shares of common distinct tokens."""
    x, y = T.token_set(a), T.token_set(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(both > 0, F.round(2.0 * both / (F.size(x) + F.size(y)), 6)).otherwise(F.lit(0.0))


def medoid(rows: DataFrame, group: str, order: str, text: str, part_rows: int = 512) -> DataFrame:
    """AGG26: the member of each group most like the others by summed Jaccard of white-space words; the first of equals.

    Members of small groups are joined with one another. A group of more than part_rows members is dealt over parts; a task
    has two of them and returns sums, so that no member is sent for each partner and no pairs leave.
    """
    prepare(rows.sparkSession)
    s = rows.select(group, order, F.array_distinct(T.words(F.lower(text))).alias("w"))
    crowd = stage(rows.groupBy(group).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_n")).where("_n > 1"), "medoid-crowd")
    few = s.join(crowd, group, "left_anti")
    pairs = few.alias("a").join(few.alias("b"), (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{order}") != F.col(f"b.{order}")), "left")
    sums = pairs.select(F.col(f"a.{group}").alias(group), F.col(f"a.{order}").alias(order), F.coalesce(T.jaccard(F.col("a.w"), F.col("b.w")), F.lit(0.0)).alias("s"))
    dealt = s.join(crowd, group).withColumn("_p", F.pmod(F.xxhash64(order), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select(group, F.least("_p", "_o").alias("_x"), F.greatest("_p", "_o").alias("_y"), "_p", order, "w")
    kinds = {f.name: f.dataType.simpleString() for f in s.schema}

    def run(table: pa.Table) -> pa.Table:
        x, y, part, orders = (table[c].to_numpy() for c in ("_x", "_y", "_p", order))
        bags = table["w"].to_pylist()
        names: dict[str, int] = {}
        at = [[names.setdefault(t, len(names)) for t in bag or ()] for bag in bags]
        hot = np.zeros((len(bags), len(names)), np.float32)
        for i, cols in enumerate(at):
            hot[i, cols] = 1
        size, out = np.array([len(c) for c in at], float), []
        left, right = np.flatnonzero(part == x[0]), np.flatnonzero(part == y[0])
        both = (hot[left] @ hot[right].T).astype(float)
        every = size[left][:, None] + size[right][None, :] - both
        like = np.where((every > 0) & (orders[left][:, None] != orders[right][None, :]), both / np.maximum(every, 1), 0.0)
        out.append((orders[left], like.sum(axis=1)))
        if x[0] != y[0]:
            out.append((orders[right], like.sum(axis=0)))
        keys, values = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({group: pa.array([table[group][0].as_py()] * len(keys), table.schema.field(group).type), order: pa.array(keys), "s": pa.array(values)})

    large = dealt.groupBy(group, "_x", "_y").applyInArrow(run, f"{group} {kinds[group]}, {order} {kinds[order]}, s double")
    score = sums.unionByName(large).groupBy(group, order).agg(F.round(F.sum("s"), 6).alias("score"))
    return score.groupBy(group).agg(F.max_by(order, F.struct("score", -F.col(order))).alias(order), F.max("score").alias("score"))


def span_iou(gold: DataFrame, predicted: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """AGG10/JN11: per gold span the best intersection over hull with a chunk it overlaps.

    Spans are dealt over bins of width positions that they touch, so the range join is by key and bin.
    """
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    g = gold.where("end > start").select(key, "span_no", "start", "end", bins().alias("bin"))
    p = predicted.where("end > start").select(key, F.col("start").alias("ps"), F.col("end").alias("pe"), bins().alias("bin"))
    over = g.join(p, [key, "bin"]).where("start < pe and ps < end").withColumn("iou", (F.least("end", "pe") - F.greatest("start", "ps")) / (F.greatest("end", "pe") - F.least("start", "ps")))
    best = over.groupBy(key, "span_no").agg(F.max("iou").alias("iou"))
    return gold.select(key, "span_no").join(best, [key, "span_no"], "left").select(key, "span_no", F.round(F.coalesce("iou", F.lit(0.0)), 6).alias("iou"))


def fracture_rate(nodes: DataFrame, cuts: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """JN12: the share of structural nodes (key, start, end) that a cut (key, at) falls strictly inside of; both meet by key and bin of width positions."""
    at = cuts.select(key, "at", F.floor(F.col("at") / width).alias("bin"))
    spread = nodes.select(key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bin"))
    hit = spread.join(at, [key, "bin"]).where((F.col("at") > F.col("start")) & (F.col("at") < F.col("end"))).select(key, "start", "end").distinct()
    hit = nodes.join(hit, [key, "start", "end"], "left_semi").groupBy(key).agg(F.count("*").alias("broken"))
    total = nodes.groupBy(key).agg(F.count("*").alias("nodes"))
    return total.join(hit, key, "left").select(key, "nodes", F.coalesce("broken", F.lit(0)).alias("broken"), F.round(F.coalesce("broken", F.lit(0)) / F.col("nodes"), 6).alias("fracture_rate"))


def pk_windowdiff(reference: list[int], predicted: list[int], k: int | None = None) -> tuple[float, float]:
    """AGG10: Pk and WindowDiff of two segmentations given as segment lengths over the same units."""
    ids = lambda parts: [i for i, n in enumerate(parts) for _ in range(n)]
    r, p = ids(reference), ids(predicted)
    if len(r) != len(p):
        raise ValueError("segmentations of different lengths")
    k = k or max(1, round(len(r) / max(1, len(reference)) / 2))
    n = len(r) - k
    if n <= 0:
        return 0.0, 0.0
    pk = sum((r[i] == r[i + k]) != (p[i] == p[i + k]) for i in range(n)) / n
    wd = sum((r[i + k] - r[i]) != (p[i + k] - p[i]) for i in range(n)) / n
    return pk, wd


def contains_run(docs: DataFrame, needles: DataFrame, key: str, item: str, n: int = 4) -> DataFrame:
    """AGG8/JN8: key, item pairs where a text has n tokens in a row of an item's, with the number of such runs.

    Both sides are cut to distinct runs and joined on them: nothing grows with the square of a text.
    """
    def runs(df, k):
        t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
        r = df.select(k, t.alias("t")).where(F.size("t") >= n)
        return r.select(k, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " ")))).alias("run"))

    return runs(docs, key).join(runs(needles, item), "run").groupBy(key, item).agg(F.count("*").alias("runs"))


def coverage_rows(expected: DataFrame, corpus: DataFrame, by: str) -> DataFrame:
    """AGG21: expected terms (by, term) that no text of the source holds."""
    terms = expected.select(by, F.lower("term").alias("term")).distinct()
    found = corpus.join(small(terms), by).where(F.lower("text").contains(F.col("term"))).select(by, "term").distinct()
    return terms.join(found.withColumn("_f", F.lit(1)), [by, "term"], "left").groupBy(by).agg(F.count("*").alias("terms"), F.count("_f").alias("found"), F.round(F.count("_f") / F.count("*"), 6).alias("term_recall"))


def violations(chunks: DataFrame, key: str, parent: str, text: str, tokens: str, budget: int) -> DataFrame:
    """FLT24/JN14: what is wrong with a set of chunks: repeated ids, blank texts, budgets passed, parents that don't exist."""
    ids = chunks.select(F.col(key).alias(parent)).distinct()
    bad = lambda df, why: df.select(F.lit(why).alias("violation"), F.col(key).cast("string").alias("chunk"))
    repeated = chunks.groupBy(key).count().where("count > 1")
    orphans = chunks.where(F.coalesce(F.col(parent), F.lit("")) != "").join(ids, parent, "left_anti")
    return bad(repeated, "duplicate_id").unionByName(bad(chunks.where(T.strip(text) == ""), "blank_text")).unionByName(bad(chunks.where(F.col(tokens) > budget), "over_budget")).unionByName(bad(orphans, "missing_parent"))
