"""Steps over ranked lists: caps, normalisation, reordering, compression, greedy selection.

Greedy steps depend on the order of one question's bounded list, and run as a grouped
Pandas function a question.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T


def min_max(df: DataFrame, q: str, score: str) -> DataFrame:
    """WIN8: score scaled to 0..1 within a question; as it is where there is one row or all are equal."""
    w = W.partitionBy(q)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("scaled", F.when(hi > lo, F.round((F.col(score) - lo) / (hi - lo), 6)).otherwise(F.col(score)))


def gate(df: DataFrame, q: str, confidence: str, threshold: float) -> DataFrame:
    """FLT15: whether the best row of the question is confident enough to answer."""
    return df.withColumn("answerable", F.max(confidence).over(W.partitionBy(q)) >= threshold)


def per_group_cap(df: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """WIN2: at most cap rows of each group, by order."""
    return df.withColumn("in_group", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("in_group") <= cap)


def lost_in_middle(df: DataFrame, q: str, rank: str) -> DataFrame:
    """WIN9: positions 1, 3, 5... for the better half by rank, and 2, 4, 6... from the worst row up, if a question has more than three."""
    n, r = F.count("*").over(W.partitionBy(q)), F.col(rank)
    return df.withColumn("position", F.when(n <= 3, r).when(r <= F.ceil(n / 2), 2 * r - 1).otherwise(2 * (n - r + 1)).cast("long"))


def compression_scores(df: DataFrame, question: str, text: str) -> DataFrame:
    """TOP12: 0.6 times the token cosine and 0.4 times the share of the question's tokens that the text has."""
    q, t = T.token_set(question), T.token_set(text)
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))
    return df.withColumn("relevance", F.round(T.token_cosine(q, t) * 0.6 + overlap * 0.4, 6))


def _tokens(text: str | None) -> frozenset[str]:
    return frozenset(re.findall(r"[a-z0-9_]+", (text or "").lower()))


def _close(a: frozenset, b: frozenset) -> float:
    return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0


def mmr(df: DataFrame, q: str, doc: str, rank: str, confidence: str, text: str, weight: float = 0.5) -> DataFrame:
    """TOP11: every row again, by maximal marginal relevance: weight * confidence - (1 - weight) * the likeness to what is placed."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank, kind="stable")
        left = [(r[0], r[1], _tokens(r[2])) for r in zip(pdf[doc], pdf[confidence], pdf[text], strict=True)]
        like, out = [0.0] * len(left), []
        while left:
            k = max(range(len(left)), key=lambda i: weight * left[i][1] - (1 - weight) * like[i])
            placed = left.pop(k)
            like.pop(k)
            like = [max(s, _close(x[2], placed[2])) for s, x in zip(like, left, strict=True)]
            out.append(placed[0])
        return pd.DataFrame({q: pdf[q].iloc[0], doc: out, "position": range(1, len(out) + 1)})

    return df.select(q, doc, rank, confidence, text).groupBy(q).applyInPandas(run, f"{q} {kinds[q]}, {doc} {kinds[doc]}, position int")


def greedy_dedup(df: DataFrame, q: str, doc: str, rank: str, text: str, threshold: float, inclusive: bool, fillers: bool = False) -> DataFrame:
    """DDP3/DDP4: rows whose word sets aren't too like those of a row kept before.

    DDP3 is threshold 0.7, exclusive, on white-space words without fillers; DDP4 0.85, inclusive, on [a-z0-9_] tokens.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    drop = frozenset(T.FILLERS)

    def bag(t):
        return frozenset((t or "").lower().split()) - drop if fillers else _tokens(t)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for d, r, t in pdf.sort_values(rank, kind="stable")[[doc, rank, text]].itertuples(index=False):
            b = bag(t)
            like = (len(b & x) / len(b | x) if b and x else 0.0 for x in kept)
            if not any(s >= threshold if inclusive else s > threshold for s in like):
                kept.append(b)
                out.append((d, r))
        return pd.DataFrame({q: pdf[q].iloc[0], doc: [d for d, _ in out], rank: [r for _, r in out]})

    return df.select(q, doc, rank, text).groupBy(q).applyInPandas(run, f"{q} {kinds[q]}, {doc} {kinds[doc]}, {rank} {kinds[rank]}")


def trigram_maxsim(question: str | None, text: str | None) -> float:
    """TOP9: mean over the question's words of the best share of character trigrams that a word of the text has in common; of all words of both."""

    def grams(word: str) -> frozenset[str]:
        return frozenset(word[i : i + 3] for i in range(max(1, len(word) - 2)))

    qs = [grams(w) for w in re.findall(r"\w+", (question or "").lower())]
    ds = list(set(map(grams, set(re.findall(r"\w+", (text or "").lower())))))
    if not qs or not ds:
        return 0.0
    having = defaultdict(list)
    for i, d in enumerate(ds):
        for g in d:
            having[g].append(i)

    def best(q: frozenset[str]) -> float:
        shared = Counter(i for g in q for i in having.get(g, ()))
        return max((n / max(len(q), len(ds[i])) for i, n in shared.items()), default=0.0)

    like = {q: best(q) for q in set(qs)}
    return sum(like[q] for q in qs) / len(qs)


def maxsim_rerank(df: DataFrame, q: str, question: str, text: str, k: int) -> DataFrame:
    """TOP9: the k best rows of a question by scaled trigram likeness; a list no longer than k stays as it is."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([trigram_maxsim(x, y) for x, y in zip(a, b, strict=True)])

    scored = df.withColumn("likeness", F.round(score(question, text), 6)).withColumn("n", F.count("*").over(W.partitionBy(q)))
    scored = min_max(scored, q, "likeness")
    place = F.row_number().over(W.partitionBy(q).orderBy(F.col("scaled").desc(), "rank"))
    return scored.withColumn("position", F.when(F.col("n") > k, place).otherwise(F.col("rank"))).where(F.col("position") <= F.greatest(F.lit(k), F.when(F.col("n") <= k, F.col("n")).otherwise(k)))


def sigmoid(c: Column) -> Column:
    """FN21."""
    return 1 / (1 + F.exp(-c))


def clamped(c: Column) -> Column:
    """FN21: a confidence between 0 and 1; null and NaN count as 0."""
    return F.when(F.isnan(c) | c.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def score_rerank(df: DataFrame, q: str, logit: str, k: int) -> DataFrame:
    """TOP7/TOP10: the k best rows of a question by a scorer's raw score (sigmoid, then min-max within the question), with confidence and position.

    A question with no more than k rows stays in its order, with the confidence it had.
    """
    scored = df.withColumn("_s", sigmoid(F.col(logit)))
    scaled = min_max(scored, q, "_s").withColumn("_n", F.count("*").over(W.partitionBy(q)))
    place = F.row_number().over(W.partitionBy(q).orderBy(F.desc("scaled"), "rank"))
    out = scaled.withColumn("position", F.when(F.col("_n") > k, place).otherwise(F.row_number().over(W.partitionBy(q).orderBy("rank"))))
    out = out.withColumn("confidence", F.when(F.col("_n") > k, F.round("scaled", 6)).otherwise(F.col("confidence")))
    return out.where((F.col("_n") <= k) | (F.col("position") <= k)).drop("_s", "_n", "scaled")


def provider_rerank(df: DataFrame, rankings: DataFrame, q: str, doc: str, k: int) -> DataFrame:
    """TOP8: a provider's scores (q, doc, score) on a question's rows: scaled within the question, unranked rows after the ranked ones in their order, k at most.

    confidence is the scaled score (as it is where all are equal), 0 for unranked rows; a question without any ranking is
    cut to its first k rows and keeps its confidence.
    """
    both = df.join(rankings.select(q, doc, F.col("score").alias("_score")), [q, doc], "left")
    w = W.partitionBy(q)
    lo, hi, any_ = F.min("_score").over(w), F.max("_score").over(w), F.count("_score").over(w) > 0
    value = F.when(F.col("_score").isNull(), F.lit(0.0)).when(hi > lo, (F.col("_score") - lo) / (hi - lo)).otherwise(F.col("_score"))
    out = both.withColumn("_any", any_).withColumn("_value", value)
    key = F.when(F.col("_any") & F.col("_score").isNull(), F.lit(-1.0)).when(F.col("_any"), F.col("_value")).otherwise(F.lit(0.0))
    place = F.row_number().over(w.orderBy(key.desc(), "rank"))
    out = out.withColumn("confidence", F.when(F.col("_any"), F.round("_value", 6)).otherwise(F.col("confidence"))).withColumn("position", place)
    return out.where(F.col("position") <= k).drop("_score", "_any", "_value")


def ranks(df: DataFrame, q: str, order: list, first: int = 1) -> DataFrame:
    """WIN1: the rank of each row within its question, from 0 or 1."""
    return df.withColumn("rank", (F.row_number().over(W.partitionBy(q).orderBy(*order)) + (first - 1)).cast("long"))


def numbered(chunks: DataFrame, doc: str, order: str) -> DataFrame:
    """WIN10: chunk_index from 0 and total_chunks of each document."""
    w = W.partitionBy(doc)
    return chunks.withColumn("chunk_index", (F.row_number().over(w.orderBy(order)) - 1).cast("long")).withColumn("total_chunks", F.count("*").over(w))


def prefix_budget(df: DataFrame, q: str, rank: str, size: str, budget: int, between: int = 2) -> DataFrame:
    """WIN3: the rows of a question up to the one that would pass the budget, with the characters used so far."""
    w = W.partitionBy(q).orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(F.col(size) + between).over(w)).where(F.col("used") <= budget)


def segment_offsets(segments: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """WIN4: start and end of each segment in the text that all segments of a document make."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = segments.withColumn("start_offset", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)))
    return out.withColumn("end_offset", F.col("start_offset") + F.length(text))


def select_context(df: DataFrame, q: str, doc: str, rank: str, url: str, size: str, budget: int, per_url: int) -> DataFrame:
    """TOP13: a place for the best row of each url, then more rows by rank, per_url at most, while the budget lasts.

    size: characters of a row as formatted, two more go between rows. A row that doesn't fit is passed over; the first is
    always placed. Returns every decision: doc, rank, position (null if dropped), reason; a row dropped in both passes has two.

    A question's trials are its rows once for coverage and once for depth, in order; one fold over them keeps the
    characters used and the decisions made, and reads off the latter what each trial depends on.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    entry = f"struct<doc:{kind[doc]},rank:{kind[rank]},url:{kind[url]},position:int,reason:string>"
    row = F.struct(F.col(rank).alias("rank"), F.col(doc).alias("doc"), F.col(url).alias("url"), F.col(size).cast("long").alias("size"))
    lists = df.groupBy(q).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    trials = F.flatten(F.transform(F.array(F.lit(False), F.lit(True)), lambda deep: F.transform("rows", lambda r: F.struct(deep.alias("deep"), r.alias("r")))))

    def decide(acc, trial):
        deep, r, chosen = trial["deep"], trial["r"], F.filter(acc["log"], lambda x: x["position"].isNotNull())
        of_url = F.size(F.filter(chosen, lambda x: x["url"].eqNullSafe(r["url"])))
        open_ = F.when(deep, (of_url > 0) & ~F.exists(chosen, lambda x: x["doc"].eqNullSafe(r["doc"]))).otherwise(of_url == 0)
        fits = (F.size(chosen) == 0) | (acc["used"] + r["size"] + 2 <= budget)
        reason = F.when(deep & (of_url >= per_url), "dropped_due_per_source_cap").when(fits, "selected").otherwise("dropped_due_total_context_budget")
        said = F.struct(r["doc"].alias("doc"), r["rank"].alias("rank"), r["url"].alias("url"), F.when(reason == "selected", F.size(chosen) + 1).cast("int").alias("position"), reason.alias("reason"))
        taken = F.when(open_ & (reason == "selected"), r["size"] + 2).otherwise(F.lit(0))
        return F.struct((acc["used"] + taken).cast("long").alias("used"), F.when(open_, F.concat(acc["log"], F.array(said))).otherwise(acc["log"]).alias("log"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{entry}>").alias("log"))
    said = lists.select(q, F.explode(F.aggregate(trials, start, decide)["log"]).alias("x"))
    return said.select(q, F.col("x.doc").alias(doc), F.col("x.rank").alias(rank), "x.position", "x.reason")


def history_budget(turns: DataFrame, budget: int) -> DataFrame:
    """WIN12: the turns of a conversation that fit the budget, newest first; a turn too long is passed over."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, used = [], 0
        for t, n in pdf.sort_values("turn", ascending=False, kind="stable")[["turn", "tokens"]].itertuples(index=False):
            if used + n <= budget:
                used += n
                kept.append((t, n))
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0], "turn": [t for t, _ in kept], "tokens": [n for _, n in kept]}).astype({"turn": "int64", "tokens": "int64"})

    return turns.select("conv_id", "turn", F.col("tokens").cast("long").alias("tokens")).groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, tokens long")
