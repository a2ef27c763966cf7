"""Evaluation of answers and contexts: relevance, key terms, diversity gates, scope, supplied judge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T


def answer_relevance(answer: Column, context: Column) -> Column:
    """AGG24: the share of the answer's distinct tokens that the context has; 0 if either is blank."""
    a, c = T.token_set(answer), T.token_set(context)
    share = F.when(F.size(a) > 0, F.size(F.array_intersect(a, c)) / F.size(a)).otherwise(F.lit(0.0))
    return F.when((F.coalesce(T.strip(answer), F.lit("")) == "") | (F.coalesce(T.strip(context), F.lit("")) == ""), F.lit(0.0)).otherwise(share)


def key_term_coverage(question: Column, context: Column) -> Column:
    """AGG24: the share of the question's words of four letters or more that the context holds as strings; 1 without such words."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9_]{4,}"), F.lit(0)))
    low = F.lower(context)
    return F.round(F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms)).otherwise(F.lit(1.0)), 4)


def overall(precision: Column, relevance: Column) -> Column:
    """AGG24: 0.6 of the retrieval precision and 0.4 of the answer's relevance."""
    return F.round(precision * 0.6 + relevance * 0.4, 4)


def mean_scores(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """AGG29: one row of each metric's mean over the samples that have one (null and NaN don't count; 0 without any), and how many have."""
    valid = lambda m: F.when(F.isnan(m), None).otherwise(F.col(m).cast("double"))
    return rows.agg(*[F.round(F.coalesce(F.avg(valid(m)), F.lit(0.0)), 6).alias(m) for m in metrics], *[F.count(valid(m)).alias(f"{m}_n") for m in metrics])


def duplicate_rate(selected: DataFrame, q: str, rank: str, text: str, threshold: float = 0.70) -> DataFrame:
    """AGG20: q, items, chars and duplicate_rate: the share of a question's rows that are too like an earlier one (Jaccard of token sets, inclusive).

    A question's selection is a bounded list; rows are compared with the rows before them in an array, without a join.
    """
    lists = selected.groupBy(q).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), T.token_set(text).alias("t")))).alias("l"), F.sum(F.length(text)).alias("chars"))
    like = lambda a, b: T.jaccard(a["t"], b["t"]) >= threshold
    repeats = F.filter("l", lambda x, i: F.exists(F.slice("l", F.lit(1), i), lambda y: like(x, y)))
    return lists.select(q, F.size("l").alias("items"), "chars", F.round(F.size(repeats) / F.size("l"), 4).alias("duplicate_rate"))


def strategy_metrics(selected: DataFrame, expected: DataFrame, q: str, rank: str, text: str, source: str) -> DataFrame:
    """AGG20: duplicate_rate()'s columns with source_coverage (of the expected sources) and groundedness (of the required facts found in the selection).

    expected: q, sources and facts (arrays). Without expected sources coverage is 0, without facts groundedness is 1.
    """
    found = selected.groupBy(q).agg(F.collect_set(source).alias("have"), F.lower(F.array_join(F.collect_list(text), " ")).alias("joined"))
    rows = duplicate_rate(selected, q, rank, text).join(found, q).join(expected, q)
    want, facts = F.array_distinct("sources"), F.col("facts")
    coverage = F.when(F.size(want) > 0, F.size(F.array_intersect("have", want)) / F.size(want)).otherwise(F.lit(0.0))
    hits = F.when(F.size(facts) > 0, F.size(F.filter(facts, lambda f: F.contains("joined", F.lower(f)))) / F.size(facts)).otherwise(F.lit(1.0))
    return rows.select(q, "items", "chars", "duplicate_rate", F.round(coverage, 4).alias("source_coverage"), F.round(hits, 4).alias("groundedness"))


def diversity_gate(current: DataFrame, candidate: DataFrame, least: float = 0.10) -> DataFrame:
    """AGG20: one row of both strategies' means, the reduction of the duplicate rate, and whether it is enough without loss of coverage or groundedness."""
    names = ["duplicate_rate", "source_coverage", "groundedness"]
    means = lambda df, p: df.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(f"{p}_{c}") for c in names])
    both = means(current, "current").crossJoin(means(candidate, "candidate"))
    c = lambda name: F.col(name)
    reduction = F.round(F.when(c("current_duplicate_rate") > 0, (c("current_duplicate_rate") - c("candidate_duplicate_rate")) / c("current_duplicate_rate")).otherwise(0.0), 4)
    kept = (c("candidate_source_coverage") >= c("current_source_coverage")) & (c("candidate_groundedness") >= c("current_groundedness"))
    return both.withColumn("reduction", reduction).withColumn("passed", (c("reduction") >= least) & kept)


def insufficient(answer: Column) -> Column:
    """AGG27: whether an answer says that the context doesn't suffice."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return low.contains("cannot answer") | low.contains("missing information:") | low.contains('"insufficient_context"') | low.contains("outside my knowledge")


def scope_rows(rows: DataFrame) -> DataFrame:
    """AGG27: per question term_recall, source_recall, candidate_source_recall, dropped (expected urls found but not kept), forbidden_hits, insufficient.

    rows: id, out_of_scope, answer, context, expected_terms, expected_urls, forbidden_terms, retrieved, fused, final (arrays of urls).
    """
    low, said = F.lower(F.coalesce("context", F.lit(""))), F.lower(F.coalesce("answer", F.lit("")))
    terms, urls = F.array_distinct("expected_terms"), F.array_distinct("expected_urls")
    share = lambda found, of: F.round(found / F.greatest(F.lit(1), F.size(of)), 6)
    found = F.array_intersect(urls, "fused")
    return rows.select(
        "id", F.coalesce("out_of_scope", F.lit(False)).alias("out_of_scope"), share(F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))), terms).alias("term_recall"), share(F.size(F.array_intersect(urls, "retrieved")), urls).alias("source_recall"),
        share(F.size(found), urls).alias("candidate_source_recall"), F.array_sort(F.array_except(found, "final")).alias("dropped"), F.filter("forbidden_terms", lambda t: F.contains(said, F.lower(t))).alias("forbidden_hits"), insufficient(F.col("answer")).alias("insufficient"),
    )


def scope_metrics(rows: DataFrame) -> DataFrame:
    """AGG27: one row of means over scope_rows(); recalls count questions in scope only, refusals those out of scope."""
    inside = ~F.col("out_of_scope")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(inside, F.col(c))), F.lit(0.0)), 6)
    rate = lambda hit, of: F.round(F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0)), 6)
    return rows.agg(
        F.count("*").alias("queries"), F.count_if(inside).alias("in_scope"), *[mean(c).alias(f"avg_{c}") for c in ("term_recall", "source_recall", "candidate_source_recall")],
        rate(F.col("insufficient"), inside).alias("insufficient_rate"), rate(F.col("insufficient"), ~inside).alias("refusal_rate"),
        F.count_if(inside & (F.size("dropped") > 0)).alias("dropping"), F.count_if(inside & (F.size("forbidden_hits") > 0)).alias("forbidden"),
    )
