"""Steps that a model decides, over columns that hold what models said: answers, scores, verdicts, triplets.

Nothing is called from here. A caller scores or generates elsewhere and hands in a column; these operators do what the
product does with it, and its deterministic form where nothing was said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import answers, search

# Fixed value: words of a heading that are no terms.
HEADING_STOPWORDS = "the a an and or of to in on for with from at by as is are this that how what when where which who does do you your use using used set get make".split()


def hashed_vector(c: Column | str, dims: int = 64) -> Column:
    """MDL1's stand-in: a vector of norm 1 that counts the text's tokens by hash, with a sign by hash; zeros without tokens."""
    tokens = T.token_set(c)
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")
    sign = lambda t: F.when(F.pmod(F.xxhash64(F.lit(1), t), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    once = lambda x, of: F.get(F.transform(F.array(x), of), F.lit(0))  # noqa: E731, a value that lambdas use again and again is found once
    pairs = F.transform(tokens, lambda t: F.struct(slot(t).alias("d"), sign(t).alias("s")))
    sums = once(pairs, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(own, lambda p: p["d"] == d), F.lit(0.0), lambda acc, p: acc + p["s"])))
    scaled = once(sums, lambda v: F.array(F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)).alias("n"))))
    return once(F.get(scaled, F.lit(0)), lambda r: F.transform(r["v"], lambda x: F.when(r["n"] > 0, x / r["n"]).otherwise(F.lit(0.0))))


def first_success(calls: DataFrame, key: str, order: str, ok: str, keep: list[str]) -> DataFrame:
    """MDL1/MDL2: of each request's attempts along a chain of providers the first that succeeded; degraded is true if an earlier one failed.

    calls: key, order (place in the chain), ok and the columns to keep. Requests of which all failed have no row.
    """
    good = F.col(ok)
    out = calls.groupBy(key).agg(F.min_by(F.struct(order, *keep), F.when(good, F.col(order))).alias("x"), F.min(order).alias("first"), F.count_if(good).alias("n"))
    return out.where("n > 0").select(key, *[F.col(f"x.{c}").alias(c) for c in keep], (F.col(f"x.{order}") > F.col("first")).alias("degraded"))


def rewritten(question: Column) -> dict[str, Column]:
    """MDL3 by rules: intent, steps, why no made-up answer is searched for (null if one may be), and filters."""
    kind = T.intent(question)
    return {"intent": kind, "steps": answers.sub_questions(question, kind), "hyde_reason": answers.hyde_suppression(question, kind), **answers.inferred_filters(question)}


def corrected(first: DataFrame, expanded: DataFrame, grades: DataFrame, k: int, threshold: float = 0.5) -> DataFrame:
    """MDL4: lists (q_id, vec_id, rank) graded below the threshold are fused with a wider search's list, once; the others stay.

    grades: q_id, grade; a question without a grade counts as relevant, and one whose wider list is empty stays as it is.
    """
    poor = grades.where(F.col("grade") < threshold).select("q_id").join(expanded.select("q_id").distinct(), "q_id", "left_semi").distinct()
    part = lambda df, n: df.join(poor, "q_id", "left_semi").select("q_id", "vec_id", "rank", F.lit(n).alias("list"))
    fused = search.merge_lists(part(first, 0).unionByName(part(expanded, 1)), k)
    kept = first.join(poor, "q_id", "left_anti").select("q_id", "vec_id", F.lit(None).cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))
    return fused.withColumn("expanded", F.lit(True)).unionByName(kept.withColumn("expanded", F.lit(False)))


def unfenced(raw: Column) -> Column:
    """What a model said, without the fence around it."""
    return F.regexp_replace(F.regexp_replace(T.strip(raw), r"(?s)^.*?```(?:json)?[ \t]*\n?", ""), r"(?s)\n?\s*```.*$", "")


def covered(raw: Column) -> Column:
    """MDL5: whether a verdict lets the question through. Only an explicit refusal doesn't; nothing said, or nothing readable, does."""
    body = F.when(raw.contains("```"), unfenced(raw)).otherwise(T.strip(raw))
    verdict = F.lower(F.trim(F.coalesce(F.get_json_object(body, "$.verdict"), F.nullif(F.regexp_extract(body, r'(?i)"verdict"\s*:\s*"([^"]+)"', 1), F.lit("")))))
    flag = F.lower(F.coalesce(F.get_json_object(body, "$.covered"), F.nullif(F.regexp_extract(body, r'(?i)"covered"\s*:\s*(true|false)', 1), F.lit(""))))
    return F.coalesce(F.when(verdict == "does_not_cover", False).when(verdict.isin("covers", "partially"), True), F.when(flag == "false", False).when(flag == "true", True), F.lit(True))


def claim_support(raw: Column, overlap: Column, threshold: float = 0.5) -> dict[str, Column]:
    """MDL6: the share of a judged list of claims (JSON, fenced or not) that are supported, or the lexical overlap where nothing readable was said; supported; the unsupported claims."""
    body = F.when(raw.contains("```"), unfenced(raw)).otherwise(T.strip(raw))
    claims = F.from_json(F.when(body.startswith("["), body), "array<struct<claim:string,supported:boolean>>")
    n = F.size(claims)
    share = F.size(F.filter(claims, lambda c: F.coalesce(c["supported"], F.lit(False)))) / n
    score = F.round(F.when(claims.isNull(), overlap).when(n > 0, share).otherwise(0.0), 6)
    open_ = F.transform(F.filter(claims, lambda c: ~F.coalesce(c["supported"], F.lit(False))), lambda c: F.trim(c["claim"]))
    return {"score": score, "supported": score >= threshold, "unsupported": F.coalesce(open_, F.array().cast("array<string>"))}


def judged(raw: Column, name: str = "score") -> Column:
    """MDL7: a judge's score between 0 and 1 from what it said; 1 where nothing readable was said."""
    body = F.when(raw.contains("```"), unfenced(raw)).otherwise(T.strip(raw))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.get_json_object(body, f"$.{name}").try_cast("double"), F.lit(1.0))))


def triplets(said: DataFrame, key: str, raw: str) -> DataFrame:
    """MDL8: key, source, relation_type, target of the triplets in JSON lists; names in lower case, incomplete ones dropped, equal ones once."""
    rows = said.select(key, F.explode(F.from_json(F.when(F.col(raw).contains("```"), unfenced(F.col(raw))).otherwise(T.strip(raw)), "array<struct<source:string,relation:string,target:string>>")).alias("t"))
    clean = lambda c: F.lower(F.trim(F.col(f"t.{c}")))
    out = rows.select(key, clean("source").alias("source"), F.trim(F.col("t.relation")).alias("relation_type"), clean("target").alias("target"))
    return out.where("source <> '' and relation_type <> '' and target <> ''").distinct()


def suggestions_or(said: DataFrame, rules: DataFrame, q: str, raw: str, n: int = 3) -> DataFrame:
    """MDL11: the first n suggestions a model listed (JSON strings or lines), or those of the rules (q, suggestions) where it gave fewer than n."""
    text = T.strip(raw)
    lines = F.transform(F.split(text, "\n", -1), lambda x: T.strip(F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])\s*", "")))
    listed = F.filter(F.coalesce(F.from_json(F.when(text.startswith("["), text), "array<string>"), lines), lambda x: x != "")
    out = rules.join(said.select(q, listed.alias("l")), q, "left")
    return out.select(q, F.when(F.size("l") >= n, F.slice("l", 1, n)).otherwise(F.col("suggestions")).alias("suggestions"))


def recalled(hits: DataFrame, cache: DataFrame, now: float, ttl: float, least_confidence: float) -> DataFrame:
    """MDL12: the best cached answer of each question that is fresh, cacheable and confident enough; questions without one fall through.

    hits: q_id, cache_id, similarity; cache: cache_id, answer, confidence, n_sources, created_at.
    """
    good = cache.where((F.col("created_at") > now - ttl) & (F.col("confidence") >= least_confidence) & T.cacheable(F.col("answer"), F.col("confidence"), F.col("n_sources")))
    both = hits.join(good, "cache_id")
    return both.groupBy("q_id").agg(F.max_by(F.struct("cache_id", "answer", "similarity"), F.struct("similarity", -F.col("cache_id"))).alias("x")).select("q_id", "x.cache_id", "x.answer", "x.similarity")


def heading_terms(heading: Column, most: int = 3) -> Column:
    """FN30: the first distinct words of a heading (by any case) that aren't stop words."""
    words = F.filter(F.regexp_extract_all(heading, F.lit(r"[A-Za-z][A-Za-z0-9_.-]{2,}"), F.lit(0)), lambda w: ~F.lower(w).isin(HEADING_STOPWORDS))
    low = F.transform(words, lambda w: F.lower(w))
    return F.slice(F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, most)


def synthetic_rows(chunks: DataFrame, source: str) -> DataFrame:
    """MDL13/FN30: evaluation rows from headings: id, question, url, terms, doc_type; at least two of the terms must stand in the text.

    chunks: url, title, heading_path, text, doc_type, ord. A heading met before gets its place in the order as a suffix.
    """
    heading = F.coalesce(F.nullif(F.array_join("heading_path", " "), F.lit("")), F.col("title"))
    rows = chunks.withColumn("url", F.regexp_replace(T.strip("url"), "/+$", "")).withColumn("heading", heading).where("url <> '' and length(heading) >= 8")
    rows = rows.withColumn("terms", F.filter(heading_terms(F.col("heading")), lambda t: F.contains(F.lower("text"), F.lower(t)))).where(F.size("terms") >= 2)
    slug = F.regexp_replace(F.substring(T.slug("heading"), 1, 40), "-+$", "")
    rows = rows.withColumn("slug", F.when(slug == "", "row").otherwise(slug))
    again = F.row_number().over(W.partitionBy("slug").orderBy("ord"))
    name = F.concat(F.lit("synthetic-"), F.col("slug"), F.when(again > 1, F.concat(F.lit("-"), F.col("ord").cast("string"))).otherwise(""))
    question = F.concat(F.lit("What does '"), F.col("heading"), F.lit(f"' cover in {source}?"))
    return rows.select(name.alias("id"), question.alias("question"), "url", "terms", F.coalesce(F.nullif("doc_type", F.lit("")), F.lit("guide")).alias("doc_type"))
