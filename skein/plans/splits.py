"""Registered queries of reStructuredText, splitting by meaning, how good a split is, and late interaction, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import chunking, late, rst, segmentation
from skein.plans import catalog
from skein.plans.registry import query
from skein.plans.runtime import prepare, table

@query(
    r"""WITH t AS (SELECT doc_id, coalesce(source, 'none') AS s, coalesce(lang, '?') AS l, list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: array_to_string(regexp_extract_all(x, '[A-Za-z]+'), ' ')), lambda x: x <> ''), lambda x: x) AS w FROM documents)
SELECT doc_id, 'Text of ' || s AS title, md5('# Text of ' || s || chr(10) || chr(10) || '**Language:** ' || l || CASE WHEN len(w) > 0 THEN chr(10) || chr(10) || '- ' || array_to_string(w, chr(10) || '- ') || chr(10) || chr(10)
  || '| line | words |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(range(len(w)), lambda i: '| ' || (i + 1) || ' | ' || w[i + 1] || ' |'), chr(10)) || chr(10) || chr(10)
  || '```text' || chr(10) || array_to_string(w, chr(10)) || chr(10) || '```' ELSE '' END) AS md5 FROM t"""
)
def rst_documents(spark, d):
    """PRS6, PRS8: every text's lines as reStructuredText (title, field, bullets, list table, code directive), back as Markdown."""
    line = lambda x: F.array_join(F.regexp_extract_all(x, F.lit("[A-Za-z]+"), F.lit(0)), " ")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line), lambda x: x != "")
    docs = table(prepare(spark), d, "documents").select("doc_id", F.concat(F.lit("Text of "), F.coalesce("source", F.lit("none"))).alias("title"), F.coalesce("lang", F.lit("?")).alias("lang"), lines.alias("w"))
    every = lambda f: F.array_join(F.transform("w", f), "\n")
    body = F.concat(
        F.lit("\n\n"), every(lambda x: F.concat(F.lit("* "), x)), F.lit("\n\n.. list-table::\n   :header-rows: 1\n\n   * - line\n     - words\n"),
        F.array_join(F.transform("w", lambda x, i: F.concat(F.lit("   * - "), i + 1, F.lit("\n     - "), x)), "\n"), F.lit("\n\n.. code-block:: text\n\n"), every(lambda x: F.concat(F.lit("   "), x)),
    )
    made = F.concat("title", F.lit("\n"), F.repeat(F.lit("="), F.length("title")), F.lit("\n\n:Language: "), "lang", F.when(F.size("w") > 0, body).otherwise(""))
    out = rst.rst_to_markdown(docs.select("doc_id", made.alias("text")), "doc_id")
    return out.select("doc_id", "title", F.md5(F.col("markdown").cast("binary")).alias("md5"))


_CUTS = """n AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
gl AS (SELECT doc_id, n, list_transform(range(1, len(ls)), lambda i: list_sum(list_transform(ls[1:i], lambda x: length(x) + 1))) AS g FROM n),
b AS (SELECT doc_id, n, list_filter(g, lambda x: x > 0 AND x < n) AS g, list_filter(range(400, n + 1, 400), lambda x: x < n) AS p FROM gl),
kk AS (SELECT *, greatest(2, CAST(round_even(n / (len(g) + 1) / 2, 0) AS BIGINT)) AS k FROM b)"""


def _line_cuts(docs: DataFrame) -> DataFrame:
    """doc_id, at: where the second and later lines begin."""
    sizes = F.transform(F.split("text", "\n", -1), lambda x: F.length(x) + 1)
    row = docs.where("text is not null").select("doc_id", F.posexplode(sizes).alias("no", "size"))
    ends = F.sum("size").over(W.partitionBy("doc_id").orderBy("no").rowsBetween(W.unboundedPreceding, 0))
    return row.select("doc_id", ends.alias("at"))


@query(
    f"""WITH {_CUTS}, w AS (
  SELECT doc_id, len(list_filter(g, lambda x: x > i AND x <= i + k)) AS a, len(list_filter(p, lambda x: x > i AND x <= i + k)) AS c
  FROM (SELECT *, unnest(range(n - k)) AS i FROM kk)),
s AS (SELECT doc_id, round(count(*) FILTER (WHERE (a = 0) <> (c = 0)) / count(*), 6) AS pk, round(count(*) FILTER (WHERE a <> c) / count(*), 6) AS windowdiff FROM w GROUP BY doc_id)
SELECT doc_id, k, coalesce(pk, 0.0) AS pk, coalesce(windowdiff, 0.0) AS windowdiff FROM kk LEFT JOIN s USING (doc_id)"""
)
def segmentation_windows(spark, d):
    """AGG10: Pk and WindowDiff of windows of 400 characters against the lines of a text."""
    docs = table(spark, d, "documents").where("text is not null")
    cuts = chunking.windows(docs, "doc_id", 400, 0).select("doc_id", F.col("start_offset").cast("long").alias("at"))
    return segmentation.window_scores(_line_cuts(docs), cuts, docs.select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")


_BEFORE = r"CASE WHEN {x} > 0 THEN 1 + len(regexp_extract_all(substr(text, 1, {x}), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+')) - CAST(regexp_matches(substr(text, {x}, 1), '[^\x20\x09-\x0D]') AS INT) ELSE 0 END AS {x}"


@query(
    f"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''),
g AS (SELECT doc_id, text, i AS no, i * 700 AS s, least(length(text), i * 700 + 700) AS e FROM (SELECT *, unnest(range((length(text) + 699) // 700)) AS i FROM d)),
p AS (SELECT doc_id, text, i AS no, i * 900 AS s, least(length(text), i * 900 + 1000) AS e FROM (SELECT *, unnest(range(greatest(1, (length(text) - 100 + 899) // 900))) AS i FROM d)),
t AS (SELECT doc_id, side, no, {_BEFORE.format(x='s')}, {_BEFORE.format(x='e')}
  FROM (SELECT doc_id, text, 'g' AS side, no, s, e FROM g UNION ALL SELECT doc_id, text, 'p', no, s, e FROM p)),
o AS (SELECT a.doc_id, a.no AS span_no, b.no, least(a.e, b.e) - greatest(a.s, b.s) AS over, greatest(a.e, b.e) - least(a.s, b.s) AS hull, b.e - b.s AS size
  FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.side = 'g' AND b.side = 'p' AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e),
r AS (SELECT doc_id, span_no, max(over / hull) AS iou, arg_max(over / size, (over, -no)) AS precision FROM o GROUP BY ALL)
SELECT g.doc_id, CAST(g.no AS INT) AS span_no, coalesce(round(iou, 6), 0.0) AS iou, coalesce(round(precision, 6), 0.0) AS precision
FROM g LEFT JOIN r ON g.doc_id = r.doc_id AND g.no = r.span_no"""
)
def excerpt_scores(spark, d):
    """AGG10: token IoU and excerpt precision of the windows against 700-character spans, in tokens."""
    docs = table(spark, d, "documents")
    span = lambda no, *a: chunking.windows(docs, "doc_id", *a).select("doc_id", F.col("chunk_index").alias(no), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    gold, got = (segmentation.token_spans(docs, s, "doc_id") for s in (span("span_no", 700, 0), span("chunk_no")))
    return segmentation.span_scores(gold, got, "doc_id", 200)


@query()
def boundary_similarities(spark, d):
    """AGG10: boundary similarity of sentences to lines, in words; no SQL, as near misses are an alignment."""
    docs = table(spark, d, "documents").where("text is not null")
    size = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    cuts = lambda by: docs.select("doc_id", F.posexplode(F.transform(F.split("text", by, -1), size)).alias("no", "size"))
    at = F.sum("size").over(W.partitionBy("doc_id").orderBy("no").rowsBetween(W.unboundedPreceding, 0)).cast("long").alias("at")
    return segmentation.boundary_similarity(cuts("\n").select("doc_id", at), cuts(r"(?<=[.!?])\s").select("doc_id", at), docs.select("doc_id", size("text").cast("long").alias("n")), "doc_id")


@query()
def semantic_clusters(spark, d):
    """CHK5: sentences put to the most similar of all clusters of their text, then packed; no SQL, as each step depends on the last."""
    docs = table(prepare(spark), d, "documents")
    return chunking.semantic_clusters(chunking.with_vectors(chunking.sentences(docs, "doc_id")), "doc_id", threshold=0.35, target_words=60, overlap_words=10)


@query()
def late_interaction_topk(spark, d):
    """TOP10: the ten best of all documents for each passage by late interaction; no SQL, as the token vectors are hashes of trigrams."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), "text")
    docs = table(spark, d, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)
    return late.late_search(docs, asked, 10).withColumnRenamed("q_id", "item_id")


@query()
def late_rerank(spark, d):
    """TOP10: the lexical hits of each passage, reranked by late interaction."""
    hits = catalog._hit_texts(spark, d).select("item_id", "doc_id", "rank", F.col("score").alias("confidence"), "question", "text")
    return late.late_rerank(hits, "item_id", "question", "text", 5).select("item_id", "doc_id", "late_score", "confidence", F.col("position").cast("long").alias("position"))
