"""Registered queries of the document operators, each over whole tables, with DuckDB SQL where SQL can say it.

Search queries take the benchmark passages as questions, or every vector whose id is divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import answers, chunking, crawl, dedup, ivf, metrics, pages, ranking, search, series
from skein.plans.registry import Query, query
from skein.plans.runtime import prepare, stage
from skein.plans.runtime import spread_table as table
from skein.sources import files

def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- lexical and dense search ------------------------------------------------------------------------------------------
_TOK = rf"list_filter(regexp_extract_all(lower(text), '[a-z0-9_\-]{{2,}}'), lambda t: NOT list_contains({_list(T.STOPWORDS)}, t))"


def _posts(name: str, key: str, source: str) -> str:
    return f"""{name} AS (
  SELECT {key}, token, count(*) AS n, any_value(len) AS len
  FROM (SELECT {key}, len(toks) AS len, unnest(toks) AS token FROM (SELECT {key}, {_TOK} AS toks FROM {source})) GROUP BY {key}, token)"""


_W = "(ln(({n_docs} - df + 0.5) / (df + 0.5) + 1) * (n / len) * 2.2 / ((n / len) + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)))".replace("{n_docs}", "n_docs")


def _bm25(k: int, source: str = "documents", key: str = "doc_id", name: str = "hits") -> str:
    return f"""{_posts('posts', key, source)}, {_posts('asked', 'item_id', 'benchmark')},
dfs AS (SELECT token, count(*) AS df FROM posts GROUP BY token),
st AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM (SELECT {key}, any_value(len) AS len FROM posts GROUP BY {key})),
wd AS (SELECT {key}, token, {_W} AS wd FROM posts JOIN dfs USING (token), st),
wq AS (SELECT item_id, token, {_W} AS wq FROM asked JOIN dfs USING (token), st),
sums AS (SELECT item_id, {key}, round(sum(wq * wd), 6) AS score FROM wd JOIN wq USING (token) GROUP BY item_id, {key}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {key}) AS rank FROM sums) WHERE rank <= {k})"""


def _hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return search.bm25_search(table(spark, d, "documents"), table(spark, d, "benchmark"), k)


@query(f"WITH {_bm25(10)} SELECT item_id, doc_id, score, rank FROM hits")
def bm25_topk(spark, d):
    """Slice 0: FN6, AGG1, FN8, JN3, TOP2."""
    return _hits(spark, d).select("item_id", "doc_id", "score", "rank")


@query(f"WITH {_posts('posts', 'doc_id', 'documents')} SELECT token, count(*) AS df, CAST(sum(n) AS BIGINT) AS n FROM posts GROUP BY token")
def bm25_vocab_stats(spark, d):
    """AGG1."""
    return search.postings(table(spark, d, "documents"), "doc_id").groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("n"))


_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), qs AS (SELECT vec_id AS q_id, e AS q FROM v WHERE vec_id % 20 = 0)"


def _dense_sql(name: str, k: int, dims: int | None = None, pool: str = "v") -> str:
    cut = (lambda x: f"{x}[1:{dims}]") if dims else (lambda x: x)
    return f"""{name} AS (
  SELECT * FROM (SELECT q_id, vec_id, confidence, row_number() OVER (PARTITION BY q_id ORDER BY confidence DESC, vec_id) AS rank FROM (
    SELECT q_id, vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity({cut('e')}, {cut('q')}))), 6) AS confidence
    FROM {pool} JOIN qs ON vec_id <> q_id)) WHERE rank <= {k})"""


def _asked_vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))


@query(f"WITH {_VEC}, {_dense_sql('hits', 10)} SELECT q_id, vec_id, confidence, round(1 - confidence, 6) AS distance, rank FROM hits")
def dense_topk_cosine(spark, d):
    """TOP1, FN4, JN4."""
    return search.dense_search(*_asked_vectors(spark, d), 10)


@query()
def ivf_topk(spark, d):
    """TOP1, JN4: the nearest 0.4 of the cells of an inverted-file index, exact scores; scored is how many vectors a question met."""
    v, qs = _asked_vectors(spark, d)
    index = ivf.build(v)
    return ivf.search(index, qs, 10, probes=max(1, int(0.4 * len(index.centres))))


@query(f"WITH {_VEC}, {_dense_sql('hits', 10)} SELECT q_id, vec_id, confidence, rank FROM hits")
def ivf_exact_topk(spark, d):
    """TOP1, JN4: the same index, read on until no other cell can hold one of the ten best."""
    v, qs = _asked_vectors(spark, d)
    index = ivf.build(v)
    return ivf.search(index, qs, 10, probes=max(1, len(index.centres) // 3), exact=True).select("q_id", "vec_id", "confidence", "rank")


@query(
    f"""WITH {_VEC}, {_dense_sql('first', 40, 16)},
full_ AS (SELECT f.q_id, f.vec_id, round(greatest(0.0, list_cosine_similarity(e, q)), 6) AS confidence FROM first f JOIN v USING (vec_id) JOIN qs USING (q_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY confidence DESC, vec_id) AS rank FROM full_) WHERE rank <= 10"""
)
def mrl_two_stage_topk(spark, d):
    """TOP4, FN19."""
    return search.mrl_search(*_asked_vectors(spark, d), 10, 16)


@query(
    f"""WITH {_bm25(40, name='sparse')}, v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
qs AS (SELECT vec_id AS q_id, e AS q FROM v JOIN benchmark ON vec_id = item_id), {_dense_sql('dense', 40)},
both_ AS (SELECT q_id, vec_id AS doc_id, 1.0 / (60 + rank) AS s FROM dense UNION ALL SELECT item_id, doc_id, 1.25 / (60 + rank) FROM sparse),
f AS (SELECT q_id, doc_id, round(sum(s), 8) AS score FROM both_ GROUP BY q_id, doc_id)
SELECT q_id, doc_id, score, rank, round(least(1.0, score * 61 / 2), 6) AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""
)
def hybrid_rrf(spark, d):
    """TOP3: item_id is paired with the vector of that id."""
    v = table(spark, d, "embeddings")
    qs = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    dense = search.dense_search(v, qs, 40).select("q_id", F.col("vec_id").alias("doc_id"), "rank")
    sparse = _hits(spark, d, 40).select(F.col("item_id").alias("q_id"), "doc_id", "rank")
    return search.rrf(dense, sparse, 10, sparse_weight=1.25)


@query(
    f"""WITH {_VEC}, {_dense_sql('l0', 10)}, {_dense_sql('l1', 10, 16)}, {_dense_sql('l2', 10, 32)},
al AS (SELECT q_id, vec_id, rank, 0 AS l FROM l0 UNION ALL SELECT q_id, vec_id, rank, 1 FROM l1 UNION ALL SELECT q_id, vec_id, rank, 2 FROM l2),
f AS (SELECT q_id, vec_id, round(sum(1.0 / (rank - 1 + 3) + CASE WHEN l = 0 THEN 0.5 ELSE 0 END), 8) AS score FROM al GROUP BY q_id, vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM f) WHERE rank <= 10"""
)
def multi_query_fusion(spark, d):
    """TOP5, SET1: the full vectors and two shortened forms as three variants of a question."""
    v, qs = _asked_vectors(spark, d)
    lists = None
    for k, dims in enumerate((None, 16, 32)):
        one = search.dense_search(v, qs, 10, dims).select("q_id", "vec_id", "rank", F.lit(k).alias("list"))
        lists = one if lists is None else lists.unionByName(one)
    return search.merge_lists(lists, 10)


@query(
    f"""WITH {_bm25(10)},
m AS (SELECT h.*, lang, source FROM hits h JOIN documents USING (doc_id)), f AS (SELECT *, FALSE AS fallback FROM m WHERE lang IN ('fr', 'de') AND source IN ('src1', 'src2', 'src3'))
SELECT item_id, doc_id, score, fallback FROM f UNION ALL SELECT item_id, doc_id, score, TRUE FROM m WHERE item_id NOT IN (SELECT item_id FROM f)"""
)
def filtered_search_fallback(spark, d):
    """FLT3, FLT6."""
    rows = search.small(_hits(spark, d)).join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    some = search.metadata_filter(rows, {"lang": ["fr", "de"], "source": ["src1", "src2", "src3"]})
    return search.with_fallback(some, rows, "item_id").select("item_id", "doc_id", "score", "fallback")


# --- text -----------------------------------------------------------------------------------------------------------------
def _redact_sql() -> str:
    out, kinds = "text", []
    for kind, p in T.PII.items():
        kinds.append(f"CASE WHEN regexp_matches({out}, '{p}') THEN '{kind}' END")
        out = f"regexp_replace({out}, '{p}', '[REDACTED_{kind.upper()}]', 'g')"
    return f"SELECT doc_id, md5({out}) AS redacted_md5, coalesce(array_to_string(list_filter([{', '.join(kinds)}], lambda x: x IS NOT NULL), ','), '') AS kinds FROM documents"


@query(_redact_sql())
def pii_redact_full(spark, d):
    """FLT9."""
    out, kinds = T.redacted("text")
    return table(spark, d, "documents").select("doc_id", F.md5(out.cast("binary")).alias("redacted_md5"), F.array_join(kinds, ",").alias("kinds"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in T.PII.items()) + " FROM documents")
def pii_counts(spark, d):
    """FLT8."""
    return table(spark, d, "documents").select("doc_id", *[c.cast("long").alias(k) for k, c in T.pii_counts("text").items()])


def _mask_sql() -> str:
    """A step for each kind: the text between the matches, and the masks of these."""
    ctes, last = [], "documents"
    for k, kind in enumerate(T.MASK_ORDER):
        p = T.PII[kind]
        if kind == "email":
            mask = "CASE WHEN strpos(m, '@') <= 2 THEN '*' ELSE substr(m, 1, 1) || '***' END || '@***.' || string_split(m, '.')[-1]"
        elif kind == "phone":
            mask = "'***-***-' || right(regexp_replace(m, '\\D', '', 'g'), 4)"
        else:
            mask = "left(m, 2) || repeat('*', length(m) - 4) || right(m, 2)"
        ctes.append(f"g{k} AS (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS f, regexp_split_to_array(text, '{p}') AS s FROM {last})")
        ctes.append(f"m{k} AS (SELECT doc_id, CASE WHEN len(f) > 0 THEN array_to_string(list_transform(range(1, len(s) + 1), lambda i: s[i] || coalesce(list_transform(f, lambda m: {mask})[i], '')), '') ELSE text END AS text FROM g{k})")
        last = f"m{k}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, text AS masked FROM {last}"


@query(_mask_sql())
def pii_redact_masked(spark, d):
    """FLT10; held against Python in the tests as well."""
    return table(spark, d, "documents").select("doc_id", T.masked("text").alias("masked"))


def _score_sql(table_: str, key: str) -> str:
    n = " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN 1 ELSE 0 END" for p in T.DIRECTIVES)
    more = f"3 * CAST(regexp_matches(lower(text), '{T.DESCRIPTIVE}') AS INT) + 4 * CAST(regexp_matches(lower(text), '{T.STRUCTURAL}') AS INT)"
    return f"SELECT {key}, CASE WHEN ({n}) > 0 THEN least(10, 3 * ({n}) + {more}) / 10.0 ELSE 0.0 END AS score FROM {table_}"


@query(_score_sql("documents", "doc_id").replace("AS score", "::DOUBLE AS score"))
def prompt_injection_score(spark, d):
    """FLT7 over whole texts."""
    return table(spark, d, "documents").select("doc_id", T.injection_score("text", None).alias("score"))


def _clean_sql(c: str = "text") -> str:
    for p in T.NOISE:
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '\\n+', chr(10), 'g')"
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_WORDS_SQL = r"len(regexp_extract_all({}, '\S+'))"
_ALNUM_SQL = r"(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[\p{L}\p{N}]')) / length(text) ELSE 0.0 END)"
_LINES_SQL = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(
    f"""WITH p AS (SELECT doc_id, text, {_WORDS_SQL.format(_clean_sql())} AS n, {_ALNUM_SQL} AS a, {_LINES_SQL} AS ls FROM documents)
SELECT doc_id, CASE WHEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'empty' WHEN n = 0 THEN 'no_words' WHEN n < 15 THEN 'low_word_count'
  WHEN a < 0.5 THEN 'low_alpha_density' WHEN len(ls) > 0 AND 1.0 - len(list_distinct(ls)) / len(ls) > 0.3 THEN 'high_repetition' ELSE 'kept' END AS reason FROM p"""
)
def noise_filter(spark, d):
    """FLT1, FLT2."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.noise_reason("text"), F.lit("kept")).alias("reason"))


@query(f"SELECT doc_id, CASE WHEN {_WORDS_SQL.format('text')} > 100 AND {_ALNUM_SQL} > 0.7 THEN 'HIGH' WHEN {_WORDS_SQL.format('text')} > 30 AND {_ALNUM_SQL} > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS density FROM documents")
def density_tag(spark, d):
    """FLT27."""
    return table(spark, d, "documents").select("doc_id", T.density("text").alias("density"))


_STRIP_SQL = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT min(doc_id) AS doc_id, sha256({_STRIP_SQL.format('text')}) AS hash FROM documents GROUP BY 2")
def exact_dedup(spark, d):
    """DDP1, WIN7."""
    docs = table(spark, d, "documents").select("doc_id", dedup.content_hash("text").alias("hash"))
    return dedup.exact_dedup(docs, F.col("hash"), "doc_id")


@query(f"SELECT sha256({_STRIP_SQL.format('text')}) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_hash_groups(spark, d):
    """AGG2, DDP8."""
    return dedup.duplicate_groups(table(spark, d, "documents"), dedup.content_hash("text"))


@query(
    """WITH t AS (SELECT doc_id, lang, source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS s FROM documents)
SELECT * FROM (SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard
FROM t a JOIN t b ON a.lang = b.lang AND a.doc_id < b.doc_id AND len(a.s) > 0 AND len(b.s) > 0 AND least(len(a.s), len(b.s)) >= 0.85 * greatest(len(a.s), len(b.s))) WHERE jaccard >= 0.85"""
)
def near_dup_pairs_jaccard(spark, d):
    """DDP4's pairs within a language, FN3."""
    out = dedup.jaccard_pairs(table(spark, d, "documents"), "doc_id", "text", 0.85, [F.col("lang")])
    return out.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE similarity >= 0.4"""
)
def embedding_near_dups(spark, d):
    """DDP5's pairs within a label."""
    return dedup.embedding_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4, "label")


def _runs_sql(source: str, key: str, n: int) -> str:
    return f"""(SELECT DISTINCT {key}, array_to_string(t[i:i + {n - 1}], ' ') AS run FROM (
  SELECT {key}, t, unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM {source}) WHERE len(t) >= {n}))"""


@query(f"SELECT doc_id, item_id, count(*) AS runs FROM {_runs_sql('documents', 'doc_id', 8)} JOIN {_runs_sql('benchmark', 'item_id', 8)} USING (run) GROUP BY doc_id, item_id")
def benchmark_contamination(spark, d):
    """AGG8's needle, JN8."""
    return metrics.contains_run(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 8)


@query(
    r"""SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '[^a-z0-9_\s]', '', 'g'), '\s+', ' ', 'g')) AS cache_key FROM conversations"""
)
def cache_key_normalise(spark, d):
    """FN14."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(T.normalized_query("text"), 256).alias("cache_key"))


def _sig_sql() -> str:
    return f"""regexp_matches(text, '{T.DOTTED}') OR len(regexp_extract_all(text, '{T.SNAKE}')) >= 3 OR len(regexp_extract_all(text, '{T.CAMEL}')) >= 2 AS identifier_heavy,
  regexp_matches(text, '{T.PATH}') AS path_heavy, regexp_matches(text, '{T.VERSION}') AS version_qualified, regexp_matches(text, '{T.SQL_WORDS}') OR regexp_matches(text, '{T.CODE}') AS code_like"""


_INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in T.INTENTS) + " ELSE 'factual' END"


@query(
    f"""WITH s AS (SELECT conv_id, turn, {_INTENT_SQL} AS intent, {_sig_sql()} FROM conversations)
SELECT *, CASE WHEN identifier_heavy OR path_heavy OR version_qualified OR code_like THEN 'identifier_sparse_rrf' ELSE 'equal_rrf' END AS profile,
 CASE WHEN intent IN ('api_lookup', 'code_example') THEN 'bm25_only' WHEN intent = 'debugging' THEN 'hybrid_sparse_bias' WHEN intent IN ('factual', 'how_to', 'synthesis') THEN 'dense_only' WHEN intent = 'comparative' THEN 'hybrid_equal' ELSE 'hybrid_dense_bias' END AS mode FROM s"""
)
def query_signals_modes(spark, d):
    """FN9, FN10, FN11."""
    s = T.signals("text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.intent("text").alias("intent"), *[c.alias(k) for k, c in s.items()])
    flags = {k: F.col(k) for k in s}
    return rows.withColumn("profile", T.rrf_profile(flags)).withColumn("mode", T.search_mode(F.col("intent"), flags))


@query(f"SELECT intent, count(*) AS n FROM (SELECT {_INTENT_SQL} AS intent FROM conversations) GROUP BY intent")
def intent_class(spark, d):
    """FN11."""
    return table(spark, d, "conversations").groupBy(T.intent("text").alias("intent")).agg(F.count("*").alias("n"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS n, regexp_matches(lower(text), 'vs|compare|difference|versus') OR contains(text, ' and ') OR len(regexp_extract_all(text, ',')) > 1 AS many FROM conversations)
SELECT conv_id, turn, CASE WHEN n > 15 AND many THEN 'hard' WHEN n < 8 AND NOT many THEN 'easy' ELSE 'medium' END AS difficulty FROM s"""
)
def query_difficulty(spark, d):
    """FN15."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.difficulty("text").alias("difficulty"))


@query(
    r"""SELECT conv_id, turn, md5(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(replace(text, '```', ''), '(?m)^#{1,6}\s+', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), 1, 2000), '^\s+|\s+$', '', 'g')) AS sanitized_md5 FROM conversations"""
)
def query_sanitize(spark, d):
    """FLT22; the 2000 characters are the operator's."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.sanitized("text").cast("binary")).alias("sanitized_md5"))


# --- chunks ---------------------------------------------------------------------------------------------------------------
def _windows_sql(name: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""{name} AS (SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(i * {step} AS INT) AS start_offset, substr(text, i * {step} + 1, {size}) AS text, CAST(least(length(text), i * {step} + {size}) AS INT) AS end_offset
  FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - {overlap}) / {step}) AS BIGINT)))) AS i FROM documents WHERE length(text) > 0))"""


@query(f"WITH {_windows_sql('w', 1000, 100)} SELECT doc_id, chunk_index, start_offset, end_offset, md5(text) AS md5 FROM w")
def char_window_chunks(spark, d):
    """CHK1, fixed windows."""
    return chunking.windows(table(spark, d, "documents"), "doc_id").select("doc_id", "chunk_index", "start_offset", "end_offset", F.md5(F.col("text").cast("binary")).alias("md5"))


@query(
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: len(regexp_extract_all(x, '\S+')) >= 10) AS ps FROM documents)
SELECT doc_id, CAST(unnest(range(len(ps))) AS INT) AS chunk_index, md5(unnest(ps)) AS md5 FROM p"""
)
def paragraph_chunks(spark, d):
    """CHK4."""
    return chunking.paragraphs(table(spark, d, "documents"), "doc_id").select("doc_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("md5"))


def _python_split(how: str) -> Query:
    def f(spark, d):
        out = chunking.split_documents(prepare(spark) and table(spark, d, "documents"), "doc_id", how)
        return out.select("doc_id", "chunk_index", "total_chunks", "start_offset", "end_offset", "section_header", "chunk_type", "text")

    f.__name__, f.__doc__ = f"{how}_chunks", "CHK2, CHK3, CHK6, CHK8, CHK15: held against the invariants in the tests."
    return f


for _how in ("sentence", "header", "budget"):
    query()(_python_split(_how))


@query()
def json_chunks(spark, d):
    """CHK6: orders with their lines as JSON documents."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag"))).alias("lines"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    texts = orders.select(F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("string").alias("o_orderdate"), "lines")).alias("text"))
    out = chunking.split_documents(prepare(spark) and texts, "doc_id", "json", 64)
    return out.select("doc_id", "chunk_index", "total_chunks", "section_header", "chunk_type", "text")


@query(
    """WITH p AS (SELECT p_partkey AS doc_id, 3 AS n, ['@cached' || chr(10) || 'def part_' || p_partkey || '(x):' || chr(10) || '    return x' || chr(10) || chr(10), 'class Part' || p_partkey || ':' || chr(10) || '    size = ' || p_size || chr(10) || chr(10), 'def last():' || chr(10) || '    pass' || chr(10)] AS u FROM part),
c AS (SELECT doc_id, n, unnest(u) AS text, CAST(unnest([0, 1, 2]) AS INT) AS chunk_index FROM p)
SELECT doc_id, chunk_index, CAST(n AS INT) AS total_chunks, 'code' AS chunk_type, text FROM c"""
)
def python_chunks(spark, d):
    """CHK8: generated modules, a decorator staying with its function."""
    text = F.concat(F.lit("@cached\ndef part_"), F.col("p_partkey"), F.lit("(x):\n    return x\n\nclass Part"), F.col("p_partkey"), F.lit(":\n    size = "), F.col("p_size"), F.lit("\n\ndef last():\n    pass\n"))
    out = chunking.split_documents(prepare(spark) and table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")), "doc_id", "python")
    return out.select("doc_id", "chunk_index", "total_chunks", "chunk_type", "text")


@query()
def hierarchical_chunks(spark, d):
    """CHK14, CHK16, CHK17."""
    return chunking.hierarchical(prepare(spark) and table(spark, d, "documents"), "doc_id")


@query(
    f"""WITH {_windows_sql('w', 1000, 100)}, c AS (SELECT doc_id || ':' || chunk_index AS chunk, CASE WHEN chunk_index % 5 = 1 THEN '' ELSE text END AS text, CASE WHEN chunk_index = 2 THEN doc_id || ':99999' WHEN chunk_index > 0 THEN doc_id || ':0' ELSE '' END AS parent, length(text) AS n FROM w),
a AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE chunk LIKE '%7:0')
SELECT 'duplicate_id' AS violation, chunk FROM a GROUP BY chunk HAVING count(*) > 1 UNION ALL SELECT 'blank_text', chunk FROM a WHERE trim(text) = ''
UNION ALL SELECT 'over_budget', chunk FROM a WHERE n > 990 UNION ALL SELECT 'missing_parent', chunk FROM a WHERE parent <> '' AND parent NOT IN (SELECT chunk FROM c)"""
)
def chunk_violations(spark, d):
    """FLT24, JN14: windows damaged on purpose: repeated ids, blank texts, long ones, parents that don't exist."""
    w = chunking.windows(table(spark, d, "documents"), "doc_id")
    name = lambda k: F.concat_ws(":", F.col("doc_id"), k)
    i = F.col("chunk_index")
    parent = F.when(i == 2, name(F.lit("99999"))).when(i > 0, name(F.lit("0"))).otherwise("")
    c = w.select(name(i).alias("chunk_id"), F.when(i % 5 == 1, "").otherwise(F.col("text")).alias("text"), parent.alias("parent"), F.length("text").alias("n"))
    return metrics.violations(c.unionByName(c.where(F.col("chunk_id").like("%7:0"))), "chunk_id", "parent", "text", "n", 990)


@query(
    f"WITH {_windows_sql('w', 1000, 100)} SELECT w.doc_id, w.chunk_index, md5(coalesce(nullif(p.text, ''), w.text)) AS md5 FROM w LEFT JOIN (SELECT doc_id, text FROM documents WHERE lang = 'en') p USING (doc_id)"
)
def parent_substitution(spark, d):
    """JN2: English documents are the parents there are."""
    docs = table(spark, d, "documents")
    parents = docs.where("lang = 'en'").select("doc_id", F.col("text").alias("parent_text"))
    out = chunking.windows(docs, "doc_id").join(parents, "doc_id", "left")
    return out.select("doc_id", "chunk_index", F.md5(F.coalesce(F.nullif("parent_text", F.lit("")), "text").cast("binary")).alias("md5"))


_NUMBERS = 100_000
_CHUNKED = f"{_windows_sql('w', 1000, 100)}, chunks AS (SELECT doc_id * 100000 + chunk_index AS chunk_no, * FROM w), {_bm25(10, 'chunks', 'chunk_no')}, ch AS (SELECT h.*, c.doc_id, c.chunk_index, c.text FROM hits h JOIN chunks c USING (chunk_no))"


def _chunk_hits(spark, d):
    docs = table(spark, d, "documents")
    numbered = lambda docs: chunking.windows(docs, "doc_id").withColumn("chunk_no", F.col("doc_id") * _NUMBERS + F.col("chunk_index"))
    c, found = numbered(docs), search.small(search.bm25_search(numbered(docs), table(spark, d, "benchmark"), 10, "chunk_no"))
    # only texts with a hit are cut again, and those so long that their numbers run into the next text's
    own = search.small(found.select(F.expr(f"(chunk_no - pmod(chunk_no, {_NUMBERS})) div {_NUMBERS}").alias("doc_id"), F.lit(True).alias("hit")).distinct())
    texts = docs.join(own, "doc_id", "left").where(F.col("hit") | (F.length("text") > _NUMBERS * 900)).select("doc_id", "text")
    hits = found.join(numbered(texts), "chunk_no")
    hits = hits.select("item_id", F.col("doc_id").cast("string").alias("parent"), F.col("chunk_no").alias("chunk_id"), F.col("chunk_index").alias("segment"), "text", F.col("score").alias("confidence"), "rank")
    return c.select(F.col("doc_id").cast("string").alias("parent"), F.col("chunk_index").alias("segment"), "text"), stage(hits, "chunk-hits")


@query(
    f"""WITH {_CHUNKED}, g AS (SELECT item_id, doc_id, max(score) AS confidence, min(rank) AS fr, count(*) AS n_merged, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS t,
  arg_max(chunk_no, score * 1e6 - rank) AS chunk_id FROM ch GROUP BY item_id, doc_id)
SELECT item_id, CAST(doc_id AS VARCHAR) AS parent, chunk_id, confidence, n_merged, md5(t) AS md5, row_number() OVER (PARTITION BY item_id ORDER BY fr) AS position FROM g"""
)
def sibling_merge(spark, d):
    """DDP9 on BM25 hits over windows, a document being the parent."""
    out = dedup.sibling_merge(_chunk_hits(spark, d)[1], "item_id")
    return out.select("item_id", "parent", "chunk_id", "confidence", "n_merged", F.md5(F.col("text").cast("binary")).alias("md5"), "position")


@query(
    f"""WITH {_CHUNKED}, b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, CAST(doc_id AS VARCHAR)) AS place FROM (SELECT item_id, doc_id, max(score) AS confidence FROM ch GROUP BY item_id, doc_id)),
s AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY chunk_index) AS t, count(*) AS n FROM chunks GROUP BY doc_id)
SELECT item_id, CAST(b.doc_id AS VARCHAR) AS parent, confidence, place, md5(substr(t, 1, 4000)) AS md5, n AS n_siblings FROM b JOIN s USING (doc_id) WHERE place <= 3"""
)
def sibling_rejoin(spark, d):
    """DDP10."""
    chunks, hits = _chunk_hits(spark, d)
    out = dedup.sibling_rejoin(hits, chunks, "item_id")
    return out.select("item_id", "parent", "confidence", "place", F.md5(F.col("text").cast("binary")).alias("md5"), "n_siblings")


@query(
    r"""SELECT source, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 1) AS mean, round(quantile_cont(n_chars, 0.5), 4) AS median, round(quantile_cont(n_chars, 0.95), 4) AS p95, round(quantile_cont(n_chars, 0.99), 4) AS p99,
 count(*) FILTER (WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') = '') AS empty, count(*) FILTER (WHERE n_chars > 6000) AS oversized, count(*) FILTER (WHERE ceil(n_chars / 4) > 3800) AS over_tokens, count(*) FILTER (WHERE n_chars < 50) AS tiny FROM documents GROUP BY source"""
)
def chunk_size_stats(spark, d):
    """AGG3, AGG4."""
    return metrics.size_stats(table(spark, d, "documents"), "source", "n_chars", "text")


@query(
    rf"""WITH {_windows_sql('w', 1000, 100)}
SELECT doc_id, chunk_index, regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^\p{{Ll}}') AS starts_lowercase_continuation, regexp_matches(regexp_replace(text, '\s+$', ''), '[\p{{L}}\p{{N}}_]$') AS ends_mid_sentence,
 len(regexp_extract_all(text, '(?m)^[ \t]*```')) % 2 = 1 AS unbalanced_code_fence, starts_with(ltrim(string_split(regexp_replace(text, '\n$', ''), chr(10))[-1]), '|') AS starts_markdown_table FROM w"""
)
def boundary_issues(spark, d):
    """FN17."""
    c = chunking.windows(table(spark, d, "documents"), "doc_id")
    return c.select("doc_id", "chunk_index", *[x.alias(k) for k, x in T.boundary_flags("text").items()])


@query(
    f"""WITH {_windows_sql('g', 700, 0)}, {_windows_sql('p', 1000, 100)},
o AS (SELECT g.doc_id, g.chunk_index, max((least(g.end_offset, p.end_offset) - greatest(g.start_offset, p.start_offset)) / (greatest(g.end_offset, p.end_offset) - least(g.start_offset, p.start_offset))) AS iou
 FROM g JOIN p ON g.doc_id = p.doc_id AND g.start_offset < p.end_offset AND p.start_offset < g.end_offset GROUP BY 1, 2)
SELECT doc_id, chunk_index AS span_no, round(iou, 6) AS iou FROM o"""
)
def span_iou(spark, d):
    """AGG10, JN11: 700-character spans against the windows."""
    docs = table(spark, d, "documents")
    gold = chunking.windows(docs, "doc_id", 700, 0).select("doc_id", F.col("chunk_index").alias("span_no"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    got = chunking.windows(docs, "doc_id").select("doc_id", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    return metrics.span_iou(gold, got, "doc_id")


@query(
    f"""WITH {_windows_sql('g', 700, 0)}, {_windows_sql('p', 1000, 100)},
b AS (SELECT g.doc_id, g.chunk_index, count(p.doc_id) > 0 AS cut FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND p.start_offset > g.start_offset AND p.start_offset < g.end_offset GROUP BY 1, 2)
SELECT doc_id, count(*) AS nodes, count(*) FILTER (WHERE cut) AS broken, round(count(*) FILTER (WHERE cut) / count(*), 6) AS fracture_rate FROM b GROUP BY doc_id"""
)
def fracture_rate(spark, d):
    """JN12."""
    docs = table(spark, d, "documents")
    nodes = chunking.windows(docs, "doc_id", 700, 0).select("doc_id", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    return metrics.fracture_rate(nodes, chunking.windows(docs, "doc_id").select("doc_id", F.col("start_offset").alias("at")), "doc_id")


# --- ranked lists ---------------------------------------------------------------------------------------------------------
@query(
    f"""WITH {_bm25(10)}, rel AS (SELECT DISTINCT item_id, doc_id FROM {_runs_sql('documents', 'doc_id', 8)} JOIN {_runs_sql('benchmark', 'item_id', 8)} USING (run)),
h AS (SELECT hits.*, rel.doc_id IS NOT NULL AS r FROM hits LEFT JOIN rel USING (item_id, doc_id)), t AS (SELECT item_id, count(*) AS n FROM rel GROUP BY item_id)
SELECT item_id, coalesce(round(count(*) FILTER (WHERE r AND rank <= 5) / any_value(n), 6), 1.0) AS recall, round(count(*) FILTER (WHERE r AND rank <= 5) / 5, 6) AS precision, coalesce(round(1 / min(rank) FILTER (WHERE r), 6), 0.0) AS mrr
FROM h LEFT JOIN t USING (item_id) GROUP BY item_id"""
)
def retrieval_metrics(spark, d):
    """AGG5, AGG6: texts that hold eight words in a row of a passage are relevant."""
    rel = metrics.contains_run(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 8)
    return metrics.retrieval_rows(_hits(spark, d), rel, "item_id", "doc_id", 5)


_RANKED = f"{_bm25(10)}, hl AS (SELECT hits.*, coalesce(quality, 0) AS gain FROM hits LEFT JOIN labels USING (doc_id))"


@query(
    f"""WITH {_RANKED}, i AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY gain DESC, rank) AS ir FROM hl),
s AS (SELECT item_id, sum(CASE WHEN rank <= 10 THEN (2 ** gain - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ir <= 10 THEN (2 ** gain - 1) / log2(ir + 1) ELSE 0 END) AS ideal FROM i GROUP BY item_id)
SELECT item_id, round(dcg, 6) AS dcg, round(ideal, 6) AS ideal, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END, 6) AS ndcg FROM s"""
)
def ndcg_at_k(spark, d):
    """AGG7 with the quality labels as gains."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("gain"))
    rows = _hits(spark, d).join(labels, "doc_id", "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    return metrics.ndcg(rows, "item_id", "gain", 10)


@query(
    f"""WITH {_bm25(10)}, m AS (SELECT *, min(score) OVER q AS lo, max(score) OVER q AS hi FROM hits WINDOW q AS (PARTITION BY item_id))
SELECT item_id, doc_id, rank, CASE WHEN hi > lo THEN round((score - lo) / (hi - lo), 6) ELSE score END AS scaled, hi >= 0.5 AS answerable FROM m"""
)
def pool_minmax_gate(spark, d):
    """WIN8, FLT15."""
    return ranking.gate(ranking.min_max(_hits(spark, d), "item_id", "score"), "item_id", "score", 0.5).select("item_id", "doc_id", "rank", "scaled", "answerable")


@query(f"WITH {_bm25(10)} SELECT item_id, doc_id, source, rank FROM (SELECT h.*, source, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS r FROM hits h JOIN documents USING (doc_id)) WHERE r <= 2")
def per_source_cap(spark, d):
    """WIN2."""
    rows = search.small(_hits(spark, d)).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return ranking.per_group_cap(rows, ["item_id", "source"], "rank", 2).select("item_id", "doc_id", "source", "rank")


@query(f"WITH {_bm25(10)} SELECT item_id, doc_id, CASE WHEN n <= 3 THEN rank WHEN rank <= ceil(n / 2) THEN 2 * rank - 1 ELSE 2 * (n - rank + 1) END AS position FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM hits)")
def lost_in_middle_order(spark, d):
    """WIN9."""
    return ranking.lost_in_middle(_hits(spark, d), "item_id", "rank").select("item_id", "doc_id", "position")


def _hit_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return search.small(_hits(spark, d)).join(docs, "doc_id").join(search.small(asked), "item_id")


@query(
    f"""WITH {_bm25(10)}, j AS (SELECT h.item_id, doc_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9_]+')) AS t FROM hits h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = h.item_id)
SELECT item_id, doc_id, round(len(list_intersect(q, t)) / sqrt(CAST(len(q) * len(t) AS DOUBLE)) * 0.6 + len(list_intersect(q, t)) / len(q) * 0.4, 6) AS relevance FROM j"""
)
def compression_rank(spark, d):
    """TOP12's score, FN2."""
    return ranking.compression_scores(_hit_texts(spark, d), "question", "text").select("item_id", "doc_id", "relevance")


@query()
def mmr_rerank(spark, d):
    """TOP11."""
    return ranking.mmr(prepare(spark) and _hit_texts(spark, d), "item_id", "doc_id", "rank", "score", "text")


@query()
def near_dup_greedy(spark, d):
    """DDP3."""
    return ranking.greedy_dedup(prepare(spark) and _hit_texts(spark, d), "item_id", "doc_id", "rank", "text", 0.70, False, True)


@query()
def trigram_maxsim(spark, d):
    """TOP9."""
    return ranking.maxsim_rerank(prepare(spark) and _hit_texts(spark, d), "item_id", "question", "text", 5).select("item_id", "doc_id", "likeness", "scaled", F.col("position").cast("long").alias("position"))


@query()
def context_selection(spark, d):
    """TOP13, FN20: sources stand for addresses."""
    rows = (prepare(spark) and _hit_texts(spark, d)).withColumn("size", F.length("text") + F.length("source") + 50)
    return ranking.select_context(rows, "item_id", "doc_id", "rank", "source", "size", 16_000, 2)


# --- conversations --------------------------------------------------------------------------------------------------------
@query(
    r"""WITH s AS (SELECT conv_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS c, turn FROM conversations WHERE role = 'assistant'),
cl AS (SELECT conv_id, row_number() OVER () AS no, list_distinct(regexp_extract_all(lower(c), '[a-z0-9_]+')) AS ct FROM (SELECT conv_id, regexp_replace(c, '^\s+|\s+$', '', 'g') AS c FROM s) WHERE len(regexp_extract_all(c, '\S+')) >= 3),
ev AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS et FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, no, max(CASE WHEN len(ct) > 0 THEN len(list_intersect(ct, et)) / len(ct) ELSE 0.0 END) AS o FROM cl LEFT JOIN ev USING (conv_id) GROUP BY conv_id, no)
SELECT conv_id, count(*) AS claims, count(*) FILTER (WHERE o >= 0.3) AS supported, round(avg(coalesce(o, 0.0)), 4) AS score FROM b GROUP BY conv_id"""
)
def groundedness_overlap(spark, d):
    """AGG22, FLT21: sentences of the assistant against what the user said."""
    c = table(spark, d, "conversations")
    claims = c.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(T.sentences("text")).alias("k", "claim")).withColumn("claim_no", F.col("turn") * 100_000 + F.col("k"))
    return metrics.groundedness(claims, c.where("role = 'user'").select("conv_id", "text"), "conv_id")


@query(
    """WITH p AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(before), '[a-z0-9_]+')) AS b FROM p WHERE role = 'assistant' AND before IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(list_intersect(a, b)) > 0 THEN round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) ELSE 0.0 END AS f1 FROM t"""
)
def answer_token_f1(spark, d):
    """AGG23: each answer against the turn before it."""
    c = table(spark, d, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.where("role = 'assistant' and before is not null").select("conv_id", "turn", metrics.token_f1("text", "before").alias("f1"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '\S+')) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, round(sum(CASE WHEN b.turn IS NULL OR len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END), 6) AS score FROM s a LEFT JOIN s b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY 1, 2)
SELECT conv_id, turn, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS r FROM p) WHERE r = 1"""
)
def medoid_turn(spark, d):
    """AGG26."""
    return metrics.medoid(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def history_last_n(spark, d):
    """WIN11."""
    r = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("r", r).where("r <= 3").select("conv_id", "turn", "role")


@query()
def history_token_budget(spark, d):
    """WIN12, FN18."""
    return ranking.history_budget((prepare(spark) and table(spark, d, "conversations")).withColumn("tokens", F.ceil(F.length("text") / 4)), 250)


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS rendered, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def conversation_render(spark, d):
    """FN27."""
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"), F.ceil(F.length("text") / 4).alias("n")).alias("s"))
    out = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("l"), F.sum("s.n").alias("tokens"))
    return out.select("conv_id", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("rendered"), F.col("tokens").cast("long").alias("tokens"))


# --- pages ----------------------------------------------------------------------------------------------------------------
def _plain_sql(tag: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '')"


@query(f"SELECT page_id, coalesce({_plain_sql('h1')}, {_plain_sql('title')}, url) AS title FROM pages")
def html_title(spark, d):
    """PRS4."""
    return table(spark, d, "pages").select("page_id", pages.title("html", "url").alias("title"))


_LINKS_SQL = r"""l AS (SELECT page_id, url, unnest(hs) AS href, unnest(range(len(hs))) AS position FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) AS hs FROM pages)),
links AS (SELECT page_id, url, CAST(position AS INT) AS position, regexp_replace(href, '^\s+|\s+$', '', 'g') AS href FROM l WHERE regexp_replace(href, '^\s+|\s+$', '', 'g') <> '' AND NOT regexp_matches(regexp_replace(href, '^\s+|\s+$', '', 'g'), '(?i)^(mailto:|tel:|javascript:|#)')),
res AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z]+:)//', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href
  ELSE (CASE WHEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z]+://[^/]+(?:/.*)?/)', 1) = '' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/' ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z]+://[^/]+(?:/.*)?/)', 1) END) || href END AS target FROM links)"""


@query(f"WITH {_LINKS_SQL} SELECT page_id, position, href, target FROM res")
def html_links(spark, d):
    """PRS11."""
    return pages.links(table(spark, d, "pages")).select("page_id", "position", "href", pages.resolve(F.col("url"), F.col("href")).alias("target"))


_CANON_SQL = rf"""lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z]+://[^/?]*)', 1)) || regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '')
 || (CASE WHEN array_to_string(kept, '&') <> '' THEN '?' || array_to_string(kept, '&') ELSE '' END)"""
_KEPT_SQL = f"(SELECT *, list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains({_list(pages.TRACKING)}, string_split(p, '=')[1])) AS kept FROM pages)"


@query(f"SELECT page_id, {_CANON_SQL} AS canonical FROM {_KEPT_SQL}")
def canonical_urls(spark, d):
    """PRS12."""
    return table(spark, d, "pages").select("page_id", pages.canonical("url").alias("canonical"))


@query(f"SELECT regexp_replace({_CANON_SQL}, '/index\\.html?$', '') AS key, min(page_id) AS page_id, count(*) AS n FROM {_KEPT_SQL} GROUP BY 1")
def url_dedupe(spark, d):
    """PRS13."""
    return table(spark, d, "pages").groupBy(pages.dedupe_key("url").alias("key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query()
def html_to_markdown(spark, d):
    """PRS1-PRS5."""
    return pages.to_markdown(prepare(spark) and table(spark, d, "pages"))


@query()
def markdown_scan(spark, d):
    """PRS20, WIN6."""
    return pages.markdown_scan(html_to_markdown(spark, d), "page_id", "markdown")


_FRONT_SQL = "fr AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS source_name, CASE page_id % 7 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'GONE' ELSE 'PROCESSED' END AS state, page_id % 4 AS attempts, CASE page_id % 7 WHEN 1 THEN CASE page_id % 3 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'read timed out' ELSE 'HTTP 404' END END AS last_error FROM pages)"


def _frontier(spark, d):
    """A frontier made of the pages, with states by id."""
    p, m = table(spark, d, "pages"), F.col("page_id") % 7
    state = F.when(m == 0, crawl.DISCOVERED).when(m == 1, crawl.FAILED).when(m == 2, crawl.GONE).otherwise(crawl.PROCESSED)
    k = F.col("page_id") % 3
    error = F.when(m == 1, F.when(k == 0, "HTTP 429").when(k == 1, "read timed out").otherwise("HTTP 404"))
    return p.select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source_name"), state.alias("state"), (F.col("page_id") % 4).alias("attempts"), error.alias("last_error"))


@query(f"WITH {_FRONT_SQL} SELECT source_name, state, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM fr GROUP BY 1, 2")
def frontier_stats(spark, d):
    """AGG16."""
    return crawl.frontier_stats(_frontier(spark, d))


@query(f"WITH {_FRONT_SQL} SELECT CASE WHEN last_error = 'HTTP 429' THEN 'rate_limit' WHEN last_error = 'read timed out' THEN 'timeout' ELSE 'not_found' END AS category, count(*) AS n FROM fr WHERE state = 'FAILED' GROUP BY 1")
def frontier_errors(spark, d):
    """AGG16, FN22."""
    f = _frontier(spark, d).where(F.col("state") == crawl.FAILED)
    return f.groupBy(crawl.error_category(F.col("last_error")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {_FRONT_SQL} SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM fr WHERE state = 'PROCESSED')")
def frontier_stale(spark, d):
    """JN5."""
    return crawl.stale(table(spark, d, "pages"), _frontier(spark, d).where(F.col("state") == crawl.PROCESSED))


@query(f"WITH {_FRONT_SQL}, ix AS (SELECT DISTINCT url FROM pages WHERE length(html) > 2000) SELECT page_id, CASE WHEN state = 'PROCESSED' AND ix.url IS NULL THEN 'DISCOVERED' ELSE state END AS state FROM fr LEFT JOIN ix USING (url)")
def frontier_reactivate(spark, d):
    """JN6."""
    return crawl.reactivate(_frontier(spark, d), table(spark, d, "pages").where("length(html) > 2000")).select("page_id", "state")


@query(f"WITH {_LINKS_SQL}, e AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS a, target AS b FROM res) SELECT lower(a) AS source, 'links_to' AS relation_type, lower(b) AS target FROM e")
def graph_neighbours(spark, d):
    """JN1: hosts and the addresses they link to, through a node and an edge table."""
    ends = pages.links(table(spark, d, "pages")).select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("a"), pages.resolve(F.col("url"), F.col("href")).alias("b")).distinct()
    edges = ends.select(F.sha1(F.lower("a")).alias("source_id"), F.sha1(F.lower("b")).alias("target_id"), F.lit("links_to").alias("relation_type"), F.lower("a").alias("a"), F.lower("b").alias("b"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("id", F.sha1("name"))
    return crawl.neighbours(edges.select("source_id", "target_id", "relation_type"), nodes)


@query("SELECT page_id, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.') AND starts_with(url, 'https://') AS allowed FROM pages")
def url_allowed(spark, d):
    """PRS14, PRS15."""
    return table(spark, d, "pages").select("page_id", pages.allowed(F.col("url"), [], ["https://"]).alias("allowed"))


# --- events ---------------------------------------------------------------------------------------------------------------
@query("SELECT event_id, user_id, in_window, in_window <= 5 AS allowed FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events)")
def rate_limit_sliding(spark, d):
    """STR1."""
    return series.sliding_limit(table(spark, d, "events"), "user_id", 3600).select("event_id", "user_id", "in_window", "allowed")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1, 2")
def daily_volume_p95(spark, d):
    """AGG14."""
    return series.daily(table(spark, d, "events"), "event_type")


@query(
    """WITH p AS (SELECT event_type AS metric, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
b AS (SELECT *, round(avg(value) OVER (PARTITION BY metric ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS baseline FROM p)
SELECT metric, CAST(day AS INT) AS day, value, baseline, round(value - baseline, 6) AS delta, coalesce(round(value - baseline, 6) < -0.1, FALSE) AS drifted FROM b"""
)
def drift_trailing_7d(spark, d):
    """AGG11, WIN13."""
    p = table(spark, d, "events").groupBy(F.col("event_type").alias("metric"), F.unix_date(F.to_date("ts")).alias("day")).agg(F.round(F.avg("value"), 6).alias("value"))
    return series.drift(p)


@query(
    """WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL),
l AS (SELECT event_type, count(*) AS n, avg(value) AS m, list_sort(list(value)) AS v FROM k WHERE r <= 10000 GROUP BY event_type)
SELECT event_type, n, round(m, 4) AS mean, round(v[1], 4) AS min, round(v[-1], 4) AS max, round(v[least(CAST(floor(n * 0.5) AS INT), n - 1) + 1], 4) AS p50, round(v[least(CAST(floor(n * 0.95) AS INT), n - 1) + 1], 4) AS p95, round(v[least(CAST(floor(n * 0.99) AS INT), n - 1) + 1], 4) AS p99 FROM l"""
)
def score_distribution(spark, d):
    """AGG13."""
    return series.distribution(table(spark, d, "events"), "event_type")


@query(
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, round(sum(0.7::DOUBLE ** (r - 1) * CASE WHEN r < n THEN 0.3::DOUBLE ELSE 1.0 END * value), 6) AS ema FROM r GROUP BY user_id"""
)
def ema_latency(spark, d):
    """AGG17, WIN14."""
    return series.moving_average(table(spark, d, "events"), "user_id")


@query(
    """WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id, min(event_id) AS first_event, count(*) AS length, least(60.0, 10 * 2.0 ** (least(count(*), 10) - 1)) AS cooldown FROM r WHERE event_type = 'error' GROUP BY user_id, island"""
)
def failure_runs(spark, d):
    """WIN15."""
    return series.failure_runs(table(spark, d, "events"), "user_id", F.col("event_type") == "error")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(event_type) FILTER (WHERE k = 1) AS latest, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (WHERE k <= 15) AS recent FROM r GROUP BY user_id"""
)
def session_progress(spark, d):
    """AGG30, STR12."""
    return series.progress(table(spark, d, "events"), "user_id")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1800 SECONDS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY user_id, no"""
)
def event_sessions(spark, d):
    """STR10 over what is there."""
    return series.sessions(table(spark, d, "events"), "user_id")


# --- snapshots and reports ------------------------------------------------------------------------------------------------
@query(
    f"""WITH o AS (SELECT source || '/' || doc_id AS url, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT source || '/' || doc_id AS url, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT url, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'gone' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (url)"""
)
def incremental_snapshot(spark, d):
    """DDP6: two made-up states of the corpus."""
    docs = table(spark, d, "documents").withColumn("url", F.concat_ws("/", "source", "doc_id"))
    old = docs.where("doc_id % 5 <> 0").select("url", F.md5(F.col("text").cast("binary")).alias("hash"))
    new = docs.where("doc_id % 7 <> 0").select("url", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("hash"))
    return dedup.snapshot_status(old, new, "url")


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS sources, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS empty, count(*) - count(DISTINCT sha256(text)) AS surplus_copies FROM documents")
def corpus_integrity(spark, d):
    """AGG2, AGG31."""
    return table(spark, d, "documents").agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"), (F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("surplus_copies"))


@query(
    """WITH t AS (SELECT DISTINCT source, lang AS term FROM documents), f AS (SELECT DISTINCT t.source, t.term FROM t JOIN documents d ON d.source = t.source AND contains(lower(d.text), t.term))
SELECT t.source, count(*) AS terms, count(f.term) AS found, round(count(f.term) / count(*), 6) AS term_recall FROM t LEFT JOIN f USING (source, term) GROUP BY t.source"""
)
def coverage_terms(spark, d):
    """AGG21, JN8: language codes as the terms each source should hold."""
    docs = table(spark, d, "documents")
    return metrics.coverage_rows(docs.select("source", F.col("lang").alias("term")), docs.select("source", "text"), "source")


@query(
    """WITH m AS (SELECT source || '/' || doc_id || '.md' AS relative_path, doc_id, text FROM documents), c AS (SELECT relative_path, CAST(CASE WHEN length(text) < 200 THEN 0 ELSE ceil(length(text) / 1000.0) END AS BIGINT) AS chunk_count FROM m WHERE doc_id % 11 <> 0)
SELECT relative_path, coalesce(chunk_count, 0) AS chunk_count, CASE WHEN doc_id % 13 = 0 THEN 'replaced' WHEN chunk_count > 0 THEN 'indexed' WHEN chunk_count = 0 THEN 'zero_chunks' ELSE 'missing_output' END AS status FROM m LEFT JOIN c USING (relative_path)"""
)
def build_coverage(spark, d):
    """JN7: a made-up build of the corpus."""
    m = table(spark, d, "documents").select(F.concat(F.concat_ws("/", "source", "doc_id"), F.lit(".md")).alias("relative_path"), "doc_id", "text")
    counts = m.where("doc_id % 11 <> 0").select("relative_path", F.when(F.length("text") < 200, 0).otherwise(F.ceil(F.length("text") / 1000)).cast("long").alias("chunk_count"))
    return crawl.coverage(m, counts, m.where("doc_id % 13 = 0")).select("relative_path", "chunk_count", "status")


@query("SELECT source || '/' || doc_id || '.md' AS relative_path, strlen(text) AS size, sha256(text) AS sha256 FROM documents WHERE regexp_matches(source || '/' || doc_id || '.md', '^src1[0-9]*/[^/]*\\.md$')")
def file_manifest(spark, d):
    """SRC6: documents as files, selected by globs."""
    f = table(spark, d, "documents").select(F.concat(F.concat_ws("/", "source", "doc_id"), F.lit(".md")).alias("relative_path"), F.col("text").cast("binary").alias("content"))
    return files.manifest(f, ["src1*/*.md"], most_bytes=1 << 30).select("relative_path", F.col("size").cast("long").alias("size"), "sha256")


def _uuid_sql(h: str) -> str:
    """A version-5 UUID from the hex digits of a SHA-1."""
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(
    f"""WITH {_windows_sql('w', 1000, 100)}, p AS (SELECT doc_id, source, chunk_index, sha1(from_hex('{T.DNS}') || encode('https://docs.example/' || source || '/' || doc_id)) AS h FROM w JOIN documents USING (doc_id)),
c AS (SELECT doc_id, source, chunk_index, sha1(from_hex(replace({_uuid_sql('h')}, '-', '')) || encode(source || ':' || lpad(CAST(chunk_index AS VARCHAR), 4, '0'))) AS g FROM p)
SELECT doc_id, source, chunk_index, {_uuid_sql('g')} AS chunk_id FROM c"""
)
def chunk_ids(spark, d):
    """Identity rules: UUID 5 of a chunk, and of its point; held against Python in the tests as well."""
    c = chunking.windows(table(spark, d, "documents").withColumn("url", F.concat_ws("/", F.lit("https://docs.example"), "source", "doc_id")), "doc_id")
    c = c.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    cid = T.chunk_id(F.concat_ws("/", F.lit("https://docs.example"), "source", "doc_id"), F.col("source"), F.col("chunk_index"))
    return c.select("doc_id", "source", "chunk_index", cid.alias("chunk_id"))


@query("SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'dimension' ELSE 'ok' END AS defect FROM embeddings")
def embedding_validation(spark, d):
    """FN5."""
    return table(spark, d, "embeddings").select("vec_id", F.coalesce(V.defect(F.col("embedding"), 64), F.lit("ok")).alias("defect"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(quantile_cont(l_quantity, 0.5), 4) AS median FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def grouped_load(spark, d):
    """A load test of grouping sets and exact percentiles, as AGG5 and AGG12 use them."""
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.percentile("l_quantity", 0.5), 4).alias("median"))


# --- answers --------------------------------------------------------------------------------------------------------------
def _sub_sql() -> str:
    out = []
    for kind, (p, templates) in answers.SUBQUESTIONS.items():
        made = []
        for t in templates:
            text = "'" + t.replace("'", "''") + "'"
            for k in (1, 2):
                text = f"replace({text}, '{{{k}}}', {_STRIP_SQL.format(f"regexp_extract(text, '{p}', {k})") if k == 1 or kind == 'comparative' else "''"})"
            made.append(f"replace({text}, '{{0}}', text)")
        out.append(f"WHEN intent = '{kind}' AND regexp_matches(text, '{p}') THEN {' || chr(10) || '.join(made)}")
    mode = rf"(?i)^(.*?){T.MODE_OR}(.*)$"
    part = lambda k: f"regexp_extract(text, '{mode}', {k})"
    both = " || chr(10) || ".join(_STRIP_SQL.format(f"{part(1)} || {part(k)} || {part(4)}") for k in (2, 3))
    first = f"WHEN intent = 'comparative' AND regexp_matches(text, '{mode}') AND lower({part(2)}) <> lower({part(3)}) THEN {both}"
    return f"WITH c AS (SELECT conv_id, turn, {_ASKED_SQL} AS text FROM conversations), s AS (SELECT *, {_INTENT_SQL} AS intent FROM c) SELECT conv_id, turn, CASE {first} {' '.join(out)} ELSE text END AS sub_questions FROM s"


_ASKED = ["Compare {} vs {}?", "How to install {}?", "Why is {} failing", "What is {}.load( for", "Write {} code?", "yarn or kubernetes for {}"]
_ASKED_SQL = "CASE (conv_id + turn) % 7 " + " ".join(f"WHEN {k} THEN replace('{t}', '{{}}', 'w' || turn)" for k, t in enumerate(_ASKED)) + " ELSE text END"


@query(_sub_sql())
def sub_questions(spark, d):
    """FN12: of every turn by its intent, most of them made into questions of each kind."""
    m, asked = (F.col("conv_id") + F.col("turn")) % 7, F.col("text")
    for k, t in enumerate(_ASKED):
        asked = F.when(m == k, F.replace(F.lit(t), F.lit("{}"), F.concat(F.lit("w"), "turn"))).otherwise(asked)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(answers.sub_questions(asked, T.intent(asked)), "\n").alias("sub_questions"))


@query(
    f"""WITH s AS (SELECT conv_id, turn, text, {_INTENT_SQL} AS intent FROM conversations)
SELECT conv_id, turn, CASE WHEN intent NOT IN ('factual', 'how_to') THEN 'intent:' || intent WHEN regexp_matches(text, '{T.DOTTED}') OR regexp_matches(text, '{T.VERSION}') THEN 'identifier_query'
 WHEN regexp_matches(text, '{answers.FENCES}') THEN 'code_query' WHEN regexp_matches(text, '{answers.STACK_TRACE}') THEN 'debugging_query' ELSE 'none' END AS reason FROM s"""
)
def hyde_policy(spark, d):
    """FN13."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(answers.hyde_suppression(F.col("text"), T.intent("text")), F.lit("none")).alias("reason"))


@query(
    r"""SELECT doc_id, array_to_string(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(pyspark(?:\.\w+)+)', 1), lambda x: lower(x))), ',') AS modules,
 CASE WHEN contains(lower(text), 'latest') THEN 0 ELSE len(list_distinct(regexp_extract_all(text, '\b(\d+\.\d+(?:\.\d+)?)\b', 1))) END AS n_versions FROM documents""".replace("len(list_distinct", "CAST(len(list_distinct").replace(", 1))) END", ", 1))) AS INT) END")
)
def inferred_filters(spark, d):
    """FLT5."""
    f = answers.inferred_filters(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(f["modules"], ",").alias("modules"), F.size(f["versions"]).alias("n_versions"))


@query(
    "WITH n AS (SELECT doc_id, "
    + "coalesce("
    + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in answers.SIGNATURES)
    + ") AS name FROM documents) SELECT doc_id, CASE WHEN contains(name, '.') THEN regexp_extract(name, '\\.([^.]*)$', 1) ELSE name END AS method FROM n"
)
def api_methods(spark, d):
    """FLT11."""
    return table(spark, d, "documents").select("doc_id", answers.api_heading(F.col("text"))["method"].alias("method"))


@query("SELECT doc_id, CASE WHEN len(t) > 0 THEN round(1.0 - len(list_distinct(t)) / len(t), 6) ELSE 0.0 END AS rate FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents)")
def duplicate_token_rate(spark, d):
    """AGG8."""
    return table(spark, d, "documents").select("doc_id", answers.duplicate_token_rate("text").alias("rate"))


@query(
    f"""WITH {_bm25(10)} SELECT item_id, coalesce(round(1 / min(rank) FILTER (WHERE score >= 0.45), 6), 0.0) AS mrr, round(count(*) FILTER (WHERE score >= 0.45 AND rank <= 5) / (CASE WHEN count(*) >= 3 THEN 3 ELSE count(*) END), 6) AS precision_at_3,
 round(count(*) FILTER (WHERE score >= 0.45 AND rank <= 5) / (CASE WHEN count(*) >= 5 THEN 5 ELSE count(*) END), 6) AS precision_at_5 FROM hits GROUP BY item_id"""
)
def proxy_retrieval_metrics(spark, d):
    """AGG25."""
    return answers.proxy_metrics(_hits(spark, d), "item_id", "score")


_MODEL_SQL = "CASE user_id % 4 WHEN 0 THEN 'groq/a' WHEN 1 THEN 'llama3' WHEN 2 THEN 'gemini/b' ELSE 'unknown' END"


@query(
    f"""WITH c AS (SELECT {_MODEL_SQL} AS model, event_id % 900 AS p, event_id % 300 AS k FROM events), s AS (SELECT model, count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(k) AS BIGINT) AS completion_tokens FROM c GROUP BY model)
SELECT *, round(CASE model WHEN 'groq/a' THEN prompt_tokens * 0.00000005::DOUBLE + completion_tokens * 0.00000008::DOUBLE WHEN 'gemini/b' THEN prompt_tokens * 0.000000125::DOUBLE + completion_tokens * 0.000000375::DOUBLE ELSE 0.0 END, 9) AS cost FROM s"""
)
def token_usage(spark, d):
    """AGG15 over events dressed as calls."""
    m = F.col("user_id") % 4
    model = F.when(m == 0, "groq/a").when(m == 1, "llama3").when(m == 2, "gemini/b").otherwise("unknown")
    return answers.usage(table(spark, d, "events").select(model.alias("model"), (F.col("event_id") % 900).alias("prompt_tokens"), (F.col("event_id") % 300).alias("completion_tokens")))


@query("SELECT 'p' || (user_id % 3) AS provider, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS refused, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS saturation FROM events GROUP BY 1")
def provider_saturation(spark, d):
    """AGG33: error events stand for refusals."""
    calls = table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"), F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"), F.lit(None).cast("double").alias("remaining"), F.lit(None).cast("double").alias("quota"))
    return answers.saturation(calls)


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) AS words, contains(text, 'Answer:') OR contains(text, 'Key Points:') OR contains(text, 'Important Notes:') OR contains(text, 'Not Covered:') OR contains(text, '##') AS has_sections, " + " OR ".join(f"contains(lower(text), '{m}')" for m in answers.UNCERTAIN) + " AS uncertain FROM conversations")
def answer_flags(spark, d):
    """FN16."""
    return table(spark, d, "conversations").select("conv_id", "turn", *[c.cast("long").alias(k) if k == "words" else c.alias(k) for k, c in answers.answer_flags("text").items()])


@query(
    f"""WITH t AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, trim(coalesce({_plain_sql('h1')}, {_plain_sql('title')}, url)) AS t, page_id FROM pages), k AS (SELECT host, lower(t) AS k, arg_min(t, page_id) AS t, min(page_id) AS o FROM t WHERE t <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY o, k) AS r FROM k), l AS (SELECT host, list(t ORDER BY r) AS l FROM r WHERE r <= 3 GROUP BY host)
SELECT host, 'What does the documentation say about ' || l[1] || '?' || chr(10) || 'Can you explain ' || coalesce(l[2], l[1]) || ' in more detail?' || chr(10) || 'Give me a code example for ' || coalesce(l[3], l[2], l[1]) || '.' AS suggestions FROM l"""
)
def follow_up_suggestions(spark, d):
    """TOP15: page titles as titles, hosts as questions."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), pages.title("html", "url").alias("title"), "page_id", F.lit("factual").alias("intent"))
    return answers.suggestions(p, "host", "title", "page_id", "intent").select("host", F.array_join("suggestions", "\n").alias("suggestions"))


@query(
    rf"""WITH {_windows_sql('w', 1000, 100)}, s AS (SELECT doc_id, coalesce(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP_SQL.format('x')}), lambda x: len(regexp_extract_all(x, '\S+')) >= 1)[1], '') AS summary FROM documents)
SELECT doc_id, chunk_index, CASE WHEN length(text) >= 200 AND summary <> '' THEN '[Document Context: ' || summary || ']' || chr(10) || chr(10) || text ELSE text END AS text FROM w JOIN s USING (doc_id)"""
)
def context_enriched(spark, d):
    """FLT12, MDL10: windows with the first sentence of their document in front."""
    docs = table(spark, d, "documents")
    c = chunking.windows(docs, "doc_id").withColumn("url", F.col("doc_id").cast("string"))
    return answers.enriched(c, docs.select("doc_id", answers.first_sentence("text").alias("summary")), "doc_id", []).select("doc_id", "chunk_index", "text")
