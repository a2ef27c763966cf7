"""Registered queries of guards, dispatch and error handling over every row's own strings: each text, address or event in all the shapes that the step tells apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import answers, chunking, crawl, models, pages
from skein.plans.registry import query
from skein.plans.runtime import table

_K = "CAST(regexp_extract(props, '(\\d+)', 1) AS INT)"
#: A response that each event stands for: errors have a status by their payload, values a type and size.
_RESPONSE = f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 400 + {_K} ELSE 200 END AS status, {_K} % 8 AS redirects,
  CASE WHEN value < 10 THEN 'text/html; charset=utf-8' WHEN value < 30 THEN 'Text/Plain' ELSE 'image/png' END AS kind, CAST(value AS VARCHAR) AS wait, event_type FROM events"""


def _each(values: list[str]) -> F.Column:
    """A row for each of some values."""
    return F.explode(F.array(*map(F.lit, values)))


def _responses(spark, d) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.when(F.col("value") < 10, "text/html; charset=utf-8").when(F.col("value") < 30, "Text/Plain").otherwise("image/png")
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", k + 400).otherwise(200).alias("status"), (k % 8).alias("redirects"), kind.alias("kind"), F.col("value").cast("string").alias("wait"), "event_type")


@query(
    f"""WITH r AS ({_RESPONSE})
SELECT event_id, CASE WHEN redirects > 5 THEN 'FAILED' WHEN status = 410 THEN 'GONE' WHEN status = 429 THEN 'DISCOVERED' WHEN status <> 200 THEN 'FAILED' WHEN NOT starts_with(lower(kind), 'text/') THEN 'SKIPPED' ELSE 'PROCESSED' END AS state FROM r"""
)
def fetch_states(spark, d):
    """SRC2: what becomes of a page by the response that an event stands for."""
    return _responses(spark, d).select("event_id", pages.fetch_state(F.col("status"), F.col("kind"), F.col("redirects")).alias("state"))


@query(
    f"""WITH r AS ({_RESPONSE}), c AS (SELECT *, CASE WHEN status = 429 THEN 'rate_limited' WHEN status IN (401, 403) THEN 'authentication_error' WHEN status IN (400, 422) THEN 'invalid_request' WHEN status >= 500 THEN 'temporary_unavailable' ELSE 'permanent_error' END AS category FROM r WHERE event_type = 'error')
SELECT event_id, category, CASE WHEN redirects < 4 THEN greatest(0.0, CAST(wait AS DOUBLE)) WHEN category = 'rate_limited' THEN 60.0 WHEN category = 'temporary_unavailable' THEN 10.0 ELSE 45.0 END AS cooldown FROM c"""
)
def provider_errors(spark, d):
    """FN22, FN23: error events by status, some with a Retry-After of their own."""
    r = _responses(spark, d).where("event_type = 'error'")
    category = crawl.provider_error(F.col("status"), F.col("event_type"), F.col("kind"))
    wait = F.when(F.col("redirects") < 4, crawl.retry_after(F.col("wait")))
    return r.select("event_id", category.alias("category"), crawl.cooldown(category, wait, {"rate_limited": 60.0, "temporary_unavailable": 10.0}, 45.0).alias("cooldown"))


_ENDS = ["", ".json", ".md", ".mdx", ".rst", ".html"]


@query(
    f"""WITH p AS (SELECT page_id, e, url || e AS u, t FROM pages, (SELECT unnest({_ENDS}) AS e), (SELECT unnest(['Text/HTML; charset=utf-8', 'application/json', 'text/plain']) AS t))
SELECT page_id, e AS ending, t AS content_type, CASE WHEN t = 'application/json' OR suffix(u, '.json') THEN 'json' WHEN suffix(u, '.md') OR suffix(u, '.mdx') THEN 'markdown' WHEN suffix(u, '.rst') THEN 'rst' WHEN t LIKE 'Text/HTML%' THEN 'html' ELSE 'text' END AS parser FROM p"""
)
def parser_dispatch(spark, d):
    """PRS16: every address under each ending and content type."""
    rows = table(spark, d, "pages").select("page_id", "url", _each(_ENDS).alias("ending")).select("*", _each(["Text/HTML; charset=utf-8", "application/json", "text/plain"]).alias("content_type"))
    return rows.select("page_id", "ending", "content_type", pages.parser_for(F.col("content_type"), F.concat("url", "ending")).alias("parser"))


@query(
    r"""WITH p AS (SELECT page_id, e, regexp_extract(url, '^https?://([^?#]*)', 1) AS path, regexp_extract(html, '(\d+(?:\.\d+)+)', 1) AS version FROM pages, (SELECT unnest(['.py', '/__init__.py', '.txt']) AS e))
SELECT page_id, e AS ending, CASE WHEN e <> '.txt' THEN replace(path, '/', '.') ELSE '' END AS module, version FROM p"""
)
def source_metadata(spark, d):
    """PRS17: modules of the addresses' paths as source files, and the first version number of each page."""
    rows = table(spark, d, "pages").withColumn("ending", _each([".py", "/__init__.py", ".txt"]))
    path = F.concat(F.lit("lib/python/"), F.regexp_extract("url", "^https?://([^?#]*)", 1), "ending")
    return rows.select("page_id", "ending", pages.module_of(path).alias("module"), pages.doc_version("html").alias("version"))


_HOSTS = ["localhost", "127.0.0.1", "10.20.30.40", "192.168.1.1", "192.169.1.1", "172.15.0.1", "172.16.0.1", "172.31.255.1", "172.32.0.1", "169.254.169.254", "0.0.0.0", "8.8.8.8", "11.0.0.1", "internal.example.com"]


@query(
    f"""WITH own AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages), h AS (SELECT page_id, host FROM own UNION SELECT page_id, unnest({_HOSTS}) FROM pages),
n AS (SELECT page_id, host, TRY_CAST(string_split(host, '.')[1] AS INT) AS a, TRY_CAST(string_split(host, '.')[2] AS INT) AS b FROM h)
SELECT page_id, host, host <> '' AND host <> 'localhost' AND coalesce(NOT (a IN (0, 10, 127) OR a = 192 AND b = 168 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 169 AND b = 254), TRUE) AS allowed FROM n"""
)
def private_hosts(spark, d):
    """PRS15: every page's path under its own host and under made ones, private and public; SQL goes by the numbers of the ranges."""
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"))
    rows = p.unionByName(p.withColumn("host", _each(_HOSTS))).dropDuplicates(["page_id", "host"])
    moved = F.concat(F.regexp_extract("url", "^(https?://)", 1), "host", F.lit(":8080"), F.regexp_extract("url", "^https?://[^/?#]*(.*)$", 1))
    return rows.select("page_id", "host", pages.allowed(moved, [], ["http://", "https://"]).alias("allowed"))


_TURNS = "SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL"
_REFUSED = "|".join(T.NON_ANSWERS).replace("'", "''")
_MOSTLY = r"len(regexp_extract_all({x}, '[\p{{L}}\s]')) / length({x}) >= 0.5"
_GOOD = f"(length({{x}}) >= 20 AND NOT regexp_matches(lower({{x}}), '{_REFUSED}') AND {_MOSTLY})"


@query(
    f"""WITH t AS (SELECT conv_id, turn, form, text, '```text' || chr(10) || text || chr(10) || '```' AS fenced, 'As an AI model, ' || text AS refused FROM ({_TURNS}), (SELECT unnest(['json', 'refusal', 'fence', 'bare', 'none']) AS form))
SELECT conv_id, turn, form, coalesce(CASE form WHEN 'json' THEN trim(text, E' \\n\\t\\r') <> '' AND {_GOOD.format(x='text')} WHEN 'refusal' THEN {_GOOD.format(x='refused')} WHEN 'fence' THEN {_GOOD.format(x='fenced')} WHEN 'bare' THEN FALSE ELSE TRUE END, FALSE) AS acceptable FROM t"""
)
def output_guardrail(spark, d):
    """FLT17: every turn as a JSON answer, a JSON refusal, fenced, bare, and with a stated lack of context."""
    t = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "text")
    answer = lambda c: F.to_json(F.struct(c.alias("answer")))
    forms = {"json": answer(F.col("text")), "refusal": answer(F.concat(F.lit("As an AI model, "), "text")), "fence": F.concat(F.lit("```text\n"), "text", F.lit("\n```")), "bare": F.col("text"), "none": F.lit('{"status": "INSUFFICIENT_CONTEXT"}')}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("form"), c.alias("raw")) for n, c in forms.items()]))
    return t.select("conv_id", "turn", each.alias("x")).select("conv_id", "turn", "x.form", answers.acceptable(F.col("x.raw"), F.lit(1)).alias("acceptable"))


_DEGENERATE = " OR ".join(f"regexp_matches(made, '{p}')" for p in answers.DEGENERATE)


@query(
    f"""WITH t AS (SELECT conv_id, turn, k, CASE k WHEN 0 THEN text WHEN 1 THEN '2) ' || text WHEN 2 THEN 'Here are the queries: ' || text WHEN 3 THEN substr(text, 1, 3) WHEN 4 THEN text || ' by column_name' ELSE 'Rewritten Query: ' || text END AS made FROM ({_TURNS}), (SELECT unnest(range(6)) AS k))
SELECT conv_id, turn, CAST(k AS INT) AS k, length(regexp_replace(made, '^\\s+|\\s+$', '', 'g')) < 4 OR {_DEGENERATE} AS degenerate FROM t"""
)
def degenerate_rewrites(spark, d):
    """FLT20: every turn as itself, as a list, as an echo of the prompt, cut short, and with a template's word."""
    t = table(spark, d, "conversations").where("text is not null")
    made = [F.col("text"), F.concat(F.lit("2) "), "text"), F.concat(F.lit("Here are the queries: "), "text"), F.substring("text", 1, 3), F.concat("text", F.lit(" by column_name")), F.concat(F.lit("Rewritten Query: "), "text")]
    return t.select("conv_id", "turn", F.posexplode(F.array(*made)).alias("k", "made")).select("conv_id", "turn", "k", answers.degenerate(F.col("made")).alias("degenerate"))


@query(
    f"""WITH q AS (SELECT conv_id, turn, w, w || ' ' || text AS question FROM ({_TURNS}), (SELECT unnest(['Does YARN', 'With k8s', 'On Kubernetes or yarn', 'yarns', '']) AS w)),
m AS (SELECT conv_id, turn, w, 'yarn' AS mode FROM q WHERE regexp_matches(question, '{answers.MODES['yarn']}') UNION ALL SELECT conv_id, turn, w, 'kubernetes' FROM q WHERE regexp_matches(question, '{answers.MODES['kubernetes']}'))
SELECT conv_id || '/' || turn || '/' || w AS question_id, mode, 'fact of ' || mode AS fact FROM m"""
)
def mode_facts(spark, d):
    """FLT26, JN16: every turn after words that name one mode, two, or none."""
    q = table(spark, d, "conversations").where("text is not null").withColumn("w", _each(["Does YARN", "With k8s", "On Kubernetes or yarn", "yarns", ""])).select(F.concat_ws("/", "conv_id", "turn", "w").alias("question_id"), F.concat_ws(" ", "w", "text").alias("question"))
    facts = spark.createDataFrame([("yarn", "fact of yarn"), ("kubernetes", "fact of kubernetes")], "mode string, fact string")
    return answers.with_mode_facts(q, "question_id", "question", facts)


# --- what models said, from the rows' own strings -----------------------------------------------------------------------------
@query(
    f"""WITH e AS (SELECT event_id, form, {_K} AS k FROM events, (SELECT unnest(['number', 'text', 'fenced', 'negative', 'large', 'none']) AS form))
SELECT event_id, form, CASE form WHEN 'negative' THEN 0.0 WHEN 'large' THEN CASE WHEN k = 0 THEN 0.0 ELSE 1.0 END WHEN 'none' THEN 1.0 ELSE CAST('0.' || lpad(CAST(k AS VARCHAR), 2, '0') AS DOUBLE) END AS score FROM e"""
)
def judge_scores(spark, d):
    """MDL7: each event's payload as a judge's score: as a number, as text, fenced, out of range, and not said."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    share = F.concat(F.lit("0."), F.lpad(k, 2, "0"))
    said = {"number": F.concat(F.lit('{"score": '), share, F.lit("}")), "text": F.concat(F.lit('{"score": "'), share, F.lit('"}')), "fenced": F.concat(F.lit('```json\n{"score": '), share, F.lit("}\n```")), "negative": F.concat(F.lit('{"score": -'), k, F.lit("}")), "large": F.concat(F.lit('{"score": '), k, F.lit("}")), "none": F.concat(F.lit("about "), k)}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("form"), c.alias("raw")) for n, c in said.items()]))
    return table(spark, d, "events").select("event_id", each.alias("x")).select("event_id", "x.form", models.judged(F.col("x.raw")).alias("score"))


@query(
    """WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS good, coalesce(string_agg(trim(text, ' '), '|' ORDER BY turn) FILTER (WHERE role <> 'assistant'), '') AS rest FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id)
SELECT conv_id, round(good / n, 6) AS score, round(good / n, 6) >= 0.5 AS supported, md5(rest) AS unsupported FROM c"""
)
def claim_verdicts(spark, d):
    """MDL6: a conversation's turns as judged claims, of which the assistant's are supported."""
    t = table(spark, d, "conversations").where("text is not null and role is not null")
    claims = F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("claim"), (F.col("role") == "assistant").alias("supported"))))
    rows = t.groupBy("conv_id").agg(F.to_json(F.transform(claims, lambda c: F.struct(c["claim"].alias("claim"), c["supported"].alias("supported")))).alias("raw"))
    s = models.claim_support(F.concat(F.lit("```json\n"), "raw", F.lit("\n```")), F.lit(0.1))
    return rows.select("conv_id", s["score"].alias("score"), s["supported"].alias("supported"), F.md5(F.array_join(s["unsupported"], "|").cast("binary")).alias("unsupported"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s*(?:[-*]|\d+[.)])\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '^\s*\['))
SELECT conv_id, turn, md5(CASE WHEN len(l) >= 3 THEN array_to_string(l[1:3], '|') ELSE coalesce(role, '') || '|more|less' END) AS suggestions FROM t"""
)
def model_suggestions(spark, d):
    """MDL11, TOP15: the lines of each turn as what a model listed; too few, and rules stand in."""
    t = table(spark, d, "conversations").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"^\s*\[")).withColumn("id", F.struct("conv_id", "turn"))
    rules = t.select("id", F.array(F.coalesce("role", F.lit("")), F.lit("more"), F.lit("less")).alias("suggestions"))
    out = models.suggestions_or(t.select("id", F.col("text").alias("raw")), rules, "id", "raw")
    return out.select("id.conv_id", "id.turn", F.md5(F.array_join("suggestions", "|").cast("binary")).alias("suggestions"))


@query(
    """WITH a AS (SELECT user_id, min(event_id) AS first, min(event_id) FILTER (WHERE event_type = 'purchase' OR value > 40) AS won FROM events GROUP BY user_id)
SELECT a.user_id, event_type, won > first AS degraded FROM a JOIN events e ON e.event_id = a.won"""
)
def provider_chain(spark, d):
    """MDL2: a user's events as the attempts along a chain, of which the first purchase or large value succeeds."""
    e = table(spark, d, "events").withColumn("ok", (F.col("event_type") == "purchase") | (F.col("value") > 40))
    return models.first_success(e, "user_id", "event_id", "ok", ["event_type"])


@query(
    """WITH f AS (SELECT user_id, event_type, max(epoch(ts)) AS updated_at FROM events GROUP BY ALL)
SELECT event_type || '/' || user_id AS url, CASE WHEN updated_at < epoch(TIMESTAMP '2024-01-29') - 604800 THEN 'DISCOVERED' ELSE 'FETCHING' END AS state FROM f"""
)
def stale_claims(spark, d):
    """STR9: the last event of a user and kind as a claim; those of more than seven days go back."""
    f = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("updated_at"))
    rows = f.select(F.concat_ws("/", "event_type", "user_id").alias("url"), F.lit(crawl.FETCHING).alias("state"), "updated_at")
    return crawl.reset_stale_claims(rows, 1706486400.0, 604800).select("url", "state")


@query(
    """WITH t AS (SELECT label AS parent, vec_id // 40 AS segment, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE label IS NOT NULL),
m AS (SELECT parent, segment, i, avg(CAST(x AS DOUBLE)) AS x FROM t GROUP BY ALL), n AS (SELECT parent, segment, sqrt(sum(x * x)) AS n FROM m GROUP BY ALL)
SELECT parent, CAST(segment AS INT) AS segment, i AS d, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS x FROM m JOIN n USING (parent, segment)"""
)
def late_chunk_vectors(spark, d):
    """CHK21: all vectors as token vectors of their label, in segments of forty positions."""
    s = F.floor(F.col("vec_id") / 40)
    tokens = table(spark, d, "embeddings").where("label is not null").select(F.col("label").alias("parent"), s.cast("int").alias("segment"), (s * 40).alias("start"), (s * 40 + 40).alias("end"), F.col("vec_id").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return chunking.late_chunks(tokens).select("parent", "segment", F.posexplode("vec").alias("d", "x")).select("parent", "segment", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))
