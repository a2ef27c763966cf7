"""Around the answer: sub-questions, filters read from a question, guardrails, citations, API headings, usage and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.search import dense_search, small

# Fixed values that results depend on.
SIGNATURES = [r"(?m)^\s*(?:def|async\s+def)\s+(\w+(?:\.\w+)*)\s*\(", r"(?m)^\s*([A-Z]\w+(?:\.\w+)*)\s*\(", r"\b(\w+\.\w+(?:\.\w+)*)\s*\(", r"`(\w+(?:\.\w+)*)\s*\(`"]
PARAMETERS = [r"(?m)^:param\s+(\w+)\s*:", r"(?m)^\|\s*(\w+)\s*\|"]
RETURNS = r"->\s*([\w\[\], .|]+)"
MODES = {"yarn": r"(?i)\byarn\b", "kubernetes": r"(?i)\bkubernetes\b|\bk8s\b"}
FENCES = r"`{3}[\s\S]*?`{3}|`[^`\n]+`"
STACK_TRACE = r'(?i)(traceback \(most recent call last\)|file "[^"]+", line \d+|\bat\s+[^\n]+(?:in\s+\w+|\.\w+\(\))|\b(keyerror|typeerror|valueerror|attributeerror|runtimeerror|oserror|indexerror|zerodivisionerror|notimplementederror|exception)\b|raise\s+\w+error)'
DEGENERATE = [r"(?i)\b(column_name|table_name|placeholder)\b", r"(?i)^\s*(here (are|is)|the (queries|search queries|variations) (are|is)|original question:|rewritten query:|return only|you are )", r"(?i)^\s*(?:[-*] |\d+[.)]\s+|`?\d+\.\s)"]
UNCERTAIN = ["not covered", "not clearly", "not addressed", "unclear", "limited information", "not specified", "documentation does not"]
SECTIONS = ["Answer:", "Key Points:", "Important Notes:", "Not Covered:", "##"]
PRICES = {"openrouter/": (0.0000003, 0.0000006), "cf-": (0.000000011, 0.000000036), "groq/": (0.00000005, 0.00000008), "cerebras/": (0.0000001, 0.0000001), "gemini/": (0.000000125, 0.000000375), "nvidia/": (0.0000001, 0.0000001)}
FREE = ["llama", "qwen", "mistral", "gemma", "phi"]
SUGGESTIONS = {
    "show": ["Show me a code example for {1}.", "What are the parameters or options for {1}?", "How does {2} work?"],
    "comparative": ["What are the differences between {1} and {2}?", "When should I use {1} over {2}?", "Give me an example using {3}."],
    "debugging": ["What are common causes of errors with {1}?", "How do I fix issues with {1}?", "What does the documentation say about {2}?"],
    "factual": ["What does the documentation say about {1}?", "Can you explain {2} in more detail?", "Give me a code example for {3}."],
}
SUBQUESTIONS = {
    "comparative": (r"(?i)(?:compare|difference between)\s+(.+?)\s+(?:vs\.?|versus|and)\s+(.+?)(?:\?|$)", ["What is {1}?", "What is {2}?", "What are the differences between {1} and {2}?"]),
    "how_to": (r"(?i)how (?:to|do|can)\s+(.+?)(?:\?|$)", ["What are the prerequisites for {1}?", "What are the steps to {1}?"]),
    "debugging": (r"(?i)((?:why|what)\s+.+?(?:failing|error|broken|oom|crash))", ["What causes {1}?", "How to fix {1}?"]),
    "api_lookup": (r"(\w+(?:\.\w+)*)\s*\(", ["What is the signature of {1}?", "What are the parameters of {1}?", "{0}"]),
    "code_example": (r"(?i)(?:write|code|implement|show)\s+(.+?)(?:\?|$)", ["Show me a code example for {1}", "What is the recommended way to implement {1}?"]),
}


def _filled(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def sub_questions(question: Column, intent: Column) -> Column:
    """FN12/MDL9: the sub-questions of a question by its intent; itself where nothing is found to split."""
    mode = rf"(?i)^(.*?){T.MODE_OR}(.*)$"
    part = lambda k: F.regexp_extract(question, mode, k)
    both = F.array(*[T.strip(F.concat(part(1), part(k), part(4))) for k in (2, 3)])
    out = F.when((intent == "comparative") & question.rlike(mode) & (F.lower(part(2)) != F.lower(part(3))), both)
    for kind, (pattern, templates) in SUBQUESTIONS.items():
        got = {str(k): T.strip(F.regexp_extract(question, pattern, k)) for k in ((1, 2) if kind == "comparative" else (1,))} | {"0": question}
        out = out.when((intent == kind) & question.rlike(pattern), F.array(*[_filled(t, got) for t in templates]))
    return out.otherwise(F.array(question))


def inferred_filters(question: Column) -> dict[str, Column]:
    """FLT5: dotted pyspark names as modules, and versions unless the latest is asked for."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(r"(?i)\b(pyspark(?:\.\w+)+)"), F.lit(1)), F.lower))
    versions = F.array_distinct(F.regexp_extract_all(question, F.lit(r"\b(\d+\.\d+(?:\.\d+)?)\b"), F.lit(1)))
    return {"modules": names, "versions": F.when(F.lower(question).contains("latest"), F.array().cast("array<string>")).otherwise(versions)}


def hyde_suppression(question: Column, intent: Column) -> Column:
    """FN13: why a made-up answer isn't searched for; null if it is."""
    return (
        F.when(~intent.isin("factual", "how_to"), F.concat(F.lit("intent:"), intent)).when(question.rlike(T.DOTTED) | question.rlike(T.VERSION), "identifier_query")
        .when(question.rlike(FENCES), "code_query").when(question.rlike(STACK_TRACE), "debugging_query")
    )


def degenerate(rewrite: Column) -> Column:
    """FLT20: a rewritten question that is too short, a template, an echo of the prompt or a list."""
    return (F.length(T.strip(rewrite)) < 4) | reduce(lambda a, b: a | b, [rewrite.rlike(p) for p in DEGENERATE])


def modes(question: Column) -> Column:
    """FLT26/JN16: the deployment modes that a question names, in order of the list."""
    return F.filter(F.array(*[F.when(question.rlike(p), F.lit(m)) for m, p in MODES.items()]), lambda x: x.isNotNull())


def with_mode_facts(questions: DataFrame, key: str, question: str, facts: DataFrame) -> DataFrame:
    """FLT26: key, mode, fact for every mode that a question names; facts (mode, fact) is a short list."""
    return questions.select(key, F.explode(modes(F.col(question))).alias("mode")).join(small(facts), "mode", "left").select(key, "mode", "fact")


def api_heading(text: Column) -> dict[str, Column]:
    """FLT11: module, method, parameters and return type of the first signature found, and the heading made of them (null without one)."""
    name = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in SIGNATURES])
    has = name.contains(".")
    module = F.when(has, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise("")
    method = F.when(has, F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise(name)
    first, second = (F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1))) for p in PARAMETERS)
    params = F.array_join(F.when(F.size(first) > 0, first).otherwise(second), ", ")
    returns = F.trim(F.regexp_extract(text, RETURNS, 1))
    piece = lambda label, v: F.when(v != "", F.concat(F.lit(f"{label}: "), v))
    heading = F.concat(F.lit("[API: "), F.concat_ws(" | ", piece("Module", module), piece("Method", method), piece("Params", params), piece("Returns", returns)), F.lit("]"))
    return {"module": module, "method": method, "params": params, "returns": returns, "heading": F.when(name.isNotNull(), heading)}


def parsed_answer(raw: Column) -> Column:
    """FLT19: the text of an answer: of the first of its usual fields if it is JSON (fenced or not), else as it is."""
    body = F.regexp_replace(F.regexp_replace(T.strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    fields = F.coalesce(*[F.get_json_object(body, f"$.{k}") for k in ("answer", "response", "text", "content")])
    return F.coalesce(fields, raw)


def without_sources(answer: Column) -> Column:
    """FN29: without a last line of sources."""
    return F.regexp_replace(F.regexp_replace(answer, r"(?is)\n\s*Sources:\s*\[.*\]\s*$", ""), r"\s+$", "")


def acceptable(raw: Column, n_sources: Column, least: int = 20) -> Column:
    """FLT17: JSON with an answer, or text with a fenced code block; with sources also long enough, no refusal, mostly letters."""
    body = F.regexp_replace(F.regexp_replace(T.strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    answer = F.coalesce(F.get_json_object(body, "$.answer"), F.when(raw.rlike(r"```\w+\n"), T.strip(raw)))
    refusal = reduce(lambda a, b: a | b, [F.lower(answer).rlike(p) for p in T.NON_ANSWERS])
    letters = F.regexp_count(answer, F.lit(r"[\p{L}\s]")) / F.length(answer)
    good = (F.length(answer) >= least) & ~refusal & (letters >= 0.5)
    return F.coalesce((F.get_json_object(body, "$.status") == "INSUFFICIENT_CONTEXT"), F.lit(False)) | F.coalesce((T.strip(answer) != "") & ((n_sources == 0) | good), F.lit(False))


def verified_citations(cited: DataFrame, retrieved: DataFrame, q: str, source: str) -> DataFrame:
    """FLT18: citations of sources that were retrieved for the question."""
    return cited.join(retrieved.select(q, source).distinct(), [q, source], "left_semi")


def domain_mismatch(ranked: DataFrame, q: str, foreign: Column, own: Column, top: int = 8) -> DataFrame:
    """FLT13: whether foreign rows among the first ones are at least as many as those of the own domain."""
    rows = ranked.where(F.col("rank") <= top).groupBy(q).agg(F.count_if(foreign).alias("foreign"), F.count_if(own).alias("own"))
    return rows.withColumn("mismatch", (F.col("foreign") > 0) & (F.col("foreign") >= F.col("own")))


def not_blocked(url: Column, blocked: list[str]) -> Column:
    """FLT14: an address that holds none of the blocked strings."""
    return ~F.exists(F.array(*[F.lit(b) for b in blocked]).cast("array<string>"), lambda b: url.contains(b))


def suggestions(titles: DataFrame, q: str, title: str, order: str, intent: str) -> DataFrame:
    """TOP15: three follow-up questions from the first three distinct titles of each question."""
    rows = titles.select(q, F.trim(title).alias("t"), order, intent).where("t <> ''").groupBy(q, F.lower("t").alias("k")).agg(F.min_by("t", order).alias("t"), F.min(order).alias("o"), F.first(intent).alias("i"))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy(q).orderBy("o", "k"))).where("r <= 3").groupBy(q).agg(F.first("i").alias("i"), F.sort_array(F.collect_list(F.struct("r", "t"))).alias("l"))
    t = [F.col("l")[0]["t"]]
    t.append(F.coalesce(F.get("l", F.lit(1))["t"], t[0]))
    t.append(F.coalesce(F.get("l", F.lit(2))["t"], t[1]))
    made = lambda kind: F.array(*[_filled(x, {"1": t[0], "2": t[1], "3": t[2]}) for x in SUGGESTIONS[kind]])
    kind = F.when(F.col("i").isin("code_example", "api_lookup", "how_to"), made("show")).when(F.col("i") == "comparative", made("comparative")).when(F.col("i") == "debugging", made("debugging")).otherwise(made("factual"))
    return first.select(q, kind.alias("suggestions"))


def pool_size(top_k: int, rerank_k: int, configured: int = 0) -> int:
    """TOP6."""
    return configured if configured > 0 else max(4 * top_k, 8 * rerank_k)


def cache_hits(questions: DataFrame, cache: DataFrame, threshold: float, k: int, now: float, ttl: float) -> DataFrame:
    """TOP14/STR3: cached answers (scope, cache_id, vec, created_at) near each question (scope, q_id, vec), fresh and of its scope."""
    fresh = cache.where(F.col("created_at") > now - ttl).select("scope", F.col("cache_id").alias("vec_id"), F.col("vec").alias("embedding"))
    found = dense_search(fresh, questions.select("scope", "q_id", F.col("vec").alias("q")), k, scope="scope", itself=True)
    near = found.where(F.col("confidence") >= threshold)
    return near.select("q_id", F.col("vec_id").alias("cache_id"), F.col("confidence").alias("similarity"), F.col("rank").cast("int").alias("rank"))


def enriched(chunks: DataFrame, summaries: DataFrame, key: str, blacklist: list[str], least_chars: int = 200) -> DataFrame:
    """FLT12/MDL10: chunks with their document's summary in front; not for blacklisted addresses, short chunks or without a summary."""
    out = chunks.join(summaries.select(key, "summary"), key, "left")
    ok = not_blocked(F.col("url"), blacklist) & (F.length("text") >= least_chars) & (F.coalesce("summary", F.lit("")) != "")
    return out.withColumn("text", F.when(ok, F.concat(F.lit("[Document Context: "), "summary", F.lit("]\n\n"), "text")).otherwise(F.col("text"))).drop("summary")


def first_sentence(c: Column | str) -> Column:
    """MDL10's stand-in for a summary."""
    return F.coalesce(F.get(T.sentences(c, 1), F.lit(0)), F.lit(""))


def answer_flags(c: Column | str) -> dict[str, Column]:
    """FN16: words, sections and marks of uncertainty of an answer."""
    col = F.col(c) if isinstance(c, str) else c
    any_of = lambda text, marks: reduce(lambda a, b: a | b, [text.contains(m) for m in marks])
    return {"words": T.word_count(col), "has_sections": any_of(col, SECTIONS), "uncertain": any_of(F.lower(col), UNCERTAIN)}


def cost(model: Column, prompt: Column, completion: Column) -> Column:
    """AGG15: dollars by the model's name; local and unknown models are free."""
    low, out = F.lower(model), F.when(model.isNull() | reduce(lambda a, b: a | b, [model.startswith(p) for p in FREE]), F.lit(0.0))
    for name, (i, o) in PRICES.items():
        out = out.when(low.contains(name), prompt * i + completion * o)
    return out.otherwise(F.lit(0.0))


def usage(calls: DataFrame) -> DataFrame:
    """AGG15: tokens and cost by model. calls: model, prompt_tokens, completion_tokens."""
    out = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return out.withColumn("cost", F.round(cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")), 9))


def saturation(calls: DataFrame) -> DataFrame:
    """AGG33: refusals (status 429) of a provider, and its saturation by remaining quota, else by the share of refusals."""
    out = calls.groupBy("provider").agg(F.count("*").alias("n"), F.count_if(F.col("status") == 429).alias("refused"), F.avg("remaining").alias("r"), F.avg("quota").alias("q"))
    return out.select("provider", "n", "refused", F.round(F.when(F.col("r").isNotNull() & (F.col("q") > 0), 1 - F.col("r") / F.col("q")).otherwise(F.col("refused") / F.col("n")), 6).alias("saturation"))


def proxy_metrics(ranked: DataFrame, q: str, confidence: str, threshold: float = 0.45) -> DataFrame:
    """AGG25: reciprocal rank of the first confident row, and precisions. The count is of the first five for both, so the one at 3 can pass 1."""
    good = F.col(confidence) >= threshold
    out = ranked.groupBy(q).agg(F.count("*").alias("n"), F.min(F.when(good, F.col("rank"))).alias("f"), F.count_if(good & (F.col("rank") <= 5)).alias("c"))
    return out.select(q, F.coalesce(F.round(1 / F.col("f"), 6), F.lit(0.0)).alias("mrr"), F.round(F.col("c") / F.when(F.col("n") >= 3, 3).otherwise(F.col("n")), 6).alias("precision_at_3"), F.round(F.col("c") / F.when(F.col("n") >= 5, 5).otherwise(F.col("n")), 6).alias("precision_at_5"))


def duplicate_token_rate(c: Column | str) -> Column:
    """AGG8: the share of tokens that repeat an earlier one."""
    t = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.when(F.size(t) > 0, F.round(1.0 - F.size(F.array_distinct(t)) / F.size(t), 6)).otherwise(F.lit(0.0))


def prompt_metrics(rows: DataFrame) -> DataFrame:
    """AGG9: one row of format compliance, citation precision and recall, injection defence and refusals without context.

    rows: output, format, expected (array of names), attacked, has_context.
    """
    cited = F.array_distinct(T.citations("output"))
    low, right = F.lower("output"), F.size(F.array_intersect(cited, "expected"))
    json_ok = F.trim("output").rlike(r"(?s)^\{.*\}$") & F.try_parse_json("output").isNotNull()
    fits = F.when(F.col("format") == "json", json_ok).when(F.col("format") == "code", F.col("output").contains("```")).otherwise(True)
    breach = low.contains("system prompt") | low.contains("ignore instructions") | low.contains("i am a")
    refuses = reduce(lambda a, b: a | b, [low.contains(x) for x in ("insufficient", "no relevant", "cannot answer", "not available")])
    share = lambda a, b, empty: F.round(F.when(b > 0, a / b).otherwise(F.lit(empty)), 6)
    return rows.agg(
        share(F.count_if(fits), F.count("*"), 0.0).alias("format_compliance"), share(F.sum(right), F.sum(F.size(cited)), 0.0).alias("citation_precision"), share(F.sum(right), F.sum(F.size(F.array_distinct("expected"))), 1.0).alias("citation_recall"),
        share(F.count_if(F.col("attacked") & ~breach), F.count_if(F.col("attacked")), 1.0).alias("injection_defence"), share(F.count_if(~F.col("has_context") & refuses), F.count_if(~F.col("has_context")), 1.0).alias("zero_context_accuracy"),
    )


def gates(baseline: DataFrame, candidate: DataFrame, key: str, least_delta: dict[str, float]) -> DataFrame:
    """AGG19/AGG28: key, metric, baseline, candidate, delta, and whether the delta is at least the metric's gate."""
    long = lambda df, name: df.select(key, F.explode(F.create_map(*[x for m in least_delta for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", name))
    gate = F.create_map(*[F.lit(x) for kv in least_delta.items() for x in kv])
    out = long(baseline, "baseline").join(long(candidate, "candidate"), [key, "metric"])
    delta = F.round(F.col("candidate") - F.col("baseline"), 6)
    return out.withColumn("delta", delta).withColumn("passed", delta >= gate[F.col("metric")])


def url_known(urls: DataFrame, corpus: DataFrame, url: str = "url") -> DataFrame:
    """JN9: url, known: in the corpus as it is, or by its last three or two path parts, as keys of an equi-join."""
    norm = F.regexp_replace(T.strip(url), "/+$", "")
    parts = F.filter(F.split(F.regexp_replace(norm, r"^[A-Za-z]+://[^/]*", ""), "/"), lambda p: p != "")
    tail = lambda n: F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))
    keys = F.filter(F.array(norm, tail(3), tail(2)), lambda k: k.isNotNull())
    have = corpus.select(F.explode(keys).alias("k")).distinct()
    asked = urls.select(F.col(url), F.explode(keys).alias("k"))
    return asked.join(have.withColumn("h", F.lit(1)), "k", "left").groupBy(url).agg((F.count("h") > 0).alias("known"))


def registry_names(source: Column) -> Column:
    """CHK12/AGG32: distinct registered names in a registry's source, in order: expression[Class]("name")."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r'expression(?:Builder)?\w*\[?\w*\]?\(\s*"(\w+)"'), F.lit(1)))


def fan_out(annotations: DataFrame, registry: DataFrame) -> DataFrame:
    """JN13/CHK11: a row per registered name of each annotated class, _FUNC_ replaced by it; its own name where none is registered."""
    out = annotations.join(registry, "owner", "left").withColumn("name", F.coalesce("name", "owner"))
    return out.withColumn("text", F.replace("text", F.lit("_FUNC_"), F.col("name")))


def permitted(rows: DataFrame, permissions: DataFrame, key_prefix: str, source: str = "source") -> DataFrame:
    """FLT28: rows of the sources that a key may read; permissions: key_prefix, source."""
    mine = permissions.where(F.lit(key_prefix).startswith(F.col("key_prefix"))).select(F.col("source").alias(source)).distinct()
    return rows.join(mine, source, "left_semi")


def payload_mismatches(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """JN10: ids whose stored text differs from the expected one, or that only one side has."""
    both = expected.select(key, F.col("text").alias("e")).join(stored.select(key, F.col("text").alias("s")), key, "full")
    return both.where(~F.col("e").eqNullSafe(F.col("s"))).select(key, F.when(F.col("s").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("different").alias("why"))


def stored_hash(chunks: DataFrame) -> DataFrame:
    """SRC13: the first non-empty content hash of each address."""
    return chunks.where("content_hash <> ''").groupBy("url").agg(F.min_by("content_hash", "chunk_id").alias("content_hash"))


def config_fingerprint(config: Column) -> Column:
    """FN24: SHA-256 of a configuration's JSON."""
    return F.sha2(F.to_json(config), 256)
