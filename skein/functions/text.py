"""Column expressions over text: tokens, similarity, cleaning, PII, signals, quality flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
STOPWORDS = "the a an and or in on at to of is are it as be by for with that this from which not we do if my has had was were can may its but".split()
FILLERS = "the a an and or in on at to of is are".split()
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
#: What every match of a kind holds, quickly found: the pattern itself is tried on texts that have it only. No replacement adds any.
PII_GATES = {"email": "@", "credit_card": "[0-9]{4}", "ssn": "[0-9]{3}-[0-9]", "phone": "[0-9]{3}", "ip_address": r"[0-9]\.[0-9]"}
MASK_ORDER = ["email", "phone", "ssn", "credit_card", "ip_address"]
DIRECTIVES = [
    r"ignore\s+(all\s+)?(previous|above|prior|the\s+above)\s+(instructions|prompts|directions)",
    r"you\s+are\s+(now|free|an?\s+ai\s+named|dan)",
    r"(reveal|leak|dump|display|output)\s+(all\s+)?(instructions|prompt|system|constraints)",
    r"act\s+as\s+(dan|an?\s+ai\s+without|if\s+you\s+are)",
    r"bypass|jailbreak|breach|compromise",
    r"new\s+(system|developer)\s*(role|prompt|instructions)\s*:",
    r"override\s+((all\s+)?(previous|prior|above|system))\s+(instructions|prompts|rules|constraints)",
    r"(forget|disregard|ignore)\s+(everything|all|your)\s+(previous|prior|instructions|rules)",
    r"you\s+(are|must|should)\s+now\s+(act|behave|respond)\s+as",
    r"\[inst\]|\[/inst\]|<<sys>>|<</sys>>",
    r"###\s*(system|human|assistant)\s*:",
]
DESCRIPTIVE = r"system\s+prompt|developer\s+mode|prompt\s+injection"
STRUCTURAL = r"(?m)^#{1,6}\s*(system|constraints|instructions|output format)"
NOISE = [r"(?m)^\d{2}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+(INFO|WARN|DEBUG|ERROR)\s+.*$", r"org\.apache\.spark\.[a-zA-Z0-9\._]+", r"[\{\}\[\]\(\)\<\>]", r"\n{3,}"]
DOTTED, SNAKE, CAMEL = r"\b[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)+\b", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", r"\b[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+\b"
PATH = r"\b[\w.~-]+(?:/[\w.~-]+){1,}\b|\b[\w.\\-]+(?:\\[\w.\\-]+){1,}\b"
VERSION = r"\b\d+\.\d+(?:\.\d+)?\b"
SQL_WORDS = r"(?i)\b(select|from|where|group\s+by|order\s+by|join|case\s+when|insert\s+into|update\s+|delete\s+from|create\s+(table|view)|having|limit|distinct)\b"
CODE = r"```|`[^`\n]+`|\b(def|class|import|return|print)\b|\b\w+\s*\("
MODE_OR = r"\b(yarn|kubernetes|k8s|standalone)\s+or\s+(yarn|kubernetes|k8s|standalone)\b"
INTENTS = [
    ("api_lookup", r"(?i)\b(\w+\.\w+\s*\(|DataFrame\.|SparkSession\.|spark\.read|spark\.sql|\.groupBy|\.select|\.filter|\.join|\.agg|\.write|\.show)\b"),
    (
        "code_example",
        r"(?i)\b((give|show|provide|send|write|generate|get)\s+(me\s+)?(a\s+)?\w*\s*(sample|example|snippet|code)"
        r"|(give|show|provide|send|write|generate|get)\s+(me\s+)?(the\s+)?(sample\s+|example\s+)?code"
        r"|how\s+to\s+(write|code|implement|build|script|program)|code\s+(to|for|example|snippet|sample)|write\s+(a\s+)?(script|function|program|query|pipeline))\b",
    ),
    ("comparative", rf"(?i)\b(compare|vs\.?|versus|difference between|pros and cons)\b|{MODE_OR}"),
    ("debugging", r"(?i)\b(why is|error|fail|bug|oom|exception|not working|broken|crash|issue|problem)\b"),
    ("how_to", r"(?i)\b(how (to|do|can|should)|step[- ]by[- ]step|guide|tutorial|set up|configure|install)\b"),
]
NON_ANSWERS = ["i cannot answer", "outside my knowledge", "missing information:", "insufficient context", r"no relevant (documents|sources)", r"as an ai (language )?model", r"i don't have (enough|sufficient|access)"]
UNCITED = r"\[Doc-([^\]]+)\]"
#: ASCII white space, as DuckDB's and Java's \s have it.
SPACE = r"\s"


def _all(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def words(c: Column | str) -> Column:
    """Runs of characters that are not white space."""
    return _all(c, r"\S+")


def word_count(c: Column | str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def token_set(c: Column | str) -> Column:
    """FN1: distinct runs of [a-z0-9_] of the lower-cased text."""
    return F.array_distinct(_all(F.lower(c), "[a-z0-9_]+"))


def bm25_tokens(c: Column | str) -> Column:
    """FN6 without the stemmer: runs of at least two of [a-z0-9_-], without stop words."""
    return F.filter(_all(F.lower(c), r"[a-z0-9_\-]{2,}"), lambda t: ~t.isin(STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """FN3; 0 if either set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def token_cosine(a: Column, b: Column) -> Column:
    """FN2: |A n B| / sqrt(|A| |B|); 0 if either set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt((F.size(a) * F.size(b)).cast("double"))).otherwise(F.lit(0.0))


def collapse(c: Column | str) -> Column:
    """PRS18: white space to single spaces, trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^\s+|\s+$", "")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def alnum_ratio(c: Column | str) -> Column:
    """Letters and digits among all characters; 0 for an empty text."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(r"[\p{L}\p{N}]")) / F.length(c)).otherwise(F.lit(0.0))


def clean(c: Column | str) -> Column:
    """FLT2: without log lines, qualified engine names and brackets, runs of blanks and line feeds collapsed."""
    out = reduce(lambda x, p: F.regexp_replace(x, p, " "), NOISE, F.col(c) if isinstance(c, str) else c)
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n+", "\n"))


def repetition_ratio(c: Column | str) -> Column:
    """Share of non-blank lines that repeat an earlier one."""
    lines = F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")
    return F.when(F.size(lines) > 0, 1.0 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(F.lit(0.0))


def noise_reason(c: Column | str, least_words: int = 15, least_alnum: float = 0.5, most_repeated: float = 0.3) -> Column:
    """FLT1: why a chunk is dropped, null if it stays. Words are counted in the cleaned text, ratios in the raw one."""
    n = word_count(clean(c))
    return (
        F.when(F.coalesce(strip(c), F.lit("")) == "", "empty").when(n == 0, "no_words").when(n < least_words, "low_word_count")
        .when(alnum_ratio(c) < least_alnum, "low_alpha_density").when(repetition_ratio(c) > most_repeated, "high_repetition")
    )


def density(c: Column | str) -> Column:
    """FLT27: HIGH, MEDIUM or LOW from words and the share of letters and digits."""
    n, ratio = word_count(c), alnum_ratio(c)
    return F.when((n > 100) & (ratio > 0.7), "HIGH").when((n > 30) & (ratio > 0.5), "MEDIUM").otherwise("LOW")


def _may_have(kind: str, c: Column) -> Column:
    return c.contains("@") if kind == "email" else c.rlike(PII_GATES[kind])


def redacted(c: Column | str) -> tuple[Column, Column]:
    """FLT9: the text with every kind of PII replaced in turn, and the kinds found, each on the text as replaced so far."""
    text = F.col(c) if isinstance(c, str) else c
    out, found = text, []
    for kind, pattern in PII.items():
        found.append(F.when(_may_have(kind, text) & out.rlike(pattern), F.lit(kind)))
        out = F.when(_may_have(kind, text), F.regexp_replace(out, pattern, f"[REDACTED_{kind.upper()}]")).otherwise(out)
    return out, F.filter(F.array(*found), lambda x: x.isNotNull())


def pii_counts(c: Column | str) -> dict[str, Column]:
    """FLT8: matches of each kind in the text as it is."""
    text = F.col(c) if isinstance(c, str) else c
    return {kind: F.when(_may_have(kind, text), F.regexp_count(text, F.lit(p))).otherwise(F.lit(0)) for kind, p in PII.items()}


def masked(c: Column | str) -> Column:
    """FLT10: partial masks, in an order of their own; the middle of a number becomes stars of its length."""
    out = F.col(c) if isinstance(c, str) else c
    for kind in MASK_ORDER:
        found = _all(out, PII[kind])
        if kind == "email":
            local, domain = lambda m: F.substring_index(m, "@", 1), lambda m: F.substring_index(m, ".", -1)
            mask = lambda m: F.concat(F.when(F.length(local(m)) <= 1, "*").otherwise(F.concat(F.substring(m, 1, 1), F.lit("***"))), F.lit("@***."), domain(m))
        elif kind == "phone":
            mask = lambda m: F.concat(F.lit("***-***-"), F.right(F.regexp_replace(m, r"\D", ""), F.lit(4)))
        else:
            mask = lambda m: F.concat(F.left(m, F.lit(2)), F.repeat(F.lit("*"), F.length(m) - 4), F.right(m, F.lit(2)))
        gaps = F.split(out, PII[kind], -1)
        parts = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.transform(found, mask), i), F.lit(""))))  # noqa: B023
        out = F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(out)
    return out


def injection_score(c: Column | str, first: int | None = 4000) -> Column:
    """FLT7: 0.3 a directive; a descriptive mention and a structural header only add to a directive; at most 1."""
    low = F.lower(F.substring(c, 1, first) if first else c)
    hit = lambda p: F.when(low.rlike(p), 1).otherwise(0)
    fired = reduce(lambda a, b: a + b, [hit(p) for p in DIRECTIVES])
    tenths = fired * 3 + hit(DESCRIPTIVE) * 3 + hit(STRUCTURAL) * 4
    return F.coalesce(F.when(fired > 0, F.least(F.lit(10), tenths) / 10).otherwise(F.lit(0.0)), F.lit(0.0))


def signals(c: Column | str) -> dict[str, Column]:
    """FN9: what makes a question technical."""
    col = F.col(c) if isinstance(c, str) else c
    return {
        "identifier_heavy": col.rlike(DOTTED) | (F.regexp_count(col, F.lit(SNAKE)) >= 3) | (F.regexp_count(col, F.lit(CAMEL)) >= 2),
        "path_heavy": col.rlike(PATH),
        "version_qualified": col.rlike(VERSION),
        "code_like": col.rlike(SQL_WORDS) | col.rlike(CODE),
    }


def intent(c: Column | str) -> Column:
    """FN11: the first intent whose pattern is found, else factual."""
    col = F.col(c) if isinstance(c, str) else c
    first, *rest = INTENTS
    out = F.when(col.rlike(first[1]), first[0])
    for name, pattern in rest:
        out = out.when(col.rlike(pattern), name)
    return out.otherwise("factual")


def search_mode(kind: Column, of: dict[str, Column]) -> Column:
    """FN10: the way to search, by intent, else by signals."""
    return (
        F.when(kind.isin("api_lookup", "code_example"), "bm25_only").when(kind == "debugging", "hybrid_sparse_bias")
        .when(kind.isin("factual", "how_to", "synthesis"), "dense_only").when(kind == "comparative", "hybrid_equal").when(kind == "configuration", "hybrid_dense_bias")
        .when(of["identifier_heavy"] | of["code_like"], "hybrid_sparse_bias").when(of["path_heavy"] | of["version_qualified"], "hybrid_dense_bias").otherwise("hybrid_equal")
    )


def rrf_profile(of: dict[str, Column]) -> Column:
    return F.when(of["identifier_heavy"] | of["path_heavy"] | of["version_qualified"] | of["code_like"], "identifier_sparse_rrf").otherwise("equal_rrf")


def sanitized(c: Column | str, most: int = 2000) -> Column:
    """FLT22: a question without fences, headers and control characters; at most 2000 characters."""
    out = F.regexp_replace(F.regexp_replace(c, "```", ""), r"(?m)^#{1,6}\s+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"\n{3,}", "\n\n")
    return strip(F.substring(out, 1, most))


def normalized_query(c: Column | str) -> Column:
    """FN14: lower case, ASCII letters, digits, underscores and single spaces only; what a cache key hashes."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"[^a-z0-9_\s]", ""), r"\s+", " ")


def difficulty(c: Column | str) -> Column:
    """FN15."""
    low, n = F.lower(c), word_count(c)
    compares = low.rlike("vs|compare|difference|versus")
    several = F.col(c).contains(" and ") | (F.regexp_count(c, F.lit(",")) > 1) if isinstance(c, str) else c.contains(" and ") | (F.regexp_count(c, F.lit(",")) > 1)
    return F.when((n > 15) & (compares | several), "hard").when((n < 8) & ~(compares | several), "easy").otherwise("medium")


def boundary_flags(c: Column | str) -> dict[str, Column]:
    """FN17: what is odd about a chunk's edges. The flag of a chunk that ends in a table has the name it always had."""
    head, tail = strip(c), F.regexp_replace(c, r"\s+$", "")
    lines = F.split(F.regexp_replace(c, r"\n$", ""), "\n", -1)
    return {
        "starts_lowercase_continuation": head.rlike(r"^\p{Ll}"),
        "ends_mid_sentence": tail.rlike(r"[\p{L}\p{N}_]$"),
        "unbalanced_code_fence": F.regexp_count(c, F.lit(r"(?m)^[ \t]*```")) % 2 == 1,
        "starts_markdown_table": F.ltrim(F.element_at(lines, -1)).startswith("|"),
    }


def sentences(c: Column | str, least_words: int = 3) -> Column:
    """FLT21: what ends in . ! or ? before white space, of at least three words."""
    marked = F.regexp_replace(c, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001", -1), strip), lambda s: word_count(s) >= least_words)


def cacheable(answer: Column, confidence: Column, n_sources: Column) -> Column:
    """FLT16: an answer with sources, enough confidence and no refusal in it."""
    refusal = reduce(lambda a, b: a | b, [F.lower(answer).rlike(p) for p in NON_ANSWERS])
    return (strip(answer) != "") & (confidence >= 0.5) & ~refusal & (n_sources > 0)


def citations(c: Column | str) -> Column:
    """FN26: names cited as [Doc-name]."""
    return F.regexp_extract_all(c, F.lit(UNCITED), F.lit(1))


def truncated(c: Column, limit: int) -> Column:
    """FLT23: at most limit characters, cut at the last blank line beyond 60 %, else at the last line end beyond half."""
    cut = F.substring(c, 1, limit)
    last = lambda s: F.when(F.locate(s[::-1], F.reverse(cut)) > 0, F.length(cut) - F.locate(s[::-1], F.reverse(cut)) - len(s) + 1).otherwise(-1)
    para, line = last("\n\n"), last("\n")
    return F.when(F.length(c) <= limit, c).when(para > limit * 0.6, F.substring(cut, F.lit(1), para)).when(line > limit * 0.5, F.substring(cut, F.lit(1), line)).otherwise(cut)


def uuid5(namespace: Column, name: Column) -> Column:
    """A version-5 UUID of a name in a namespace given as 16 bytes."""
    h = F.sha1(F.concat(namespace, F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: The name space of domain names, RFC 9562.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def chunk_id(url: Column, source: Column, index: Column, tag: str = ":") -> Column:
    """UUID of a chunk: of its source and index in the name space of its page's address."""
    page = uuid5(F.unhex(F.lit(DNS)), url)
    return uuid5(F.unhex(F.regexp_replace(page, "-", "")), F.concat(source, F.lit(tag), F.lpad(index.cast("string"), 4, "0")))
