"""Sub-questions, guardrails, citations, headings, usage: small cases."""

import pytest
from pyspark.sql import functions as F

from skein.operators import answers as A
from skein.operators import crawl


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(("kind", "text", "want"), [
    ("comparative", "Does it run on yarn or k8s?", ["Does it run on yarn?", "Does it run on k8s?"]),
    ("comparative", "compare Parquet vs ORC?", ["What is Parquet?", "What is ORC?", "What are the differences between Parquet and ORC?"]),
    ("how_to", "How to join tables?", ["What are the prerequisites for join tables?", "What are the steps to join tables?"]),
    ("factual", "what is it", ["what is it"]),
    ("api_lookup", "df.select(x)", ["What is the signature of df.select?", "What are the parameters of df.select?", "df.select(x)"]),
])
def test_sub_questions(spark, kind, text, want):
    assert one(spark, A.sub_questions(F.col("t"), F.lit(kind)), text) == want


def test_question_rules(spark):
    f = A.inferred_filters(F.col("t"))
    assert one(spark, f["modules"], "use pyspark.sql.Functions in 3.5.1") == ["pyspark.sql.functions"]
    assert one(spark, f["versions"], "in 3.5.1 and 4.0") == ["3.5.1", "4.0"] and one(spark, f["versions"], "latest 4.0") == []
    reason = lambda t, i="factual": one(spark, A.hyde_suppression(F.col("t"), F.lit(i)), t)
    assert [reason("x", "debugging"), reason("v 1.2"), reason("`a b`"), reason("got a KeyError"), reason("what is a stage")] == ["intent:debugging", "identifier_query", "code_query", "debugging_query", None]
    assert one(spark, A.degenerate(F.col("t")), "1. do it") and one(spark, A.degenerate(F.col("t")), "abc") and not one(spark, A.degenerate(F.col("t")), "window functions")
    assert one(spark, A.modes(F.col("t")), "YARN and k8s") == ["yarn", "kubernetes"]
    assert A.pool_size(5, 3) == 24 and A.pool_size(5, 3, 7) == 7


def test_api_heading(spark):
    got = one(spark, A.api_heading(F.col("t"))["heading"], "def a.b.run(x) -> int\n:param x: y\n:param x: z")
    assert got == "[API: Module: a.b | Method: run | Params: x | Returns: int]"
    assert one(spark, A.api_heading(F.col("t"))["heading"], "no signature here") is None


def test_answer_guardrails(spark):
    ok = lambda t, n=1: one(spark, A.acceptable(F.col("t"), F.lit(n)), t)
    assert ok('{"answer": "A shuffle moves rows between tasks."}') and ok('```json\n{"answer": "A shuffle moves rows between tasks."}\n```')
    assert not ok("plain text without code") and not ok('{"answer": "short"}') and ok('{"answer": "short"}', 0) and ok("```python\nlong enough code here to pass\n```") and not ok(None)
    assert one(spark, A.parsed_answer(F.col("t")), '{"response": "r"}') == "r" and one(spark, A.parsed_answer(F.col("t")), "raw") == "raw"
    assert one(spark, A.without_sources(F.col("t")), "text\nSources: [a, b]") == "text"


def test_lists(spark):
    r = spark.createDataFrame([(1, "own", 1, 0.5), (1, "alien", 2, 0.2), (1, "alien", 3, 0.1)], "q long, source string, rank int, c double")
    assert A.domain_mismatch(r, "q", F.col("source") == "alien", F.col("source") == "own").first().mismatch
    got = A.proxy_metrics(spark.createDataFrame([(1, k, 0.9) for k in range(1, 6)], "q long, rank int, c double"), "q", "c").first()
    assert got.precision_at_3 == pytest.approx(5 / 3, abs=1e-6)  # trap 8
    t = spark.createDataFrame([(1, "A", 1, "factual"), (1, "a", 2, "factual"), (1, "B", 3, "factual")], "q long, title string, o int, i string")
    assert A.suggestions(t, "q", "title", "o", "i").first().suggestions == ["What does the documentation say about A?", "Can you explain B in more detail?", "Give me a code example for B."]
    c = spark.createDataFrame([("s", 1, [1.0, 0.0], 100.0), ("s", 2, [0.0, 1.0], 100.0), ("s", 3, [1.0, 0.0], 1.0), ("o", 4, [1.0, 0.0], 100.0)], "scope string, cache_id long, vec array<double>, created_at double")
    q = spark.createDataFrame([("s", 9, [1.0, 0.1])], "scope string, q_id long, vec array<double>")
    assert [x.cache_id for x in A.cache_hits(q, c, 0.9, 3, 120.0, 60.0).collect()] == [1]
    rows = spark.createDataFrame([("{\"a\": 1} [x]", "json", ["x"], False, True), ("[Doc-a] ok", "text", ["a", "b"], True, True), ("cannot answer", "code", [], False, False)], "output string, format string, expected array<string>, attacked boolean, has_context boolean")
    m = A.prompt_metrics(rows).first()
    assert (m.format_compliance, m.citation_precision, m.citation_recall, m.injection_defence, m.zero_context_accuracy) == (0.333333, 1.0, 0.333333, 1.0, 1.0)
    g = A.gates(spark.createDataFrame([("k", 0.5)], "k string, recall double"), spark.createDataFrame([("k", 0.49)], "k string, recall double"), "k", {"recall": -0.02}).first()
    assert g.passed and g.delta == -0.01
    u = A.url_known(spark.createDataFrame([("https://x/a/b/c/",), ("https://x/z",)], "url string"), spark.createDataFrame([("https://y/q/b/c",)], "url string"))
    assert {r.url: r.known for r in u.collect()} == {"https://x/a/b/c/": True, "https://x/z": False}
    fan = A.fan_out(spark.createDataFrame([("C", "_FUNC_(x)"), ("D", "_FUNC_")], "owner string, text string"), spark.createDataFrame([("C", "f"), ("C", "g")], "owner string, name string"))
    assert sorted(r.text for r in fan.collect()) == ["D", "f(x)", "g(x)"]
    assert one(spark, A.registry_names(F.col("t")), 'expression[Abs]("abs"), expressionBuilder("nvl", x)') == ["abs", "nvl"]
    p = spark.createDataFrame([("k1", "a")], "key_prefix string, source string")
    assert A.permitted(spark.createDataFrame([("a",), ("b",)], "source string"), p, "k1-secret").count() == 1
    e, s = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, text string"), spark.createDataFrame([("1", "x"), ("2", "z"), ("3", "w")], "id string, text string")
    assert {r.id: r.why for r in A.payload_mismatches(e, s, "id").collect()} == {"2": "different", "3": "unexpected"}
    edges = spark.createDataFrame([(1, 2, "r")], "source_id long, target_id long, relation_type string")
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert crawl.neighbours(edges, nodes, "A").first().target == "b"
