"""Stemmer, searches and list steps against brute-force versions over whole tables; model and evaluation steps on small cases."""

import html
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import stem
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import chunking, crawl, dedup, evaluation, metrics, models, ranking, search, series
from skein.plans import catalog, registry, runtime, store
from skein.plans import steps as _steps  # noqa: F401
from skein.sources import files

#: Words of the algorithm's publication and their stems.
PUBLISHED = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate
cease ceas controll control roll roll""".split()


def test_published_stems():
    assert [stem.stem(w) for w in PUBLISHED[::2]] == PUBLISHED[1::2]
    assert [stem.stem(w) for w in ("Dying", "ties", "enjoy", "skies", "at", "died", "proceed")] == ["die", "tie", "enjoy", "sky", "at", "die", "proceed"]


def test_tokenizers():
    assert stem.word_tokens("The quick brown fox is in the box") == ["quick", "brown", "fox", "box"] and stem.word_tokens("the a") == stem.word_tokens("") == []
    got = stem.namespace_tokens("spark.sql.functions.row_number")
    assert got == ["spark.sql.functions.row_number", "spark", "sql", "function", "row_numb"]
    assert stem.namespace_tokens("lake/raw/tables")[0] == "lake/raw/tables"
    version = stem.namespace_tokens("use v3.4.1 now")
    assert version == ["v3.4.1", "v3", "use", "now"] and stem.namespace_tokens("Spark.SQL") == stem.namespace_tokens("spark.sql")
    url = stem.namespace_tokens("see https://spark.apache.org/docs/latest")
    assert "spark.apache.org/docs/latest" in url and "https" not in url and {"spark", "apach", "org", "doc", "latest"} <= set(url)
    assert stem.namespace_tokens("plain words only") == stem.word_tokens("plain words only")
    assert stem.namespace_tokens("...") == stem.namespace_tokens("::") == [] and stem.namespace_tokens("use ... or") == stem.word_tokens("use or")


@pytest.mark.parametrize("of", [stem.word_tokens, stem.namespace_tokens])
def test_stemmed_search_matches_brute_force(spark, sf_dir, of):
    docs, asked = ({r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()} for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    tf = {i: Counter(of(t or "")) for i, t in docs.items()}
    tf = {i: c for i, c in tf.items() if c}
    df = Counter(t for c in tf.values() for t in c)
    avg = sum(sum(c.values()) for c in tf.values()) / len(tf)

    def weights(c):
        n = sum(c.values())
        return {t: math.log((len(tf) - df[t] + 0.5) / (df[t] + 0.5) + 1) * (k / n) * 2.2 / (k / n + 1.2 * (0.25 + 0.75 * n / avg)) for t, k in c.items() if t in df}

    by_doc, want = {i: weights(c) for i, c in tf.items()}, {}
    for q, t in asked.items():
        w = weights(Counter(of(t)))
        scores = {i: sum(v * d[t] for t, v in w.items() if t in d) for i, d in by_doc.items() if w.keys() & d.keys()}
        want[q] = sorted((-round(s, 6), i) for i, s in scores.items())[:10]
    query = search.bm25_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, tokens=stem.stemmed if of is stem.word_tokens else stem.namespaced)
    got = defaultdict(list)
    for r in query.orderBy("item_id", "rank").collect():
        got[r.item_id].append((-r.score, r.doc_id))
    assert {q: [round(s, 5) for s, _ in x] for q, x in got.items()} == {q: [round(s, 5) for s, _ in x] for q, x in want.items() if x}
    same = sum([i for _, i in got[q]] == [i for _, i in want[q]] for q in got)
    assert same >= 0.95 * len(got)  # ties by the last digit aside


@pytest.mark.parametrize("dims", [None, 8])
def test_dense_search_matches_brute_force(spark, monkeypatch, dims):
    """Ties, zero and null vectors, other lengths, more questions than a block holds."""
    monkeypatch.setattr(search, "BROADCAST_ROWS", 7)
    monkeypatch.setattr(search, "TILE", 3)
    r = np.random.default_rng(2)
    vecs = r.standard_normal((60, 16)).round(1)
    rows = [(k, vecs[k % 40].tolist()) for k in range(60)] + [(70, [0.0] * 16), (71, None), (72, [1.0] * 5)]
    asked = [(k, vecs[k].tolist()) for k in range(0, 40, 2)] + [(72, [1.0] * 5)]
    got = defaultdict(list)
    schema = "vec_id long, embedding array<double>"
    out = search.dense_search(spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame(asked, "q_id long, q array<double>"), 6, dims)
    for x in out.orderBy("q_id", "rank").collect():
        got[x.q_id].append((x.vec_id, x.confidence))
        assert x.distance == pytest.approx(1 - x.confidence)
    cut = lambda v: np.array((v or [])[:dims])

    def cos(a, b):
        a, b = cut(a), cut(b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return min(1.0, max(0.0, float(a @ b / n))) if len(a) == len(b) and n else 0.0

    for q, v in asked:
        want = sorted((-round(cos(v, e), 6), k) for k, e in rows if k != q)[:6]
        assert [(k, -s) for s, k in want] == got[q]


def test_embedding_pairs_match_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.standard_normal(4).tolist(), k % 3 if k % 10 else None) for k in range(90)] + [(100, None, 1), (101, [1.0], 1)]
    got = {(x.a, x.b): x.similarity for x in dedup.embedding_pairs(spark.createDataFrame(rows, "k long, v array<double>, label int"), "k", "v", 0.6, "label", rows=7).collect()}
    want = {}
    for a, u, la in rows:
        for b, v, lb in rows:
            if a < b and la == lb and la is not None and u and v and len(u) == len(v):
                s = float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))
                if round(s, 6) >= 0.6:
                    want[a, b] = round(s, 6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 100


def test_vector_functions_find_norms_once(spark):
    """The plan of a cosine names each norm once, and unit() doesn't divide by a norm of its own for each component."""
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.unit(F.col("a")).alias("u")).collect()
    assert [r.c for r in got] == pytest.approx([0.96, 0.0, 0.0]) and [r.u for r in got] == [[0.6, 0.8], [0.0, 0.0], []]
    plan = df.select(V.unit(F.col("a")).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1


def hit_texts(spark, sf_dir):
    rows = defaultdict(list)
    for r in catalog._hit_texts(spark, sf_dir).orderBy("item_id", "rank").collect():
        rows[r.item_id].append(r)
    return rows


def test_greedy_lists_match_brute_force(spark, sf_dir):
    """mmr_rerank, near_dup_greedy, trigram_maxsim and context_selection over all questions."""
    lists = hit_texts(spark, sf_dir)
    tokens = lambda t: set(re.findall(r"[a-z0-9_]+", t.lower()))
    mmr, greedy, maxsim, context = (defaultdict(list) for _ in range(4))
    for q, rows in lists.items():
        left, placed = list(rows), []
        while left:
            like = lambda a, b: len(tokens(a.text) & tokens(b.text)) / math.sqrt(len(tokens(a.text)) * len(tokens(b.text))) if tokens(a.text) and tokens(b.text) else 0.0
            best = max(left, key=lambda x: (0.5 * x.score - 0.5 * max((like(x, p) for p in placed), default=0.0), -x.rank))
            placed.append(best)
            left.remove(best)
        mmr[q] = [x.doc_id for x in placed]
        kept = []
        for x in rows:
            bag = set(x.text.lower().split()) - set(T.FILLERS)
            if all(not (bag and b) or len(bag & b) / len(bag | b) <= 0.7 for _, b in kept):
                kept.append((x.doc_id, bag))
        greedy[q] = [i for i, _ in kept]
        grams = lambda w: {w[i : i + 3] for i in range(max(1, len(w) - 2))}
        for x in rows:
            qs, ds = re.findall(r"\w+", x.question.lower())[:32], re.findall(r"\w+", x.text.lower())[:256]
            maxsim[q].append(round(sum(max((len(grams(a) & grams(b)) / max(len(grams(a)), len(grams(b))) for b in ds), default=0) for a in qs) / len(qs), 6) if qs and ds else 0.0)
        covered, chosen, used = Counter(), [], 0
        for deep in (False, True):
            for x in rows:
                if (not deep and covered[x.source]) or (deep and (not covered[x.source] or x.doc_id in chosen)):
                    continue
                n = len(x.text) + len(x.source) + 50
                if deep and covered[x.source] >= 2:
                    context[q].append((x.doc_id, None, "dropped_due_per_source_cap"))
                elif chosen and used + n + 2 > 16_000:
                    context[q].append((x.doc_id, None, "dropped_due_total_context_budget"))
                else:
                    used, covered[x.source] = used + n + 2, covered[x.source] + 1
                    chosen.append(x.doc_id)
                    context[q].append((x.doc_id, len(chosen), "selected"))
    by = lambda df, *cols: {q: [r[1:] if len(cols) > 1 else r[1] for r in rows] for q, rows in _groups(df, *cols).items()}
    run = registry.queries()
    assert by(run["mmr_rerank"](spark, sf_dir).orderBy("item_id", "position"), "doc_id") == mmr
    assert by(run["near_dup_greedy"](spark, sf_dir).orderBy("item_id", "rank"), "doc_id") == greedy
    got = run["trigram_maxsim"](spark, sf_dir).collect()
    want = {(q, x.doc_id): s for q, rows in lists.items() for x, s in zip(rows, maxsim[q], strict=True)}
    assert all(abs(r.likeness - want[r.item_id, r.doc_id]) < 2e-6 for r in got) and len(got) == sum(min(5, len(x)) for x in lists.values())
    got = by(run["context_selection"](spark, sf_dir), "doc_id", "position", "reason")
    assert {q: sorted(map(str, map(tuple, x))) for q, x in got.items()} == {q: sorted(map(str, x)) for q, x in context.items()}


def test_trigram_maxsim_scores_whole_texts(spark, sf_dir):
    """Every word of a question and of its hits counts."""
    grams = lambda w: {w[i : i + 3] for i in range(max(1, len(w) - 2))}
    want, words = {}, 0
    for q, rows in hit_texts(spark, sf_dir).items():
        for x in rows:
            qs, ds = re.findall(r"\w+", x.question.lower()), set(re.findall(r"\w+", x.text.lower()))
            want[q, x.doc_id] = sum(max((len(grams(a) & grams(b)) / max(len(grams(a)), len(grams(b))) for b in ds), default=0) for a in qs) / len(qs) if qs and ds else 0.0
            words = max(words, len(re.findall(r"\w+", x.text)))
    got = registry.queries()["trigram_maxsim"](spark, sf_dir).collect()
    assert words > 256 and got and all(r.likeness == pytest.approx(want[r.item_id, r.doc_id], abs=2e-6) for r in got)


def _groups(df, *cols):
    out = defaultdict(list)
    for r in df.select("item_id", *cols).collect():
        out[r[0]].append(tuple(r))
    return out


def test_history_budget_matches_brute_force(spark, sf_dir):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", F.desc("turn")).collect():
        turns[r.conv_id].append((r.turn, math.ceil(len(r.text) / 4)))
    want = set()
    for conv, rows in turns.items():
        used = 0
        for t, n in rows:
            if used + n <= 250:
                used += n
                want.add((conv, t, n))
    assert {tuple(r) for r in registry.queries()["history_token_budget"](spark, sf_dir).select("conv_id", "turn", "tokens").collect()} == want


@pytest.mark.parametrize("how", ["budget", "sentence", "header"])
def test_splitters_over_the_corpus(spark, sf_dir, how):
    """Lossless pieces join to the text; the others keep every word in order, bar what overlaps."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if r.text}
    parts = defaultdict(list)
    for r in registry.queries()[f"{how}_chunks"](spark, sf_dir).orderBy("doc_id", "chunk_index").collect():
        parts[r.doc_id].append(r.text)
        assert r.total_chunks > r.chunk_index
    for i, t in texts.items():
        if how == "budget":
            assert "".join(parts[i]) == t and all(chunking.count_tokens(p) <= 256 for p in parts[i])
        else:
            assert set(t.split()) == {w for p in parts[i] for w in p.split()} | ({w for w in t.split() if w.startswith("#")} if how == "header" else set())


def test_hierarchical_over_the_corpus(spark, sf_dir):
    rows = registry.queries()["hierarchical_chunks"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if r.text}
    level = {name: [r for r in rows if r.level == name] for name in ("parent", "child")}
    parents, children = defaultdict(list), defaultdict(list)
    for r in sorted(level["parent"], key=lambda r: r.segment_index):
        parents[r.doc_id].append(r.text)
    for r in sorted(level["child"], key=lambda r: r.segment_index):
        children[r.parent_chunk_id].append(r.text)
    assert {i: "".join(p) for i, p in parents.items()} == texts and all("".join(children[r.chunk_id]) == r.text for r in level["parent"])
    assert all(r.token_count <= (1024 if r.level == "parent" else 256) for r in rows)


def test_markdown_queries(spark, sf_dir):
    """Every word of a page's article stands in its Markdown; the scan counts its headings."""
    got = {r.page_id: r.markdown for r in registry.queries()["html_to_markdown"](spark, sf_dir).collect()}
    scan = {r.page_id: r for r in registry.queries()["markdown_scan"](spark, sf_dir).collect()}
    assert got.keys() == scan.keys() and len(got) > 20
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        if r.page_id in got:
            article = re.search(r"(?is)<article>(.*?)</article>", r.html)[1]
            words = set(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
            assert len({w for w in words if w in got[r.page_id]}) >= 0.9 * len(words)
            fenced = re.sub(r"(?s)```.*?(```|\Z)", "", got[r.page_id])
            assert scan[r.page_id].headings == len(re.findall(r"(?m)^#{1,6}\s+\S", fenced))


def test_moving_average_by_its_definition(spark):
    rows = [(k, k % 3, 0.5 * k) for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    for r in series.moving_average(df, "user_id").collect():
        ema = None
        for _, u, v in rows:
            if u == r.user_id:
                ema = v if ema is None else 0.3 * v + 0.7 * ema
        assert r.ema == pytest.approx(ema, abs=1e-6)


def test_model_steps(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c).first()[0]
    cover = models.covered(F.col("t"))
    cases = {'{"verdict": "covers"}': True, '{"verdict": " DOES_NOT_COVER "}': False, "```json\n{\"covered\": false}\n```": False, '{"covered": true}': True, "garbage": True, 'x "verdict": "does_not_cover" y': False, None: True, "": True}
    assert {k: one(cover, k) for k in cases} == cases
    s = models.claim_support(F.col("t"), F.lit(0.4))
    assert one(s["score"], '[{"claim": "a", "supported": true}, {"claim": " b ", "supported": false}]') == 0.5 and one(s["unsupported"], '[{"claim": " b ", "supported": false}]') == ["b"]
    assert one(s["score"], "[]") == 0.0 and one(s["score"], "no json") == 0.4 and one(s["supported"], "no json") is False and one(s["score"], '{"claim": 1}') == 0.4
    assert [one(models.judged(F.col("t")), x) for x in ('{"score": 0.3}', '{"score": 5}', "?", None)] == [0.3, 1.0, 1.0, 1.0]
    assert one(models.heading_terms(F.col("t")), "How to Use Window functions with window frames") == ["Window", "functions", "frames"]
    v = one(models.hashed_vector("t", 16), "some words of a text")
    assert len(v) == 16 and sum(x * x for x in v) == pytest.approx(1.0) and one(models.hashed_vector("t", 16), "...") == [0.0] * 16
    calls = spark.createDataFrame([(1, 0, False, "a"), (1, 1, True, "b"), (1, 2, True, "c"), (2, 0, False, "a"), (3, 0, True, "a")], "k long, place int, ok boolean, provider string")
    assert {(r.k, r.provider, r.degraded) for r in models.first_success(calls, "k", "place", "ok", ["provider"]).collect()} == {(1, "b", True), (3, "a", False)}


def test_rerank_steps(spark):
    rows = [(1, d, d, 0.1 * d) for d in range(1, 5)] + [(2, 1, 1, 0.9), (2, 2, 2, 0.8)]
    df = spark.createDataFrame(rows, "q long, doc long, rank int, confidence double")
    scored = ranking.score_rerank(df.withColumn("logit", F.col("doc").cast("double")), "q", "logit", 2).orderBy("q", "position").collect()
    assert [(r.q, r.doc) for r in scored] == [(1, 4), (1, 3), (2, 1), (2, 2)] and scored[0].confidence == 1.0 and scored[2].confidence == 0.9
    said = spark.createDataFrame([(1, 3, 7.0), (1, 1, 5.0)], "q long, doc long, score double")
    got = ranking.provider_rerank(df, said, "q", "doc", 3).orderBy("q", "position").collect()
    assert [(r.q, r.doc, r.confidence) for r in got] == [(1, 3, 1.0), (1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.9), (2, 2, 0.8)]
    equal = ranking.provider_rerank(df, spark.createDataFrame([(1, 2, 0.0), (1, 4, 0.0)], "q long, doc long, score double"), "q", "doc", 4).where("q = 1").orderBy("position").collect()
    assert [(r.doc, r.confidence) for r in equal] == [(2, 0.0), (4, 0.0), (1, 0.0), (3, 0.0)]
    values = [r[0] for r in spark.createDataFrame([(None,), (float("nan"),), (2.0,), (-1.0,), (0.4,)], "c double").select(ranking.clamped(F.col("c"))).collect()]
    assert values == [0.0, 0.0, 1.0, 0.0, 0.4]


def test_evaluation_steps(spark):
    rows = spark.createDataFrame([(1, 1, "a b c", "s1"), (1, 2, "a b c", "s2"), (1, 3, "x y", "s1"), (2, 1, "", "s9")], "q long, rank int, text string, source string")
    want = spark.createDataFrame([(1, ["s1", "s3"], ["A B", "zzz"]), (2, [], [])], "q long, sources array<string>, facts array<string>")
    got = {r.q: r for r in evaluation.strategy_metrics(rows, want, "q", "rank", "text", "source").collect()}
    assert (got[1].duplicate_rate, got[1].source_coverage, got[1].groundedness, got[1].chars) == (0.3333, 0.5, 0.5, 13) and (got[2].source_coverage, got[2].groundedness) == (0.0, 1.0)
    means = evaluation.mean_scores(spark.createDataFrame([(1.0,), (None,), (float("nan"),), (0.5,)], "m double"), ["m"]).first()
    assert (means.m, means.m_n) == (0.75, 2)
    worse = spark.createDataFrame([(0.1, 0.4, 1.0)], "duplicate_rate double, source_coverage double, groundedness double")
    better = spark.createDataFrame([(0.2, 0.5, 1.0)], "duplicate_rate double, source_coverage double, groundedness double")
    assert evaluation.diversity_gate(better, worse).first().passed is False and evaluation.diversity_gate(better, better).first().reduction == 0.0


def test_errors_and_waits(spark):
    df = spark.createDataFrame([(403, "Unknown model", None), (403, "no", None), (None, None, "Connection reset"), (None, None, "quota exceeded"), (404, "", None), (None, None, None)], "status int, body string, message string")
    got = [r[0] for r in df.select(crawl.provider_error(F.col("status"), F.col("body"), F.col("message"))).collect()]
    assert got == ["invalid_request", "authentication_error", "retryable", "quota_exceeded", "permanent_error", "permanent_error"]
    waits = [r[0] for r in spark.createDataFrame([("5",), ("soon",), (None,)], "h string").select(crawl.retry_after(F.col("h"))).collect()]
    assert waits == [5.0, 60.0, 60.0]
    rest = [r[0] for r in spark.createDataFrame([("a", -1.0), ("a", None), ("b", None)], "c string, w double").select(crawl.cooldown(F.col("c"), F.col("w"), {"a": 10.0}, 60.0)).collect()]
    assert rest == [0.0, 10.0, 60.0]


def test_sources(spark, tmp_path):
    import io
    import tarfile

    def packed(names):
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as t:
            for name in names:
                info = tarfile.TarInfo(name)
                info.size = 2
                t.addfile(info, io.BytesIO(b"hi"))
        return spark.createDataFrame([(bytearray(buffer.getvalue()),)], "content binary")

    assert {r.relative_path: bytes(r.content) for r in files.unpacked(packed(["top/a.md", "top/d/b.md"])).collect()} == {"a.md": b"hi", "d/b.md": b"hi"}
    with pytest.raises(Exception, match="unsafe"):
        files.unpacked(packed(["top/../../etc/x"])).collect()
    mirror = tmp_path / "mirror"
    mirror.mkdir()
    (mirror / "HEAD").write_text("abc\n")
    (mirror / "a.md").write_text("x")
    assert files.checked_mirror(spark, str(mirror), "abc", ["**/*.md"]).count() == 1
    with pytest.raises(ValueError):
        files.checked_mirror(spark, str(mirror), "abd", ["**/*.md"])
    (tmp_path / "c.json").write_text('[{"name": "a", "url": "u"}, {"name": "b", "url": ""}]')
    assert files.configs(spark, str(tmp_path / "c.json"), "name string, url string", ["name"]).count() == 2
    with pytest.raises(ValueError):
        files.configs(spark, str(tmp_path / "c.json"), "name string, url string", ["name", "url"])
    m = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "relative_path string, sha256 string, size int")
    assert files.manifest_hash(m).first() == files.manifest_hash(m.repartition(2).orderBy(F.desc("size"))).first() != files.manifest_hash(m.unionByName(m)).first()


def test_scratch_folder_and_pointer(spark, tmp_path):
    path = str(tmp_path / "pointer")
    for text in ("one", "zwei é"):
        runtime.replace_file(spark, path, text)
        assert runtime.read_file(spark, path) == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["pointer"]
    report = store.profile_report(spark.createDataFrame([("a", 1), ("b", 2)], "stage string, n int"), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r/report.md").glob("part-*"))
    assert report.count() == 2 and sorted(text.splitlines()) == sorted(["| stage | n |", "|-|-|", "| a | 1 |", "| b | 2 |"])


def test_newest_rows(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, None, "d")], "k long, v int, t string")
    assert {(r.k, r.t) for r in store.newest(df, "k", "v").collect()} == {(1, "b"), (2, "d")}


def test_medoid_of_large_groups(spark):
    import random

    r = random.Random(4)
    rows = [(k % 2 if k < 60 else 7, k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 6)))) for k in range(70)]
    df = spark.createDataFrame(rows, "g long, turn long, text string")
    plain = {(x.g, x.turn, x.score) for x in metrics.medoid(df, "g", "turn", "text").collect()}
    assert plain == {(x.g, x.turn, x.score) for x in metrics.medoid(df, "g", "turn", "text", part_rows=9).collect()}
    bag = {t: set(x.split()) for _, t, x in rows}
    for g, turn, score in plain:
        sums = {t: round(sum(len(bag[t] & bag[o]) / len(bag[t] | bag[o]) for h, o, _ in rows if h == g and o != t and bag[t] and bag[o]), 6) for h, t, _ in rows if h == g}
        assert score == pytest.approx(max(sums.values())) and turn == min(t for t, v in sums.items() if v == pytest.approx(score))


def test_chunk_hits_cut_only_texts_with_a_hit_again(spark, sf_dir, monkeypatch):
    cut = []
    monkeypatch.setattr(chunking, "windows", lambda docs, key, windows=chunking.windows: cut.append(docs) or windows(docs, key))
    hits = catalog._chunk_hits(spark, sf_dir)[1].collect()
    assert {str(r.doc_id) for r in cut[-1].collect()} == {r.parent for r in hits} and cut[-1].count() < cut[0].count()
    assert all(int(r.parent) * 100_000 + r.segment == r.chunk_id for r in hits)


def test_mirror_and_configurations_grow_with_the_tables(spark, sf_dir):
    """Made of documents and pages, all of them; tasks write the files."""
    q = registry.queries()
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    assert q["mirror_manifest"](spark, sf_dir).count() == docs.select(F.expr("doc_id div 100")).distinct().count()
    assert q["source_configs"](spark, sf_dir).count() == pages.count()


#: Queries on lexical search, and how many hits a question they take.
SEARCHES = {
    "hybrid_rrf": 40,
    "pool_minmax_gate": 10,
    "per_source_cap": 10,
    "lost_in_middle_order": 10,
    "near_dup_greedy": 10,
    "trigram_maxsim": 10,
    "context_selection": 10,
    "proxy_retrieval_metrics": 10,
    "domain_mismatch": 10,
    "verified_citations": 5,
}


@pytest.mark.parametrize("name", SEARCHES)
def test_queries_on_search_send_on_k_rows_a_question(spark, sf_dir, monkeypatch, name):
    """They deal texts out by a bound and search once, and k rows a question leave a task."""
    n_docs, asked = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "benchmark"))
    parts, sent = [], []
    monkeypatch.setattr(search, "COUNTED", 30)
    monkeypatch.setattr(search, "PAIRS", 10_000)
    monkeypatch.setattr(search, "dealt", lambda df, key, n: parts.append(n) or df.repartition(n, key))
    monkeypatch.setattr(search, "top_k", lambda df, k, q, *a, top_k=search.top_k: sent.append((df, k, q)) or top_k(df, k, q, *a))
    registry.queries()[name](spark, sf_dir).collect()
    found = [(df, k) for df, k, q in sent if q == "item_id"]
    assert parts == [-(-n_docs // 30), -(-n_docs * asked // 10_000)]
    assert len(found) == 1 and found[0][1] == SEARCHES[name]
    assert found[0][0].count() <= SEARCHES[name] * asked * parts[1]
