"""Late interaction against scoring everything."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from skein.operators import late


def brute(question, text):
    q, t = late.trigram_vectors(late.tokens(question)[: late.QUESTION_TOKENS]), late.trigram_vectors(late.tokens(text))
    return round(float((q.astype(float) @ t.astype(float).T).max(axis=1).sum()), 6) if len(q) and len(t) else 0.0


def test_vectors_are_of_norm_one_and_alike_for_like_words():
    a, b, c = late.trigram_vectors(["spelling", "spellings", "quartz"])
    assert np.allclose([np.linalg.norm(x) for x in (a, b, c)], 1) and a @ b > 0.7 > 0.6 > a @ c


def test_search_matches_brute_force(spark, sf_dir, monkeypatch):
    """All documents for every passage, with texts null, empty and repeated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "?!"), (10_003, "same words here"), (10_004, "same words here")], docs.schema)
    docs = docs.unionByName(odd).repartition(3)
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("q_id"), "text")
    asked = asked.unionByName(spark.createDataFrame([(20_000, None), (20_001, "same words"), (20_002, "zz")], asked.schema))
    monkeypatch.setattr(late, "QUESTIONS", 20)
    got = late.late_search(docs, asked, 5).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for q in asked.collect():
        own = sorted((r.rank, r.doc_id, r.score) for r in got if r.q_id == q.q_id)
        scores = {d: brute(q.text, t) for d, t in texts.items()}
        want = sorted(scores.values(), reverse=True)[:5]
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        assert np.allclose([r[2] for r in own], want, atol=3e-6)
        assert all(abs(scores[d] - s) < 3e-6 for _, d, s in own)


def themed_encoder():
    def themed(words):
        """Vectors near the direction of the first letter, as learned ones gather around meanings."""
        base = np.random.default_rng(0).normal(size=(128, 32))
        rows = np.array([base[ord(w[0]) % 128] + 0.05 * np.random.default_rng(zlib.crc32(w.encode())).normal(size=32) for w in words]).reshape(-1, 32)
        return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)

    return themed


def test_texts_far_below_the_best_are_not_scored(spark):
    r, themed = random.Random(1), themed_encoder()
    rows = [(k, " ".join(r.choice("abcdefghijklmnop"[k % 16 : k % 16 + 1] + "z") + str(r.randint(0, 999)) for _ in range(30))) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(k, f"{c}1 {c}2 {c}3") for k, c in enumerate("adk")], "q_id long, text string")
    got = late.late_search(docs, asked, 5, themed).collect()
    assert {r.scored for r in got} and max(r.scored for r in got) < 200
    for q in asked.collect():
        q_rows = themed(late.tokens(q.text)).astype(float)
        want = sorted((round(float((q_rows @ themed(late.tokens(t)).astype(float).T).max(axis=1).sum()), 6) for _, t in rows), reverse=True)[:5]
        assert np.allclose(sorted((r.score for r in got if r.q_id == q.q_id), reverse=True), want, atol=3e-6)


def test_bounds_hold(sf_dir, spark):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    batch = late._Batch([*texts, None, ""], late.trigram_vectors)
    for question in ("the of and", "reingwh ontionti", "zebra"):
        q = late.trigram_vectors(late.tokens(question))
        exact = late.maxsim(q, [batch.vectors[r] for r in batch.rows])
        assert (exact <= batch.bounds(q)).all()


def test_rerank_scales_within_the_pool(spark):
    rows = [(1, 1, 1, 0.9, "red apple", "a green pear"), (1, 2, 2, 0.8, "red apple", "the red apple"), (1, 3, 3, 0.7, "red apple", "apples"), (2, 1, 1, 0.4, "red apple", "pear"), (3, 5, 1, 0.4, None, None), (3, 6, 2, 0.3, None, "x")]
    df = spark.createDataFrame(rows, "q long, d long, rank int, confidence double, question string, text string")
    got = {(r.q, r.d): (r.position, r.confidence) for r in late.late_rerank(df, "q", "question", "text", 2).collect()}
    assert got[1, 2] == (1, 1.0) and got[1, 3][0] == 2 and (1, 1) not in got
    assert got[2, 1] == (1, 0.4)  # a pool of one row
    assert got[3, 5][0] == 1 and got[3, 6][0] == 2


def test_questions_share_their_tokens(monkeypatch):
    """A token of many questions meets a text once, and groups of questions or parts of a text change no score."""
    r = random.Random(4)
    words = [f"w{k}x{k % 7}" for k in range(40)]
    asked = [(q, [r.choice(words) for _ in range(r.randint(0, 9))]) for q in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(50)] + [None, ""]
    groups = late.grouped(asked, late.trigram_vectors)
    assert len(groups) == 1 and len(groups[0][1]) == len({w for _, own in asked for w in own}) < sum(len(own) for _, own in asked) / 5
    monkeypatch.setattr(late, "WORDS", 12)
    monkeypatch.setattr(late, "ROWS", 4)
    batch, ids = late._Batch(texts, late.trigram_vectors), np.arange(len(texts))
    parts = late.grouped(asked, late.trigram_vectors)
    assert len(parts) > 3 and [q for p in parts for q in p[0]] == [q for q, _ in asked]
    for qs, vectors, own in parts:
        found = [late._Found(5) for _ in qs]
        late._meet(batch, ids, vectors, own, found)
        for q, f in zip(qs, found, strict=True):
            scores = sorted((-brute(" ".join(asked[q][1]), t), i) for i, t in enumerate(texts))[:5]
            assert np.allclose([s for s, _ in f.best], [s for s, _ in scores], atol=3e-6)
