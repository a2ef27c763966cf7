"""Semantic clustering and segmentation measures against their definitions."""

import itertools
import random

import numpy as np
import pytest

from skein.operators import chunking, segmentation
from skein.plans.runtime import table


def brute_clusters(vectors, threshold):
    """Every mean from the cluster's members anew."""
    rows = [np.asarray(v, float) / (np.linalg.norm(v) + 1e-10) for v in vectors]
    out = []
    for i, v in enumerate(rows):
        like = []
        for own in out:
            m = np.mean([rows[j] for j in own], axis=0)
            like.append(round(float(v @ (m / (np.linalg.norm(m) + 1e-10))), 9))
        if like and max(like) >= threshold - 1e-9:
            out[like.index(max(like))].append(i)
        else:
            out.append([i])
    return out


def test_clusters_of_real_sentences_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    split = chunking.with_vectors(chunking.sentences(docs, "doc_id")).collect()
    assert len(split) == docs.count()
    apart = many = 0
    for r in split:
        got = chunking.cluster_sentences([list(v) for v in r.vectors], 0.35)
        assert got == brute_clusters([list(v) for v in r.vectors], 0.35)
        apart += any(b - a > 1 for own in got for a, b in itertools.pairwise(own))
        many += len(got) > 1
    assert apart > 20 and many > 20  # clusters that are not contiguous


def test_sentences_give_their_offsets():
    text = ' First one.  Second `a. b` here! "Third?"\nlast without stop '
    spans = chunking.sentence_spans(text)
    assert [s for s, _, _ in spans] == ["First one.", "Second `a. b` here!", '"Third?"', "last without stop"]
    assert all(text[a:b] == s for s, a, b in spans)
    assert chunking.sentence_spans("") == [] == chunking.sentence_spans(" \n")


def test_packing_by_words_with_overlap():
    spans, at = [], 0
    for k in range(6):
        s = " ".join(f"w{k}_{i}" for i in range(10))
        spans.append((s, at, at + len(s)))
        at += len(s) + 1
    pack = lambda clusters, **kw: [(t.split(), a, b, n) for t, a, b, n in chunking.pack_clusters(spans, clusters, **{"target_words": 25, "overlap_words": 3, "least_words": 5} | kw)]
    got = pack([[0, 2], [1], [3], [4, 5]])
    words = [s.split() for s, _, _ in spans]
    assert [g[0] for g in got] == [words[0] + words[2], words[2][-3:] + words[1] + words[3], words[3][-3:] + words[4] + words[5]]
    assert [(g[1], g[2]) for g in got] == [(spans[0][1], spans[2][2]), (spans[2][1], spans[3][2]), (spans[3][1], spans[5][2])]
    assert [g[3] for g in got] == [1, 2, 1]
    assert [len(g[0]) for g in pack([[0, 1, 2, 3], [4], [5]])] == [40, 20]  # too long a cluster is closed by itself, without overlap
    assert pack([[0]], least_words=11) == []
    assert chunking.pack_clusters([("... !", 0, 5)], [[0]], least_words=0) == []
    assert chunking.pack_clusters([], []) == []


def test_semantic_clusters_by_row(spark):
    text = "alpha beta gamma. delta epsilon. alpha beta gamma zeta. delta epsilon eta. alone"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    split = chunking.with_vectors(chunking.sentences(docs, "doc_id"))
    got = chunking.semantic_clusters(split, "doc_id", target_words=8, overlap_words=0, least_words=1).collect()
    assert [(r.doc_id, r.chunk_index, r.total_chunks, r.text) for r in got] == [(1, 0, 2, "alpha beta gamma. alpha beta gamma zeta."), (1, 1, 2, "delta epsilon. delta epsilon eta. alone")]


def brute_windows(gold, predicted, n, k):
    held = lambda cuts, i: len({c for c in cuts if i < c <= i + k and 0 < c < n})
    both = [(held(gold, i), held(predicted, i)) for i in range(n - k)]
    return (sum((a == 0) != (b == 0) for a, b in both) / len(both), sum(a != b for a, b in both) / len(both)) if both else (0.0, 0.0)


def test_window_scores_match_their_definition(spark):
    r = random.Random(4)
    rows = {k: ([r.randint(-1, n + 1) for _ in range(r.randint(0, 6))], [r.randint(-1, n + 1) for _ in range(r.randint(0, 6))], n) for k, n in enumerate([0, 1, 2, 3, 10, 30, 31, 50, 100, 5, 7, 40])}
    rows[100] = ([10, 10, 20], [10, 20], 30)
    cuts = lambda side: spark.createDataFrame([(k, c) for k, v in rows.items() for c in v[side]], "d long, at long")
    got = segmentation.window_scores(cuts(0), cuts(1), spark.createDataFrame([(k, v[2]) for k, v in rows.items()], "d long, n long"), "d").collect()
    by = {g.d: g for g in got}
    assert set(by) == set(rows)
    for k, (gold, predicted, n) in rows.items():
        size = max(2, round(n / (len({c for c in gold if 0 < c < n}) + 1) / 2))
        pk, wd = brute_windows(gold, predicted, n, size)
        assert by[k].k == size and by[k].pk == pytest.approx(pk, abs=1e-6) and by[k].windowdiff == pytest.approx(wd, abs=1e-6)
    assert (by[100].pk, by[100].windowdiff) == (0, 0)


@pytest.mark.parametrize("near", [2, 3, 4])
def test_boundary_edits_leave_the_fewest_alone(near):
    def most(gold, predicted):
        """Near misses of the best matching, by trying all."""
        if not gold:
            return 0
        g, rest = gold[0], gold[1:]
        return max([most(rest, predicted), *(1 + most(rest, predicted[:i] + predicted[i + 1 :]) for i, p in enumerate(predicted) if abs(p - g) < near)])

    r = random.Random(near)
    for _ in range(300):
        gold, predicted = (sorted(r.sample(range(1, 16), r.randint(0, 6))) for _ in range(2))
        same, missed, alone = segmentation.boundary_edits(gold, predicted, near)
        g, p = sorted(set(gold) - set(predicted)), sorted(set(predicted) - set(gold))
        assert same == len(set(gold) & set(predicted)) and all(0 < d < near for d in missed)
        assert len(missed) == most(g, p) and alone == len(g) + len(p) - 2 * len(missed)


def test_boundary_similarity_by_row(spark):
    gold = spark.createDataFrame([(1, 5), (1, 10), (2, 5), (4, 3)], "k long, at long")
    other = spark.createDataFrame([(1, 5), (1, 11), (2, 9), (3, 0), (4, 3)], "k long, at long")
    got = segmentation.boundary_similarity(gold, other, spark.createDataFrame([(k, 20) for k in (1, 2, 3, 4)], "k long, n long"), "k").collect()
    assert {r.k: r.similarity for r in got} == {1: 0.75, 2: 0.0, 3: 1.0, 4: 1.0}


def test_token_spans_and_scores(spark):
    docs = spark.createDataFrame([(1, "one two  three four"), (2, None), (3, "")], "k long, text string")
    spans = spark.createDataFrame([(1, 0, 0, 7), (1, 1, 7, 19), (1, 2, 5, 9), (2, 0, 0, 3), (3, 0, 0, 0)], "k long, span_no int, start int, end int")
    got = {(r.k, r.span_no): (r.start, r.end) for r in segmentation.token_spans(docs, spans, "k").collect()}
    assert got == {(1, 0): (0, 2), (1, 1): (2, 4), (1, 2): (2, 3), (3, 0): (0, 0)}
    gold = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 12), (1, 2, 90, 99), (1, 3, 5, 5)], "k long, span_no int, start int, end int")
    chunks = spark.createDataFrame([(1, 0, 0, 8), (1, 1, 2, 20), (1, 2, 4, 12)], "k long, chunk_no int, start int, end int")
    scores = {r.span_no: (r.iou, r.precision) for r in segmentation.span_scores(gold, chunks, "k", 4).collect()}
    assert scores == {0: (0.8, 1.0), 1: (0.25, round(2 / 18, 6)), 2: (0.0, 0.0), 3: (0.0, 0.0)}
