"""TOP10: late interaction. Texts are matrices of token vectors; a question scores the sum of its tokens' best likeness in a text.

A search is one scan: a task groups the token vectors of a batch of texts around centres and knows the widest angle in each
group, so it can bound a text's score from the groups that its tokens are in, without its vectors. The texts with the highest
bounds are scored exactly, then all whose bound reaches the k-th score of the task: the result is that of scoring all. A token
that several questions have meets each text once. Tasks send on k rows a question. Vectors are a function's of the tokens (a model's, or hashed character trigrams). Bounds
spare texts where vectors gather around meanings, as learned ones do; hashed trigrams hardly do, so they are all scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.operators import ivf, ranking, search
from skein.plans.runtime import prepare, stage

#: Tokens of a question that count; questions of one scan; centres; texts scored at once for one question.
QUESTION_TOKENS, QUESTIONS, CENTRES, BLOCK = 32, 2000, 64, 16
#: Different tokens of the questions that are asked together; tokens of a text that they meet at once; questions score their
#: texts one by one if fewer than one in so many pairs are wanted.
WORDS, ROWS, SPARSE = 1024, 256, 16
#: Rounding of scores, and what bounds are widened by against errors of the last digits.
DIGITS, SLACK = 6, 1e-5

Encoder = Callable[[list[str]], np.ndarray]


def tokens(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def trigram_vectors(words: list[str]) -> np.ndarray:
    """32 components and norm 1 a token: the sum of a sign pattern by each of its character trigrams' hashes, so that words alike in spelling are alike."""
    at: dict[str, int] = {}
    flat = [at.setdefault(p[i : i + 3], len(at)) for p in (f"<{w}>" for w in words) for i in range(len(p) - 2)]
    hashes = np.array([zlib.crc32(g.encode()) for g in at], np.uint32)
    signs = np.unpackbits(hashes.view(np.uint8).reshape(-1, 4), axis=1).astype(np.float32) * 2 - 1
    sums = np.add.reduceat(signs[flat], np.cumsum([0, *map(len, words)])[:-1], axis=0) if words else np.zeros((0, 32), np.float32)
    norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return sums / np.where(norm > 0, norm, 1)


def maxsim(question: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Scores of some texts' matrices: for each token of the question the highest product with a token of the text, summed; 0 for a text or question without tokens."""
    out = np.zeros(len(texts))
    full = [k for k, t in enumerate(texts) if len(t)]
    if full and len(question):
        like = question @ np.concatenate([texts[k] for k in full]).T
        starts = np.cumsum([0, *(len(texts[k]) for k in full)])[:-1]
        out[full] = np.maximum.reduceat(like, starts, axis=1).sum(axis=0, dtype=np.float64)
    return out


class _Batch:
    """The distinct tokens of some texts, in groups around centres."""

    def __init__(self, texts: list[str | None], encode: Encoder):
        self.own = [sorted(set(tokens(t))) for t in texts]
        words = sorted(set().union(*self.own))
        at = {w: k for k, w in enumerate(words)}
        self.vectors = encode(words)
        self.rows = [np.array([at[w] for w in own], np.int64) for own in self.own]
        self.groups: list[np.ndarray] = [np.zeros(0, np.int64) for _ in texts]
        if words:
            rng = np.random.default_rng(len(words))
            some = self.vectors[rng.choice(len(words), min(len(words), 4096), replace=False)].astype(float)
            self.centres = ivf.fit(some, CENTRES, rounds=3)
            like = self.vectors @ self.centres.T
            group = like.argmax(axis=1)
            self.radius = np.zeros(len(self.centres))
            np.maximum.at(self.radius, group, np.arccos(np.clip(like.max(axis=1), -1, 1)))
            self.groups = [np.unique(group[r]) for r in self.rows]

    def bound(self, words: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What no text's score passes, texts by questions: words are vectors of their tokens, times how often each question has them."""
        if not len(self.vectors) or not len(words):
            return np.zeros((len(self.rows), times.shape[1]))
        most = np.cos(np.maximum(0, np.arccos(np.clip(self.centres @ words.T, -1, 1)) - self.radius[:, None]))
        return np.array([most[g].max(axis=0) if len(g) else np.zeros(len(words)) for g in self.groups]) @ times + SLACK

    def bounds(self, question: np.ndarray) -> np.ndarray:
        """bound() of one question."""
        return self.bound(question, np.ones((len(question), 1)))[:, 0]

    def scores(self, words: np.ndarray, times: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Scores of some texts, texts by questions: a token of several questions meets each text once, ROWS of its tokens at a time."""
        out, turned = np.zeros((len(some), len(words)), np.float32), np.ascontiguousarray(words.T)
        for k, i in enumerate(some):
            own = self.vectors[self.rows[i]]
            parts = [(own[lo : lo + ROWS] @ turned).max(axis=0) for lo in range(0, len(own), ROWS)]
            if parts:
                out[k] = np.max(parts, axis=0) if len(parts) > 1 else parts[0]
        return out.astype(np.float64) @ times


def grouped(asked: list[tuple[int, list[str]]], encode: Encoder) -> list[tuple[list[int], np.ndarray, list[list[int]]]]:
    """Questions (id, tokens) in groups of at most WORDS different tokens: ids, these tokens' vectors, and each question's tokens by their place."""
    out: list[tuple[list[int], dict[str, int], list[list[int]]]] = []
    for q, words in asked:
        if not out or len(out[-1][1].keys() | words) > WORDS:
            out.append(([], {}, []))
        ids, at, own = out[-1]
        ids.append(q)
        own.append([at.setdefault(w, len(at)) for w in words])
    return [(ids, encode(list(at)), own) for ids, at, own in out]


class _Found:
    """The k best (-score, id) of a question so far, and how many texts were scored."""

    def __init__(self, k: int):
        self.k, self.best, self.scored = k, [], 0

    def least(self) -> float:
        """What a score or bound must reach."""
        return -self.best[-1][0] - 10.0**-DIGITS if len(self.best) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray):
        self.scored += len(score)
        at = np.flatnonzero(score >= self.least())
        self.best = sorted([*self.best, *zip((-score[at]).tolist(), ids[at].tolist(), strict=True)])[: self.k]


def _meet(batch: _Batch, ids: np.ndarray, words: np.ndarray, own: list[list[int]], found: list[_Found]) -> None:
    """Score a batch's texts for a group of questions: first the texts with the highest bounds of a question that has no k yet, then all whose bound reaches its k-th score."""
    times = np.zeros((len(words), len(own)))
    for j, tokens_ in enumerate(own):
        np.add.at(times[:, j], tokens_, 1)
    bound = batch.bound(words, times)
    open_ = np.ones(bound.shape, bool)

    def one(j: int, some: np.ndarray) -> None:
        found[j].add(maxsim(words[own[j]], [batch.vectors[batch.rows[i]] for i in some]).round(DIGITS), ids[some])
        open_[some, j] = False

    for j, f in enumerate(found):
        order, lo = np.argsort(-bound[:, j], kind="stable"), 0
        while len(f.best) < f.k and lo < len(order):
            one(j, order[lo : lo + BLOCK])
            lo += BLOCK
    open_ &= bound >= np.array([f.least() for f in found])
    texts, asked = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if open_.sum() < len(texts) * len(asked) / SPARSE:
        for j in asked:
            one(j, np.flatnonzero(open_[:, j]))
        return
    used = np.flatnonzero(times[:, asked].any(axis=1))
    score = batch.scores(words[used], times[np.ix_(used, asked)], texts).round(DIGITS)
    for c, j in enumerate(asked):
        some = open_[texts, j]
        found[j].add(score[some, c], ids[texts[some]])


def _scan(groups: list[tuple[list[int], np.ndarray, list[list[int]]]], k: int, encode: Encoder, kinds: tuple[pa.DataType, pa.DataType]):
    def run(batches):
        found = [[_Found(k) for _ in ids] for ids, _, _ in groups]
        for b in batches:
            batch, ids = _Batch(b.column(1).to_pylist(), encode), np.array(b.column(0).to_pylist())
            for (_, words, own), best in zip(groups, found, strict=True):
                _meet(batch, ids, words, own, best)
        rows = [(q, i, -s, f.scored if not at else 0) for (ids, _, _), best in zip(groups, found, strict=True) for q, f in zip(ids, best, strict=True) for at, (s, i) in enumerate(f.best)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((*kinds, pa.float64(), pa.int64()))], ["q_id", "doc_id", "score", "scored"])

    return run


def late_search(docs: DataFrame, questions: DataFrame, k: int, encode: Encoder = trigram_vectors) -> DataFrame:
    """q_id, doc_id, score, rank, scored (texts that were scored exactly) of the k best whole texts of each question.

    docs: doc_id, text; questions: q_id, text, of which the first QUESTION_TOKENS tokens count; ids are numbers. Null texts
    and texts without tokens have score 0. Ties go to the smaller doc_id. Questions are broadcast, QUESTIONS a scan.
    """
    spark = prepare(docs.sparkSession)
    kinds = [questions.schema["q_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()]
    id_type, n = to_arrow_type(docs.schema["doc_id"].dataType), questions.count()
    parts = max(1, -(-n // QUESTIONS))
    out = None
    for part in range(parts):
        rows = questions.where(F.pmod(F.xxhash64("q_id"), F.lit(parts)) == part).select("q_id", "text").toArrow()
        asked = [(q, tokens(t)[:QUESTION_TOKENS]) for q, t in zip(rows["q_id"].to_pylist(), rows["text"].to_pylist(), strict=True)]
        shared = spark.sparkContext.broadcast(grouped(asked, encode))
        run = lambda batches, shared=shared, types=(rows.schema.field("q_id").type, id_type): _scan(shared.value, k, encode, types)(batches)
        found = docs.select("doc_id", "text").mapInArrow(run, f"q_id {kinds[0]}, doc_id {kinds[1]}, score double, scored long")
        out = found if out is None else out.unionByName(found)
    out = stage(out, "late")
    met = out.groupBy("q_id").agg(F.sum("scored").alias("scored"))  # each task's number stands at its first row
    return search.top_k(out.drop("scored"), k, "q_id", "doc_id").join(met, "q_id")


def late_rerank(df: DataFrame, q: str, question: str, text: str, k: int, encode: Encoder = trigram_vectors) -> DataFrame:
    """TOP10: the k best rows of a question's pool by late interaction, with confidence (scaled from 0 to 1 within the pool) and position; a pool of one row stays as it is.

    df has rank and confidence, which a pool of one row keeps. Pairs are scored a batch at a time, each token once.
    """
    prepare(df.sparkSession)

    def run(batches):
        for b in batches:
            texts, asked = b.column(text).to_pylist(), b.column(question).to_pylist()
            words = sorted(set().union(*map(tokens, {*texts, *asked})))
            at, vectors = {w: i for i, w in enumerate(words)}, encode(words)
            rows = lambda own, vectors=vectors, at=at: vectors[[at[w] for w in own]]
            score = [maxsim(rows(tokens(a)[:QUESTION_TOKENS]), [rows(sorted(set(tokens(t))))])[0].round(DIGITS) for a, t in zip(asked, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, "late_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    scored = ranking.min_max(df.mapInArrow(run, f"{kinds}, late_score double"), q, "late_score").withColumn("_n", F.count("*").over(W.partitionBy(q)))
    out = scored.withColumn("confidence", F.when(F.col("_n") > 1, F.round("scaled", 6)).otherwise(F.col("confidence")))
    return out.withColumn("position", F.row_number().over(W.partitionBy(q).orderBy(F.desc("scaled"), "rank"))).where(F.col("position") <= k).drop("_n", "scaled")
