"""TOP1/JN4 with an inverted-file index: vectors stored by cell, a few cells read for each question, all scores exact.

Cells are the nearest of spherical k-means centres, fitted on a bounded sample of all rows. A cell also has a radius, the
largest angle between its vectors and its centre, so that a question at angle a from the centre finds nothing above
cos(max(0, a - radius)) in it. An approximate search reads the nearest cells; an exact one goes on, with twice as many
cells each round, until no unread cell's bound reaches the k-th score.

Small cells share a shelf, which is a folder. Questions and vectors meet in tiles of bounded size, (shelf, block of its
vectors, block of its questions): neither a cell with a third of all vectors nor one that a third of all questions ask for
is a task of its own, and no question passes through the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.search import top_k, unit_rows
from skein.plans.runtime import new_path, prepare, stage

#: Rows that the centres are fitted on (the smallest hashes of all rows), cells at most, rounds of k-means.
SAMPLE, CELLS, ROUNDS = 65_536, 4096, 12
#: Rows of the sample whose likeness to all centres is held at once.
BLOCK = 1024
#: Vectors and questions of a tile.
VECTORS, QUESTIONS = 4096, 1024
#: Scores are rounded to six digits, so a bound within this of the k-th score may tie with it.
MARGIN = 2e-6


@dataclass
class Index:
    """Stored: vec_id, v (of norm 1), scope, cell, block by shelf. The last cell holds the vectors without a direction or of another length, which have cosine 0."""

    path: str
    centres: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    shelf: np.ndarray
    vec_kind: str

    def read(self, spark, shelves: list[int]) -> DataFrame:
        """The vectors of some shelves; the others' files are not listed."""
        kind = f"vec_id {self.vec_kind}, v array<double>, scope string, cell int, block int, shelf int"
        return spark.read.schema(kind).parquet(self.path).where(F.col("shelf").isin(shelves))

    def blocks(self) -> np.ndarray:
        """Blocks of each shelf."""
        return np.maximum(1, -(-np.bincount(self.shelf, self.counts).astype(np.int64) // VECTORS))


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means: centres of norm 1 of a sample of unit rows; a centre that loses all its rows moves to the row that fits worst. BLOCK rows meet all centres at once."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own, most = np.zeros(len(sample), np.int64), np.zeros(len(sample))
        for lo in range(0, len(sample), BLOCK):
            like = sample[lo : lo + BLOCK] @ centres.T
            own[lo : lo + BLOCK], most[lo : lo + BLOCK] = like.argmax(axis=1), like.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        worst = np.argsort(most)[: len(empty)]
        sums[empty] = sample[worst]
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _place(centres: np.ndarray):
    def run(batches):
        for b in batches:
            rows = unit_rows(b.column(1), None, centres.shape[1])
            good = (rows != 0).any(axis=1)
            like = rows @ centres.T
            cell = np.where(good, like.argmax(axis=1), len(centres)).astype(np.int32)
            angle = np.where(good, np.arccos(np.clip(like.max(axis=1), -1, 1)), 0.0)
            flat = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat, b.column(2), pa.array(cell), pa.array(angle)], ["vec_id", "v", "scope", "cell", "angle"])

    return run


def build(vectors: DataFrame, cells: int | None = None, scope: str | None = None, path: str | None = None, sample: int = SAMPLE) -> Index:
    """Index of every row of vectors (vec_id, embedding), by default in eight times the square root of their number of cells, in a folder of the session's or at path.

    The length of the vectors is the commonest one of the sample. Null, zero and non-finite vectors are stored as well.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding", (F.col(scope).cast("string") if scope else F.lit("")).alias("scope"))
    n = rows.count()
    first = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).where(F.size("embedding") > 0).orderBy("h").limit(sample).toArrow()
    lists = first.column("embedding").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.ones(1, int)
    length = int(np.bincount(sizes).argmax())
    units = unit_rows(lists, None, length) if len(lists) else np.zeros((0, length))
    units = units[(units != 0).any(axis=1)]
    cells = min(CELLS, cells or max(1, round(8 * math.sqrt(n))))
    centres = fit(units, cells) if len(units) else np.eye(1, length)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(centres)  # CELLS rows at most
    run = lambda batches: _place(shared.value)(batches)
    placed = stage(rows.select("vec_id", "embedding", "scope").mapInArrow(run, f"vec_id {kind}, v array<double>, scope string, cell int, angle double"), "ivf-placed")
    radius, counts = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle"), F.count("*")).collect():  # a row a cell
        radius[r[0]], counts[r[0]] = r[1], r[2]
    shelf = np.maximum(0, np.cumsum(counts) - 1) // VECTORS  # as many vectors a shelf as a block has, or one cell
    index = Index(path or new_path(spark, "ivf"), centres, radius, counts, np.unique(shelf, return_inverse=True)[1].astype(np.int32), kind)
    of_cell = spark.createDataFrame([(c, int(s), int(index.blocks()[s])) for c, s in enumerate(index.shelf)], "cell int, shelf int, blocks long")
    out = placed.join(F.broadcast(of_cell), "cell").select("vec_id", "v", "scope", "cell", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "shelf")
    out.repartition("shelf", "block").sortWithinPartitions("shelf", "cell").write.partitionBy("shelf").parquet(index.path)
    return index


def _bounds(index: Index, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells by nearness and, in that order, what their vectors' confidence can't pass; the cell of vectors without a direction is last."""
    like = np.clip(rows @ index.centres.T, -1, 1)
    most = np.cos(np.maximum(0, np.arccos(like) - index.radius[:-1]))
    order = np.argsort(-like, axis=1, kind="stable")
    bound = np.maximum(np.take_along_axis(most, order, axis=1), 0)
    odd = np.full((len(rows), 1), len(index.centres))
    return np.hstack((order, odd)), np.hstack((bound, np.zeros((len(rows), 1))))


_ASKED = "q_id {kind}, q array<double>, scope string, shelf int, cells array<int>, n long"


def _probe(index: Index, lo: int, hi: int):
    """Rows (q_id, q, scope, kth) to one for each shelf that holds some of the cells lo to hi by nearness whose bound reaches kth, with n vectors in these; shelf is null once for a question that has such cells beyond hi."""
    wanted = index.counts > 0

    def run(batches):
        for b in batches:
            rows = unit_rows(b.column(1), None, index.centres.shape[1])
            cells, bound = _bounds(index, rows)
            open_ = (bound >= b.column(3).to_numpy()[:, None] - MARGIN) & wanted[cells]
            q, at = np.nonzero(open_[:, lo:hi])
            cell = cells[q, at + lo]
            by = np.lexsort((cell, index.shelf[cell], q))
            q, cell, shelf = q[by], cell[by].astype(np.int32), index.shelf[cell[by]]
            starts = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (shelf[1:] != shelf[:-1])]) if len(q) else np.zeros(0, int)
            more = np.flatnonzero(open_[:, hi:].any(axis=1))
            take = pa.array(np.r_[q[starts], more])
            none = np.r_[np.zeros(len(starts), bool), np.ones(len(more), bool)]
            n = np.add.reduceat(index.counts[cell], starts) if len(starts) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, np.full(len(more) + 1, len(cell))].astype(np.int32)), pa.array(cell))
            flat = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))
            cols = [pa.array(np.r_[shelf[starts], np.zeros(len(more), np.int32)].astype(np.int32), mask=none), lists, pa.array(np.r_[n, np.zeros(len(more), np.int64)])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), flat.take(take), b.column(2).take(take), *cols], ["q_id", "q", "scope", "shelf", "cells", "n"])

    return run


def _tile(k: int, itself: bool, length: int):
    """A tile's vectors and questions, cell by cell, to the k best of the tile for each question."""

    def rows(t: pa.Table, c: str) -> np.ndarray:
        return t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length)

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        ids, q_ids = vectors.column("vec_id").to_numpy(), asked.column("q_id").to_numpy()
        if len(ids) and len(q_ids):
            v, q, own, within = rows(vectors, "v"), rows(asked, "q"), vectors.column("scope").to_numpy(), asked.column("scope").to_numpy()
            lists = asked.column("cells").combine_chunks()
            cell, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            by = np.lexsort((ids, vectors.column("cell").to_numpy()))
            placed = vectors.column("cell").to_numpy()[by]
            for c in np.unique(cell):
                at, some = by[slice(*np.searchsorted(placed, (c, c + 1)))], who[cell == c]
                if not len(at):
                    continue
                score = np.rint(np.clip(q[some] @ v[at].T, 0, 1) * 1e6) / 1e6
                score[within[some][:, None] != own[at][None, :]] = -1
                if not itself:
                    score[q_ids[some][:, None] == ids[at][None, :]] = -1
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # of equal scores the smaller id
                value = np.take_along_axis(score, best, axis=1).ravel()
                found.append((np.repeat(some, best.shape[1])[value >= 0], at[best.ravel()[value >= 0]], value[value >= 0]))
        who, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((ids[at], -score, who))
        first = np.flatnonzero(np.r_[True, np.diff(who[by]) != 0]) if len(by) else by
        by = by[np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)])) < k]
        return pa.table({"q_id": asked.column("q_id").take(pa.array(who[by])), "vec_id": vectors.column("vec_id").take(pa.array(at[by])), "confidence": pa.array(score[by])})

    return run


def _score(index: Index, asked: DataFrame, k: int, itself: bool) -> DataFrame:
    """The k best of each tile (q_id, vec_id, confidence) of _probe's rows."""
    spark, blocks = asked.sparkSession, index.blocks()
    per_shelf = {r["shelf"]: r["count"] for r in asked.groupBy("shelf").count().collect()}  # a row a shelf
    kind = asked.schema["q_id"].dataType.simpleString()
    sizes = spark.createDataFrame([(int(s), int(blocks[s]), -(-n // QUESTIONS)) for s, n in per_shelf.items()] or [(0, 1, 1)], "shelf int, vb int, qb int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    questions = asked.join(F.broadcast(sizes), "shelf").withColumn("part", F.pmod(F.xxhash64("q_id"), F.col("qb")).cast("int")).withColumn("block", upto("vb")).drop("vb", "qb", "n")
    vectors = index.read(spark, sorted(per_shelf)).join(F.broadcast(sizes), "shelf").withColumn("part", upto("qb")).drop("vb", "qb")
    key = ["shelf", "block", "part"]
    return vectors.groupBy(*key).cogroup(questions.groupBy(*key)).applyInArrow(_tile(k, itself, index.centres.shape[1]), f"q_id {kind}, vec_id {index.vec_kind}, confidence double")


def search(index: Index, questions: DataFrame, k: int, probes: int = 8, exact: bool = False, scope: str | None = None, itself: bool = False) -> DataFrame:
    """q_id, vec_id, confidence (the cosine, clamped to 0..1), rank, scored (vectors that the question met) of the k best.

    questions: q_id, q and, where the index has one, the scope column to be equal. exact: the result of a full scan. A
    question that is null, zero or of another length has cosine 0 with all. Ids are numbers.
    """
    spark = prepare(questions.sparkSession)
    of = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
    kind = questions.schema["q_id"].dataType.simpleString()
    open_ = stage(questions.select("q_id", "q", of.alias("scope"), F.lit(-1.0).alias("kth")), "ivf-asked")
    shared = spark.sparkContext.broadcast(index)  # CELLS centres
    lo, hi, found, met = 0, probes, None, None
    while True:
        run = lambda batches, lo=lo, hi=hi: _probe(shared.value, lo, hi)(batches)
        asked = stage(open_.mapInArrow(run, _ASKED.format(kind=kind)), "ivf-probes")
        now = _score(index, asked.where("shelf is not null"), k, itself)
        best = stage(top_k(now if found is None else now.unionByName(found.select("q_id", "vec_id", "confidence")), k, "q_id", "vec_id", "confidence"), "ivf-best")
        read = asked.groupBy("q_id").agg(F.sum("n").alias("scored"))
        met = stage(read if met is None else met.unionByName(read).groupBy("q_id").agg(F.sum("scored").alias("scored")), "ivf-met")
        found = best
        if not exact or hi > len(index.centres):
            break
        rest = asked.where("shelf is null").select("q_id")
        kth = found.groupBy("q_id").agg(F.when(F.count("*") == k, F.min("confidence")).alias("least"))
        open_ = stage(open_.join(rest, "q_id", "left_semi").join(kth, "q_id", "left").select("q_id", "q", "scope", F.coalesce("least", F.lit(-1.0)).alias("kth")), "ivf-asked")
        if open_.isEmpty():
            break
        lo, hi = hi, 2 * hi
    return found.join(met, "q_id", "left")
