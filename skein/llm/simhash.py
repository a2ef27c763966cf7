"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r
flips of each. Every distinct fingerprint therefore emits its whole ball of radius
r = 2; fingerprints that share a variant are linked, and since both lie within r of
it they differ in at most 2r bits: a shared variant is itself the verification
(and is checked again on the pair).

The shuffle is by the leading bits of the variant, so that one row stands for all
variants of a fingerprint with the same leading bits (79 rows instead of 2081 at
12 leading bits); the receiving task unfolds the remaining flips in numpy, sorts
and links. Prefixes that more than CROWD rows share are dealt out by more bits before
the shuffle, and a task that still holds more than it unfolds at once goes on bit by
bit. No pairs of a group are emitted: links are reduced to a tree after each unfolding.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.graph import components
from skein.llm.ordering import fresh
from skein.plans.runtime import prepare, stage

SEED = 42
RADIUS = 4
SHINGLE = 4
#: Fingerprints a leading-bit pattern holds on average, from LEAST_BITS leading bits on, and rows of a task. The number of
#: rows a fingerprint is shuffled as grows with the square of the bits: 79 at 12 bits (8 million fingerprints), 326 at 25.
PER_PREFIX, LEAST_BITS, PER_TASK = 2048, 12, 1_000_000
#: Rows of one prefix from which it is dealt out by so many more bits.
CROWD, MORE_BITS = 250_000, 8
#: Variants unfolded at once in a task.
UNFOLD = 1_000_000
#: Shingles whose bits are counted at once.
WINDOW = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text (null and word-free texts: 0), unsigned."""
    if not text:
        return 0
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, WINDOW):
        h = np.array([digest(data[a:b], SEED) for a, b in zip(starts[k : k + WINDOW], stops[k : k + WINDOW], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, kept: tuple[str, ...]):
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fps, pa.int64())], [*kept, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of every row."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle, ("doc_id",)), "doc_id long, fp long")


@cache
def _ball(bits: int, r: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for k in range(r + 1) for c in combinations(range(bits), k)], np.uint64)


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n by the links a-b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        lo = np.minimum(ra, rb)
        was = root.copy()
        np.minimum.at(root, ra, lo)
        np.minimum.at(root, rb, lo)
        while not np.array_equal(nxt := root[root], root):
            root = nxt
        if np.array_equal(root, was):
            return root


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link a member, to the smallest of its component."""
    names, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = _union(len(names), codes[: len(a)], codes[len(a) :])
    hit = np.flatnonzero(root != np.arange(len(names)))
    return names[hit], names[root[hit]]


class _Linker:
    """Links of fingerprints that share a variant within r flips, as a tree that grows with the members."""

    def __init__(self, r: int):
        self.r = r
        self.trees: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def groups(self, keys: np.ndarray, fps: np.ndarray, bits: int):
        """keys: leading bits of variants, sorted; fps: whose variants. Groups of few variants are unfolded together."""
        flips = np.bitwise_count(keys ^ (fps >> np.uint64(64 - bits))).astype(np.int64)
        sizes = np.array([len(_ball(64 - bits, self.r - d)) for d in range(self.r + 1)])[flips]
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums, ends = np.add.reduceat(sizes, bounds), np.r_[bounds[1:], len(keys)]
        k = 0
        while k < len(bounds):
            j, total = k + 1, sums[k]
            while j < len(bounds) and total + sums[j] <= UNFOLD:
                total, j = total + sums[j], j + 1
            at = slice(bounds[k], ends[j - 1])
            self.unfold(keys[at], fps[at], flips[at], bits)
            k = j

    def unfold(self, keys: np.ndarray, fps: np.ndarray, flips: np.ndarray, bits: int):
        """keys: several, or too many variants of one; the latter go on by four more bits, a pattern at a time."""
        low = 64 - bits
        balls = [_ball(low, self.r - d) for d in range(self.r + 1)]
        total = sum(len(ball) * int((flips == d).sum()) for d, ball in enumerate(balls))
        if total > UNFOLD and low:
            step = min(4, low)
            own = fps >> np.uint64(low - step) & np.uint64((1 << step) - 1)
            for pattern in range(1 << step):
                d = flips + np.bitwise_count(own ^ np.uint64(pattern))
                at = np.flatnonzero(d <= self.r)
                if len(at) > 1:
                    self.unfold(keys[at] << np.uint64(step) | np.uint64(pattern), fps[at], d[at], bits + step)
            return
        rest = fps & np.uint64((1 << low) - 1)
        variants, owners = [], []
        for d, ball in enumerate(balls):
            at = np.flatnonzero(flips == d)
            head = keys[at] << np.uint64(low) if low < 64 else np.zeros(len(at), np.uint64)
            variants.append(((head | rest[at])[:, None] ^ ball[None, :]).ravel())
            owners.append(np.repeat(at, len(ball)))
        v, o = np.concatenate(variants), np.concatenate(owners)
        by = np.argsort(v)
        v, o = v[by], fps[o[by]]
        same = np.flatnonzero(v[1:] == v[:-1])
        a, b = o[same], o[same + 1]
        near = (np.bitwise_count(a ^ b) <= 2 * self.r) & (a != b)
        if near.any():
            self.trees.append(_star(a[near], b[near]))
            self.size += len(self.trees[-1][0])
            if self.size > UNFOLD:
                self.reduce()

    def reduce(self):
        if self.trees:
            self.trees = [_star(*(np.concatenate(x) for x in zip(*self.trees, strict=True)))]
            self.size = 0
        return self.trees


def _links_of(r: int):
    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        bits, keys, fps = (np.concatenate([b.column(c).to_numpy() for b in tables]) for c in range(3))
        keys, fps, linker = keys.view(np.uint64), fps.view(np.uint64), _Linker(r)
        for n in np.unique(bits):
            at = np.flatnonzero(bits == n)
            at = at[np.argsort(keys[at], kind="stable")]
            linker.groups(keys[at], fps[at], int(n))
        for a, b in linker.reduce():
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (a, b)], ["a", "b"])

    return run


def _dealt(rows: DataFrame, used: int, more: int, r: int) -> DataFrame:
    """rows (bits, k, fp) once for each pattern of the next bits that r flips in all allow."""
    prefix, following = F.shiftrightunsigned("fp", 64 - used), F.shiftrightunsigned("fp", 64 - used - more).bitwiseAND(F.lit((1 << more) - 1))
    left = F.lit(r) - F.bit_count(prefix.bitwiseXOR(F.col("k"))) if used else F.lit(r)
    masks = F.array(*[F.lit(int(m)) for m in _ball(more, r)])
    rows = rows.select("k", "fp", following.alias("own"), F.explode(F.filter(masks, lambda m: F.bit_count(m) <= left)).alias("m"))
    return rows.select(F.lit(used + more).alias("bits"), F.shiftleft("k", more).bitwiseOR(F.col("own").bitwiseXOR(F.col("m"))).alias("k"), "fp")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct: one long column of distinct fingerprints. Returns a, b: links that join exactly those within radius bits."""
    if radius % 2:
        raise ValueError("an even radius is expected")
    spark, r = distinct.sparkSession, radius // 2
    col = distinct.columns[0]
    n = distinct.count()
    bits = min(32, max(LEAST_BITS, math.ceil(math.log2(max(2, n / PER_PREFIX)))))
    rows = _dealt(distinct.select(F.lit(0).cast("long").alias("k"), F.col(col).alias("fp")), 0, bits, r)
    masks = F.array(*[F.lit(int(m)) for m in _ball(bits, r)])
    own = distinct.groupBy(F.shiftrightunsigned(col, 64 - bits).alias("k")).agg(F.count("*").alias("c"))
    sums = own.select("c", "k", F.explode(masks).alias("m")).groupBy(F.col("k").bitwiseXOR(F.col("m")).alias("full")).agg(F.sum("c").alias("c"))
    crowd = stage(sums.where(F.col("c") > CROWD).select("full"), "simhash-crowd")
    if not crowd.isEmpty():
        marked = rows.join(crowd, F.col("k") == F.col("full"), "left")
        rows = marked.where("full is null").select("bits", "k", "fp").unionByName(_dealt(marked.where("full is not null").select("k", "fp"), bits, MORE_BITS, r))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * len(_ball(bits, r)) / PER_TASK))
    return rows.repartition(tasks, "bits", "k").mapInArrow(_links_of(r), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included.

    Nulls: a null or word-free text has fingerprint zero and is linked like any other;
    a null doc_id keeps its row and is no candidate for component_id, unless all of its component are null.
    Repeated rows each keep a row. No rows give no rows. Further columns of docs are not read.
    """
    fps = stage(fingerprints(docs, shingle), "simhash-fp")
    least = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    comp = components(links(least.select("fp"), radius))
    linked = least.join(comp.withColumnRenamed("node", "fp"), "fp")
    smallest = stage(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-smallest")
    label = linked.join(smallest, "root").select("fp", "component_id")
    label = least.join(label, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    label = stage(label, "simhash-label")
    return fps.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs with exactly one row of each near-duplicate group, all columns: its smallest doc_id, null last.

    Ties go by a hash of the text, then of the other columns, so the same rows survive whatever their order; rows that
    share a doc_id, or have none, are told apart by these hashes.
    """
    prepare(docs.sparkSession)
    own = fresh(docs, "_keep_id", "_keep_th", "_keep_rh")
    kept_as = fresh(docs, "_kept_id", "_kept_th", "_kept_rh")
    # maps can't be hashed
    rest = [c for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t]
    flat = [x for c in rest for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    keys = docs.withColumns(dict(zip(own, (F.col("doc_id").cast("long"), F.xxhash64("text"), F.xxhash64(F.lit(0), F.col("doc_id"), *flat)), strict=True)))
    rows = keys.select(*own, "text").mapInArrow(_fingerprints(shingle, tuple(own)), ", ".join(f"{c} long" for c in own) + ", fp long")
    first = F.min(F.struct(F.col(own[0]).isNull().alias("none"), *own)).alias("first")
    least = stage(rows.groupBy("fp").agg(first), "simhash-least")
    comp = components(links(least.select("fp"), radius))
    groups = least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
    kept = groups.agg(F.min("first").alias("first")).select(*[F.col(f"first.{c}").alias(k) for c, k in zip(own, kept_as, strict=True)])
    kept = stage(kept, "simhash-kept")
    same = [keys[c].eqNullSafe(kept[k]) for c, k in zip(own, kept_as, strict=True)]
    return keys.join(kept, same[0] & same[1] & same[2], "left_semi").dropDuplicates(own).drop(*own)
