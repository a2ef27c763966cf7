"""Spelling variants: words one edit apart, by merging an errata trie along heavy paths.

The sorted vocabulary is dealt out by ranges, so a task holds a contiguous piece of the trie. At each node the child with
the most words is heavy, the others are light. Two words that differ in one character part at the node of their longest
common prefix, so all pairs are found by merging, at each node, its light subtrees with the node's character

* replaced: by any other (light words that then coincide), or by the heavy child's (a light word that becomes a heavy one),
* skipped: a light word that becomes a word below the node, or
* preceded by the heavy child's: a light word that becomes a heavy one which skips its own.

Light subtrees go into heavy ones, the small into the large, so a word is moved once for each light edge above it: at most
log2 of the vocabulary's size. Terminals that coincide are one-edit pairs, each found once.

Below a node that lies in one task everything merges there. The nodes on the borders of the ranges (prefixes of a few
characters) are shared: their children's counts are summed in Spark, and what is merged there coincides in a join.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.runtime import drop_path, prepare, stage, stage_at

#: A word is a maximal run of these with so many code points at least; A-Z are lower-cased.
LETTERS, LEAST, OCCURRENCES = r"A-Za-zÀ-ÿ", 7, 2
#: A near word of so many times a word's occurrences is its form.
TIMES = 10
#: Words of a task.
PER_PART = 100_000
#: Stands for any character; no letter.
ANY = "*"
_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))


def words(docs: DataFrame, spoil: int | None = None, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: the distinct words of all whole texts that occur often enough.

    spoil: let every word of a document whose crc32 of "doc_id:word" it divides lose one character, that at crc32 % length.
    Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))
    found = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", _UPPER, _UPPER.lower()).alias("word"))
    if spoil:
        found = found.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        found = found.select(F.when(F.col("h") % spoil == 0, short).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _children(own: list[str], lo: int, hi: int, depth: int) -> list[tuple[int, int, str]]:
    """Ranges of the words lo to hi, which share depth characters, by their next one; the word that ends there has ""."""
    out = []
    while lo < hi:
        c = own[lo][depth : depth + 1]
        to = bisect_left(own, own[lo][:depth] + chr(ord(c) + 1), lo, hi) if c else lo + 1
        out.append((lo, to, c))
        lo = to
    return out


def _names(path: str, limit: int) -> list[bytes]:
    """Names of the nodes at depths 0 to limit above path."""
    h, out = hashlib.blake2b(digest_size=16), []
    for depth in range(limit + 1):
        out.append(h.digest())
        h.update(path[depth : depth + 1].encode())
    return out


def _border_counts(own: list[str], left: int, right: int):
    """(node, child, words) of the nodes that this part shares with the one before (depths to left) and after it (to right)."""
    both = min(shared(own[0], own[-1]), left)
    for path, limit, after in ((own[0], left, -1), (own[-1], right, both)):
        names, lo, hi, depth = _names(path, limit), 0, len(own), 0
        while depth <= limit:
            fork = shared(own[lo], own[hi - 1])
            for d in range(max(depth, after + 1), min(fork - 1, limit) + 1):
                yield names[d], path[d], hi - lo
            if fork > limit:
                break
            parts = _children(own, lo, hi, fork)
            if fork > after:
                for a, b, c in parts:
                    yield names[fork], c, b - a
            if fork >= len(path):
                break
            lo, hi = next((a, b) for a, b, c in parts if c == path[fork])
            depth = fork + 1


class _Merger:
    """The pairs of one part: near words and the best of each, and what its shared nodes send on."""

    def __init__(self, own: list[str], n: list[int], left: int, right: int, heavy: dict[bytes, str]):
        self.own, self.n, self.left, self.right = own, n, left, right
        self.heavy_left = [heavy.get(x) for x in _names(own[0], left)]
        self.heavy_right = [heavy.get(x) for x in _names(own[-1], right)]
        self.near, self.best_n, self.best = [0] * len(own), [0] * len(own), [-1] * len(own)
        self.index = {w: k for k, w in enumerate(own)}
        self.sent: list[tuple[int, str, bool]] = []

    def run(self):
        own, todo = self.own, [(0, len(self.own), 0)]
        while todo:
            lo, hi, depth = todo.pop()
            border = max(self.left if lo == 0 else -1, self.right if hi == len(own) else -1)
            fork = shared(own[lo], own[hi - 1])
            for d in range(depth, min(fork - 1, border) + 1):  # one child here, maybe others elsewhere
                self.send(lo, hi, d, own[lo][d], self.heavy_at(d, lo))
            if fork > border and hi - lo == 1:
                continue
            parts = _children(own, lo, hi, fork)
            if fork <= border:
                heavy = self.heavy_at(fork, lo)
                for a, b, c in parts:
                    self.send(a, b, fork, c, heavy)
            else:
                self.merge(parts, fork)
            todo += [(a, b, fork + 1) for a, b, c in parts if c]

    def heavy_at(self, depth: int, lo: int) -> str | None:
        return self.heavy_left[depth] if lo == 0 and depth <= self.left else self.heavy_right[depth]

    def send(self, lo: int, hi: int, depth: int, char: str, heavy: str | None):
        """What the light words lo to hi are with an error at depth, to be joined with all words and with each other."""
        if heavy is None or char == heavy:
            return
        for k in range(lo, hi):
            w = self.own[k]
            head, tail = w[:depth], w[depth + 1 :]
            if char:
                self.sent.append((k, head + ANY + tail, True))
                if heavy:
                    self.sent.append((k, head + heavy + tail, False))
                if tail[:1] != char:
                    self.sent.append((k, head + tail, False))
            if heavy:
                self.sent.append((k, head + heavy + w[depth:], False))

    def merge(self, parts: list[tuple[int, int, str]], depth: int):
        """Merge a node's light subtrees with each other and into the heavy one."""
        most = max(parts, key=lambda p: p[1] - p[0])
        heavy, find, merged = most[2], self.index.get, {}
        for lo, hi, char in parts:
            if char == heavy:
                continue
            for k in range(lo, hi):
                w = self.own[k]
                head, tail = w[:depth], w[depth + 1 :]
                if char:
                    merged.setdefault(tail, []).append(k)
                    if heavy:
                        self.link(k, find(head + heavy + tail))
                    if tail[:1] != char:
                        self.link(k, find(head + tail))
                if heavy:
                    self.link(k, find(head + heavy + w[depth:]))
        for same in merged.values():  # no more than there are letters
            for i, k in enumerate(same):
                for j in same[:i]:
                    self.link(k, j)

    def link(self, a: int, b: int | None):
        if b is not None:
            for x, y in ((a, b), (b, a)):
                self.near[x] += 1
                n = self.n[y]
                if n > self.best_n[x] or n == self.best_n[x] and y < self.best[x]:
                    self.best_n[x], self.best[x] = n, y


def _sorted(t: pa.Table) -> tuple[list[str], list[int]]:
    pairs = sorted(zip(t.column("word").to_pylist(), t.column("n").to_pylist(), strict=True))
    return [w for w, _ in pairs], [n for _, n in pairs]


_EDGES, _FOUND = "part int, node binary, child string, c long", "word string, n long, near long, best_n long, best string, key string, any boolean"
_EDGE_TYPES = pa.schema([("part", pa.int32()), ("node", pa.binary()), ("child", pa.string()), ("c", pa.int64())])
_FOUND_TYPES = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()), ("key", pa.string()), ("any", pa.bool_())])


def _edges(borders: dict[int, tuple[int, int]]):
    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        rows = list(_border_counts(_sorted(t)[0], *borders[part]))
        return pa.table([[part] * len(rows), *([r[k] for r in rows] for k in range(3))], schema=_EDGE_TYPES)

    return run


def _merged(borders: dict[int, tuple[int, int]]):
    def run(t: pa.Table, nodes: pa.Table) -> pa.Table:
        if not len(t):
            return _FOUND_TYPES.empty_table()
        own, n = _sorted(t)
        m = _Merger(own, n, *borders[t.column("part")[0].as_py()], dict(zip(nodes.column("node").to_pylist(), nodes.column("child").to_pylist(), strict=True)))
        m.run()
        rows = [own, n, m.near, m.best_n, [own[b] if b >= 0 else None for b in m.best], [None] * len(own), [None] * len(own)]
        at, none = [s[0] for s in m.sent], [None] * len(m.sent)
        sent = [[own[k] for k in at], [n[k] for k in at], none, none, none, [s[1] for s in m.sent], [s[2] for s in m.sent]]
        return pa.concat_tables([pa.table(x, schema=_FOUND_TYPES) for x in (rows, sent)])

    return run


def near(counted: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """word, n, n_near, best, best_n of each distinct word of counted (word, n): its near words, and that of the largest n (ties: smallest in code-point order)."""
    spark = prepare(counted.sparkSession)
    counted = stage(counted.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(counted.count() / per_part))
    placed = stage(counted.repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id()), "spelling-parts")
    ends = sorted(tuple(r) for r in placed.groupBy("part").agg(F.min("word"), F.max("word")).collect())  # two words a task
    between = [-1, *(shared(a[2], b[1]) for a, b in zip(ends, ends[1:], strict=False)), -1]
    borders = {e[0]: (between[k], between[k + 1]) for k, e in enumerate(ends)}
    edges = stage(placed.groupBy("part").applyInArrow(_edges(borders), _EDGES), "spelling-edges")
    sums = edges.groupBy("node", "child").agg(F.sum("c").alias("c"))
    heavy = sums.groupBy("node").agg(F.max(F.struct("c", "child"))["child"].alias("child"))
    nodes = edges.select("part", "node").distinct().join(heavy, "node")
    found = stage(placed.groupBy("part").cogroup(nodes.groupBy("part")).applyInArrow(_merged(borders), _FOUND), "spelling-found")
    own, sent = found.where("key is null"), found.where("key is not null").select("word", "n", "key", "any")
    pairs = sent.where("not any").join(counted.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key")
    sides = [pairs.select("word", F.lit(1).alias("near"), F.col("key_n").alias("best_n"), F.col("key").alias("best")), pairs.select(F.col("key").alias("word"), F.lit(1).alias("near"), F.col("n").alias("best_n"), F.col("word").alias("best"))]
    # light words that are one with a character replaced: no more than there are letters
    alike = sent.where("any").groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rest"), "word"))).alias("all")).where(F.size("all") > 1)
    alike = alike.select(F.explode("all").alias("own"), (F.size("all") - 1).alias("near"), F.get("all", F.lit(0)).alias("first"), F.get("all", F.lit(1)).alias("second"))
    other = F.when(F.col("own") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    sides.append(alike.select("own.word", "near", (-other["rest"]).alias("best_n"), other["word"].alias("best")))
    all_ = own.select("word", "n", "near", "best_n", "best")
    for s in sides:
        all_ = all_.unionByName(s, allowMissingColumns=True)
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("rest"), "best"))).alias("first")
    out = all_.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), first)
    return out.select("word", "n", "n_near", F.col("first.best").alias("best"), (-F.col("first.rest")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form (word, form), by pointer doubling; a form has TIMES the occurrences, so chains are short."""
    now, path = stage_at(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt, nxt_path = stage_at(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_path(now.sparkSession, path)
        now, path = nxt.drop("moved"), nxt_path
        if nxt.where("moved").isEmpty():
            return now


def variants(counted: DataFrame, times: int = TIMES, per_part: int = PER_PART) -> DataFrame:
    """word, form, root, n, n_near, form_n of each distinct word of counted (word, n).

    A word's near words differ from it by one inserted, deleted or replaced code point. Its form is the near word of the
    largest n, ties going to the smallest in code-point order, if that n is at least times its own, else null. Its root is
    what the forms lead to, itself without one. Words of any length; no words give no rows.
    """
    found = near(counted, per_part)
    form = F.col("best_n") >= F.col("n") * times
    out = stage(found.select("word", "n", "n_near", F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(out.where("form is not null").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
