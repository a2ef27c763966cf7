"""Exact and incremental deduplication, sibling merges, near-duplicate pairs."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.search import small, unit_rows
from skein.plans.runtime import prepare, stage


def content_hash(c: Column | str) -> Column:
    """SHA-256 of the text without white space at its ends."""
    return F.sha2(T.strip(c), 256)


def exact_dedup(df: DataFrame, key: Column, order: str) -> DataFrame:
    """DDP1/WIN7: the first row of each key by order. The choice is a keyed minimum with map-side combine, so that a key with a third of all rows is no window."""
    rows = df.withColumn("_key", key)
    first = rows.groupBy(F.col("_key").alias("_same")).agg(F.min(order).alias("_first"))
    return rows.join(first, F.col("_key").eqNullSafe(F.col("_same")) & (F.col(order) == F.col("_first")), "left_semi").drop("_key")


def first_by_hash(df: DataFrame, hash_col: str, order: str) -> DataFrame:
    """DDP2: the first row of each non-empty hash; rows with an empty one all stay."""
    full = df.where(F.col(hash_col) != "")
    return exact_dedup(full, F.col(hash_col), order).unionByName(df.where(F.coalesce(F.col(hash_col), F.lit("")) == ""))


def duplicate_groups(df: DataFrame, key: Column) -> DataFrame:
    """AGG2/DDP8: keys that more than one row has, and how many."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def snapshot_status(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """DDP6: key, status of every key by the old and new hash: unchanged, changed, new or gone."""
    both = old.withColumnRenamed("hash", "old_hash").join(new.withColumnRenamed("hash", "new_hash"), key, "full")
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return both.select(key, status.alias("status"))


#: Of the parts that a set is cut into, so many more than pairs may differ in; and how many sets a side of a block of comparisons has.
SPARE, SIDE = 2, 512


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _size_classes(threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The first size of each class of sizes, and how many tokens a set of the class and one not smaller that reaches the threshold can differ in.

    A set's partners that aren't smaller are in its own class or the next.
    """
    first = [1]
    while first[-1] < 1 << 31:
        first.append(max(first[-1] + 1, int(np.ceil(first[-1] / threshold))))
    most = np.array(first[1:]) - 1
    return np.array(first), np.floor((1 - threshold) / (1 + threshold) * (most + np.floor(most / threshold + 1e-9)) + 1e-9).astype(np.int64)


def _hashed_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the token sets of lower-cased texts; of each token the text's place and 64 bits that stand for it."""
    sets = [set(_TOKEN(t or "")) for t in texts]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = pa.array([w for s in sets for w in s], pa.string()).dictionary_encode()
    return sizes, np.repeat(np.arange(len(sets)), sizes), pd.util.hash_array(flat.dictionary.to_numpy(zero_copy_only=False), categorize=False)[flat.indices.to_numpy()]


_TOKEN = re.compile("[a-z0-9_]+").findall


def _class_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_hashed_sets() of column _t, with an id of each row's set and block _b, and the block's hash."""
    sizes, row, h = _hashed_sets(batch["_t"].to_pylist())
    block = pd.util.hash_array(np.array(batch["_b"].to_pylist(), dtype=object), categorize=False)
    total = np.zeros(len(sizes), np.uint64)
    np.add.at(total, row, _mixed(h))
    return sizes, row, h, _mixed(total + _mixed(block + sizes.astype(np.uint64))), block


def _runs(batches, key: str, weight, most: int = 200_000):
    """Batches that are sorted by key as tables of whole keys, of about most rows by weight."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += weight(batch)
        if n < most:
            continue
        table = pa.Table.from_batches(held)
        keys = table[key].to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n = sum(map(weight, held)) if cut else 0  # a key that is not at its end is looked at again after as many rows more
    if held:
        yield pa.Table.from_batches(held)


def _part_hashes(batches, threshold: float):
    """sig, id, n of each part of each set, once for its own class of sizes (n is even, twice the size) and once for the one before (odd)."""
    first, differ = _size_classes(threshold)
    for batch in batches:
        sizes, row, h, ids, block = _class_ids(batch)
        once = np.zeros(len(ids), bool)
        once[np.unique(ids, return_index=True)[1]] = True
        at = np.searchsorted(first, sizes, side="right") - 1
        out = []
        for before in (0, 1):
            k = np.maximum(at - before, 0)
            use = once & (sizes > 0) & (at >= before) & (differ[k] > 0)  # sets that may differ in nothing are one class
            parts = np.where(use, differ[k] + 1 + SPARE, 0)
            start = np.concatenate([[0], np.cumsum(parts)])
            mine = use[row]
            r, x = row[mine], h[mine]
            sums = np.zeros(start[-1], np.uint64)
            np.add.at(sums, start[r] + (_mixed(x + np.uint64(77)) % parts[r].astype(np.uint64)).astype(np.int64), _mixed(x + np.uint64(123)))
            doc = np.repeat(np.arange(len(ids)), parts)
            place = _mixed(block[doc] + _mixed((k[doc] << 32).astype(np.uint64) + (np.arange(start[-1]) - start[doc]).astype(np.uint64)))
            out.append((_mixed(sums + place).view(np.int64), ids[doc].view(np.int64), sizes[doc] * 2 + before))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["sig", "id", "n"])


def _meetings(batches, threshold: float, most: int = 1_000_000):
    """a, bs: ids of sets with a part in common whose sizes allow the threshold, once for each such part; bs as 64-bit words."""

    def rows(found):
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        ends = (np.append(start, len(a)) * 8).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(a[start]), pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(b)])], ["a", "bs"])

    for table in _runs(batches, "sig", lambda b: b.num_rows):
        sig, ids, n = (table[c].to_numpy() for c in ("sig", "id", "n"))
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])])
        sig, ids, n = sig[new], ids[new], n[new]
        found, held, step, live = [], 0, 1, np.arange(len(sig))
        while len(live := live[live < len(sig) - step]) and len(live := live[sig[live] == sig[live + step]]):
            x, y = live, live + step
            lo, hi = np.minimum(n[x] >> 1, n[y] >> 1), np.maximum(n[x] >> 1, n[y] >> 1)
            ok = (lo >= hi * threshold - 1e-9) & ((n[x] & n[y] & 1) == 0)  # two odd ones meet in their own class
            x, y, step = ids[x[ok]], ids[y[ok]], step + 1
            found.append((np.minimum(x, y), np.maximum(x, y)))
            held += len(x)
            if held >= most:
                yield rows(found)
                found, held = [], 0
        if held:
            yield rows(found)


def _often(batches):
    """a, b of the pairs that meet in more than SPARE parts."""
    for table in _runs(batches, "a", lambda b: b["bs"].nbytes // 8, 1_000_000):
        a, b = np.repeat(table["a"].to_numpy(), pc.binary_length(table["bs"]).to_numpy() // 8), np.frombuffer(b"".join(table["bs"].to_pylist()), np.int64)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        start = start[np.diff(np.append(start, len(a))) > SPARE]
        for i in range(0, len(start), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[start[i : i + 100_000]]) for c in (a, b)], ["a", "b"])


def _sent_sets(batches):
    """tile, a, b (null), s: the set of a text, to each block that compares it."""
    for batch in batches:
        sizes, _, h, ids, _ = _class_ids(batch)
        start = np.concatenate([[0], np.cumsum(sizes)])
        for i, (id_, tiles) in enumerate(zip(batch["id"].to_pylist(), batch["tiles"].to_pylist(), strict=True)):
            if ids.view(np.int64)[i] != id_:  # another row of the same key
                continue
            s = h[start[i] : start[i + 1]].tobytes()
            for k in range(0, len(tiles), 100):
                some = tiles[k : k + 100]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([id_] * len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array([s] * len(some), pa.binary())], ["tile", "a", "b", "s"])


def _compared(batches, threshold: float):
    """a, b, jaccard at or over the threshold; a tile's sets come before its pairs."""
    now, sets = None, {}
    for batch in batches:
        out = []
        for tile, a, b, s in zip(*(batch[c].to_pylist() for c in ("tile", "a", "b", "s")), strict=True):
            if tile != now:
                now, sets = tile, {}
            if s is not None:
                sets[a] = frozenset(np.frombuffer(s, np.int64).tolist())
                continue
            x, y = sets[a], sets[b]
            both = len(x & y)
            j = both / (len(x) + len(y) - both)
            if j >= threshold:
                out.append((a, b, j))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "jaccard"])


def jaccard_pairs(docs: DataFrame, key: str, text: str, threshold: float, block: list[Column]) -> DataFrame:
    """DDP4's pairs within blocks: a, b, jaccard of token sets at or over the threshold.

    Rows of one block and equal sets are a class, and only classes are compared. Two sets that reach the threshold differ in
    at most d tokens, d by their class of sizes. So each set is cut into d + 1 + SPARE parts by its tokens' hashes: at least
    1 + SPARE parts of the two are the same, which other sets' hardly ever are. Pairs that meet in so many are compared whole,
    in blocks of SIDE sets a side: sets that share their least neighbour are together, so one is sent once a block, not once
    a pair. What a class's rows have in common with another's is written out in keys at the very end.

    Texts are read again where their sets are needed; no table of sets is kept. 64 bits stand for a token and for a class: with
    ten million of either, the chance that any two are the same is under one in 100,000.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_k"), *[b.alias(f"_b{k}") for k, b in enumerate(block)], F.lower(text).alias("_t"))
    if block:  # a null block equals none
        rows = rows.where(F.concat(*[F.col(f"_b{k}").cast("string") for k in range(len(block))]).isNotNull())
    rows = rows.select("_k", (F.to_json(F.struct(*[f"_b{k}" for k in range(len(block))])) if block else F.lit("")).alias("_b"), "_t")
    kind = rows.schema["_k"].dataType.simpleString()

    def ids(batches):
        for batch in batches:
            sizes, _, _, found, _ = _class_ids(batch)
            yield pa.RecordBatch.from_arrays([batch["_k"], pa.array(found.view(np.int64))], ["k", "id"]).filter(pa.array(sizes > 0))

    members = stage(rows.mapInArrow(ids, f"k {kind}, id long"), "jaccard-members")
    classes = stage(members.groupBy("id").agg(F.min("k").alias("c"), F.count("*").alias("n")), "jaccard-classes")
    parts = rows.select("_b", "_t").mapInArrow(lambda b: _part_hashes(b, threshold), "sig long, id long, n long")
    met = parts.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(lambda b: _meetings(b, threshold), "a long, bs binary")
    found = stage(met.repartition("a").sortWithinPartitions("a").mapInArrow(_often, "a long, b long"), "jaccard-found")

    near = found.select(F.explode(F.array("a", "b")).alias("id"), F.col("a").alias("home")).groupBy("id").agg(F.min("home").alias("home"))
    near = stage(near, "jaccard-homes")
    side = near.join(near.groupBy("home").agg(F.ceil(F.count("*") / SIDE).alias("sides")), "home")
    side = side.select("id", F.xxhash64("home", F.pmod(F.xxhash64("id"), "sides")).alias("side"))
    tiled = found.join(side.select(F.col("id").alias("a"), F.col("side").alias("x")), "a").join(side.select(F.col("id").alias("b"), F.col("side").alias("y")), "b")
    tiled = stage(tiled.select(F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("tile"), "a", "b"), "jaccard-tiles")
    wanted = tiled.select(F.explode(F.array("a", "b")).alias("id"), "tile").groupBy("id").agg(F.collect_set("tile").alias("tiles")).join(classes, "id")
    sent = rows.join(wanted.select("id", "tiles", F.col("c").alias("_k")), "_k").select("id", "tiles", "_b", "_t").mapInArrow(_sent_sets, "tile long, a long, b long, s binary")
    both = sent.unionByName(tiled.withColumn("s", F.lit(None).cast("binary"))).withColumn("late", F.col("b").isNotNull())
    exact = both.repartition("tile").sortWithinPartitions("tile", "late").select("tile", "a", "b", "s").mapInArrow(lambda b: _compared(b, threshold), "a long, b long, jaccard double")

    own = classes.where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    linked = stage(exact.unionByName(own), "jaccard-links")
    pairs = linked.join(members.select(F.col("k").alias("x"), F.col("id").alias("a")), "a").join(members.select(F.col("k").alias("y"), F.col("id").alias("b")), "b")
    return pairs.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def embedding_pairs(vectors: DataFrame, key: str, vec: str, threshold: float, block: str, rows: int = 2048) -> DataFrame:
    """DDP5's pairs of one block value: a, b, similarity (rounded to 6 places) at or over the threshold.

    A block is dealt over parts of about so many rows; each pair of parts is one product in a task, so a vector is sent
    once for each part of its block, not for each partner, and only pairs over the threshold leave.
    """
    prepare(vectors.sparkSession)
    kind = vectors.schema[key].dataType.simpleString()
    v = vectors.where(F.col(block).isNotNull()).select(F.col(block).alias("_b"), F.col(key).alias("_k"), F.col(vec).alias("_v"))
    parts = stage(v.groupBy("_b").agg(F.ceil(F.count("*") / rows).cast("int").alias("_n")), "pair-parts")
    dealt = v.join(parts, "_b").withColumn("_p", F.pmod(F.xxhash64("_k"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("_b", F.least("_p", "_o").alias("_x"), F.greatest("_p", "_o").alias("_y"), "_p", "_k", "_v")

    def run(table: pa.Table) -> pa.Table:
        x, y, part = (table[c].to_numpy() for c in ("_x", "_y", "_p"))
        keys = table["_k"].to_numpy()
        left, right = (np.flatnonzero(part == side[0]) for side in (x, y))
        sizes = pc.fill_null(pc.list_value_length(table["_v"]), 0).to_numpy()
        out = []
        for length in np.unique(sizes):
            i, j = left[sizes[left] == length], right[sizes[right] == length]
            if length and len(i) and len(j):
                m, n = (unit_rows(table["_v"].take(pa.array(k)).combine_chunks(), None, int(length)) for k in (i, j))
                s = np.rint(np.clip(m @ n.T, -1, 1) * 1e6) / 1e6
                a, b = np.nonzero(s >= threshold)
                one = keys[i[a]] < keys[j[b]]
                two = (keys[i[a]] > keys[j[b]]) & (x[0] != y[0])  # within a part the other order is there as well
                out += [(keys[i[a[one]]], keys[j[b[one]]], s[a[one], b[one]]), (keys[j[b[two]]], keys[i[a[two]]], s[a[two], b[two]])]
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [keys[:0], keys[:0], np.zeros(0)]
        return pa.table(dict(zip(("a", "b", "similarity"), map(pa.array, cols), strict=True)))

    return dealt.groupBy("_b", "_x", "_y").applyInArrow(run, f"a {kind}, b {kind}, similarity double")


def sibling_merge(hits: DataFrame, q: str) -> DataFrame:
    """DDP9: rows of one parent become one, texts by segment with a blank line between, under the most confident row's id.

    Merged groups come first in the order of their best rank, then rows without a parent in theirs.
    """
    withp = hits.where("parent <> ''")
    best = F.max_by("chunk_id", F.struct("confidence", -F.col("rank")))
    merged = withp.groupBy(q, "parent").agg(
        best.alias("chunk_id"), F.max("confidence").alias("confidence"), F.min("rank").alias("first_rank"), F.count("*").alias("n_merged"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "text"))), lambda s: s["text"]), "\n\n").alias("text"),
    )
    alone = hits.where("parent = ''").select(q, "parent", "chunk_id", "confidence", F.col("rank").alias("first_rank"), F.lit(1).cast("long").alias("n_merged"), "text")
    both = merged.withColumn("kind", F.lit(0)).unionByName(alone.withColumn("kind", F.lit(1)))
    return both.withColumn("position", F.row_number().over(W.partitionBy(q).orderBy("kind", "first_rank")).cast("long")).drop("kind", "first_rank")


def sibling_rejoin(hits: DataFrame, chunks: DataFrame, q: str, parents: int = 3, cap: int = 4000) -> DataFrame:
    """DDP10: the best parents of each question by confidence, with the text of all their chunks in order, cut at cap characters."""
    best = hits.where("parent <> ''").groupBy(q, "parent").agg(F.max("confidence").alias("confidence"))
    best = best.withColumn("place", F.row_number().over(W.partitionBy(q).orderBy(F.col("confidence").desc(), "parent"))).where(F.col("place") <= parents)
    best = best.withColumn("place", F.col("place").cast("long"))
    own = chunks.join(small(best.select("parent").distinct()), "parent", "left_semi").groupBy("parent")
    text = own.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "text"))), lambda s: s["text"]), "\n").alias("text"), F.count("*").alias("n_siblings"))
    return best.join(text, "parent").withColumn("text", F.substring("text", 1, cap))


def merge_rendered(native: DataFrame, rendered: DataFrame) -> DataFrame:
    """DDP11: a rendered page replaces the native one of its canonical_url; native order first, then rendered pages by url."""
    r = rendered.select("canonical_url", F.col("text").alias("r_text"))
    both = native.join(r, "canonical_url", "full")
    return both.select("canonical_url", F.coalesce("r_text", "text").alias("text"), "ord", F.when(F.col("r_text").isNotNull(), "rendered").otherwise("native").alias("representation")).orderBy(F.col("ord").asc_nulls_last(), "canonical_url")


def union_first(variants: list[DataFrame], key: str, order: str) -> DataFrame:
    """DDP7/SET1: rows of several result lists, each key once: of the first variant that has it, there by order."""
    both = None
    for k, df in enumerate(variants):
        one = df.withColumn("_variant", F.lit(k))
        both = one if both is None else both.unionByName(one)
    rest = [c for c in variants[0].columns if c != key]
    out = both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_variant", order)).alias("_x"), F.min("_variant").alias("variant"))
    return out.select(key, *[F.col(f"_x.{c}").alias(c) for c in rest], "variant")


def union_packages(packages: list[DataFrame]) -> DataFrame:
    """SET2: the chunk packages of several sources as one table; columns that a package lacks are null."""
    out = packages[0]
    for p in packages[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def missing_from(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """SET3: distinct keys of expected that found lacks."""
    return expected.select(key).distinct().join(found.select(key), key, "left_anti")


def in_both(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """SET4: distinct keys that both have."""
    return expected.select(key).distinct().join(found.select(key), key, "left_semi")
