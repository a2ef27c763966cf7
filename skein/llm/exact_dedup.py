"""Exact dedup by a split of heavy hitters, in DataFrame functions only.

Rows are (digest, doc_id, a row number), written once, so that texts are read once. Misra-Gries counters of bounded number
(Spark's freqItems) find a superset of the digests that hold more than a share SUPPORT of all rows, each task its own and
merged; a second pass counts these exactly, keeps those of at least HEAVY rows and finds their winners. There are at most
1 / SUPPORT of them, so they are broadcast: copies of a frequent text get their winner where they are read and are never
shuffled. All other digests are grouped and joined by ordinary shuffles, in which none has more than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.ordering import fresh
from skein.plans.runtime import prepare, stage

#: Digests with more than this share of all rows are heavy: at most 1 / SUPPORT + 1 counters and broadcast rows of 60 bytes.
SUPPORT = 1 / 2048
#: A digest of fewer rows is left to the shuffle, whatever its share, as in small tables.
HEAVY = 8


def rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256, 32 bytes) and row (a number of its own) of every row; null texts count as empty."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return stage(docs.select("doc_id", digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "exact-rows")


def _winners(found: DataFrame) -> DataFrame:
    """digest, keep (doc_id and row of the largest doc_id; null is least), n of each digest."""
    return found.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n"))


def heavy_hitters(found: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Winners of the digests with more than a share support of all rows, exact, and maybe of others of HEAVY rows; at most 1 / support rows."""
    name = F.xxhash64("digest")  # counters compare numbers; Spark's don't compare byte arrays by value
    likely = stage(found.select(name.alias("name")).freqItems(["name"], support).select(F.explode("name_freqItems").alias("name")), "exact-likely")
    return stage(_winners(found.join(F.broadcast(likely), name == F.col("name"), "left_semi")).where(F.col("n") >= HEAVY), "exact-heavy")


def classes(found: DataFrame, support: float = SUPPORT) -> DataFrame:
    """found with keep and n of the row's digest."""
    heavy = F.broadcast(heavy_hitters(found, support))
    frequent = found.join(heavy, "digest")
    rest = found.join(heavy.select("digest"), "digest", "left_anti")
    # a table of its own, so that the join has partitions that Spark may split
    return frequent.unionByName(rest.join(stage(_winners(rest), "exact-winners"), "digest"))


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, by whole texts that are identical.

    The row with the largest doc_id stays. A null text counts as empty; a null doc_id is below all others and is keep_id
    only where all of its group are null. Of rows repeated in doc_id and text exactly one is kept. Very long texts are
    hashed whole. No rows give no rows. Further columns of docs are not read.
    """
    prepare(docs.sparkSession)
    out = classes(rows(docs), support)
    kept = F.col("row") == F.col("keep.row")
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_last(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """docs with one row of each text, that of the largest doc_id, all columns: null ids least, texts null or empty are one.

    Copies of heavy texts go where they are read; of the rest, the rows that stay are joined by digest and doc_id. Rows
    repeated in doc_id and text are one document, of which any row stays; which columns it has beside them is then open.
    """
    prepare(docs.sparkSession)
    digest, id_, named, winner = fresh(docs, "_digest", "_id", "_named", "_winner")
    heavy = heavy_hitters(rows(docs), support).select(F.col("digest").alias(named), F.col("keep.doc_id").alias(winner))
    whole = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))
    left = whole.join(F.broadcast(heavy), F.col(digest) == F.col(named), "left")
    left = left.where(F.col(named).isNull() | F.col("doc_id").eqNullSafe(F.col(winner))).drop(named, winner)
    slim = left.select(F.col(digest).alias(named), F.col("doc_id").alias(id_)).groupBy(named).agg(F.max(id_).alias(id_))
    kept = left.join(stage(slim, "exact-kept"), (F.col(digest) == F.col(named)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    return kept.dropDuplicates([digest, "doc_id"]).drop(digest)
