"""Connected components by alternating large-star and small-star rounds over an edge table.

Every round is two keyed minima with map-side combine and two joins that adaptive
execution may split, so a node with very many edges is no single task. Each round
is written to the shared folder; the driver sees a row count and a checksum only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.runtime import drop_path, stage_at


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns. Returns node, root for every node with an edge; root: the smallest node reachable.

    Self-edges, repeated edges and nulls are ignored; no edges give no rows.
    """
    a, b = edges.columns
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    cur, path = stage_at(first, "edges")
    spark, mark = cur.sparkSession, _mark(cur)
    while mark[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        nxt, nxt_path = stage_at(small.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_path(spark, path)
        now = _mark(nxt)
        cur, path = nxt, nxt_path
        if now == mark:
            break
        mark = now
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
