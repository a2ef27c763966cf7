"""Exact percentiles of groups of any size: selection by counts of ranges, so that no task or buffer holds a group's values.

A percentile is one or two ranks of its group. A rank is known to lie in a range of values; while a range holds more than
LIMIT rows, a bounded sketch of it (approximate quantiles, merged from tasks) proposes cuts, a second pass counts the rows
between the cuts and at each of them, and the rank moves into one of these parts, a small share of the range, or is found if
all values there are equal. What is left are windows of at most LIMIT rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.search import small
from skein.plans.runtime import stage

#: Rows of a range that a window may sort, and cuts of a larger one.
LIMIT, CUTS = 100_000, 64


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))


def _inside(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """ranges' columns and v of the rows in them; ranges are few, one or two for each rank."""
    few = small(ranges)
    met = rows.join(few, _same(rows, few, keys) & (rows["v"] >= few["lo"]) & (rows["v"] <= few["hi"]))
    return met.select(*[few[c] for c in ranges.columns], rows["v"])


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """keys and a column for each of wanted (name: share from 0 to 1): linearly interpolated percentiles of value, nulls left out.

    Keys may be null. Groups without a value have no row. NaN is above all numbers.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    sizes = stage(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-sizes")
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*[f(place(q)).cast("long") for q in wanted.values() for f in (F.floor, F.ceil)]))
    open_ = stage(sizes.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("c")), "quantile-ranks")
    span = [*keys, "lo", "hi"]
    found = []
    while True:
        large = open_.where((F.col("lo") < F.col("hi")) & (F.col("c") > limit))
        found.append(open_.where((F.col("lo") >= F.col("hi")) | (F.col("c") <= limit)))
        if large.isEmpty():
            break
        ranges = large.select(*span).distinct()
        cuts = [k / CUTS for k in range(1, CUTS)]
        grid = stage(_inside(rows, ranges, keys).groupBy(*span).agg(F.percentile_approx("v", cuts, 10 * CUTS).alias("cuts")), "quantile-cuts")
        part = 2 * F.size(F.filter("cuts", lambda x: x < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        counts = _inside(rows, grid, keys).groupBy(*span, part.alias("part")).agg(F.count("*").alias("pc"), F.min("v").alias("pl"), F.max("v").alias("ph"))
        start = F.coalesce(F.sum("pc").over(W.partitionBy(*span).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = stage(counts.withColumn("start", start), "quantile-counts")
        at = large["rank"] - large["before"]
        met = large.join(counts, _same(large, counts, span) & (at >= counts["start"]) & (at < counts["start"] + counts["pc"]))
        open_ = stage(met.select(*[large[k] for k in keys], large["rank"], counts["pl"].alias("lo"), counts["ph"].alias("hi"), (large["before"] + counts["start"]).alias("before"), counts["pc"].alias("c")), "quantile-ranks")
    settled = reduce(DataFrame.unionByName, found)
    equal = settled.where("lo >= hi").select(*keys, "rank", F.col("lo").alias("v"))
    rest = settled.where("lo < hi")
    ordered = _inside(rows, rest.select(*span, "before").distinct(), keys)
    ordered = ordered.withColumn("rank", F.row_number().over(W.partitionBy(*span, "before").orderBy("v")) - 1 + F.col("before"))
    picked = ordered.join(small(rest.select(*keys, "rank")), [ordered[k].eqNullSafe(rest[k]) for k in keys] + [ordered["rank"] == rest["rank"]], "left_semi").select(*keys, "rank", "v")
    values = equal.unionByName(picked).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    both = sizes.join(values, _same(sizes, values, keys)).select(*[sizes[k] for k in keys], "n", "at")
    pick = lambda q, f: F.col("at")[f(place(q)).cast("long")]
    return both.select(*keys, *[(pick(q, F.floor) + (pick(q, F.ceil) - pick(q, F.floor)) * (place(q) - F.floor(place(q)))).alias(name) for name, q in wanted.items()])


def with_percentiles(aggregated: DataFrame, df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """aggregated (a row for each of the keys) with percentiles() of df; null where a group has no value."""
    p = percentiles(df, keys, value, wanted)
    return aggregated.join(p, _same(aggregated, p, keys), "left").select(*[aggregated[c] for c in aggregated.columns], *[p[c] for c in wanted])
