"""Line dedup by a suffix array over line-ID sequences, in DataFrame functions only.

A document is the sequence of its non-blank lines. All lines of all documents get one global position each, in the order
of copies (doc_id, text, line), and an ID of 128 bits. Distributed prefix doubling ranks the suffixes: at level k the rank
of a suffix is the first position at which its first 2^k lines stand, and level k + 1 joins the ranks of positions i and
i + 2^k and ranks the pairs anew. A suffix whose rank nobody shares has its place in the array and leaves the rounds, so
that a round holds repeated runs only; the rounds end when the longest repeated run is passed.

Suffixes of equal rank at level k are an interval of the suffix array whose longest common prefix is 2^k lines or more.
All but the first of an interval are later copies of the run; the runs of all intervals of MIN_LINES or more, merged
where they touch or overlap, are the maximal repeated runs, and their later copies are deleted. So are later copies of a
single line of at least MIN_WORDS words.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.ordering import fresh, ranked
from skein.plans.runtime import drop_path, stage, stage_at

#: A run of so many lines (a power of two) is enough, or one line of so many words.
MIN_LINES, MIN_WORDS = 4, 10
BLANK, BLACK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def positions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """pos, doc_id, th (the text's hash), at, left (lines of the document from this one on), long (min_words words), a, b: every non-blank line.

    Rows equal in doc_id and text are one document. The two halves of a line's ID are salted hashes of its text.
    """
    long = rf"^{BLANK}*+(?:{BLACK}++{BLANK}++){{{min_words - 1}}}{BLACK}"
    line = lambda x: F.when(x.rlike(BLACK), F.struct(x.rlike(long).alias("long"), F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b")))
    seq = F.filter(F.transform(F.split("text", "\n", -1), line), lambda x: x.isNotNull())
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), seq.alias("seq"))
    rows = rows.select("doc_id", "th", F.size("seq").alias("n"), F.posexplode("seq").alias("at", "x")).select("doc_id", "th", "at", (F.col("n") - F.col("at")).alias("left"), "x.*")
    # written before the range partitioning samples it, so that texts are split once
    return ranked(stage(rows, "lines"), [F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("at")], "pos", distinct=["doc_id", "th", "at"])


def _level(members: DataFrame, keys: list[str]) -> DataFrame:
    """pos, left, rank, long of the members that share their keys with another one; rank: the first position of these.

    The classes are a table of their own, so that the join has partitions that Spark may split where a key is frequent.
    """
    classes = members.groupBy(*keys).agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    return members.join(stage(classes, "suffix-classes"), keys).select("pos", "left", F.col("first").alias("rank"), "long")


def levels(lines: DataFrame) -> list[tuple[DataFrame, str]]:
    """The levels of the suffix array with a table's path each: pos, left, rank, long of the suffixes whose first 2^k lines stand elsewhere as well."""
    found, k = [stage_at(_level(lines.select("pos", "left", "long", "a", "b"), ["a", "b"]), "suffix-ranks")], 0
    while not found[-1][0].isEmpty():
        now, step = found[-1][0], 1 << k
        ahead = now.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        found.append(stage_at(_level(now.where(F.col("left") > step).join(ahead, "pos"), ["rank", "next"]), "suffix-ranks"))
        k += 1
    drop_path(lines.sparkSession, found.pop()[1])
    return found


def runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, n, first, last, lines: maximal runs of non-blank lines (numbered without blank ones) that are later copies; n: all such lines of the document."""
    depth = round(math.log2(min_lines))
    if 1 << depth != min_lines:
        raise ValueError("min_lines is a power of two")
    lines = positions(docs, min_words)
    spark, found = lines.sparkSession, levels(lines)
    later = lambda k, cond: found[k][0].where((F.col("pos") != F.col("rank")) & cond).select("pos", F.lit(1 << k).alias("n"))
    copies = [later(0, F.col("long"))] if found else []
    copies += [later(k, F.lit(True)) for k in range(depth, len(found))]
    if not copies:
        return lines.where("false").select("doc_id", "th", F.col("left").alias("n"), F.col("at").alias("first"), F.col("at").alias("last"), F.lit(0).cast("long").alias("lines"))
    windows = copies[0]
    for c in copies[1:]:
        windows = windows.unionByName(c)
    windows = windows.groupBy("pos").agg(F.max("n").alias("n")).join(lines.select("pos", "doc_id", "th", "at", (F.col("at") + F.col("left")).alias("all")), "pos")
    inside = W.partitionBy("doc_id", "th").orderBy("at")
    reach = F.max(F.col("at") + F.col("n")).over(inside.rowsBetween(W.unboundedPreceding, -1))
    marked = windows.withColumn("new", F.when(F.col("at") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    merged = marked.groupBy("doc_id", "th", "run").agg(F.first("all").alias("all"), F.min("at").alias("first"), (F.max(F.col("at") + F.col("n")) - 1).alias("last"))
    out = stage(merged.select("doc_id", "th", F.col("all").alias("n"), "first", "last", (F.col("last") - F.col("first") + 1).cast("long").alias("lines")), "line-runs")
    for _, path in found:
        drop_path(spark, path)
    return out


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, names: tuple[str, str, str] = ("n_lines", "n_removed", "emptied")) -> DataFrame:
    """docs with text rid of later copies of repeated line runs, plus n_lines, n_removed and emptied (no non-blank line is left of some), or as names has it.

    Order of copies: doc_id (null first), then the text's hash, then the line. Lines are what stands between \\n; blank
    lines are neither compared nor deleted. Null texts stay null with 0 lines; an empty text is one blank line; very long
    texts are split whole. Rows equal in doc_id and text are one document: they share its fate, and are no copies of each
    other; rows of different texts that share a doc_id, or have none, are told apart by their texts. No rows give no rows.
    Further columns stay as they are, n_chars among them; columns with one of the names, in upper or lower case, are replaced.
    """
    h, id_, th, found_runs, gone, all_, full, gaps = fresh(docs, "_h", "_id", "_th", "_runs", "_gone", "_all", "_full", "_gaps")
    found = runs(docs, min_lines, min_words).groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.collect_list(F.struct("first", "last")).alias(found_runs), F.sum("lines").alias(gone), F.first("n").alias(all_))
    found = found.hint("shuffle_hash")  # a few numbers a document: the texts needn't be sorted
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64("text").alias(h)).join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(th)), "left")
    lines = F.split("text", "\n", -1)
    numbers = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(BLACK), i)), lambda i: i.isNotNull())
    out = out.withColumn(full, F.when(F.col(found_runs).isNotNull(), numbers))  # of the non-blank lines
    out = out.withColumn(gaps, F.transform(found_runs, lambda r: F.struct(F.get(full, r["first"]).alias("first"), F.get(full, r["last"]).alias("last"))))
    in_gap = lambda i: F.exists(gaps, lambda g: (g["first"] <= i) & (i <= g["last"]))
    kept = F.filter(lines, lambda x, i: ~in_gap(i) | ~x.rlike(BLACK))
    text = F.when(F.col(gaps).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in keep], n_lines.alias(names[0]), F.coalesce(gone, F.lit(0)).cast("long").alias(names[1]), F.coalesce(F.col(gone) == F.col(all_), F.lit(False)).alias(names[2]))
