"""Sinks: generations of an index as Parquet tables, upserts, artifact files, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.runtime import drop_path

STATE_VERSION = 1


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """SNK1: old rows whose key is not in new, and the last new row of each key by order."""
    if order:
        new = newest(new, key, order)
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def newest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest order; equal ones go by a hash of the row. An aggregate with map-side combine, no window."""
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest)))
    return df.groupBy(key).agg(last.alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def insert_new(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """SNK6: old rows, and of keys that old doesn't have the newest new row by order."""
    return old.unionByName(newest(new, key, order).join(old.select(key), key, "left_anti").select(old.columns))


def delete_by(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """SNK2: rows whose column isn't among values' first column."""
    return df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_anti").select(df.columns)


def write_generation(chunks: DataFrame, root: str, generation: str) -> str:
    """SNK1/SNK5: a generation is a partition folder of its own, written whole."""
    path = f"{root}/index_generation={generation}"
    chunks.write.mode("errorifexists").parquet(path)
    return path


def activate(spark: SparkSession, root: str, generation: str, seen: int | None = None) -> int:
    """SNK5: point at a generation, in one step; activating an earlier one again is a rollback. Returns the number of the activation.

    Every activation is a version of a log. seen: the number that the caller decided on, as activation() gave it; if another
    writer has activated something since, that is a commits.Conflict and nothing changes.
    """
    from skein.plans import commits

    log = commits.Log(spark, root)
    while True:
        base = log.read(seen) if seen is not None else log.read()
        try:
            return log.commit(base, {"active": generation}).number
        except commits.Conflict:
            if seen is not None:
                raise


def activation(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and generation of the last activation; 0 and None before the first."""
    from skein.plans import commits

    version = commits.Log(spark, root).read()
    return version.number, version.folders.get("active")


def active(spark: SparkSession, root: str) -> str:
    number, generation = activation(spark, root)
    if generation is None:
        raise ValueError("no generation is active")
    return generation


def read_active(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/index_generation={active(spark, root)}")


def classify_generations(generations: DataFrame, pinned: DataFrame, current: str) -> DataFrame:
    """SNK5: active, stale (of a pin, but not current) or orphan (of no pin) for each generation."""
    p = pinned.select("generation").distinct().withColumn("_p", F.lit(True))
    return generations.join(p, "generation", "left").select("generation", F.when(F.col("generation") == current, "active").when(F.col("_p"), "stale").otherwise("orphan").alias("status"))


def reset(spark: SparkSession, root: str, generation: str, confirm: str) -> None:
    """SNK5: delete a generation; confirm must repeat its name, and the active one is never deleted."""
    if confirm != generation or active(spark, root) == generation:
        raise ValueError("not confirmed, or active")
    drop_path(spark, f"{root}/index_generation={generation}")


def write_artifacts(chunks: DataFrame, coverage: DataFrame, root: str) -> DataFrame:
    """SNK3/AGG31: chunks and coverage as JSON lines, and the one-row report, which is returned as well."""
    chunks.write.mode("overwrite").json(f"{root}/chunks.jsonl")
    coverage.write.mode("overwrite").json(f"{root}/coverage.jsonl")
    report = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("source_name").alias("sources"), F.sha2(F.bit_xor(F.xxhash64("chunk_id", "content_hash")).cast("string"), 256).alias("combined_hash"))
    report.write.mode("overwrite").json(f"{root}/build_report.json")
    return report


def save_bm25(df: DataFrame, stats: DataFrame, root: str) -> None:
    """SNK4: a fitted vocabulary, with the version of its format."""
    df.write.mode("overwrite").parquet(f"{root}/df")
    stats.withColumn("version", F.lit(STATE_VERSION)).write.mode("overwrite").parquet(f"{root}/stats")


def load_bm25(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    stats = spark.read.parquet(f"{root}/stats")
    if stats.first()["version"] != STATE_VERSION:
        raise ValueError("a BM25 state of another version")
    return spark.read.parquet(f"{root}/df"), stats.drop("version")


def append_log(rows: DataFrame, path: str) -> None:
    """SNK7/SNK8/SNK11: append rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def profile_report(stages: DataFrame, root: str) -> DataFrame:
    """SNK10: a profile's rows by stage as a JSON report and a Markdown table in root; the rows are returned."""
    cols = stages.columns
    row = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    head = stages.sparkSession.createDataFrame([("| " + " | ".join(cols) + " |",), ("|" + "-|" * len(cols),)], "line string")
    lines = stages.orderBy("stage").select(row([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("line"))
    stages.write.mode("overwrite").json(f"{root}/report.json")
    head.unionByName(lines).coalesce(1).write.mode("overwrite").text(f"{root}/report.md")  # a row a stage
    return stages.sparkSession.read.schema(stages.schema).json(f"{root}/report.json")
