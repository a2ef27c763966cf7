"""Run-time helpers: scratch tables in the cluster's shared folder, worker set-up."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch, as whole texts can be long; and how much larger than its files a table is taken to
#: be, as scratch tables compress well, so that none is broadcast for the size of its files.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20), "spark.sql.sources.fileCompressionFactor": "10.0"}
#: What workers get in their environment unless the user set it: memory that a batch needed goes back to the system.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "131072"}

_own: dict[str, str] = {}
_marked: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, and bound Arrow batches and broadcasts. Settings of the user's own stay as they are."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    own = {k: v for k, v in spark.sparkContext.getConf().getAll() if k in SETTINGS}
    for k, v in SETTINGS.items():
        if k not in own:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master (tests) gets one of its own; a cluster must name one that its machines share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="skein-")
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the application's scratch folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        _marked.add(folder)
        at, system = _file_system(spark, folder)
        system.mkdirs(at)
        system.deleteOnExit(at)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    return stage_at(df, label, codec)[0]


def stage_at(df: DataFrame, label: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    at, system = _file_system(spark, path)
    system.delete(at, True)


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside path and rename it over path, so that readers find the old text or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, system = _file_system(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(new), system.makeQualified(at), over)


def read_file(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    at, system = _file_system(spark, path)
    n = system.getFileStatus(at).getLen()
    source = system.open(at)
    try:
        return bytes(source.readNBytes(n)).decode()
    finally:
        source.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer files than cores and no more bytes than this is dealt out to all cores: one file may be one row group, and so one task.
SPREAD_BYTES = 64 << 20


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """table(), dealt out to all cores where it is small and of few files. What work there is on small tables is by text, not by bytes."""
    df = table(spark, sf_dir, name)
    at, system = _file_system(spark, f"{sf_dir}/{name}.parquet")
    found, cores = system.getContentSummary(at), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if found.getLength() <= SPREAD_BYTES and found.getFileCount() < cores else df
