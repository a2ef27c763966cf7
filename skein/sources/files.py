"""Readers: JSON lines, evaluation sets, file manifests, address lists, sitemaps, chat logs."""

from __future__ import annotations

import io
import re
import tarfile
from functools import reduce

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.quantiles import with_percentiles

CHUNK_SCHEMA = (
    "chunk_id string, source_name string, title string, url string, text string, start_offset int, end_offset int, content_hash string, section_header string, chunk_type string, "
    "word_count int, heading_path array<string>, chunk_index int, total_chunks int, crawled_at string, doc_type string, language string, spark_version string, module string, source_commit string, "
    "file_path string, license string, parser_version string, chunker_version string, index_generation string, deployment_mode string, parent_content_hash string, segment_index int, segment_total int, "
    "token_count int, character_count int, representation string, parent_chunk_id string"
)
RECALL_SCHEMA = "id string, question string, expected_urls array<string>, expected_terms array<string>, expected_doc_types array<string>, source_name string, doc_type string, intent string, complexity string, out_of_scope boolean"
QA_SCHEMA = "id string, question string, ground_truth string, answer string, contexts array<string>, source_name string"
#: Endings of files that are never text.
BINARY = "png jpg jpeg gif ico svg pdf zip gz tar jar class so dll exe parquet avro orc woff woff2 ttf".split()


def jsonl(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """SRC10/SRC11: JSON lines of a schema; lines that don't parse are skipped, missing fields are null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Missing fields of a chunk as its sentinels: empty text, 0, -1 for segment_index, 1 for segment_total."""
    special = {"segment_index": -1, "segment_total": 1, "chunk_type": "text"}
    out = []
    for f in chunks.schema:
        kind = f.dataType.simpleString()
        empty = special.get(f.name, "" if kind == "string" else 0 if kind == "int" else None)
        out.append(F.coalesce(f.name, F.lit(empty) if empty is not None else F.array().cast(kind)).alias(f.name))
    return chunks.select(out)


def glob_regex(glob: str) -> str:
    """A path glob with **, * and ? as a regular expression."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def manifest(files: DataFrame, include: list[str], exclude: list[str] = (), most_bytes: int = 2_000_000, requires: list[str] = ()) -> DataFrame:
    """SRC6: relative_path, size, sha256 of the files (relative_path, content) that the globs select."""
    match = lambda globs: reduce(lambda a, b: a | b, [F.col("relative_path").rlike(glob_regex(g)) for g in globs], F.lit(False))
    text = F.try_to_binary(F.col("content")) if files.schema["content"].dataType.simpleString() == "string" else F.col("content")
    out = files.where(match(include) & ~match(list(exclude)) & (F.octet_length(text) <= most_bytes))
    out = out.where(~F.lower(F.substring_index("relative_path", ".", -1)).isin(BINARY))
    for s in requires:
        out = out.where(F.col("content").cast("string").contains(s))
    return out.select("relative_path", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_hash(m: DataFrame) -> DataFrame:
    """One row: files, and a hash of all rows of the manifest whatever their order: SHA-256 over the sums of the rows' SHA-256 words.

    A sum, so that no list of all files is gathered; unlike an exclusive or it counts repeated rows.
    """
    line = F.sha2(F.to_json(F.struct("relative_path", "sha256", "size")), 256)
    words = [F.sum(F.conv(F.substring(line, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    return m.agg(F.count("*").alias("files"), F.sha2(F.concat_ws(",", *words), 256).alias("manifest_hash"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC5/SRC6: relative_path, content of every file below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(re.sub(r"^file:/+", "/", root).rstrip("/")) + "/", "")
    return raw.select(rel.alias("relative_path"), "content")


def url_index(texts: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """SRC7: title, url of the list entries `- [Title](address)` under a prefix."""
    pair = F.regexp_extract_all(text, F.lit(r"(?m)^\s*-\s*\[[^\]]*\]\([^)\s]+\)"), F.lit(0))
    out = texts.select(F.posexplode(pair).alias("position", "e")).select("position", F.regexp_extract("e", r"\[([^\]]*)\]", 1).alias("title"), F.regexp_extract("e", r"\(([^)\s]+)\)", 1).alias("url"))
    return out.where(F.col("url").startswith(prefix))


def sitemap(texts: DataFrame, xml: str = "xml", prefix: str = "") -> DataFrame:
    """SRC3: loc, lastmod of a sitemap's entries under a prefix."""
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    field = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    out = texts.select(F.explode(entries).alias("e")).select(field("loc").alias("loc"), field("lastmod").alias("lastmod"))
    return out.where(F.col("loc").startswith(prefix))


def eval_violations(rows: DataFrame) -> DataFrame:
    """FLT25: what is wrong with recall rows: no or repeated id, no question, nothing expected though in scope."""
    bad = lambda cond, why: F.when(cond, F.lit(why))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    checks: list[Column] = [
        bad(F.coalesce(F.trim("id"), F.lit("")) == "", "no_id"), bad(F.coalesce(F.trim("question"), F.lit("")) == "", "no_question"),
        bad(~F.coalesce("out_of_scope", F.lit(False)) & empty("expected_urls") & empty("expected_terms"), "nothing_expected"),
        bad(F.coalesce("out_of_scope", F.lit(False)) & ~(empty("expected_urls") & empty("expected_terms")), "out_of_scope_expects"),
    ]
    single = rows.select("id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("violation"))
    repeated = rows.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("violation"))
    return single.unionByName(repeated)


def mirrored(files: DataFrame, root: str) -> None:
    """SRC8's other side: tasks write the files (relative_path, content) below root, in the shared folder; a task that runs again writes the same."""

    def run(batches):
        system, top = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, data in zip(b.column("relative_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                system.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write(data)
            yield b.select(["relative_path"])

    files.select("relative_path", "content").mapInArrow(run, "relative_path string").write.format("noop").mode("overwrite").save()


def checked_mirror(spark: SparkSession, root: str, commit: str, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """SRC8: the manifest of a mirror on disk; its HEAD file must name the pinned commit."""
    head = spark.read.text(f"{root}/HEAD").first()
    if not head or head[0].strip() != commit:
        raise ValueError("the mirror isn't at the pinned commit")
    return manifest(scan_files(spark, root).where("relative_path <> 'HEAD'"), include, exclude)


def rendered_pages(files: DataFrame, include: list[str], exclude: list[str] = (), base: str = "") -> DataFrame:
    """SRC9: relative_path, canonical_url, sha256 of the pages that a build left; an index page stands for its folder."""
    rows = manifest(files, include, exclude, 1 << 30)
    return rows.select("relative_path", F.concat(F.lit(base), F.regexp_replace("relative_path", r"(^|/)index\.html?$", "$1")).alias("canonical_url"), "sha256")


def unpacked(archive: DataFrame) -> DataFrame:
    """SRC5: relative_path, content of the files in tar.gz archives (column content), without the top folder; unsafe paths are an error."""

    def run(batches):
        for b in batches:
            paths, contents = [], []
            for data in b.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                    for m in t:
                        if m.name.startswith("/") or ".." in m.name.split("/") or m.issym() or m.islnk():
                            raise ValueError(f"unsafe path in an archive: {m.name}")
                        if m.isfile():
                            paths.append(m.name.split("/", 1)[-1])
                            contents.append(t.extractfile(m).read())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["relative_path", "content"])

    return archive.select("content").mapInArrow(run, "relative_path string, content binary")


def packed(rows: DataFrame) -> DataFrame:
    """SRC5's other side: a tar.gz archive (content) of each row's file (path, content)."""

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                buffer = io.BytesIO()
                with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as t:
                    info = tarfile.TarInfo(path)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["content"])

    return rows.select("path", "content").mapInArrow(run, "content binary")


def stored_urls(chunks: DataFrame, source: str | None = None) -> DataFrame:
    """SRC12: distinct addresses in the index, of one source if given."""
    return (chunks.where(F.col("source_name") == source) if source else chunks).select("url").distinct()


def children_of(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """SRC12: the chunks of some parents (parent_content_hash) with their place among the siblings."""
    return chunks.join(parents.select("parent_content_hash").distinct(), "parent_content_hash", "left_semi").select("parent_content_hash", "segment_index", "chunk_id", "text")


def configs(spark: SparkSession, path: str, schema: str, required: list[str], lines: bool = False) -> DataFrame:
    """SRC14: source configurations of a JSON file, or of JSON lines; a row without a required value is an error."""
    rows = spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("mode", "FAILFAST").json(path)
    bad = rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in required]))
    if not bad.isEmpty():
        raise ValueError(f"a configuration without {required}")
    return rows


def trace_metrics(traces: DataFrame, view: str) -> DataFrame:
    """SRC15: one of the metrics views over traces (model, day, cost, latency, score_name, score)."""
    views = {
        "cost_by_model": lambda t: t.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost")),
        "daily_volume_and_latency": lambda t: with_percentiles(t.groupBy("day").agg(F.count("*").alias("n")), t, ["day"], "latency", {"p95": 0.95}).withColumn("p95", F.round("p95", 4)),
        "score_summary": lambda t: t.where("score_name is not null").groupBy("score_name").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean")),
    }
    return views[view](traces)


def review_items(rows: DataFrame, reviewed: DataFrame, key: str, low: float) -> DataFrame:
    """SRC16: rows of a dataset that a reviewer should see: scored below low and not yet reviewed."""
    return rows.where(F.col("score") < low).join(reviewed.select(key), key, "left_anti")


def indexed_documents(index: DataFrame, found: DataFrame, prefix: str, least_chars: int) -> DataFrame:
    """PRS10: title, url, relative_path, text, doc_type of the listed addresses (title, url) whose files (relative_path, text) are there.

    Front matter is cut; what is shorter than least_chars then is a stub and goes. Files below api/ are references.
    """
    rel = F.when(F.col("url").startswith(prefix), F.substring("url", len(prefix) + 1, 1 << 30)).otherwise(F.regexp_extract("url", r"^[A-Za-z]+://[^/]*/*([^?#]*)", 1))
    out = index.withColumn("relative_path", rel).join(found, "relative_path").withColumn("text", F.regexp_replace("text", r"\A---\r?\n(?s:.*?)\r?\n---\r?\n?", ""))
    kind = F.when(F.substring_index("relative_path", "/", 1) == "api", "api_reference").otherwise("guide")
    return out.where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= least_chars).select("title", "url", "relative_path", "text", kind.alias("doc_type"))
