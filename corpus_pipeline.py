"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run()
applies them to documents. All stages but the last return the columns of documents.
Further columns of docs pass through, whatever their names. Empty docs give no rows.
Very long texts are handled whole. Rows equal in doc_id, source and text share one fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, langid, line_dedup, mixing, simhash
from skein.llm.ordering import fresh
from skein.plans.runtime import stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject.

    Null texts and texts without a letter are rejected where there is a model; without labelled documents all rows stay.
    Null doc_ids, langs and sources are no reason to go; repeated rows stay as often as they are there. Texts that two
    languages score alike go by the first of these.
    """
    return langid.accepted(docs, langid.train(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs, n_chars anew where a line went; documents that lose every word go.

    Null and word-free texts that lost nothing stay as they are. The first copy is that of the smallest doc_id (null
    first), then by a hash of the text, then by line; rows equal in doc_id and text are no copies of each other.
    """
    names = fresh(docs, "n_lines", "n_removed", "emptied")
    out = line_dedup.dedup_lines(docs, names=tuple(names)).where(~F.col(names[2]))  # a condition on the new text would have it computed again
    size = F.when(F.col(names[1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the smallest doc_id (null last), ties by hashes of the text and of the other columns.

    Null and word-free texts are one group with fingerprint zero; of rows equal in all columns one stays.
    """
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0 to 3 times) as the mix to the sources' targets takes them.

    Null texts and texts without words are kept once; a null source is a source of its own; rows that share or lack a
    doc_id are told apart by source and text; ties in the shuffled order go by doc_id, size and a hash of the text.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text in the mix; a null text has no tokens, repeated rows each keep a row."""
    return bpe.digests(docs)


STAGES = [("language ID", language_id), ("line dedup", line_dedup_stage), ("SimHash near-dedup", near_dedup), ("mixing", mix), ("BPE", tokenize)]

#: Language ID, SimHash's bit counts and BPE are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
