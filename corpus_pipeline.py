"""The corpus pipeline: five stages from documents to token ids, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, decontam, neardup, quality, secrets
from orrery.llm.common import drop_folders, folders, new_folder, settled, shared_table, without_rows
from orrery.llm.queries import token_digests

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: All stages take any documents: null and empty texts have no words, an empty table gives no rows, repeated rows and rows that share
#: a doc_id or have none are told apart, and further columns, whatever their names, are carried along unless a stage says otherwise.
#: Of those that a stage reads, all but doc_id and text may be absent.
ROW = "__pipeline_row"
#: The columns that stages read.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage: Stage) -> Stage:
    """The stage on documents whose further columns have names that no operator uses; they get their own names back."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        renamed = docs.toDF(*[c if c in READ else f"__further_{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, renamed, sf_dir).toDF(*docs.columns)

    return run_stage


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of each row, written out so that the number stays."""
    return shared_table(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


@_apart
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the standard policy; null and empty texts don't, repeated rows all or none."""
    return quality.passing_rows(quality.rule_ledger(docs), quality.STANDARD).select(*docs.columns)


@_apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles: that of the smallest doc_id (null last), of several rows
    with it the first read.

    Rows are compared by their texts alone: different texts that share a doc_id both stay, and repeated rows leave one. Texts without
    words are no duplicates of each other.
    """
    rows = _numbered(docs)
    made = len(folders(spark))
    groups = neardup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), p=neardup.Params(shingle=5))
    groups = settled(groups.select(F.col("doc_id").alias(ROW), "component_id"), "groups", made)
    members = groups.join(rows.select(ROW, "doc_id"), ROW)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW).alias("row"))
    first = members.groupBy("component_id").agg(F.min(order)["row"].alias("row"), F.count("*").alias("n")).where("n > 1")
    first = shared_table(first, "first")  # written, so that the join can split a group that a third of all rows are in
    others = groups.join(first, "component_id").where(F.col(ROW) != F.col("row")).select(ROW)
    return without_rows(rows, settled(others, "others", made), ROW).select(*docs.columns)


@_apart
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; rows that share a doc_id are judged apart, and those without one like all others."""
    rows = _numbered(docs)
    made = len(folders(spark))
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc=ROW).select(F.col("doc_id").alias(ROW)).distinct()
    return without_rows(rows, settled(found, "contaminated", made), ROW).select(*docs.columns)


@_apart
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars (if they have it) as it is then; null texts stay null. Without a source,
    nobody owns a value, and none is an example for its owners' number."""
    owned = docs if "source" in docs.columns else docs.withColumn("source", F.lit(None).cast("string"))
    masked = secrets.redact(secrets.scan_secrets(owned))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (4 bytes each), their number, and digests of the ids and of what they decode to, with doc_id, and lang
    and source if they are there; null and empty texts have no ids."""
    told = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(bpe.transcode_documents(docs.select(*told, "text"), vocabulary), *told, "token_ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe", bpe_tokens),
]

#: Near-duplicate components with an approximate candidate search, and tokens, are beyond SQL; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of `sf_dir`, each written as Parquet to the shared folder and read again.

    When a stage is written, the tables that it made on its way are deleted, and so is the stage before it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(folders(spark))
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        folder = new_folder(spark)
        out.write.parquet(f"{folder}/{name}")
        folders(spark).remove(folder)
        drop_folders(spark, before)
        folders(spark).append(folder)
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
