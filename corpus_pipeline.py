"""The corpus pipeline: five stages over documents, each written and read again before the next.

In every stage null and empty texts are texts without words, other columns (of any name) pass unchanged, repeated rows stay or go together, and an
empty table gives an empty one. Near copies and decontamination decide by id: rows of one id share its decision."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from displace.llm.decontaminate import contaminated_words
from displace.llm.near_copies import near_copy_groups
from displace.llm.pieces import Model, encode_texts
from displace.llm.secrets import find_secrets, redact
from displace.llm.toxicity import score_toxicity
from displace.session import materialize

PIECES = os.environ.get("DISPLACE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier does not call toxic; null and empty texts are scored as texts without features. Without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return score_toxicity(own, labels).where("predicted = 0").select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, similarity 0.8): the one with the smallest id. Ids are whole
    numbers (others are an error). Documents without an id belong to no group and all stay."""
    kept = near_copy_groups(docs.select("doc_id", "text")).where(F.col("doc_id") == F.col("group")).select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of a twentieth of their words or more. Rows of one id go together; documents without an id stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated_words(docs.select("doc_id", "text"), items)
    bad = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars, if there, counted again."""
    rest = [c for c in docs.columns if c != "text"]
    out = redact(find_secrets(docs.select("doc_id", "text", F.struct(*rest).alias("_rest"))))
    now = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[now[f.name].cast(f.dataType).alias(f.name) if f.name in now else F.col("_rest")[f.name].alias(f.name) for f in docs.schema.fields])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids; none for null and empty texts."""
    return encode_texts(docs.select("doc_id", "text"), Model.load(PIECES)).select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontaminate", decontaminate), ("secrets", secrets), ("tokens", tokens)]

#: A fitted classifier, SimHash groups and a segmentation are not expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
