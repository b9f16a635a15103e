"""A corpus pipeline: quality rules, near-duplicate removal, masking of secrets, mixing of sources, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as
Parquet into the shared folder and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import jaccard, mixing, packing, quality, secrets
from folio.llm.shared import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null, empty and blank texts are too short and go; each row is judged by itself, so repeated rows go or stay together
    and there are no ties; very long texts are judged whole; an empty table stays empty; other columns pass by.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays, that of the smallest doc_id; null ones come last.

    If a doc_id is null or repeated, rows are compared by keys of their own, in a staged copy: different texts of one
    doc_id stay, and copies without doc_id go. Of copies of one doc_id the one whose columns hash least stays. Rows
    without words (null, empty or blank texts) are copies of nothing and stay. Very long texts are compared whole; an
    empty table stays empty; other columns pass by, whatever their names.
    """
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        found = staged(jaccard.join(docs).filter("doc_id <> component_id").select("doc_id"), "pipeline-copies")
        return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*columns))
    keyed = staged(docs.select(F.struct(*columns).alias("document"), F.col("text").alias("text"), rank.alias("place"), F.monotonically_increasing_id().alias("key")), "pipeline-keyed")
    groups = jaccard.join(keyed, "key").filter("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("copies"))
    ranked = staged(groups.join(keyed.select("key", F.struct("place", "key").alias("place")), "key"), "pipeline-groups")
    first = ranked.groupBy("copies").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    go = ranked.join(first, "copies").filter("place <> first").select("key")
    return keyed.join(go, "key", "left_anti").select("document.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars, if there, is counted anew where it was the text's length.

    Null and empty texts stay as they are; overlapping spans (ties) are masked once; each row is masked by itself, so
    repeated rows stay equal; very long texts are scanned whole; an empty table stays empty; other columns pass by,
    whatever their names.
    """
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), "doc_id", "text")
    masked = secrets.mask(carried)
    before, after = F.col("document")["text"], F.col("text")
    counted = lambda n: F.when(n == F.length(before), F.length(after).cast("long")).otherwise(n)
    fresh = {"text": lambda _: after, "n_chars": counted}
    return masked.select(*(fresh.get(c, lambda own: own)(F.col("document")[c]).alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix reads it, twice at most.

    Null sources are one source; texts without words (null, empty or blank) are never read and go; repeated rows are
    documents of their own; documents of one position (ties) stand by a hash; very long texts are read whole or, if less
    than half of one is left in the target, not at all; an empty table stays empty; other columns pass by.
    """
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents with their places in sequences.

    Null and empty texts are the end token alone; repeated rows and rows without doc_id are documents of their own;
    pieces of equal length (ties) stand by doc_id and start; very long texts are cut into full sequences and a rest; an
    empty table gives no pieces; other columns are not read.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("packing", sequence_packing),
]

#: None: SQL can't express the tokenizer; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
