"""A corpus pipeline over documents: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns the columns of
documents, the last one the packed pieces.  Rows that the quality rules reject are gone; one document of each group of
near-duplicates stays; personal data are replaced by their kind; a document is repeated as often as the mix takes it,
and documents that it takes zero times are gone.

Defined results: a null or empty text has no words and goes in the first stage; rows with a null doc_id are documents of
their own and stay; of rows under one doc_id that with the least text stays; ties in the mix are dealt by hash, the same
in every run; repeated rows in the mix have one count; an empty table gives no rows; other columns, whatever their names,
go through all stages but the last, which reads doc_id and text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.llm import minhash, mixing, packing, pii, quality
from pitmart.llm.common import discard, materialize, n_words, table, tidy

#: Percent of common word shingles from which documents are near-duplicates.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_labelled(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_duplicates(docs, percent=NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keys = ["doc_id", "source", "size"]  # rows that agree in them, nulls too, have one count
    taken = mixing.mix(docs).where("copies > 0").groupBy(keys).agg(F.max("copies").cast("int").alias("copies")).withColumnsRenamed({c: f"t_{c}" for c in keys})
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", n_words("text").alias("size"))
    same = F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size"))
    # dealt by id at every size: what is taken grows with the corpus and is never broadcast
    return rows.join(taken.hint("merge"), same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(materialize(packing.tokenize_pieces(docs)))


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_pieces),
]

#: Tokens, signatures and a trained span classifier are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each result written to the shared folder and read again.  What a stage has written besides
    goes once its result stands, and that once the next one's does: one table is left."""
    docs, done = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = tidy(stage)(spark, docs, sf_dir)
        if done is not None:
            discard(done)
        done = docs
    return docs
