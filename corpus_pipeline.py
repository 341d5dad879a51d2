"""A training corpus from documents: toxicity, line and document de-duplication, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from leafmill.llm.components import discard, release, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the lexicon is learned from the labels of this stage's own documents.

    A null or empty text has no match and stays; rows that repeat are scored
    alike. Labels of other documents, and null ones, count for nothing.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.found("text")["score"] < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that another place has already; one that loses every line that is not blank goes.

    Null, empty and blank texts lose nothing and stay. The first place by
    doc_id, then by a hash of the text, keeps its line; rows equal in both keep
    the same lines. n_chars is counted anew where a text has changed.
    """
    columns = docs.columns
    others = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"])  # beside the text, so that no name meets the operator's
    found = line_dedup.dedup_lines(docs.select("doc_id", "text", others.alias("row_")))
    emptied = F.col("line_keep").isNotNull() & ~F.col("kept_text").rlike(r"[^\s\x{A0}\x{3000}]")
    n_chars = lambda: F.when(F.col("line_keep").isNull(), F.col("row_.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    new = {"text": lambda: F.col("kept_text"), "n_chars": n_chars}
    return found.where(~emptied).select(*[new.get(c, lambda c=c: F.col("row_")[c])().alias(c) for c in columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component; rows that share a doc_id are one document, a null id stays.

    Null and empty texts link with nothing and stay.
    """
    found = ngram_join.near_duplicates(docs)
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("c")).where("c <> doc_id").select(F.col("doc_id").alias("gone_id_"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id_"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows equal in doc_id and text share their copies evenly.

    A null or empty text has no words, so the mix takes it as it takes any
    document of size 0. Ties are broken by the hash that orders the sample.
    """
    columns = docs.columns
    taken = mixing.mix_sources(docs).groupBy("doc_id", "th").agg(F.round(F.avg("copies")).cast("int").alias("copies_"))
    taken = taken.select(F.col("doc_id").alias("taken_id_"), F.col("th").alias("taken_th_"), "copies_").where("copies_ > 0")
    whole = docs.select(F.struct("*").alias("row_"), F.xxhash64("text").alias("th_"))
    same = F.col("row_.doc_id").eqNullSafe(F.col("taken_id_")) & (F.col("th_") == F.col("taken_th_"))
    copies = whole.join(taken, same).select("row_", F.explode(F.sequence(F.lit(1), F.col("copies_"))))
    return copies.select(*[F.col("row_")[c].alias(c) for c in columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; a null text counts as empty, rows that repeat are encoded alike."""
    return bpe.encode_documents(docs, bpe.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what one stage keeps is the next one's input, until that has its own."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = store(stage(spark, docs, sf_dir))
        release(spark)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
