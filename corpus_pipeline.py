"""From raw documents to packed sequences, in five stages. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.workspace import discard, materialise
from llm import op4_decontamination, op6_packing, op7_simhash, op8_recompression, op10_toxicity
from llm.common import bounded_batches, numbered
from llm.tokens import default_path

SHINGLE_WORDS, SIMILARITY = 5, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at CUT or more go. Rows are decided one by one; null and empty texts get the score of no votes and stay."""
    bounded_batches(spark)
    model = op10_toxicity.fit_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = op10_toxicity.free_name(docs, "toxicity")
    return op10_toxicity.scored(docs, model, column=score).filter(F.col(score) < op10_toxicity.CUT).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows, the one with the smallest id stays (of rows with one id or none, the first by text; ids go before none).

    Null and empty texts are copies of one another. An empty table stays empty; other columns are carried and not read, whatever their names.
    """
    bounded_batches(spark)
    d = numbered(docs, "_row")
    r = op7_simhash.similar_documents(d, SHINGLE_WORDS, SIMILARITY, id_col="_row")
    keep = materialise(r.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_row")))
    return d.join(keep.hint("merge"), "_row", "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that occur more than once go; documents that have nothing left go too, but not those that had no words.

    Rows with one id or none are rows of their own, and their passages count. A null text becomes empty. Documents that lose nothing keep their spacing.
    """
    bounded_batches(spark)
    d = numbered(docs, "_row")
    kept = op8_recompression.dedup_substrings(d, id_col="_row", keep_text=True).filter("n_words > n_removed or n_words = 0")
    out = d.drop("text", "n_chars").join(kept.select(F.col("doc_id").alias("_row"), F.col("kept_text").alias("text")), "_row").withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, one by one, whatever their ids; null and empty texts hold none, and empty items match nothing."""
    bounded_batches(spark)
    return op4_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; every row is packed, a null or empty text as its end id alone."""
    bounded_batches(spark)
    return op6_packing.pack(docs, default_path())


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Labels of a trained model, components and token ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = materialise(out)
            discard(docs)  # nothing reads what is before the table just written
        docs = out
    return docs
