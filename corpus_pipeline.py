"""A corpus pipeline over ``documents``: language, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each stage's
rows as Parquet and reads them again as the next stage's documents. All but the last return the
columns of ``documents``; the last returns pieces with their places in sequences.

The stages handle nulls, empty texts, repeated rows and empty tables as their operators say;
columns of other names pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import exact_dedup, jaccard_join, langid, packing, pii
from trailspark.llm.queries import tokenizer_file
from trailspark.runtime import materialize


#: Bytes of an Arrow batch: ten thousand rows of whole texts, Spark's default, take ten times as much in both processes.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of bounded size, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; the model rejects few that it knows."""
    _small_batches(spark)
    score = langid.scorer(langid.train(docs))
    return docs.where(score(F.col("text"))["accepted"])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text, the one with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, one with the smallest id; documents without words stay.

    Rows are told apart by id and text, so unlike documents that share an id are judged each for itself.
    """
    return jaccard_join.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed personal data masked and n_chars as it then is."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    _small_batches(spark)
    pieces = packing.tokenize_pieces(docs, tokenizer_file("word_bpe_49k.json"))
    told = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(told).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Language identification and packing are models and searches that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
