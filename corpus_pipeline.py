"""Training-data pipeline: stages that filter ``documents`` and end with token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last
return the columns of documents.  Between stages the rows are written as Parquet and
read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchgrid.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join
from merchgrid.llm.common import remainder, stored

#: Documents whose language is less certain than this are rejected, as are those without a letter.
LEAST_CERTAIN = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is uncertain."""
    model = language_id.fit(docs.where(remainder("doc_id", 4) != 2).select("text", "lang"))
    seen = language_id.identify(docs.select(F.struct("*").alias("row"), "text"), model)
    return seen.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CERTAIN)).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text left, with the digests of ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("bpe", tokenise),
]
#: The stages that learn, hash by band and align have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
