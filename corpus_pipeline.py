"""The corpus pipeline: quality, near duplicates, secrets, mixture, tokens.

Every stage works on all that its predecessor kept. The first four return the columns of ``documents``,
the last one a row of tokens for each text of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm.bpe import encode_texts, read_vocabulary
from tokenloom.llm.components import checkpointed
from tokenloom.llm.line_crf import fit_field, keep_good
from tokenloom.llm.mixture import mixed_rows
from tokenloom.llm.ngram_join import one_of_each
from tokenloom.llm.queries import vocabulary_path
from tokenloom.llm.secret_links import redact_secrets


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject. It learns from the given documents and the labels."""
    return keep_good(docs, fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark. n_chars stays what it was in the source."""
    return redact_secrets(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time that the mix takes a document; the last one of a source may be cut."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, n_tokens, ids_sha256, decoded_sha256, ids of every text of the mix."""
    return encode_texts(docs, read_vocabulary(vocabulary_path()), with_decoded=False)


STAGES = [("quality", good_documents), ("near_duplicates", without_near_copies), ("secrets", without_secrets),
          ("mixture", mixed_sources), ("tokens", tokens)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
