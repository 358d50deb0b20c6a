"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
A stage works on all that the one before it has kept; other columns of docs go along untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from basalt.llm import langid
from basalt.llm.common import remove, shared_dir
from basalt.llm.exact_dedup import distinct_texts
from basalt.llm.mixing import mix
from basalt.llm.packing import pack
from basalt.llm.simhash import representatives

#: Words that a worker remembers in a stage: fewer than the operators' queries do, as workers share an executor with what earlier stages have left in the JVM.
CACHE_WORDS = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: null and empty texts and others without a letter, and those that no learned language explains. What is learned from
    are all labelled documents of the input; without any, every text with a letter stays. Rows that repeat an id or a text are judged each."""
    model = langid.train(docs)
    return langid.identify(docs, model, carry=docs.columns, prefix="langid_", cache_words=CACHE_WORDS).filter("NOT langid_rejected").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of documents with equal texts, the one with the largest id. Null and empty texts are equal; of rows that repeat id and text one stays; null ids sort below others."""
    return distinct_texts(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of documents that are near copies (five-word shingles, similarity of 0.8 or more) or chained together by such, the one with the smallest id; a null id only where no other is there.

    Texts without words are alike; rows that repeat an id are documents of their own.
    """
    return representatives(docs, shingle=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take from each source what its target says, whole passes repeated, in training order. A null source is a source of its own; documents without words are in no
    stream; ties in position go by a hash of id and text, rows that repeat both being alike."""
    return mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens: a row for each piece. Null and empty texts are their end token; rows that repeat an id are packed each."""
    return pack(docs, cache_words=CACHE_WORDS)


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixing), ("packing", packing)]

#: Language models, SimHash components and packing have no SQL: the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has read is deleted once it has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out, here = stage(spark, docs, sf_dir), f"{folder}/{k}-{name}"
        out.write.parquet(here)
        docs = spark.read.schema(out.schema).parquet(here)
        if before is not None:
            remove(spark, before)
        before = here
    return docs
