"""The corpus pipeline: documents in, deduplicated, mixed and encoded documents out.

Stages, each a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the docs of the next one:

1. quality        rows that break a threshold go
2. exact          of texts equal but for A-Z case, the largest doc_id stays
3. near           five-word shingles, similarity 0.8: one document of each component stays
4. mix            slot and position of each row in the order that interleaves sources by their
                  target weights; columns, since Parquet doesn't keep the order of rows
5. encode         SentencePiece ids of every whole text, which decode to it exactly, beside slot and position
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markloom.llm import exact, hyperminhash, mixing, pieces, quality
from markloom.llm._io import materialise, table
from markloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.drop_near_copies(docs, shingle=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, placed=True)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True, keep=("lang", "source", "slot", "position"))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: SQL can't express components of near copies or the Viterbi path; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
