"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return
the columns of documents.  The near-duplicate stage takes five-word shingles and a similarity of 0.8.

- language: documents without an identifiable language (null text, no letter, or letters that are too unlike all learned languages) go; all others stay.
- lines: later occurrences of windows of three consecutive lines are removed from the texts.
- near_duplicates: of each group of near-duplicates the document with the smallest doc_id stays.
- decontaminate: passages that occur in the benchmark are removed; a document of which nothing is left goes.
- tokens: ids of each text by byte-level BPE, and a decoding of them.

Null and empty texts go at the first stage; a text that becomes empty later stays until decontamination.  Repeated rows (equal doc_id and text) don't
remove each other's lines, and one of them is kept as a near-duplicate.  Ties go to the smaller doc_id.  An empty table gives an empty
result, as does one without any labelled document.  Extra columns, of any name, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectorvote.llm import bpe, decontaminate, lang_id, line_dedup, near_dedup
from vectorvote.llm.shared import kept


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs, words=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, keep_ids=True)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", benchmark_passages),
    ("tokens", tokens),
]

#: The language stage fits a classifier, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept(docs, f"stage-{k}-{name}")
    return docs
