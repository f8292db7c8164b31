"""Pipeline over documents: language, near copies, benchmark passages, mix of sources, token files.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept. All but the last return the
columns of ``docs``; the mix shows in the order of the rows: stage results are written as Parquet, whose files
by name and rows by number keep it, and the last stage writes token ids in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm import decontaminate, langid, mixing, simhash, token_files
from hearthline.llm.files import free_name, saved


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with a rejected or undetermined language go, null and empty texts among them; repeated rows go or
    stay together."""
    return langid.keep_known(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near copies the document with the smallest id stays; unlike rows with null or equal ids all stay."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents in which a benchmark window occurs go; documents without words stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: all documents, their rows in the order of the mix; null sources are a stream of their own."""
    return mixing.ordered_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: ids of all documents in the order of the rows; (doc_id, start, n_tokens, ids_crc32).

    The order is that of the files by their part number and of the rows in them. Null ids and texts and repeated rows are written.
    """
    import public_tokenizers

    part, file, row = (free_name(docs, n) for n in ("part", "file", "row"))
    if docs.inputFiles():
        name = F.col("_metadata.file_name")
        number = F.regexp_extract(name, "^part-([0-9]+)", 1).try_cast("long")  # beyond 99,999 names don't sort by number
        laid = docs.select("*", number.alias(part), name.alias(file), F.col("_metadata.row_index").alias(row))
    else:  # rows that come from no file have no other order than their id
        laid = docs.select("*", F.lit(0).alias(part), F.lit("").alias(file), F.col("doc_id").alias(row))
    return token_files.read_back(token_files.write_tokens(laid, public_tokenizers.path("word_bpe_49k.json"), [part, file, row]))


STAGES = [
    ("language", known_languages),
    ("near_copies", without_copies),
    ("benchmark", without_benchmark),
    ("mix", mixed),
    ("tokens", token_output),
]

#: Language models and the tokenizer are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
