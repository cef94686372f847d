"""Five stages from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyscape.llm import decontamination, mixing, ngram_join, quality_crf, queries, token_files


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, learnt from the labels, scores below a half
    go."""
    queries.prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_crf.good_documents(docs, queries.quality_model(docs, labels))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-copies connect, the one of the smallest doc_id stays."""
    queries.prepare(spark)
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten benchmark words go."""
    queries.prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs, benchmark)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files whose order interleaves the sources at weights of the
    square root of their rows."""
    queries.prepare(spark)
    return mixing.mixed(docs, mixing.tempered_weights(docs))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix, which is that of the input's files and
    rows, and what reading them gives: doc_id, start, n_tokens, ids_crc32."""
    queries.prepare(spark)
    path = token_files.new_path(spark, "pipeline-tokens")
    placed = docs.select("doc_id", "text", "_metadata.file_path", "_metadata.row_index")
    token_files.write_token_files(
        placed, path, queries.tokenizer("word_bpe_49k.json"), queries.END_ID,
        order=["file_path", "row_index"], folds=True)
    return token_files.read_token_files(spark, path)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = token_files.new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the schedule and the tokens can't be stated in SQL; a test holds
#: run() to a brute force.
ORACLE_SQL = None
