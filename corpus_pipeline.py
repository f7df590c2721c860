"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's documents. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, exact_dedup, simhash, toxicity
from millrace.llm.common import cut, read_table, shared_path


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number of its own for each row: that of its file, and its place in the file.

    Both are stored, so the number is the same however often ``docs`` is read.
    What is not read straight from files is written first.
    """
    if not docs._jdf.queryExecution().analyzed().children().isEmpty() or not docs.inputFiles():
        docs = cut(docs, "rows")
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    files = sorted(r[0] for r in placed.select("_file").distinct().collect())
    numbers = spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_file string, _number long")
    # bounded by the number of files
    return placed.join(F.broadcast(numbers), "_file").select(*docs.columns, (F.col("_number") * (1 << 40) + F.col("_place")).alias("_row"))


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose _row is in ``kept``, without it."""
    return docs.join(kept.select("_row"), "_row", "left_semi").drop("_row")


def _by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with _row for doc_id, for operators whose verdict on a row lies in its text."""
    return docs.select(F.col("_row").alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    rows = _numbered(spark, docs)
    return _keep(rows, cut(toxicity.score(_by_row(rows), model), "toxicity").where("predicted = 0").withColumnRenamed("doc_id", "_row"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex}")
    rows = _numbered(spark, docs)
    return _keep(rows, index.add(rows, "_row").where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, docs)
    return _keep(rows, simhash.near_dups(rows, row="_row").where("kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, docs)
    found = decontam.search(decontam.store_index(_by_row(rows)), read_table(spark, sf_dir, "benchmark"))
    return _keep(rows, found.where("n_hit = 0").withColumnRenamed("doc_id", "_row"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN).drop("decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: SQL has neither the classifier nor XXH64 nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
