"""A training-data pipeline of five corpus operators: every stage's table is written and read again by the next.

toxicity: documents that the weakly supervised classifier rejects go. exact_dedup: of equal texts the smallest doc_id
stays. ngram_join: of each component of near duplicates the smallest doc_id stays. decontamination: documents that hold
a benchmark passage go. packing: what is left is packed into windows; its rows are the result.

Rows are told by their id and text together wherever one goes. Defined results: null texts are empty; of the empty texts
one stays, under the smallest id; rows with a null doc_id are judged like others, but near copies and benchmark passages
among them stay, since nothing can name them; repeated rows are one; rows that share a doc_id with different texts are
documents of their own; other columns stay until packing, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import remove, shared_folder, table
from lodestrata.llm.decontaminate import drop_contaminated
from lodestrata.llm.exact_dedup import drop_exact_copies
from lodestrata.llm.ngram_join import keep_one_of_each
from lodestrata.llm.packing import pack_documents
from lodestrata.llm.toxicity import fit_toxicity, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the classifier or the tokenizer; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if done:  # its successor is written: nothing reads it any more
            remove(spark, done)
        docs, done = spark.read.parquet(path), path
    return docs
