"""The corpus queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import durable, fold, remove, shared_folder, table
from .decontaminate import contaminated
from .exact_dedup import exact_groups
from .lm_scores import score_documents
from .ngram_join import near_duplicate_components
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .sentence_spans import remove_repeats
from .token_counts import count_tokens
from .token_files import read_tokens, write_tokens
from .toxicity import fit_toxicity, score_toxicity


def _scored(scores: DataFrame, folds: int, held: int) -> DataFrame:
    return scores.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))), 3, 1)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, each with the items whose passages it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    digests = durable(read_tokens(spark, folder, with_ids=False))
    remove(spark, folder)
    return digests


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))), 5, 0)


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lost sentences, with what is left of their texts as digests."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).where("n_removed > 0")
    return cut.select("doc_id", "n_sentences", "n_removed", F.length("text").alias("n_chars_left"), F.sha2("text", 256).alias("left_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_ngram_join, op3_stupid_backoff, op4_spaced_seeds, op5_content_sort, op6_packing, op7_token_files, op8_toxicity, op9_sentence_spans, op10_token_counts)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL = {
    "op2_ngram_join": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
        n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
        e AS (SELECT doc_id, unnest(g) AS g FROM s),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link)
        SELECT * FROM (WITH RECURSIVE t(d, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT edge.b, t.c FROM t JOIN edge ON edge.a = t.d)
        SELECT n.doc_id, n.n AS n_shingles, min(t.c) AS component_id FROM n JOIN t ON t.d = n.doc_id GROUP BY n.doc_id, n.n)
    """,
    "op5_content_sort": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)
    """,
}
