"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.llm import ann, bpe, exact, fuzzy_lines, html_extract, packing, simhash, suffix, toxicity, unit_dedup
from rulequarry.session import Scratch, ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), Scratch(spark, "op1"))


def op2_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_read(spark, sf_dir, "pages"))


def op3_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(_read(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_exact_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_read(spark, sf_dir, "documents"), Scratch(spark, "op5")).drop("row")


def op6_toxicity_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, "doc_id")
    held_out = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.removed_lines(_read(spark, sf_dir, "documents"), Scratch(spark, "op8"), by="ngrams")


def op9_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.removal_spans(_read(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), added=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_inverted_multi_index, op2_html_tree_model, op3_bpe_merge_replay, op4_suffix_array_dedup, op5_exact_fingerprint_dedup,
        op6_toxicity_nb_ngrams, op7_simhash_gray_index, op8_fuzzy_line_dedup, op9_line_hash_dedup, op10_hierarchical_packing,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_fingerprint_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
            FROM n""",
        "op9_line_hash_dedup": r"""
            WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
            u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s),
            p AS (SELECT doc_id, i, part, coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
                         translate(trim(regexp_replace(part, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM u),
            r AS (SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) > 1 AS gone FROM p)
            SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(sum(length(part)) FILTER (gone), 0)::BIGINT AS chars_removed,
                   coalesce(string_agg(pos || '-' || (pos + length(part)), ',' ORDER BY i) FILTER (gone), '') AS removed_spans
            FROM r GROUP BY doc_id""",
    }
