"""The registered queries of this subpackage, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (
    byte_bpe,
    license_scan,
    line_dedup,
    mixing,
    packing,
    periodic_runs,
    quality_rules,
    sharding,
    simhash_dedup,
    source_divergence,
    substring_dedup,
    topk_search,
    toxicity,
)
from palimpsest.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanner = license_scan.trained(spark, table(spark, sf_dir, "benchmark"))
    return license_scan.scan(table(spark, sf_dir, "documents"), scanner)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op3_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, F.col("vec_id") % 20 == 0)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without the line runs that stand earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_runs(docs)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, a tenth of them with a repetition planted by the rule of ``looped``."""
    return periodic_runs.detected(table(spark, sf_dir, "documents"), plant=True)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_sharding,
        op3_exact_top_k_search,
        op4_simhash_near_dedup,
        op5_substring_dedup,
        op6_toxicity,
        op7_best_fit_packing,
        op8_quality_rules,
        op9_line_dedup,
        op10_mixing,
        op11_source_divergence,
        op12_periodic_runs,
        op13_byte_bpe,
    )
}
SQL: dict[str, str] = {
    "op3_exact_top_k_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), o AS (
            SELECT doc, lang, source, unnest(terms) AS term FROM d
        ), k AS (
            SELECT lang, term, count(*)::HUGEINT AS c FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
        ), l AS (
            SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), c AS (
            SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS c FROM o JOIN k USING (lang, term) GROUP BY ALL
        ), n AS (
            SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
        ), p AS (
            SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c,
                   1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (n.n + l.v) AS p,
                   1 + (1000000000 * (k.c + 1)) // (l.n + l.v) AS q
            FROM n JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term
        ), s AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q
        )
        SELECT lang, source, part, item, value::BIGINT AS value,
               row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 200
    """,
}
