"""One query per operator on its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm import (
    cover_tree,
    differencing_pack,
    line_neighbourhood,
    one_bit_negatives,
    partition_join,
    secret_battery,
    seed_alignment,
    spelling_variants,
    suffix_levels,
    token_cache,
    toxicity_subwords,
    url_ngrams,
    warc_revisits,
)
from recordlens.session import scratch_path

TOXIC_SCORE = 0.3
WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_battery.find_secrets(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", secret_battery.spans_text(F.col("spans")))


def op3_line_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_neighbourhood.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = warc_revisits.archive_pages(table(spark, sf_dir, "pages"))
    return headers.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def op5_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.repeat_digest(table(spark, sf_dir, "documents"))


def op6_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_subwords.train(documents, labels.where(~held_out()))
    scored = toxicity_subwords.score_texts(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def op7_url_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_ngrams.judge(pages, url_ngrams.train(url_ngrams.rule_labels(pages)))


def op8_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_digest(documents)


def pack_digest(documents: DataFrame) -> DataFrame:
    pieces = differencing_pack.tokenized(documents, public_tokenizers.path("word_bpe_49k.json"))
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = differencing_pack.packed(differencing_pack.cut(digest, "pieces"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_join.near_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = seed_alignment.benchmark_matches(documents, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op11_one_bit_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return one_bit_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


def op12_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = scratch_path(spark, "token-counts")
    counted = token_cache.token_counts(documents, public_tokenizers.path(WORD_BPE), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_groups(spelling_variants.vocabulary(table(spark, sf_dir, "documents")))


def near_sets_sql(documents: str, size: int = partition_join.SHINGLE, percent: int = partition_join.PERCENT) -> str:
    """Common table expressions that end in near_sets(doc_id, n_shingles, component_id)."""
    return f"""
        ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
        ss AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
                      range(1, greatest(len(w) - {size - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {size - 1}], ' ')))
                      END AS s FROM ws),
        texts AS (SELECT min(doc_id) AS first, list_sort(s) AS s FROM ss WHERE len(s) > 0 GROUP BY list_sort(s)),
        e AS (SELECT first, unnest(s) AS g, len(s) AS n FROM texts),
        i AS (SELECT a.first AS a, b.first AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS t
              FROM e a JOIN e b ON a.g = b.g AND a.first < b.first GROUP BY 1, 2),
        l AS (SELECT a, b FROM i WHERE 100 * c >= {percent} * (t - c)),
        both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT first AS a, first AS b FROM texts
                  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
        groups AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        near_sets AS (SELECT doc_id, len(ss.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id
                      FROM ss LEFT JOIN texts ON texts.s = list_sort(ss.s) LEFT JOIN groups ON groups.a = first)"""


ORACLES = {
    "op9_partition_join": f"WITH RECURSIVE {near_sets_sql('documents')} SELECT * FROM near_sets",
    "op1_cover_tree": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        ), g AS (
            SELECT vec_id, e FROM v
            WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b
        ), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id,
               vec_id = component_id AS kept
        FROM v JOIN c ON c.a = vec_id
    """,
    "op3_line_neighbourhood": f"""
        WITH {line_neighbourhood.oracle_sql()}
        SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256 FROM line_dedup
    """,
    "op11_one_bit_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS row_id, a.label = b.label AS same,
                   CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM r a JOIN r b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id
        ), p AS (
            SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5
        ), n AS (
            SELECT p.*, row_id AS negative_id, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id) AS place
            FROM p JOIN s USING (anchor_id)
            WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        )
        SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM n WHERE place <= 3
    """,
    "op4_warc_revisits": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest AS d, payload_bytes AS b, min(page_id) AS first FROM p
            WHERE payload_bytes >= 100 GROUP BY 1, 2
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM p LEFT JOIN f ON d = payload_digest AND b = payload_bytes
    """,
}


def registered() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    queries = {name: fn for name, fn in globals().items() if name.startswith("op") and name[2].isdigit()}
    return queries, dict(ORACLES)
