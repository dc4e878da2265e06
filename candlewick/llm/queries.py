"""Registered queries of the document operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import (
    embeddings, exact, langid, mixing, packing, pages, quality, search, sharding, simhash, spelling, substring, toxicity,
)
from candlewick.llm.common import read_table


def remainder(divisor: int):
    """crc32 of the doc_id as text, by a divisor; null ids have none."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").filter(remainder(3) != 1))
    return toxicity.tag(docs, model).select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(True)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "spans")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify_documents(docs, remainder(5) != 0)
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.cut_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "removed")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from labelled rows whose crc32 leaves 0, 2 or 3 by 4; kept is what the pipeline keeps."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs.filter(F.coalesce(remainder(4) != 1, F.lit(False))), read_table(spark, sf_dir, "labels"))
    return docs.select("doc_id", F.coalesce(remainder(4) == 1, F.lit(True)).alias("held_out"), quality.score(docs, model).alias("s")).select(
        "doc_id", "held_out", "s.*", (F.col("s.score") >= quality.REJECT_BELOW).alias("kept"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "weight", "block", "block_order")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(exact.normalised("text"), 256)
    return exact.exact_groups(read_table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = {"text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")))}
    placed = sharding.shard_rows(read_table(spark, sf_dir, "documents"), carry=crc)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_language_id, op3_embedding_near_dedup, op4_simhash_near_dedup, op5_html_extraction, op6_substring_dedup, op7_quality_classifier, op8_temperature_mixing, op9_exact_dedup, op10_best_fit_packing,
                              op11_spelling_variants, op12_ranked_search, op13_sharding)
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS chars,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
        FROM n WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id)""",
    "op12_ranked_search": r"""
        WITH q AS (SELECT DISTINCT item_id, text FROM benchmark),
        qt AS (SELECT item_id, t, count(*) AS often FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM q) GROUP BY ALL),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        c AS (SELECT count(*) AS nn, sum(len(ts)) AS ll FROM d WHERE len(ts) > 0),
        p AS (SELECT r, doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
        w AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t),
        s AS (SELECT qt.item_id, p.r, p.doc_id, sum(often * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
              FROM qt JOIN p USING (t) JOIN w USING (t), c GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 20""",
}
