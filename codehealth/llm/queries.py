"""The registered queries: thin wrappers that apply an operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.llm import decontamination, exact_dedup, language_id, license_scan, mixing, near_dedup, quality, suffix_dedup, token_counts, warc
from codehealth.llm.common import new_dir, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, reads them back and assembles the captures without moving payloads again."""
    path = new_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    captures = warc.transactions(warc.records(spark, path, payloads=False))
    return captures.select(
        F.element_at(F.get("metadata", F.lit(0))["fields"], "captureId").try_cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.regexp_extract("response.refers_to", r"^<urn:x-capture:(-?\d+):\d+:response>$", 1).try_cast("long").alias("refers_to"),
    )


OP1_SQL = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_classes(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("runs")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then what is left: its bytes' number, whether anything went, and the text (bytes of cut characters replaced)."""
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    left = F.octet_length("kept").cast("long")
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - left).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        left.alias("n_kept"),
        (F.col("n_bytes") > left).alias("repeats"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


#: Words as the package takes them: A-Z lowered, runs of ASCII letters, digits and non-ASCII characters.
SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP9_SQL = f"""
WITH i AS (SELECT row_number() OVER () AS i, item_id, {SQL_WORDS} AS w FROM benchmark),
     runs AS (SELECT DISTINCT i, item_id, least(5, len(w)) AS n, list_aggregate(w[k:k + least(5, len(w)) - 1], 'string_agg', ' ') AS s
              FROM (SELECT i, item_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM i WHERE len(w) > 0)),
     d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS w FROM documents),
     lengths AS (SELECT DISTINCT n FROM runs),
     have AS (SELECT DISTINCT r, doc_id, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS s
              FROM (SELECT r, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)),
     sizes AS (SELECT i, count(*) AS n_item FROM runs GROUP BY i)
SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_shared, count(*) / any_value(n_item) AS containment
FROM runs JOIN have USING (n, s) JOIN sizes USING (i) GROUP BY r, i, doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
"""

QUERIES = {
    "op1_warc": op1_warc,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_near_dedup": op8_near_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op9_decontamination": OP9_SQL}
