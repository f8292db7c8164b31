"""One query for each operator, over its whole table, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm import (
    decontaminate, langid, licenses, mixing, pieces, pii, quality, resampling, sharding, simhash, spelling, token_files, warc,
)

#: Shards that documents are placed on.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back through the merged capture index."""
    records, _ = warc.archive_pages(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every document in the mix of the sources by tempered weights."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and template matches of every document."""
    return licenses.scan_licenses(table(spark, folder, "documents"), ["doc_id"]).drop("places")


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token ids written, indexed and read back by key."""
    import public_tokenizers

    files = token_files.write_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"]
    )
    return token_files.read_by_key(files)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality.verdicts(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard of every document, and its shard after one shard is gone."""
    docs = table(spark, folder, "documents").select("doc_id")
    placed = sharding.place(docs, ["doc_id"], SHARDS)
    return sharding.place(placed, ["doc_id"], SHARDS[:-1], "shard_after_loss")


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, folder, "documents"), ["doc_id"]).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    return pii.personal_data(table(spark, folder, "documents"), ["doc_id"])


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, in which every 97th run is spelt wrong, with their neighbours and forms."""
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents"), every=97))


def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document, their ends in its bytes, and the text decoded from them."""
    import public_tokenizers

    found = pieces.encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.crc32(F.array_join("ends", " ")).alias("ends_crc32"),
    )


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weight of every document towards the benchmark, and the ranks of those drawn."""
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash, op2_warc, op3_mixing, op4_licenses, op5_token_files, op6_decontamination, op7_quality, op8_sharding,
        op9_language, op10_personal_data, op11_spelling, op12_pieces, op13_resampling, pipeline,
    )
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op2_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS str, least(len(w), 10) AS size
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM s),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, i, places.size, item_id FROM places JOIN s
         ON s.size = places.size AND s.str = array_to_string(w[i:i + places.size - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {PLAIN} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN again USING (doc_id, gram))
      GROUP BY 1),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS capitals
      FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
            OR word_chars > 12 * n_words OR 2 * capitals > letters OR 5 * letters < 2 * word_chars) AS kept
FROM f
""",
}
