"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedmine.llm import bpe, digest, fill_middle, packing, quality, secret_scan, sharding, simhash, substring_dedup, token_counts, token_file, warc, word_runs
from feedmine.llm.common import shared_folder

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents, by source and in all."""
    lengths = token_counts.token_lengths(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), keep=("source",))
    return token_counts.length_histogram(lengths, "source")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_with_edit(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = public_tokenizers.path(BYTE_BPE), shared_folder(spark, "token-files")
    vocabulary = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    token_file.write_token_files(_table(spark, sf_dir, "documents"), folder, path, end_id=0, vocabulary=vocabulary)
    return token_file.token_file_index(spark, folder)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train_rules(docs, _table(spark, sf_dir, "labels")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), "word", end_id=1, capacity=4096)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _tails_repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in the tenth of the documents that the CRC-32 of the id chooses, the words from a place on
    repeat with a period, both from the same number."""
    h = "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary))"
    first, period = "(g % size(words))", "(1 + (size(words) - a) div (3 + g % 8))"
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text", f"{h} % 10 = 0 AS chosen", f"{h} div 10 AS g")
    # Only the chosen texts are split; the others pass as they are.
    rows = rows.selectExpr("doc_id", "text", "g", r"CASE WHEN chosen THEN filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '') END AS words")
    rows = rows.selectExpr("doc_id", "text", "g", "words", f"CASE WHEN size(words) > 0 THEN {first} END AS a")
    rows = rows.selectExpr("doc_id", "text", "words", "a", f"{period} AS p")
    return rows.selectExpr("doc_id", """CASE WHEN a IS NULL THEN text ELSE array_join(transform(sequence(0L, size(words) - 1L),
        i -> words[cast(if(i < a, i, a + (i - a) % p) AS int)]), ' ') END AS text""")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_runs.word_runs(_tails_repeated(_table(spark, sf_dir, "documents")))
    rows = rows.withColumn("best", F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS s, -r.period AS q)))"))
    listing = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return rows.selectExpr("doc_id", "cast(size(runs) AS long) AS n_runs", "-best.s AS start", "best.length AS length", "-best.q AS period",
                           "1000 * best.length div -best.q AS exponent_milli", f"sha2({listing}, 256) AS runs_sha256",
                           "sha2(collapsed, 256) AS collapsed_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_fingerprints, op4_bpe, op5_token_file,
                                   op6_quality_rules, op7_secret_scan, op8_simhash, op9_packing, op10_warc, op11_word_runs, op12_fill_in_middle, op13_substring_dedup)}

ORACLE = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
                     row_number() OVER (PARTITION BY html ORDER BY page_id) AS nth,
                     min(page_id) OVER (PARTITION BY html) AS least
              FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND nth > 1 THEN least END AS refers_to
        FROM d""",
    "op12_fill_in_middle": """
        WITH u AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                          regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
                   FROM documents),
        k AS (SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                     CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
              FROM u),
        c AS (SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                          THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
              FROM k),
        p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS p,
                     coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:n], ''), '') AS s
              FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
    "op13_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM d),
        w AS (SELECT doc_id, i, words[i] AS word,
                     CASE WHEN i + 19 <= len(words) THEN array_to_string(words[i:i + 19], ' ') END AS win FROM s),
        e AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM w),
        c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
              FROM e),
        k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                     coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
              FROM c GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
}
