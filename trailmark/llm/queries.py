"""The queries that apply the operators to their tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontaminate, langid, mixing, pii, quality, sharding, simhash, substring_dedup, training_order, warc
from trailmark.llm.scratch import Scratch

#: Production parameters of the placement query.
SHARDS, TABLE_SIZE = [f"shard-{k:02d}" for k in range(32)], 8191


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.read_captures(spark, path)
    sha = F.coalesce(F.sha2("payload", 256), F.col("digest"))
    return captures.select(F.col("page").alias("page_id"), "payload_bytes", sha.alias("payload_digest"), "record_type", F.col("refers").alias("refers_to"), "status")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)
    return out.withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [pii.count_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(pii.BASE)]
    every = F.array_sort(F.concat("base", "added"))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_quality(table(spark, sf_dir, "documents")).select("doc_id", "quality_verdict.*")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training_order.training_order(table(spark, sf_dir, "documents"))
    return out.select("slot", "shard", F.col("id").alias("doc_id"), "seq_no", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate.with_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = F.col("benchmark_matches")
    return docs.select(
        "doc_id", found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"), F.size(found["items"]).cast("long").alias("n_items"),
        decontaminate.items_digest(found["items"]).alias("items_sha256"), (found["n_hit"] > 0).alias("contaminated"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS, TABLE_SIZE)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rates.withColumnRenamed("row_id", "doc_id").drop("text_hash")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labelled = docs.where(~held_out)
    out = langid.with_language(docs.select("doc_id", "text"), labelled)
    return out.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))




QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_substring_dedup, op3_simhash, op4_pii, op5_quality, op6_training_order, op7_decontaminate, op8_sharding, op9_mixing, op10_language_id)
}

SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to, 'ok' AS status
FROM f""",
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
firsts AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
gone AS (
  SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 13)) AS k
  FROM win JOIN firsts ON win.h = firsts.h AND firsts.d < win.doc_id),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(words) AS n, coalesce(len(ks), 0) AS r,
         CASE WHEN ks IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(ks, k)) END AS left_words
  FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(left_words, ' '), '')) AS kept_sha256
FROM kept""",
    "op7_decontaminate": r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM benchmark),
iwin AS (
  SELECT item, n, array_to_string(words[i:i + n - 1], ' ') AS s
  FROM (SELECT item, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM iwin),
dwin AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, sizes WHERE len(words) >= n)),
hits AS (SELECT DISTINCT doc_id, d.n, i, item FROM dwin d JOIN iwin USING (n, s)),
per_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
per_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN per_words USING (doc_id) LEFT JOIN per_items USING (doc_id)""",
    # the table is filled by turns: one step of the recursion for each claim
    "op8_sharding": """
WITH RECURSIVE n AS (SELECT CAST(k AS INTEGER) AS k, 'shard-' || lpad(CAST(k AS VARCHAR), 2, '0') AS name FROM range(0, 32) t(k)),
p AS (SELECT k, name, CAST('0x' || substr(md5(name || '/offset'), 1, 15) AS BIGINT) % 8191 AS first, CAST('0x' || substr(md5(name || '/skip'), 1, 15) AS BIGINT) % 8190 + 1 AS skip FROM n),
fill(step, owner, slot) AS (
  SELECT -1, list_transform(range(0, 8191), lambda x: CAST(-1 AS INTEGER)), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT step + 1, list_concat(list_concat(owner[1:s], [CAST((step + 1) % 32 AS INTEGER)]), owner[s + 2:8191]), s
  FROM (SELECT step, owner, list_filter(list_transform(range(0, 8191), lambda j: (first + j * skip) % 8191), lambda q: owner[q + 1] < 0)[1] AS s
        FROM fill JOIN p ON p.k = (step + 1) % 32 WHERE step < 8190)),
lookup AS (SELECT slot, name FROM fill JOIN n ON n.k = step % 32 WHERE step >= 0)
SELECT doc_id, slot, name AS shard FROM (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % 8191 AS slot FROM documents) JOIN lookup USING (slot)""",
}
