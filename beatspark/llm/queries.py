"""The operators' queries: `QUERIES` (name -> callable) and `ORACLES` (name -> DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, hard_negatives, license_scan, mixing, ngram_lm, packing, pu_quality, quality_rules, simhash, substring_dedup, warc, whitening
from .common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "web-1")
    base = quality_rules.policy_mask("base-1")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept",
        "failed_bits",
    )


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.transform("phrases", lambda s: s["first"])
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc.doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.reassemble(warc.read(spark, warc.archive(table(spark, sf_dir, "pages"), min_revisit=0)))
    broken = F.raise_error(F.concat(F.lit("a record is not whole, page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without id"))))
    digest = F.when(F.col("whole"), F.col("payload_digest")).otherwise(broken.cast("string"))
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


@query
def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), repetitions=4.0)
    return mixed.select("doc.doc_id", "doc.source", F.col("tokens").alias("n_tokens"), "weight", "exponent", "epochs", "copies", "epoch", "block", "place")


@query
def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    seen = pu_quality.fold(F.col("doc_id")) != 2
    model = pu_quality.train(docs, labels.where(seen & (F.col("quality") == 1)), docs.where(seen))
    held_out = F.coalesce(pu_quality.fold(F.col("id")) == 2, F.lit(False)).alias("held_out")
    return pu_quality.score(docs, model).select(
        F.col("id").alias("doc_id"), held_out, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


@query
def op4_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = ann.search(ann.index(vectors, k=10, recall=0.97), vectors.where("vec_id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.cut(substring_dedup.marked(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400))
    return found.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"))


@query
def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(ngram_lm.fold(F.col("doc_id")) == 2, F.lit(False))
    scored = ngram_lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    found = exact_dedup.add(index, table(spark, sf_dir, "documents"), "documents")
    index.drop()
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    made = whitening.fit(vectors)
    if made is None:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return whitening.components(vectors, made).withColumnRenamed("id", "vec_id")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
 list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 10 * (k // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

ORACLES["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""

ORACLES["op11_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op9_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 g AS (SELECT id, i, count(*) OVER (PARTITION BY id, w[i:i + 4]) AS c FROM (SELECT id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
 r AS (SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest(generate_series(i, i + 4)) AS k FROM g WHERE c > 1) GROUP BY id),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_alpha_words,
  len(list_filter(w, lambda x: regexp_matches(x, '^\PL*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*$'))) AS n_caps_words, len(list_distinct(w)) AS n_distinct_words, len(list_filter(w, lambda x: x = '|')) AS n_pipe_words FROM w LEFT JOIN r ON w.id = r.id),
 b AS (SELECT *, @BITS@ AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & @BASE@ <> 0 AS base_failed, failed_bits & @POLICY@ = 0 AS kept, failed_bits FROM b
""".replace("@BITS@", " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit}::BIGINT ELSE 0 END" for r in quality_rules.RULES)).replace("@BASE@", str(quality_rules.policy_mask("base-1"))).replace("@POLICY@", str(quality_rules.policy_mask("web-1")))
