"""The training-data operators as queries on the given tables, with their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from reviewlake.llm import bins, crossing, licences, lines, media, mixing, packing, simhash, spelling, substring, token_counts, toxicity, vectors
from reviewlake.llm.common import table


def op1_media_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return media.media_features(media.store_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "n_samples", F.transform("keyframes", lambda k: F.concat_ws("+", k["start"], k["size"])).alias("keyframe_ranges"))


def op2_token_counts(spark, sf_dir):
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("model", F.lit("unigram over the pieces of piece_bpe_32k, log probability -ln(rank + 1)"))


def op3_substring_dedup(spark, sf_dir):
    cut = substring.drop_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_license_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))


def op5_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", F.col("name").alias("source"), "epoch", "block", "block_order", "doc_order")


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark, sf_dir):
    return vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, machine)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op9_line_dedup(spark, sf_dir):
    return lines.drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_packing(spark, sf_dir):
    path = public_tokenizers.path
    return packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op11_best_fit_packing(spark, sf_dir):
    path = public_tokenizers.path
    return bins.pack_best_fit(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer(spark, sf_dir):
    path = public_tokenizers.path
    return crossing.align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_token_counts, op3_substring_dedup, op4_license_scans, op5_mixing, op6_simhash, op7_embedding_dedup, op8_toxicity, op9_line_dedup, op10_packing, op11_best_fit_packing, op12_spelling_variants, op13_cross_tokenizer, pipeline)}

SQL = {
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts),
        firsts AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
        hits AS (SELECT DISTINCT doc_id, i FROM windows JOIN firsts USING (k) WHERE m < doc_id),
        covered AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i, unnest(range(13)) AS o FROM hits)),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents),
        k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        common AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        judged AS (SELECT doc_id, line, p, keeper IS NULL OR keeper = doc_id AS stays FROM k LEFT JOIN common USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE stays), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
}
