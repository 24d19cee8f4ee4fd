"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from arpent.llm import filter_audit, url_reputation
from arpent.llm.common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_byte_bpe(spark, sf_dir):
    from arpent.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op6_quartile_digest(spark, sf_dir):
    from arpent.llm import quartile_digest

    return quartile_digest.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op8_sum_of_squares(spark, sf_dir):
    from arpent.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_warc(spark, sf_dir):
    from arpent.llm import warc
    from arpent.llm.common import scratch

    return warc.write_and_read(table(spark, sf_dir, "pages"), scratch(spark, "warc"))


ORACLE["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
r AS (SELECT payload_digest, max(page_id) AS response_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest,
  CASE WHEN p.page_id < response_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < response_id THEN response_id END AS refers_to
FROM p LEFT JOIN r ON p.payload_digest = r.payload_digest AND payload_bytes >= 1000
"""


@query
def op3_url_reputation(spark, sf_dir):
    from arpent.llm import filter_audit, url_reputation

    return url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


ORACLE["op3_url_reputation"] = url_reputation.oracle()


@query
def op4_pseudonyms(spark, sf_dir):
    from arpent.llm import pseudonyms

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymized(docs, spark.conf.get(pseudonyms.KEY_SETTING, pseudonyms.KEY), replaced="n_replaced")


@query
def op10_embedding_dedup(spark, sf_dir):
    from arpent.llm import embedding_dedup

    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_ngram_jaccard(spark, sf_dir):
    from arpent.llm import ngram_jaccard

    return ngram_jaccard.linked(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F

    from arpent.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.train(docs, labels, fold != 1)
    return toxicity.scored(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


@query
def op1_pitman_yor(spark, sf_dir):
    from arpent.llm import pitman_yor

    return pitman_yor.scored(table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark, sf_dir):
    from arpent.llm import periodic_runs

    return periodic_runs.summarized(periodic_runs.with_planted(table(spark, sf_dir, "documents")))


@query
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = filter_audit.oracle()


@query
def op13_token_counts(spark, sf_dir):
    """Each call starts from an empty cache, unless the session names one to keep."""
    from arpent.llm import token_counts

    cache = spark.conf.get(token_counts.CACHE_SETTING, None)
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
