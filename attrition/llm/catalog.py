"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from attrition.llm import chat, divergence, jaccard, language, licenses, line_dedup, packing, pieces, pigeonhole, quality, ranked, toxicity, vantage
from attrition.llm.common import table


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op1_embedding_near_dedup(spark, sf_dir):
    return pigeonhole.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.predict(docs, language.learn(docs))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.predict(docs, toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.predict(docs, quality.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op6_vantage_point_search(spark, sf_dir):
    return vantage.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op7_ngram_jaccard(spark, sf_dir):
    return jaccard.similar_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_sentencepiece(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents", "doc_id", "text"), pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), packing.load(public_tokenizers.path("byte_bpe_50k.json")), digest=True)


def op11_chat_format(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    case = spark.createDataFrame(chat.CASE, "conv_id long, turn long, role string, text string")
    vocabulary = packing.load(public_tokenizers.path("byte_bpe_50k.json"))
    return chat.read_back(chat.format_chat(conversations.unionByName(case), vocabulary), vocabulary)


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def queries():
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_license_scan, op3_language_id, op4_toxicity, op5_quality, op6_vantage_point_search, op7_ngram_jaccard, op8_sentencepiece, op9_line_dedup, op10_packing, op11_chat_format, op12_source_divergence, op13_ranked_search)}


def oracle_queries():
    return {"op1_embedding_near_dedup": pigeonhole.DUPLICATES_SQL, "op6_vantage_point_search": vantage.SEARCH_SQL, "op2_license_scan": licenses.SCAN_SQL, "op7_ngram_jaccard": jaccard.GROUPS_SQL, "op9_line_dedup": line_dedup.LINES_SQL, "op11_chat_format": chat.READ_BACK_SQL, "op12_source_divergence": divergence.AUDIT_SQL, "op13_ranked_search": ranked.SEARCH_SQL}
