"""License scans as an exact set-similarity join, in DataFrame functions only.

Every text is a row of overlapping blocks of ``BLOCK`` words, ``STRIDE`` words
apart (both grow with a caller's longest template, so that a copy always lies whole
in some block). A block matches a template when it holds at least ``threshold`` of
the template's distinct words, the deciding ones (``DECIDING``) all among them: a
short notice without its name says nothing. The templates' words are ordered by how many
documents hold them (rarest first, counted over the whole table); a block is a
candidate for a template only if it holds a word of the template's prefix in
that order (prefix filter), has enough template words at all (length filter),
and could still reach the threshold from the places of the shared word in both
sequences (positional filter). Candidates are verified exactly.

What is broadcast has one row per template word, which the fixed templates
bound. Defined results: null and empty texts have no words, labels '' and score
0; repeated rows are scanned each; null doc_ids are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, STRIDE = 96, 48

# Phrases and their labels; short public license notices and the labels they add.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-terms": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit-notice": "released under the mit license",
    "mit-terms": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "rights-reserved": "all rights reserved",
}
DECIDING = {
    "apache-notice": "apache",
    "bsd-terms": "redistribution source binary",
    "cc-by-nc-notice": "cc by nc",
    "cc-by-notice": "creative commons attribution",
    "gpl-notice": "gnu general public",
    "gpl-terms": "gnu general public",
    "mit-notice": "mit",
    "mit-terms": "permission free charge",
    "mpl-notice": "mozilla",
    "rights-reserved": "all rights reserved",
}


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of digits, ASCII letters and all non-ASCII characters.
    ``lower`` also touches other letters, which no phrase or template holds; the two
    that it would turn into ASCII letters are replaced first."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.array_remove(F.split(F.lower(plain), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _places(w: Column, phrase: str) -> Column:
    """Starts of a phrase among the words."""
    parts = phrase.split()

    def at(x: Column, i: Column) -> Column:
        same = x == parts[0]
        for k, p in enumerate(parts[1:], 1):
            same = same & (F.get(w, i + k) == p)
        return F.when(same, i)

    found = F.filter(F.transform(w, at), lambda i: i.isNotNull())
    rare = F.array_contains(w, parts[0]) & F.array_contains(w, parts[-1])
    return F.when(rare, found).otherwise(F.array().cast("array<int>"))


def _parsed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row_key"), words(F.col("text")).alias("words"))


def base_scan(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_words, places and labels of the phrases."""
    w = F.col("words")
    found = _parsed(docs).select("doc_id", "row_key", F.size(w).alias("n_words"), *(_places(w, p).alias(v) for p, v in PHRASES.items()))
    places = F.concat(*(F.col(f"`{v}`") for v in PHRASES.values()))
    labels = F.array_compact(F.array(*(F.when(F.size(f"`{v}`") > 0, F.lit(v)) for v in PHRASES.values())))
    return found.select("doc_id", "row_key", F.col("n_words").cast("long"), places.alias("places"), labels.alias("base"))


def token_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words, rarest first by documents of the table that hold them."""
    vocabulary = sorted({t for text in templates.values() for t in text.split()})
    held = _parsed(docs).select(F.explode(F.array_intersect("words", F.lit(vocabulary))).alias("token"))
    counts = {r.token: r["count"] for r in held.groupBy("token").count().collect()}  # at most a row per template word
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def template_matches(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, row_key, block, label, containment: every block that meets the threshold."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    order = token_order(docs, templates)
    rank = {t: i for i, t in enumerate(order)}
    sets = {name: sorted(set(text.split()), key=rank.get) for name, text in templates.items()}
    need = {name: math.ceil(threshold * len(s) - 1e-9) for name, s in sets.items()}
    prefix_rows = [(t, name, p, len(s), need[name]) for name, s in sets.items() for p, t in enumerate(s[: len(s) - need[name] + 1])]
    prefix = spark.createDataFrame(prefix_rows, "token string, label string, place int, size int, need int")
    deciding = {name: sorted(set(DECIDING.get(name, "").split()) & set(s)) for name, s in sets.items()}
    whole = spark.createDataFrame([(name, s, deciding[name]) for name, s in sets.items()], "label string, tokens_of_template array<string>, deciding array<string>")
    stride = max([STRIDE, *(len(text.split()) for text in templates.values())])
    length = max(BLOCK, 2 * stride)
    starters = F.lit(sorted({r[0] for r in prefix_rows}))

    w = F.col("words")
    hits = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(starters, x), i)), lambda i: i.isNotNull())
    blocks = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array((i / stride).cast("int"), F.greatest((i / stride).cast("int") - 1, F.lit(0))))))
    tokens = F.transform(blocks, lambda b: F.struct(b.alias("block"), F.array_intersect(F.lit(order), F.slice(w, b * stride + 1, length)).alias("tokens")))
    found = _parsed(docs).where(F.arrays_overlap(w, starters)).select("doc_id", "row_key", F.explode(tokens).alias("b")).select("doc_id", "row_key", "b.*")
    probe = found.select("*", F.posexplode("tokens").alias("at", "token")).join(F.broadcast(prefix), "token")
    long_enough = F.size("tokens") >= F.col("need")
    reachable = F.least(F.col("size") - F.col("place"), F.size("tokens") - F.col("at")) + F.least("place", "at") >= F.col("need")
    candidates = probe.where(long_enough & reachable).select("doc_id", "row_key", "block", "tokens", "label", "size", "need").distinct()
    shared = F.size(F.array_intersect("tokens", "tokens_of_template"))
    verified = candidates.join(F.broadcast(whole), "label").where((shared >= F.col("need")) & (F.size(F.array_except("deciding", "tokens")) == 0))
    return verified.select("doc_id", "row_key", "block", "label", (shared / F.col("size")).alias("containment"))


def scan(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = docs.select("doc_id", "text")
    best = template_matches(docs, threshold).groupBy("doc_id", "row_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    best = best.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), "more", "best")
    out = base_scan(docs).join(best, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_key") == F.col("_key")), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    templates = ", ".join(f"('{n}', {quoted(sorted(set(t.split())))}, {quoted(DECIDING.get(n, '').split())}::VARCHAR[])" for n, t in TEMPLATES.items())
    phrases = ", ".join(f"('{v}', {quoted(p.split())})" for p, v in PHRASES.items())
    return rf"""
WITH parsed AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
phrases(label, p) AS (VALUES {phrases}),
places AS (SELECT r, label, i FROM (SELECT r, w, unnest(range(len(w))) AS i FROM parsed), phrases WHERE w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY r),
templates(label, t, deciding) AS (VALUES {templates}),
blocks AS (SELECT r, w[b * {STRIDE} + 1 : b * {STRIDE} + {BLOCK}] AS block FROM (SELECT r, w, unnest(range((len(w) + {STRIDE - 1}) // {STRIDE})) AS b FROM parsed)),
matched AS (SELECT r, label, max(len(list_intersect(t, block)) / len(t)) AS best FROM blocks, templates
            WHERE len(list_intersect(t, block)) >= ceil(0.8 * len(t) - 1e-9) AND list_has_all(block, deciding) GROUP BY r, label),
method AS (SELECT r, list(label) AS more, max(best) AS best FROM matched GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM parsed LEFT JOIN base USING (r) LEFT JOIN method USING (r)
"""


SCAN_SQL = _sql()
