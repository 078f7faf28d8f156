"""Registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import (
    alignment,
    automaton,
    bloom_lm,
    covering,
    hilbert,
    licenses,
    packing,
    parity,
    periods,
    pieces,
    repetition,
    suffix_sort,
    toxicity,
)
from turnwise.llm.common import documents, fold, text_chunks, words

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_toxicity_compression")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(fold("doc_id") != 0))
    return toxicity.score(docs, model).withColumn("held_out", fold("doc_id") == 0)


@query("op2_bloom_language_model")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return bloom_lm.score(docs, fold("doc_id") != 1).withColumn("held_out", fold("doc_id") == 1)


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


OP4_SQL = r"""
WITH templates(template, license, text) AS (VALUES
  (0, 'Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
  (1, 'Apache-2.0', 'Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.'),
  (2, 'MIT', 'Released under the MIT License.'),
  (3, 'MIT', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction'),
  (4, 'GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
  (5, 'GPL-3.0', 'you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
  (6, 'GPL-2.0', 'This work is licensed under the GNU General Public License, version 2.'),
  (7, 'LGPL-3.0', 'This work is licensed under the GNU Lesser General Public License, version 3.'),
  (8, 'AGPL-3.0', 'This work is licensed under the GNU Affero General Public License, version 3.'),
  (9, 'BSD-3-Clause', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met'),
  (10, 'MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
  (11, 'CC-BY-4.0', 'Licensed under CC BY 4.0.'),
  (12, 'CC-BY-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
  (13, 'CC-BY-SA-4.0', 'Licensed under CC BY-SA 4.0.'),
  (14, 'CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
  (15, 'CC-BY-NC-4.0', 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.'),
  (16, 'CC0-1.0', 'To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).'),
  (17, 'Unlicense', 'This is free and unencumbered software released into the public domain.')
), files AS (
  SELECT page_id, coalesce(regexp_extract(url, '^(?i:https?://)?([^?#]*)', 1), '') AS path,
         regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS body
  FROM pages
), found AS (
  SELECT page_id, path, trim(line) AS line
  FROM (SELECT page_id, path, unnest(string_split(body, chr(10))) AS line FROM files)
  WHERE regexp_matches(line, '(?i)licen[cs]e|copyright|spdx|redistribut|permission|public domain|public license|creative commons')
), counted AS (
  SELECT line, count(*) AS n FROM found GROUP BY line
), tf AS (
  SELECT line, n, term, count(*) AS tf
  FROM (SELECT line, n, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS term FROM counted)
  WHERE term <> '' GROUP BY line, n, term
), ttf AS (
  SELECT template, license, term, count(*) AS tf
  FROM (SELECT template, license, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM templates)
  WHERE term <> '' GROUP BY template, license, term
), idf AS (
  SELECT term, ln((1 + (SELECT coalesce(sum(n), 0) FROM counted)) / (1 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT term, sum(n) AS df FROM tf GROUP BY term) FULL JOIN (SELECT DISTINCT term FROM ttf) USING (term)
), a AS (
  SELECT line, term, tf * idf AS w, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY line)) AS norm FROM tf JOIN idf USING (term)
), b AS (
  SELECT template, license, term, tf * idf AS w, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY template)) AS norm FROM ttf JOIN idf USING (term)
), cosines AS (
  SELECT line, license, round(sum(a.w * b.w) / min(a.norm) / min(b.norm), 6) AS score
  FROM a JOIN b USING (term) GROUP BY line, template, license
), best AS (
  SELECT line, license, score FROM cosines
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1
), own AS (
  SELECT page_id, path, license AS own_license, score AS own_score
  FROM found JOIN best USING (line) WHERE score >= 0.6
  QUALIFY row_number() OVER (PARTITION BY page_id, path ORDER BY score DESC, license) = 1
), folders AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS directory, own_license AS folder_license FROM own
  WHERE path LIKE '%/' OR regexp_matches(path, '(?i)(^|/)(un)?licen[cs]e([.-][^/]*)?$|(^|/)(copying|notice)([.-][^/]*)?$')
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY own_score DESC, own_license) = 1
), near AS (
  SELECT page_id, path, directory, folder_license
  FROM (SELECT page_id, path, depth, array_to_string(string_split(path, '/')[1:depth], '/') AS directory
        FROM (SELECT page_id, path, unnest(range(1, len(string_split(path, '/')))) AS depth FROM files))
  JOIN folders USING (directory)
  QUALIFY row_number() OVER (PARTITION BY page_id, path ORDER BY depth DESC) = 1
)
SELECT page_id, path, own_license, own_score, CASE WHEN own_license IS NULL THEN directory END AS directory,
       coalesce(own_license, folder_license) AS license
FROM files LEFT JOIN own USING (page_id, path) LEFT JOIN near USING (page_id, path)
"""


@query("op4_license_scan", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = licenses.url_path(F.col("url"))
    speaks = path.endswith("/") | path.rlike(licenses.LICENSE_FILE)
    return licenses.scan(pages, licenses.html_lines(F.col("html")), path, speaks, id_col="page_id")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), pos AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), win AS (
  SELECT doc_id, i,
         CASE WHEN i + 2 <= len(ws) THEN ws[i : i + 2] END AS w3,
         CASE WHEN i + 7 <= len(ws) THEN ws[i : i + 7] END AS w8,
         CASE WHEN i + 200 <= len(ws) THEN hash(ws[i : i + 200]) END AS w201
  FROM pos
), hit AS (
  SELECT doc_id, i,
         w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w3) > 1 AS h3,
         w8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w8) > 1 AS h8,
         w201 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w201) > 1 AS h201
  FROM win
), cov AS (
  SELECT doc_id, h201,
         bool_or(h3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
         bool_or(h8) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8
  FROM hit
), rep AS (
  SELECT doc_id, count(*) FILTER (c3) AS r3, count(*) FILTER (c8) AS r8, bool_or(h201) AS r201 FROM cov GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dups
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(r3, 0)::BIGINT AS n_repeat_words,
         coalesce(r8, 0)::BIGINT AS covered_words, coalesce(r201, false) AS r201
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN ln ON w.doc_id = ln.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND 100 * covered_words <= 45 * n_words AND NOT r201 AS kept
FROM base
"""


@query("op5_suffix_repetition", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(documents(spark, sf_dir)).drop("longest_repeat")


@query("op6_vector_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = packing.file_tokenizer(public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packing.pack(documents(spark, sf_dir), tokenizer, keep_ids=False)


@query("op7_suffix_automata")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.deduplicate(documents(spark, sf_dir), digests=True)


@query("op8_hilbert_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query("op9_suffix_merge_sort")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sort.deduplicate(documents(spark, sf_dir), digests=True)


@query("op10_simhash_covering")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering.near_duplicates(documents(spark, sf_dir))


def with_planted_periods(df: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) in which a tenth of the texts repeat some words to their end, as op12's contract has it."""

    def planted(doc_id: int, text: str | None) -> str | None:
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is None or h % 10:
            return text
        ws, g = words(text), h // 10
        if not ws:
            return text
        a = g % len(ws)
        p = 1 + (len(ws) - a) // (3 + g % 8)
        return b" ".join(ws[:a] + (ws[a : a + p] * (len(ws) // p + 1))[: len(ws) - a]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch, "text"):
                ids = rows.column("doc_id")
                new = [planted(i, t) for i, t in zip(ids.to_pylist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(new, pa.string())], ["doc_id", "text"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string")


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(with_planted_periods(documents(spark, sf_dir)))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.align(documents(spark, sf_dir), *paths, digests=True)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("op13_parity_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity.similarity_join(documents(spark, sf_dir))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
