"""One registered query per operator, over whole tables with production parameters; DuckDB SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.llm import (
    embeddings,
    language,
    manifest,
    near,
    negatives,
    packing,
    passages,
    pseudonyms,
    quality,
    repetition,
    segmentation,
    sharding,
    statements,
    templates,
)

#: Rows that may teach a classifier.
LEARN = "pmod(crc32(CAST(doc_id AS STRING)), 3) <> 1"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without recurring lines: ``doc_id, text, n_lines, n_dropped``."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return templates.drop_recurring_lines(docs)


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text: ``doc_id, held_out, lang_pred, score, rejected``."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(LEARN))
    found = language.predict(docs, model)
    return found.withColumn("held_out", ~F.coalesce(F.expr(LEARN), F.lit(True)))


def op3_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition statistics and verdict of every text."""
    return repetition.judge(repetition.repetition_stats(_table(spark, folder, "documents"))).drop("longest_repeat")


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every text: ``doc_id, n_pieces, ids_crc32, n_bytes, same``."""
    return segmentation.segment_digests(_table(spark, folder, "documents"), _vocabulary("piece_bpe_32k.model"))


def op5_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages that a document shares with an earlier one: word spans with the document they repeat."""
    return passages.repeated_passages(_table(spark, folder, "documents"))


def op6_near_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of 80 % of five-word shingles."""
    return near.near_components(_table(spark, folder, "documents"))


def op7_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with validated values replaced: ``doc_id, text, n_values``. The secret is a setting of the session."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize_documents(docs, pseudonyms.job_key(spark)).select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_values"))


def op8_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every text: ``doc_id, held_out, score, predicted``."""
    scores = quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"), LEARN)
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    pieces = packing.token_pieces(_table(spark, folder, "documents"), _vocabulary("byte_bpe_50k.json"))
    return packing.pack(pieces)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives under the first five positives of every anchor: ids, rank and scores."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(vectors, F.expr("id % 100 = 0"))


def op12_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard of every document by its key, its place there, and its shard if there were one more."""
    return sharding.shard_documents(_table(spark, folder, "documents"))


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle proof of every document, and the root that it leads to when some texts are lower-cased."""
    altered = F.expr("pmod(crc32(CAST(doc_id AS STRING)), 3) = 0")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", upper, upper.lower())
    return manifest.dataset_manifest(_table(spark, folder, "documents"), altered, lowered)


REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_templates,
        op2_language,
        op3_repetition,
        op4_sentencepiece,
        op5_passages,
        op6_near_documents,
        op7_pseudonyms,
        op8_embeddings,
        op9_quality,
        op10_packing,
        op11_hard_negatives,
        op12_shards,
        op13_manifest,
    )
}

#: Dropped lines as SQL: the same template forms, spelled out instead of hashed.
LINES_SQL = r"""
  source AS (SELECT doc_id, text FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
  cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                 unnest(range(len(string_split(text, chr(10))))) AS line FROM source),
  plain AS (SELECT doc_id, line, string_split(trim(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), ' ') AS p FROM cut),
  masked AS (SELECT doc_id, line, p, list_transform(p, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS t FROM plain),
  tokens AS (SELECT *, len(list_filter(t, lambda x: x <> '*')) AS words,
                    words = len(t) OR (len(t) >= 10 AND 2 * words >= len(t)) AS firm FROM masked),
  pieces AS (
    SELECT doc_id, line, t, words, 's' || k AS k, 2 + floor((len(t) - 2) * k / 4.0)::INT AS a, 2 + floor((len(t) - 2) * (k + 1) / 4.0)::INT AS b
    FROM tokens, range(4) AS r(k) WHERE len(t) >= 10
    UNION ALL
    SELECT doc_id, line, t, words, 't' || k, k::INT, k::INT + 1 FROM tokens, range(2, 9) AS r(k) WHERE len(t) >= 5 AND len(t) < 10 AND k < len(t)),
  forms AS (
    SELECT doc_id, line, concat_ws('|', 'm', array_to_string(t, ' ')) AS form, firm FROM tokens WHERE len(t) >= 2
    UNION ALL
    SELECT doc_id, line, concat_ws('|', 'p', array_to_string(p, ' ')), true FROM tokens
    WHERE (len(t) >= 2 AND NOT firm) OR (len(t) = 1 AND octet_length(encode(p[1])) >= 12)
    UNION ALL
    SELECT doc_id, line, concat_ws('|', k, len(t), coalesce(array_to_string(t[1:a], ' '), ''), coalesce(array_to_string(t[b + 1:], ' '), '')),
           len(t) >= 10 AND 2 * len(list_filter(list_concat(t[1:a], t[b + 1:]), lambda x: x <> '*')) >= len(t)
    FROM pieces),
  seen AS (SELECT form, firm, doc_id, min(line) AS line FROM forms GROUP BY ALL),
  recurring AS (SELECT form, min(doc_id) AS first_doc FROM seen GROUP BY form, firm HAVING count(*) >= CASE WHEN firm THEN 2 ELSE 4 END),
  gone AS (
    SELECT DISTINCT f.doc_id, f.line FROM forms f JOIN recurring r USING (form)
      JOIN seen s ON s.form = f.form AND s.doc_id = f.doc_id
    WHERE f.doc_id <> r.first_doc OR f.line > s.line),
  rest AS (
    SELECT c.doc_id, coalesce(string_agg(c.raw, chr(10) ORDER BY c.line) FILTER (WHERE g.line IS NULL), '') AS text,
           count(*) AS n_lines, count(g.line) AS n_dropped
    FROM cut c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.line = c.line GROUP BY c.doc_id)
"""

ORACLE: dict[str, str] = {
    "op11_hard_negatives": statements.HARD_NEGATIVES,
    "op12_shards": statements.SHARDS,
    "op13_manifest": statements.MANIFEST,
    "op1_line_templates": "WITH "
    + LINES_SQL.replace("{docs}", "documents")
    + """SELECT d.doc_id, coalesce(r.text, d.text) AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
         FROM documents d LEFT JOIN rest r USING (doc_id)""",
    "op3_repetition": r"""
      WITH words AS (SELECT doc_id, coalesce(text, '') AS text,
                            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
      place AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, len(w) AS n, w FROM words),
      runs AS (SELECT doc_id, size, i, hash(w[i:i + size - 1]) AS h FROM place, (VALUES (3), (10), (61)) AS s(size)
               WHERE i + size - 1 <= n),
      twice AS (SELECT doc_id, size, i, count(*) OVER (PARTITION BY doc_id, size, h) AS times FROM runs),
      covered AS (SELECT doc_id, size, count(DISTINCT i + k) AS words
                  FROM twice, range(10) AS r(k) WHERE times > 1 AND k < size AND size <= 10 GROUP BY ALL),
      long_ AS (SELECT DISTINCT doc_id FROM twice WHERE size = 61 AND times > 1),
      lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
      dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
      stats AS (
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(a.words, 0)::BIGINT AS n_repeat_words,
               coalesce(b.words, 0)::BIGINT AS covered_words, l.doc_id IS NOT NULL AS too_long
        FROM words d LEFT JOIN dup ON dup.doc_id = d.doc_id
          LEFT JOIN covered a ON a.doc_id = d.doc_id AND a.size = 3
          LEFT JOIN covered b ON b.doc_id = d.doc_id AND b.size = 10
          LEFT JOIN long_ l ON l.doc_id = d.doc_id)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
               AND covered_words <= 0.3::DOUBLE * n_words AND NOT too_long AS kept
      FROM stats""",
}
