"""The registered queries of the training-data operators, and reference SQL where SQL can express one.

`public_tokenizers` holds vocabulary files; only the queries that count or encode tokens need it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from vantage.llm import (
    bpe, decontaminate, fim, hard_negatives, langid, licenses, neardup, packing, quality, secret_scan, shards, token_counts, winnow,
)
from vantage.llm.common import small_batches
from vantage.session import configure, use_local_folder


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(use_local_folder(configure(spark))).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.window_hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(_read(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(_read(spark, sf_dir, "documents")))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_read(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.prepared(_read(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(use_local_folder(configure(spark)), sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_token_counts, op3_quality, op4_bpe, op5_near_dup, op6_fingerprints, op7_secrets, op8_shards,
        op9_language, op10_licenses, op11_packing, op12_fill_in_middle, op13_hard_negatives, pipeline,
    )
}

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _phrases_sql(size: int = 10) -> str:
    """The phrases of n words that start at each place, for every n that a window has."""
    words = ["word", *(f"w{i}" for i in range(1, size))]
    return " UNION ALL ".join(
        f"SELECT doc_id, p, {n} AS n, concat_ws(' ', {', '.join(words[:n])}) AS phrase FROM places "
        f"WHERE {words[n - 1]} IS NOT NULL AND {n} IN (SELECT n FROM windows)"
        for n in range(1, size + 1)
    )


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(w[s:s + 9]) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
places AS (SELECT doc_id, p, word, {', '.join(f"lead(word, {i}) OVER v AS w{i}" for i in range(1, 10))} FROM flat WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
phrases AS ({_phrases_sql()}),
hits AS (SELECT doc_id, p, phrases.n AS n, item_id FROM phrases JOIN windows ON phrases.n = windows.n AND phrases.phrase = windows.phrase),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


#: What must stand before a match, for a dialect that cannot look back: a text's start or one character, which is no part of the match.
LOOK_BACK = {r"(?<![A-Za-z0-9_-])": r"(?:^|[^A-Za-z0-9_-])"}


def _spans_sql() -> str:
    """Each rule's matches and the gaps between them, as in the operator; positions are running sums."""
    each = []
    for n, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        lead = "0"
        for ours, theirs in LOOK_BACK.items():
            if ours in pattern:
                pattern, lead = pattern.replace(ours, theirs), "1"
        each.append(
            f"SELECT r, {n} AS ord, '{rule.kind}' AS kind, regexp_extract_all(text, '{pattern}', 0) AS m, "
            f"regexp_extract_all(text, '{pattern}', {rule.group}) AS g, string_split_regex(text, '{pattern}') AS gaps, {rule.least} AS least, {lead} AS lead FROM d"
        )
    return " UNION ALL ".join(each)


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_spans_sql()}),
placed AS (
  SELECT r, ord, kind, length(g[i]) >= least AS kept, length(m[i]) - lead * (length(m[i]) - length(g[i])) AS size,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)
      + lead * (length(m[i]) - length(g[i])) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)
),
listed AS (
  SELECT r, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    coalesce(string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + size AS BIGINT)), ',' ORDER BY start, ord) FILTER (ord < 3), '') AS base,
    coalesce(string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + size AS BIGINT)), ',' ORDER BY start, ord), '') AS spans
  FROM placed WHERE kept GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed ON d.r = listed.r
"""

OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
),
numbers AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
),
placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM numbers),
parts AS (
  SELECT doc_id, n, text, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

OP13_SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
points AS (SELECT DISTINCT * FROM given),
scored AS (
  SELECT a.vec_id AS anchor_id, p.vec_id, a.label = p.label AS same, a.v AS key,
    list_sum(list_transform(list_zip(a.v, p.v), lambda x: x[1] * x[2])) AS score
  FROM points a JOIN points p ON a.vec_id % 100 = 0 AND NOT (a.vec_id = p.vec_id AND a.label = p.label AND a.v = p.v)
),
positives AS (
  SELECT anchor_id, key, vec_id AS positive_id, CAST(score AS BIGINT) AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id, key ORDER BY score DESC, vec_id) <= 5
),
ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, CAST(score AS BIGINT) AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.key, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.key = p.key AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

ORACLES = {"op1_decontaminate": OP1_SQL, "op7_secrets": OP7_SQL, "op12_fill_in_middle": OP12_SQL, "op13_hard_negatives": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
