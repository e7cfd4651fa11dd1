"""The queries of this folder, `opN_<name>`, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk_dedup, cover_negatives, fm_dedup, lexical_search, lz_fingerprint, ordinal_quality, pii_bootstrap, quality_rules, secret_dfa, soft_mixing, sp_viterbi, token_files, warc_files
from .common import table

WORD_TOKENIZER, WORD_VOCABULARY, END_ID = "word_bpe_49k.json", 49_408, 2
PIECE_MODEL = "piece_bpe_32k.model"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID, WORD_VOCABULARY)[1]


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_viterbi.encoded_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_dfa.find_secrets(table(spark, sf_dir, "documents"))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed_windows")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, share=0.8)


def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.find_pii(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_files.archived(table(spark, sf_dir, "pages"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_ordinal_quality, op3_token_files, op4_sentencepiece, op5_secret_scan, op6_soft_mixing, op7_substring_dedup, op8_near_duplicates, op9_lz_fingerprint, op10_pii, op11_hard_negatives, op12_warc, op13_lexical_search)}

_WORD = r"[^\x20\x09-\x0D]+"
_CLOSED = "[" + "".join({"]": r"\]", "'": "''"}.get(c, c) for c in quality_rules.CLOSING) + "]"
_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in quality_rules.BOILERPLATE)
ORACLES = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, i + unnest(range(0, 5)) AS p FROM twice) GROUP BY doc_id),
pieces AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
l0 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM pieces),
l1 AS (SELECT doc_id, line, pos, len(regexp_extract_all(line, '{_WORD}')) AS n, lower(line) AS low FROM l0),
l2 AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup,
  (length(line) - length(replace(line, '|', '')) >= 2 AND 4 * (length(line) - length(replace(line, '|', ''))) >= n)
  OR (length(line) - length(replace(line, '!!', '')) >= 4 AND 3 * (length(line) - length(replace(line, '!!', ''))) / 2 >= n)
  OR 10 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) >= length(line)
  OR (n >= {quality_rules.SENTENCE_WORDS} AND NOT regexp_matches(line, '{_CLOSED}[\x20\x09-\x0D]*$'))
  OR (n <= {quality_rules.BOILERPLATE_WORDS} AND ({_PHRASES})) AS fails
  FROM l1 WHERE n > 0),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(n) FILTER (fails), 0) AS n_words_removed FROM l2 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_lines_removed, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(n_words_removed, 0) AS BIGINT) AS n_words_removed,
  len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed,
  NOT (len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w)) AND coalesce(n_words_removed, 0) <= 0.5 * len(w) AS kept
FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ls USING (doc_id)""",
    "op7_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS p FROM rep),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS k, string_agg(x, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN comp USING (doc_id) LEFT JOIN size USING (doc_id)""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pair WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pair USING (anchor_id) WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op12_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM t""",
    "op13_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, x, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS x FROM d) GROUP BY r, doc_id, x),
df AS (SELECT x, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY x, n_all),
q AS (SELECT item_id, x, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark) GROUP BY ALL),
score AS (SELECT item_id, r, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all)))) AS BIGINT) AS score FROM q JOIN tf USING (x) JOIN df USING (x), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0 QUALIFY rank <= 20""",
}
