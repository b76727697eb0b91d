"""One query for each corpus operator, with the parameters used in production."""

from __future__ import annotations

from sluice.llm import exact_dedup, fingerprints, jaccard_join, mixing, phrase_automata, piece_sampling, secret_scan, suffix_dedup, token_counts, toxicity
from sluice.llm.common import documents

#: Where public tokenizer files lie; only read, never copied.
TOKENIZERS = "/opt/tokenizers"


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir)).drop("kept")


def op2_phrase_automata(spark, sf_dir):
    return phrase_automata.substring_dedup(documents(spark, sf_dir)).drop("kept_text")


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_fingerprints(spark, sf_dir):
    return fingerprints.edited_likeness(documents(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json")


def op7_piece_sampling(spark, sf_dir):
    return piece_sampling.sample_pieces(documents(spark, sf_dir).select("doc_id", "text"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op9_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op10_secret_scan(spark, sf_dir):
    return secret_scan.scan(documents(spark, sf_dir))


OP3_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""


OP1_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS byte, CASE WHEN 2 * i + 398 <= length(h) THEN md5(substr(h, 2 * i - 1, 400)) END AS w FROM d, unnest(range(1, length(h) // 2 + 1)) AS r(i)),
r AS (SELECT doc_id, i, byte, CASE WHEN w IS NULL THEN 0 ELSE (count(*) OVER (PARTITION BY w) > 1)::INT END AS again FROM b),
c AS (SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, i, byte, gone, gone > coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS begins FROM c),
g AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM s GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS w FROM d, unnest(range(1, len(ws) + 1)) AS r(i)),
r AS (SELECT doc_id, i, word, CASE WHEN w IS NULL THEN 0 ELSE (count(*) OVER (PARTITION BY w) > 1)::INT END AS again FROM b),
c AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
g AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS t FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
c AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(c.root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id GROUP BY 1, 2
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op2_phrase_automata": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op8_jaccard_join": OP8_SQL, "op9_mixing": mixing.ORACLE_SQL}
