"""The registered queries of this subpackage: one for each operator, over its whole table.

Two can be put as SQL in full, by brute force over ids that don't repeat; of the others no (hashes, models and
decoders are not SQL functions), and tests/llm holds each against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, language, linedup, media, minhash, mixing, packing, pii, secrets, toxicity

#: All pairs of equal lines; those that follow on each other in both places are runs, and of 50 words or more the later goes.
LINE_DEDUP = r"""
WITH own AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM own),
p AS (
  SELECT doc_id AS d, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM split),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM p),
pairs AS (
  SELECT a.d AS d1, b.d AS d2, a.i AS i1, b.i AS i2, a.w AS w, a.i - row_number() OVER (PARTITION BY a.d, b.d, b.i - a.i ORDER BY a.i) AS run
  FROM counted a JOIN counted b ON a.line = b.line AND (a.d < b.d OR a.d = b.d AND a.i < b.i)),
runs AS (SELECT d2, min(i2) AS s, max(i2) + 1 AS e FROM pairs GROUP BY d1, d2, i2 - i1, run HAVING sum(w) >= 50),
gone AS (SELECT DISTINCT d2 AS d, unnest(range(s, e)) AS i FROM runs),
kept AS (
  SELECT c.d, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY c.i), '') AS rest
  FROM counted c LEFT JOIN gone g ON c.d = g.d AND c.i = g.i GROUP BY c.d)
SELECT doc_id,
  CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN text IS NULL THEN NULL WHEN n_removed > 0 THEN rest ELSE text END AS text
FROM documents LEFT JOIN kept ON d = doc_id
"""

#: All pairs of documents with a common shingle; the least id that links lead to.
MINHASH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, x FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS x FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
pairs AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT v, root FROM reach JOIN pairs ON u = reach.doc_id WHERE v > root)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_packing": packing.query,
        "op3_language_model": language.query,
        "op4_secrets": secrets.query,
        "op5_line_dedup": linedup.query,
        "op6_minhash": minhash.query,
        "op7_pii": pii.query,
        "op8_mixing": mixing.query,
        "op9_fingerprints": fingerprints.query,
        "op10_media": media.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": LINE_DEDUP, "op6_minhash": MINHASH}
