"""The registered queries of the corpus operators, each over the whole of its table."""

from __future__ import annotations

from assetspark.llm import htmltext, jaccard, licenses, linededup, merkle, mixing, negatives, packing, pii, simhash, spotsigs, topk, toxicity
from assetspark.llm.common import table

QUERIES = {
    "op1_license_scan": lambda spark, sf_dir: licenses.license_digest(table(spark, sf_dir, "documents")),
    "op2_spot_signatures": lambda spark, sf_dir: spotsigs.fingerprint_digest(table(spark, sf_dir, "documents")),
    "op3_line_dedup": lambda spark, sf_dir: linededup.dedup_digest(table(spark, sf_dir, "documents")),
    "op4_toxicity": lambda spark, sf_dir: toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_pack": lambda spark, sf_dir: packing.pack_documents(table(spark, sf_dir, "documents")),
    "op6_ngram_jaccard": lambda spark, sf_dir: jaccard.linked(table(spark, sf_dir, "documents")),
    "op7_mix_sources": lambda spark, sf_dir: mixing.mix_digest(table(spark, sf_dir, "documents")),
    "op8_top_k": lambda spark, sf_dir: topk.top_k(table(spark, sf_dir, "embeddings")),
    "op9_html_text": lambda spark, sf_dir: htmltext.extract_main_text(table(spark, sf_dir, "pages")),
    "op10_pii": lambda spark, sf_dir: pii.pii_digest(table(spark, sf_dir, "documents")),
    "op11_merkle_manifest": lambda spark, sf_dir: merkle.manifest_digest(table(spark, sf_dir, "documents")),
    "op12_simhash": lambda spark, sf_dir: simhash.simhash_digest(table(spark, sf_dir, "documents")),
    "op13_hard_negatives": lambda spark, sf_dir: negatives.hard_negatives(table(spark, sf_dir, "embeddings")),
}

#: A line goes if it lies in a run of 3 words or more that also stands at an earlier place. Runs are looked at from
#: each line on and up to each line; lines without words belong to none.
LINE_DEDUP = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
every AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM split),
worded AS (
  SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM worded),
ahead AS (SELECT a.doc_id, a.k AS i, min(b.k) AS j FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.k >= a.k AND b.upto - a.upto + a.words >= 3 GROUP BY a.doc_id, a.k),
behind AS (SELECT a.doc_id, max(b.k) AS i, a.k AS j FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.k <= a.k AND a.upto - b.upto + b.words >= 3 GROUP BY a.doc_id, a.k),
runs AS (SELECT doc_id, i, j FROM ahead UNION SELECT doc_id, i, j FROM behind),
texts AS (SELECT r.doc_id, r.i, r.j, string_agg(c.line, chr(10) ORDER BY c.k) AS content FROM runs r JOIN c ON c.doc_id = r.doc_id AND c.k BETWEEN r.i AND r.j GROUP BY r.doc_id, r.i, r.j),
firsts AS (SELECT content, min(doc_id * 1000000 + i) AS first_pos FROM texts GROUP BY content),
gone AS (
  SELECT DISTINCT t.doc_id, c.pos FROM texts t JOIN firsts f ON f.content = t.content JOIN c ON c.doc_id = t.doc_id AND c.k BETWEEN t.i AND t.j
  WHERE t.doc_id * 1000000 + t.i > f.first_pos),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos WHERE g.pos IS NULL GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_deleted FROM gone GROUP BY doc_id),
result AS (
  SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(g.n_deleted, 0) AS n_deleted,
         CASE WHEN g.n_deleted = n.n_lines THEN '' ELSE coalesce(kept.text, '') END AS text
  FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id)
SELECT doc_id, n_lines, n_deleted, sha256(text) AS kept_sha256, length(text) AS n_chars FROM result"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

#: Levels, then the climb of each leaf, two by two; crc32 bit by bit over the digits of doc_id.
MERKLE = """
WITH RECURSIVE fields AS (
  SELECT doc_id, n_chars, coalesce('1' || lang, '0') AS g,
    list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text, CAST(n_chars + 1 AS VARCHAR)], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS f,
    xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b:
      list_reduce(range(0, 8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), CAST(4294967295 AS BIGINT))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, g, sha256(f[1] || f[2] || f[3] || f[4] || f[5]) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(f[1] || f[2] || f[3] || f[6] || f[5]) ELSE sha256(f[1] || f[2] || f[3] || f[4] || f[5]) END AS altered
  FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (
  SELECT g, 0 AS level, pos, n, leaf AS hash FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, pos // 2, n),
subroots AS (SELECT g, hash, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, hash FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
climb AS (
  SELECT doc_id, g, leaf, pos AS own, 0 AS level, pos, n, altered AS at, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.g, c.leaf, c.own, c.level + 1, c.pos // 2, (c.n + 1) // 2, sha256(CASE WHEN c.pos % 2 = 1 THEN s.hash || c.at ELSE c.at || coalesce(s.hash, '') END), c.proof || coalesce(s.hash, '')
  FROM climb c LEFT JOIN nodes s ON s.g = c.g AND s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1),
higher AS (
  SELECT c.doc_id, c.leaf, c.own, r.hash AS subroot, 0 AS level, r.pos, r.n, c.at, c.proof FROM climb c JOIN subroots r ON r.g = c.g WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.own, c.subroot, c.level + 1, c.pos // 2, (c.n + 1) // 2, sha256(CASE WHEN c.pos % 2 = 1 THEN s.hash || c.at ELSE c.at || coalesce(s.hash, '') END), c.proof || coalesce(s.hash, '')
  FROM higher c LEFT JOIN tops s ON s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1)
SELECT h.doc_id, h.leaf, h.subroot, t.hash AS root, sha256(h.proof) AS proof_sha256, h.at AS folded_root, h.at = t.hash AS verified FROM higher h JOIN tops t ON t.n = 1 WHERE h.n = 1"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM scored WHERE same) WHERE k <= 5),
found AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5"""

ORACLES = {"op13_hard_negatives": HARD_NEGATIVES, "op3_line_dedup": LINE_DEDUP, "op8_top_k": TOP_K, "op11_merkle_manifest": MERKLE}
