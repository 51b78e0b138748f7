"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm.common import table
from failscope.llm.decontaminate import decontaminate
from failscope.llm.exact_search import exact_top_k
from failscope.llm.hard_negatives import hard_negatives
from failscope.llm.licences import document_licences, known_table
from failscope.llm.line_dedup import line_report
from failscope.llm.merkle import manifest, verify
from failscope.llm.near_duplicates import near_duplicates
from failscope.llm.pieces import segmentations
from failscope.llm.pseudonyms import findings
from failscope.llm.quality import fit, quality
from failscope.llm.simhash import simhash_duplicates
from failscope.llm.token_counts import token_counts
from failscope.llm.token_files import token_files

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality(docs, fit(docs))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
    translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(
    translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS n FROM starts),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d),
cand AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM places, lens WHERE p + n - 1 <= len(w)),
hit AS (SELECT DISTINCT rid, p, c.n, item_id FROM cand c JOIN win ON win.s = c.s AND win.n = c.n),
pos AS (SELECT DISTINCT rid, unnest(range(p, p + n)) AS p FROM hit),
nh AS (SELECT rid, count(*) AS n_hit FROM pos GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (rid) LEFT JOIN its USING (rid)"""


def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top_k(table(spark, folder, "embeddings"))


OP7_SQL = """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
  CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM u q JOIN u c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
  AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(table(spark, folder, "documents"))


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM starts),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b
  ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * i >= 85 * (a.n + b.n - i)),
e2 AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x, y FROM e2 UNION SELECT r.x, e2.y FROM reach r JOIN e2 ON r.y = e2.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = doc_id"""


def op1_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return segmentations(table(spark, folder, "documents"))


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"))


def op3_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return document_licences(table(spark, folder, "documents"), known_table(spark))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))


def op10_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return findings(table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Tampered are the texts of a third of the rows: their A-Z are lower-cased."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER))
    return verify(manifest(table(spark, folder, "documents"), tampered))


def _sql_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(
        f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


# crc: each byte is followed by eight shifts, written as -1
OP11_SQL = f"""
WITH RECURSIVE c AS (SELECT *, coalesce('+' || lang, '') AS b, xor(list_reduce(list_concat([4294967295], flatten(
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, (r & 1) * 3988292384) END), 4294967295) AS crc
  FROM documents),
d AS (SELECT doc_id, b, {_sql_leaf('text')} AS leaf, CASE WHEN crc % 3 = 0
    THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY b) AS size FROM d),
n AS (SELECT 0 AS level, b, place AS pos, leaf AS digest, size FROM p
  UNION ALL SELECT level + 1, b, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (size + 7) // 8
  FROM n WHERE size > 1 GROUP BY level, b, pos // 8, size),
s AS (SELECT b, digest AS subroot, row_number() OVER (ORDER BY b) - 1 AS place, count(*) OVER () AS size
  FROM n WHERE size = 1),
m AS (SELECT 0 AS level, place AS pos, subroot AS digest, size FROM s
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (size + 7) // 8
  FROM m WHERE size > 1 GROUP BY level, pos // 8, size),
near AS (SELECT 'branch' AS kind, * FROM n WHERE size > 1 UNION ALL SELECT 'top', level, '', pos, digest, size FROM m WHERE size > 1),
sib AS (SELECT kind, level, b, pos,
  coalesce(string_agg(digest, '') OVER (PARTITION BY kind, level, b, pos // 8 ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') OVER (PARTITION BY kind, level, b, pos // 8 ORDER BY pos
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM near),
w AS (SELECT doc_id, b, place, leaf, 0 AS level, place AS pos, '' AS proof, coalesce(changed, leaf) AS top FROM p
  UNION ALL SELECT doc_id, w.b, place, leaf, w.level + 1, w.pos // 8, proof || l || r, sha256(l || top || r)
  FROM w JOIN sib ON kind = 'branch' AND sib.b = w.b AND sib.level = w.level AND sib.pos = w.pos),
up AS (SELECT doc_id, w.b, w.place, leaf, subroot, s.place AS up_place, 0 AS level, s.place AS pos, proof, top
  FROM w JOIN s ON s.b = w.b WHERE w.level = (SELECT max(level) FROM n WHERE n.b = w.b)
  UNION ALL SELECT doc_id, up.b, place, leaf, subroot, up_place, up.level + 1, up.pos // 8, proof || l || r, sha256(l || top || r)
  FROM up JOIN sib ON kind = 'top' AND sib.level = up.level AND sib.pos = up.pos)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, top AS folded_root, top = root AS verified
FROM up, (SELECT level AS height, digest AS root FROM m WHERE size = 1) WHERE level = height"""


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_duplicates(table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of rows whose vec_id is divisible by 7 are moved on by one first."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved)).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP13_SQL = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(CAST(list_sum(list_transform(
  range(1, least(len(a.v), len(c.v)) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT), 0) AS score
  FROM u a JOIN u c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (
  PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3"""


QUERIES = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_token_files": op2_token_files,
    "op3_licence_scan": op3_licence_scan,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_line_dedup": op8_line_dedup,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash": op12_simhash,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op6_decontaminate": OP6_SQL,
    "op7_exact_top_k": OP7_SQL,
    "op9_near_duplicates": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
