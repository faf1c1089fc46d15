"""Registered queries of this package: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    bisector_clusters, combination_join, decontaminate, hilbert_shards, language_id, near_dedup, packing, quality_gbt, secret_scan,
    source_audit, suffix_dedup, token_counts, topk_blocks,
)
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_token_counts(spark, sf_dir):
    """Tokens of every whole text by the 32k piece model, by overlap resynchronisation."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register
def op2_near_dedup(spark, sf_dir):
    """Near-duplicate groups of all documents by chosen-path set similarity join."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


@register
def op3_secret_scan(spark, sf_dir):
    """Secrets of every whole text, weak parts only beside complementary parts."""
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


@register
def op4_suffix_dedup(spark, sf_dir):
    """Bytes of all documents in 100-byte strings that start earlier elsewhere, by deep-shallow sorting."""
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


@register
def op6_decontamination(spark, sf_dir):
    """Benchmark items in whole documents by latent semantic retrieval with word checks."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register
def op8_quality_gbt(spark, sf_dir):
    """Quality score of every whole text by histogram gradient-boosted trees."""
    return quality_gbt.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register
def op9_hilbert_shards(spark, sf_dir):
    """All documents in Hilbert order, cut into 24 shards of equal row counts."""
    return hilbert_shards.hilbert_shards(read(spark, sf_dir, "documents"))


@register
def op10_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens by vector best-fit."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register
def op5_language_id(spark, sf_dir):
    """Language of every whole text by interpolated Kneser-Ney character models."""
    return language_id.identify(read(spark, sf_dir, "documents"))


@register
def op7_exact_top_k(spark, sf_dir):
    """20 best rows of every query vector (ids divisible by 20) by block-at-a-time pruning."""
    rows = topk_blocks.quantised(read(spark, sf_dir, "embeddings"))
    return topk_blocks.top_k(rows, rows.where("vec_id % 20 = 0"))


@register
def op11_centroid_clusters(spark, sf_dir):
    """Cluster of every 64-component vector by a tournament over bisecting planes."""
    return bisector_clusters.cluster(read(spark, sf_dir, "embeddings"))


@register
def op12_source_audit(spark, sf_dir):
    """Term divergence between the sources of each language, by chunk factorisation."""
    return source_audit.divergence(read(spark, sf_dir, "documents"))


@register
def op13_jaccard_join(spark, sf_dir):
    """Groups of documents linked by five-word shingles, by token-combination prefixes."""
    return combination_join.jaccard_groups(read(spark, sf_dir, "documents"))


ORACLES["op7_exact_top_k"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _shingle_groups(k: int, more: str = "") -> str:
    """Exact k-word shingle sets, candidate pairs over shared shingles, components by recursion."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i+{k - 1}], ' '))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id{more}
FROM s LEFT JOIN c ON s.doc_id = c.a
"""


ORACLES["op2_near_dedup"] = _shingle_groups(4, ", s.doc_id <= coalesce(c.m, s.doc_id) AS kept")
ORACLES["op13_jaccard_join"] = _shingle_groups(5)


def _rounds(rounds: int) -> str:
    """Common table expressions of the rounds: a<i> the nearest centroid, c<i> the centroids."""
    near = """a{i} AS (SELECT row, arg_min(cid, struct_pack(d, cid)) AS cid, CAST(min(d) AS BIGINT) AS d FROM
      (SELECT row, cid, sum((x - y) * (x - y)) AS d FROM v JOIN c{i} USING (pos) GROUP BY row, cid) GROUP BY row)"""
    mean = """c{j} AS (SELECT c.cid, c.pos, coalesce((s - ((s % n) + n) % n) // n, c.y) AS y FROM c{i} c LEFT JOIN
      (SELECT cid, pos, sum(x) AS s, count(*) AS n FROM v JOIN a{i} USING (row) GROUP BY cid, pos) m ON c.cid = m.cid AND c.pos = m.pos)"""
    return ",\n".join([t.format(i=i, j=i + 1) for i in range(rounds) for t in (near, mean)] + [near.format(i=rounds)])


ORACLES["op11_centroid_clusters"] = f"""
WITH k AS (SELECT vec_id, embedding AS e, row_number() OVER () AS row FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row, unnest(range(1, 65)) AS pos, unnest(list_transform(e, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM k),
f AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS cid FROM k WHERE vec_id IS NOT NULL),
c0 AS (SELECT cid, pos, x AS y FROM f JOIN v USING (row) WHERE cid < 16),
{_rounds(3)},
h AS (SELECT cid, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c3 GROUP BY cid)
SELECT k.vec_id, CAST(a3.cid AS INTEGER) AS cluster, a3.d AS distance,
       CAST(sum(a3.d) OVER (PARTITION BY a3.cid) AS BIGINT) AS cluster_inertia, CAST(sum(a3.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM k JOIN a3 USING (row) JOIN h ON h.cid = a3.cid
"""

# terms of every row, exact integer shares, every kept term for every group
ORACLES["op12_source_audit"] = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL),
lt AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(n.n, 0) AS n,
             1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 1)) // (gn.total + v.v) AS p
      FROM gn JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = gn.lang AND n.source = gn.source AND n.term = k.term),
q AS (SELECT ln.lang, ln.term, 1 + (CAST(1000000000 AS HUGEINT) * (ln.n + 1)) // (lt.total + v.v) AS q FROM ln JOIN lt USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
           (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
         ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, 'pair' AS part FROM pair UNION ALL BY NAME SELECT *, 'term' AS part FROM term),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
             CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200
"""
