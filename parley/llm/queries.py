"""The queries of this package: each applies one operator to a whole table."""

from parley.llm import (
    archives,
    centroids,
    exactdedup,
    filteraudit,
    innerproduct,
    jaccard,
    lm,
    maintext,
    packing,
    quality,
    sharding,
    toxicity,
    treebpe,
)
from parley.llm.centroids import SCALE, SEED, WIDTH
from parley.llm.common import reachable

VOCAB = "word_bpe_49k.json"


def vocab_path(name=VOCAB):
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    reachable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


QUERIES = {
    "op1_rendezvous_sharding": lambda s, d: sharding.documents_query(table(s, d, "documents")),
    "op2_arc_to_warc": lambda s, d: archives.pages_query(table(s, d, "pages")),
    "op3_complement_packing": lambda s, d: packing.documents_query(table(s, d, "documents"), vocab_path()),
    "op4_main_text": lambda s, d: maintext.pages_query(table(s, d, "pages")),
    "op5_exact_dedup": lambda s, d: exactdedup.documents_query(table(s, d, "documents")),
    "op6_toxicity": lambda s, d: toxicity.documents_query(table(s, d, "documents"), table(s, d, "labels")),
    "op7_norm_sorted_topk": lambda s, d: innerproduct.embeddings_query(table(s, d, "embeddings")),
    "op8_tree_bpe": lambda s, d: treebpe.documents_query(table(s, d, "documents"), vocab_path()),
    "op9_ngram_jaccard_join": lambda s, d: jaccard.documents_query(table(s, d, "documents")),
    "op10_attention_lm": lambda s, d: lm.documents_query(table(s, d, "documents"), vocab_path()),
    "op11_vantage_clusters": lambda s, d: centroids.embeddings_query(table(s, d, "embeddings")),
    "op12_quality_rules": lambda s, d: quality.documents_query(table(s, d, "documents"), table(s, d, "labels")),
    "op13_filter_audit": lambda s, d: filteraudit.documents_query(table(s, d, "documents"), table(s, d, "labels")),
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE32 = _UPPER + "234567"


def _clusters_sql(k=8, rounds=10):
    """Rounds as steps of one statement; distances of all vectors to the few centroids of each step."""

    def assigned(step):
        return f"""
a{step} AS MATERIALIZED (
  SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.n, m.c, list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: (v.q[i] - m.q[i]) * (v.q[i] - m.q[i]))) AS d
    FROM v, m{step} m) GROUP BY n)"""

    def moved(step):
        return f"""
s{step} AS (
  SELECT c, i, CAST(sum(x) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS k
  FROM (SELECT a.c, unnest(v.q) AS x, unnest(range({WIDTH})) AS i FROM a{step} a JOIN v USING (n)) GROUP BY c, i),
m{step + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(f.q, m.q) AS q FROM m{step} m LEFT JOIN (
    SELECT c, list((s - ((s % k) + k) % k) // k ORDER BY i) AS q FROM s{step} GROUP BY c) f USING (c))"""

    steps = ",".join(assigned(i) + "," + moved(i) for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (
    SELECT q, sha256('{SEED}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k})),{steps},{assigned(rounds)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (n) JOIN m{rounds} m ON m.c = a.c"""


#: DuckDB SQL for the queries that SQL can express; the tests compare the others with brute force.
ORACLES = {
    "op2_arc_to_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', CAST(1 + (
         (CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT)
          >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (h)""",
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)""",
    "op7_norm_sorted_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score FROM s QUALIFY rank <= 5""",
    "op9_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (
  SELECT p.a, p.b FROM (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY 1, 2) p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op11_vantage_clusters": _clusters_sql(),
    "op13_filter_audit": """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good,
             max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(doc_id > first, false)] AS fails
  FROM d JOIN g USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order,
             i AS step, o[i] AS own, o[1:i - 1] AS before FROM o, i),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS bad,
         len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM c, s),
t AS (
  SELECT part, filter_order, step, own,
         CAST(sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN bad AND alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM t""",
}
