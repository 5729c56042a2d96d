"""The queries opN_<name> and their SQL, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, enrichment, factors, fingerprints, lines, minhash, mixing, sharding, toxicity, trie, urls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(_table(spark, sf_dir, "documents"))


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("node")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op11_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.passage_digests(_table(spark, sf_dir, "documents"))


def op12_sale_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrich_sales(_table(spark, sf_dir, "sales"), _table(spark, sf_dir, "client_changes"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_winnowing, op2_feistel_shards, op3_token_counts, op4_probminhash, op5_toxicity, op6_cube_mix, op7_bpe_round_trip,
        op8_embedding_near_dedup, op9_fuzzy_lines, op10_url_filter, op11_passage_dedup, op12_sale_enrichment, op13_conversation_trie,
    )
}

#: Brute force: all pairs of texts that share a five-word shingle, and the closure of the links.
_NEAR = r"""
WITH RECURSIVE t AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
k AS (SELECT text, md5(text) AS k, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM t),
s AS (SELECT k, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)])) AS s FROM k WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.k < y.k GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE c >= 0.8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT k AS a, k AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
d AS (SELECT doc_id, md5(coalesce(text, '')) AS k FROM documents),
c AS (SELECT r.a AS k, min(d.doc_id) AS class_id FROM r JOIN d ON d.k = r.b GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, doc_id IS NOT DISTINCT FROM coalesce(class_id, doc_id) AS kept FROM d LEFT JOIN c USING (k)
"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, (SELECT min(b) FROM r WHERE a = vec_id) AS component_id, vec_id = (SELECT min(b) FROM r WHERE a = vec_id) AS kept FROM v
"""

#: crc32 of a column's decimal text, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST({} AS VARCHAR), '')])), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

_PASSAGES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, o, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS (SELECT r, o, i, md5(string_agg(word, ' ') OVER s) AS k, count(*) OVER s AS n FROM words WINDOW s AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
x AS (SELECT * FROM f WHERE n = 13),
m AS (SELECT k, min(o) AS o FROM x GROUP BY k),
gone AS (SELECT DISTINCT r, i + unnest(range(0, 13)) AS i FROM x JOIN m ON m.k = x.k AND m.o < x.o),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

_SALES = f"""
WITH s AS (
  SELECT sale_id AS id, client_id, sold_at, greatest(least(11, CAST(floor((CAST(floor(epoch_us(arrived_at) / 86400000000) AS BIGINT) - 19723) * 12 / 152) AS BIGINT)), 0) AS batch FROM sales),
c AS (
  SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
v AS (
  SELECT change_id AS id, client_id, valid_at, op, CAST(floor(100 * balance + 0.5) AS BIGINT) AS cents,
    greatest(least(11, CAST(floor((CAST(floor(epoch_us(valid_at) / 86400000000) AS BIGINT) + crc % 4 - 19723) * 12 / 152) AS BIGINT)), 0) AS batch
  FROM (SELECT *, {_CRC.format('change_id')} AS crc FROM c)),
b AS (SELECT unnest(range(0, 12)) AS batch),
m AS (SELECT batch, (SELECT max(sold_at) FROM s WHERE s.batch < b.batch) AS ws, (SELECT max(valid_at) FROM v WHERE v.batch < b.batch) AS wc FROM b),
h AS (SELECT batch, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM m),
late AS (SELECT v.id, v.batch FROM v JOIN h USING (batch) WHERE valid_at < wc),
kept AS (
  SELECT v.*, (SELECT min(h.batch) FROM h WHERE h.batch >= v.batch AND h.h >= v.valid_at) AS passed FROM v JOIN h USING (batch) WHERE wc IS NULL OR valid_at >= wc),
alive AS (
  SELECT *, CASE WHEN later IS NOT NULL THEN greatest(batch, later) END AS pruned
  FROM (SELECT *, min(passed) OVER (PARTITION BY client_id ORDER BY valid_at, id, cents, op ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM kept)),
e AS (
  SELECT s.id, s.client_id, sold_at, CASE WHEN sold_at IS NULL THEN s.batch ELSE coalesce((SELECT min(h.batch) FROM h WHERE h.batch >= s.batch AND h.h > s.sold_at), 12) END AS batch FROM s),
held AS (SELECT e.client_id, e.batch, count(*) AS n FROM (SELECT DISTINCT client_id, batch FROM e) e JOIN alive a ON a.client_id = e.client_id AND a.batch <= e.batch AND (a.pruned IS NULL OR a.pruned >= e.batch) GROUP BY 1, 2),
took AS (
  SELECT e.id, e.batch, arg_max(struct_pack(id := a.id, cents := a.cents, op := a.op), struct_pack(t := a.valid_at, i := a.id)) AS x
  FROM e JOIN alive a ON a.client_id = e.client_id AND a.batch <= e.batch AND (a.pruned IS NULL OR a.pruned >= e.batch) AND a.valid_at <= e.sold_at GROUP BY 1, 2)
SELECT 'sale' AS rec, e.id, e.batch, coalesce(held.n, 0) AS n_held, took.x.id AS change_id, took.x.cents AS balance_cents, took.x.op AS op
FROM e LEFT JOIN held ON held.client_id = e.client_id AND held.batch = e.batch LEFT JOIN took ON took.id = e.id AND took.batch = e.batch
UNION ALL SELECT 'late', id, batch, NULL, NULL, NULL, NULL FROM late
"""

_TRIE = f"""
WITH own AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS t, {_CRC.format('conv_id')} % 6 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
seq AS (SELECT o.conv_id, list_concat(coalesce(x.t, [])[1:o.h], o.t[o.h + 1:]) AS s FROM own o LEFT JOIN own x ON x.conv_id = o.conv_id - o.conv_id % 100),
pre AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM seq),
node AS (
  SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '') AS ends FROM pre GROUP BY 1, 2),
kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
valued AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, CASE WHEN node.depth > 0 THEN (n_convs - 1) * length(node.p[node.depth].text) ELSE 0 END AS own FROM node LEFT JOIN kids ON kids.p = node.p AND kids.depth = node.depth),
up AS (SELECT p[1:d] AS p, d AS depth, n_children, own FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM valued)),
sums AS (SELECT p, depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN sums ON sums.p = v.p AND sums.depth = v.depth LEFT JOIN node q ON v.depth > 0 AND q.depth = v.depth - 1 AND q.p = v.p[1:v.depth - 1]
"""

#: SQL has no xxhash64 (1, 2), no fitted models (5, 10), no BPE (3, 7), no sequential sampling (6) and no SimHash of parts of lines (9); these are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op4_probminhash": _NEAR, "op8_embedding_near_dedup": _VECTORS, "op11_passage_dedup": _PASSAGES, "op12_sale_enrichment": _SALES, "op13_conversation_trie": _TRIE,
}
