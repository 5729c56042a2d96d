"""Queries about contributors, their routes and rounds over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.operators import contributors, edges
from quillgraph.policies import LENS
from quillgraph.queries import _EDGE_ALBUMS, _EDGES, _PERFORMER_ROLE, _REAL, L, _any, _catalog, _model, _seeds, _SEEDS, _stored, query
from quillgraph.sources.scratch import materialize

_CASES = " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in LENS.role_categories.items())
_CAT = f"[CASE lower(trim(regexp_replace(x, '\\[.*\\]', '', 'g'))) {_CASES} ELSE 'unknown' END for x in string_split(role_text, ',')]"

_INDEX = f"""{_EDGES},
hops AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y, release_id FROM directed),
either AS (SELECT x AS artist_id, y AS other, release_id FROM hops UNION ALL SELECT y, x, release_id FROM hops),
near AS (SELECT artist_id, other, count(*) AS n FROM either GROUP BY 1, 2),
near_list AS (SELECT artist_id, count(*) AS connection_count, list(other ORDER BY n DESC, other)[1:20] AS neighbours FROM near GROUP BY 1),
used AS (SELECT artist_id, release_id, count(*) AS hops FROM either GROUP BY 1, 2),
texts AS (SELECT artist_id, release_id, role_text, count(*) AS n FROM credits WHERE role_text IS NOT NULL GROUP BY 1, 2, 3),
held AS (SELECT artist_id, release_id, role_text, hops * n AS n FROM used JOIN texts USING (artist_id, release_id)),
counted AS (SELECT artist_id, role_text, sum(n) AS n FROM held GROUP BY 1, 2),
examples AS (SELECT artist_id, list(role_text ORDER BY n DESC, role_text)[1:5] AS role_texts FROM counted GROUP BY 1),
kinds AS (SELECT artist_id, list(DISTINCT c ORDER BY c) AS every FROM (SELECT artist_id, unnest({_CAT}) AS c FROM counted) GROUP BY 1),
shown AS (SELECT artist_id, CASE WHEN len(list_filter(every, lambda c: c <> 'unknown')) > 0 THEN list_filter(every, lambda c: c <> 'unknown') ELSE every END AS kinds FROM kinds),
evidence AS (SELECT artist_id, list(CAST(release_id AS VARCHAR) || ':' || role_text ORDER BY CAST(release_id AS VARCHAR), role_text)[1:10] AS evidence FROM (SELECT DISTINCT artist_id, release_id, role_text FROM held) GROUP BY 1),
decades AS (SELECT artist_id, list(DISTINCT CAST(substr(released, 1, 3) || '0' AS INTEGER) ORDER BY CAST(substr(released, 1, 3) || '0' AS INTEGER)) AS decades FROM (SELECT DISTINCT artist_id, release_id FROM held) JOIN releases USING (release_id) GROUP BY 1),
albums AS (SELECT artist_id, list(DISTINCT master_id ORDER BY master_id) AS albums FROM used JOIN releases USING (release_id) GROUP BY 1),
idx AS (SELECT artist_id, coalesce(kinds, ['unknown']) AS kinds, role_texts, albums, decades, connection_count, neighbours, evidence
  FROM near_list JOIN albums USING (artist_id) LEFT JOIN examples USING (artist_id) LEFT JOIN shown USING (artist_id) LEFT JOIN evidence USING (artist_id) LEFT JOIN decades USING (artist_id))"""


def _index(spark, sf_dir):
    m = _model(spark, sf_dir)
    pair = F.least("artist_a_id", "artist_b_id").alias("artist_a_id"), F.greatest("artist_a_id", "artist_b_id").alias("artist_b_id")
    hops = edges.directed_edges(m, LENS).select(*pair, "release_id").distinct().join(m.releases.select("release_id", F.col("master_id").alias("album_a"), F.col("master_id").alias("album_b")), "release_id")
    return contributors.contributor_index(materialize(hops, "hops"), m, LENS)


def _text(c: str, sep: str = ","):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep).alias(c)


@query(f"""WITH {_INDEX} SELECT artist_id, array_to_string(kinds, ',') AS role_categories, array_to_string(role_texts, '|') AS role_texts, array_to_string(albums, ',') AS albums, array_to_string(decades, ',') AS decades, connection_count,
array_to_string(neighbours, ',') AS neighbours, array_to_string(evidence, '|') AS evidence FROM idx""")
def contributor_index(spark, sf_dir):
    i = _index(spark, sf_dir).withColumn("evidence", F.transform("evidence", lambda e: F.concat(e["release_id"].cast("string"), F.lit(":"), e["role_text"])))
    return i.select("artist_id", _text("role_categories"), _text("role_texts", "|"), _text("albums"), _text("decades"), "connection_count", _text("neighbours"), _text("evidence", "|"))


@query(f"""WITH {_INDEX}, n AS (SELECT artist_id, kinds, unnest(neighbours) AS next_id FROM idx),
fit AS (SELECT n.artist_id, n.next_id, row_number() OVER (PARTITION BY n.artist_id ORDER BY o.connection_count, n.next_id) AS rn FROM n JOIN idx o ON o.artist_id = n.next_id WHERE NOT list_has_any(n.kinds, o.kinds))
SELECT idx.artist_id, fit.next_id FROM idx LEFT JOIN fit ON fit.artist_id = idx.artist_id AND rn = 1""")
def interesting_next_step(spark, sf_dir):
    return contributors.interesting_next_step(materialize(_index(spark, sf_dir), "index"))


@query(f"WITH {L.SQL}, v AS (SELECT c.artist_id, c.name, r.released FROM credits c JOIN releases r USING (release_id)), m AS (SELECT artist_id, max(released) AS released FROM v GROUP BY 1) SELECT artist_id, min(name) AS name FROM v JOIN m USING (artist_id, released) GROUP BY 1")
def latest_names(spark, sf_dir):
    m = _model(spark, sf_dir)
    return contributors.latest_names(m.credits.join(m.releases.select("release_id", "released"), "release_id"), "released")


@query(f"""WITH {L.SQL}, c AS (SELECT DISTINCT release_id, artist_id, name, role_text FROM credits WHERE playable_identity)
SELECT release_id, title, released, string_agg(artist_id || '/' || name || '/' || coalesce(role_text, ''), '|' ORDER BY artist_id, name, role_text NULLS FIRST) AS contributors FROM c JOIN releases USING (release_id) GROUP BY 1, 2, 3""")
def release_personnel(spark, sf_dir):
    who = F.transform("contributors", lambda c: F.concat_ws("/", c["artist_id"].cast("string"), c["name"], F.coalesce(c["role_text"], F.lit(""))))
    return contributors.release_personnel(_model(spark, sf_dir)).withColumn("contributors", F.array_join(who, "|"))


@query(f"""WITH {L.SQL}, seeds AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN ' ' || upper(p_name) ELSE p_brand END AS seed FROM part),
named AS (SELECT artist_id, name, count(*) AS n FROM credits GROUP BY 1, 2), f AS (SELECT seed, artist_id, name, n, row_number() OVER (PARTITION BY seed ORDER BY n DESC, artist_id, name) AS rn FROM seeds JOIN named ON lower(trim(seed)) = lower(trim(name))),
a AS (SELECT seed, count(DISTINCT artist_id) AS artists FROM f GROUP BY 1)
SELECT s.seed, CASE WHEN artists = 1 THEN artist_id END AS artist_id, CASE WHEN artists = 1 THEN name END AS matched, CASE WHEN artists = 1 THEN n END AS credits, coalesce(artists, 0) AS artists FROM seeds s LEFT JOIN a USING (seed) LEFT JOIN f ON f.seed = s.seed AND rn = 1""")
def resolve_seeds(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.col("p_brand"))
    return contributors.resolve_seed(_model(spark, sf_dir).credits, L.read(spark, sf_dir, "part").select(name.alias("name")))


@query(f"WITH {_EDGES} SELECT n.artist_id, n.name, coalesce(degree, 0) AS degree FROM names n LEFT JOIN degree USING (artist_id) WHERE name ILIKE '%Ed%' ORDER BY degree DESC NULLS LAST, n.artist_id LIMIT 20")
def search_names(spark, sf_dir):
    m = _model(spark, sf_dir)
    return contributors.search(edges.artist_names(m.credits), "Ed", edges.degrees(edges.credit_edges(m, LENS)))


@query("SELECT doc_id, text LIKE '%Ã%' OR text LIKE '%â€%' OR text LIKE '%Â%' AS odd FROM documents")
def mis_decoded_texts(spark, sf_dir):
    return L.read(spark, sf_dir, "documents").select("doc_id", contributors.mis_decoded(F.col("text")).alias("odd"))


@query(f"WITH {L.SQL} SELECT artist_id, name, count(*) AS credits FROM credits WHERE regexp_matches(lower(trim(name)), '{LENS.placeholder_name_pattern}') GROUP BY 1, 2")
def placeholder_candidates(spark, sf_dir):
    return contributors.placeholder_candidates(_model(spark, sf_dir).credits, LENS)


@query(f"""WITH {L.SQL}, c AS (SELECT DISTINCT release_id, artist_id FROM credits WHERE artist_id > 0 AND {_REAL}), few AS (SELECT release_id FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND {LENS.max_artists_per_release})
SELECT x.artist_id AS artist_a_id, y.artist_id AS artist_b_id, count(*) AS releases, min(release_id) AS release_id FROM c x JOIN c y USING (release_id) JOIN few USING (release_id) WHERE x.artist_id < y.artist_id GROUP BY 1, 2""")
def co_credits(spark, sf_dir):
    return contributors.co_credits(_model(spark, sf_dir), LENS)


@query(f"""WITH {_EDGE_ALBUMS}, ends AS (SELECT DISTINCT artist_id FROM catalog), plays AS (SELECT DISTINCT release_id, artist_id FROM credits WHERE {_PERFORMER_ROLE}),
near AS (SELECT artist_a_id AS e, artist_b_id AS o, release_id, (release_id, artist_a_id) IN (SELECT (release_id, artist_id) FROM plays) AND (release_id, artist_b_id) IN (SELECT (release_id, artist_id) FROM plays) AS ok FROM edges WHERE artist_a_id IN (SELECT artist_id FROM ends)),
one AS (SELECT e AS a, o AS c, release_id, ok FROM near WHERE e < o AND o IN (SELECT artist_id FROM ends)),
two AS (SELECT x.e AS a, y.e AS c, x.o AS bridge, x.release_id AS ra, y.release_id AS rc, x.ok AND y.ok AS ok, row_number() OVER (PARTITION BY x.e, y.e ORDER BY x.o) AS rn FROM near x JOIN near y ON x.o = y.o WHERE x.e < y.e AND x.o <> y.e AND x.o <> x.e AND (x.e, y.e) NOT IN (SELECT (a, c) FROM one)),
best AS (SELECT *, row_number() OVER (PARTITION BY a, c ORDER BY bridge) AS k FROM two WHERE rn <= 8 AND ok)
SELECT a AS artist_a, c AS artist_c, CAST(NULL AS BIGINT) AS bridge, release_id AS release_a, CAST(NULL AS BIGINT) AS release_c FROM one WHERE ok UNION ALL SELECT a, c, bridge, ra, rc FROM best WHERE k = 1""")
def path_rounds(spark, sf_dir):
    m, c = _catalog(spark, sf_dir)
    return contributors.path_rounds(_stored(spark, sf_dir), c.select(F.col("master_id").alias("album_id"), "artist_id"), m.credits, LENS)


_DEMO = f"""{_EDGES}, {_SEEDS},
pairs AS (SELECT artist_a_id AS a, artist_b_id AS b, release_id FROM edges WHERE artist_a_id IN (SELECT artist_id FROM seeds) OR artist_a_id IN (SELECT artist_b_id FROM edges WHERE artist_a_id IN (SELECT artist_id FROM seeds))),
rows_of AS (SELECT p.a, p.b, c.role_text, c.credit_scope IN ('track_artist', 'track_credit') AS on_track FROM pairs p JOIN credits c ON c.release_id = p.release_id AND c.artist_id IN (p.a, p.b)),
scored AS (SELECT a, b, count(*) + count(DISTINCT role_text) + 0.5 * count(*) FILTER (WHERE on_track) AS s FROM rows_of GROUP BY 1, 2),
one AS (SELECT a AS source, b AS target, CAST(NULL AS BIGINT) AS bridge, s AS score FROM scored WHERE a IN (SELECT artist_id FROM seeds)),
two AS (SELECT x.source, y.b AS target, x.target AS bridge, x.score + y.s AS score, row_number() OVER (PARTITION BY x.source, y.b ORDER BY x.score + y.s DESC, x.target) AS rn FROM one x JOIN scored y ON y.a = x.target WHERE y.b <> x.source AND (x.source, y.b) NOT IN (SELECT (source, target) FROM one)),
every AS (SELECT * FROM one UNION ALL SELECT source, target, bridge, score FROM two WHERE rn = 1),
paths AS (SELECT source, target, bridge, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY source) AS k FROM every) WHERE k = 1)"""


def _demo(spark, sf_dir):
    e = _stored(spark, sf_dir)
    return contributors.demo_paths(e, _model(spark, sf_dir).credits, _seeds(e)).withColumn("score", F.col("score").cast("double"))


@query(f"WITH {_DEMO} SELECT * FROM paths")
def demo_paths(spark, sf_dir):
    return _demo(spark, sf_dir)


@query(f"WITH {_DEMO} SELECT * FROM paths ORDER BY score DESC, source, target LIMIT 8")
def curated_demo_paths(spark, sf_dir):
    return contributors.curated_paths(_demo(spark, sf_dir))


_MEASURES = f"""{_EDGES}, {_SEEDS},
ends AS (SELECT x.artist_id AS "start", y.artist_id AS "end" FROM seeds x JOIN seeds y ON x.artist_id < y.artist_id),
one AS (SELECT artist_a_id AS "start", artist_b_id AS node FROM edges WHERE artist_a_id IN (SELECT artist_id FROM seeds)),
two AS (SELECT o."start", e.artist_b_id AS node, count(*) AS n FROM one o JOIN edges e ON e.artist_a_id = o.node WHERE e.artist_b_id <> o."start" AND (o."start", e.artist_b_id) NOT IN (SELECT ("start", node) FROM one) GROUP BY 1, 2),
measured AS (SELECT s."start", s."end", CAST(CASE WHEN o.node IS NOT NULL THEN 1 WHEN t.node IS NOT NULL THEN 2 END AS INTEGER) AS shortest_hops, CASE WHEN o.node IS NOT NULL THEN 1 ELSE t.n END AS equal_routes
  FROM ends s LEFT JOIN one o ON o."start" = s."start" AND o.node = s."end" LEFT JOIN two t ON t."start" = s."start" AND t.node = s."end")"""


def _measures(spark, sf_dir):
    e = _stored(spark, sf_dir)
    s = _seeds(e)
    pairs = s.select(F.col("artist_id").alias("start")).join(s.select(F.col("artist_id").alias("end")), F.col("start") < F.col("end"))
    return contributors.route_measures(e, pairs, 2)


@query(f"WITH {_MEASURES} SELECT * FROM measured")
def route_measures(spark, sf_dir):
    return _measures(spark, sf_dir)


@query(f"WITH {_MEASURES} SELECT count(*) AS pairs, count(shortest_hops) AS with_route, min(equal_routes) AS least, median(equal_routes) AS median, max(equal_routes) AS most, max(shortest_hops) AS longest FROM measured")
def route_summary(spark, sf_dir):
    return contributors.route_summary(_measures(spark, sf_dir))


@query(f"WITH {L.SQL} SELECT DISTINCT role_text, {_any([w for w, c in LENS.role_categories.items() if c in ('production', 'engineering')] or ['-'])} AS behind, role_text IS NOT NULL AND len([y for y in [lower(trim(regexp_replace(x, '\\[.*\\]', '', 'g'))) for x in string_split(role_text, ',')] if y NOT IN {LENS.grading_roles}]) = 0 AS graded FROM credits")
def role_grades(spark, sf_dir):
    r = F.col("role_text")
    return _model(spark, sf_dir).credits.select("role_text").distinct().select(r, R.behind_the_glass(r, LENS).alias("behind"), R.only_graded_roles(r, LENS).alias("graded"))


@query("""WITH r AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 5 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY id) AS turn, list_position(['easy', 'medium', 'hard'], difficulty) AS place FROM r)
SELECT id, difficulty FROM (SELECT * FROM t ORDER BY turn, place, id LIMIT 100)""")
def balanced_rounds(spark, sf_dir):
    k = F.col("o_orderkey")
    r = L.read(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.when(k % 5 == 0, "easy").when(k % 5 == 1, "medium").otherwise("hard").alias("difficulty"))
    return contributors.balanced_cap(r, 100)


@query("""WITH r AS (SELECT l_linenumber > 2 AS solved, l_suppkey % 3 AS clues, l_partkey % 2 AS wrong FROM lineitem), x AS (SELECT CASE WHEN NOT solved THEN 'revealed' WHEN clues = 0 AND wrong = 0 THEN 'clean' ELSE 'with_clues' END AS r FROM r)
SELECT count(*) AS played, count(*) FILTER (WHERE r = 'clean') AS clean, count(*) FILTER (WHERE r = 'with_clues') AS with_clues, count(*) FILTER (WHERE r = 'revealed') AS revealed FROM x""")
def rating_summary(spark, sf_dir):
    t = L.read(spark, sf_dir, "lineitem")
    return contributors.rating_summary(t.select((F.col("l_linenumber") > 2).alias("solved"), (F.col("l_suppkey") % 3).alias("clues"), (F.col("l_partkey") % 2).alias("wrong")))


@query(r"""SELECT DISTINCT p_name, array_to_string([upper(x[1]) || '.' for x in regexp_split_to_array(trim(p_name), '\s+') if regexp_matches(x, '^\p{L}')], ' ') AS initials, nullif(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g'), '') AS slug FROM part""")
def name_forms(spark, sf_dir):
    n = F.col("p_name")
    return L.read(spark, sf_dir, "part").select(n, contributors.initials(n).alias("initials"), contributors.slug(n).alias("slug")).distinct()

