"""Queries about routes within budgets and rebuilt paths, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import albumgraph, edges, enumeration, formats, graph
from quillgraph.policies import LENS
from quillgraph.queries import _any, _bfs, _CAVEATS, _catalog, _EDGE_ALBUMS, _EDGES, _INELIGIBLE, _model, _REAL, _seeds, _SEEDS, _stored, query
from quillgraph.sources.scratch import materialize

#: Budgets low enough to stop some of the pairs of the most connected artists.
_ROUTES, _EXPANSIONS, _REACH, _DEGREE = 1, 300, 16, 12

_ENUMERATED = f"""{_EDGES}, {_SEEDS},
ends AS (SELECT s.artist_id AS "end", d.degree AS one, (SELECT sum(n.degree) FROM edges e JOIN degree n ON n.artist_id = e.artist_b_id WHERE e.artist_a_id = s.artist_id) AS two FROM seeds s JOIN degree d USING (artist_id)),
paid AS (SELECT "end", CASE WHEN one > {_EXPANSIONS} THEN 0 WHEN one + two > {_EXPANSIONS} THEN one ELSE one + two END AS spent, one > {_EXPANSIONS} OR one + two > {_EXPANSIONS} AS over FROM ends),
p AS (SELECT x.artist_id AS "start", y.artist_id AS "end", d.degree AS cost, paid.spent, paid.over, EXISTS (SELECT 1 FROM edges e WHERE e.artist_a_id = x.artist_id AND e.artist_b_id = y.artist_id) AS near
  FROM seeds x JOIN seeds y ON x.artist_id < y.artist_id JOIN degree d ON d.artist_id = x.artist_id JOIN paid ON paid."end" = y.artist_id),
mid AS (SELECT p."start", p."end", x.artist_b_id AS m, d.degree FROM p JOIN edges x ON x.artist_a_id = p."start" JOIN edges y ON y.artist_a_id = x.artist_b_id AND y.artist_b_id = p."end" JOIN degree d ON d.artist_id = x.artist_b_id WHERE x.artist_b_id <> p."end" AND NOT p.over),
m AS (SELECT "start", "end", count(*) AS routes, sum(degree) AS cost FROM mid GROUP BY 1, 2),
one AS (SELECT p."start", p."end", p.cost, p.over, p.near, coalesce(m.routes, 0) AS two_routes, coalesce(m.cost, 0) AS two_cost, p.near AND NOT p.over AND p.spent + p.cost > {_EXPANSIONS} AS stop1,
  CASE WHEN p.near AND NOT p.over AND p.spent + p.cost <= {_EXPANSIONS} THEN p.spent + p.cost ELSE p.spent END AS spent1 FROM p LEFT JOIN m ON m."start" = p."start" AND m."end" = p."end"),
two AS (SELECT *, NOT over AND NOT stop1 AND (near OR two_routes > 0) AS goes FROM one),
three AS (SELECT *, CASE WHEN goes AND spent1 + cost <= {_EXPANSIONS} THEN spent1 + cost ELSE spent1 END AS spent2, goes AND spent1 + cost > {_EXPANSIONS} AS stop2 FROM two),
four AS (SELECT *, CASE WHEN goes AND NOT stop2 AND spent2 + two_cost <= {_EXPANSIONS} THEN spent2 + two_cost ELSE spent2 END AS expansions, stop2 OR (goes AND spent2 + two_cost > {_EXPANSIONS}) AS stopped2 FROM three),
five AS (SELECT *, CASE WHEN near AND NOT over AND NOT stop1 THEN 1 ELSE 0 END AS held1, CASE WHEN goes AND NOT stopped2 THEN two_routes ELSE 0 END AS found2 FROM four),
done AS (SELECT "start", "end", CASE WHEN over THEN NULL WHEN near THEN 1 WHEN two_routes > 0 THEN 2 END AS shortest, CAST(held1 + CASE WHEN near THEN least(found2, {_ROUTES} - held1) ELSE found2 END AS BIGINT) AS routes,
  CAST(CASE WHEN near THEN held1 ELSE found2 END AS BIGINT) AS equal_routes, CAST(expansions AS BIGINT) AS expansions, CASE WHEN over OR stop1 OR stopped2 THEN 'expansions' WHEN near AND held1 + found2 > {_ROUTES} THEN 'routes' END AS stopped,
  CASE WHEN over THEN 0 WHEN stop1 THEN 1 WHEN stopped2 OR (near AND held1 + found2 > {_ROUTES}) THEN 2 END AS stopped_at FROM five)"""


def _enumerated(spark, sf_dir):
    e = _stored(spark, sf_dir)
    s = _seeds(e)
    pairs = graph.seed_pairs(s).select(F.col("seed_a").alias("start"), F.col("seed_b").alias("end"))
    return e, enumeration.enumerate_routes(e, pairs, 2, _ROUTES, _EXPANSIONS)


@query(f"WITH {_ENUMERATED} SELECT * FROM done")
def route_budgets(spark, sf_dir):
    return _enumerated(spark, sf_dir)[1].pairs


@query(f"""WITH {_ENUMERATED}, listed AS (
  SELECT "start", "end", 1 AS hops, concat("start", '-', "end") AS path, 0 AS m FROM five WHERE held1 = 1
  UNION ALL SELECT "start", "end", 2, concat("start", '-', m, '-', "end"), m FROM (SELECT mid.*, five.near, five.held1, row_number() OVER (PARTITION BY mid."start", mid."end" ORDER BY m) AS rn FROM mid JOIN five ON five."start" = mid."start" AND five."end" = mid."end" WHERE found2 > 0) WHERE NOT near OR rn <= {_ROUTES} - held1)
SELECT "start", "end", hops, path FROM listed""")
def route_enumeration(spark, sf_dir):
    found = _enumerated(spark, sf_dir)[1].routes
    return found.select("start", "end", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


_MET = "met AS (SELECT x.seed_id AS seed_a, y.seed_id AS seed_b, x.dist + y.dist AS hops, artist_id AS via FROM d2 x JOIN d2 y USING (artist_id) WHERE x.seed_id < y.seed_id AND x.dist + y.dist <= 3), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_a, seed_b ORDER BY hops, via) AS rn FROM met) WHERE rn = 1)"
_PATHS = """back AS (
  SELECT b.seed_a, b.seed_b, b.hops, TRUE AS ahead, d.artist_id, d.parent_id, d.release_id, d.dist FROM best b JOIN d2 d ON d.seed_id = b.seed_a AND d.artist_id = b.via WHERE d.dist > 0
  UNION ALL SELECT b.seed_a, b.seed_b, b.hops, FALSE, d.artist_id, d.parent_id, d.release_id, d.dist FROM best b JOIN d2 d ON d.seed_id = b.seed_b AND d.artist_id = b.via WHERE d.dist > 0),
steps AS (SELECT * FROM back UNION ALL SELECT b.seed_a, b.seed_b, b.hops, b.ahead, d.artist_id, d.parent_id, d.release_id, d.dist FROM back b JOIN d2 d ON d.seed_id = CASE WHEN b.ahead THEN b.seed_a ELSE b.seed_b END AND d.artist_id = b.parent_id WHERE b.dist = 2),
paths AS (SELECT seed_a, seed_b, hops, CAST(CASE WHEN ahead THEN dist ELSE hops - dist + 1 END AS INTEGER) AS hop, CASE WHEN ahead THEN parent_id ELSE artist_id END AS from_id, CASE WHEN ahead THEN artist_id ELSE parent_id END AS to_id, release_id FROM steps)"""


@query(f"WITH {_EDGE_ALBUMS}, seeds AS (SELECT DISTINCT artist_id FROM catalog), {_bfs(None, 2)}, {_MET}, {_PATHS} SELECT seed_a, seed_b, hop, from_id, to_id, release_id FROM paths")
def connectivity_paths(spark, sf_dir):
    e, (_, c) = _stored(spark, sf_dir), _catalog(spark, sf_dir)
    scored, reached = graph.scored_pairs(e, materialize(c.select("artist_id").distinct(), "ends"), 3)
    return graph.pair_paths(reached, materialize(scored, "scored"))



@query(f"""WITH {_EDGES}, {_SEEDS}, allowed AS (SELECT * FROM edges WHERE release_id % 3 <> 0), {_bfs(None, 2).replace("JOIN edges e", "JOIN allowed e")}, {_MET}, {_PATHS}
SELECT seed_b AS seed_a, seed_a AS seed_b, CAST(hops - hop + 1 AS INTEGER) AS hop, to_id AS from_id, from_id AS to_id, release_id FROM paths""")
def detour_paths(spark, sf_dir):
    e = _stored(spark, sf_dir)
    rest = materialize(graph.without_edges(e, e.where("release_id % 3 = 0 AND artist_a_id < artist_b_id")), "allowed")
    scored, reached = graph.scored_pairs(rest, _seeds(e), 3)
    return graph.reversed_paths(graph.pair_paths(reached, materialize(scored, "scored")))


@query(f"""WITH {_EDGES}, seeds AS (SELECT artist_id FROM degree ORDER BY degree, artist_id LIMIT 40), {_bfs(_DEGREE, 2)},
large AS (SELECT seed_id FROM d2 GROUP BY 1 HAVING count(*) > {_REACH} UNION SELECT seed_id FROM d2 WHERE dist <= 1 GROUP BY 1 HAVING count(*) > {_REACH}),
met AS (SELECT x.seed_id AS seed_a, y.seed_id AS seed_b, x.dist + y.dist AS hops, artist_id AS via FROM d2 x JOIN d2 y USING (artist_id) WHERE x.seed_id < y.seed_id AND x.dist + y.dist <= 3 AND x.seed_id NOT IN (FROM large) AND y.seed_id NOT IN (FROM large)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_a, seed_b ORDER BY hops, via) AS rn FROM met) WHERE rn = 1),
cut AS (SELECT DISTINCT seed_id FROM d2 WHERE dist = 1 AND artist_id IN (SELECT artist_id FROM degree WHERE degree > {_DEGREE})),
judged AS (SELECT a.artist_id AS seed_a, b.artist_id AS seed_b, hops, via, a.artist_id IN (FROM large) OR b.artist_id IN (FROM large) AS big, a.artist_id IN (FROM cut) OR b.artist_id IN (FROM cut) AS hub
  FROM seeds a JOIN seeds b ON a.artist_id < b.artist_id LEFT JOIN best ON seed_a = a.artist_id AND seed_b = b.artist_id)
SELECT seed_a, seed_b, CASE WHEN hops IS NOT NULL THEN 'found' WHEN big OR hub THEN 'skipped' ELSE 'no_path' END AS status, hops, via, CASE WHEN hops IS NOT NULL THEN NULL WHEN big THEN 'reach_too_large' WHEN hub THEN 'frontier_too_large' END AS skip_reason FROM judged""")
def pair_status_bounded(spark, sf_dir):
    e = _stored(spark, sf_dir)
    seeds = materialize(edges.degrees(e).orderBy("degree", "artist_id").limit(40).select("artist_id"), "seeds")
    return graph.scored_pairs(e, seeds, 3, max_degree=_DEGREE, max_rows=_REACH)[0]


_PLAYS = f"{_any(list(LENS.performer_categories))}"


@query(f"""WITH {_EDGE_ALBUMS},
roles AS (SELECT release_id, artist_id, bool_or(role_text IS NOT NULL AND {_PLAYS}) AS plays FROM credits GROUP BY 1, 2),
anchor AS (SELECT -row_number() OVER (ORDER BY master_id) AS a, artist_id, main_release_id FROM catalog),
near AS (SELECT e.*, x.plays OR y.plays AS plays FROM edges e LEFT JOIN roles x ON x.release_id = e.release_id AND x.artist_id = artist_a_id LEFT JOIN roles y ON y.release_id = e.release_id AND y.artist_id = artist_b_id
  WHERE artist_a_id IN (SELECT artist_id FROM catalog) OR artist_b_id IN (SELECT artist_id FROM catalog)),
deg AS (SELECT artist_a_id AS artist_id, count(*) AS degree FROM near GROUP BY 1),
member AS (SELECT DISTINCT a, m FROM anchor JOIN (SELECT release_id, artist_id AS m FROM credits WHERE {_REAL} AND NOT {_INELIGIBLE}) c ON c.release_id = main_release_id),
f AS (SELECT release_id, {_CAVEATS} FROM release_formats GROUP BY 1), severity AS (SELECT release_id, CAST(CASE WHEN t0 = 1 THEN 3 WHEN t1 = 1 THEN 2 WHEN t2 = 1 THEN 1 ELSE 0 END AS INTEGER) AS s FROM f),
hop AS (SELECT artist_a_id AS x, artist_b_id AS y, coalesce(s, 0) AS s, CASE WHEN plays THEN 0 ELSE 1 END AS weak FROM near LEFT JOIN severity USING (release_id)),
every AS (
  SELECT p.a AS "start", q.a AS "end", 2 AS depth, [p.a, p.m, q.a] AS path, 0 AS severity, 0 AS weak_hops, coalesce(d.degree, 0) AS hub_degree FROM member p JOIN member q ON p.m = q.m AND p.a > q.a LEFT JOIN deg d ON d.artist_id = p.m
  UNION ALL SELECT p.a, q.a, 3, [p.a, h.x, h.y, q.a], h.s, h.weak, greatest(coalesce(d.degree, 0), coalesce(e.degree, 0)) FROM member p JOIN hop h ON h.x = p.m JOIN member q ON q.m = h.y AND p.a > q.a LEFT JOIN deg d ON d.artist_id = h.x LEFT JOIN deg e ON e.artist_id = h.y),
least_ AS (SELECT "start", "end", min(depth) AS l, min(CASE WHEN depth = l0 THEN severity END) AS best FROM (SELECT *, min(depth) OVER (PARTITION BY "start", "end") AS l0 FROM every) GROUP BY 1, 2),
ranked AS (SELECT e.*, l, row_number() OVER (PARTITION BY "start", "end" ORDER BY severity, hub_degree, weak_hops, depth, path) AS rn FROM every e JOIN least_ USING ("start", "end") WHERE depth = l OR (depth = l + 1 AND severity < best))
SELECT "start", "end", depth - 2 AS hops, array_to_string(path, '|') AS path, severity, CAST(hub_degree AS BIGINT) AS hub_degree, CAST(weak_hops AS BIGINT) AS weak_hops, depth > l AS longer, FALSE AS degraded FROM ranked WHERE rn = 1""")
def recommended_routes_near(spark, sf_dir):
    m, c = _catalog(spark, sf_dir)
    albums = materialize(c, "albums")
    g = albumgraph.anchored_graph(m, _stored(spark, sf_dir), albums, LENS)
    a = albumgraph.anchors(albums).select("anchor_id")
    pairs = a.select(F.col("anchor_id").alias("start")).join(a.select(F.col("anchor_id").alias("end")), F.col("start") > F.col("end"))
    return albumgraph.recommended_routes(g, materialize(pairs, "pairs"), formats.release_caveats(m, LENS), LENS, max_hops=1, max_expansions=10**9)
