"""All queries over the test tables by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.operators import albumgraph, analyses, artifacts, centrality, edges, expand, formats, graph, quality, rank, rounds, routes
from quillgraph.plans import lens as L
from quillgraph.policies import LENS
from quillgraph.sources import html
from quillgraph.sources.scratch import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _model(spark: SparkSession, sf_dir: str) -> L.Model:
    return L.lens(spark, sf_dir)


# ---- SQL building blocks (the other engine's side of the comparison)

_NORM = "lower(trim(regexp_replace(x, '\\[.*\\]', '', 'g')))"
_COMP = f"[{_NORM} for x in string_split(role_text, ',')]"


def _any(words) -> str:
    return f"coalesce(list_has_any({_COMP}, [{', '.join(repr(w) for w in words)}]), FALSE)"


def _other_than(words) -> str:
    return f"len([y for y in {_COMP} if y NOT IN ({', '.join(repr(w) for w in words)})]) > 0"


_INELIGIBLE = f"(role_text IS NOT NULL AND NOT ({_other_than(LENS.non_collaborative_roles)}))"
_PERFORMER_CREDIT = f"(role_text IS NULL OR {_other_than(LENS.non_performer_roles)})"
_PERFORMER_ROLE = f"(role_text IS NOT NULL AND {_any(LENS.performer_categories)})"
_REAL = f"artist_id % {LENS.placeholder_modulus} <> 0"
_EDGES = f"""
{L.SQL},
edge_credits AS (
  SELECT c.release_id, c.track_index, c.credit_scope, c.artist_id FROM credits c JOIN releases r USING (release_id)
  WHERE c.artist_id > 0 AND {_REAL} AND NOT {_INELIGIBLE} AND NOT regexp_matches(lower(r.title), '{LENS.variant_release_pattern}')),
shape AS (
  SELECT release_id, count(DISTINCT CASE WHEN credit_scope = 'track_artist' THEN artist_id END) AS ta,
         count(DISTINCT CASE WHEN credit_scope = 'release_artist' THEN artist_id END) AS ba, count(DISTINCT artist_id) AS n
  FROM edge_credits GROUP BY 1),
album AS (SELECT release_id FROM shape WHERE ta < {LENS.compilation_threshold} AND n BETWEEN 2 AND {LENS.max_artists_per_release}),
single AS (SELECT release_id FROM shape WHERE ba = 1),
tracks AS (SELECT release_id, track_index FROM edge_credits WHERE track_index IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT artist_id) <= {LENS.max_artists_per_track}),
billed AS (SELECT DISTINCT release_id, artist_id FROM edge_credits WHERE credit_scope = 'release_artist'),
own AS (SELECT DISTINCT release_id, track_index, artist_id FROM edge_credits WHERE credit_scope = 'track_artist' AND track_index IS NOT NULL),
performers AS (
  SELECT * FROM own UNION
  SELECT t.release_id, t.track_index, b.artist_id FROM tracks t JOIN single USING (release_id) JOIN album USING (release_id) JOIN billed b USING (release_id)
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.release_id = t.release_id AND o.track_index = t.track_index)),
same_recording AS (
  SELECT p.artist_id AS a, c.artist_id AS b, p.release_id FROM performers p JOIN edge_credits c USING (release_id, track_index) JOIN tracks USING (release_id, track_index)
  WHERE p.artist_id <> c.artist_id AND c.credit_scope <> 'track_artist'
    AND ((p.release_id, p.artist_id) IN (SELECT (release_id, artist_id) FROM billed) OR (p.release_id, c.artist_id) IN (SELECT (release_id, artist_id) FROM billed))),
co_performers AS (
  SELECT p.artist_id AS a, q.artist_id AS b, p.release_id FROM performers p JOIN performers q USING (release_id, track_index) JOIN album USING (release_id) JOIN tracks USING (release_id, track_index)
  JOIN billed x ON x.release_id = p.release_id AND x.artist_id = p.artist_id JOIN billed y ON y.release_id = p.release_id AND y.artist_id = q.artist_id WHERE p.artist_id <> q.artist_id),
release_scope AS (
  SELECT b.artist_id AS a, c.artist_id AS b, b.release_id FROM billed b JOIN edge_credits c USING (release_id) JOIN album USING (release_id)
  WHERE c.credit_scope = 'release_credit' AND b.artist_id <> c.artist_id),
directed AS (
  SELECT a, b, release_id, 'same_recording' AS rule FROM same_recording UNION ALL SELECT b, a, release_id, 'same_recording' FROM same_recording
  UNION ALL SELECT a, b, release_id, 'co_performers' FROM co_performers
  UNION ALL SELECT a, b, release_id, 'release_scope' FROM release_scope UNION ALL SELECT b, a, release_id, 'release_scope' FROM release_scope),
edges AS (SELECT a AS artist_a_id, b AS artist_b_id, min(release_id) AS release_id FROM directed GROUP BY 1, 2),
degree AS (SELECT artist_a_id AS artist_id, count(*) AS degree FROM edges GROUP BY 1),
names AS (
  SELECT artist_id, name FROM (SELECT artist_id, name, row_number() OVER (PARTITION BY artist_id ORDER BY count(*) DESC, name) AS rn FROM credits WHERE artist_id > 0 GROUP BY 1, 2) WHERE rn = 1)
"""
_SEEDS = "seeds AS (SELECT artist_id FROM degree ORDER BY degree DESC, artist_id LIMIT 12)"
_CAVEATS = ", ".join(f"max(list_has_any(descriptions, [{', '.join(repr(w) for w in tier)}]))::INT AS t{i}" for i, tier in enumerate(LENS.caveat_tiers))


def _edges(spark, sf_dir):
    return edges.credit_edges(_model(spark, sf_dir), LENS)


def _stored(spark, sf_dir):
    """The edge relation written once, for queries that read it again and again."""
    return materialize(_edges(spark, sf_dir), "edges")


def _seeds(e: DataFrame, n: int = 12) -> DataFrame:
    return materialize(edges.degrees(e).orderBy(F.desc("degree"), "artist_id").limit(n).select("artist_id"), "seeds")


# ---- edges and graph


@query(f"WITH {_EDGES} SELECT * FROM edges")
def credit_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {_EDGES} SELECT rule, count(*) AS rows, count(DISTINCT release_id) AS releases FROM directed GROUP BY rule")
def edge_rules(spark, sf_dir):
    return edges.directed_edges(_model(spark, sf_dir), LENS).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("release_id").alias("releases"))


@query(f"WITH {_EDGES} SELECT release_id, ta AS track_artists, ba AS billed, n AS artists, ta < {LENS.compilation_threshold} AND n BETWEEN 2 AND {LENS.max_artists_per_release} AS album, ba = 1 AS single FROM shape")
def release_shapes(spark, sf_dir):
    return edges.release_shapes(edges.edge_credits(_model(spark, sf_dir), LENS), LENS)


@query(f"""WITH {_EDGES}, flags AS (SELECT release_id, {_CAVEATS} FROM release_formats GROUP BY 1),
ranked AS (SELECT a, b, d.release_id, row_number() OVER (PARTITION BY a, b ORDER BY coalesce(t0, 0) * 4 + coalesce(t1, 0) * 2 + coalesce(t2, 0), NOT master_is_main_release, d.release_id) AS rn
  FROM (SELECT DISTINCT a, b, release_id FROM directed) d JOIN releases USING (release_id) LEFT JOIN flags USING (release_id))
SELECT a AS artist_a_id, b AS artist_b_id, release_id FROM ranked WHERE rn = 1""")
def edges_preferred(spark, sf_dir):
    return edges.credit_edges(_model(spark, sf_dir), LENS, preference=edges.EvidencePreference())


@query(f"WITH {_EDGES} SELECT artist_id, degree FROM degree")
def edge_degree(spark, sf_dir):
    return edges.degrees(_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT artist_id, name FROM names")
def artist_names(spark, sf_dir):
    return edges.artist_names(_model(spark, sf_dir).credits)


@query(f"WITH {_EDGES} SELECT artist_id, name, degree FROM (SELECT * FROM degree ORDER BY degree DESC, artist_id LIMIT 20) JOIN names USING (artist_id)")
def top_connected(spark, sf_dir):
    return edges.top_connected(_model(spark, sf_dir), LENS)


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM degree) AS artists, (SELECT max(degree) FROM degree) AS max_degree, CAST(count(*) // 2 AS BIGINT) AS edges, count(DISTINCT release_id) AS evidence_releases FROM edges")
def graph_stats(spark, sf_dir):
    return edges.graph_stats(_stored(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT degree, count(*) AS artists FROM degree GROUP BY degree")
def degree_distribution(spark, sf_dir):
    return analyses.degree_distribution(_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT artist_a_id, artist_b_id, release_id FROM edges WHERE artist_a_id < artist_b_id")
def graph_snapshot_edges(spark, sf_dir):
    return _edges(spark, sf_dir).where("artist_a_id < artist_b_id")


@query(f"WITH {_EDGES}, {_SEEDS} SELECT s.artist_id, e.artist_b_id AS neighbor_id, e.release_id FROM seeds s LEFT JOIN edges e ON e.artist_a_id = s.artist_id")
def neighbors(spark, sf_dir):
    e = _stored(spark, sf_dir)
    return graph.neighbors(e, _seeds(e))


def _bfs(cap: int | None, hops: int) -> str:
    open_ = "" if cap is None else f"AND p.artist_id IN (SELECT artist_id FROM degree WHERE degree <= {cap})"
    sql = "d0 AS (SELECT artist_id AS seed_id, artist_id, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS BIGINT) AS release_id, 0 AS dist FROM seeds)"
    seen = "d0"
    for d in range(1, hops + 1):
        sql += f""", n{d} AS (SELECT seed_id, artist_id, parent_id, release_id, {d} AS dist FROM (
  SELECT p.seed_id, e.artist_b_id AS artist_id, e.artist_a_id AS parent_id, e.release_id, row_number() OVER (PARTITION BY p.seed_id, e.artist_b_id ORDER BY e.release_id, e.artist_a_id) AS rn
  FROM {seen} p JOIN edges e ON e.artist_a_id = p.artist_id WHERE p.dist = {d - 1} {open_ if d > 1 else ""}
    AND (p.seed_id, e.artist_b_id) NOT IN (SELECT (seed_id, artist_id) FROM {seen})) WHERE rn = 1),
d{d} AS (SELECT * FROM {seen} UNION ALL SELECT * FROM n{d})"""
        seen = f"d{d}"
    return sql


@query(f"WITH {_EDGES}, {_SEEDS}, {_bfs(None, 2)} SELECT * FROM d2")
def reach(spark, sf_dir):
    e = _stored(spark, sf_dir)
    return graph.reach(e, _seeds(e), 2)


@query(f"WITH {_EDGES}, {_SEEDS}, {_bfs(40, 2)} SELECT seed_id, dist, count(*) AS artists FROM d2 GROUP BY 1, 2")
def reach_by_distance(spark, sf_dir):
    e = _stored(spark, sf_dir)
    return graph.reach(e, _seeds(e), 2, max_degree=40).groupBy("seed_id", "dist").agg(F.count(F.lit(1)).alias("artists"))


_MET = "met AS (SELECT x.seed_id AS seed_a, y.seed_id AS seed_b, x.dist + y.dist AS hops, artist_id FROM d2 x JOIN d2 y USING (artist_id) WHERE x.seed_id < y.seed_id AND x.dist + y.dist <= 3)"


@query(f"WITH {_EDGES}, {_SEEDS}, {_bfs(None, 2)}, {_MET} SELECT seed_a, seed_b, hops, artist_id AS via FROM (SELECT *, row_number() OVER (PARTITION BY seed_a, seed_b ORDER BY hops, artist_id) AS rn FROM met) WHERE rn = 1")
def pair_distances(spark, sf_dir):
    e = _stored(spark, sf_dir)
    return graph.pair_distances(graph.reach(e, _seeds(e), 2), 3)


@query(f"""WITH {_EDGES}, seeds AS (SELECT artist_id FROM degree ORDER BY degree, artist_id LIMIT 12), {_bfs(25, 2)}, {_MET},
best AS (SELECT seed_a, seed_b, hops, artist_id AS via FROM (SELECT *, row_number() OVER (PARTITION BY seed_a, seed_b ORDER BY hops, artist_id) AS rn FROM met) WHERE rn = 1),
cut AS (SELECT DISTINCT seed_id FROM d2 WHERE dist = 1 AND artist_id IN (SELECT artist_id FROM degree WHERE degree > 25))
SELECT a.artist_id AS seed_a, b.artist_id AS seed_b, CASE WHEN hops IS NOT NULL THEN 'found' WHEN a.artist_id IN (SELECT seed_id FROM cut) OR b.artist_id IN (SELECT seed_id FROM cut) THEN 'skipped' ELSE 'no_path' END AS status, hops, via
FROM seeds a JOIN seeds b ON a.artist_id < b.artist_id LEFT JOIN best ON seed_a = a.artist_id AND seed_b = b.artist_id""")
def pair_status(spark, sf_dir):
    e = _stored(spark, sf_dir)
    seeds = materialize(edges.degrees(e).orderBy("degree", "artist_id").limit(12).select("artist_id"), "seeds")
    return graph.pair_status(e, seeds, 3, max_degree=25)


@query(f"""WITH {_EDGES}, facts AS (
  SELECT release_id, artist_id, max(credit_scope = 'release_artist') AS billed, max(role_text IS NULL OR {_other_than(LENS.grading_roles)}) AS performs, list(DISTINCT track_index) FILTER (WHERE track_index IS NOT NULL) AS tracks FROM credits GROUP BY 1, 2)
SELECT e.artist_a_id, e.artist_b_id, e.release_id,
  CASE WHEN a.billed AND b.billed THEN 'co_billed_release_artists' WHEN a.billed OR b.billed OR a.performs OR b.performs THEN 'performer_credit' ELSE 'non_performer_only' END AS strength,
  CASE WHEN coalesce(list_has_any(a.tracks, b.tracks), FALSE) OR (a.billed AND b.tracks IS NOT NULL) OR (b.billed AND a.tracks IS NOT NULL) THEN 'same_recording' ELSE 'release_scope_credit' END AS scope,
  artist_a_id IN {LENS.flagged_ids} OR artist_b_id IN {LENS.flagged_ids} AS placeholder
FROM edges e JOIN facts a ON a.release_id = e.release_id AND a.artist_id = artist_a_id JOIN facts b ON b.release_id = e.release_id AND b.artist_id = artist_b_id WHERE artist_a_id < artist_b_id""")
def hop_quality(spark, sf_dir):
    m = _model(spark, sf_dir)
    return graph.hop_quality(m, edges.credit_edges(m, LENS), LENS)


@query(f"WITH {_EDGES}, {_SEEDS} SELECT * FROM edges WHERE artist_a_id < artist_b_id AND (artist_a_id IN (SELECT artist_id FROM seeds) OR artist_b_id IN (SELECT artist_id FROM seeds))")
def ego_network(spark, sf_dir):
    e = _stored(spark, sf_dir)
    return graph.ego_network(e, _seeds(e))


@query(f"""WITH {_EDGES} SELECT artist_a_id AS node, CAST(coalesce(sum(count(*)) OVER (ORDER BY artist_a_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", count(*) AS degree,
array_to_string(list(artist_b_id ORDER BY artist_b_id), ',') AS neighbours FROM edges GROUP BY artist_a_id""")
def csr_offsets(spark, sf_dir):
    return routes.csr(_stored(spark, sf_dir))


@query(f"""WITH {_EDGES}, {_SEEDS}, top AS (
  SELECT s.artist_id, e.artist_b_id AS neighbor_id, d.degree, row_number() OVER (PARTITION BY s.artist_id ORDER BY d.degree DESC, e.artist_b_id) AS rn, count(*) OVER (PARTITION BY s.artist_id) AS n
  FROM seeds s JOIN edges e ON e.artist_a_id = s.artist_id JOIN degree d ON d.artist_id = e.artist_b_id)
SELECT artist_id, neighbor_id, degree, n > 24 AS truncated FROM top WHERE rn <= 24""")
def explorer_view(spark, sf_dir):
    e = _stored(spark, sf_dir)
    return routes.explorer_view(e, _seeds(e))


@query(f"""WITH {_EDGES}, {_SEEDS}, walk AS (
  SELECT a.artist_id AS "start", b.artist_id AS "end", x.artist_b_id AS m FROM seeds a JOIN seeds b ON a.artist_id < b.artist_id JOIN edges x ON x.artist_a_id = a.artist_id JOIN edges y ON y.artist_a_id = x.artist_b_id AND y.artist_b_id = b.artist_id
  WHERE x.artist_b_id <> b.artist_id),
ranked AS (SELECT w.*, d.degree, row_number() OVER (PARTITION BY "start", "end" ORDER BY d.degree, m) AS rn FROM walk w JOIN degree d ON d.artist_id = m)
SELECT "start", "end", CAST(rn AS INTEGER) AS rank, concat("start", '-', m, '-', "end") AS path, degree AS hub_degree, CAST(degree AS BIGINT) AS degree_sum FROM ranked WHERE rn <= 3""")
def ranked_routes(spark, sf_dir):
    e = _stored(spark, sf_dir)
    s = _seeds(e)
    pairs = s.select(F.col("artist_id").alias("start")).join(s.select(F.col("artist_id").alias("end")), F.col("start") < F.col("end"))
    return routes.ranked_routes(e, pairs, 2)


@query(f"""WITH RECURSIVE {_EDGES}, labels(artist_id, component) USING KEY (artist_id) AS (
  SELECT artist_id, artist_id FROM degree
  UNION SELECT e.artist_b_id, min(l.component) FROM labels l JOIN edges e ON e.artist_a_id = l.artist_id JOIN recurring.labels r ON r.artist_id = e.artist_b_id WHERE l.component < r.component GROUP BY 1)
SELECT artist_id, component FROM labels""")
def component_labels(spark, sf_dir):
    return graph.label_components(_stored(spark, sf_dir))


@query()
def label_communities(spark, sf_dir):
    return analyses.label_communities(_stored(spark, sf_dir))


@query()
def modularity_communities(spark, sf_dir):
    return centrality.modularity_communities(_stored(spark, sf_dir))[0]


@query()
def betweenness(spark, sf_dir):
    return centrality.betweenness(_stored(spark, sf_dir))


# ---- roles, titles, formats, masters

_ROLES = f"WITH {L.SQL}, roles AS (SELECT role_text, count(*) AS credits FROM credits GROUP BY 1)"
_CASE = " ".join(f"WHEN y = '{w}' THEN '{c}'" for w, c in LENS.role_categories.items())
_CATS = f"CASE WHEN role_text IS NULL OR trim(role_text) = '' THEN ['unknown'] ELSE [CASE {_CASE} ELSE 'unknown' END for y in {_COMP}] END"


def _roles(spark, sf_dir):
    return _model(spark, sf_dir).credits.groupBy("role_text").agg(F.count(F.lit(1)).alias("credits"))


@query(f"{_ROLES} SELECT role_text, credits, array_to_string(list_sort(list_distinct({_CATS})), ',') AS categories, coalesce([z for z in {_CATS} if z <> 'unknown'][1], 'unknown') AS primary_category FROM roles")
def role_categories(spark, sf_dir):
    c = R.role_categories(F.col("role_text"), LENS)
    return _roles(spark, sf_dir).select("role_text", "credits", F.array_join(F.sort_array(c), ",").alias("categories"), R.primary_category(c).alias("primary_category"))


@query(f"{_ROLES} SELECT role_text, {_INELIGIBLE} AS ineligible, {_PERFORMER_CREDIT} AS performer_credit, {_PERFORMER_ROLE} AS performer_role FROM roles")
def role_predicates(spark, sf_dir):
    r = F.col("role_text")
    return _roles(spark, sf_dir).select("role_text", R.edge_ineligible(r, LENS).alias("ineligible"), R.performer_credit(r, LENS).alias("performer_credit"), R.performer_role(r, LENS).alias("performer_role"))


@query(f"""{_ROLES} SELECT role_text, CASE WHEN role_text IS NULL THEN 'performer' ELSE coalesce([CASE {' '.join(f"WHEN y = '{w}' THEN '{c}'" for w, c in LENS.performer_categories.items())} END for y in {_COMP} if y IN ({', '.join(repr(w) for w in LENS.performer_categories)})][1], 'performer') END AS category,
role_text IS NOT NULL AND {_any(['small'])} AS guitar, role_text IS NOT NULL AND {_any(['medium', 'large'])} AS rhythm FROM roles""")
def performer_categories(spark, sf_dir):
    r = F.col("role_text")
    return _roles(spark, sf_dir).select("role_text", R.performer_category(r, LENS).alias("category"), R.instrument_role(r, LENS, ["guitar"]).alias("guitar"), R.instrument_role(r, LENS, ["bass", "drums"]).alias("rhythm"))


_EXCLUDED = " ".join(f"WHEN list_contains(d, '{w}') THEN '{s}'" for w, s in LENS.excluded_descriptors.items())
_SIGNALS = " || ".join(f"CASE WHEN list_contains(d, '{w}') THEN ['{s}'] ELSE [] END" for w, s in LENS.excluded_descriptors.items())
_POLICY = f"""{L.SQL}, described AS (SELECT release_id, list_distinct(flatten(list([lower(trim(x)) for x in descriptions]))) AS d FROM release_formats GROUP BY 1),
judged AS (SELECT r.release_id, r.title, d, {_SIGNALS} AS x, list_contains(d, '{LENS.album_descriptor}') AS album, regexp_matches(lower(r.title), '{LENS.live_title_pattern}') AS live FROM releases r LEFT JOIN described USING (release_id)),
policy AS (SELECT release_id, title, CASE WHEN d IS NULL THEN 'review' WHEN len(x) > 0 THEN 'exclude' WHEN album AND NOT live THEN 'allow' ELSE 'review' END AS decision,
  CASE WHEN d IS NULL THEN ['missing_formats'] WHEN len(x) > 0 THEN x WHEN album AND live THEN ['explicit_album', 'title_signals_live_or_soundtrack'] WHEN album THEN ['explicit_album'] ELSE ['album_descriptor_missing'] END AS signals FROM judged)"""


@query(f"WITH {_POLICY} SELECT release_id, decision, CASE WHEN decision = 'allow' THEN 'studio_album' ELSE 'unknown' END AS shape, array_to_string(signals, ',') AS signals FROM policy")
def format_policy(spark, sf_dir):
    return formats.format_policy(_model(spark, sf_dir), LENS)


@query(f"WITH {_POLICY} SELECT release_id FROM policy WHERE decision = 'allow'")
def format_index(spark, sf_dir):
    return formats.scoring_index(formats.format_policy(_model(spark, sf_dir), LENS))


@query(f"WITH {_POLICY} SELECT CASE WHEN regexp_matches(lower(title), '{LENS.variant_release_pattern}') THEN 'title_exclude' ELSE 'title_keep' END AS title_filter, decision, count(*) AS releases FROM policy GROUP BY 1, 2")
def policy_shadow(spark, sf_dir):
    return formats.shadow_report(_model(spark, sf_dir), LENS)


@query(f"WITH {L.SQL}, f AS (SELECT release_id, {_CAVEATS} FROM release_formats GROUP BY 1) SELECT release_id, CAST(t0 * 4 + t1 * 2 + t2 AS INTEGER) AS caveats, CAST(CASE WHEN t0 = 1 THEN 3 WHEN t1 = 1 THEN 2 WHEN t2 = 1 THEN 1 ELSE 0 END AS INTEGER) AS severity FROM f")
def caveat_flags(spark, sf_dir):
    return formats.release_caveats(_model(spark, sf_dir), LENS)


@query(f"WITH {L.SQL} SELECT master_id, lower(genres[1]) IN ({', '.join(repr(g) for g in LENS.non_studio_genres)}) AS non_studio FROM masters")
def master_gate(spark, sf_dir):
    return _model(spark, sf_dir).masters.select("master_id", R.non_studio_master(F.col("genres"), F.col("styles"), LENS).alias("non_studio"))


# ---- validation and profiles


@query(f"""WITH {L.SQL} SELECT (SELECT count(*) FROM releases) AS releases, (SELECT count(DISTINCT release_id) FROM releases) AS distinct_releases, (SELECT count(DISTINCT master_id) FROM releases) AS masters,
count(*) AS credits, count(artist_id) AS linked_credits, count(*) FILTER (WHERE playable_identity) AS playable_credits, count(DISTINCT artist_id) AS artists, count(DISTINCT CASE WHEN credit_scope = 'release_artist' THEN artist_id END) AS billed_artists,
(SELECT count(*) FROM credits c ANTI JOIN releases USING (release_id)) AS orphan_credits, (SELECT count(*) FROM release_formats f ANTI JOIN releases USING (release_id)) AS orphan_formats FROM credits""")
def validate_metrics(spark, sf_dir):
    return quality.dataset_metrics(_model(spark, sf_dir))


_NULLS = ("track_index", "track_title", "artist_id", "role_text")


@query(f"WITH {L.SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls FROM credits" for c in _NULLS))
def null_profile(spark, sf_dir):
    return quality.null_profile(_model(spark, sf_dir).credits, list(_NULLS))


@query(f"WITH {L.SQL} SELECT CASE WHEN released IS NULL OR trim(released) = '' THEN 'empty' WHEN regexp_matches(released, '^[0-9]{{4}}$') THEN 'year' WHEN regexp_matches(released, '^[0-9]{{4}}-[0-9]{{2}}-00$') THEN 'year_month' WHEN regexp_matches(released, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'full_date' ELSE 'other' END AS shape, count(*) AS rows FROM releases GROUP BY 1")
def date_shapes(spark, sf_dir):
    return quality.date_shapes(_model(spark, sf_dir).releases, "released")


@query(f"WITH {L.SQL} SELECT CASE WHEN role_text IS NULL THEN 'null' WHEN length(role_text) <= 8 THEN 'short' WHEN length(role_text) <= 14 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS credits, CAST(coalesce(max(length(role_text)), 0) AS INTEGER) AS longest FROM credits GROUP BY 1")
def role_length_buckets(spark, sf_dir):
    return quality.role_lengths(_model(spark, sf_dir))


@query(f"WITH {L.SQL} SELECT country AS value, count(*) AS rows FROM releases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def topn_countries(spark, sf_dir):
    return quality.top_counts(_model(spark, sf_dir).releases, "country", 10)


@query(f"WITH {L.SQL} SELECT role_text AS value, count(*) AS rows FROM credits GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10")
def topn_roles(spark, sf_dir):
    return quality.top_counts(_model(spark, sf_dir).credits, "role_text", 10)


@query(f"WITH {L.SQL} SELECT (SELECT count(*) FROM credits) / (SELECT count(*) FROM releases) AS credits_per_release, (SELECT count(*) FROM release_formats) / (SELECT count(*) FROM releases) AS formats_per_release")
def per_release_averages(spark, sf_dir):
    return quality.per_release_averages(_model(spark, sf_dir))


@query(f"WITH {L.SQL} SELECT CAST(substr(released, 1, 3) || '0' AS INTEGER) AS decade, count(*) AS releases, CAST(min(substr(released, 1, 4)) AS INTEGER) AS first_year, CAST(max(substr(released, 1, 4)) AS INTEGER) AS last_year FROM releases GROUP BY 1")
def decades(spark, sf_dir):
    return quality.decades(_model(spark, sf_dir))


@query(f"WITH {L.SQL}, k AS (SELECT len([z for z in {_CATS} if z <> 'unknown']) > 0 AS known FROM credits) SELECT count(*) AS credits, count(*) FILTER (WHERE known) AS classified, round(100.0 * count(*) FILTER (WHERE known) / count(*), 2) AS percent FROM k")
def role_coverage(spark, sf_dir):
    return quality.role_coverage(_model(spark, sf_dir), LENS)


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_lines(spark, sf_dir):
    return quality.duplicate_keys(L.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {L.SQL} SELECT artist_id, min(name) AS name, count(DISTINCT release_id) AS releases FROM credits WHERE regexp_matches(lower(name), '\\b(red|blue)\\b') GROUP BY 1 HAVING count(DISTINCT release_id) >= 20")
def placeholder_audit(spark, sf_dir):
    return quality.placeholder_candidates(_model(spark, sf_dir), r"\b(red|blue)\b", 20)


# ---- corpora

_FRONTIER = f"""{L.SQL}, seed AS (SELECT release_id FROM releases WHERE country = 'NATION_1' OR release_id % 997 = 1),
frontier AS (SELECT DISTINCT artist_id FROM credits WHERE {_REAL} AND {_PERFORMER_CREDIT} AND release_id IN (SELECT release_id FROM seed)),
retained AS (SELECT DISTINCT release_id FROM credits WHERE {_PERFORMER_CREDIT} AND artist_id IN (SELECT artist_id FROM frontier))"""


def _seed_releases(m):
    return m.releases.where("country = 'NATION_1' OR release_id % 997 = 1").select("release_id")


@query(f"WITH {_FRONTIER} SELECT artist_id FROM frontier")
def onehop_frontier(spark, sf_dir):
    m = _model(spark, sf_dir)
    return expand.frontier_artists(m, _seed_releases(m), LENS)


@query(f"WITH {_FRONTIER} SELECT release_id FROM retained")
def onehop_retained(spark, sf_dir):
    m = _model(spark, sf_dir)
    return expand.retained_releases(m, expand.frontier_artists(m, _seed_releases(m), LENS), LENS)


@query(f"WITH {_FRONTIER} SELECT c.release_id, track_index, credit_scope, artist_id, role_text FROM credits c SEMI JOIN retained USING (release_id)")
def onehop_credits(spark, sf_dir):
    m = _model(spark, sf_dir)
    return expand.expand_one_hop(m, _seed_releases(m), LENS).model.credits.select("release_id", "track_index", "credit_scope", "artist_id", "role_text")


@query(f"""WITH {_FRONTIER}, kept AS (SELECT c.* FROM credits c SEMI JOIN retained USING (release_id)), anchored AS (SELECT DISTINCT k.release_id FROM kept k SEMI JOIN frontier USING (artist_id) WHERE {_PERFORMER_CREDIT})
SELECT (SELECT count(*) FROM kept ANTI JOIN (SELECT release_id FROM releases SEMI JOIN retained USING (release_id)) USING (release_id)) AS orphan_credits,
(SELECT count(*) FROM (SELECT f.* FROM release_formats f SEMI JOIN retained USING (release_id)) ANTI JOIN (SELECT release_id FROM releases SEMI JOIN retained USING (release_id)) USING (release_id)) AS orphan_formats,
(SELECT count(*) FROM (SELECT release_id FROM releases SEMI JOIN retained USING (release_id)) ANTI JOIN anchored USING (release_id)) AS unanchored_releases,
(SELECT count(*) FROM seed ANTI JOIN retained USING (release_id)) AS lost_seeds""")
def onehop_selfcheck(spark, sf_dir):
    m = _model(spark, sf_dir)
    return expand.self_check(expand.expand_one_hop(m, _seed_releases(m), LENS), LENS)


@query(f"WITH {L.SQL} SELECT release_id FROM releases WHERE release_id IN (SELECT release_id FROM credits WHERE artist_id IN (5, 10, 15) AND {_PERFORMER_CREDIT})")
def topic_corpus(spark, sf_dir):
    m = _model(spark, sf_dir)
    return expand.topic_corpus(m, graph.ids_frame(spark, [5, 10, 15]), LENS).model.releases.select("release_id")


# ---- albums

_SCORES = f"""{L.SQL},
variants AS (SELECT master_id, count(*) AS variant_count, min(release_id) FILTER (WHERE master_is_main_release) AS main_release_id FROM releases GROUP BY 1),
counts AS (SELECT master_id, count(*) AS credit_rows FROM credits JOIN releases USING (release_id) GROUP BY 1),
ra AS (SELECT release_id, artist_id, name FROM (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY artist_id, name) AS rn FROM credits WHERE credit_scope = 'release_artist' AND {_REAL}) WHERE rn = 1),
scores AS (SELECT v.master_id, r.title, v.variant_count, coalesce(credit_rows, 0) AS credit_rows, v.variant_count * coalesce(credit_rows, 0) AS score, v.main_release_id, ra.artist_id, ra.name AS artist_name, CAST(substr(r.released, 1, 4) AS INTEGER) AS year
  FROM variants v LEFT JOIN counts USING (master_id) JOIN ra ON ra.release_id = v.main_release_id JOIN releases r ON r.release_id = v.main_release_id JOIN masters m ON m.master_id = v.master_id
  WHERE lower(m.genres[1]) NOT IN ({', '.join(repr(g) for g in LENS.non_studio_genres)}))"""
_CATALOG = "catalog AS (SELECT master_id, artist_id, score, main_release_id, master_id % 7 = 0 AS editorial FROM (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY master_id % 7 <> 0, score DESC, master_id) AS rn FROM scores) WHERE rn = 1 ORDER BY master_id % 7 <> 0, score DESC, master_id LIMIT 140)"


def _albums(spark, sf_dir):
    m = _model(spark, sf_dir)
    s = rank.album_scores(m, LENS)
    return m, s, rank.album_catalog(s, s.where("master_id % 7 = 0").select("master_id"), 140)


def _catalog(spark, sf_dir):
    m, s, c = _albums(spark, sf_dir)
    return m, c.join(s.select("master_id", "main_release_id"), "master_id")


@query(f"WITH {_SCORES} SELECT * FROM scores ORDER BY score DESC, master_id LIMIT 200")
def rank_albums(spark, sf_dir):
    return rank.rank_albums(_model(spark, sf_dir), LENS)


@query(f"WITH {_SCORES}, {_CATALOG} SELECT master_id, artist_id, score, editorial FROM catalog")
def album_catalog(spark, sf_dir):
    return _albums(spark, sf_dir)[2]


_PERF = f"perf AS (SELECT DISTINCT release_id, artist_id FROM credits WHERE {_REAL} AND {_PERFORMER_ROLE})"


@query(f"""WITH {_SCORES}, {_CATALOG}, {_PERF}, have AS (SELECT DISTINCT p.artist_id FROM catalog c JOIN perf p ON p.release_id = c.main_release_id)
SELECT s.master_id, s.score, count(*) AS performers, count(*) FILTER (WHERE p.artist_id NOT IN (SELECT artist_id FROM perf JOIN catalog ON main_release_id = release_id)) AS new_performers FROM scores s JOIN perf p ON p.release_id = s.main_release_id WHERE s.master_id NOT IN (SELECT master_id FROM catalog) GROUP BY 1, 2""".replace("SELECT artist_id FROM perf JOIN catalog ON main_release_id = release_id", "SELECT h.artist_id FROM have h"))
def review_candidates(spark, sf_dir):
    m, s, c = _albums(spark, sf_dir)
    return rank.review_candidates(m, s, c, LENS)


_CANDIDATES = "candidates AS (SELECT o_orderkey AS position, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS release_hint, upper(o_orderpriority) AS title, ' ' || p_name AS artist FROM orders JOIN part ON p_partkey = o_orderkey % 50 + 1)"


@query(f"""WITH {L.SQL}, {_CANDIDATES},
a AS (SELECT release_id, artist_id, name FROM (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY artist_id, name) AS rn FROM credits WHERE credit_scope = 'release_artist' AND {_REAL}) WHERE rn = 1),
known AS (SELECT r.release_id, master_id, title, master_is_main_release AS main, artist_id, name FROM releases r JOIN a USING (release_id)),
main AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY NOT main, release_id) AS rn FROM known) WHERE rn = 1),
hint AS (SELECT position, 'hint' AS how, m.release_id, m.artist_id FROM candidates JOIN known k ON k.release_id = release_hint JOIN main m ON m.master_id = k.master_id),
text AS (SELECT position, 'text' AS how, release_id, artist_id FROM (SELECT position, k.release_id, k.artist_id, row_number() OVER (PARTITION BY position ORDER BY NOT main, k.release_id) AS rn
  FROM candidates c JOIN known k ON lower(trim(c.title)) = lower(trim(k.title)) AND lower(trim(c.artist)) = lower(trim(k.name)) WHERE position NOT IN (SELECT position FROM hint)) WHERE rn = 1)
SELECT position, how, release_id, artist_id FROM (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY position) AS rn FROM (SELECT * FROM hint UNION ALL SELECT * FROM text)) WHERE rn = 1""")
def resolve_candidates(spark, sf_dir):
    return _resolved(spark, sf_dir, L.read(spark, sf_dir, "orders"))


def _resolved(spark, sf_dir, o):
    p = L.read(spark, sf_dir, "part")
    c = o.join(p, F.col("p_partkey") == F.col("o_orderkey") % 50 + 1).select(
        F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("release_hint"), F.upper("o_orderpriority").alias("title"), F.concat(F.lit(" "), "p_name").alias("artist")
    )
    return rank.resolve_candidates(_model(spark, sf_dir), c, LENS)


_MEMBERS = f"{_SCORES}, {_CATALOG}, {_PERF}, ap AS (SELECT DISTINCT master_id AS album_id, p.artist_id FROM catalog c JOIN perf p ON p.release_id = c.main_release_id)"
_PAIRS = "pairs AS (SELECT x.album_id AS album_a, y.album_id AS album_b, count(*) AS shared, min(artist_id) AS artist_id FROM ap x JOIN ap y USING (artist_id) WHERE x.album_id < y.album_id GROUP BY 1, 2)"
_TWO = "both_ways AS (SELECT album_a AS a, album_b AS m FROM pairs UNION ALL SELECT album_b, album_a FROM pairs), two AS (SELECT x.a AS album_a, y.a AS album_c, count(*) AS n, min(x.m) AS middle FROM both_ways x JOIN both_ways y USING (m) WHERE x.a < y.a AND (x.a, y.a) NOT IN (SELECT (album_a, album_b) FROM pairs) GROUP BY 1, 2)"


def _performers(spark, sf_dir):
    m, c = _catalog(spark, sf_dir)
    return rounds.album_performers(m, c, LENS)


@query(f"WITH {_MEMBERS}, {_PAIRS} SELECT * FROM pairs")
def shared_performers(spark, sf_dir):
    return rounds.shared_performers(_performers(spark, sf_dir))


@query(f"WITH {_MEMBERS}, {_PAIRS}, {_TWO} SELECT album_a, album_c, middle FROM two WHERE n = 1")
def two_hop_unique_middle(spark, sf_dir):
    return rounds.unique_middles(rounds.shared_performers(_performers(spark, sf_dir)))


@query(f"""WITH {_MEMBERS}, {_PAIRS}, either AS (SELECT album_a, album_b, ap.artist_id, count(*) AS n FROM pairs JOIN ap ON album_id IN (album_a, album_b) GROUP BY 1, 2, 3)
SELECT album_a, album_b, artist_id FROM (SELECT *, row_number() OVER (PARTITION BY album_a, album_b ORDER BY artist_id) AS rn FROM either WHERE n = 1) WHERE rn <= 4""")
def distractors(spark, sf_dir):
    p = _performers(spark, sf_dir)
    return rounds.distractors(p, rounds.shared_performers(p))


def _mode_sql(name: str, words: list[str]) -> str:
    ap = f"SELECT DISTINCT c.master_id AS album_id, k.artist_id FROM catalog c JOIN (SELECT release_id, artist_id FROM credits WHERE {_REAL} AND role_text IS NOT NULL AND {_any(words)}) k ON k.release_id = c.main_release_id"
    return f"""ap_{name} AS ({ap}), {_PAIRS.replace("pairs AS", f"pairs_{name} AS").replace("FROM ap x JOIN ap y", f"FROM ap_{name} x JOIN ap_{name} y")},
{_TWO.replace("both_ways", f"bw_{name}").replace("two AS", f"two_{name} AS").replace("FROM pairs", f"FROM pairs_{name}")}"""


@query(f"WITH {_SCORES}, {_CATALOG}, {_mode_sql('guitar', ['small'])}, {_mode_sql('rhythm', ['medium', 'large'])} " + " UNION ALL ".join(f"SELECT '{n}' AS mode, (SELECT count(DISTINCT album_id) FROM ap_{n}) AS albums, (SELECT count(*) FROM pairs_{n}) AS one_hop, (SELECT count(*) FROM two_{n}) AS two_hop" for n in ("guitar", "rhythm")))
def role_mode_counts(spark, sf_dir):
    m, c = _catalog(spark, sf_dir)
    r = F.col("role_text")
    return rounds.role_mode_counts(m, c, LENS, {"guitar": R.instrument_role(r, LENS, ["guitar"]), "rhythm": R.instrument_role(r, LENS, ["bass", "drums"])})


_EDGE_ALBUMS = f"{_EDGES}, {_SCORES.replace(L.SQL + ',', '')}, {_CATALOG}"


@query(f"""WITH {_EDGE_ALBUMS}, near AS (SELECT c.master_id AS album, e.artist_a_id AS e, e.artist_b_id AS bridge FROM catalog c JOIN edges e ON e.artist_a_id = c.artist_id)
SELECT x.album AS album_a, y.album AS album_b, count(*) AS bridges, min(bridge) AS bridge FROM near x JOIN near y USING (bridge) WHERE x.album < y.album AND x.e <> y.e AND bridge <> x.e AND bridge <> y.e GROUP BY 1, 2""")
def route_candidates(spark, sf_dir):
    m, c = _catalog(spark, sf_dir)
    return rounds.route_candidates(edges.credit_edges(m, LENS), m, c, LENS)


@query(f"""WITH {_SCORES}, {_CATALOG}, members AS (SELECT DISTINCT c.master_id, k.artist_id FROM catalog c JOIN (SELECT release_id, artist_id FROM credits WHERE {_REAL} AND NOT {_INELIGIBLE}) k ON k.release_id = c.main_release_id)
SELECT master_id, count(*) AS members, array_to_string(list(artist_id ORDER BY artist_id), ',') AS artist_ids FROM members GROUP BY 1""")
def album_membership(spark, sf_dir):
    m, c = _catalog(spark, sf_dir)
    return rounds.album_membership(m, c, LENS)


@query(f"""WITH {_EDGES}, f AS (SELECT release_id, {_CAVEATS} FROM release_formats GROUP BY 1)
SELECT r.release_id, r.title, CAST(substr(r.released, 1, 4) AS INTEGER) AS year, r.master_id, u.edges, CAST(coalesce(t0 * 4 + t1 * 2 + t2, 0) AS INTEGER) AS caveats, CAST(CASE WHEN t0 = 1 THEN 3 WHEN t1 = 1 THEN 2 WHEN t2 = 1 THEN 1 ELSE 0 END AS INTEGER) AS severity
FROM (SELECT release_id, count(*) AS edges FROM edges GROUP BY 1) u JOIN releases r USING (release_id) LEFT JOIN f USING (release_id)""")
def evidence_registry(spark, sf_dir):
    m = _model(spark, sf_dir)
    return rank.evidence_registry(edges.credit_edges(m, LENS), m, LENS, formats.release_caveats(m, LENS))


@query(f"""WITH {L.SQL}, claimed AS (SELECT release_id, artist_id, credit_scope, CASE WHEN release_id % 10 = 0 THEN 'absent' ELSE role_text END AS role_text, track_index FROM credits),
held AS (SELECT DISTINCT release_id, artist_id, credit_scope, coalesce(role_text, '\x01') AS role, coalesce(track_index, -1) AS track FROM credits)
SELECT c.* FROM claimed c ANTI JOIN held k ON k.release_id = c.release_id AND k.artist_id = c.artist_id AND k.credit_scope = c.credit_scope AND k.role = coalesce(c.role_text, '\x01') AND k.track = coalesce(c.track_index, -1)""")
def missing_evidence(spark, sf_dir):
    c = _model(spark, sf_dir).credits
    claimed = c.select("release_id", "artist_id", "credit_scope", F.when(F.col("release_id") % 10 == 0, "absent").otherwise(F.col("role_text")).alias("role_text"), "track_index")
    return graph.missing_evidence(claimed, c)


# ---- analyses

_DATED = f"{L.SQL}, dated AS (SELECT release_id, CAST(substr(released, 1, 4) AS INTEGER) AS year FROM releases)"


@query(f"""WITH {_DATED}, c AS (SELECT year, artist_id FROM credits JOIN dated USING (release_id) WHERE artist_id > 0), f AS (SELECT artist_id, min(year) AS year FROM c GROUP BY 1), n AS (SELECT year, count(*) AS new_artists FROM f GROUP BY 1)
SELECT year, count(*) AS credits, count(DISTINCT artist_id) AS artists, coalesce(any_value(new_artists), 0) AS new_artists FROM c LEFT JOIN n USING (year) GROUP BY year""")
def personnel_timeline(spark, sf_dir):
    return analyses.personnel_timeline(_model(spark, sf_dir), LENS)


@query(f"WITH {_DATED}, e AS (SELECT release_id, unnest(list_distinct({_CATS})) AS category FROM credits) SELECT year, category, count(*) AS credits FROM e JOIN dated USING (release_id) GROUP BY 1, 2")
def role_distribution(spark, sf_dir):
    return analyses.role_distribution(_model(spark, sf_dir), LENS)


@query(f"""WITH {_DATED}, c AS (SELECT DISTINCT year, artist_id FROM credits JOIN dated USING (release_id) WHERE artist_id > 0),
n AS (SELECT year, count(*) AS artists, lag(year) OVER (ORDER BY year) AS previous, lag(count(*)) OVER (ORDER BY year) AS prev_n FROM c GROUP BY year),
s AS (SELECT n.year, count(*) AS shared FROM n JOIN c x ON x.year = n.year JOIN c y ON y.year = n.previous AND y.artist_id = x.artist_id GROUP BY 1),
j AS (SELECT n.year, artists, coalesce(shared, 0) AS shared, CASE WHEN previous IS NOT NULL THEN coalesce(shared, 0) / (artists + prev_n - coalesce(shared, 0)) END AS jac FROM n LEFT JOIN s USING (year))
SELECT year, artists, shared, round(jac, 6) AS jaccard, CAST(sum(CASE WHEN coalesce(jac < 0.5, TRUE) THEN 1 ELSE 0 END) OVER (ORDER BY year) AS BIGINT) AS era FROM j""")
def era_turnover(spark, sf_dir):
    return analyses.era_turnover(_model(spark, sf_dir), LENS)


@query(f"""WITH {L.SQL}, a AS (SELECT DISTINCT artist_id, release_id FROM credits WHERE artist_id > 0), b AS (SELECT release_id, count(DISTINCT artist_id) AS n, min(artist_id) AS o FROM credits WHERE credit_scope = 'release_artist' AND artist_id > 0 GROUP BY 1)
SELECT artist_id, count(*) AS tier_a, count(*) FILTER (WHERE n = 1 AND o = artist_id) AS tier_b, count(*) FILTER (WHERE n = 1 AND o = artist_id AND master_is_main_release) AS tier_c FROM a LEFT JOIN b USING (release_id) JOIN releases USING (release_id) GROUP BY 1""")
def scope_tiers(spark, sf_dir):
    m = _model(spark, sf_dir)
    return analyses.scope_tiers(m, m.credits.select("artist_id").distinct(), LENS)


@query(f"""WITH RECURSIVE {_EDGES}, held AS (SELECT DISTINCT artist_id AS seed, release_id FROM credits WHERE artist_id > 0),
alone AS (SELECT release_id, count(DISTINCT artist_id) AS n, min(artist_id) AS o FROM credits WHERE credit_scope = 'release_artist' AND artist_id > 0 GROUP BY 1),
j AS (SELECT seed, h.release_id, coalesce(n = 1 AND o = seed, FALSE) AS alone, master_is_main_release AS main FROM held h LEFT JOIN alone a ON a.release_id = h.release_id JOIN releases r ON r.release_id = h.release_id),
tier AS (SELECT seed, release_id, 'a' AS tier FROM j UNION ALL SELECT seed, release_id, 'b' FROM j WHERE alone UNION ALL SELECT seed, release_id, 'c' FROM j WHERE alone AND main),
per AS (SELECT seed, tier, count(DISTINCT c.release_id) AS releases, count(*) AS credits, count(DISTINCT artist_id) AS contributors, round(avg(CASE WHEN len([z for z in {_CATS} if z <> 'unknown']) > 0 THEN 1.0 ELSE 0.0 END), 4) AS classified_share FROM tier t JOIN credits c ON c.release_id = t.release_id GROUP BY 1, 2),
e AS (SELECT DISTINCT seed, tier, least(a, b) AS x, greatest(a, b) AS y FROM tier t JOIN directed d ON d.release_id = t.release_id),
ed AS (SELECT seed, tier, count(*) AS edges FROM e GROUP BY 1, 2),
w AS (SELECT seed, tier, x, y FROM e UNION ALL SELECT seed, tier, y, x FROM e),
label(seed, tier, node, root) USING KEY (seed, tier, node) AS (
  SELECT DISTINCT seed, tier, x, x FROM w
  UNION SELECT w.seed, w.tier, w.y, min(l.root) FROM label l JOIN w ON w.seed = l.seed AND w.tier = l.tier AND w.x = l.node JOIN recurring.label r ON r.seed = w.seed AND r.tier = w.tier AND r.node = w.y WHERE l.root < r.root GROUP BY 1, 2, 3),
sizes AS (SELECT seed, tier, root, count(*) AS n FROM label GROUP BY 1, 2, 3),
forms AS (SELECT seed, tier, CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components, max(n) AS largest FROM sizes GROUP BY 1, 2),
every AS (SELECT DISTINCT artist_id AS seed, t.tier FROM credits, (SELECT unnest(['a', 'b', 'c']) AS tier) t)
SELECT v.seed AS artist_id, v.tier, coalesce(releases, 0) AS releases, coalesce(credits, 0) AS credits, coalesce(contributors, 0) AS contributors, coalesce(classified_share, 0.0) AS classified_share, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges,
coalesce(components, 0) AS components, coalesce(largest, 0) AS largest, coalesce(components = 1 AND edges = nodes - 1, FALSE) AS star
FROM every v LEFT JOIN per p ON p.seed = v.seed AND p.tier = v.tier LEFT JOIN ed ON ed.seed = v.seed AND ed.tier = v.tier LEFT JOIN forms s ON s.seed = v.seed AND s.tier = v.tier""")
def tier_graphs(spark, sf_dir):
    m = _model(spark, sf_dir)
    return analyses.tier_graphs(m, edges.directed_edges(m, LENS), m.credits.select("artist_id").distinct(), LENS)


@query(f"""WITH {L.SQL}, g AS (SELECT DISTINCT artist_id, related_artist_id AS group_id FROM artist_relations WHERE relation = 'member_of' UNION SELECT related_artist_id, artist_id FROM artist_relations WHERE relation = 'has_member')
SELECT DISTINCT x.artist_id AS a, y.artist_id AS b FROM g x JOIN g y USING (group_id) WHERE x.artist_id < y.artist_id""")
def family_exclusions(spark, sf_dir):
    return analyses.family_pairs(analyses.family_groups(_model(spark, sf_dir)))


@query(f"""WITH {L.SQL}, g AS (SELECT DISTINCT artist_id, related_artist_id AS group_id FROM artist_relations WHERE relation = 'member_of' UNION SELECT related_artist_id, artist_id FROM artist_relations WHERE relation = 'has_member'),
p AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1),
s AS (SELECT DISTINCT p.a, p.b FROM p JOIN g x ON x.artist_id = p.a JOIN g y ON y.artist_id = p.b AND y.group_id = x.group_id)
SELECT p.a, p.b, p.a = p.b OR s.a IS NOT NULL OR u.artist_id IS NOT NULL OR v.artist_id IS NOT NULL AS excluded FROM p LEFT JOIN s ON s.a = p.a AND s.b = p.b LEFT JOIN g u ON u.artist_id = p.a AND u.group_id = p.b LEFT JOIN g v ON v.artist_id = p.b AND v.group_id = p.a""")
def family_excluded(spark, sf_dir):
    t = L.read(spark, sf_dir, "lineitem")
    x, y = (t.select("l_orderkey", F.col("l_linenumber").alias(f"_{n}"), F.col("l_suppkey").alias(n)) for n in "ab")
    pairs = x.join(y, (x["l_orderkey"] == y["l_orderkey"]) & (F.col("_b") == F.col("_a") + 1)).select("a", "b").distinct()
    return analyses.family_excluded(pairs, analyses.family_groups(_model(spark, sf_dir)))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'click'")
def event_props(spark, sf_dir):
    e = L.read(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query()
def recommended_routes(spark, sf_dir):
    m, c = _catalog(spark, sf_dir)
    albums = materialize(c, "albums")
    g = albumgraph.anchored_graph(m, _stored(spark, sf_dir), albums, LENS)
    a = albumgraph.anchors(albums).select("anchor_id")
    pairs = a.select(F.col("anchor_id").alias("start")).join(a.select(F.col("anchor_id").alias("end")), F.col("start") > F.col("end"))
    return albumgraph.recommended_routes(g, materialize(pairs, "pairs"), formats.release_caveats(m, LENS), LENS)


@query(f"""WITH {_EDGE_ALBUMS}, ends AS (SELECT DISTINCT artist_id AS a FROM catalog),
one AS (SELECT a, artist_b_id AS at1 FROM ends JOIN edges ON artist_a_id = a), two AS (SELECT DISTINCT a, artist_b_id AS at1 FROM one JOIN edges ON artist_a_id = at1),
near AS (SELECT a, at1, min(d) AS d FROM (SELECT a, at1, 1 AS d FROM one UNION ALL SELECT a, at1, 2 FROM two UNION ALL SELECT a, a, 0 FROM ends) GROUP BY 1, 2),
met AS (SELECT x.a AS a, y.a AS b, min(x.d + y.d) AS hops FROM near x JOIN near y ON x.at1 = y.at1 WHERE x.a < y.a AND x.d + y.d <= 3 GROUP BY 1, 2)
SELECT x.master_id AS album_a_id, y.master_id AS album_b_id, CASE WHEN hops IS NULL THEN 'no_path' ELSE 'found' END AS status, CAST(hops AS INTEGER) AS hop_count,
  CASE hops WHEN 1 THEN 'easy' WHEN 2 THEN 'medium' WHEN 3 THEN 'hard' END AS difficulty
FROM catalog x JOIN catalog y ON x.master_id < y.master_id LEFT JOIN met ON met.a = least(x.artist_id, y.artist_id) AND met.b = greatest(x.artist_id, y.artist_id)""")
def connectivity_pairs(spark, sf_dir):
    m, c = _catalog(spark, sf_dir)
    albums = materialize(c.select("master_id", "artist_id"), "albums")
    status = graph.pair_status(_stored(spark, sf_dir), albums.select("artist_id").distinct(), 3)
    x, y = (albums.select(F.col("master_id").alias(f"album_{n}_id"), F.col("artist_id").alias(f"_{n}")) for n in "ab")
    pairs = x.join(y, F.col("album_a_id") < F.col("album_b_id")).withColumn("seed_a", F.least("_a", "_b")).withColumn("seed_b", F.greatest("_a", "_b"))
    hops = F.col("hops")
    difficulty = F.when(hops == 1, "easy").when(hops == 2, "medium").when(hops == 3, "hard")
    return pairs.join(status, ["seed_a", "seed_b"], "left").select("album_a_id", "album_b_id", "status", hops.alias("hop_count"), difficulty.alias("difficulty"))


@query(f"""WITH {_SCORES}, {_CATALOG}, {_POLICY.replace(L.SQL + ", ", "")},
j AS (SELECT c.master_id, coalesce(p.decision, 'missing') AS decision, lower(m.genres[1]) IN ({', '.join(repr(g) for g in LENS.non_studio_genres)}) AS non_studio,
  regexp_matches(lower(p.title), '{LENS.variant_release_pattern}') AS variant_title,
  EXISTS (SELECT 1 FROM credits k WHERE k.release_id = c.main_release_id AND k.artist_id = c.artist_id AND k.credit_scope = 'release_artist') AS billed
  FROM catalog c LEFT JOIN policy p ON p.release_id = c.main_release_id LEFT JOIN masters m ON m.master_id = c.master_id)
SELECT *, decision = 'allow' AND NOT non_studio AND NOT variant_title AND billed AS passes FROM j""")
def catalog_audit(spark, sf_dir):
    m, c = _catalog(spark, sf_dir)
    return artifacts.catalog_audit(m, c, formats.format_policy(m, LENS), LENS)


@query()
def page_candidates(spark, sf_dir):
    return html.extract_candidates(L.read(spark, sf_dir, "pages"))
