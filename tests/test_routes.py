"""Enumerated routes, rebuilt paths and bounded reach against plain searches on random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import albumgraph, edges, enumeration, graph
from quillgraph.policies import Policy
from tests.model import album, model, shared

P = Policy()


def random_edges(spark, nodes, links, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(1, nodes + 1), 2))) for _ in range(links)}
    release = {p: r.randrange(1, 50) for p in pairs}
    rows = [(*q, release[p]) for p in pairs for q in (p, p[::-1])]
    near = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
    return spark.createDataFrame(rows, "artist_a_id long, artist_b_id long, release_id long"), near, release


def plain_routes(near, start, end, max_hops, max_routes, max_expansions):
    """The rule by a depth-first search, with budgets charged step by step: (routes, spent, stopped, stopped_at)."""
    spent, dist, level = 0, {end: 0}, [end]
    for d in range(1, max_hops + 1):
        cost = sum(len(near.get(x, ())) for x in level)
        if spent + cost > max_expansions:
            return [], spent, "expansions", 0
        spent += cost
        level = sorted({y for x in level for y in near.get(x, ())} - dist.keys())
        dist |= dict.fromkeys(level, d)
    held, shortest = [], dist.get(start)
    for hops in range(shortest or 1, max_hops + 1 if shortest else 1):
        walks = [[start]]
        for step in range(1, hops + 1):
            cost = sum(len(near.get(w[-1], ())) for w in walks)
            if spent + cost > max_expansions:
                return held, spent, "expansions", hops
            spent += cost
            walks = [[*w, y] for w in walks for y in near.get(w[-1], ()) if y not in w and dist.get(y, 99) <= hops - step and (y == end) == (step == hops)]
        room = len(walks) if hops == shortest else max(max_routes - len(held), 0)
        held += sorted(walks)[:room]
        if len(walks) > room:
            return held, spent, "routes", hops
    return held, spent, None, None


@pytest.mark.parametrize(("routes", "expansions"), [(3, 10**6), (200, 60), (5, 150)])
def test_routes_equal_a_depth_first_search(spark, routes, expansions):
    e, near, _ = random_edges(spark, 14, 26, 3)
    ends = [(a, b) for a in range(1, 6) for b in range(6, 11)] + [(1, 1), (1, 99)]
    got = enumeration.enumerate_routes(e, spark.createDataFrame(ends, "start long, end long"), 4, routes, expansions)
    listed = {}
    for r in got.routes.collect():
        assert len(r.path) == r.hops + 1
        listed.setdefault((r.start, r.end), []).append(list(r.path))
    state = {(r.start, r.end): r for r in got.pairs.collect()}
    assert set(state) == {p for p in ends if p[0] != p[1]}
    for p, r in state.items():
        held, spent, stopped, at = plain_routes(near, *p, 4, routes, expansions)
        assert sorted(listed.get(p, [])) == sorted(held), p
        assert (r.expansions, r.stopped, r.stopped_at, r.routes) == (spent, stopped, at, len(held)), p


def test_routes_of_an_empty_graph(spark):
    none = spark.createDataFrame([], "artist_a_id long, artist_b_id long, release_id long")
    got = enumeration.enumerate_routes(none, spark.createDataFrame([(1, 2)], "start long, end long"), 3)
    assert got.routes.count() == 0 and [(r.shortest, r.routes, r.stopped) for r in got.pairs.collect()] == [(None, 0, None)]


def test_route_facts(spark):
    m = model(spark, album(1, [1, 2]) + album(2, [2, 3]) + album(4, [2, 9]) + [(1, None, None, "release_credit", 2, "Guitar"), (2, None, None, "release_credit", 3, "Producer")])
    e = edges.credit_edges(m, P)
    got = enumeration.route_facts(enumeration.enumerate_routes(e, spark.createDataFrame([(1, 3)], "start long, end long"), 3).routes, e, m, P).collect()
    assert [(r.path, r.max_degree, r.mean_degree, r.release_ids, r.performer_share) for r in got] == [([1, 2, 3], 3, 3.0, [1, 2], 0.5)]
    assert {"strings", "production"} & set(got[0].categories) or len(got[0].categories) > 1


def plain_distance(near, a):
    dist, queue = {a: 0}, deque([a])
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                queue.append(y)
    return dist


@pytest.mark.parametrize("max_hops", [1, 3, 4])
def test_paths_of_all_pairs(spark, max_hops):
    e, near, release = random_edges(spark, 30, 34, 5)
    seeds = graph.ids_frame(spark, range(1, 13))
    scored, reached = graph.scored_pairs(e, seeds, max_hops)
    scored = {(r.seed_a, r.seed_b): r for r in scored.collect()}
    assert len(scored) == 66
    paths = {}
    for r in graph.pair_paths(reached, graph.scored_pairs(e, seeds, max_hops)[0]).collect():
        paths.setdefault((r.seed_a, r.seed_b), {})[r.hop] = (r.from_id, r.to_id, r.release_id)
    for (a, b), r in scored.items():
        d = plain_distance(near, a).get(b)
        assert r.hops == (d if d is not None and d <= max_hops else None) and r.status == ("found" if r.hops else "no_path")
        if r.hops:
            hops = [paths[a, b][i] for i in range(1, r.hops + 1)]
            assert len(paths[a, b]) == r.hops and hops[0][0] == a and hops[-1][1] == b
            assert all(x[1] == y[0] for x, y in zip(hops, hops[1:], strict=False)) and all(release[tuple(sorted(h[:2]))] == h[2] for h in hops)


def test_excluded_edges_and_reversed_paths(spark):
    e = edges.credit_edges(shared(spark), P)
    rest = graph.without_edges(e, spark.createDataFrame([(500, 100)], "artist_a_id long, artist_b_id long"))
    assert rest.count() == e.count() - 2
    seeds = graph.ids_frame(spark, [100, 400])
    scored, reached = graph.scored_pairs(rest, seeds, 4)
    back = sorted((r.hop, r.from_id, r.to_id) for r in graph.reversed_paths(graph.pair_paths(reached, scored)).collect())
    assert [x[0] for x in back] == [1, 2, 3] and back[0][1] == 400 and back[-1][2] == 100 and all(x[2] == y[1] for x, y in zip(back, back[1:], strict=False))


def test_reach_within_rows(spark):
    star = [(1, i, 1) for i in range(10, 30)] + [(2, 10, 1), (3, 4, 1)]
    e = spark.createDataFrame([r for a, b, c in star for r in ((a, b, c), (b, a, c))], "artist_a_id long, artist_b_id long, release_id long")
    seeds = graph.ids_frame(spark, [1, 2, 3, 4])
    got = graph.bounded_reach(e, seeds, 2, max_rows=10)
    assert {r.seed_id for r in got.failed.collect()} == {1} and got.rows.where("seed_id = 1").count() == 0 and got.rows.where("seed_id = 2").count() == 3
    scored = {(r.seed_a, r.seed_b): (r.status, r.skip_reason) for r in graph.scored_pairs(e, seeds, 3, max_rows=10)[0].collect()}
    assert scored[1, 2] == ("skipped", "reach_too_large") and scored[2, 3] == ("no_path", None) and scored[3, 4] == ("found", None)
    capped = {(r.seed_a, r.seed_b): (r.status, r.skip_reason) for r in graph.scored_pairs(e, seeds, 3, max_degree=1)[0].collect()}
    assert capped[2, 3] == ("skipped", "frontier_too_large")


def plain_recommendation(near, facts, degree, anchors, a, b, max_hops):
    """All simple routes by length; ranked as the rule says."""
    ranked, least = [], None
    for depth in range(2, max_hops + 3):
        layer, stack = [], [[a]]
        while stack:
            w = stack.pop()
            if len(w) == depth + 1:
                if w[-1] == b:
                    layer.append(w)
                continue
            stack += [[*w, y] for y in near.get(w[-1], ()) if y not in w and (y > 0 or y == b) and (y != b or len(w) == depth)]
        if layer:
            least = depth if least is None else least
            hops = lambda w: [facts[x, y] for x, y in zip(w[1:-2], w[2:-1], strict=True)]
            ranked += [(max([s for s, _ in hops(w)], default=0), max(degree.get(x, 0) for x in w[1:-1]), sum(k for _, k in hops(w)), depth, w) for w in layer]
            if depth > least or min(r[0] for r in ranked) == 0:
                break
    if not ranked:
        return None
    best = min(r[0] for r in ranked if r[3] == least)
    return min(r for r in ranked if r[3] == least or r[0] < best)


def test_recommended_routes_of_all_pairs(spark):
    r = random.Random(11)
    credits = [(*c[:5], r.choice(["Guitar", "Producer"]) if c[5] else None) for i in range(1, 31) for c in album(i, r.sample(range(1, 26), 2))]
    m = model(spark, credits)
    e = edges.credit_edges(m, P)
    albums = spark.createDataFrame([(i, i, next(c[4] for c in credits if c[0] == i)) for i in range(1, 9)], "master_id long, main_release_id long, artist_id long")
    g = albumgraph.anchored_graph(m, e, albums, P)
    bad = spark.createDataFrame([(i, r.randrange(0, 4)) for i in range(1, 31)], "release_id long, severity int")
    severity = {x.release_id: x.severity for x in bad.collect()}
    near, facts, degree = {}, {}, {}
    for x in g.collect():
        near.setdefault(x.artist_a_id, set()).add(x.artist_b_id)
        facts[x.artist_a_id, x.artist_b_id] = (severity.get(x.release_id, 0), 0 if "Guitar" in f"{x.role_a}{x.role_b}" else 1)
        if x.artist_a_id > 0 and x.artist_b_id > 0:
            degree[x.artist_a_id] = degree.get(x.artist_a_id, 0) + 1
    ends = [(-i, -j) for i in range(1, 9) for j in range(i + 1, 9)]
    pairs = spark.createDataFrame(ends, "start long, end long")
    got = {(x.start, x.end): x for x in albumgraph.recommended_routes(g, pairs, bad, P, max_hops=3).collect()}
    for a, b in ends:
        want = plain_recommendation(near, facts, degree, None, a, b, 3)
        if want is None:
            assert (a, b) not in got
        else:
            x = got[a, b]
            assert (x.severity, x.hub_degree, x.weak_hops, x.hops, x.path, x.degraded) == (*want[:3], want[3] - 2, "|".join(map(str, want[4])), False), (a, b)
    cut = {(x.start, x.end): x for x in albumgraph.recommended_routes(g, pairs, bad, P, max_hops=3, max_expansions=12).collect()}
    assert set(cut) == set(got) and any(x.degraded for x in cut.values())
    for p, x in cut.items():
        if x.degraded:
            way = [int(i) for i in x.path.split("|")]
            assert (way[0], way[-1]) == p and all(j in near[i] for i, j in zip(way, way[1:], strict=False)) and all(i > 0 for i in way[1:-1])
    some = [r.asDict() for r in got.values()] + [r.asDict() for r in cut.values()]
    shown = [r.explanation for r in albumgraph.explained_routes(spark.createDataFrame(some, "start long, end long, hops int, path string, severity int, hub_degree long, weak_hops long, longer boolean, degraded boolean")).collect()]
    assert any(x.startswith("best of the shortest; 1 hop; no caveat") for x in shown) and any(x.startswith("shortest found, not ranked") for x in shown)
