"""The edge rules scenario by scenario, and the graph questions on the shared fixture."""

import pytest

from quillgraph.operators import analyses, edges, graph, routes
from quillgraph.policies import Policy
from tests.model import album, model, shared

P = Policy()


def pairs(m, policy=P, **more):
    return {(r.artist_a_id, r.artist_b_id): r.release_id for r in edges.credit_edges(m, policy, **more).collect()}


def linked(spark, credits, **more):
    return {k for k in pairs(model(spark, credits, **more)) if k[0] < k[1]}


B, T, C, K = "release_artist", "track_artist", "track_credit", "release_credit"

SCENARIOS = {
    "compilation, artists on different tracks": ([(1, i, "S", T, 10 + i, None) for i in range(6)], set()),
    "guests of one track are no clique": ([(1, None, None, B, 1, None), (1, 0, "S", C, 2, "Featuring"), (1, 0, "S", C, 3, "Featuring")], {(1, 2), (1, 3)}),
    "a sampled artist": ([(1, None, None, B, 1, None), (1, 0, "S", T, 1, None), (1, 0, "S", C, 2, "Performer [Sample]")], set()),
    "a producer stars out from the billed artist": ([(1, None, None, B, 1, None), (1, None, None, K, 2, "Producer"), (1, None, None, K, 3, "Engineer")], {(1, 2), (1, 3)}),
    "writing and packaging": ([(1, None, None, B, 1, None), (1, None, None, K, 2, "Written-By, Design"), (1, 0, "S", T, 1, None), (1, 0, "S", C, 3, "Lyrics By")], set()),
    "one collaborating component is enough": ([(1, None, None, B, 1, None), (1, None, None, K, 2, "Written-By, Producer")], {(1, 2)}),
    "duet": (album(1, [1, 2]), {(1, 2)}),
    "mashup, performers not billed": ([(1, None, None, B, 9, None), (1, 0, "S", T, 1, None), (1, 0, "S", T, 2, None)], set()),
    "container track": ([(1, None, None, B, 1, None)] + [(1, 0, "S", C, 10 + i, "Featuring") for i in range(20)], set()),
    "remixer": ([(1, None, None, B, 1, None), (1, 0, "S", T, 1, None), (1, 0, "S", C, 2, "Remix")], set()),
    "neither endpoint billed": ([(1, None, None, B, 9, None), (1, 0, "S", T, 1, None), (1, 0, "S", C, 2, "Guitar")], set()),
    "feature with a billed guest": ([(1, None, None, B, 2, None), (1, 0, "S", T, 1, None), (1, 0, "S", C, 2, "Guitar")], {(1, 2)}),
    "live track": ([(1, None, None, B, 1, None), (1, 0, "Song (live)", T, 1, None), (1, 0, "Song (live)", C, 2, "Guitar")], set()),
    "sampler as an instrument": ([(1, None, None, B, 1, None), (1, 0, "S", T, 1, None), (1, 0, "S", C, 2, "Sampler [Fairlight]")], {(1, 2)}),
    "placeholder": (album(1, [194, 600]), set()),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_edge_scenarios(spark, name):
    credits, want = SCENARIOS[name]
    assert linked(spark, credits) == want


def test_compilation_title(spark):
    assert linked(spark, album(1, [1, 2]), releases=[(1, "Greatest Hits", "UK", "1990", 1, True, "ok")]) == set()


def test_caps_and_symmetry(spark):
    m = shared(spark)
    e = pairs(m)
    assert all((b, a) in e and a != b for a, b in e) and e[100, 500] == 4
    capped = pairs(m, P.but(max_artists_per_release=3))
    assert (100, 500) not in capped and (100, 200) in capped


def test_preference_keeps_the_pairs(spark):
    credits = album(1, [1, 2]) + album(2, [1, 2]) + album(3, [2, 3])
    m = model(spark, credits, formats=[(1, 0, "Vinyl", ["Unofficial Release"]), (2, 0, "CD", ["Reissue"])])
    plain, chosen, named = pairs(m), pairs(m, preference=edges.EvidencePreference()), pairs(m, preference=edges.EvidencePreference(preferred=(1,)))
    assert plain.keys() == chosen.keys() == named.keys() and (plain[1, 2], chosen[1, 2], named[1, 2]) == (1, 2, 1)


def test_paths(spark):
    m = shared(spark)
    full, capped = edges.credit_edges(m, P), edges.credit_edges(m, P.but(max_artists_per_release=3))
    assert [h["release_id"] for h in graph.find_path(full, 100, 500)] == [4]
    assert [(h["to"], h["release_id"]) for h in graph.find_path(capped, 100, 500)] == [(200, 1), (300, 2), (400, 3), (500, 6)]
    assert graph.find_path(capped, 100, 500, max_hops=3) is None and graph.find_path(full, 100, 600) is None and graph.find_path(full, 100, 100) == []
    with pytest.raises(graph.FrontierTooLarge):
        graph.find_path(capped, 100, 500, max_frontier_degree=1)


def test_reach_and_status(spark):
    e = edges.credit_edges(shared(spark), P.but(max_artists_per_release=3))
    seeds = graph.ids_frame(spark, [100, 400, 500])
    dist = {(r.seed_id, r.artist_id): r.dist for r in graph.reach(e, seeds, 2).collect()}
    assert dist[100, 300] == 2 and dist[100, 100] == 0 and (100, 400) not in dist
    got = {(r.seed_a, r.seed_b): (r.status, r.hops) for r in graph.pair_status(e, seeds, 3).collect()}
    assert got == {(100, 400): ("found", 3), (100, 500): ("no_path", None), (400, 500): ("found", 1)}
    cut = {(r.seed_a, r.seed_b): r.status for r in graph.pair_status(e, seeds, 3, max_degree=1).collect()}
    assert cut[100, 500] == "skipped"


def test_components_csr_routes(spark):
    m = shared(spark)
    e = edges.credit_edges(m, P.but(max_artists_per_release=3))
    assert {r.component for r in graph.label_components(e).collect()} == {100}
    chain = spark.createDataFrame([x for i in range(60) for x in ((i, i + 1, 1), (i + 1, i, 1))], "artist_a_id long, artist_b_id long, release_id long")
    assert {r.component for r in graph.label_components(chain).collect()} == {0}
    rows = routes.csr(e).orderBy("node").collect()
    assert [r.offset for r in rows] == [0, 1, 3, 5, 7] and rows[1].neighbours == "100,300"
    two = spark.createDataFrame([(100, 300)], "start long, end long")
    assert [r.path for r in routes.ranked_routes(e, two, 2).collect()] == ["100-200-300"]
    assert analyses.label_communities(e).count() == 5


def test_determinism_across_partitions(spark):
    m = shared(spark)
    one = pairs(m)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert pairs(m) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_missing_evidence(spark):
    m = shared(spark)
    claimed = spark.createDataFrame([(1, 100, "release_artist", "Performer", None), (1, 100, "track_artist", None, 0), (1, 100, "track_artist", "Guitar", 0)], "release_id long, artist_id long, credit_scope string, role_text string, track_index int")
    assert [r.role_text for r in graph.missing_evidence(claimed, m.credits).collect()] == ["Guitar"]
