"""Queries take whole tables."""

import pytest

import __spark_entry__ as entry
from tests.test_queries import SF


def test_no_order_or_release_is_left_out(spark):
    q = entry.queries()
    assert q["missing_evidence"](spark, SF).where("release_id > 500").count() > 0
    assert q["resolve_candidates"](spark, SF).where("position > 200").count() > 0


def test_scope_tiers_of_all_artists(spark):
    assert entry.queries()["scope_tiers"](spark, "/root/testdata/sf0.01").where("artist_id > 200").count() > 0


def _union_find(links):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_component_labels_equal_union_find(spark):
    links = [(r.artist_a_id, r.artist_b_id) for r in entry.queries()["credit_edges"](spark, SF).collect()]
    got = {r.artist_id: r.component for r in entry.queries()["component_labels"](spark, SF).collect()}
    assert got == _union_find(links)


def test_labels_of_several_components(spark):
    from quillgraph.operators import graph

    links = [(1, 2), (2, 5), (7, 9), (9, 8), (20, 21)]
    e = spark.createDataFrame([(*p, 1) for x in links for p in (x, x[::-1])], "artist_a_id long, artist_b_id long, release_id long")
    assert {r.artist_id: r.component for r in graph.label_components(e).collect()} == _union_find(links)


def test_routes_take_the_whole_catalog(spark, monkeypatch):
    from quillgraph import queries as q

    class Taken(Exception):
        pass

    def take(*args, **kwargs):
        raise Taken(args, kwargs)

    catalog = spark.createDataFrame([(i, 10 * i, 1000 + i) for i in range(1, 31)], "master_id long, main_release_id long, artist_id long")
    monkeypatch.setattr(q, "_catalog", lambda *_: (None, catalog))
    monkeypatch.setattr(q, "_stored", lambda *_: None)
    monkeypatch.setattr(q.formats, "release_caveats", lambda *_: None)
    monkeypatch.setattr(q.albumgraph, "anchored_graph", lambda *_: None)
    monkeypatch.setattr(q.albumgraph, "anchors", lambda albums: albums.selectExpr("-master_id AS anchor_id"))
    monkeypatch.setattr(q.albumgraph, "recommended_routes", take)
    with pytest.raises(Taken) as routes:
        q.recommended_routes(spark, SF)
    assert routes.value.args[0][1].count() == 30 * 29 // 2 and routes.value.args[1].get("max_hops", 4) == 4


def test_self_check_finds_planted_faults(spark):
    from quillgraph.operators import expand
    from quillgraph.plans.lens import Model
    from quillgraph.policies import Policy
    from tests.model import album, model

    m = model(spark, album(1, [1, 2]) + album(2, [2, 3]) + album(3, [7, 8]), formats=[(1, 0, "LP", ["Album"])])
    sound = expand.expand_one_hop(m, spark.createDataFrame([(1,)], "release_id long"), Policy())
    counts = lambda c: tuple(expand.self_check(c, Policy()).first())
    assert counts(sound) == (0, 0, 0, 0)
    k = sound.model
    lost = Model(k.releases.where("release_id <> 1"), k.credits, k.release_formats, k.masters, k.artist_relations)
    assert counts(expand.Corpus(lost, sound.frontier, sound.seeds)) == (4, 1, 0, 1)
    assert counts(expand.Corpus(m, sound.frontier, sound.seeds)) == (0, 0, 1, 0)
