"""Anchored graphs, recommended routes, and contract checks."""

import copy

from pyspark.sql import functions as F

from quillgraph.operators import albumgraph, contracts, edges
from quillgraph.policies import Policy
from quillgraph.sources.datasets import content_hash, stable_id
from tests.model import album, model

P = Policy()


def test_recommended_routes(spark):
    credits = album(1, [1, 2]) + album(2, [2, 3]) + album(3, [1, 4]) + album(4, [4, 3]) + album(5, [4, 9]) + album(6, [4, 8])
    m = model(spark, credits)
    e = edges.credit_edges(m, P)
    albums = spark.createDataFrame([(10, 5, 9), (20, 1, 1), (30, 2, 3)], "master_id long, main_release_id long, artist_id long")
    graph = albumgraph.anchored_graph(m, e, albums, P)
    assert {r.artist_a_id for r in graph.where("artist_b_id = -2").collect()} == {1, 2}
    pairs = spark.createDataFrame([(-1, -2)], "start long, end long")
    clean = spark.createDataFrame([], "release_id long, severity int")
    got = albumgraph.recommended_routes(graph, pairs, clean, P).collect()
    assert [(r.hops, r.path, r.longer) for r in got] == [(1, "-1|4|1|-2", False)]
    bad = spark.createDataFrame([(3, 3)], "release_id long, severity int")
    other = albumgraph.recommended_routes(graph, pairs, bad, P).collect()
    assert [(r.hops, r.path, r.severity, r.longer) for r in other] == [(2, "-1|4|3|2|-2", 0, True)]
    none = albumgraph.recommended_routes(graph, pairs, clean, P, allowed=F.lit(False)).collect()
    assert none == []


def test_role_texts_are_cut_at_a_comma(spark):
    m = model(spark, [(1, None, None, "release_artist", 1, f"Role Number {i:02d}") for i in range(30)])
    text = albumgraph.joined_roles(m).collect()[0].roles
    assert len(text) <= 201 and text.endswith("…") and all(len(x.rstrip("…")) == 14 for x in text.split(", "))


def test_contracts():
    g = {"node_ids": [-1, 5, 6], "offsets": [0, 1, 3, 4], "neighbors": [1, 0, 2, 1], "evidence_release_ids": [7, 7, 8, 8], "album_virtual_nodes": [{"album_id": "a", "virtual_artist_id": -1}]}
    assert contracts.compact_graph_failures(g) == []
    for field, value in (("node_ids", [5, -1, 6]), ("offsets", [0, 1, 3, 5]), ("neighbors", [2, 0, 2, 1]), ("neighbors", [1, 0, 9, 1]), ("evidence_release_ids", [7]), ("album_virtual_nodes", [{"album_id": "a", "virtual_artist_id": 5}])):
        assert contracts.compact_graph_failures(g | {field: value}), field
    pair = {"status": "found", "artist_a_id": 1, "artist_b_id": 3, "hop_count": 2, "hops": [{"from": 1, "to": 2, "release_id": 4}, {"from": 2, "to": 3, "release_id": 5}]}
    assert contracts.connectivity_failures({"pairs": [pair, {"status": "no_path"}, {"status": "skipped", "skip_reason": "hub"}]}) == []
    broken = copy.deepcopy(pair)
    broken["hops"][1]["from"] = 9
    assert contracts.connectivity_failures({"pairs": [broken, {"status": "lost"}, {"status": "skipped"}, {"status": "no_path", "hops": [1]}]}).__len__() == 4
    performers = {"a": {1, 2}, "b": {2, 3}}
    r = {"album_a": "a", "album_b": "b", "answers": [2], "distractors": [1], "id": stable_id(["a", "b", 2])}
    assert contracts.round_failures({"rounds": [r]}, performers) == []
    assert len(contracts.round_failures({"rounds": [r | {"answers": [1], "distractors": [2]}, r]}, performers)) >= 3
    albums = [{"id": "x", "artist_id": 1}, {"id": "y", "artist_id": 2}]
    catalog = {"albums": albums, "catalog_version": content_hash({"albums": albums})}
    assert contracts.catalog_failures(catalog) == [] and contracts.catalog_failures(catalog | {"albums": albums[:1] * 2})
    assert contracts.membership_failures({"albums": [{"album_id": "x", "artist_ids": [1]}, {"album_id": "y", "artist_ids": [2, 1]}]}, catalog) == ["artists of y must be sorted and distinct"]
    assert contracts.registry_failures({"release_ids": [1, 2], "titles": ["a"], "years": [1, 2], "caveat_flags": [0, 0]}) == ["titles has another length than release_ids"]
    assert contracts.key_failures({"a": 1, "z": 2}, ["a", "b"]) == ["missing b", "unknown z"]
    assert contracts.forbidden_failures({"x": [{"seed": 1}], "y": "Secret path"}, ["secret"]) == ["$.x[0].seed is not allowed", "$.y holds 'secret'"]
