"""Contributors, hop grades and explanations on small models, and artifacts that break their contracts."""

import pytest

from quillgraph.operators import artifacts, contracts, contributors, edges, graph
from quillgraph.policies import Policy
from tests.model import album, model

P = Policy()


def _hops(spark, rows):
    return spark.createDataFrame(rows, "album_a string, album_b string, artist_a_id long, artist_b_id long, release_id long")


def test_index_and_next_step(spark):
    play = lambda r, a, role: (r, None, None, "release_credit", a, role)
    m = model(spark, [play(1, 1, "Guitar"), play(1, 2, "Guitar, Producer"), play(2, 1, "Guitar"), play(2, 3, "Producer"), play(3, 1, "Bass"), play(3, 4, "Engineer"), play(3, 4, "Engineer"), play(4, 3, "Producer"), play(4, 5, "Odd Thing")])
    hops = _hops(spark, [("a", "b", 1, 2, 1), ("a", "c", 1, 2, 1), ("a", "b", 1, 3, 2), ("b", "c", 1, 4, 3), ("b", "c", 3, 5, 4)])
    index = contributors.contributor_index(hops, m, P)
    got = {r.artist_id: r for r in index.collect()}
    assert got[1].neighbours == [2, 3, 4] and got[1].connection_count == 3 and got[1].albums == ["a", "b", "c"] and got[1].role_texts == ["Guitar", "Bass"]
    assert got[2].role_categories == ["production", "strings"] and got[5].role_categories == ["unknown"] and got[1].decades == [1990]
    assert [(e.release_id, e.role_text) for e in got[4].evidence] == [(3, "Engineer")]
    step = {r.artist_id: r.next_id for r in contributors.interesting_next_step(index).collect()}
    assert step[1] == 4 and step[2] is None and step[3] == 5 and step[4] == 1  # the least connected, then the lowest id


def test_hop_grades(spark):
    m = model(spark, album(1, [1, 2]) + [(2, None, None, "release_artist", 1, None), (2, 0, "Song", "track_credit", 3, "Remastered By"), (3, 0, "x", "track_credit", 4, "Producer"), (3, 1, "y", "track_credit", 5, "Engineer")])
    e = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (4, 5, 3)], "artist_a_id long, artist_b_id long, release_id long")
    got = {(r.artist_a_id, r.artist_b_id): (r.strength, r.scope, r.placeholder) for r in graph.hop_quality(m, e, P.but(flagged_ids=(5,))).collect()}
    assert got == {(1, 2): ("co_billed_release_artists", "same_recording", False), (1, 3): ("performer_credit", "same_recording", False), (4, 5): ("non_performer_only", "release_scope_credit", True)}
    cohort = {"pairs": [{"status": "found", "hops": [{"from": 5, "to": 4, "release_id": 3}]}]}
    flagged = artifacts.with_hop_quality(cohort, graph.hop_quality(m, e, P.but(flagged_ids=(5,))))["pairs"][0]
    assert flagged["hops"][0]["flags"] == ["non_performer_only", "release_scope_credit", "placeholder_artist_hop"] and len(flagged["warnings"]) == 2
    told = artifacts.explain_hops(m, [{"from": 1, "to": 3, "release_id": 2, "flags": ["same_recording"]}, {"from": 1, "to": 2, "release_id": 1}], P)
    assert told[0]["connection"] == "same_recording" and [c["artist_id"] for c in told[0]["credits"]] == [3] and told[0]["track_index"] == 0
    assert told[1]["track_index"] == 0 and {c["artist"] for c in told[1]["credits"]} == {"Artist 1", "Artist 2"}


def test_pair_scores():
    from collections import Counter

    pair = {"difficulty": "easy", "album_a_id": 1, "album_b_id": 2, "hops": [{"release_id": 9, "flags": ["performer_credit", "same_recording"]}]}
    assert artifacts.pair_score(pair, Counter([9]), Counter([1, 2]))[0] == 75
    assert artifacts.pair_score(pair | {"warnings": ["x"]}, Counter([9] * 3), Counter([1, 2, 2]))[0] == 75 - 35 - 6 - 2
    assert artifacts.difficulty(4) == "very_hard"


def test_seeds_and_names(spark):
    m = model(spark, album(1, [100, 200]) + album(2, [100, 700]))
    assert contributors.one_seed(m.credits, "  alice ") == 100
    with pytest.raises(contributors.SeedError):
        contributors.one_seed(m.credits, "Nobody")
    names = spark.createDataFrame([(1, "A", "2020"), (1, "B", "2021"), (1, "C", "2021"), (2, None, "2021")], "artist_id long, name string, v string")
    assert [tuple(r) for r in contributors.latest_names(names, "v").collect()] == [(1, "B")]
    placeholder = spark.createDataFrame([(1, "Various Artists (3)"), (2, "The Unknowns"), (3, "trad.")], "artist_id long, name string")
    assert {r.artist_id for r in contributors.placeholder_candidates(placeholder, P).collect()} == {1, 3}
    forms = spark.createDataFrame([("  Big Bill 3rd ", ["a", "b", "a", "c" * 9])], "n string, t array<string>").select(contributors.initials(contributors.F.col("n")), contributors.slug(contributors.F.col("n")), contributors.joined_texts(contributors.F.col("t")), contributors.joined_texts(contributors.F.col("t"), 8)).first()
    assert tuple(forms) == ("B. B.", "big-bill-3rd", "a, b, ccccccccc", "a, b…")


def test_path_rounds_take_the_first_bridge_that_holds(spark):
    play = lambda r, *artists: [c for a in artists for c in ((r, None, None, "release_artist", a, "Guitar"), (r, 0, "s", "track_artist", a, None))]
    quiet = lambda r, *artists: [(c[0], c[1], c[2], c[3], c[4], "Producer" if c[5] else None) for c in play(r, *artists)]
    m = model(spark, quiet(1, 1, 5) + play(2, 5, 2) + play(3, 1, 6) + play(4, 6, 2) + play(5, 1, 3))
    albums = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "album_id string, artist_id long")
    e = edges.credit_edges(m, P)
    got = sorted((r.artist_a, r.artist_c, r.bridge, r.release_a, r.release_c) for r in contributors.path_rounds(e, albums, m.credits, P).collect())
    assert got == [(1, 2, 6, 3, 4), (1, 3, None, 5, None)]
    no = spark.createDataFrame([(1, 3)], "a long, b long")
    assert contributors.path_rounds(e, albums, m.credits, P, no).count() == 1
    assert contributors.path_rounds(e, albums, m.credits, P, attempts=1).count() == 1  # bridge 5 comes first and does not hold


def test_route_counts(spark):
    links = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (7, 8)]
    e = spark.createDataFrame([(*p, 1) for x in links for p in (x, x[::-1])], "artist_a_id long, artist_b_id long, release_id long")
    pairs = spark.createDataFrame([(1, 4), (1, 5), (1, 2), (1, 8)], "start long, end long")
    m = contributors.route_measures(e, pairs, 3)
    assert {(r.start, r.end): (r.shortest_hops, r.equal_routes) for r in m.collect()} == {(1, 4): (2, 2), (1, 5): (3, 2), (1, 2): (1, 1), (1, 8): (None, None)}
    assert tuple(contributors.route_summary(m).first()) == (4, 3, 1, 2.0, 2, 3)


CATALOG = {"catalog_version": "v", "albums": [{"id": "m1", "artist_id": 1}, {"id": "m2", "artist_id": 2}]}


def test_broken_artifacts_are_found():
    art = [{"album_id": "m1", "main_release_id": 3, "uri150": "https://i.discogs.com/a", "uri": "https://i.discogs.com/b"}]
    sound = {"catalog_version": "v", "albums": art, "art_version": contracts.album_art_version(art)}
    assert contracts.album_art_failures(sound, CATALOG) == []
    for change in ({"uri": "http://i.discogs.com/b"}, {"uri": "https://elsewhere.org/b"}, {"album_id": "m9"}, {"main_release_id": 0}, {"width": "x"}):
        bad = [art[0] | change]
        assert contracts.album_art_failures(sound | {"albums": bad, "art_version": contracts.album_art_version(bad)}, CATALOG)
    assert contracts.album_art_failures(sound | {"art_version": "w"}, CATALOG) and contracts.album_art_failures(sound | {"albums": art * 2}, CATALOG)

    hop = {"release_id": 5, "artist_a_id": 1, "artist_b_id": 2}
    play = {"schema_version": 2, "provenance": {"source": "s", "license": "l", "snapshot_date": "d", "generated_by": "g", "catalog_version": "v"}, "albums": [{"id": "m1", "main_release_id": 3}], "artists": [{"artist_id": 1}, {"artist_id": 2}], "paths": [{"id": "p", "hops": [hop]}], "releases": [{"release_id": 5}]}
    assert contracts.challenge_failures(play, CATALOG) == []
    for change in ({"releases": []}, {"artists": [{"artist_id": 1}]}, {"provenance": {}}, {"seed": 1}, {"albums": [{"id": "m1", "main_release_id": True}]}):
        assert contracts.challenge_failures(play | change, CATALOG)

    row = {"artist_id": 1, "name": "A", "role_categories": ["strings"], "albums": ["m1"], "connection_count": 1, "neighboring_contributor_ids": [2], "evidence": [], "role_text_examples": [], "interesting_next_step": {"artist_id": 2}}
    index = {"catalog_version": "v", "contributors": [row, row | {"artist_id": 2, "role_categories": ["vocals"], "neighboring_contributor_ids": [1], "interesting_next_step": None}]}
    check = lambda i: contracts.contributor_index_failures(i, CATALOG, ["strings", "vocals"])
    assert check(index) == []
    for change in ({"name": ""}, {"role_categories": ["vocals"]}, {"albums": ["m7"]}, {"connection_count": 0}, {"neighboring_contributor_ids": [1]}, {"evidence": [{}] * 11}, {"name": "worked with B"}):
        assert check(index | {"contributors": [row | change, index["contributors"][1]]}), change

    universe = {"albums": [{"id": "m1"}, {"id": "m2"}], "artists": [{"artist_id": a} for a in (1, 2, 3)]}
    round_ = {"id": "r", "from_album_id": "m1", "to_album_id": "m2", "hop_count": 2, "hops": [hop, {"release_id": 6, "artist_a_id": 2, "artist_b_id": 3}]}
    assert contracts.record_route_failures(universe, {"rounds": [round_]}) == []
    for change in ({"hop_count": 1}, {"to_album_id": "m3"}, {"hops": [hop, hop]}, {"hops": [hop | {"release_id": None}], "hop_count": 1}):
        assert contracts.record_route_failures(universe, {"rounds": [round_ | change]}), change
    assert contracts.record_route_failures(universe, {"rounds": [round_, round_]})

    candidate = {"rank": 1, "artist": "a", "title": "t", "year": None, "master_id": None, "release_id": 4, "confidence": "high"}
    assert contracts.extracted_failures({"schema_version": 1, "source": {}, "candidates": [candidate]}) == []
    assert contracts.extracted_failures({"schema_version": 1, "source": {}, "candidates": [candidate | {"release_id": -1, "confidence": "sure"}]})
    assert contracts.resolved_failures({"resolved": [{"artist_id": 1, "master_id": 2, "release_id": 3, "position": 1}], "unresolved": [{"position": 1}]})
    found = contracts.all_failures({"catalog": CATALOG, "album_art": sound}, ["strings"])
    assert found["album_art"] == [] and found["challenge"] == ["challenge is missing"]
