"""Readers and writers on small files."""

import gzip
import json
from datetime import date

import pytest

from quillgraph.operators import routes, selection
from quillgraph.sources import datasets, html, tables

RELEASE = """<releases>
<release id="7" status="Accepted"><title> One </title><title>Two</title><country>UK</country><released>1999-03-00</released><master_id is_main_release="true">3</master_id><data_quality>ok</data_quality>
<artists><artist><id>10</id><name>A</name><role></role></artist></artists><extraartists><artist><id>0</id><name>B</name><role>Producer</role></artist></extraartists>
<formats><format name="CD" qty="2" text=""><descriptions><description>Album</description><description> </description></descriptions></format></formats>
<tracklist><track><position>1</position><title>T1</title><artists><artist><id>11</id><name>C</name></artist></artists>
<sub_tracks><track><position>1a</position><title>S1</title></track><track><position>1b</position><title>S2</title><extraartists><artist><id>12</id><name>D</name><role>Guitar</role></artist></extraartists></track></sub_tracks></track>
<track><position>2</position><title>T2</title></track></tracklist></release>
<release id="x"><title>bad</title></release></releases>"""


@pytest.mark.parametrize("packed", [False, True])
def test_release_dump(spark, tmp_path, packed):
    path = tmp_path / ("r.xml.gz" if packed else "r.xml")
    (gzip.open if packed else open)(path, "wt").write(RELEASE)
    t = tables.read_release_dump(spark, str(path), "2026-01-01", "u")
    r = t["releases"].collect()
    assert len(r) == 1 and (r[0].title, r[0].country, r[0].master_id, r[0].master_is_main_release) == ("One", "UK", 3, True)
    assert [(x.track_index, x.parent_track_index, x.track_path, x.title) for x in t["tracks"].orderBy("track_index").collect()] == [(0, None, "0", "T1"), (1, 0, "0.0", "S1"), (2, 0, "0.1", "S2"), (3, None, "1", "T2")]
    credits = {(x.credit_scope, x.artist_id, x.track_index, x.role_text) for x in t["credits"].collect()}
    assert credits == {("release_artist", 10, None, None), ("release_credit", None, None, "Producer"), ("track_artist", 11, 0, None), ("track_credit", 12, 2, "Guitar")}
    f = t["release_formats"].collect()[0]
    assert (f.format_name, f.quantity, f.format_text, f.descriptions) == ("CD", 2, None, ["Album"])


def test_master_and_artist_dumps(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<masters><master id="3"><main_release>7</main_release><title>M</title><year>1999</year><genres><genre>Rock</genre></genres><artists><artist><id>10</id><name>A</name></artist></artists></master></masters>')
    m = tables.read_master_dump(spark, str(tmp_path / "m.xml"), "d", "u")
    row = m["masters"].collect()[0]
    assert (row.master_id, row.main_release_id, row.year, row.genres, row.styles) == (3, 7, 1999, ["Rock"], []) and m["master_artists"].collect()[0].artist_id == 10
    (tmp_path / "a.xml").write_text('<artists><artist><id>5</id><name>G</name><members><name id="6">X</name></members></artist><artist><id>6</id><name>X</name><groups><name id="5">G</name></groups></artist></artists>')
    got = {(r.artist_id, r.related_artist_id, r.relation) for r in tables.read_artist_relations(spark, str(tmp_path / "a.xml"), "d", "u").collect()}
    assert got == {(5, 6, "has_member"), (6, 5, "member_of")}


def test_seed_csv_and_json(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Title,release_id\na,7\nb,\nc,3\nd,7\n")
    assert [r.release_id for r in tables.read_seed_csv(spark, str(tmp_path / "s.csv")).collect()] == [3, 7]
    (tmp_path / "bad.csv").write_text("release_id\nseven\n")
    with pytest.raises(ValueError):
        tables.read_seed_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "g.json").write_text(json.dumps({"node_ids": [5, 6, 9], "offsets": [0, 1, 2, 2], "neighbors": [1, 0], "evidence_release_ids": [70, 70]}))
    assert {tuple(r) for r in tables.read_compact_graph(spark, str(tmp_path / "g.json")).collect()} == {(5, 6, 70), (6, 5, 70)}
    (tmp_path / "p.json").write_text(json.dumps({"classifications": [{"release_id": 1, "decision": "allow"}]}))
    assert [tuple(r) for r in tables.read_policy(spark, str(tmp_path / "p.json")).collect()] == [(1, "allow")]
    payload = json.dumps({"id": 4, "artists": [{"id": 1, "name": "A"}], "tracklist": [{"position": "1", "extraartists": [{"id": 2, "name": "B", "role": "Bass"}]}]})
    got = {(r.credit_scope, r.artist_id, r.track_index) for r in tables.api_credits(spark.createDataFrame([(payload,)], "payload string")).collect()}
    assert got == {("release_artist", 1, None), ("track_credit", 2, 0)}
    assert tables.generated_credits(spark, 10).count() == 110


def test_html_candidates(spark):
    page = '<ul><li>1. Ann - Blue (1971) <a href="/master/55">x</a></li><li>nothing</li><li>2) Bob – Red</li></ul><script>3. No - No</script>'
    got = html.candidates(page)
    assert [(c["rank"], c["artist"], c["master_hint"], c["confidence"]) for c in got] == [(1, "Ann", None if got[0]["master_hint"] is None else 55, got[0]["confidence"]), (2, "Bob", None, "medium")]
    rows = html.extract_candidates(spark.createDataFrame([(1, page), (2, None), (3, "<p>Cid - Green</p>")], "page_id long, html string")).collect()
    assert [(r.page_id, r["rank"]) for r in rows] == [(1, 1), (1, 2), (3, 1)]


def test_datasets(spark, tmp_path):
    df = spark.range(50).selectExpr("50 - id AS release_id", "cast(null AS string) AS title")
    m = datasets.write_dataset({"releases": df}, str(tmp_path), "2026-01-01", {"releases": ["release_id"]})
    root = str(tmp_path / "snapshot=2026-01-01")
    assert m["rows"] == {"releases": 50} and datasets.verify_dataset(spark, root).count() == 0
    assert [r.release_id for r in tables.snapshot_table(spark, root, "releases").orderBy("release_id").collect()] == list(range(1, 51))
    assert tables.snapshot_table(spark, root, "masters").count() == 0
    with pytest.raises(FileExistsError):
        datasets.write_dataset({"releases": df}, str(tmp_path), "2026-01-01")
    first = tmp_path / "snapshot=2026-01-01" / m["files"][0]["path"]
    first.write_bytes(first.read_bytes() + b"x")
    assert [r.problem for r in datasets.verify_dataset(spark, root).collect()] == ["size"]
    assert datasets.resume_report(spark, root)["corrupt"]
    assert datasets.artifact_diff({"a": [1, 2], "b": 1}, {"a": [1, 3], "c": 1}) == [("$.b", "removed"), ("$.c", "added"), ("$.a[1]", "value")]
    row = datasets.with_stable_id(spark.createDataFrame([(1, "x")], "a int, b string"), ["a", "b"], "id").collect()[0]
    assert row.id == datasets.stable_id([1, "x"])


def test_dataset_on_a_store_that_only_spark_opens(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.data.link./d", f"file://{tmp_path}")
    root, at = "viewfs://data/d/sets", "viewfs://data/d/sets/snapshot=2026-01-01"
    people = spark.createDataFrame([(i, f"n{i}") for i in range(40)], "artist_id long, name string")
    masters = spark.createDataFrame([], tables.SCHEMAS["masters"])
    m = datasets.write_dataset({"artists": people, "masters": masters}, root, "2026-01-01", {"artists": ["artist_id"]}, file_rows=7)
    assert m["rows"] == {"artists": 40, "masters": 0} and sum(f["table"] == "artists" for f in m["files"]) >= 6
    assert datasets.read_manifest(spark, at) == m and datasets.verify_dataset(spark, at).count() == 0
    relations = spark.createDataFrame([("d", 1, 2, "n", "member_of", "u")], tables.SCHEMAS["artist_relations"])
    read = lambda s, r, t: s.read.parquet(f"{r}/table={t}")
    more = datasets.migrate_dataset(spark, at, "viewfs://data/d/next", "artist_relations", relations, read)
    assert more["rows"] == {"artists": 40, "masters": 0, "artist_relations": 1} and more["migrated_from"] == datasets.content_hash(m)
    edges = spark.createDataFrame([(1, 2, 9), (2, 1, 9)], "artist_a_id long, artist_b_id long, release_id long")
    g = datasets.export_graph(edges, people.withColumnRenamed("name", "title"), "viewfs://data/d/graphs", "2026-01-01")
    assert g["rows"] == {"artists": 2, "edges": 1} and g["kind"] == "graph"
    again = datasets.write_dataset({"artists": people.limit(3)}, root, "2026-01-01", overwrite=True)
    assert again["rows"] == {"artists": 3} and datasets.verify_dataset(spark, at).count() == 0
    store = datasets.Store(spark, root)
    store.delete(f"snapshot=2026-01-01/{again['files'][0]['path']}")
    assert [r.problem for r in datasets.verify_dataset(spark, at).collect()] == ["missing"]
    with pytest.raises(datasets.DatasetError):
        datasets.read_manifest(spark, "viewfs://data/d/none")


def test_changes_of_artifacts_as_rows(spark):
    old = {"a": [1, 2, {"x": 1}], "b": 1, "same": {"k": [True, None, "t"]}, "t": 1, "gone": {"deep": [1]}, "n": None, "f": 1}
    new = {"a": [1, 3, {"x": 2}, 5], "c": {"new": [1, 2]}, "same": {"k": [True, None, "t"]}, "t": "1", "b": 1, "n": None, "f": 1.5}
    frame = lambda v: spark.createDataFrame([(json.dumps(v),)], "artifact string")
    got = sorted(tuple(r) for r in datasets.artifact_changes(frame(old), frame(new)).collect())
    assert got == sorted(datasets.artifact_diff(old, new)) and len(got) == 7
    rows = {r.path: (r.kind, r.value) for r in datasets.artifact_rows(frame(old)).collect()}
    assert rows["$.a[2].x"] == ("integer", "1") and rows["$.same.k[1]"] == ("null", None) and rows["$.gone"] == ("object", None)
    assert datasets.artifact_changes(frame(old), frame(old)).count() == 0


def test_failures_of_a_compact_graph(spark):
    good = [(-1, 0, 1, "5"), (5, 1, 2, "-1,6"), (6, 3, 1, "5")]
    bad = {
        "node comes twice": [*good, (6, 3, 1, "5")], "degree is not the number of neighbours": [*good[:2], (6, 3, 2, "5")], "offset is not the sum of the degrees before": [*good[:2], (6, 4, 1, "5")],
        "neighbours are not sorted and distinct": [good[0], (5, 1, 2, "6,-1"), good[2]], "node is its own neighbour": [*good[:2], (6, 3, 2, "5,6")], "neighbour is no node": [*good[:2], (6, 3, 2, "5,9")],
        "edge has no way back": [good[0], (5, 1, 1, "6"), (6, 2, 1, "5")], "anchors are neighbours": [(-2, 0, 1, "-1"), (-1, 1, 1, "-2")],
    }
    frame = lambda rows: spark.createDataFrame(rows, "node long, offset long, degree long, neighbours string")
    assert routes.csr_failures(frame(good)).count() == 0
    for why, rows in bad.items():
        assert why in {r.failure for r in routes.csr_failures(frame(rows)).collect()}, why


def test_selection_and_schedule():
    candidates = [{"id": i, "a": i % 3, "b": i % 2, "score": 10 - i, "artist_id": i % 2} for i in range(9)]
    picked = selection.greedy_diversified(candidates, ("a", "b"), 6, max_uses=3)
    assert picked[0]["id"] == 0 and all(sum(p[k] == v for p in picked) <= 3 for k in "ab" for v in range(3))
    assert len(selection.editorial_shortlist(candidates, ("a", "b"), size=5)) == 5
    s = selection.daily_schedule(candidates, "2026-01-30", 4, "seed")
    more = selection.extend_schedule(s, candidates, 3, "seed")
    assert more["entries"][:4] == s["entries"] and more["entries"][-1]["date"] == date(2026, 2, 5).isoformat() and selection.schedule_failures(more, candidates) == []
    more["entries"][1] = more["entries"][0]
    assert len(selection.schedule_failures(more, candidates)) >= 3
    assert len(selection.stratified_pairs({i: i for i in range(30)}, 8)) == 8


def test_deep_tracks_and_formats_only(spark, tmp_path):
    nest = lambda d: "<track><title>x</title>" + (f"<sub_tracks>{nest(d - 1)}</sub_tracks>" if d else "") + "</track>"
    dump = lambda d: f'<releases><release id="1"><title>t</title><formats><format name="LP" qty="1"/></formats><tracklist>{nest(d)}</tracklist></release></releases>'
    (tmp_path / "ok.xml").write_text(dump(4))
    inner = dump(20).replace('<release id="1">', '<release id="2"><artists><artist><id>7</id><name>A &amp; B</name></artist></artists>').replace("<title>x</title></track>", "<title>x</title><artists><artist><id>9</id><name>N</name></artist></artists></track><track><title>last</title></track>", 1)
    (tmp_path / "deep.xml").write_text(dump(1).replace("</releases>", "") + '<release id="3"><title>broken</title><tracklist></release>' + inner.replace("<releases>", ""))
    ok = tables.read_release_dump(spark, str(tmp_path / "ok.xml"), "d", "u")
    assert [r.track_path for r in ok["tracks"].orderBy("track_index").collect()] == ["0", "0.0", "0.0.0", "0.0.0.0", "0.0.0.0.0"] and ok["bad_records"].count() == 0
    deep = tables.read_release_dump(spark, str(tmp_path / "deep.xml"), "d", "u")
    rows = deep["tracks"].where("release_id = 2").orderBy("track_index").collect()
    assert [r.track_path for r in rows] == [".".join("0" * (d + 1)) for d in range(21)] + [".".join("0" * 20) + ".1"]
    assert [r.parent_track_index for r in rows] == [None, *range(20), 19] and rows[-1].title == "last"
    assert {(r.credit_scope, r.artist_id, r.name, r.track_index) for r in deep["credits"].collect()} == {("release_artist", 7, "A & B", None), ("track_artist", 9, "N", 20)}
    assert deep["tracks"].where("release_id = 1").count() == 2 and deep["releases"].count() == 2 and deep["bad_records"].count() == 1
    some = spark.createDataFrame([(1,)], "release_id long")
    assert [r.format_name for r in tables.read_release_formats(spark, str(tmp_path / "deep.xml"), "d", some).collect()] == ["LP"]
    assert tables.read_release_formats(spark, str(tmp_path / "ok.xml"), "d", some.where("release_id > 1")).count() == 0


def test_cards():
    card = lambda t, a, y, link="": f'<div class="x release-block-info"><h3 class="release-block-title"><a href="{link}">{t}</a></h3><br><span class="release-block-artist">{a}</span><span class="release-block-year">{y}</span></div>'
    got = html.candidates(card("Blue", "Ann", "(1971)", "/release/9-blue") + card("Red", "", "1972") + card("Green", "Cid", ""))
    assert [(c["rank"], c["artist"], c["title"], c["year"], c["release_hint"], c["confidence"]) for c in got] == [(1, "Ann", "Blue", 1971, 9, "high"), (2, "Cid", "Green", None, None, "low")]


def test_runs_reports_and_manifests(spark, tmp_path):
    (tmp_path / "staged").mkdir()
    (tmp_path / "staged" / "a.json").write_text("{}")
    assert [f["path"] for f in datasets.publish_run(str(tmp_path / "staged"), str(tmp_path / "done" / "run"))] == ["a.json"]
    with pytest.raises(FileExistsError):
        datasets.publish_run(str(tmp_path / "other"), str(tmp_path / "done" / "run"))
    assert [m["kind"] for m in datasets.dump_manifest("20260601", "https://example.org/data/")] == ["artists", "labels", "masters", "releases"]
    with pytest.raises(ValueError):
        datasets.dump_manifest("2026-06", "x")
    assert datasets.artifact_report({"a": 1}, {"a": 1})["identical"]
    changed = datasets.artifact_report({"a_version": "x", "n": 1}, {"a_version": "y", "n": 1})
    assert changed["versions"] == {"a_version": ("x", "y")} and changed["differences"] == [("$.a_version", "value")]
    df = spark.range(5).selectExpr("id AS release_id")
    for _ in range(2):
        datasets.write_dataset({"releases": df}, str(tmp_path), "2026-01-02", overwrite=True)
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".snap")] == []
    r = tables.random_credits(spark, 20, 50, 4)
    assert r.select("release_id").distinct().count() == 20 and r.where("credit_scope = 'release_artist'").count() == 20


def test_paths_in_compact_graphs(spark):
    from quillgraph.operators import analyses, routes

    g = {"node_ids": [1, 2, 3, 4, 9], "offsets": [0, 2, 4, 6, 8, 8], "neighbors": [1, 2, 0, 3, 0, 3, 1, 2]}
    assert routes.csr_path(g, 1, 4, 3) == ("found", [1, 2, 4]) and routes.csr_path(g, 1, 4, 3, without=frozenset({(1, 2)})) == ("found", [1, 3, 4])
    assert routes.csr_path(g, 1, 9, 4) == ("none", []) and routes.csr_path(g, 1, 4, 1) == ("none", []) and routes.csr_path(g, 1, 4, 3, max_nodes=2) == ("inconclusive", [])
    groups = spark.createDataFrame([(1, 100), (2, 100), (3, 4)], "artist_id long, group_id long")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 5), (1, 3)], "a long, b long")
    assert {(r.a, r.b): r.excluded for r in analyses.family_excluded(pairs, groups).collect()} == {(1, 2): True, (3, 4): True, (5, 5): True, (1, 3): False}
