"""Small hand-made credit models for tests."""

from quillgraph.plans.lens import Model

RELEASES = "release_id long, title string, country string, released string, master_id long, master_is_main_release boolean, data_quality string"
CREDITS = "release_id long, track_index int, track_title string, credit_scope string, artist_id long, name string, role_text string, playable_identity boolean"
FORMATS = "release_id long, format_index int, format_name string, descriptions array<string>"
MASTERS = "master_id long, title string, genres array<string>, styles array<string>"
RELATIONS = "artist_id long, related_artist_id long, relation string"

NAMES = {100: "Alice", 200: "Bob", 300: "Cara", 400: "Dan", 500: "Eve", 501: "PlusOne", 502: "PlusTwo", 600: "Frank", 194: "Various"}


def model(spark, credits, releases=None, formats=(), masters=(), relations=()):
    ids = sorted({c[0] for c in credits})
    releases = releases or [(i, f"Title {i}", "UK", f"{1992 + i}", 900 + i, True, "ok") for i in ids]
    rows = [(r, t, title, scope, a, NAMES.get(a, f"Artist {a}"), role, a is not None) for r, t, title, scope, a, role in credits]
    return Model(
        spark.createDataFrame(releases, RELEASES), spark.createDataFrame(rows, CREDITS), spark.createDataFrame(list(formats), FORMATS),
        spark.createDataFrame(list(masters), MASTERS), spark.createDataFrame(list(relations), RELATIONS),
    )


def album(release, artists):
    """Each artist billed and performing on the first track."""
    return [c for a in artists for c in ((release, None, None, "release_artist", a, "Performer"), (release, 0, "Song", "track_artist", a, None))]


def shared(spark):
    credits = album(1, [100, 200]) + album(2, [200, 300]) + album(3, [300, 400]) + album(4, [100, 500, 501, 502]) + album(5, [100]) + album(6, [400, 500]) + album(7, [194, 600])
    return model(spark, credits + [(5, None, None, "release_credit", None, None)])
