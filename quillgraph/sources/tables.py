"""Readers: snapshot tables, XML dumps, seed lists, policies, compact graphs and API records."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Tables of a snapshot. Tables stay readable when they are empty or missing.
SCHEMAS = {
    "releases": "snapshot_date string, release_id long, status string, title string, country string, released string, master_id long, master_is_main_release boolean, data_quality string, source_url string",
    "tracks": "snapshot_date string, release_id long, track_index int, parent_track_index int, track_path string, position string, title string, duration string",
    "credits": "snapshot_date string, release_id long, track_index int, track_path string, track_position string, track_title string, credit_scope string, artist_id long, name string, anv string, join_text string, role_text string, credited_tracks_text string, is_linked boolean, playable_identity boolean",
    "release_formats": "snapshot_date string, release_id long, format_index int, format_name string, quantity int, format_text string, descriptions array<string>",
    "masters": "snapshot_date string, master_id long, main_release_id long, title string, year int, genres array<string>, styles array<string>, data_quality string, source_url string",
    "master_artists": "snapshot_date string, master_id long, artist_id long, name string, anv string, join_text string, is_linked boolean, playable_identity boolean",
    "artist_relations": "snapshot_date string, artist_id long, related_artist_id long, related_name string, relation string, source_url string",
}

_ARTIST = "struct<id:string,name:string,anv:string,join:string,role:string,tracks:string>"
_TRACK = "position:array<string>,title:array<string>,duration:array<string>,artists:struct<artist:array<{a}>>,extraartists:struct<artist:array<{a}>>".format(a=_ARTIST)
#: Levels of tracks in the schema of the XML scan; releases with deeper ones are read by a parser of their own.
DEPTH = 5


def _track(depth: int) -> str:
    inner = f",sub_tracks:struct<track:array<{_track(depth - 1)}>>" if depth else ",sub_tracks:string"
    return f"struct<{_TRACK}{inner}>"


RELEASE = (
    f"_id string, _status string, title array<string>, country array<string>, released array<string>, data_quality array<string>, "
    f"master_id struct<_VALUE:string,_is_main_release:string>, artists struct<artist:array<{_ARTIST}>>, extraartists struct<artist:array<{_ARTIST}>>, "
    f"formats struct<format:array<struct<_name:string,_qty:string,_text:string,descriptions:struct<description:array<string>>>>>, tracklist struct<track:array<{_track(DEPTH - 1)}>>"
)
MASTER = f"_id string, main_release string, title string, year string, genres struct<genre:array<string>>, styles struct<style:array<string>>, data_quality string, artists struct<artist:array<{_ARTIST}>>"
ARTIST = "id string, name string, groups struct<name:array<struct<_VALUE:string,_id:string>>>, members struct<name:array<struct<_VALUE:string,_id:string>>>"


def snapshot_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a snapshot folder; the table's own folder is read, so that no columns come from parent folder names. A
    missing table is empty."""
    schema = T._parse_datatype_string(SCHEMAS[name])
    path = f"{root}/table={name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _xml(spark: SparkSession) -> DataFrameReader:
    """Records are found by their tags one by one, so that a broken one does not end the scan."""
    return spark.read.format("xml").option("useLegacyXMLParser", "true")


def clean(x: Column) -> Column:
    """Trimmed text, null if blank."""
    t = F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(t != "", t)


def positive(x: Column) -> Column:
    """A positive integer, else null."""
    t = F.regexp_extract(F.coalesce(clean(x), F.lit("")), r"^[0-9]{1,18}$", 0)
    return F.when(t != "", F.when(t.cast("long") > 0, t.cast("long")))


def _first(c: str) -> Column:
    """The first of repeated child elements counts."""
    return clean(F.get(F.col(c), F.lit(0)))


_FLAT = f"release_id long, artists array<{_ARTIST}>, extraartists array<{_ARTIST}>, tracks array<struct<path:string,position:string,title:string,duration:string,artists:array<{_ARTIST}>,extra:array<{_ARTIST}>>>"


def _too_deep(tracks: Column, depth: int = DEPTH) -> Column:
    """Whether tracks have sub-tracks below the last level of the schema."""
    below = (lambda t: clean(t["sub_tracks"]).isNotNull()) if depth <= 1 else (lambda t: _too_deep(t["sub_tracks"]["track"], depth - 1))
    return F.coalesce(F.exists(tracks, lambda t: F.coalesce(below(t), F.lit(False))), F.lit(False))


def _deep_releases(spark: SparkSession, path: str) -> DataFrame:
    """Releases with tracks of any depth, as rows of _FLAT, for records with as many openings of sub-tracks as a deep one must have.

    Records are split by their end tags as text, and each is parsed by itself; a stack takes the place of nesting."""

    def people(node, name: str) -> list[dict]:
        return [{k: a.findtext(k) for k in ("id", "name", "anv", "join", "role", "tracks")} for a in node.findall(f"{name}/artist")]

    def text(node, name: str) -> str | None:
        return (node.findtext(name) or "").strip() or None

    schema = to_arrow_schema(T._parse_datatype_string(_FLAT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for record in b.column("value").to_pylist():
                try:
                    release = ElementTree.fromstring(record[record.index("<release ") :] + "</release>")
                except (ValueError, ElementTree.ParseError):
                    continue  # the XML scan reports it as a bad record
                tracks, stack = [], [(str(i), t) for i, t in reversed(list(enumerate(release.findall("tracklist/track"))))]
                while stack:
                    at, t = stack.pop()
                    tracks.append({"path": at, **{k: text(t, k) for k in ("position", "title", "duration")}, "artists": people(t, "artists"), "extra": people(t, "extraartists")})
                    stack += [(f"{at}.{i}", x) for i, x in reversed(list(enumerate(t.findall("sub_tracks/track"))))]
                number = (release.get("id") or "").strip()
                out.append({"release_id": int(number) if number.isdigit() else None, "artists": people(release, "artists"), "extraartists": people(release, "extraartists"), "tracks": tracks})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    records = spark.read.option("lineSep", "</release>").text(path).where(F.size(F.split("value", "<sub_tracks>")) > DEPTH)
    return records.mapInArrow(run, _FLAT).where("release_id > 0")


def read_release_dump(spark: SparkSession, path: str, snapshot_date: str, source_url: str) -> dict[str, DataFrame]:
    """The four tables of a release dump (.xml or .xml.gz), each a projection of one streaming XML scan, and bad_records, the
    beginnings of records that could not be parsed, which the tables go without. Tracks nested deeper than DEPTH levels come from a
    second scan that parses only records that may have them."""
    raw = _xml(spark).option("rowTag", "release").option("columnNameOfCorruptRecord", "_bad").schema(f"{RELEASE}, _bad string").load(path)
    some = F.coalesce("_id", F.lit("")) != "-"  # of every record: the scan does not hand out the records alone
    bad = raw.where(F.col("_bad").isNotNull() & some).select(F.lit(snapshot_date).alias("snapshot_date"), positive(F.coalesce("_id", F.regexp_extract("_bad", '^<release[^>]* id="([0-9]+)"', 1))).alias("release_id"), F.substring("_bad", 1, 500).alias("record"))
    raw = raw.withColumn("release_id", positive(F.col("_id"))).where("release_id IS NOT NULL AND _bad IS NULL").drop("_bad")
    date = F.lit(snapshot_date).alias("snapshot_date")
    releases = raw.select(
        date, "release_id", clean(F.col("_status")).alias("status"), _first("title").alias("title"), _first("country").alias("country"), _first("released").alias("released"),
        positive(F.col("master_id._VALUE")).alias("master_id"), F.coalesce(F.lower("master_id._is_main_release") == "true", F.lit(False)).alias("master_is_main_release"),
        _first("data_quality").alias("data_quality"), F.lit(source_url).alias("source_url"),
    )
    formats = _formats(raw, snapshot_date)
    flat = raw.select("release_id", F.col("artists.artist").alias("artists"), F.col("extraartists.artist").alias("extraartists"), flat_tracks(F.col("tracklist.track")).alias("tracks"), _too_deep(F.col("tracklist.track")).alias("_deep"))
    deep = _deep_releases(spark, path).join(flat.where("_deep").select("release_id").distinct(), "release_id", "left_semi")
    flat = flat.where("NOT _deep").drop("_deep").unionByName(deep)
    t = flat.select("release_id", F.posexplode("tracks").alias("track_index", "t"), F.transform("tracks", lambda x: x["path"]).alias("_paths"))
    above = F.regexp_extract("t.path", r"^(.*)\.[0-9]+$", 1)
    tracks = t.select(
        date, "release_id", "track_index", F.when(above != "", (F.array_position("_paths", above) - 1).cast("int")).alias("parent_track_index"),
        F.col("t.path").alias("track_path"), F.col("t.position").alias("position"), F.col("t.title").alias("title"), F.col("t.duration").alias("duration"),
    )

    none = {k: F.lit(None).cast(v) for k, v in (("track_index", "int"), ("path", "string"), ("position", "string"), ("title", "string"))}

    def rows(df: DataFrame, list_: str, scope: str, at: dict[str, Column]) -> DataFrame:
        e = df.select("release_id", *[c.alias(f"_{k}") for k, c in at.items()], F.explode(list_).alias("a"))
        linked = positive(F.col("a.id"))
        return e.select(
            date, "release_id", F.col("_track_index").alias("track_index"), F.col("_path").alias("track_path"), F.col("_position").alias("track_position"), F.col("_title").alias("track_title"), F.lit(scope).alias("credit_scope"),
            linked.alias("artist_id"), clean(F.col("a.name")).alias("name"), clean(F.col("a.anv")).alias("anv"), clean(F.col("a.join")).alias("join_text"), clean(F.col("a.role")).alias("role_text"),
            clean(F.col("a.tracks")).alias("credited_tracks_text"), linked.isNotNull().alias("is_linked"), linked.isNotNull().alias("playable_identity"),
        )

    of_track = {"track_index": F.col("track_index"), "path": F.col("t.path"), "position": F.col("t.position"), "title": F.col("t.title")}
    credits = rows(flat, "artists", "release_artist", none).unionByName(rows(flat, "extraartists", "release_credit", none)).unionByName(rows(t, "t.artists", "track_artist", of_track)).unionByName(rows(t, "t.extra", "track_credit", of_track))
    return {"releases": releases, "tracks": tracks, "credits": credits, "release_formats": formats, "bad_records": bad}


def read_release_formats(spark: SparkSession, path: str, snapshot_date: str, release_ids: DataFrame | None = None) -> DataFrame:
    """The formats of a release dump alone (of these release_ids): a scan that parses no other element."""
    schema = "_id string, formats struct<format:array<struct<_name:string,_qty:string,_text:string,descriptions:struct<description:array<string>>>>>"
    raw = _xml(spark).option("rowTag", "release").schema(schema).load(path).withColumn("release_id", positive(F.col("_id"))).where("release_id IS NOT NULL")
    if release_ids is not None:
        raw = raw.join(release_ids.select("release_id").distinct(), "release_id", "left_semi")
    return _formats(raw, snapshot_date)


def _formats(raw: DataFrame, snapshot_date: str) -> DataFrame:
    f = raw.select("release_id", F.posexplode("formats.format").alias("format_index", "f"))
    return f.select(
        F.lit(snapshot_date).alias("snapshot_date"), "release_id", "format_index", clean(F.col("f._name")).alias("format_name"), positive(F.col("f._qty")).cast("int").alias("quantity"), clean(F.col("f._text")).alias("format_text"),
        F.coalesce(F.array_compact(F.transform("f.descriptions.description", clean)), F.array().cast("array<string>")).alias("descriptions"),
    )


def flat_tracks(tracks: Column, prefix: Column | None = None, depth: int = DEPTH) -> Column:
    """Tracks and their sub-tracks in pre-order: path (`0`, `0.1`, ...), position, title, duration, artists, extra."""

    def one(t: Column, i: Column) -> Column:
        path = i.cast("string") if prefix is None else F.concat(prefix, F.lit("."), i.cast("string"))
        first = lambda c: clean(F.get(t[c], F.lit(0)))
        own = F.array(F.struct(path.alias("path"), first("position").alias("position"), first("title").alias("title"), first("duration").alias("duration"), t["artists"]["artist"].alias("artists"), t["extraartists"]["artist"].alias("extra")))
        if depth <= 1:
            return own
        return F.concat(own, F.coalesce(flat_tracks(t["sub_tracks"]["track"], path, depth - 1), F.slice(own, 1, 0)))

    return F.flatten(F.transform(tracks, one))


def read_master_dump(spark: SparkSession, path: str, snapshot_date: str, source_url: str) -> dict[str, DataFrame]:
    raw = _xml(spark).option("rowTag", "master").schema(MASTER).load(path).withColumn("master_id", positive(F.col("_id"))).where("master_id IS NOT NULL")
    date = F.lit(snapshot_date).alias("snapshot_date")
    some = lambda c: F.coalesce(F.array_compact(F.transform(c, clean)), F.array().cast("array<string>"))
    masters = raw.select(
        date, "master_id", positive(F.col("main_release")).alias("main_release_id"), clean(F.col("title")).alias("title"), positive(F.col("year")).cast("int").alias("year"),
        some("genres.genre").alias("genres"), some("styles.style").alias("styles"), clean(F.col("data_quality")).alias("data_quality"), F.lit(source_url).alias("source_url"),
    )
    a = raw.select("master_id", F.explode("artists.artist").alias("a"))
    linked = positive(F.col("a.id"))
    artists = a.select(date, "master_id", linked.alias("artist_id"), clean(F.col("a.name")).alias("name"), clean(F.col("a.anv")).alias("anv"), clean(F.col("a.join")).alias("join_text"), linked.isNotNull().alias("is_linked"), linked.isNotNull().alias("playable_identity"))
    return {"masters": masters, "master_artists": artists}


def read_artist_relations(spark: SparkSession, path: str, snapshot_date: str, source_url: str) -> DataFrame:
    """Group memberships, as seen from either side."""
    raw = _xml(spark).option("rowTag", "artist").schema(ARTIST).load(path).withColumn("artist_id", positive(F.col("id"))).where("artist_id IS NOT NULL")

    def side(names: str, relation: str) -> DataFrame:
        e = raw.select("artist_id", F.explode(names).alias("n"))
        rows = e.select(F.lit(snapshot_date).alias("snapshot_date"), "artist_id", positive(F.col("n._id")).alias("related_artist_id"), clean(F.col("n._VALUE")).alias("related_name"), F.lit(relation).alias("relation"), F.lit(source_url).alias("source_url"))
        return rows.where("related_artist_id IS NOT NULL")

    return side("groups.name", "member_of").unionByName(side("members.name", "has_member"))


def read_seed_csv(spark: SparkSession, path: str, column: str = "release_id") -> DataFrame:
    """Distinct ascending ids of a CSV export; blank cells are skipped, others must be positive integers."""
    rows = spark.read.option("header", True).csv(path)
    if column not in rows.columns:
        raise ValueError(f"{path} has no column {column}")
    value = clean(F.col(column))
    bad = rows.where(value.isNotNull() & positive(F.col(column)).isNull()).select(value.alias("v")).limit(5).collect()
    if bad:
        raise ValueError(f"{column} is not a positive integer: {[r['v'] for r in bad]}")
    return rows.where(value.isNotNull()).select(positive(F.col(column)).alias(column)).distinct().orderBy(column)


def read_allowed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Release ids of a scoring index (JSON)."""
    return spark.read.option("multiLine", True).schema("allowed_release_ids array<long>").json(path).select(F.explode("allowed_release_ids").alias("release_id"))


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """Decisions by release of a policy file (JSON)."""
    c = spark.read.option("multiLine", True).schema("classifications array<struct<release_id:bigint,decision:string>>").json(path)
    return c.select(F.explode("classifications").alias("c")).select("c.release_id", "c.decision")


def read_compact_graph(spark: SparkSession, path: str) -> DataFrame:
    """Directed edges (artist_a_id, artist_b_id, release_id) of a published compact graph (JSON of CSR arrays)."""
    g = spark.read.option("multiLine", True).schema("node_ids array<long>, offsets array<long>, neighbors array<int>, evidence_release_ids array<long>").json(path)
    node = g.select("node_ids", "neighbors", "evidence_release_ids", F.posexplode("node_ids").alias("i", "artist_a_id"), "offsets")
    lo, hi = F.get("offsets", F.col("i")), F.get("offsets", F.col("i") + 1)
    slot = node.where(hi > lo).select("artist_a_id", "node_ids", "neighbors", "evidence_release_ids", F.explode(F.sequence(lo, hi - 1)).alias("s"))
    return slot.select("artist_a_id", F.get("node_ids", F.get("neighbors", F.col("s").cast("int"))).alias("artist_b_id"), F.get("evidence_release_ids", F.col("s").cast("int")).alias("release_id"))


_API_ARTIST = "struct<id:bigint,name:string,anv:string,join:string,role:string,tracks:string>"
API_RELEASE = f"id bigint, title string, country string, released string, master_id bigint, artists array<{_API_ARTIST}>, extraartists array<{_API_ARTIST}>, tracklist array<struct<position:string,title:string,artists:array<{_API_ARTIST}>,extraartists:array<{_API_ARTIST}>>>"


def api_credits(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Credit rows of API release records (JSON texts), in the shape of the snapshot's."""
    r = payloads.select(F.from_json(column, API_RELEASE).alias("r")).select("r.*").where("id IS NOT NULL")
    t = r.select("id", F.posexplode("tracklist").alias("i", "t"))
    none = F.lit(None).cast("int")

    def rows(df: DataFrame, list_: str, scope: str, index: Column) -> DataFrame:
        e = df.select("id", index.alias("track_index"), F.explode(list_).alias("a"))
        linked = F.when(F.col("a.id") > 0, F.col("a.id"))
        return e.select(F.col("id").alias("release_id"), "track_index", F.lit(scope).alias("credit_scope"), linked.alias("artist_id"), clean(F.col("a.name")).alias("name"), clean(F.col("a.role")).alias("role_text"), linked.isNotNull().alias("playable_identity"))

    return rows(r, "artists", "release_artist", none).unionByName(rows(r, "extraartists", "release_credit", none)).unionByName(rows(t, "t.artists", "track_artist", F.col("i"))).unionByName(rows(t, "t.extraartists", "track_credit", F.col("i")))


def generated_credits(spark: SparkSession, releases: int, per_release: int = 11, artists: int = 4000) -> DataFrame:
    """A synthetic credit table of any size, from id arithmetic only."""
    n = spark.range(releases * per_release)
    return n.selectExpr(f"id div {per_release} + 1 AS release_id", f"cast((id * 7919 + id div {per_release} * 104729) % {artists} + 1 AS bigint) AS artist_id", "cast(id % 5 AS int) AS track_index", "element_at(array('release_artist', 'track_artist', 'track_credit', 'release_credit'), cast(id % 4 AS int) + 1) AS credit_scope")


def manifest_files(path: str, table: str) -> list[str]:
    """Paths of a table's files by the manifest of a snapshot (a small local JSON file)."""
    with open(path, encoding="utf-8") as f:
        m = json.load(f)
    return [x["path"] for x in m["files"] if x["table"] == table]


def random_credits(spark: SparkSession, releases: int, artists: int, per_release: int = 11, seed: int = 1) -> DataFrame:
    """A random co-credit table (release_id, artist_id): each release names `per_release` artists drawn with a seed, the first of
    them billed. Rows that draw an artist twice count once."""
    slot = spark.range(releases * per_release)
    drawn = slot.select((F.col("id") / per_release).cast("long").alias("release_id"), (F.col("id") % per_release).alias("slot"), (F.rand(seed) * artists).cast("long").alias("artist_id"))
    return drawn.groupBy("release_id", "artist_id").agg(F.when(F.min("slot") == 0, "release_artist").otherwise("release_credit").alias("credit_scope"))
