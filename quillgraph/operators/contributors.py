"""Contributors: names, personnel, search, seeds, and the index of who is connected to whom by which evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.operators.edges import window_rank
from quillgraph.plans.lens import Model
from quillgraph.policies import Policy
from quillgraph.sources.scratch import materialize

#: Entries of an artist's lists at most: a list that is a feature, each with a total order.
ROLE_TEXTS, EVIDENCE, NEIGHBOURS = 5, 10, 20


class SeedError(ValueError):
    """A seed's name stands for no artist, or for several."""


def latest_names(credits: DataFrame, version: str) -> DataFrame:
    """Each artist's name in the latest version (the highest value of a column), the first in order among equals."""
    known = credits.where("artist_id IS NOT NULL AND name IS NOT NULL")
    newest = known.groupBy("artist_id").agg(F.max(version).alias(version))
    return known.join(newest, ["artist_id", version]).groupBy("artist_id").agg(F.min("name").alias("name"))


def release_personnel(model: Model) -> DataFrame:
    """Per release in order of its date, the distinct (artist, name, role) of its playable credits, sorted."""
    who = F.struct("artist_id", "name", "role_text")
    c = model.credits.where("playable_identity").groupBy("release_id").agg(F.sort_array(F.collect_set(who)).alias("contributors"))
    return model.releases.select("release_id", "title", "released").join(c, "release_id")


def resolve_seed(credits: DataFrame, names: DataFrame) -> DataFrame:
    """Seeds (name) with the artist that bears the name (case and outer blanks aside): artist_id, matched name, credits, and
    how many artists there are. Only seeds with exactly one are resolved; the others have a null artist_id."""
    low = lambda c: F.lower(F.trim(c))
    named = credits.where("artist_id IS NOT NULL").groupBy("artist_id", "name").agg(F.count(F.lit(1)).alias("n"))
    found = names.select(F.col("name").alias("seed")).distinct().join(named, low(F.col("seed")) == low(F.col("name")))
    best = found.groupBy("seed").agg(F.countDistinct("artist_id").alias("artists"), F.min(F.struct((-F.col("n")).alias("n"), "artist_id", "name")).alias("b"))
    one = F.col("artists") == 1
    best = best.select("seed", F.when(one, F.col("b.artist_id")).alias("artist_id"), F.when(one, F.col("b.name")).alias("matched"), F.when(one, -F.col("b.n")).alias("credits"), "artists")
    return names.select(F.col("name").alias("seed")).distinct().join(best, "seed", "left").withColumn("artists", F.coalesce("artists", F.lit(0)))


def one_seed(credits: DataFrame, name: str) -> int:
    """The artist of this name; SeedError if there is none, or more than one."""
    r = resolve_seed(credits, credits.sparkSession.createDataFrame([(name,)], "name string")).first()
    if r["artists"] != 1:
        raise SeedError(f"{name!r} stands for {r['artists']} artists")
    return r["artist_id"]


def search(names: DataFrame, text: str, degree: DataFrame, limit: int = 20) -> DataFrame:
    """Artists whose name holds the text (without regard to case), the most connected first."""
    hit = names.where(F.contains(F.lower("name"), F.lit(text.strip().lower())))
    return hit.join(degree, "artist_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "artist_id").limit(limit)


def mis_decoded(text: Column) -> Column:
    """Whether a text looks like UTF-8 that was read as Latin-1."""
    return text.like("%Ã%") | text.like("%â€%") | text.like("%Â%")


def placeholder_candidates(credits: DataFrame, policy: Policy, known: DataFrame | None = None) -> DataFrame:
    """Artists whose name marks a placeholder rather than a person, with their credits; for review, never for exclusion."""
    c = credits.where(F.lower(F.trim("name")).rlike(policy.placeholder_name_pattern))
    if known is not None:
        c = c.join(known.select("artist_id"), "artist_id", "left_anti")
    return c.groupBy("artist_id", "name").agg(F.count(F.lit(1)).alias("credits"))


def co_credits(model: Model, policy: Policy) -> DataFrame:
    """Pairs of playable artists credited on the same release, with the number of releases and the lowest one. Releases of more
    artists than the policy allows make no pairs, so a release costs a bounded number."""
    c = model.credits.where(R.is_playable() & R.not_placeholder(F.col("artist_id"), policy)).select("release_id", "artist_id").distinct()
    few = c.groupBy("release_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, policy.max_artists_per_release)).select("release_id")
    c = c.join(few, "release_id", "left_semi")
    x, y = (c.select("release_id", F.col("artist_id").alias(f"artist_{n}_id")) for n in "ab")
    pairs = x.join(y, "release_id").where("artist_a_id < artist_b_id")
    return pairs.groupBy("artist_a_id", "artist_b_id").agg(F.count(F.lit(1)).alias("releases"), F.min("release_id").alias("release_id"))


def _top_list(df: DataFrame, order: list, values: list, k: int, name: str) -> DataFrame:
    """artist_id with the list of the first k values in order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy("artist_id").orderBy(*order))).where(F.col("_rn") <= k)
    value = F.struct(*values) if len(values) > 1 else F.col(values[0])
    return ranked.groupBy("artist_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", value.alias("v")))), lambda x: x["v"]).alias(name))


def contributor_index(hops: DataFrame, model: Model, policy: Policy) -> DataFrame:
    """The index of all artists of these hops (album_a, album_b, artist_a_id, artist_b_id, release_id): categories of their
    roles, most frequent role texts, albums, decades of their evidence, number of neighbours, the neighbours by most hops then
    id, and evidence by release (as text) and role.

    A role is the text of a credit of the artist on a hop's release; credits without one count as evidence of nothing.
    Unknown categories are left out beside known ones.
    """
    both = hops.select("album_a", "album_b", F.col("artist_a_id").alias("artist_id"), F.col("artist_b_id").alias("other"), "release_id")
    both = both.unionByName(hops.select("album_a", "album_b", F.col("artist_b_id").alias("artist_id"), F.col("artist_a_id").alias("other"), "release_id"))
    albums = both.select("artist_id", F.explode(F.array("album_a", "album_b")).alias("album")).distinct().groupBy("artist_id").agg(F.sort_array(F.collect_set("album")).alias("albums"))
    near = both.groupBy("artist_id", "other").agg(F.count(F.lit(1)).alias("n"))
    connected = near.groupBy("artist_id").agg(F.count(F.lit(1)).alias("connection_count"))
    neighbours = _top_list(near, [F.desc("n"), "other"], ["other"], NEIGHBOURS, "neighbours")
    used = both.groupBy("artist_id", "release_id").agg(F.count(F.lit(1)).alias("hops"))
    texts = model.credits.where("artist_id IS NOT NULL AND role_text IS NOT NULL").groupBy("artist_id", "release_id", "role_text").agg(F.count(F.lit(1)).alias("n"))
    roles = used.join(texts, ["artist_id", "release_id"])
    counted = roles.groupBy("artist_id", "role_text").agg(F.sum(F.col("hops") * F.col("n")).alias("n"))
    examples = _top_list(counted, [F.desc("n"), "role_text"], ["role_text"], ROLE_TEXTS, "role_texts")
    evidence = _top_list(roles.select("artist_id", "release_id", "role_text").distinct(), [F.col("release_id").cast("string"), "role_text"], ["release_id", "role_text"], EVIDENCE, "evidence")
    kinds = counted.select("artist_id", F.explode(R.role_categories(F.col("role_text"), policy)).alias("c")).groupBy("artist_id").agg(F.sort_array(F.collect_set("c")).alias("all"))
    known = F.filter("all", lambda x: x != "unknown")
    kinds = kinds.select("artist_id", F.when(F.size(known) > 0, known).otherwise(F.col("all")).alias("role_categories"))
    year = R.year_of(F.col("released"))
    decades = roles.select("artist_id", "release_id").distinct().join(model.releases.select("release_id", R.decade_of(year).alias("d")).where("d IS NOT NULL"), "release_id").groupBy("artist_id").agg(F.sort_array(F.collect_set("d")).alias("decades"))
    out = connected.join(albums, "artist_id").join(neighbours, "artist_id")
    for part in (examples, evidence, kinds, decades):
        out = out.join(part, "artist_id", "left")
    return out.withColumn("role_categories", F.coalesce("role_categories", F.array(F.lit("unknown"))))


def interesting_next_step(index: DataFrame) -> DataFrame:
    """For each artist of an index, of its listed neighbours the one that shares no role category with it: the least connected,
    then the lowest id. Null where there is none. Connections break ties towards the less known, never towards hubs."""
    mine = index.select("artist_id", "role_categories", F.explode("neighbours").alias("next_id"))
    other = index.select(F.col("artist_id").alias("next_id"), F.col("role_categories").alias("theirs"), F.col("connection_count").alias("n"))
    fit = mine.join(other, "next_id").where(~F.arrays_overlap("role_categories", "theirs"))
    best = fit.groupBy("artist_id").agg(F.min(F.struct("n", "next_id"))["next_id"].alias("next_id"))
    return index.select("artist_id").join(best, "artist_id", "left")


def path_rounds(edges: DataFrame, albums: DataFrame, credits: DataFrame, policy: Policy, excluded: DataFrame | None = None, attempts: int = 8) -> DataFrame:
    """Rounds between the artists of albums (album_id, artist_id): one hop where two are neighbours, else two hops over the
    first of the lowest `attempts` common neighbours whose hops both hold.

    A hop holds if both its artists have a performer's role on its release. `excluded` (a, b with a < b) are pairs that make no
    round. Returns artist_a, artist_c, bridge (null: one hop), release_a, release_c.
    """
    plays = credits.where(R.performer_role(F.col("role_text"), policy)).select("release_id", "artist_id").distinct()
    sides = [plays.select("release_id", F.col("artist_id").alias(c)) for c in ("artist_a_id", "artist_b_id")]
    fit = edges.join(sides[0], ["release_id", "artist_a_id"], "left_semi").join(sides[1], ["release_id", "artist_b_id"], "left_semi").withColumn("ok", F.lit(True))
    near = edges.join(albums.select(F.col("artist_id").alias("artist_a_id")).distinct(), "artist_a_id", "left_semi")
    near = near.join(fit.select("artist_a_id", "artist_b_id", "ok"), ["artist_a_id", "artist_b_id"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    ends = albums.select(F.col("artist_id").alias("artist_b_id")).distinct()
    one = near.join(ends, "artist_b_id", "left_semi").where("artist_a_id < artist_b_id").select(F.col("artist_a_id").alias("artist_a"), F.col("artist_b_id").alias("artist_c"), F.col("release_id").alias("release_a"), "ok")
    x, y = (near.select(F.col("artist_a_id").alias(f"artist_{n}"), F.col("artist_b_id").alias("bridge"), F.col("release_id").alias(f"release_{n}"), F.col("ok").alias(f"ok_{n}")) for n in "ac")
    two = x.join(y, "bridge").where("artist_a < artist_c AND bridge <> artist_a AND bridge <> artist_c").join(one.select("artist_a", "artist_c"), ["artist_a", "artist_c"], "left_anti")
    two = window_rank(two, ["artist_a", "artist_c"], ["bridge"], attempts).where("ok_a AND ok_c")
    two = window_rank(two, ["artist_a", "artist_c"], ["bridge"], 1).select("artist_a", "artist_c", "bridge", "release_a", "release_c")
    none = F.lit(None).cast("long")
    out = one.where("ok").select("artist_a", "artist_c", none.alias("bridge"), "release_a", none.alias("release_c")).unionByName(two)
    if excluded is not None:
        out = out.join(excluded.select(F.col("a").alias("artist_a"), F.col("b").alias("artist_c")), ["artist_a", "artist_c"], "left_anti")
    return out


def demo_paths(edges: DataFrame, credits: DataFrame, seeds: DataFrame) -> DataFrame:
    """Candidate paths from each seed: every neighbour at one hop, and every artist at two hops that is none, over the bridge
    of the best evidence. A hop scores the credits of its two artists on its release, the distinct roles among them, and a half
    for each on a track; a pair of artists counts once, from its lower seed."""
    c = credits.select("release_id", "artist_id", "role_text", F.col("credit_scope").isin("track_artist", "track_credit").cast("int").alias("on_track"))
    steps = edges.join(seeds.select(F.col("artist_id").alias("artist_a_id")), "artist_a_id", "left_semi")
    second = edges.join(steps.select(F.col("artist_b_id").alias("artist_a_id")).distinct(), "artist_a_id", "left_semi")
    wanted = steps.unionByName(second).distinct()
    both = wanted.withColumn("artist_id", F.explode(F.array("artist_a_id", "artist_b_id"))).join(c, ["release_id", "artist_id"], "left")
    score = (F.count("on_track") + F.countDistinct("role_text") + F.lit(0.5) * F.coalesce(F.sum("on_track"), F.lit(0))).alias("score")
    scored = both.groupBy("artist_a_id", "artist_b_id").agg(score)
    one = scored.join(seeds.select(F.col("artist_id").alias("artist_a_id")), "artist_a_id", "left_semi").select(F.col("artist_a_id").alias("source"), F.col("artist_b_id").alias("target"), F.lit(None).cast("long").alias("bridge"), "score")
    x = one.select("source", F.col("target").alias("bridge"), F.col("score").alias("s"))
    two = x.join(scored.select(F.col("artist_a_id").alias("bridge"), F.col("artist_b_id").alias("target"), F.col("score").alias("t")), "bridge").where("source <> target")
    two = two.join(one.select("source", "target"), ["source", "target"], "left_anti").withColumn("score", F.col("s") + F.col("t"))
    two = window_rank(two, ["source", "target"], [F.desc("score"), "bridge"], 1).select("source", "target", "bridge", "score")
    paths = one.unionByName(two).withColumn("_lo", F.least("source", "target")).withColumn("_hi", F.greatest("source", "target"))
    return window_rank(paths, ["_lo", "_hi"], ["source"], 1).drop("_lo", "_hi")


def curated_paths(paths: DataFrame, limit: int = 8) -> DataFrame:
    """The best paths: by score falling, then source and target."""
    return paths.orderBy(F.desc("score"), "source", "target").limit(limit)


def route_measures(edges: DataFrame, pairs: DataFrame, hops: int = 3) -> DataFrame:
    """For pairs (start, end): shortest_hops within the bound (null: none, which is proven), and the number of equally short
    routes. Levels are counted by joins: the routes to an artist are the sum of those to its neighbours one level nearer, so no
    route is listed."""
    step = edges.select(F.col("artist_a_id").alias("at"), F.col("artist_b_id").alias("to"))
    state = pairs.select("start").distinct().select("start", F.col("start").alias("at"), F.lit(1).cast("decimal(38,0)").alias("n"), F.lit(0).alias("dist"))
    for d in range(1, hops + 1):
        last = state.where(F.col("dist") == d - 1).select("start", "at", "n")
        new = last.join(step, "at").groupBy("start", F.col("to").alias("at")).agg(F.sum("n").cast("decimal(38,0)").alias("n"))
        state = state.unionByName(materialize(new.join(state.select("start", "at"), ["start", "at"], "left_anti").withColumn("dist", F.lit(d)), "measures"))
    reached = state.where("dist > 0").select("start", F.col("at").alias("end"), F.col("dist").alias("shortest_hops"), F.col("n").cast("long").alias("equal_routes"))
    return pairs.select("start", "end").join(reached, ["start", "end"], "left")


def route_summary(measures: DataFrame) -> DataFrame:
    """Pairs, pairs with a route, and the least, median (exact) and greatest number of equally short routes."""
    return measures.agg(
        F.count(F.lit(1)).alias("pairs"), F.count("shortest_hops").alias("with_route"), F.min("equal_routes").alias("least"),
        F.expr("percentile(equal_routes, 0.5)").alias("median"), F.max("equal_routes").alias("most"), F.max("shortest_hops").alias("longest"),
    )


def balanced_cap(rounds: DataFrame, cap: int, order: tuple[str, ...] = ("easy", "medium", "hard")) -> DataFrame:
    """At most `cap` rounds (id, difficulty), taken in turn from each difficulty in order of id, then in order of id."""
    turn = F.row_number().over(Window.partitionBy("difficulty").orderBy("id"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("difficulty"))
    return rounds.withColumn("_turn", turn).orderBy("_turn", place, "id").limit(cap).drop("_turn").orderBy("id")


def rating(solved: Column, clues: Column, wrong: Column) -> Column:
    """How a round ended: revealed (not solved), clean (solved without clues or wrong answers), or with_clues."""
    return F.when(~solved, F.lit("revealed")).when((clues == 0) & (wrong == 0), F.lit("clean")).otherwise(F.lit("with_clues"))


def rating_summary(rounds: DataFrame) -> DataFrame:
    """Rounds played, and of each rating."""
    r = rounds.select(rating(F.col("solved"), F.col("clues"), F.col("wrong")).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("played"), *[F.count_if(F.col("r") == x).alias(x) for x in ("clean", "with_clues", "revealed")])


def initials(name: Column) -> Column:
    """The upper-case first letters of a name's words, each with a point; words that begin otherwise are left out."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w.rlike(r"^\p{L}"))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")


def slug(text: Column) -> Column:
    """Lower-cased letters and digits, with one hyphen for what is between; null if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.when(s != "", s)


def joined_texts(texts: Column, limit: int = 200) -> Column:
    """Distinct texts in the order given, joined by ", "; longer than the limit, it ends after the last whole text with an ellipsis."""
    whole = F.array_join(F.array_distinct(texts), ", ")
    cut = F.substring(whole, 1, limit - 1)
    back = F.regexp_replace(cut, r"(?s)^(.*), .*$", "$1")
    return F.when(F.char_length(whole) <= limit, whole).otherwise(F.concat(back, F.lit("…")))
