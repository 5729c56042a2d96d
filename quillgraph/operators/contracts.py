"""Contract checks of published JSON artifacts: each returns the failures it finds, none for a sound artifact."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from itertools import pairwise
from typing import Any

from quillgraph.sources.datasets import content_hash, stable_id

STATUSES = ("found", "no_path", "skipped")


def key_failures(value: dict, required: Iterable[str], optional: Iterable[str] = ()) -> list[str]:
    """Closed sets of keys: missing and unknown ones."""
    required, optional = set(required), set(optional)
    return [f"missing {k}" for k in sorted(required - value.keys())] + [f"unknown {k}" for k in sorted(value.keys() - required - optional)]


def hash_failures(value: dict, field: str, over: Iterable[str]) -> list[str]:
    return [] if value.get(field) == content_hash({k: value.get(k) for k in over}) else [f"{field} does not match its content"]


def forbidden_failures(value: Any, substrings: Iterable[str] = (), keys: Iterable[str] = ("seed",), at: str = "$") -> list[str]:
    """Texts that hold a forbidden part (without regard to case) and forbidden keys, anywhere."""
    substrings, keys = [s.lower() for s in substrings], set(keys)
    if isinstance(value, dict):
        return [f"{at}.{k} is not allowed" for k in value if k in keys] + [f for k, v in value.items() for f in forbidden_failures(v, substrings, keys, f"{at}.{k}")]
    if isinstance(value, list):
        return [f for i, v in enumerate(value) for f in forbidden_failures(v, substrings, keys, f"{at}[{i}]")]
    return [f"{at} holds {s!r}" for s in substrings if isinstance(value, str) and s in value.lower()]


def compact_graph_failures(g: dict) -> list[str]:
    """Sorted distinct nodes, monotonic offsets, parallel arrays of one length, neighbours in range, sorted, mutual and not the
    node itself."""
    nodes, offsets, near = g.get("node_ids", []), g.get("offsets", []), g.get("neighbors", [])
    out = []
    if not nodes or any(isinstance(n, bool) or not isinstance(n, int) for n in nodes):
        return ["node_ids must be integers"]
    if nodes != sorted(set(nodes)):
        out.append("node_ids must be sorted and distinct")
    if len(offsets) != len(nodes) + 1 or (offsets and (offsets[0] != 0 or offsets[-1] != len(near))) or any(b < a for a, b in pairwise(offsets)):
        return [*out, "offsets must rise from 0 to the number of neighbours"]
    out += [f"{k} has another length than neighbors" for k in ("evidence_release_ids", "edge_role_a", "edge_role_b") if k in g and len(g[k]) != len(near)]
    if any(not 0 <= n < len(nodes) for n in near):
        return [*out, "a neighbour is out of range"]
    slots = {(i, n) for i in range(len(nodes)) for n in near[offsets[i] : offsets[i + 1]]}
    for i in range(len(nodes)):
        part = near[offsets[i] : offsets[i + 1]]
        if part != sorted(set(part)):
            out.append(f"the neighbours of {nodes[i]} must be sorted and distinct")
        if i in part:
            out.append(f"{nodes[i]} is its own neighbour")
    out += [f"the edge {nodes[a]} - {nodes[b]} has no way back" for a, b in sorted(slots) if (b, a) not in slots]
    albums = g.get("album_virtual_nodes", [])
    virtual = [a.get("virtual_artist_id") for a in albums]
    out += [f"virtual node {v} is not a negative node" for v in virtual if v is None or v >= 0 or v not in nodes]
    out += [f"{what} {k} comes twice" for what, xs in (("virtual node", virtual), ("album", [a.get("album_id") for a in albums])) for k, n in Counter(xs).items() if n > 1]
    return out


def connectivity_failures(artifact: dict) -> list[str]:
    """Known statuses; a found pair has its hops in a row from end to end, a skipped one a reason, no other has hops."""
    out = []
    for i, p in enumerate(artifact.get("pairs", [])):
        at = f"pair {i}"
        if p.get("status") not in STATUSES:
            out.append(f"{at}: unknown status {p.get('status')!r}")
        hops = p.get("hops") or []
        if p.get("status") == "found":
            if p.get("hop_count") != len(hops):
                out.append(f"{at}: hop_count is not the number of hops")
            ends = [p.get("artist_a_id"), *(h.get("to") for h in hops)]
            if any(h.get("from") != e for h, e in zip(hops, ends)) or (hops and hops[-1].get("to") != p.get("artist_b_id")):
                out.append(f"{at}: hops do not lead from end to end")
            out += [f"{at}: a hop has no evidence" for h in hops if not h.get("release_id")]
        elif hops:
            out.append(f"{at}: hops without a found path")
        if p.get("status") == "skipped" and not p.get("skip_reason"):
            out.append(f"{at}: skipped without a reason")
    return out


def round_failures(artifact: dict, performers: dict[Any, set[int]]) -> list[str]:
    """Rounds over albums: the answers are exactly the shared performers, distractors are none of them, ids follow from content."""
    out, seen = [], set()
    for r in artifact.get("rounds", []):
        at = f"round {r.get('id')}"
        want = performers.get(r.get("album_a"), set()) & performers.get(r.get("album_b"), set())
        if set(r.get("answers", [])) != want:
            out.append(f"{at}: answers are not the shared performers")
        if set(r.get("distractors", [])) & want:
            out.append(f"{at}: a distractor is an answer")
        if r.get("id") != stable_id([r.get("album_a"), r.get("album_b"), *sorted(r.get("answers", []))]):
            out.append(f"{at}: the id does not follow from its content")
        if r.get("id") in seen:
            out.append(f"{at} comes twice")
        seen.add(r.get("id"))
    return out


def registry_failures(registry: dict, fields: Iterable[str] = ("titles", "years", "caveat_flags")) -> list[str]:
    """Parallel arrays of one length over sorted distinct release ids."""
    ids = registry.get("release_ids", [])
    out = [] if ids == sorted(set(ids)) else ["release_ids must be sorted and distinct"]
    return out + [f"{f} has another length than release_ids" for f in fields if len(registry.get(f, [])) != len(ids)]


def catalog_failures(catalog: dict) -> list[str]:
    albums = catalog.get("albums", [])
    out = [f"{k} {v} comes twice" for k in ("id", "artist_id") for v, n in Counter(a.get(k) for a in albums).items() if n > 1]
    return out + hash_failures(catalog, "catalog_version", ("albums",))


def membership_failures(membership: dict, catalog: dict) -> list[str]:
    """Every album of the catalog once, with sorted distinct artists."""
    have, want = Counter(a["album_id"] for a in membership.get("albums", [])), {a["id"] for a in catalog.get("albums", [])}
    out = [f"album {i} is missing" for i in sorted(want - have.keys(), key=str)] + [f"album {i} is unknown" for i in sorted(have.keys() - want, key=str)] + [f"album {i} comes twice" for i, n in have.items() if n > 1]
    return out + [f"artists of {a['album_id']} must be sorted and distinct" for a in membership.get("albums", []) if a["artist_ids"] != sorted(set(a["artist_ids"]))]


def version_failures(value: dict, catalog: dict, where: str = "catalog_version") -> list[str]:
    """An artifact belongs to exactly one generation of the catalog."""
    return [] if value.get(where) == catalog.get("catalog_version") else [f"{where} is not the catalog's"]


def challenge_failures(artifact: dict, catalog: dict | None = None) -> list[str]:
    """Albums with a main release, and paths whose hops name published releases and artists only."""
    if not isinstance(artifact, dict):
        return ["a challenge must be an object"]
    out = key_failures(artifact, ("schema_version", "provenance", "albums", "artists", "paths", "releases"))
    origin = artifact.get("provenance") or {}
    out += [f"provenance.{k} is required" for k in ("source", "license", "snapshot_date", "generated_by") if not origin.get(k)]
    if catalog is not None and origin.get("catalog_version") is not None:
        out += version_failures(origin, catalog)
    artists, releases = ({x.get(k) for x in artifact.get(n, [])} for n, k in (("artists", "artist_id"), ("releases", "release_id")))
    out += [f"album {a.get('id')} has no main release" for a in artifact.get("albums", []) if not _positive(a.get("main_release_id"))]
    for p in artifact.get("paths", []):
        for h in p.get("hops", []):
            if h.get("release_id") not in releases:
                out.append(f"path {p.get('id')}: release {h.get('release_id')} is not published")
            out += [f"path {p.get('id')}: artist {h.get(k)} is not published" for k in ("artist_a_id", "artist_b_id") if h.get(k) not in artists]
    return out + forbidden_failures(artifact)


def _positive(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x > 0


def album_art_version(entries: list[dict]) -> str:
    """Follows from the albums and their two addresses, in any order."""
    return content_hash(sorted(([e.get("album_id"), e.get("uri150"), e.get("uri")] for e in entries), key=str))


def album_art_failures(registry: dict, catalog: dict, hosts: Iterable[str] = ("i.discogs.com",)) -> list[str]:
    """Covers of known albums, each once, by https from approved hosts; an empty registry is sound."""
    entries, known = registry.get("albums", []), {a.get("id") for a in catalog.get("albums", [])}
    out = version_failures(registry, catalog)
    if registry.get("art_version") != album_art_version(entries):
        out.append("art_version does not match its content")
    out += [f"album {i} comes twice" for i, n in Counter(e.get("album_id") for e in entries).items() if n > 1]
    for e in entries:
        at = f"album {e.get('album_id')}"
        if e.get("album_id") not in known:
            out.append(f"{at} is unknown")
        if not _positive(e.get("main_release_id")):
            out.append(f"{at} has no main release")
        for k in ("uri150", "uri"):
            scheme, _, rest = str(e.get(k) or "").partition("://")
            if scheme.lower() != "https" or rest.split("/")[0].split(":")[0].lower() not in set(hosts) or "/" not in rest:
                out.append(f"{at}: {k} is not an address of an approved host")
        out += [f"{at}: {k} must be an integer" for k in ("width", "height") if k in e and not isinstance(e[k], int)]
    return out + forbidden_failures(registry, ("token=", "/home/", "data/private"), ())


def contributor_index_failures(index: dict, catalog: dict, categories: Iterable[str], limits: tuple[int, int, int] = (5, 10, 20)) -> list[str]:
    """Contributors in order of distinct ids; known categories and albums; lists within their limits; neighbours that are not
    the contributor; a next step that is a listed neighbour without a category in common."""
    rows, albums, categories = index.get("contributors", []), {a.get("id") for a in catalog.get("albums", [])}, set(categories)
    ids = [r.get("artist_id") for r in rows]
    out = version_failures(index, catalog)
    if ids != sorted(set(ids)):
        out.append("contributors must be sorted and distinct")
    kinds = {r.get("artist_id"): set(r.get("role_categories", [])) for r in rows}
    for r in rows:
        at = f"contributor {r.get('artist_id')}"
        if not r.get("name"):
            out.append(f"{at} has no name")
        if not r.get("role_categories") or set(r["role_categories"]) - categories:
            out.append(f"{at} has no or unknown role categories")
        out += [f"{at}: album {a} is unknown" for a in r.get("albums", []) if a not in albums]
        near = r.get("neighboring_contributor_ids", [])
        out += [f"{at}: {k} is longer than {n}" for k, n in zip(("role_text_examples", "evidence", "neighboring_contributor_ids"), limits, strict=True) if len(r.get(k, [])) > n]
        if r.get("artist_id") in near or len(near) != len(set(near)):
            out.append(f"{at}: neighbours must be distinct others")
        if r.get("connection_count", 0) < len(near):
            out.append(f"{at}: more neighbours than connections")
        step = r.get("interesting_next_step")
        if step is not None and (step.get("artist_id") not in near or kinds.get(r.get("artist_id"), set()) & kinds.get(step.get("artist_id"), set())):
            out.append(f"{at}: the next step is no neighbour of other categories")
    return out + forbidden_failures(index, ("worked with", "collaborated with", "influenced"))


def record_route_failures(universe: dict, artifact: dict) -> list[str]:
    """Routes between known albums and artists, in a row from end to end, each hop with evidence, each pair of ends once."""
    albums, artists = ({x.get(k) for x in universe.get(n, [])} for n, k in (("albums", "id"), ("artists", "artist_id")))
    out, pairs, ids = [], Counter(), Counter()
    for r in artifact.get("rounds", []):
        at, hops = f"round {r.get('id')}", r.get("hops", [])
        ids[r.get("id")] += 1
        out += [f"{at}: album {r.get(k)} is unknown" for k in ("from_album_id", "to_album_id") if r.get(k) not in albums]
        out += [f"{at}: artist {h.get(k)} is unknown" for h in hops for k in ("artist_a_id", "artist_b_id") if h.get(k) not in artists]
        if not hops or r.get("hop_count") != len(hops):
            out.append(f"{at}: hop_count is not the number of hops")
        if any(x.get("artist_b_id") != y.get("artist_a_id") for x, y in pairwise(hops)):
            out.append(f"{at}: hops are not in a row")
        out += [f"{at}: a hop has no evidence" for h in hops if not _positive(h.get("release_id"))]
        if hops:
            pairs[frozenset((hops[0].get("artist_a_id"), hops[-1].get("artist_b_id")))] += 1
    return out + [f"round {i} comes twice" for i, n in ids.items() if n > 1] + [f"the ends {sorted(p, key=str)} come twice" for p, n in pairs.items() if n > 1]


def extracted_failures(artifact: dict) -> list[str]:
    """Candidates extracted from a list page: closed keys, a known confidence, ids that are positive or null."""
    out = key_failures(artifact, ("schema_version", "source", "candidates"))
    for i, c in enumerate(artifact.get("candidates", [])):
        out += [f"candidate {i}: {f}" for f in key_failures(c, ("rank", "artist", "title", "year", "master_id", "release_id", "confidence"))]
        if c.get("confidence") not in ("high", "medium", "low"):
            out.append(f"candidate {i}: unknown confidence")
        out += [f"candidate {i}: {k} must be positive or null" for k in ("master_id", "release_id") if c.get(k) is not None and not _positive(c[k])]
    return out + forbidden_failures(artifact, ("/home/", "data/private"), ())


def resolved_failures(artifact: dict) -> list[str]:
    """Resolved albums: each artist and master once, with a positive main release; positions are those of the candidates."""
    rows = artifact.get("resolved", [])
    out = [f"{k} {v} comes twice" for k in ("artist_id", "master_id") for v, n in Counter(r.get(k) for r in rows).items() if n > 1]
    out += [f"album {r.get('master_id')} has no main release" for r in rows if not _positive(r.get("release_id"))]
    both = {r.get("position") for r in rows} & {r.get("position") for r in artifact.get("unresolved", [])}
    return out + [f"candidate {p} is resolved and unresolved" for p in sorted(both, key=str)]


def all_failures(artifacts: dict[str, Any], categories: Iterable[str]) -> dict[str, list[str]]:
    """Failures of a whole publication by artifact; every name is there, with none for a sound one, and a missing one is a failure."""
    catalog = artifacts.get("catalog") or {}
    checks = {
        "catalog": lambda a: catalog_failures(a), "album_art": lambda a: album_art_failures(a, catalog), "challenge": lambda a: challenge_failures(a, catalog),
        "record_routes": lambda a: record_route_failures(a.get("universe", {}), a.get("rounds", {})), "contributor_index": lambda a: contributor_index_failures(a, catalog, categories),
        "compact_graph": lambda a: compact_graph_failures(a), "membership": lambda a: membership_failures(a, catalog), "registry": lambda a: registry_failures(a), "connectivity": lambda a: connectivity_failures(a),
    }
    return {name: check(artifacts[name]) if isinstance(artifacts.get(name), dict) else [f"{name} is missing"] for name, check in checks.items()}
