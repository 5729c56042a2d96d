"""Policies: the word lists, patterns and limits by which credits, formats and masters are judged.

Every operator takes a Policy, so that other vocabularies (such as the one of the test tables) can be passed in.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# They must be these for right results.
NON_PERFORMER_ROLES = (
    "written-by", "written by", "mastered by", "mixed by", "recorded by", "lacquer cut by", "arranged by", "liner notes",
    "composed by", "lyrics by", "music by", "words by", "engineer", "producer", "co-producer", "design", "design concept",
    "photography by",
)
# The roles that grade a hop as one without a performer; they must be these for right results.
GRADING_ROLES = (
    "written-by", "written by", "mastered by", "remastered by", "mixed by", "recorded by", "lacquer cut by", "arranged by",
    "liner notes", "composed by", "lyrics by", "music by", "words by", "engineer", "producer", "co-producer", "design",
    "design concept", "photography by",
)
# Fixed value: names that mark a placeholder; it must be this for right results.
PLACEHOLDER_NAME_PATTERN = (
    r"^(various|various artists|unknown|unknown artist|no artist|not on label|"
    r"traditional|trad\.?|anonymous|uncredited|n/a|artist unknown|no artist listed)"
    r"( \([0-9]+\))?$"
)
# They must be these for right results.
COMPOSITION_ROLES = ("written-by", "written by", "composed by", "music by", "lyrics by", "words by", "songwriter", "song by", "libretto by")
PACKAGING_ROLES = (
    "design", "design concept", "art direction", "artwork", "artwork by", "layout", "illustration", "photography by",
    "photography", "liner notes", "sleeve notes", "a&r", "management", "translation", "lacquer cut by",
    "executive-producer", "executive producer", "coordinator", "supervised by", "authoring", "other",
)
REWORK_ROLES = ("remix", "remixed by", "re-edit", "re-edited by", "edit", "edited by", "dj mix", "mashup")
PRODUCTION_ROLES = ("producer", "co-producer", "produced by")
ENGINEERING_ROLES = ("engineer", "mixed by", "mastered by", "recorded by", "programmed by", "drum programming")
ARRANGEMENT_ROLES = ("arranged by", "conductor")
#: Fine categories of performers' roles.
PERFORMER_CATEGORIES = {
    "vocals": ("vocals", "lead vocals", "co-lead vocals", "choir", "chorus", "voice", "rap", "spoken word"),
    "backing_vocals": ("backing vocals", "background vocals", "additional vocals"),
    "guitar": ("guitar", "acoustic guitar", "electric guitar", "lead guitar", "rhythm guitar", "slide guitar", "steel guitar", "pedal steel"),
    "bass": ("bass", "bass guitar", "double bass", "upright bass"),
    "strings": ("banjo", "mandolin", "ukulele", "sitar", "viola", "cello"),
    "violin": ("violin", "fiddle"),
    "harp": ("harp",),
    "drums": ("drums",),
    "percussion": ("percussion", "congas", "bongos", "timpani", "tabla", "vibraphone", "marimba", "xylophone"),
    "keys": ("piano", "electric piano", "keyboards", "synthesizer", "synth", "accordion", "harpsichord", "celesta"),
    "organ": ("organ", "hammond organ"),
    "trumpet": ("trumpet",),
    "brass": ("trombone", "tuba", "french horn", "cornet", "flugelhorn"),
    "sax": ("saxophone", "alto saxophone", "tenor saxophone", "baritone saxophone", "soprano saxophone"),
    "woodwind": ("clarinet", "piccolo", "oboe", "bassoon", "bagpipes", "harmonica"),
    "flute": ("flute",),
}
#: Coarse categories over the fine ones.
COARSE_CATEGORIES = {
    "vocals": ("vocals", "backing_vocals"),
    "strings": ("guitar", "bass", "strings", "violin", "harp"),
    "percussion_keys": ("drums", "percussion", "keys", "organ"),
    "brass_woodwind": ("brass", "trumpet", "sax", "woodwind", "flute"),
}
QUOTATION_PATTERN = r"\[[^\]]*(sample|interpolat|excerpt|contains)"
BARE_QUOTATIONS = ("samples", "sampled by")
VARIANT_TRACK_PATTERN = r"\b(live|demo|remix|re-?edit|acoustic|radio edit)\b"
VARIANT_RELEASE_PATTERN = (
    r"\b(compilations?|samplers?|greatest hits|best of|antholog(?:y|ies)|collections?|rarit(?:y|ies)|bootlegs?|mash[- ]?ups?|"
    r"live(?:box)?|remixes?|reissues?|soundtracks?|sound collages?|singles?|box sets?|mixtapes?)\b"
)
LIVE_TITLE_PATTERN = r"\b(bootlegs?|live(?:box)?|soundtracks?|sound collages?)\b"
EXCLUDED_DESCRIPTORS = {
    "compilation": "explicit_compilation", "sampler": "explicit_sampler", "single": "explicit_single", "maxi-single": "explicit_maxi_single",
    "ep": "explicit_ep", "mini-album": "explicit_mini_album", "mixtape": "explicit_mixtape", "live": "explicit_live",
    "bootleg": "explicit_bootleg", "unofficial release": "explicit_unofficial", "remix": "explicit_remix",
    "soundtrack": "explicit_soundtrack", "box set": "explicit_box_set",
}
CAVEAT_TIERS = (("Unofficial Release",), ("Compilation", "Mixed", "Sampler"), ("Promo", "Reissue", "Repress"))
NON_STUDIO_GENRES = ("stage & screen",)
NON_STUDIO_STYLES = ("soundtrack", "musical", "score")
VARIOUS_IDS = (194, 151641)

TRACK_SCOPES = ("track_artist", "track_credit")


def role_categories() -> dict[str, str]:
    """Coarse category of each known role."""
    fine = {role: name for name, roles in PERFORMER_CATEGORIES.items() for role in roles}
    coarse = {f: name for name, fs in COARSE_CATEGORIES.items() for f in fs}
    out = {role: coarse[f] for role, f in fine.items()}
    for name, roles in (
        ("production", PRODUCTION_ROLES), ("engineering", ENGINEERING_ROLES), ("arrangement", ARRANGEMENT_ROLES),
        ("composition", COMPOSITION_ROLES), ("rework", REWORK_ROLES), ("packaging_business", PACKAGING_ROLES),
    ):
        out |= dict.fromkeys(roles, name)
    return out


@dataclass(frozen=True)
class Policy:
    """What counts as a performer, a collaboration, a studio release; and the limits of the edge rules."""

    non_performer_roles: tuple[str, ...] = NON_PERFORMER_ROLES
    grading_roles: tuple[str, ...] = GRADING_ROLES
    non_collaborative_roles: tuple[str, ...] = COMPOSITION_ROLES + PACKAGING_ROLES + REWORK_ROLES
    performer_categories: dict[str, str] = field(default_factory=lambda: {role: name for name, roles in PERFORMER_CATEGORIES.items() for role in roles})
    role_categories: dict[str, str] = field(default_factory=role_categories)
    quotation_pattern: str = QUOTATION_PATTERN
    bare_quotations: tuple[str, ...] = BARE_QUOTATIONS
    variant_track_pattern: str = VARIANT_TRACK_PATTERN
    variant_release_pattern: str = VARIANT_RELEASE_PATTERN
    live_title_pattern: str = LIVE_TITLE_PATTERN
    excluded_descriptors: dict[str, str] = field(default_factory=lambda: dict(EXCLUDED_DESCRIPTORS))
    album_descriptor: str = "album"
    caveat_tiers: tuple[tuple[str, ...], ...] = CAVEAT_TIERS
    non_studio_genres: tuple[str, ...] = NON_STUDIO_GENRES
    non_studio_styles: tuple[str, ...] = NON_STUDIO_STYLES
    placeholder_ids: tuple[int, ...] = VARIOUS_IDS
    flagged_ids: tuple[int, ...] = ()  # placeholders that may make edges, and are pointed out
    placeholder_name_pattern: str = PLACEHOLDER_NAME_PATTERN
    placeholder_modulus: int | None = None  # test tables: ids divisible by it are placeholders
    max_artists_per_release: int = 50
    compilation_threshold: int = 5
    max_artists_per_track: int = 16

    def but(self, **changes) -> Policy:
        return replace(self, **changes)


#: The policy of the test tables, in whose vocabulary part types and brands stand for roles and formats.
LENS = Policy(
    non_performer_roles=("promo", "economy", "standard"),
    grading_roles=("promo", "economy", "standard", "medium"),
    non_collaborative_roles=("promo", "economy"),
    performer_categories={"small": "guitar", "medium": "bass", "large": "drums"},
    role_categories={"small": "strings", "medium": "strings", "large": "percussion_keys", "promo": "composition", "economy": "packaging_business"},
    variant_release_pattern=r"\b(not specified)\b",
    live_title_pattern=r"\b(low)\b",
    excluded_descriptors={"promo": "explicit_promo", "brand#11": "explicit_brand"},
    album_descriptor="small",
    caveat_tiers=(("PROMO",), ("ECONOMY", "STANDARD"), ("Brand#11", "Brand#12")),
    non_studio_genres=("machinery",),
    non_studio_styles=(),
    placeholder_ids=(),
    flagged_ids=(7, 11, 13),
    placeholder_name_pattern=r"^(cold|blue) (rod|widget)$",
    placeholder_modulus=97,
)
