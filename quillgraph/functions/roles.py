"""Column functions that judge role texts, titles, formats and masters under a Policy."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.policies import Policy


def literals(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normal(component: Column) -> Column:
    """A role component without its bracketed part, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(component, r"\[.*\]", "")))


def components(role: Column) -> Column:
    return F.transform(F.split(role, ","), normal)


def among(x: Column, words: Iterable) -> Column:
    words = list(words)
    return x.isin(*words) if words else F.lit(False)


def is_playable(artist: str = "artist_id", flag: str = "playable_identity") -> Column:
    return F.coalesce(F.col(flag), F.lit(False)) & F.col(artist).isNotNull() & (F.col(artist) > 0)


def not_placeholder(artist: Column, policy: Policy) -> Column:
    ok = ~artist.isin(*policy.placeholder_ids) if policy.placeholder_ids else F.lit(True)
    return ok & (artist % policy.placeholder_modulus != 0) if policy.placeholder_modulus else ok


def performer_credit(role: Column, policy: Policy) -> Column:
    """Permissive: no role, or any component that is not known as a non-performer's."""
    return role.isNull() | F.exists(components(role), lambda x: ~among(x, policy.non_performer_roles))


def only_graded_roles(role: Column, policy: Policy) -> Column:
    """Every component is of the grading list; no role is none of them."""
    return F.coalesce(F.forall(components(role), lambda x: among(x, policy.grading_roles)), F.lit(False))


def behind_the_glass(role: Column, policy: Policy) -> Column:
    """Fail-closed: any component is of production or engineering."""
    words = [w for w, c in policy.role_categories.items() if c in ("production", "engineering")]
    return F.coalesce(F.exists(components(role), lambda x: among(x, words)), F.lit(False))


def edge_ineligible(role: Column, policy: Policy) -> Column:
    """A quotation, or only components that are no collaboration. No role is eligible."""
    lowered = F.lower(role)
    return F.coalesce(
        lowered.rlike(policy.quotation_pattern) | among(F.trim(lowered), policy.bare_quotations) | F.forall(components(role), lambda x: among(x, policy.non_collaborative_roles)),
        F.lit(False),
    )


def performer_role(role: Column, policy: Policy, categories: Iterable[str] | None = None) -> Column:
    """Fail-closed: any component is a known performer's role (of these fine categories)."""
    wanted = None if categories is None else set(categories)
    words = [w for w, c in policy.performer_categories.items() if wanted is None or c in wanted]
    return F.coalesce(F.exists(components(role), lambda x: among(x, words)), F.lit(False))


def instrument_role(role: Column, policy: Policy, categories: Iterable[str]) -> Column:
    """Like performer_role, but a component is cut at its first bracket."""
    wanted = set(categories)
    words = [w for w, c in policy.performer_categories.items() if c in wanted]
    cut = F.transform(F.split(role, ","), lambda x: F.trim(F.element_at(F.split(F.lower(F.trim(x)), r"\["), 1)))
    return F.coalesce(F.exists(cut, lambda x: among(x, words)), F.lit(False))


def _mapped(x: Column, table: dict[str, str], default: str) -> Column:
    out, by = F, {}
    for word, name in table.items():
        by.setdefault(name, []).append(word)
    for name, words in by.items():
        out = out.when(x.isin(*words), F.lit(name))
    return out.otherwise(F.lit(default)) if by else F.lit(default)


def role_categories(role: Column, policy: Policy) -> Column:
    """Distinct coarse categories in first-seen order; unknown is a category of its own."""
    known = F.array_distinct(F.transform(components(role), lambda x: _mapped(x, policy.role_categories, "unknown")))
    return F.when(role.isNull() | (F.trim(role) == ""), F.array(F.lit("unknown"))).otherwise(known)


def primary_category(categories: Column) -> Column:
    return F.coalesce(F.get(F.filter(categories, lambda x: x != "unknown"), F.lit(0)), F.lit("unknown"))


def performer_category(role: Column, policy: Policy) -> Column:
    """The fine category of the first performer's component, else `performer`."""
    first = F.get(F.filter(components(role), lambda x: among(x, policy.performer_categories)), F.lit(0))
    return F.when(first.isNull(), F.lit("performer")).otherwise(_mapped(first, policy.performer_categories, "performer"))


def variant_title(title: Column, pattern: str) -> Column:
    return F.lower(F.coalesce(title, F.lit(""))).rlike(pattern)


def squeezed(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def non_studio_master(genres: Column, styles: Column, policy: Policy) -> Column:
    def hit(values: Column, words: Iterable[str]) -> Column:
        return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.coalesce(among(squeezed(x), words), F.lit(False)))

    return hit(genres, policy.non_studio_genres) | hit(styles, policy.non_studio_styles)


def year_of(text: Column) -> Column:
    """The leading four digits of a free-text date."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"^([0-9]{4})", 1)
    return F.when(found != "", found.cast("int"))


def decade_of(year: Column) -> Column:
    return (year - F.pmod(year, F.lit(10))).cast("int")
