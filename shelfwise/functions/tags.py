"""Tag arrays: ordered ``language:slug`` lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.fixed_values import CANDY_WORDS, GRADE_RANKS, UNGRADED_RANK
from shelfwise.functions.scalars import strip

# Joins the slugs of one product for substring tests. No searched word holds it,
# so a match never spans two slugs.
_BOUNDARY = "\n"


def tags_or_empty(tags: Column) -> Column:
    """A null tag array counts as empty."""
    return F.coalesce(tags, F.array().cast("array<string>"))


def without_prefix(tag: Column) -> Column:
    """The part after the first colon, or the whole tag."""
    return F.substr(tag, F.instr(tag, ":") + 1)


def slug(tag: Column) -> Column:
    return F.lower(without_prefix(tag))


def readable_names(tags: Column) -> Column:
    """Tag names with blanks for dashes, order and repeats kept."""
    return F.transform(
        tags_or_empty(tags), lambda t: F.replace(without_prefix(t), F.lit("-"), F.lit(" "))
    )


def allergen_names(tags: Column) -> Column:
    return readable_names(tags)


def additive_names(tags: Column) -> Column:
    return F.transform(readable_names(tags), F.upper)


def slugs(tags: Column) -> Column:
    """All non-empty slugs in tag order."""
    return F.filter(F.transform(tags_or_empty(tags), slug), lambda s: s != "")


def first_slug(tags: Column) -> Column:
    """First non-empty slug, or an empty text."""
    return F.coalesce(F.get(slugs(tags), F.lit(0)), F.lit(""))


def last_slug(tags: Column) -> Column:
    """Slug of the last, most specific tag; empty if that tag is blank."""
    return F.coalesce(slug(F.try_element_at(tags, F.lit(-1))), F.lit(""))


def last_name(tags: Column, default: str) -> Column:
    """Last tag without its prefix, case kept; ``default`` without any tag."""
    return F.coalesce(without_prefix(F.try_element_at(tags, F.lit(-1))), F.lit(default))


def category_path(tags: Column, depth: int) -> Column:
    """Up to ``depth`` slugs, most specific first.

    The last ``depth`` tags are taken before blank ones are dropped, so a blank
    tag is not replaced by a broader one.
    """
    tags = tags_or_empty(tags)
    recent = F.slice(tags, F.greatest(F.size(tags) - (depth - 1), F.lit(1)), depth)
    return F.filter(F.transform(F.reverse(recent), slug), lambda s: s != "")


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def joined_tags(tags: Column) -> Column:
    """All tags in one lowercase text, for substring tests on any of them."""
    return F.lower(F.array_join(tags, _BOUNDARY))


def joined_slugs(tags: Column) -> Column:
    """All slugs in one text, for substring tests on any of them."""
    return F.array_join(F.transform(tags, slug), _BOUNDARY)


def is_candy_like(tags: Column) -> Column:
    return contains_any(F.lower(F.array_join(tags, " ")), CANDY_WORDS)


def normalise_grade(grade: Column) -> Column:
    """Lowercase and stripped; empty becomes null. Unknown grades are kept."""
    return F.nullif(strip(F.lower(grade)), F.lit(""))


def grade_rank(grade: Column) -> Column:
    """0 for the best grade to 4; 99 for anything else."""
    ranks = F.create_map(*[F.lit(item) for entry in GRADE_RANKS.items() for item in entry])
    return F.coalesce(F.try_element_at(ranks, grade), F.lit(UNGRADED_RANK))
