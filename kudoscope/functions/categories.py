"""Category lists kept as ``array<string>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kudoscope.functions.text import strip

# Generic parents that say nothing about a business, and the
# meta groups of the exploratory report (all lower case).
GENERIC_PARENTS = (
    "restaurants",
    "food",
    "bars",
    "nightlife",
    "event planning & services",
    "hotels",
    "hotels & travel",
    "shopping",
)
GENERIC_PARENTS_BUT_RESTAURANTS = GENERIC_PARENTS[1:]
META_GROUPS = {
    "meta_restaurants": ("restaurants",),
    "meta_food_coffee": ("food", "coffee & tea"),
    "meta_bars_nightlife": ("bars", "nightlife"),
    "meta_hotels_travel": ("hotels", "hotels & travel"),
    "meta_event_services": ("event planning & services",),
    "meta_beauty_spas": ("beauty & spas", "hair salons", "nail salons"),
    "meta_shopping": ("shopping",),
}


def _empty() -> Column:
    return F.array().cast("array<string>")


def split_list(c: Column) -> Column:
    """Comma parts, blanks stripped; null and "" give an empty list."""
    return F.when(c.isNull() | (c == ""), _empty()).otherwise(
        F.transform(F.split(c, ","), strip)
    )


def non_empty(parts: Column) -> Column:
    """Stripped list entries without the empty ones."""
    return F.coalesce(
        F.filter(F.transform(parts, strip), lambda x: x.isNotNull() & (x != "")), _empty()
    )


def normalize(parts: Column, parents: tuple[str, ...] = GENERIC_PARENTS) -> Column:
    """Flatten comma parts, drop blanks and parents, keep the first spelling
    of names that differ only in case."""
    flat = F.flatten(
        F.transform(F.coalesce(parts, _empty()), lambda x: F.split(F.coalesce(x, F.lit("")), ","))
    )
    kept = F.filter(
        F.transform(flat, strip), lambda x: (x != "") & ~F.lower(x).isin(*parents)
    )

    def first_spellings(names: Column) -> Column:
        folded = F.transform(names, F.lower)
        return F.filter(names, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)

    # the one-entry list binds the names, so they are computed once per row
    return F.get(F.transform(F.array(kept), first_spellings), F.lit(0))


def primary(c: Column) -> Column:
    """First comma part of the raw string."""
    return strip(F.get(F.split(c, ","), F.lit(0)))


def count(parts: Column) -> Column:
    return F.when(parts.isNull(), F.lit(0)).otherwise(F.size(parts))


def has(parts: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(parts, name), F.lit(False)).cast("int")


def meta_flags(parts: Column, groups: dict[str, tuple[str, ...]] = META_GROUPS) -> dict[str, Column]:
    """0/1 flag per meta group; works on lists that still hold their parents."""
    return {
        name: F.coalesce(
            F.exists(parts, lambda x: F.lower(x).isin(*members)), F.lit(False)
        ).cast("int")
        for name, members in groups.items()
    }
