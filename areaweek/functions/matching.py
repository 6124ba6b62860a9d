"""Finding a known area name inside free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A longer list would make the generated expression unwieldy; see
# operators.names for lists that live in a table.
MAX_INLINE_NAMES = 200


def usable_names(names: Sequence[str]) -> list[str]:
    """Trimmed names, each once, without empty ones, in the given order."""
    return list(dict.fromkeys(n.strip(" ") for n in names if n and n.strip(" ")))


def in_match_order(names: Sequence[str], mode: str) -> list[str]:
    """``longest`` tries long names first, so no name hides inside another;
    ``first`` keeps the given order."""
    if mode == "first":
        return list(names)
    if mode == "longest":
        return sorted(names, key=lambda n: (-len(n), n))
    raise ValueError(f"unknown match mode: {mode}")


def find_area(text: Column, names: Sequence[str], mode: str = "longest") -> Column:
    """The name contained in ``text`` regardless of case, or null.

    ``text`` should be a column or a lambda variable, as every name looks at it; an
    expression would be worked out again for each (see ``operators.names``).
    """
    ordered = in_match_order(usable_names(names), mode)
    if not ordered:
        raise ValueError("no area names given")
    if len(ordered) > MAX_INLINE_NAMES:
        raise ValueError("too many names for one expression; use operators.names")
    return first_contained(F.lower(text), ordered)


def first_contained(lowered: Column, ordered: Sequence[str]) -> Column:
    """The first of the names that the lower-case text contains."""
    hit = F.when(F.contains(lowered, F.lower(F.lit(ordered[0]))), ordered[0])
    for name in ordered[1:]:
        hit = hit.when(F.contains(lowered, F.lower(F.lit(name))), name)
    return hit
