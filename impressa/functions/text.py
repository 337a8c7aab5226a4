"""Scalar functions of reports and validation rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_word(text: Column, word: str) -> Column:
    """Does the word occur, not within a longer identifier?"""
    return text.rlike(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")


def has_evidence(text: Column, anchors: Column) -> Column:
    """A digit, or one of the anchors, occurs."""
    return text.rlike(r"\d") | F.exists(anchors, lambda a: text.contains(a))


def mentions(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def tail_lines(text: Column, lines: int = 40, chars: int = 4000) -> Column:
    """The last lines of an error, and of those the last characters."""
    parts = F.split(text, "\n")
    kept = F.array_join(F.slice(parts, F.greatest(F.size(parts) - lines + 1, F.lit(1)), lines), "\n")
    return F.right(kept, F.lit(chars))


def display_width(text: Column) -> Column:
    """Columns on a terminal: wide characters count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x00-⺀]", ""))


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    """A number within bounds; text that is none gives the default."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("double"), F.lit(default))))


def safe_path(path: Column, roots: list[str]) -> Column:
    """Under one of the roots, without a parent step."""
    inside = F.lit(False)
    for r in roots:
        inside = inside | path.startswith(r.rstrip("/") + "/")
    return inside & ~F.array_contains(F.split(path, "/"), "..")
