"""Snippets of texts around query terms, with highlights."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, BEFORE, FRAGMENT = 240, 80, 180
OPEN, CLOSE = "<mark>", "</mark>"


def default_snippet(content: Column, length: int = LENGTH) -> Column:
    return F.when(F.length(content) > length, F.concat(F.substring(content, 1, length), F.lit("..."))).otherwise(content)


def first_match(content: Column, terms: list[str]) -> Column:
    """The first place, from 1, of any term; null where none occurs."""
    low = F.lower(content)
    places = F.filter(F.array(*[F.instr(low, F.lit(t)) for t in terms]), lambda p: p > 0)
    return F.array_min(places)


def highlight(text: Column, terms: list[str]) -> Column:
    """All terms marked in one pass, longer ones first, so that marks aren't marked again."""
    if not terms:
        return text
    either = "|".join(map(re.escape, sorted(set(terms), key=lambda t: (-len(t), t))))
    return F.regexp_replace(text, f"(?iu)({either})", f"{OPEN}$1{CLOSE}")


def snippet(content: Column, terms: list[str]) -> Column:
    """240 characters from 80 before the first term, with dots where text is cut; the beginning where no term occurs."""
    place = first_match(content, terms)
    start = F.greatest(F.lit(0), place - 1 - BEFORE)
    end = F.least(F.length(content), start + LENGTH)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(content, (start + 1).cast("int"), (end - start).cast("int")), F.when(end < F.length(content), "...").otherwise(""))
    return F.when(place.isNull(), default_snippet(content)).otherwise(highlight(cut, terms))


def fragments(content: Column, title: Column, terms: list[str], number: int = 2) -> Column:
    """Up to two fragments with terms, joined by dots; else the title with its terms marked; else the beginning."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(content) - 1), F.lit(FRAGMENT)), lambda i: F.substring(content, (i + 1).cast("int"), F.lit(FRAGMENT)))
    has = lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(x), t))
    found = F.slice(F.filter(pieces, has), 1, number)
    return F.when(F.size(found) > 0, highlight(F.array_join(found, " ... "), terms)).when(has(title), highlight(title, terms)).otherwise(F.substring(content, 1, 200))
