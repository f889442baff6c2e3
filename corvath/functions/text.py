"""Text expressions: words, trimming, counting, titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}_]+"
# The default English stop words of the usual full-text analysers.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def words(text: Column) -> Column:
    """The lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def index_terms(text: Column) -> Column:
    """The words without stop words."""
    return F.filter(words(text), lambda w: ~w.isin(STOPWORDS))


def strip(text: Column) -> Column:
    """Without any kind of white space at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def occurrences(text: Column, term: str) -> Column:
    """How often a literal stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("bigint")


def query_terms(query: str, distinct: bool = False) -> list[str]:
    """The words of a query longer than one character, or the whole query where there are none."""
    lowered = query.strip().lower()
    found = [t for t in re.findall(r"\w+", lowered) if len(t) > 1] or [lowered]
    return list(dict.fromkeys(found)) if distinct else found


def stem_title(file_name: Column) -> Column:
    """A file's stem as a title: marks to blanks, words capitalised."""
    stem = F.regexp_replace(F.regexp_replace(file_name, "^.*/", ""), "\\.[^.]*$", "")
    return F.initcap(F.regexp_replace(stem, "[_-]", " "))


def lines(text: Column) -> Column:
    return F.split(text, "\\r\\n|\\n|\\r")
