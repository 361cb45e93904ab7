"""Query terms of the lexical search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no query terms.
STOP_WORDS = frozenset(
    """
    a an the is are was were be been being have has had do does did will would could should may might can shall
    to of in for on with at by from as into through during before after above below between under again further
    then once here there when where why how all both each few more most other some such no not only own same so
    than too very and but or nor if while about up out it its this that these those just also now well way even
    new want because any every which what who whom whose
    """.split()
)
CJK = "[\u4e00-\u9fff\u3040-\u30ff]"
TRAILING = ".,;:!?"


def extract_terms(query: str) -> list[str]:
    """The terms of a query in order, repeats kept: words without trailing punctuation that are CJK, or longer than one
    character and no stop word."""
    import re

    words = (w.rstrip(TRAILING) for w in query.split())
    return [w for w in words if w and (re.search(CJK, w) or (len(w) >= 2 and w.lower() not in STOP_WORDS))]


def terms(query: Column) -> Column:
    """``extract_terms`` over a column."""
    words = F.transform(F.split(query, r"(?U)\s+"), lambda w: F.rtrim(w, F.lit(TRAILING)))
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    long_ = lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, F.lower(w))
    return F.filter(words, lambda w: (w != "") & (w.rlike(CJK) | long_(w)))


def case_variants(term: str) -> list[str]:
    """The term, then its lower, upper and title case where they differ."""
    return list(dict.fromkeys([term, term.lower(), term.upper(), term.title()]))


def ascii_variants(term: Column) -> Column:
    """``case_variants`` over a column of ASCII terms: a letter behind one that is none is capital in title case."""
    pieces = F.regexp_extract_all(F.lower(term), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    title = F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")
    return F.array_distinct(F.array(term, F.lower(term), F.upper(term), title))
