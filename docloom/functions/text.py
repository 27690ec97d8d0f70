"""Text matching and ranking as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import clamp01

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TITLE_WEIGHT, BODY_WEIGHT, POPULARITY_WEIGHT = 5.0, 1.0, 0.4
_K1, _B = 1.2, 0.75
SNIPPET_TOKENS = 40


def match_terms(q: str) -> list[str] | None:
    """The folded terms that full text can match, None without any of three characters and more.

    Terms are split at Unicode white space and measured before double quotes go; a term that
    is then too short matches nothing.
    """
    terms = [t for t in q.split() if len(t) >= 3]
    return [t.replace('"', "").lower() for t in terms] or None


def ascii_lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def bm25(tf: list[Column], length: Column, n_docs: int, mean_length: float, n_with: list[int]) -> Column:
    """The negated sum over terms: the best is least. Corpus figures are of all documents, before any filter."""
    import math

    score = F.lit(0.0)
    for f, n in zip(tf, n_with):
        idf = max(math.log((n_docs - n + 0.5) / (n + 0.5)), 1e-6)
        score = score - F.lit(idf) * f * (_K1 + 1) / (f + _K1 * (1 - _B + _B * length / (mean_length or 1.0)))
    return score


def blended(score: Column, rank: Column) -> Column:
    return score * (1 + POPULARITY_WEIGHT * clamp01(rank))


def exact_first(title: Column, q: str) -> Column:
    return F.when(ascii_lower(title) == F.lit(q.translate(str.maketrans(_UPPER, _LOWER))), 0).otherwise(1)


def window(text: Column, first: Column, last: Column) -> Column:
    """Up to 42 characters of the text with what stands from first to last in their middle; … marks cut sides, null places show the beginning."""
    width = SNIPPET_TOKENS + 2
    lead = ((SNIPPET_TOKENS - (last - first)) / 2).cast("int")
    start = F.when(first.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(first - lead, F.char_length(text) - width)))  # least skips nulls
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(width)), F.when(start + width < F.char_length(text), "…").otherwise(""))


def snippet(body: Column, term: str) -> Column:
    """The window around the first match of a term, else the beginning."""
    text = F.coalesce(body, F.lit(""))
    at = F.instr(F.lower(text), term) - 1
    return window(text, F.when(at >= 0, at), at + len(term) - 2)


def best_window(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows (doc_id, at: sorted (p, k) of place and term) -> doc_id, first, last of the best window of SNIPPET_TOKENS places.

    Windows begin with an occurrence. That of most different terms is best, of equals that of
    most occurrences, then the earliest. A window has at most SNIPPET_TOKENS places a term, so
    no occurrence looks at more that follow it.
    """
    most = SNIPPET_TOKENS * len(lengths)
    held = lambda x, i: F.filter(F.slice("at", i + 1, most), lambda y: y["p"] < x["p"] + SNIPPET_TOKENS)
    different = lambda w: F.size(F.array_distinct(F.transform(w, lambda y: y["k"])))
    scored = F.transform("at", lambda x, i: F.struct(different(held(x, i)).alias("different"), F.size(held(x, i)).alias("n"), (-i).alias("i")))
    best = rows.filter(F.size("at") > 0).select("doc_id", "at", (-F.array_max(scored)["i"]).alias("i"))
    last = F.element_at(F.filter(F.slice("at", F.col("i") + 1, most), lambda y: y["p"] < F.get("at", F.col("i"))["p"] + SNIPPET_TOKENS), -1)
    return best.select("doc_id", F.get("at", F.col("i"))["p"].alias("first"), (last["p"] + F.get(F.array(*[F.lit(n - 2) for n in lengths]), last["k"])).alias("last"))


def head(opening: Column, body: Column, n: int = 120) -> Column:
    return F.substring(F.coalesce(opening, body), 1, n)


def collapse_markup(text: Column) -> Column:
    """Behaviour switches go, lines are trimmed, and three or more line breaks become two."""
    out = F.regexp_replace(text, "__[A-Z]+__", "")
    out = F.regexp_replace(out, r"(?m)^[ \t]+|[ \t]+$", "")
    return F.btrim(F.regexp_replace(out, "\n{3,}", "\n\n"), F.lit(" \t\n"))
