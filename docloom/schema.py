"""The uniform document model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOC_SCHEMA = (
    "doc_id bigint, title string, opening string, body string, tags array<string>, links array<string>, "
    "aliases array<string>, updated_at string, rank_score double, extra string"
)
FIELDS = ("doc_id", "title", "opening", "body", "tags", "links", "updated_at", "rank_score", "extra", "feature", "area", "lat", "lon", "wikidata")
#: Digits of the value that scores 1: monthly views, people of a city, people of a country.
PAGEVIEWS, CITY, COUNTRY = 7.0, 8.0, 10.0


class BadRequest(ValueError):
    """A parameter is out of its domain."""


class NotFound(LookupError):
    """Nothing has this title or id; candidates begin alike."""

    def __init__(self, what: str, candidates: list[str] = ()):  # noqa: B006
        super().__init__(what)
        self.candidates = list(candidates)


class UnknownSource(LookupError):
    """No source has this name."""


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def normalized_popularity(value: Column, digits: float) -> Column:
    """round(min(1, log10(1 + v) / digits), 4); 0 for null and what isn't positive."""
    return F.when(value > 0, F.round(F.least(F.lit(1.0), F.log10(1.0 + value) / digits), 4)).otherwise(F.lit(0.0))


#: What readers put into extra besides a document's own columns.
EXTRA = {"feature": "string", "area": "string", "lat": "double", "lon": "double", "wikidata": "string"}


def with_extra_columns(docs: DataFrame, names: dict[str, str] = EXTRA, extra: str = "extra") -> DataFrame:
    """docs with columns read, each as its type, from the JSON of extra."""
    return docs.withColumns({k: F.get_json_object(extra, f"$.{k}").try_cast(t) for k, t in names.items()})
