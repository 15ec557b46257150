"""Eligibility predicates that views, rules and reports share. None of them is ever null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INCOMPLETE = "Response body incomplete"
ROBOTS = "Blocked by robots.txt"
LARGE_IMAGE_BYTES = 204_800


def sure(c: Column) -> Column:
    """False where the condition is unknown."""
    return F.coalesce(c, F.lit(False))


def success() -> Column:
    return sure(F.col("status_code").between(200, 299))


def success_html() -> Column:
    """A complete successful HTML response."""
    return success() & sure(F.contains(F.lower("content_type"), F.lit("text/html"))) & sure(F.coalesce(F.col("indexability_status"), F.lit("")) != INCOMPLETE)


def redirect() -> Column:
    return sure(F.col("status_code").between(300, 399))


def robots_blocked() -> Column:
    return F.col("status_code").isNull() & (sure(F.col("status_text") == ROBOTS) | sure(F.col("error") == ROBOTS))


def no_response() -> Column:
    return F.col("status_code").isNull() & F.col("error").isNotNull() & ~robots_blocked()


def broken() -> Column:
    return no_response() | sure(F.col("status_code") >= 400) | (redirect() & F.col("error").isNotNull())


def sitemap_eligible() -> Column:
    """Fit for an exported sitemap."""
    return success() & sure(F.col("indexability") == "Indexable") & F.col("error").isNull() & sure(F.startswith("final_url", F.lit("http")))
