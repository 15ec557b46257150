"""All queries of the core and their checking SQL, by name."""

from __future__ import annotations

from siteloom.plans import audit, comparison, library, pages, reports, synthetic, training

QUERIES = {**training.QUERIES, **audit.QUERIES, **reports.QUERIES, **comparison.QUERIES, **pages.QUERIES, **library.QUERIES, **synthetic.QUERIES}
SQL = {**training.SQL, **audit.SQL, **reports.SQL, **comparison.SQL, **pages.SQL, **library.SQL, **synthetic.SQL}
