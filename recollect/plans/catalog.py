"""All queries of the core by name, and the SQL they are compared with."""

from __future__ import annotations

from recollect.plans import answers, curation, filters, graphs, metrics, recall, records, reports, retrieval, stores, streams  # noqa: F401
from recollect.plans.registry import QUERIES, SQL  # noqa: F401
