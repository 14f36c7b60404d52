"""All registered queries. Importing the modules registers them."""

from __future__ import annotations

from verdigris.plans import audits, capture, claims, identity, ingest, ledger, records, reports, retrieval, streams, tables, upserts  # noqa: F401
from verdigris.plans.base import ORACLES, QUERIES  # noqa: F401
