"""Registered queries, by module; each module has ``QUERIES`` and ``SQL``."""

MODULES = ["vulnlake.queries.problems", "vulnlake.queries.catalog", "vulnlake.queries.quality", "vulnlake.queries.matching", "vulnlake.queries.ingest"]
