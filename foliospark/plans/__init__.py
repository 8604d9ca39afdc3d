"""Registered queries: operators applied to the benchmark tables, each with its SQL."""

from foliospark.plans import assembly, catalog, seams  # noqa: F401
