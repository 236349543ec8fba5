"""Queries: operators bound to tables, each with SQL that gives the same rows."""

from larder.plans import aggregates, filters, lookups, ranking, requirements, scoring, sources, streams, texts, units  # noqa: F401
