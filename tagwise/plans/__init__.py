"""Importing this package registers every query in :mod:`tagwise.plans.registry`."""

from tagwise.plans import audit, curation, ingest, lifecycle, modeling, routing, scoring, streams  # noqa: F401
from tagwise.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "COVERS"]
