"""All registered queries."""

from veilmark.catalog import detection, linking, reviewing, streams  # noqa: F401
from veilmark.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
