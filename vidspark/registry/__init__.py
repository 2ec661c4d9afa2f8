"""Named queries over the given tables, each with its SQL twin where one exists."""

from vidspark.registry import encoding, flows, matching, pixel, relational, stream, tracking  # noqa: F401
from vidspark.registry.core import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
