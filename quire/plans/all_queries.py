"""Importing the plan modules registers their queries."""

from quire.plans import extraction, graphs, library, retrieval, storage, structure  # noqa: F401
from quire.plans.registry import CHECKS, QUERIES  # noqa: F401
