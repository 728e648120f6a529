"""Queries over the given tables; importing the package registers them all."""

from trawlframe.plans import crawl, fetching, reporting, streams, tasking, texts  # noqa: F401
from trawlframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
