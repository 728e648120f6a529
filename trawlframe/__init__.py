"""Crawl-data processing as Spark DataFrame jobs.

Pages, requests, fetch outcomes, tasks and results come in as DataFrames and
leave as DataFrames; nothing here fetches pages or serves an API.
"""

import sys

from pyspark import cloudpickle

from trawlframe.session import build_session

# The few functions that run in Python workers travel with their job, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
