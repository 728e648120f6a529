"""Python workers must not need the package on their path."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from trawlframe import build_session
spark = build_session("shipping", "local[2]", **{{"spark.sql.shuffle.partitions": 2, "spark.ui.enabled": "false"}})
for name in ("page_fields_css", "page_items", "page_fields_table_function", "cleaner_title_case", "cleaner_normalize_unicode",
             "breaker_replay", "requests_accepted_with_ttl", "stream_breaker", "stream_accept_with_ttl", "stream_ingest_pages"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_queries_run_from_elsewhere(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
