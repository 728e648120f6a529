"""Shapes of the plans that matter at scale."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NATIVE = ("link_edges", "request_fingerprints", "first_seen_requests", "new_requests", "duplicate_report", "pattern_email", "clean_batch",
          "webpage_validation", "numeric_rules", "download_stats_by_host", "retry_plan", "task_status_view", "distinct_documents",
          "json_log_lines", "link_targets", "frontier_commands", "cookie_set_newest", "queue_stats")


@pytest.fixture
def plan(spark):
    def text(name):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    return text


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cross_join(plan, name):
    text = plan(name)
    assert "Python" not in text and "Pandas" not in text and "InArrow" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["first_seen_requests", "frontier_next", "task_results_latest_each", "distinct_documents"])
def test_rank_filters_are_cut_before_the_shuffle(plan, name):
    text = plan(name)
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["link_edges", "page_fields_css", "crawl_job", "crawl_dedup_by_domain"])
def test_html_is_not_shuffled(plan, name):
    lines = plan(name).splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    for i in exchanges:
        project = next((line for line in lines[i + 1:] if "Project" in line or "Aggregate" in line), "")
        assert "html#" not in project.split("[")[-1].split("AS")[0] or " AS " in project


def test_columns_are_pruned_and_filters_pushed(plan):
    text = plan("download_stats_by_host")
    assert "props" not in text
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in plan("task_by_id")


@pytest.mark.parametrize("name", ["tasks_page", "seen_set_newest", "log_top_errors"])
def test_listings_take_their_rows_from_the_sort(plan, name):
    assert "TakeOrderedAndProject" in plan(name)


def test_counts_are_combined_before_the_shuffle(plan):
    for name in ("link_in_degrees", "daily_crawl_stats", "task_progress", "queue_stats"):
        assert "partial_" in plan(name)
