"""Usage reports with empty intervals, and of empty input."""

from datetime import datetime, timezone

from logloom.operators.meter import usage_report

SCHEMA = "app_secret string, ok boolean, ts timestamp"


def at(second):
    return datetime(2024, 1, 1, 0, 0, second, tzinfo=timezone.utc)


def test_intervals_without_records_report_no_application(spark):
    rows = [("a", True, at(1)), ("a", False, at(2)), ("b", True, at(2)), ("a", True, at(32)), ("z", False, None)]
    made = usage_report(spark.createDataFrame(rows, SCHEMA), every="10 seconds", empty=True)
    assert [r.report for r in made.orderBy("window_start").collect()] == [
        '{"application_groups":[{"token":"a","new_log_count":1},{"token":"b","new_log_count":1}]}',
        '{"application_groups":[]}',
        '{"application_groups":[]}',
        '{"application_groups":[{"token":"a","new_log_count":1}]}',
    ]


def test_no_records_no_reports(spark):
    assert usage_report(spark.createDataFrame([], SCHEMA), empty=True).collect() == []
    assert usage_report(spark.createDataFrame([], SCHEMA)).collect() == []
