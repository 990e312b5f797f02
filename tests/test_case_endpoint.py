"""The endpoint of a case never gathers a user's events in one array."""

import datetime

from tessella.plans import text_queries


def test_no_list_of_events(spark, monkeypatch):
    at = lambda k: datetime.datetime(2024, 1, 1 + k)
    rows = [(1, "view", 2.0, at(3)), (1, "error", None, at(9)), (1, "view", -1.0, at(0)), (2, "view", 5.0, at(1))]
    events = spark.createDataFrame(rows, "user_id long, event_type string, value double, ts timestamp")
    monkeypatch.setattr(text_queries, "table", lambda spark, d, name: events)
    found = text_queries.nested_case_endpoint(spark, "")
    assert sorted(map(tuple, found.collect())) == [(1, 9, -1.0, 2.0, 3, True), (2, 1, 5.0, 5.0, 1, False)]
    assert "collect_list" not in found._jdf.queryExecution().toString()
