"""A landing worked off part by part: whole, each key in one part, one part on disk at a time."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyglass import registry
from tallyglass.sources import testbed as T
from tallyglass.sources.events import read_events

N = 120


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Events of which a sixth share one time, some share time and id, and some have no time."""
    folder = tmp_path_factory.mktemp("parts")
    kinds = ["click", "error", "signup", "view"]
    rows = []
    for i in range(N):
        ts = datetime(2024, 1, 1) + timedelta(hours=6 * i, microseconds=i)
        if i % 6 == 1:
            ts = datetime(2024, 1, 9, 5)
        rows.append((i, None if i % 40 == 17 else ts, i % 9, kinds[i % 4]))
    rows += [(i + 100_000, ts, user, kind) for i, ts, user, kind in rows if i % 12 == 4]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    docs = [(i, f"select {i} from  t where x = 'é{i}'") for i in range(7)]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(T, "PART_EVENTS", 50)


def result(spark, name, tables):
    return sorted(map(str, registry.queries()[name](spark, tables).collect()))


def test_every_event_is_in_one_part_and_times_stay_together(spark, tables, small_parts):
    parts = T.event_parts(spark, tables)
    events = T.source_rows(spark, tables, documents=False)
    assert len(parts) > 2
    assert [events.where(p).count() for p, _ in parts] == [n for _, n in parts]
    inside = sum(F.coalesce(p, F.lit(False)).cast("int") for p, _ in parts)
    assert {r[0] for r in events.select(inside).collect()} == {1}
    assert sum(n for _, n in parts) == events.count()


def test_parts_hold_the_landing_one_at_a_time(spark, tables, small_parts):
    whole = sorted(r.value for r in read_events(spark, T.landing(spark, tables)).collect())
    seen, folders, most = [], set(), 0
    for path in T.landing_parts(spark, tables):
        lines = [r.value for r in read_events(spark, path).collect()]
        folders.add(path)
        most = max(most, len(lines))
        seen += lines
    assert sorted(seen) == whole
    assert len(folders) == 1 and most < len(whole) * 0.6


def test_event_source_counts_all_parts(spark, tables, monkeypatch):
    want = result(spark, "event_source", tables)
    landed = []
    monkeypatch.setattr(T, "PART_EVENTS", 50)
    monkeypatch.setattr(T, "landing", lambda *a: landed.append(a))
    assert result(spark, "event_source", tables) == want
    assert not landed  # the landing is never on disk as a whole


QUERIES = ["compact", "partition_day", "filter_since", "sort_cpu", "api_list", "dashboard_report", "explode_inputs"]


def test_queries_over_a_log_of_parts(spark, tables, monkeypatch):
    want = {name: result(spark, name, tables) for name in QUERIES}
    texts = ["query_id", "ingest_seq", "query_text", "plan", "query_preview"]
    whole = sorted(map(str, T.log_table(spark, tables).select(*texts).collect()))
    assert all(want.values())
    monkeypatch.setattr(T, "PART_EVENTS", 50)
    monkeypatch.setattr(T, "landing", lambda *a: pytest.fail("the landing is on disk as a whole"))
    lean = T.log_table(spark, tables, lean=True)
    assert "query_text" not in lean.columns and "plan" not in lean.columns
    assert sorted(map(str, T.log_table(spark, tables).select(*texts).collect())) == whole
    for name in QUERIES:
        assert result(spark, name, tables) == want[name], name
