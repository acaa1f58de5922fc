import json
import os
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import table as TB
from tallyglass.operators.fingerprint import line_fingerprint
from tallyglass.operators import lookup as LK
from tallyglass.operators.ingest import IngestOptions, ingest_lines
from tallyglass.operators.lookup import lookup_many
from tallyglass.schema import SUMMARY_COLUMNS, VERSION_COLUMNS
from tallyglass.session import fresh_path
from tallyglass.sources import testbed as T
from tallyglass.sources.events import MAX_EVENT_BYTES, read_events
from tallyglass.operators.versions import latest_of_few, latest_version
from tallyglass.sources.querylog import scan_latest
from tallyglass.streaming import ingest as S

EAST, WEST = timezone(timedelta(hours=9)), timezone(timedelta(hours=-8))
CUTOFFS = [
    # midnight, in the day, its last microsecond, over a leap day and over a new year
    (datetime(2027, 3, 12), 5, datetime(2027, 3, 7)),
    (datetime(2027, 3, 12, 16, 45), 5, datetime(2027, 3, 7)),
    (datetime(2027, 3, 12, 23, 59, 59, 999999), 5, datetime(2027, 3, 7)),
    (datetime(2028, 3, 1, 9), 1, datetime(2028, 2, 29)),
    (datetime(2028, 1, 2, 9), 4, datetime(2027, 12, 29)),
    (datetime(2027, 3, 12, 9), 0, datetime(2027, 3, 12)),
    # the day of another zone is not the day of UTC
    (datetime(2027, 3, 12, 4, tzinfo=EAST), 5, datetime(2027, 3, 6)),
    (datetime(2027, 3, 12, 20, tzinfo=WEST), 5, datetime(2027, 3, 8)),
]


@pytest.mark.parametrize("now, days, want", CUTOFFS)
def test_retention_cutoff(now, days, want):
    assert TB.retention_cutoff(now, days) == want.replace(tzinfo=timezone.utc)


def test_retention_keeps_whole_days():
    with pytest.raises(ValueError):
        TB.retention_cutoff(datetime(2027, 3, 12), -1)
    for minutes in range(0, 3000, 97):
        now = datetime(2027, 3, 11, tzinfo=timezone.utc) + timedelta(minutes=minutes)
        for days in (0, 1, 10, 45):
            cutoff = TB.retention_cutoff(now, days)
            assert timedelta(0) <= now - timedelta(days=days) - cutoff < timedelta(days=1)
            assert (cutoff.hour, cutoff.minute, cutoff.second) == (0, 0, 0)


def test_compaction_window():
    now = datetime(2027, 5, 20, 7, 40)
    for days, want in ((-1, 20), (0, 20), (1, 20), (3, 18), (10, 11)):
        assert TB.compaction_window(now, days) == datetime(2027, 5, want, tzinfo=timezone.utc)
    assert TB.compaction_window(datetime(2027, 5, 20, 7, tzinfo=EAST), 1).day == 19


def event(i: int, day: int, wall: int = 1, **extra) -> str:
    return json.dumps(
        {
            "metadata": {"queryId": f"202406{day:02d}_000000_{i:05d}_x", "queryState": "FINISHED", "query": f"q {i}"},
            "statistics": {"wallTime": f"PT{wall}S"},
            "context": {"user": "u"},
            "createTime": f"2024-06-{day:02d}T00:00:{i % 60:02d}Z",
            **extra,
        }
    )


@pytest.fixture
def table(spark):
    return TB.create_log_table(spark, T.new_table_name(spark, "t"))


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def append(spark, table, texts, at="2024-07-01 00:00:00", seq=0):
    rows = ingest_lines(lines(spark, texts)).withColumns(
        {"ingested_at": F.lit(at).cast("timestamp"), "ingest_seq": F.lit(seq).cast("bigint")}
    )
    TB.append_log(rows, table)


def days(spark, table):
    return [str(d) for d in TB.partition_days(spark, table)]


def test_create_is_idempotent_and_lists_every_column(spark, table):
    append(spark, table, [event(1, 1)])
    TB.create_log_table(spark, table)
    assert spark.table(table).count() == 1
    ddl = TB.table_ddl("log")
    assert ddl.count("\n  ") == 45 and "PARTITIONED BY (create_date)" in ddl


def test_appended_files_are_sorted(spark, table):
    append(spark, table, [event(i, 1 + i % 2) for i in reversed(range(50))])
    stored = spark.table(table).select("create_time", "_metadata.file_path", F.monotonically_increasing_id().alias("n"))
    per_file: dict = {}
    for r in stored.orderBy("n").collect():
        per_file.setdefault(r.file_path, []).append(r.create_time)
    assert len(per_file) == 2 and all(t == sorted(t) for t in per_file.values())


def test_prune_drops_whole_days(spark, table):
    append(spark, table, [event(i, d) for d in (1, 2, 3, 4) for i in range(3)])
    assert TB.prune(spark, table, datetime(2024, 6, 3, 12)) == [date(2024, 6, 1), date(2024, 6, 2)]
    assert days(spark, table) == ["2024-06-03", "2024-06-04"]
    assert spark.table(table).count() == 6
    assert [r.partition_id for r in TB.list_partitions(spark, table).collect()] == ["20240603", "20240604"]
    exact = TB.retained_rows(spark.table(table), datetime(2024, 6, 3, 0, 0, 1, tzinfo=timezone.utc))
    assert exact.count() == 5
    TB.prune(spark, table, datetime(2030, 1, 1))
    assert spark.table(table).count() == 0 and days(spark, table) == []


@pytest.mark.parametrize(
    "cutoff, left",
    [
        (datetime(2024, 6, 3, 0, 30, tzinfo=EAST), ["2024-06-02", "2024-06-03", "2024-06-04"]),
        (datetime(2024, 6, 2, 23, tzinfo=WEST), ["2024-06-03", "2024-06-04"]),
    ],
)
def test_prune_goes_by_the_day_of_utc(spark, table, cutoff, left):
    append(spark, table, [event(i, d) for d in (1, 2, 3, 4) for i in range(3)])
    assert TB.retained_rows(spark.table(table), cutoff).count() <= 3 * len(left)
    exact = cutoff.astimezone(timezone.utc)
    want = [r for r in spark.table(table).select("create_time").collect() if r.create_time.replace(tzinfo=timezone.utc) >= exact]
    assert TB.retained_rows(spark.table(table), cutoff).count() == len(want)
    TB.prune(spark, table, cutoff)
    assert days(spark, table) == left


def test_rows_appended_during_a_rewrite_stay(spark, table):
    for flush in range(2):
        append(spark, table, [event(i, d) for d in (1, 2) for i in range(5)], seq=flush)

    def late(rows):
        append(spark, table, [event(100 + i, 1) for i in range(3)], seq=9)
        return rows.where("ingest_seq = 0")

    both = [date(2024, 6, 1), date(2024, 6, 2)]
    assert TB.rewrite_days(spark, table, both, late) == [date(2024, 6, 2)]  # the first day is left for another run
    counts = {r.create_date.day: r["count"] for r in spark.table(table).groupBy("create_date").count().collect()}
    assert counts == {1: 13, 2: 5}


def test_only_days_of_small_files_are_rewritten(spark, table):
    append(spark, table, [event(i, 1) for i in range(10)])
    for flush in (1, 2):
        append(spark, table, [event(i, 2) for i in range(3)], seq=flush)
    assert TB.compact(spark, table, datetime(2024, 6, 1), small_bytes=10) == []
    assert TB.compact(spark, table, datetime(2024, 6, 1)) == [date(2024, 6, 2)]
    assert spark.table(table).count() == 16 and TB.compact(spark, table, datetime(2024, 6, 1)) == []


def test_exact_prune_rewrites_one_day(spark, table):
    append(spark, table, [event(i, d) for d in (1, 2, 3, 4) for i in range(30)])
    paths = lambda: {r.path for r in TB._day_files(spark, table, F.col("create_date") > "2024-06-03").collect()}
    before = paths()
    cutoff = datetime(2024, 6, 3, 0, 0, 12)
    want = sorted(map(tuple, TB.retained_rows(spark.table(table), cutoff).select("query_id", "create_time").collect()))
    assert TB.prune(spark, table, cutoff, exact=True) == [date(2024, 6, d) for d in (1, 2, 3)]
    assert sorted(map(tuple, spark.table(table).select("query_id", "create_time").collect())) == want and len(want) == 18 + 30
    assert paths() == before
    assert TB.prune(spark, table, cutoff, exact=True) == []
    # Nothing of the day is left.
    assert TB.prune(spark, table, datetime(2024, 6, 3, 5), exact=True) == [date(2024, 6, 3)] and days(spark, table) == ["2024-06-04"]


def files(spark, table):
    return spark.table(table).select("create_date", "_metadata.file_path").distinct().groupBy("create_date").count().collect()


def test_compaction_keeps_the_rows(spark, table):
    for flush in range(3):
        append(spark, table, [event(i, d, wall=flush) for d in (1, 2, 3) for i in range(10)], seq=flush)
    before = sorted(map(tuple, spark.table(table).select("query_id", "create_time", "wall_ms", "ingest_seq").collect()))
    done = TB.compact(spark, table, datetime(2024, 6, 2))
    assert done == [date(2024, 6, 2), date(2024, 6, 3)]
    spark.catalog.refreshTable(table)
    after = sorted(map(tuple, spark.table(table).select("query_id", "create_time", "wall_ms", "ingest_seq").collect()))
    assert after == before
    n = {str(r.create_date): r["count"] for r in files(spark, table)}
    assert n["2024-06-01"] == 3 and n["2024-06-02"] == 1 and n["2024-06-03"] == 1
    TB.compact(spark, table, datetime(2024, 6, 1), resolve_versions=True)
    spark.catalog.refreshTable(table)
    left = {(r.create_date.day, r.ingest_seq) for r in spark.table(table).select("create_date", "ingest_seq").collect()}
    # Days two and three were in one file each already, so only day one was rewritten.
    assert (1, 2) in left and (1, 0) not in left and (2, 0) in left
    assert TB.compact(spark, table, datetime(2024, 6, 1)) == []


def shuffled_rows(spark, df):
    """Rows and bytes that the exchanges of a query wrote."""
    df = df.select("*")
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
            walk(node.plan())
        if name == "Exchange":
            m = node.metrics()
            found.append((m.apply("shuffleRecordsWritten").value(), m.apply("shuffleBytesWritten").value()))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return rows, found


def test_resolved_days_have_nothing_to_merge(spark, table):
    for flush in range(3):
        append(spark, table, [event(i, d, wall=flush) for d in (1, 2, 3) for i in range(10)], seq=flush)
    assert TB.resolve_days(spark, table, datetime(2024, 6, 1), datetime(2024, 6, 3, 5)) == [date(2024, 6, 1), date(2024, 6, 2)]
    assert TB.resolve_days(spark, table, datetime(2024, 6, 1), datetime(2024, 6, 3)) == []
    assert spark.table(table).count() == 50
    append(spark, table, [event(4, 1, wall=8), event(77, 1, wall=8)], seq=9)
    assert TB.resolve_days(spark, table, datetime(2024, 6, 1), datetime(2024, 6, 3)) == [date(2024, 6, 1)]
    assert spark.table(table).where("create_date = '2024-06-01'").count() == 11
    assert scan_latest(spark.table(table)).count() == 31


def sent(spark, n, resent):
    """Rows of one day with a long text, of which every ``resent``-th was sent again."""
    rows = spark.range(0, n, 1, 8).selectExpr(
        "DATE'2024-06-01' AS create_date", "TIMESTAMP'2024-06-01' + make_dt_interval(0, 0, 0, id % 1000) AS create_time",
        "CAST(id AS STRING) AS query_id", "repeat(sha2(CAST(id AS STRING), 256), 20) AS plan",
    )
    stamps = "explode(IF(id % {0} = 0, array(0L, 1L, 2L), array(0L))) AS ingest_seq".format(resent)
    both = rows.selectExpr("*", "CAST(query_id AS BIGINT) AS id").selectExpr("*", stamps).drop("id")
    return both.withColumn("ingested_at", F.timestamp_seconds("ingest_seq"))


def test_only_rows_with_versions_are_shuffled(spark):
    rows = sent(spark, 20_000, 10)
    want = {(r.query_id, r.ingest_seq) for r in latest_version(rows).select("query_id", "ingest_seq").collect()}
    got, exchanges = shuffled_rows(spark, latest_of_few(rows))
    assert {(r.query_id, r.ingest_seq) for r in got} == want and len(got) == 20_000
    plain = shuffled_rows(spark, latest_version(rows))[1]
    wide = [r for r, size in exchanges if size > 100 * r]
    assert sum(wide) < 7_000  # three versions of a tenth, and what shares a bit with them
    assert sum(size for _, size in exchanges) < sum(size for _, size in plain) / 2
    # A map far too small marks too much and loses nothing.
    for bits in (1 << 15, 1 << 17):
        assert {(r.query_id, r.ingest_seq) for r in latest_of_few(rows, bits).select("query_id", "ingest_seq").collect()} == want


def test_no_resends_no_merge(spark):
    got, exchanges = shuffled_rows(spark, latest_of_few(sent(spark, 2000, 1 << 40).where("query_id <> '0'")))
    assert len(got) == 1999 and all(size <= 60 * max(r, 1) for r, size in exchanges)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_buckets_are_read_without_an_exchange(spark):
    plain, bucketed = (TB.create_log_table(spark, T.new_table_name(spark, f"b{n}"), buckets=n) for n in (None, 4))
    assert [TB.bucket_count(spark, t) for t in (plain, bucketed)] == [0, 4]
    for flush in range(2):
        for t in (plain, bucketed):
            append(spark, t, [event(i, 1 + i % 3, wall=flush) for i in range(0, 90, 1 + flush)], seq=flush)
    TB.compact(spark, bucketed, datetime(2024, 6, 1))
    files = TB._day_files(spark, bucketed, F.lit(True)).groupBy("create_date").count().collect()
    assert len(files) == 3 and all(r["count"] <= 4 for r in files)
    ids = spark.table(plain).select("query_id").where("query_id LIKE '%7_x'").distinct()
    for read in (lambda t: latest_version(t).select(*SUMMARY_COLUMNS), lambda t: lookup_many(t, ids, SUMMARY_COLUMNS)):
        got = read(spark.table(bucketed))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, read(spark.table(plain)).collect()), key=str)
        assert "Exchange hashpartitioning" not in executed(got).split("BroadcastQueryStage")[0].split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning(create_date" in executed(latest_version(spark.table(plain)).select(*SUMMARY_COLUMNS))


def test_lookups_prune_days_and_filter_rows(spark, table, monkeypatch):
    append(spark, table, [event(i, d) for d in range(1, 29) for i in range(40)])
    log = spark.table(table)
    ids = spark.createDataFrame([("20240610_000000_00003_x",), ("20240610_000000_00099_x",), ("no id",)], "query_id string")
    few = lookup_many(log, ids, SUMMARY_COLUMNS)
    assert [r.query_id for r in few.collect()] == ["20240610_000000_00003_x"]
    assert {str(r[0]) for r in log.where("create_date IN ('2024-06-09', '2024-06-10', '2024-06-11')").select("create_date").distinct().collect()} == {
        "2024-06-09", "2024-06-10", "2024-06-11"
    }
    plan = executed(few)
    assert "PartitionFilters: [" in plan and plan.split("PartitionFilters: [")[1].split("]")[0].count("2024-06-") == 3
    assert "BroadcastHashJoin" in plan and "bitmap" not in plan

    monkeypatch.setattr(LK, "FEW_IDS", 0)
    many = lookup_many(log, log.where("query_id LIKE '%3_x'").select("query_id"), ["query_id", "create_time"])
    rows, exchanges = shuffled_rows(spark, many)
    assert len(rows) == 28 * 4 and "bitmap" in executed(many)
    assert lookup_many(log, ids, ["query_id"]).count() == 1 and lookup_many(log, ids.limit(0), ["query_id"]).count() == 0


def test_keys_with_nulls_keep_their_last_version(spark):
    rows = spark.createDataFrame(
        [(None, None, "a", "x", 0), (None, None, "a", "y", 1), (None, None, "b", "z", 0)],
        "create_date date, create_time timestamp, query_id string, plan string, ingest_seq long",
    ).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    assert sorted(r.plan for r in latest_of_few(rows).collect()) == sorted(r.plan for r in latest_version(rows).collect()) == ["y", "z"]


def test_identical_resend_is_skipped(spark, table):
    batch = [event(i, 1) for i in range(5)]
    landed = lines(spark, batch).selectExpr(
        "value", "timestamp'2024-07-01' AS file_time", "'f' AS file_path", "0L AS file_offset"
    )
    first = S.flush_batch(landed, table)
    again = S.flush_batch(landed, table)
    assert (first["rows_flushed"], first["batches_flushed"], again["rows_flushed"]) == (5, 1, 0)
    S.flush_batch(landed.where("value NOT LIKE '%00004_x%'"), table)
    assert spark.table(table).count() == 9
    assert scan_latest(spark.table(table)).count() == 5


def land(folder, name, texts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(texts) + "\n")


def test_stream_equals_batch_and_resumes(spark, table, tmp_path):
    folder = tmp_path / "landing"
    checkpoint = fresh_path(spark, "checkpoint")
    land(folder, "a.json", [event(i, 1) for i in range(20)] + ["{broken", event(1, 2, wall=9)])
    seen: list = []
    S.drain(spark, str(folder), table, checkpoint, on_batch=seen.append)
    # A late event lands in its own day; a resend replaces the earlier version.
    land(folder, "b.json", [event(5, 1, wall=7), event(3, 28)])
    S.drain(spark, str(folder), table, checkpoint, on_batch=seen.append)
    S.drain(spark, str(folder), table, checkpoint, on_batch=seen.append)
    assert [c["events_received"] for c in seen] == [22, 2] and seen[0]["events_invalid"] == 1
    current = scan_latest(spark.table(table)).collect()
    assert len(current) == 22
    assert {r.wall_ms for r in current if r.query_id == "20240601_000000_00005_x"} == {7000}
    assert days(spark, table) == ["2024-06-01", "2024-06-02", "2024-06-28"]


def test_stream_by_file_arrives_in_order(spark, table, tmp_path):
    """Explicit sequence numbers decide, whatever the order of files and batches."""
    folder = tmp_path / "landing"
    stamp = "2024-07-01T00:00:00Z"
    land(folder, "a.json", [event(1, 1, wall=2, ingestedAt=stamp, ingestSeq=2), event(1, 1, wall=1, ingestedAt=stamp, ingestSeq=1)])
    land(folder, "b.json", [event(1, 1, wall=5, ingestedAt=stamp, ingestSeq=0)])
    options = IngestOptions(event_versions=True)
    S.drain(spark, str(folder), table, fresh_path(spark, "checkpoint"), options=options, max_files=1)
    (row,) = scan_latest(spark.table(table)).collect()
    assert row.wall_ms == 2000


def test_narrow_tables_share_the_code(spark):
    name = TB.create_log_table(spark, T.new_table_name(spark, "narrow"), [*SUMMARY_COLUMNS, *VERSION_COLUMNS])
    append(spark, name, [event(1, 1)])
    assert set(spark.table(name).columns) == {*SUMMARY_COLUMNS, *VERSION_COLUMNS, "create_date"}


def as_lines(spark, texts):
    return lines(spark, texts).selectExpr("value", "timestamp'2024-07-01' AS file_time", "'f' AS file_path", "0L AS file_offset")


@pytest.mark.parametrize("max_files", [1, 100])
def test_the_table_does_not_depend_on_the_size_of_a_batch(spark, table, tmp_path, max_files):
    """One id under two create times, in two files; and a later sending of one of the two."""
    folder = tmp_path / "landing"
    moved = event(1, 1, wall=3, createTime="2024-06-01T00:00:59Z")
    for n, text in enumerate([event(1, 1, wall=2), moved, event(1, 1, wall=5)]):
        land(folder, f"{n}.json", [text])
        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    S.drain(spark, str(folder), table, fresh_path(spark, "checkpoint"), max_files=max_files)
    assert sorted(r.wall_ms for r in scan_latest(spark.table(table)).collect()) == [3000, 5000]


def test_the_last_flush_wins_whatever_files_and_events_claim(spark, table, tmp_path):
    future = {"ingestedAt": "2099-01-01T00:00:00Z", "ingestSeq": 10**12}
    land(tmp_path / "a", "a.json", [event(1, 1, wall=1, **future)])
    land(tmp_path / "b", "b.json", [event(1, 1, wall=2)])
    os.utime(tmp_path / "b" / "b.json", (1_000_000_000, 1_000_000_000))
    # Two streams, each with a checkpoint of its own.
    for name in ("a", "b"):
        S.drain(spark, str(tmp_path / name), table, fresh_path(spark, "checkpoint"))
    (row,) = scan_latest(spark.table(table)).collect()
    assert row.wall_ms == 2000
    ledger = spark.table(S.ledger_name(table)).where("state = 'done'").orderBy("number").collect()
    assert [r.number for r in ledger] == [0, 1] and ledger[0].stream != ledger[1].stream
    # A new checkpoint over the same files finds every document flushed before.
    S.drain(spark, str(tmp_path / "a"), table, fresh_path(spark, "checkpoint"))
    assert spark.table(table).count() == 2


def test_flush_versions_rise_even_if_the_clock_does_not(spark, table):
    for wall, hour in ((1, 12), (2, 3)):
        S.flush_batch(as_lines(spark, [event(1, 1, wall=wall)]), table, now=datetime(2024, 7, 1, hour, tzinfo=timezone.utc))
    (row,) = scan_latest(spark.table(table)).collect()
    assert row.wall_ms == 2000


def test_repeats_are_known_after_many_flushes(spark, table, monkeypatch):
    monkeypatch.setattr(S, "REPEAT_WINDOW", 3)
    done = [S.flush_batch(as_lines(spark, [event(i, 1)]), table)["batches_flushed"] for i in (0, 1, 2, 3, 4, 5, 6, 7, 7, 5, 1)]
    assert done == [1] * 8 + [0, 0, 1]
    totals = {r.counter: r.n for r in S.ledger_counters(spark, table).collect()}
    assert (totals["batches_flushed"], totals["events_received"], totals["events_repeated"]) == (9, 11, 2)


def test_rejects_are_kept(spark, table):
    counters = S.flush_batch(as_lines(spark, [event(1, 1), "{broken", "{}"]), table)
    assert (counters["events_invalid"], counters["rows_flushed"]) == (2, 1)
    kept = spark.table(S.rejects_name(table)).orderBy("value").collect()
    assert [(r.value, r.status, r.number) for r in kept] == [("{broken", "malformed", 0), ("{}", "invalid", 0)]


def test_an_event_may_take_many_lines(spark, table, tmp_path):
    folder = tmp_path / "pretty"
    for i in range(3):
        land(folder, f"{i}.json", [json.dumps(json.loads(event(i, 1)), indent=2)])
    S.flush_batch(read_events(spark, str(folder), whole_files=True), table)
    assert spark.table(table).count() == 3


def repeats(frame):
    return S.batch_facts(S.check_lines(frame))["repeats"]


def test_one_exchange_carries_the_rows_of_a_batch_without_repeats(spark, table):
    fresh, again = as_lines(spark, [event(1, 1), event(2, 1)]), as_lines(spark, [event(1, 1), event(1, 1, wall=2)])
    other = as_lines(spark, [event(1, 1), event(1, 1, createTime="2024-06-01T02:00:01+02:00")])
    assert [repeats(x) for x in (fresh, again, other, fresh.limit(0))] == [False, True, True, False]
    rows = TB.clustered(S.batch_rows(fresh, repeats=repeats(fresh)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "max_by" not in plan
    assert S.flush_batch(again, table)["rows_flushed"] == 1


def test_check_gives_the_fingerprint_of_the_lines(spark):
    texts = [event(1, 1), event(1, 1), "{broken", "{broken", "{}", event(2, 1, context={"source": IngestOptions().own_source})]
    frame = as_lines(spark, texts)
    facts = S.batch_facts(S.check_lines(frame))
    assert (facts["events_received"], facts["fingerprint"]) == tuple(line_fingerprint(frame).first())
    assert [facts[n] for n in ("events_invalid", "events_suppressed", "rows_enqueued", "keys")] == [3, 1, 2, 1]
    empty = frame.limit(0)
    assert S.batch_facts(S.check_lines(empty))["fingerprint"] == line_fingerprint(empty).first()[1]


def current(spark, table):
    return sorted(map(tuple, scan_latest(spark.table(table), ["query_id", "wall_ms"]).select("query_id", "wall_ms").collect()))


def ledger(spark, table, state="done"):
    spark.catalog.refreshTable(S.ledger_name(table))
    return [r.n_events for r in spark.table(S.ledger_name(table)).where(F.col("state") == state).orderBy("number").collect()]


def test_one_large_file_is_flushed_by_events(spark, table, tmp_path):
    texts = [event(i % 900, 1 + i % 3, wall=1 + i // 900) for i in range(1000)] + ["{broken"]
    land(tmp_path / "landing", "a.json", texts)
    S.drain(spark, str(tmp_path / "landing"), table, fresh_path(spark, "checkpoint"), max_events=300)
    assert ledger(spark, table) == [300, 300, 300, 101]
    whole = TB.create_log_table(spark, T.new_table_name(spark, "whole"))
    S.flush_batch(read_events(spark, str(tmp_path / "landing")), whole)
    assert current(spark, table) == current(spark, whole)
    assert spark.table(S.rejects_name(table)).count() == 1
    with pytest.raises(ValueError):
        S.cut_lines(as_lines(spark, texts), 0)


def test_parts_of_a_cut_follow_the_arrival(spark, tmp_path):
    for n in range(5):
        land(tmp_path / "landing", f"{n}.json", [f"{n} {k}" for k in range(7)])
        os.utime(tmp_path / "landing" / f"{n}.json", (1_700_000_000 - n, 1_700_000_000 - n))
    parts = [sorted(r.value for r in p.collect()) for p in S.cut_lines(read_events(spark, str(tmp_path / "landing")), 4)]
    want = [f"{n} {k}" for n in reversed(range(5)) for k in range(7)]
    assert parts == [sorted(want[k : k + 4]) for k in range(0, 35, 4)]


def test_volume_bounds_a_micro_batch(spark, table, tmp_path):
    for n in range(6):
        land(tmp_path / "landing", f"{n}.json", [event(10 * n + k, 1) for k in range(10)])
    size = (tmp_path / "landing" / "0.json").stat().st_size
    seen: list = []
    S.drain(spark, str(tmp_path / "landing"), table, fresh_path(spark, "c"), on_batch=seen.append, max_bytes=2 * size + 20)
    assert sum(c["events_received"] for c in seen) == 60 and len(seen) >= 3


class Died(Exception):
    pass


def dies_after(monkeypatch, appends):
    """The driver is lost behind this many appends: neither the batch is closed nor a failure noted."""
    append, enter, done = S.append_log, S._enter, []

    def dying(rows, name):
        append(rows, name)
        done.append(name)
        if len(done) == appends:
            raise Died

    monkeypatch.setattr(S, "append_log", dying)
    monkeypatch.setattr(S, "_enter", lambda spark, name, entries: None if len(done) == appends else enter(spark, name, entries))


@pytest.mark.parametrize(("first", "second"), [(None, None), (40, 40), (40, 70), (40, None), (None, 30)])
def test_a_batch_broken_off_is_taken_back(spark, table, tmp_path, monkeypatch, first, second):
    """Dies between append and record, then drains with the same checkpoint, cut another way."""
    texts = [event(i % 90, 1 + i % 3, wall=1 + i // 90) for i in range(100)] + ["{broken"]
    land(tmp_path / "landing", "a.json", texts)
    S.flush_batch(as_lines(spark, [event(200, 1), "{other"]), table)
    checkpoint = fresh_path(spark, "checkpoint")
    with monkeypatch.context() as m:
        dies_after(m, 1 if first is None else 2)
        with pytest.raises(Exception):
            S.drain(spark, str(tmp_path / "landing"), table, checkpoint, max_events=first)
    left = spark.table(table).count()
    assert left > 1 and ledger(spark, table) == [2]
    S.drain(spark, str(tmp_path / "landing"), table, checkpoint, max_events=second)
    whole = TB.create_log_table(spark, T.new_table_name(spark, "whole"))
    for batch in (as_lines(spark, [event(200, 1)]), read_events(spark, str(tmp_path / "landing"))):
        S.flush_batch(batch, whole)
    assert current(spark, table) == current(spark, whole)
    spark.catalog.refreshTable(table)
    marks = {r.flush for r in spark.table(table).select("flush").distinct().collect()}
    assert len(marks) == 2  # rows of the batch by hand and of one try
    if second is None:
        assert spark.table(table).count() == spark.table(whole).count()
    assert sorted(r.value for r in spark.table(S.rejects_name(table)).collect()) == ["{broken", "{other"]
    # Once closed, the same batch is skipped.
    stream = next(r.stream for r in spark.table(S.ledger_name(table)).collect() if r.stream != "batch")
    before = spark.table(table).count()
    again = S.flush_batch(read_events(spark, str(tmp_path / "landing")), table, stream=stream, batch=0)
    assert again["events_repeated"] == 101 and spark.table(table).count() == before


def test_failures_are_counted(spark, table, monkeypatch):
    batch = as_lines(spark, [event(1, 1), event(2, 1)])

    def broken(rows, name):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(S, "append_log", broken)
        with pytest.raises(Died):
            S.flush_batch(batch, table)
    S.flush_batch(batch, table)
    totals = {r.counter: r.n for r in S.ledger_counters(spark, table).collect()}
    assert (totals["batches_failed"], totals["batches_flushed"], totals["rows_flushed"]) == (1, 1, 2)
    assert spark.table(table).count() == 2


def test_a_document_beyond_the_bound_is_rejected(spark, table, tmp_path):
    """The real bound, through landing, check and rejects."""
    large = event(1, 1, padding="x" * MAX_EVENT_BYTES)
    fits = event(2, 1, padding="x" * (MAX_EVENT_BYTES - len(event(2, 1, padding=""))))
    assert len(fits) == MAX_EVENT_BYTES
    land(tmp_path / "landing", "a.json", [large, fits, event(3, 1)])
    counters = S.flush_batch(read_events(spark, str(tmp_path / "landing")), table)
    assert (counters["events_invalid"], counters["rows_flushed"]) == (1, 2)
    kept = spark.table(S.rejects_name(table)).selectExpr("octet_length(value) AS n", "status").collect()
    assert [(r.n, r.status) for r in kept] == [(len(large), "malformed")]
