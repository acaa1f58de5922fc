import glob
import hashlib
import io

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from tallyglass.llm import warc_bundles as W
from tallyglass.session import fresh_path

SCHEMA = "page_id long, url string, html string, payload string, last int"
BIG = "<p>é</p>" * 200
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2\nx", BIG), (9, None, BIG), (9, None, BIG), (None, "u", BIG), (3, "u", "small"), (4, "u", "small"),
    (5, "u", None), (6, "u", ""), (7, "u", "x" * 999), (8, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (12, "u", "WARC/1.1\r\n\r\n" * 300),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)


def expected(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        kept = max(same) if len(data) >= 1000 and same else i
        revisit = kept is not None and (i is None or i < kept)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    assert sorted(map(tuple, W.archive(frame(spark, ROWS)).collect()), key=str) == expected(ROWS)
    assert W.archive(frame(spark, [])).count() == 0


def test_bundles_are_plain_zstandard_and_seekable(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(400)]
    folder = fresh_path(spark, "bundle-test")
    index = W.write_bundles(W.with_revisits(frame(spark, rows).repartition(3)), folder, frame_bytes=4000, bundle_bytes=6000).cache()
    files = glob.glob(f"{folder.removeprefix('file://')}/*.warc.zst")
    assert len(files) == index.select("path").distinct().count() > 3
    assert index.count() == 400 and index.select("record_id").distinct().count() == 400
    for name in files:
        with open(name, "rb") as f:
            data = f.read()
        frames = W.frames_of(io.BytesIO(data), len(data))
        assert frames and sum(packed for _, packed, _ in frames) < len(data)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert len(whole) == sum(plain for _, _, plain in frames)
        one = zstandard.ZstdDecompressor().decompress(data[frames[-1][0] : frames[-1][0] + frames[-1][1]])
        assert one.startswith(b"WARC/1.1\r\n")
    wanted = index.where("page IN ('17', '399')")
    got = {r.page: bytes(r.payload).decode() for r in W.fetch(wanted).collect()}
    assert got == {str(i): rows[i][2] for i in (17, 399)}
    found = {r.record_id: r for r in W.fetch(index).collect()}
    assert len(found) == 400 and all(found[r.record_id].page == r.page for r in index.collect())


def test_a_bundle_is_read_by_many_tasks(spark):
    """Also with adaptive execution, which would put frames' names into one partition."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 40) for i in range(600)]
    index = W.write_bundles(W.with_revisits(frame(spark, rows).coalesce(1)), fresh_path(spark, "bundle-test"), frame_bytes=2000)
    assert index.select("path").distinct().count() == 1
    read = W.read_bundles(index).withColumn("task", F.spark_partition_id())
    counts = {r.task: r["count"] for r in read.groupBy("task").count().collect()}
    assert sum(counts.values()) == 600 and len(counts) == spark.sparkContext.defaultParallelism and max(counts.values()) < 300
    spans = {(r.path, r.frame_offset, r.frame_bytes) for r in index.collect()}
    assert {tuple(r) for r in W.seek_tables(index).collect()} == spans


def test_names_of_stores(monkeypatch):
    for path, want in (("s3a://b/x", "s3://b/x"), ("s3n://b/x", "s3://b/x"), ("/tmp/s3a://x", "/tmp/s3a://x")):
        monkeypatch.setattr(W, "fs", type("fs", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(lambda p: p)})}))
        assert W.store_of(path) == want


def test_damage_is_noticed():
    data = W.record_bytes("<urn:x>", "1", "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    record, end = W.parse_record(data)
    assert end == len(data) and record["payload"] == b"payload"
    for bad in (data.replace(b"payload", b"pAyload"), data[:-3], b"x" + data):
        try:
            W.parse_record(bad)
        except ValueError:
            continue
        raise AssertionError("damage passed")


def test_batches_without_rows_have_the_schema():
    assert W._batch([], W._INDEX_ARROW).schema == W._INDEX_ARROW and pa.__version__
