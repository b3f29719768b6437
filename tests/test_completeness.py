"""Completeness as a stream: what is reported when, and the same as in a batch."""

from datetime import datetime, timedelta

from runweave.operators import check_complete
from runweave.streaming import completeness_stream, findings_report

START = datetime(2024, 1, 1)
PLAN, GOT = "chunk_id long, n_items long, issued timestamp", "chunk_id long, n_items long, returned timestamp"


def minute(m):
    return START + timedelta(minutes=m)


def replay(spark, tmp_path, plan, got):
    """Adds the rows to both folders and takes them up in one go; all findings so far."""
    for name, rows, schema in (("plan", plan, PLAN), ("got", got, GOT)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in (("plan", PLAN), ("got", GOT))]
    found = completeness_stream(*streams, within=timedelta(minutes=10), lateness=timedelta(minutes=2))
    writer = found.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(str(tmp_path / "out"))


def told(findings):
    return sorted((r["chunk_id"], r["finding"]) for r in findings.collect())


def test_chunks_are_missing_once_their_time_has_passed(spark, tmp_path):
    plan = [(1, 10, minute(0)), (2, 10, minute(1)), (3, 10, minute(2)), (4, 10, minute(3)), (None, 5, minute(3))]
    got = [(1, 10, minute(4)), (3, 9, minute(5)), (1, 10, minute(6)), (77, 10, minute(7)), (None, 5, minute(8))]
    first = replay(spark, tmp_path, plan, got)
    # Nothing has passed: only pairs are told.
    pairs = [(r["chunk_id"], r["finding"]) for r in first.where("chunk_id is not null").collect()]
    assert sorted(pairs) == [(1, "done"), (1, "done"), (3, "size_mismatch")]
    assert [r["finding"] for r in first.where("chunk_id is null").collect()] == ["done"]
    # Up to minute 12: chunk 2 is gone, 77 was never planned, 4 still has time.
    second = replay(spark, tmp_path, [(5, 1, minute(14))], [(5, 1, minute(15))]).where("chunk_id is not null")
    assert told(second) == [(1, "done"), (1, "done"), (2, "missing"), (3, "size_mismatch"), (5, "done"), (77, "unexpected")]
    # Chunk 4 comes back after its time.
    third = replay(spark, tmp_path, [(9, 1, minute(60))], [(4, 10, minute(20)), (9, 1, minute(61))]).where("chunk_id is not null")
    assert told(third) == sorted([*told(second), (4, "missing"), (4, "unexpected"), (9, "done")])


def test_findings_report_equals_the_batch_report(spark, tmp_path):
    plan = [(i, i % 7, minute(i % 30)) for i in range(300)]
    got = [(i + 1_000 * (i % 17 == 0), i % 7 + (i % 13 == 0), minute(i % 30 + i % 9)) for i in range(300) if i % 11]
    got += [(i, i % 7, minute(i % 30 + 3)) for i in range(0, 300, 19)]
    # A last pair lets the time of all others pass.
    end = [(9_999, 1, minute(900))], [(9_999, 1, minute(900))]
    found = replay(spark, tmp_path, plan + end[0], got + end[1])
    want = check_complete(spark.createDataFrame(plan + end[0], PLAN), spark.createDataFrame(got + end[1], GOT)).first()
    assert findings_report(found).first() == want and want["missing"] and want["duplicate"] and want["unexpected"]


def test_nothing_planned_and_nothing_returned(spark, tmp_path):
    found = replay(spark, tmp_path, [(1, 1, None)], [])
    assert found.count() == 0 and findings_report(found).first()["complete"]
