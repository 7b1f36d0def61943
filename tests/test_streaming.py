import os

from pyspark.sql import functions as F

from siltstone.operators import visibility
from siltstone.plans.catalog import records
from siltstone.schema import WAL_SCHEMA
from siltstone.sources import wal
from siltstone.streaming import tail

DIR = "/root/testdata/sf0.001"


def write_log(spark, path):
    text = records(spark, DIR).withColumn("value", F.col("value").cast("string").cast("binary"))
    text.repartitionByRange(5, "lsn").write.parquet(path)
    return text


def state(df):
    return sorted((bytes(r["key"]), r["seq"]) for r in visibility.visible_entries(df).collect())


def test_tail_equals_batch_and_resumes(spark, tmp_path):
    p = str(tmp_path)
    text = write_log(spark, f"{p}/log")
    tail.tail(tail.read_wal(spark, f"{p}/log", 1), f"{p}/out", f"{p}/cp").awaitTermination()
    assert state(tail.tailed(spark, f"{p}/out")) == state(wal.committed(text))
    before = tail.tailed(spark, f"{p}/out").count()
    more = [(10**9, 1, -5, None, None, None, None, None), (10**9 + 1, 4, -5, 10**8, 0, b"zz", b"1", None), (10**9 + 2, 4, -6, 10**8 + 1, 0, b"yy", b"1", None)]
    spark.createDataFrame(more, WAL_SCHEMA).coalesce(1).write.mode("append").parquet(f"{p}/log")
    tail.tail(tail.read_wal(spark, f"{p}/log"), f"{p}/out", f"{p}/cp").awaitTermination()
    assert tail.tailed(spark, f"{p}/out").count() == before  # no commit yet
    spark.createDataFrame([(10**9 + 3, 2, -5, None, None, None, None, None), (10**9 + 4, 3, -6, None, None, None, None, None)], WAL_SCHEMA).coalesce(1).write.mode("append").parquet(f"{p}/log")
    tail.tail(tail.read_wal(spark, f"{p}/log"), f"{p}/out", f"{p}/cp").awaitTermination()
    assert tail.tailed(spark, f"{p}/out").count() == before + 1


def add_file(spark, path, rows, minute):
    """One file of a log, which a stream takes in the order of minutes."""
    known = set(os.listdir(path)) if os.path.isdir(path) else set()
    spark.createDataFrame(rows, WAL_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    for name in set(os.listdir(path)) - known:
        os.utime(f"{path}/{name}", (1.7e9 + 60 * minute, 1.7e9 + 60 * minute))


def entry(lsn, txn, key, kind=0):
    return lsn, 4, txn, lsn, kind, key, b"1", None


def mark(lsn, type_, txn):
    return lsn, type_, txn, None, None, None, None, None


def run_tail(spark, p, files=1):
    stream = tail.tail(tail.read_wal(spark, f"{p}/log", files), f"{p}/out", f"{p}/cp")
    stream.awaitTermination()
    return stream, sorted(bytes(r["key"]) for r in tail.tailed(spark, f"{p}/out").collect())


def test_tail_releases_without_state_per_transaction(spark, tmp_path):
    """No Python call and no keyed state for each transaction, whose number grows with the log."""
    p = str(tmp_path)
    text = write_log(spark, f"{p}/log")
    stream, keys = run_tail(spark, p, 2)
    assert [b for b in stream.recentProgress if b["stateOperators"]] == []
    assert "Pandas" not in stream._jsq.explainInternal(False)
    assert keys == sorted(bytes(r["key"]) for r in wal.committed(text).collect())


def test_tail_takes_a_transactions_files_in_any_order(spark, tmp_path):
    p = str(tmp_path)
    add_file(spark, f"{p}/log", [entry(20, 1, b"c"), mark(25, 2, 1), entry(26, 2, b"x"), mark(29, 3, 2)], 1)
    add_file(spark, f"{p}/log", [mark(3, 1, 1), entry(4, 1, b"a"), entry(5, 2, b"y"), entry(6, 3, b"open")], 2)
    add_file(spark, f"{p}/log", [entry(12, 1, b"b"), entry(13, 2, b"z")], 3)
    assert run_tail(spark, p)[1] == [b"a", b"b", b"c"]
    add_file(spark, f"{p}/log", [mark(40, 2, 3)], 4)
    assert run_tail(spark, p)[1] == [b"a", b"b", b"c", b"open"]


def test_tail_tells_transactions_of_one_number_apart(spark, tmp_path):
    p = str(tmp_path)
    add_file(spark, f"{p}/log", [entry(1, 1, b"a"), mark(2, 2, 1), entry(3, 1, b"b"), mark(4, 3, 1), entry(5, 1, b"c")], 1)
    assert run_tail(spark, p)[1] == [b"a"]
    add_file(spark, f"{p}/log", [entry(6, 1, b"d")], 2)
    assert run_tail(spark, p)[1] == [b"a"]  # its older ends say nothing about it
    add_file(spark, f"{p}/log", [mark(7, 2, 1), entry(8, 9, b"torn"), mark(0, 3, 9)], 3)
    assert run_tail(spark, p)[1] == [b"a", b"c", b"d"]
    assert spark.read.parquet(f"{p}/cp/open/batch=2").count() == 0  # an unwritten segment's rollback, at 0, drops its entries


def test_tail_batch_that_runs_again_changes_nothing(spark, tmp_path):
    p = str(tmp_path)
    release = tail.Release(f"{p}/out", f"{p}/cp")
    batches = [[entry(1, 1, b"a"), entry(2, 2, b"b")], [mark(3, 2, 2), entry(4, 3, b"c")], [mark(5, 2, 1)], [], [mark(6, 2, 3)]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            release(spark.createDataFrame(rows, WAL_SCHEMA), number)
    assert sorted(bytes(r["key"]) for r in tail.tailed(spark, f"{p}/out").collect()) == [b"a", b"b", b"c"]
    assert sorted(os.listdir(f"{p}/cp/open")) == ["batch=3", "batch=4"]


def test_latest_stream_ignores_late_rows(spark, tmp_path):
    p = str(tmp_path)
    schema = "seq long, kind tinyint, key binary, value binary, range_end binary"
    spark.createDataFrame([(5, 0, b"a", b"5", None), (7, 0, b"b", b"7", None)], schema).write.parquet(f"{p}/in")
    out = {}

    def take(batch, _):
        out.update({bytes(r["key"]): (r["seq"], r["kind"]) for r in batch.collect()})

    def run():
        stream = tail.latest_stream(spark.readStream.schema(schema).parquet(f"{p}/in"))
        stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{p}/cp").trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([(3, 0, b"a", b"3", None), (7, 1, b"b", None, None)], schema).write.mode("append").parquet(f"{p}/in")
    run()
    assert out == {b"a": (5, 0), b"b": (7, 1)}
