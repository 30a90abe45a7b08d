"""Decisions that come late, twice, out of order, or again after a failure."""

import datetime as dt

from tubula.streaming import decisions

BEGAN = dt.datetime(2024, 5, 1, 12)
KINDS = "branch_id int, first int, type string, at timestamp"


def put(spark, folder, number, rows):
    table = [(b, f, t, None if m is None else BEGAN + dt.timedelta(minutes=m)) for b, f, t, m in rows]
    spark.createDataFrame(table, KINDS).coalesce(1).write.parquet(f"{folder}/in/n={number}")


def run(spark, folder):
    stream = spark.readStream.schema(KINDS + ", n int").parquet(f"{folder}/in").drop("n")
    decisions.upserted(decisions.latest(stream, "1 hour", 5), f"{folder}/out", f"{folder}/check").awaitTermination(120)


def test_decisions(spark, tmp_path):
    put(spark, tmp_path, 0, [(1, 1, "NORMAL", 0), (1, 1, "SACCULAR", 10), (1, 1, "NORMAL", 5), (2, 4, "NORMAL", 3), (2, 4, "FUSIFORM", 3), (None, 1, "NORMAL", 1), (3, 1, None, 1)])
    run(spark, tmp_path)
    first = {(r.branch_id, r["first"]): r.type for r in decisions.decided(spark, f"{tmp_path}/out").collect()}
    assert first == {(1, 1): "SACCULAR", (2, 4): "NORMAL"}  # equally late: the greatest type
    put(spark, tmp_path, 1, [(1, 1, "SACCULAR", 10), (1, 1, "NORMAL", 8), (2, 4, "FUSIFORM", 30), (9, 9, "NORMAL", 600)])
    run(spark, tmp_path)
    rows = decisions.decided(spark, f"{tmp_path}/out").collect()
    assert {(r.branch_id, r["first"]): r.type for r in rows} == {(1, 1): "SACCULAR", (2, 4): "FUSIFORM", (9, 9): "NORMAL"}
    # A repeated one and one that was overtaken made no row of their own.
    assert spark.read.schema(decisions.LATEST).parquet(f"{tmp_path}/out").where("branch_id = 1").count() == 1
    # More than an hour behind the stream by now: left out.
    put(spark, tmp_path, 2, [(2, 4, "SACCULAR", 60), (9, 9, "SACCULAR", 610)])
    run(spark, tmp_path)
    late = {(r.branch_id, r["first"]): r.type for r in decisions.decided(spark, f"{tmp_path}/out").collect()}
    assert late == {(1, 1): "SACCULAR", (2, 4): "FUSIFORM", (9, 9): "SACCULAR"}
    # A batch that is run again replaces itself.
    before = sorted(map(tuple, decisions.decided(spark, f"{tmp_path}/out").collect()))
    again = spark.read.schema(decisions.LATEST).parquet(f"{tmp_path}/out/batch=0")
    kept = again.collect()
    spark.createDataFrame(kept, decisions.LATEST).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=0")
    assert sorted(map(tuple, decisions.decided(spark, f"{tmp_path}/out").collect())) == before
    found = spark.createDataFrame([(1, 1, 5.0), (2, 4, 6.0), (7, 1, 7.0)], "branch_id int, first int, score double")
    assert {(r.branch_id, r.type) for r in decisions.reviewed(found, f"{tmp_path}/out").collect()} == {(1, "SACCULAR"), (2, "FUSIFORM"), (7, "UNKNOWN")}
