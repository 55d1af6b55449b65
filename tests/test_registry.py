"""Typed state: a stream that starts from another's exported records goes on as if unbroken."""

import pytest
from pyspark.sql import functions as F

from gridloom.streaming import machines, registry

SHAPE = "scene long, step long, query_id long, kind string, r double, c double, target_r double, target_c double, suppress_steps long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, registry.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def rows_of(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    target = "cast(if(user_id % 3 = 0, null, user_id % 3) as double)"
    return e.selectExpr("user_id % 4 as scene", "event_id div 25 as step", "event_id as query_id", "if(event_id % 5 = 0, 'mark', 'query') as kind", "cast(user_id % 20 as double) as r", "cast(event_id * 7 % 20 as double) as c", f"{target} as target_r", f"{target} as target_c", "event_id % 9 as suppress_steps")


def ran(spark, source, out, check, snapshot=None):
    stream = registry.suppressed(spark.readStream.schema(SHAPE).parquet(source), radius=2.0, tile=4, snapshot=snapshot)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return {(x.scene, x.step, x.query_id): x.suppressed for x in spark.read.parquet(out).collect()}


def test_a_stream_from_a_snapshot_goes_on_as_if_unbroken(rocks, sf, tmp_path):
    rows = rows_of(rocks, sf).select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in SHAPE.split(", ")])
    parts = [rows.where("step < 12"), rows.where("step between 12 and 25"), rows.where("step > 25")]
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        first = ran(rocks, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    registry.exported(rocks, f"{tmp_path}/check", 26).write.parquet(f"{tmp_path}/snapshot")
    snapshot = rocks.read.parquet(f"{tmp_path}/snapshot")
    assert snapshot.count() > 20 and registry.exported(rocks, f"{tmp_path}/check").count() > snapshot.count()
    parts[2].coalesce(1).write.parquet(f"{tmp_path}/rest")
    second = ran(rocks, f"{tmp_path}/rest", f"{tmp_path}/out2", f"{tmp_path}/check2", snapshot)
    parts[2].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    unbroken = ran(rocks, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    assert not first.keys() & second.keys() and first | second == unbroken
    fresh = ran(rocks, f"{tmp_path}/rest", f"{tmp_path}/out3", f"{tmp_path}/check3")
    assert fresh != second  # the snapshot matters
    whole = machines.in_batch(rows, ["scene"], "step", lambda s, t, r: machines.terminal_registry(s, t, r, 2.0), machines.OUTPUTS["terminal_registry"])
    assert unbroken == {(x.scene, x.step, x.query_id): x.suppressed for x in whole.collect()} and set(unbroken.values()) == {True, False}
