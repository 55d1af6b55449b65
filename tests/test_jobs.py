"""The jobs on growing copies of the tables, on failures, and as queries against their SQL."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.streaming.blocks import BlockMap
from jobs import artifact_manifest, online_map, queries
from jobs.common import settings

MAP = settings(online_map.CONFIG)
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def rows(df, *drop):
    return sorted(map(tuple, df.drop(*drop).collect()), key=repr)


def files(df):
    return {r[0] for r in df.select("_metadata.file_path").distinct().collect()}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    before = dict(spark.conf.getAll)
    got, want = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    assert rows(got.select(*[c[0] for c in want.description])) == sorted(want.fetchall(), key=repr)
    assert before == dict(spark.conf.getAll)


def grow(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def once(spark, sf, tmp_path_factory):
    """The map of all events in one batch."""
    root = str(tmp_path_factory.mktemp("once"))
    grow(spark.read.parquet(f"{sf}/events.parquet"), f"{root}/events")
    online_map.run(spark, f"{root}/events", f"{root}/out", f"{root}/check", MAP)
    target = online_map.block_map(f"{root}/out", MAP)
    return rows(target.current(spark)), rows(target.layers(spark))


def test_map_over_growing_input(spark, sf, tmp_path, once, monkeypatch):
    events, root = spark.read.parquet(f"{sf}/events.parquet"), str(tmp_path)
    args = (f"{root}/events", f"{root}/out", f"{root}/check", MAP)
    target = online_map.block_map(f"{root}/out", MAP)
    grow(events.where("event_id < 300"), args[0])
    first = online_map.run(spark, *args)
    assert first["read"] == 300 and first["batches"] == 1
    held = files(target._state(spark)) | files(target.layers(spark))
    assert online_map.run(spark, *args) == {"read": 0, "batches": 0, "blocks": 0, "voxels": 0}
    assert files(target._state(spark)) | files(target.layers(spark)) == held

    grow(events.where("event_id >= 300 and event_id < 800"), args[0])
    with monkeypatch.context() as patch:  # the batch fails with its state written, and its layers not
        patch.setattr(BlockMap, "project", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            online_map.run(spark, *args)
    assert online_map.run(spark, *args)["read"] == 500
    grow(events.where("event_id >= 800"), args[0])
    assert online_map.run(spark, *args)["read"] == 200
    assert (rows(target.current(spark)), rows(target.layers(spark))) == once
    slots = target._state(spark).groupBy("scene", "block").agg(F.countDistinct("version").alias("n"), F.countDistinct("slot").alias("s")).collect()
    assert max(r.n for r in slots) == 2 and all(r.n == r.s for r in slots)  # three batches, two versions


def test_a_batch_writes_the_blocks_that_it_touches(spark, tmp_path):
    target = BlockMap(str(tmp_path), 64, 64, block=8, reach=2, obstacle=(0, 3), free=(0, 3))
    shape = "scene long, frame long, z int, r int, c int, hit boolean"
    target.prepare(spark)
    everywhere = [(s, 0, 1, r, c, (r + c) % 5 == 0) for s in (1, 2) for r in range(64) for c in range(64)]
    target.fold(spark.createDataFrame(everywhere, shape), 0)
    state, layers = files(target._state(spark)), files(target.layers(spark))
    # the middle of a block reaches no other; the corner of one reaches three more
    for number, (r, c), blocks in ((1, (20, 20), {(2, 2)}), (2, (40, 39), {(4, 4), (4, 5), (5, 4), (5, 5)})):
        target.fold(spark.createDataFrame([(1, number, 1, r, c, True)], shape), number)
        new_state, new_layers = files(target._state(spark)) - state, files(target.layers(spark)) - layers
        assert len(new_state) == 1 and f"block={r // 8 * 32768 + c // 8}/" in new_state.pop()
        assert {(int(f.split("block=")[1].split("/")[0]) // 32768, int(f.split("block=")[1].split("/")[0]) % 32768) for f in new_layers} == blocks
        assert all("scene=1/" in f for f in new_layers)
        state, layers = files(target._state(spark)), files(target.layers(spark))
    got = {(r.r, r.c) for r in target.layers(spark).where("scene = 1 and inflated").collect()}
    hit = {(r, c) for r in range(64) for c in range(64) if (r + c) % 5 == 0} | {(20, 20), (40, 39)}
    assert got == {(r + a, c + b) for r, c in hit for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4 and 0 <= r + a < 64 and 0 <= c + b < 64}


def test_obstacles_that_go_take_their_surroundings_along(spark, tmp_path):
    target = BlockMap(str(tmp_path), 32, 32, block=8, reach=3, obstacle=(0, 3), free=(0, 3))
    shape = "scene long, frame long, z int, r int, c int, hit boolean"
    target.prepare(spark)
    target.fold(spark.createDataFrame([(1, 0, 1, 8, 8, True)], shape), 0)
    assert {r.block for r in target.layers(spark).collect()} == {0, 1, 32768, 32769}
    misses = [(1, n, 1, 8, 8, False) for n in range(1, 14)] + [(1, 1, 1, -1, 3, True), (1, 1, 1, 3, 32, True), (None, 1, 1, 3, 3, True), (1, None, 1, 3, 3, True), (1, 1, None, 3, 3, True)]
    target.fold(spark.createDataFrame(misses, shape), 1)
    assert rows(target.layers(spark)) == [(8, 8, False, True, False, True, 1, 32769)]
    target.fold(spark.createDataFrame([], shape), 2)
    assert rows(target.layers(spark)) == [(8, 8, False, True, False, True, 1, 32769)]


TEXTS = {"kinds": {"documents": {"artifact_id": "doc_id", "scene": "source", "text": "text"}}, "files_per_batch": None}


def test_manifest_over_growing_input(spark, tmp_path, monkeypatch):
    shape, root = "doc_id long, source string, text string", str(tmp_path)
    args = (root, f"{root}/out", f"{root}/check", TEXTS)
    status = lambda: {(r.artifact_id, r.batch): (r.status, r.owner_id, r.copies) for r in artifact_manifest.manifest(spark, args[1]).collect()}
    grow(spark.createDataFrame([(5, "run a", "x\ny"), (3, "b", "x\ny"), (3, "b", "x\ny"), (7, "b", None), (8, None, ""), (None, "b", "lost")], shape), f"{root}/documents.parquet")
    assert artifact_manifest.run(spark, *args) == {"read": 6, "without_id": 1, "written": 4}
    first = {(5, 0): ("repeat", 3, 1), (3, 0): ("new", 3, 2), (7, 0): ("missing", None, 1), (8, 0): ("new", 8, 1)}
    assert status() == first
    assert artifact_manifest.run(spark, *args) == {"read": 0, "without_id": 0, "written": 0} and status() == first

    grow(spark.createDataFrame([(1, "b", "x\ny"), (3, "b", "z"), (5, "run a", "x\ny"), (9, "b", "x" * 300_000)], shape), f"{root}/documents.parquet")
    with monkeypatch.context() as patch:  # fails after its rows are written
        patch.setattr(artifact_manifest.log, "info", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            artifact_manifest.run(spark, *args)
    second = {(1, 1): ("repeat", 3, 1), (3, 1): ("changed", 3, 1), (9, 1): ("new", 9, 1)}
    assert artifact_manifest.run(spark, *args) == {"read": 4, "without_id": 0, "written": 3}
    assert status() == first | second
    assert rows(artifact_manifest.scenes(spark, args[1])) == rows(spark.createDataFrame([("", 1, 1, 0, 0, "documents"), ("b", 4, 4, 300_007, 1, "documents"), ("run_a", 1, 1, 3, 1, "documents")], "scene string, artifacts long, contents long, n_bytes long, repeats long, kind string").select(artifact_manifest.scenes(spark, args[1]).columns))


def test_command_line(sf, tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    call = [sys.executable, "-m", "jobs.online_map", "--events", f"{sf}/events.parquet", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/check"]
    for read in (1000, 0):
        said = subprocess.run(call, cwd=here, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}, capture_output=True, text=True, timeout=300)
        assert said.returncode == 0, said.stderr[-2000:]
        assert f"read {read} observations of {sf}/events.parquet" in said.stderr
