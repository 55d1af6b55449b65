"""Queries without SQL hand their operators whole tables."""

import pytest

from gridloom.operators import doors
from gridloom.plans import registry
from gridloom.streaming import machines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["fused_instances", "object_memory", "door_memory", "separator_memory"])
def test_machines_get_every_event(spark, monkeypatch, name):
    monkeypatch.setattr(machines, "in_batch", lambda rows, *_: rows)
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_every_ray_leaves_evidence(spark):
    e = registry.Tables(spark, SF).e
    assert registry.queries()["ray_evidence_2d"](spark, SF).selectExpr("sum(hit)").first()[0] == e.where("occ").count()


def test_topology_gets_every_cell_and_door(spark, monkeypatch):
    monkeypatch.setattr(machines, "in_batch", lambda rows, *_: rows)
    rows = registry.queries()["topology_map"](spark, SF)
    got = rows.selectExpr("sum(size(cells)) as cells", "sum(size(doors)) as doors").first()
    e = registry.Tables(spark, SF).e.selectExpr("user_id % 5 as scene", "step", "r % 4 as r", "c % 12 as c", "c % 9 as door")
    assert got.cells == e.select("scene", "step", "r", "c").distinct().count()
    assert got.doors == e.select("scene", "step", "door").distinct().count()


def test_door_conflicts_get_whole_lines(spark, monkeypatch):
    monkeypatch.setattr(doors, "without_conflicts", lambda lines, keys: lines)
    assert registry.queries()["door_conflicts"](spark, SF).selectExpr("sum(size(cells))").first()[0] == registry.Tables(spark, SF).lines.count()
