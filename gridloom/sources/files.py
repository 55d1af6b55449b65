"""Sources: snapshot archives, listings, JSON lines with line numbers, room polygons, nested configuration."""

from __future__ import annotations

import io
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar


def snapshot_listing(spark: SparkSession, root: str, glob: str = "*.npz") -> DataFrame:
    """(path, scene, step, source) of files below root, ordered by scene and step; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path")
    named = scalar.step_with_source(F.element_at(F.split("path", "/"), -1), F.lit(None).cast("long"), F.lit(None).cast("long"))
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("scene"), named.alias("s")).select("path", "scene", "s.step", "s.source").orderBy("scene", "step", "path")


def snapshot_cells(spark: SparkSession, root: str, layers: list[str], glob: str = "*.npz") -> DataFrame:
    """(path, scene, step, r, c, layers as doubles) of numpy archives; a missing layer is null. Pickled arrays are refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", "content")

    def cells(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    found = {k: archive[k] for k in layers if k in archive.files and archive[k].ndim == 2}
                if not found:
                    continue
                h, w = next(iter(found.values())).shape
                r, c = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"path": path, "r": r, "c": c, **{k: found[k].ravel().astype(float) if k in found else np.nan for k in layers}})

    rows = files.mapInPandas(cells, ", ".join(["path string", "r int", "c int", *(f"`{k}` double" for k in layers)]))
    step = scalar.step_of_path(F.element_at(F.split("path", "/"), -1))
    return rows.select("path", F.element_at(F.split("path", "/"), -2).alias("scene"), step.alias("step"), "r", "c", *[F.when(~F.isnan(k), F.col(k)).alias(k) for k in layers])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file, malformed ones null in `row`, with the file and the place of each line in it."""
    text = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = text.select("file", F.posexplode(F.split("value", "\n")).alias("line", "text")).where(F.trim("text") != "")
    return lines.select("file", "line", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("row"), F.try_parse_json("text").isNotNull().alias("well_formed"))


def last_row(lines: DataFrame) -> DataFrame:
    """By file: the last well-formed row and how many there are."""
    return lines.where("well_formed").groupBy("file").agg(F.max(F.struct("line", "row")).alias("l"), F.count("*").alias("rows")).select("file", "l.row.*", "rows")


def rooms(spark: SparkSession, path: str) -> DataFrame:
    """(room_id, category, points) of a JSON list of rooms with polygons."""
    found = spark.read.option("multiLine", "true").schema("room_id string, category string, polygon array<array<double>>").json(path)
    return found.select("room_id", "category", F.transform("polygon", lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))).alias("points"))


def merged_config(*layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers over earlier ones, mappings merged key by key."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def setting(config: dict[str, Any], dotted: str, default: Any = None) -> Any:
    here: Any = config
    for part in dotted.split("."):
        if not isinstance(here, dict) or part not in here:
            return default
        here = here[part]
    return here


def known_only(config: dict[str, Any], names: set[str]) -> dict[str, Any]:
    """The settings that a record knows; others are dropped."""
    return {k: v for k, v in config.items() if k in names}


def yaml_config(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def first_present(*columns: str):
    """The preference chain of optional columns."""
    return F.coalesce(*[F.col(c) for c in columns])
