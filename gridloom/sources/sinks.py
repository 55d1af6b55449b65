"""Sinks: snapshots, label swaps, JSON lines, fixed-field CSV, small reports. Writes go through Spark's commit protocol."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshots(cells: DataFrame, path: str, layers: list[str], keys: tuple[str, ...] = ("scene", "step"), mode: str = "overwrite") -> None:
    """The listed layers alone, a folder by scene and step."""
    cells.select(*keys, "r", "c", *layers).repartition(*keys).sortWithinPartitions(*keys, "r", "c").write.mode(mode).partitionBy(*keys).parquet(path)


def with_label_layer(cells: DataFrame, labels: DataFrame, keys: list[str], name: str, layer: str = "final_label") -> DataFrame:
    """Snapshot cells with their label layer swapped for another's, and its name."""
    fresh = labels.select(*keys, "r", "c", F.col("label").alias("__label"))
    return cells.drop(layer).join(fresh, [*keys, "r", "c"], "left").withColumn(layer, F.coalesce("__label", F.lit(0))).drop("__label").withColumn("baseline", F.lit(name))


def write_json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """A header and the listed fields in order, others left out."""
    rows.select(*fields).write.mode("overwrite").option("header", "true").csv(path)


def missing_only(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned outputs that don't exist yet."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def markdown(rows: DataFrame, columns: list[str], limit: int = 1000) -> str:
    """A small ordered result as a table for a report."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    shown = rows.select(*columns).orderBy(*columns).limit(limit).collect()
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in shown]) + "\n"


def gallery(rows: DataFrame, columns: list[str], limit: int = 1000) -> str:
    """The same as HTML."""
    shown = rows.select(*columns).orderBy(*columns).limit(limit).collect()
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)
    return "<table><tr>" + cells("th", columns) + "</tr>" + "".join("<tr>" + cells("td", r) + "</tr>" for r in shown) + "</table>"


def completed_results(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Result rows with required fields filled: missing columns added, nulls replaced."""
    have = set(rows.columns)
    return rows.select(*[c for c in rows.columns if c not in defaults], *[(F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v)).alias(k) for k, v in defaults.items()])


def gate(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, failures) of data-quality rules given as SQL conditions; null counts as failed."""
    counts = rows.agg(*[F.sum(F.when(F.coalesce(F.expr(cond), F.lit(False)), 0).otherwise(1)).alias(name) for name, cond in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in rules]), F.array(*[F.coalesce(F.col(n), F.lit(0)) for n in rules]))).alias("rule", "failures"))
