"""Keeps the manifest of a run's saved text artifacts, so later steps can skip what is done and find what changed.

Takes the new files of each kind of artifact (a stream that ends when nothing
is new), hashes whole texts, and adds one row for each content of each
artifact that the manifest lacks: `manifest` by kind and batch, with the
first artifact of the same content (`owner_id`) and a status: `missing` (null
text), `changed` (the artifact is known with another content), `repeat` (the
content has another owner), else `new`. `scenes` by kind sums the manifest up.
A batch that is run again overwrites its own folder and looks at earlier ones
alone, so it writes the same rows; a run without new files changes nothing.
Rows without an id are left out and counted in the log.

    python -m jobs.artifact_manifest --tables DIR --out PATH --checkpoint PATH [--config jobs/artifact_manifest.json]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.sources import sinks

from .common import beside, log, new_files, session, settings

CONFIG = beside(__file__, "artifact_manifest.json")
MANIFEST = "artifact_id long, scene string, sha256 string, n_bytes long, n_lines long, copies long, owner_id long, status string, kind string, batch long"
NONE = "none"


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def scenes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/scenes")


def artifacts(rows: DataFrame) -> DataFrame:
    """One row by artifact and content, with how often it stands in the input; texts themselves are not shuffled."""
    text = F.col("text")
    plain = rows.where("artifact_id is not null").select(
        "artifact_id", scalar.slug(F.coalesce("scene", F.lit(""))).alias("scene"), F.coalesce(scalar.sha256(text), F.lit(NONE)).alias("sha256"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
    )
    plain = plain.withColumn("n_lines", F.when(F.col("sha256") == NONE, 0).otherwise(F.col("n_lines")))
    return plain.groupBy("artifact_id", "sha256").agg(F.min("scene").alias("scene"), F.max("n_bytes").alias("n_bytes"), F.max("n_lines").alias("n_lines"), F.count("*").alias("copies"))


def taken_in(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """The manifest rows that a batch adds to the earlier ones of its kind."""
    fresh = sinks.missing_only(artifacts(rows), earlier, ["artifact_id", "sha256"])
    known = earlier.select("artifact_id").distinct().withColumn("known", F.lit(True))
    owners = fresh.select("sha256", F.col("artifact_id").alias("mine"), F.lit(None).cast("long").alias("old")).union(earlier.select("sha256", F.lit(None).cast("long"), "owner_id"))
    owners = owners.where(F.col("sha256") != NONE).groupBy("sha256").agg(F.coalesce(F.min("old"), F.min("mine")).alias("owner_id"))
    found = fresh.join(owners, "sha256", "left").join(known, "artifact_id", "left")
    status = F.when(F.col("sha256") == NONE, "missing").when(F.col("known"), "changed").when(F.col("owner_id") != F.col("artifact_id"), "repeat").otherwise("new")
    return found.select("artifact_id", "scene", "sha256", "n_bytes", "n_lines", "copies", "owner_id", status.alias("status"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "scene").agg(F.countDistinct("artifact_id").alias("artifacts"), F.countDistinct("sha256").alias("contents"), F.sum("n_bytes").alias("n_bytes"), F.count(F.when(F.col("status") == "repeat", 1)).alias("repeats"))


def run(spark: SparkSession, tables: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes all new files of each kind; gives the rows read, those without an id, and the manifest rows written."""
    done = {"read": 0, "without_id": 0, "written": 0}
    spark.createDataFrame([], MANIFEST).write.mode("ignore").partitionBy("kind", "batch").parquet(f"{out}/manifest")
    for kind, columns in config["kinds"].items():
        rows = new_files(spark, f"{tables}/{kind}.parquet", config.get("files_per_batch")).selectExpr(*[f"{columns[c]} as {c}" for c in ("artifact_id", "scene", "text")])

        def take(batch: DataFrame, number: int, kind: str = kind) -> None:
            here = batch.sparkSession
            earlier = manifest(here, out).where((F.col("kind") == kind) & (F.col("batch") < number))
            added = taken_in(batch, earlier).select("*", F.lit(kind).alias("kind"), F.lit(number).cast("long").alias("batch"))
            added.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(f"{out}/manifest")
            n = batch.selectExpr("count(*) as n", "count_if(artifact_id is null) as lost").first()
            wrote = manifest(here, out).where((F.col("kind") == kind) & (F.col("batch") == number)).count()
            log.info("%s, batch %d: read %d rows, %d without an id; wrote %d rows to %s/manifest", kind, number, n.n, n.lost, wrote, out)
            for name, m in (("read", n.n), ("without_id", n.lost), ("written", wrote)):
                done[name] += m

        query = rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{kind}").trigger(availableNow=True).start()
        query.awaitTermination()
    summed(manifest(spark, out)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(f"{out}/scenes")
    log.info("read %d rows of %s, wrote %d rows to %s", done["read"], tables, done["written"], out)
    return done


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("tables", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=CONFIG)
    given = parser.parse_args()
    spark = session("artifact-manifest")
    try:
        run(spark, given.tables, given.out, given.checkpoint, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
