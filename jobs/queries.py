"""The jobs as registered queries: each runs twice into one new folder and gives its whole output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.storage import shared_dir

from . import artifact_manifest, online_map
from .common import settings


def job1_artifact_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/jobs/artifact-manifest-{uuid.uuid4().hex}"
    for _ in range(2):
        artifact_manifest.run(spark, sf_dir, f"{root}/out", f"{root}/checkpoint", settings(artifact_manifest.CONFIG))
    return artifact_manifest.manifest(spark, f"{root}/out")


def job2_online_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, config = f"{shared_dir(spark)}/jobs/online-map-{uuid.uuid4().hex}", settings(online_map.CONFIG)
    for _ in range(2):
        online_map.run(spark, f"{sf_dir}/events.parquet", f"{root}/out", f"{root}/checkpoint", config)
    return online_map.block_map(f"{root}/out", config).layers(spark)


QUERIES = {"job1_artifact_manifest": job1_artifact_manifest, "job2_online_map": job2_online_map}

#: One batch holds all of a table, so the first owner is the smallest id.
MANIFEST_SQL = r"""
WITH t AS (SELECT 'documents' AS kind, doc_id AS id, source AS scene, text FROM documents
  UNION ALL SELECT 'pages', page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), html FROM pages
  UNION ALL SELECT 'benchmark', item_id, 'benchmark', text FROM benchmark),
a AS (SELECT kind, id, coalesce(sha256(text), 'none') AS sha256, min(regexp_replace(trim(coalesce(scene, '')), '[^A-Za-z0-9_.-]+', '_', 'g')) AS scene,
  max(coalesce(strlen(text), 0)) AS n_bytes, max(coalesce(len(string_split(text, chr(10))), 0)) AS n_lines, count(*) AS copies FROM t WHERE id IS NOT NULL GROUP BY kind, id, coalesce(sha256(text), 'none')),
o AS (SELECT *, CASE WHEN sha256 <> 'none' THEN min(id) OVER (PARTITION BY kind, sha256) END AS owner_id FROM a)
SELECT id AS artifact_id, scene, sha256, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_lines AS BIGINT) AS n_lines, copies, owner_id,
  CASE WHEN sha256 = 'none' THEN 'missing' WHEN owner_id <> id THEN 'repeat' ELSE 'new' END AS status, kind, CAST(0 AS BIGINT) AS batch FROM o
"""

#: The fold as a recursion over frames, the columns, and a disk of radius 2 around obstacles.
MAP_SQL = """
WITH RECURSIVE x AS (SELECT event_id // 2500 AS scene, event_id // 50 AS frame, event_id % 8 AS z, user_id % 24 AS r, (event_id // 3) % 24 AS c, event_type IN ('error', 'purchase') AS hit FROM events),
v AS (SELECT scene, z, r, c, frame, count(*) FILTER (NOT hit) AS free, count(*) FILTER (hit) AS occupied FROM x GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY scene, z, r, c ORDER BY frame) AS n FROM v),
f(scene, z, r, c, n, v, s) AS (SELECT DISTINCT scene, z, r, c, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM v
UNION ALL SELECT scene, z, r, c, n, w, CASE WHEN w >= 1 THEN 2 WHEN w <= -1 AND (s <> 2 OR w <= -6) THEN 1 ELSE s END FROM (
SELECT f.scene, f.z, f.r, f.c, o.n, f.s, greatest(-20, least(20, greatest(-20, least(20, f.v - CASE WHEN o.occupied > 0 THEN 0 ELSE least(o.free, 1) END)) + 4 * least(o.occupied, 3))) AS w
FROM f JOIN o ON o.scene = f.scene AND o.z = f.z AND o.r = f.r AND o.c = f.c AND o.n = f.n + 1)),
state AS (SELECT scene, z, r, c, arg_max(s, n) AS state FROM f GROUP BY ALL),
col AS (SELECT scene, r, c, bool_or(state = 2 AND z BETWEEN 1 AND 6) AS occupied, NOT bool_or(state = 2 AND z BETWEEN 1 AND 6) AND count(*) FILTER (state = 1) >= 1 AS free FROM state GROUP BY ALL),
disk AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE dr * dr + dc * dc <= 4),
fat AS (SELECT DISTINCT scene, r + dr AS r, c + dc AS c, true AS inflated FROM col, disk WHERE occupied AND r + dr BETWEEN 0 AND 23 AND c + dc BETWEEN 0 AND 23),
cell AS (SELECT scene, r, c, coalesce(occupied, false) AS occupied, coalesce(free, false) AS free, coalesce(inflated, false) AS inflated FROM (SELECT * FROM col WHERE occupied OR free) FULL JOIN fat USING (scene, r, c))
SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, occupied, free, inflated, free AND NOT inflated AS navigable, scene, CAST(r // 8 * 32768 + c // 8 AS BIGINT) AS block FROM cell
"""

ORACLE_SQL = {"job1_artifact_manifest": MANIFEST_SQL, "job2_online_map": MAP_SQL}
