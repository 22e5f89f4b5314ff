"""Problem 3 over the object tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.operators import hierarchy as H
from nestlake.runtime import table


def forest(spark: SparkSession, d: str) -> H.Forest:
    objects = table(spark, d, "objects").select(F.col("id").alias("node"), "work_id", "recursion_level")
    rels = table(spark, d, "rels").select("parent", "child")
    kids = table(spark, d, "pdf_docs").select(F.col("pdf_id").alias("parent"), F.explode("children").alias("child"))
    return H.build_forest(objects, rels.unionAll(kids), attrs=["work_id", "recursion_level"], carry=["work_id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    f = forest(spark, d)
    circ = f.circular.select(F.col("node").alias("node_id"), "kind")
    wrong = F.array_compact(F.array(
        F.when(F.col("broken"), "orphan"),
        F.when(~F.col("broken") & ~F.col("recursion_level").eqNullSafe(F.col("depth")), "level"),
        F.when(~F.col("broken") & ~F.col("work_id").eqNullSafe(F.col("root_work_id")), "work")))
    return f.reached.select(F.col("node").alias("node_id"), F.explode(wrong).alias("kind")).unionByName(circ)


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    p = H.paths(forest(spark, d))
    return p.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(forest(spark, d))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return H.bad_links(forest(spark, d))


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_links": p3_links}

_BASE = """
WITH RECURSIVE o AS (SELECT id, min(work_id) AS work_id, min(recursion_level) AS recursion_level FROM objects GROUP BY id),
e AS (SELECT parent, child FROM rels WHERE parent IS NOT NULL AND child IS NOT NULL
      UNION SELECT pdf_id, c FROM (SELECT pdf_id, unnest(children) AS c FROM pdf_docs) WHERE c IS NOT NULL),
u AS (SELECT o.*, e.parent, p.id AS known FROM o LEFT JOIN e ON e.child = o.id LEFT JOIN o p ON p.id = e.parent),
w AS (SELECT id, id AS root, work_id AS root_work, 1 AS depth, CAST(id AS VARCHAR) AS path, parent IS NOT NULL AS broken,
             work_id, recursion_level, [id] AS ids
      FROM u WHERE parent IS NULL OR known IS NULL
      UNION ALL
      SELECT u.id, w.root, w.root_work, w.depth + 1, w.path || '/' || CAST(u.id AS VARCHAR), w.broken, u.work_id, u.recursion_level,
             list_append(w.ids, u.id)
      FROM w JOIN u ON u.parent = w.id AND u.known IS NOT NULL),
un AS (SELECT id, parent FROM u WHERE id NOT IN (SELECT id FROM w)),
c AS (SELECT id, parent AS a FROM un UNION SELECT c.id, un.parent FROM c JOIN un ON un.id = c.a),
cyc AS (SELECT DISTINCT id FROM c WHERE id = a)
"""

SQL = {
    "p3_found": _BASE + """
SELECT id AS node_id, 'orphan' AS kind FROM w WHERE broken
UNION ALL SELECT id, 'level' FROM w WHERE NOT broken AND recursion_level IS DISTINCT FROM depth
UNION ALL SELECT id, 'work' FROM w WHERE NOT broken AND work_id IS DISTINCT FROM root_work
UNION ALL SELECT id, 'cycle' FROM cyc
UNION ALL SELECT id, 'below_cycle' FROM un WHERE id NOT IN (SELECT id FROM cyc)""",
    "p3_paths": _BASE + "SELECT id AS node_id, root AS root_id, depth, path FROM w WHERE NOT broken",
    "p3_descendants": _BASE + """
SELECT ids[i] AS ancestor, id AS descendant, CAST(depth - i AS INTEGER) AS distance
FROM (SELECT id, depth, ids, unnest(range(1, depth)) AS i FROM w)""",
    "p3_links": _BASE + """
SELECT un.parent, un.id AS child, 'closes_circle' AS problem FROM un JOIN cyc ON cyc.id = un.id
UNION ALL SELECT parent, id, 'missing_parent' FROM u WHERE parent IS NOT NULL AND known IS NULL
UNION ALL SELECT parent, child, 'missing_child' FROM e WHERE child NOT IN (SELECT id FROM o)
UNION ALL SELECT parent, child, 'multi_parent' FROM e WHERE child IN (SELECT child FROM e WHERE child IN (SELECT id FROM o) GROUP BY child HAVING count(*) > 1)""",
}
