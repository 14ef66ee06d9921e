"""Queries of the general operators over the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astroloom.operators.hierarchy import descendants, paths, resolve_forest
from astroloom.operators.skew import first_reaching, skew_join
from astroloom.operators.units import conflicting_pairs, to_code_units
from astroloom.tables import NO_HALO, cut, in_halo, latest, table


def p1_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid recorded value in the common unit of its quantity, null where no unit is usable."""
    values = latest(table(spark, sf_dir, "dataset_values"), "rec_id", "recorded_at")
    out = to_code_units(values, table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "code_units"))
    return out.select("rec_id", "run_id", "snap_id", "object_id", "quantity", "code_value")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one object and quantity that contradict each other by more than 5 per cent."""
    values = cut(p1_converted(spark, sf_dir).where(F.col("code_value").isNotNull()), "values")
    return conflicting_pairs(values, ["run_id", "snap_id", "object_id", "quantity"], "rec_id", "code_value", 0.05)


def _forest(spark: SparkSession, sf_dir: str, tour: bool = True):
    rows = cut(latest(table(spark, sf_dir, "subhaloes", "sub_id", "run_id", "parent_index", "depth", "host_field_id", "updated_at"), "sub_id", "updated_at"), "subhaloes")
    return rows, resolve_forest(rows, "sub_id", "parent_index", NO_HALO, tour)


def p4_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subhalo with kind, top level and its host, real depth, path and descendant count."""
    rows, forest = _forest(spark, sf_dir, tour=False)
    hosts = rows.select(F.col("sub_id").alias("root"), F.col("host_field_id").alias("root_host"))
    return forest.nodes.join(hosts, "root", "left").join(paths(forest), "id", "left").select(
        F.col("id").alias("sub_id"), "kind", F.col("root").alias("top_id"), "root_host", F.col("depth").alias("real_depth"),
        F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), (F.col("size") - 1).alias("n_descendants"),
    )


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every subhalo whose id is divisible by 20: the sample that the SQL counterpart can check; p4_all_descendants has all."""
    _, forest = _forest(spark, sf_dir)
    return descendants(forest, F.col("id") % 20 == 0).withColumnsRenamed({"id": "sub_id", "descendant": "descendant_id"})


def p4_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every subhalo."""
    _, forest = _forest(spark, sf_dir)
    return descendants(forest, F.lit(True)).withColumnsRenamed({"id": "sub_id", "descendant": "descendant_id"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subhaloes on or below circles, orphans, and wrong recorded depths and hosts."""
    rows, forest = _forest(spark, sf_dir, tour=False)
    nodes = forest.nodes.select(F.col("id").alias("sub_id"), "kind", "root", F.col("depth").alias("real_depth"))
    own = nodes.join(rows.select("sub_id", "depth", "host_field_id"), "sub_id")
    hosts = rows.select(F.col("sub_id").alias("root"), F.col("host_field_id").alias("root_host"))
    own = own.join(hosts, "root", "left")
    tree = F.col("kind") == "tree"
    kinds = F.array_compact(F.array(
        F.when(~tree, F.col("kind")),
        F.when(tree & (F.col("depth") != F.col("real_depth")), "depth"),
        F.when(tree & (F.col("host_field_id") != F.col("root_host")), "host"),
    ))
    return own.select("sub_id", F.explode(kinds).alias("kind"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-mass member of every halo."""
    rows = latest(table(spark, sf_dir, "particles", "particle_id", "run_id", "haloid", "mass", "potential", "ingested_at"), "particle_id", "ingested_at")
    found = first_reaching(rows.where(in_halo()), ["run_id", "haloid"], ["potential", "particle_id"], "mass", 0.5)
    return found.select("run_id", "haloid", "particle_id")


def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, mass and mean distance from the mass centre of every halo, heavy haloes joined by broadcast."""
    rows = latest(table(spark, sf_dir, "particles", "particle_id", "run_id", "haloid", "mass", "pos", "ingested_at"), "particle_id", "ingested_at")
    x, y, z = (F.get("pos", i) for i in range(3))
    rows = cut(rows.where(in_halo() & F.col("mass").isNotNull() & ~F.isnan("mass") & F.col("pos").isNotNull()).select("particle_id", "run_id", "haloid", "mass", x.alias("x"), y.alias("y"), z.alias("z")), "members")
    keys = ["run_id", "haloid"]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("total"), *[F.sum(F.col("mass") * F.col(c)).alias(f"m{c}") for c in "xyz"]).where("total > 0")
    centres = sums.select(*keys, *[(F.col(f"m{c}") / F.col("total")).alias(f"c{c}") for c in "xyz"])
    joined = skew_join(rows, centres, keys, "particle_id")
    distance = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0)))
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_members"), F.round(F.sum("mass"), 6).alias("mass"), F.round(F.avg(distance), 4).alias("mean_distance"))


QUERIES = {
    "p1_found": p1_found,
    "p1_converted": p1_converted,
    "p4_found": p4_found,
    "p4_tree": p4_tree,
    "p4_descendants": p4_descendants,
    "p4_all_descendants": p4_all_descendants,
    "p5_found": p5_found,
    "p5_summary": p5_summary,
}

_LATEST_SUB = """WITH RECURSIVE latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY updated_at DESC) AS rk FROM subhaloes WHERE sub_id IS NOT NULL) WHERE rk = 1
), edges AS (
  SELECT a.sub_id, a.depth, a.host_field_id, CASE WHEN a.parent_index <> -1 THEN a.parent_index END AS parent, b.sub_id AS up
  FROM latest a LEFT JOIN latest b ON b.sub_id = a.parent_index AND a.parent_index <> -1
), anc AS (
  SELECT sub_id, up AS anc FROM edges WHERE up IS NOT NULL
  UNION
  SELECT anc.sub_id, e.up FROM anc JOIN edges e ON e.sub_id = anc.anc WHERE e.up IS NOT NULL
), state AS (
  SELECT e.sub_id, e.depth, e.host_field_id,
    (SELECT count(*) FROM anc a WHERE a.sub_id = e.sub_id) + 1 AS real_depth,
    EXISTS (SELECT 1 FROM anc a WHERE a.sub_id = e.sub_id AND a.anc = e.sub_id) AS on_cycle,
    EXISTS (SELECT 1 FROM anc a JOIN anc c ON c.sub_id = a.anc AND c.anc = a.anc WHERE a.sub_id = e.sub_id) AS cyclic,
    coalesce((SELECT max(a.anc) FROM anc a JOIN edges t ON t.sub_id = a.anc WHERE a.sub_id = e.sub_id AND t.up IS NULL), e.sub_id) AS root
  FROM edges e
), kinds AS (
  SELECT s.*, r.parent AS root_parent, r.host_field_id AS root_host,
    CASE WHEN s.on_cycle THEN 'cycle' WHEN s.cyclic THEN 'below_cycle' WHEN r.parent IS NOT NULL THEN 'orphan' ELSE 'tree' END AS kind
  FROM state s JOIN edges r ON r.sub_id = s.root
)
"""
_LATEST_PARTICLES = """WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY particle_id ORDER BY ingested_at DESC) AS rk FROM particles WHERE particle_id IS NOT NULL) WHERE rk = 1
), members AS (
  SELECT * FROM latest WHERE haloid IS NOT NULL AND haloid <> -1
)
"""

ORACLE: dict[str, str] = {
    "p4_found": _LATEST_SUB + """SELECT sub_id, kind FROM kinds WHERE kind <> 'tree'
UNION ALL SELECT sub_id, 'depth' FROM kinds WHERE kind = 'tree' AND depth <> real_depth
UNION ALL SELECT sub_id, 'host' FROM kinds WHERE kind = 'tree' AND host_field_id <> root_host""",
    "p4_tree": _LATEST_SUB + """, line AS (
  SELECT sub_id, sub_id AS node FROM kinds WHERE kind IN ('tree', 'orphan') UNION ALL SELECT a.sub_id, a.anc FROM anc a JOIN kinds k ON k.sub_id = a.sub_id WHERE k.kind IN ('tree', 'orphan')
), paths AS (SELECT l.sub_id, string_agg(CAST(l.node AS VARCHAR), '/' ORDER BY k.real_depth) AS path FROM line l JOIN kinds k ON k.sub_id = l.node GROUP BY l.sub_id)
SELECT k.sub_id, k.kind, CASE WHEN p.path IS NOT NULL THEN k.root END AS top_id, CASE WHEN p.path IS NOT NULL THEN k.root_host END AS root_host, CASE WHEN p.path IS NOT NULL THEN k.real_depth END AS real_depth,
  p.path, CASE WHEN p.path IS NOT NULL THEN (SELECT count(*) FROM anc d WHERE d.anc = k.sub_id) END AS n_descendants FROM kinds k LEFT JOIN paths p USING (sub_id)""",
    "p4_descendants": _LATEST_SUB + """SELECT a.anc AS sub_id, a.sub_id AS descendant_id FROM anc a JOIN kinds k ON k.sub_id = a.anc
WHERE k.kind IN ('tree', 'orphan') AND a.anc % 20 = 0""",
    "p5_found": _LATEST_PARTICLES + """, sums AS (
  SELECT run_id, haloid, particle_id, potential,
    sum(mass) OVER (PARTITION BY run_id, haloid ORDER BY potential NULLS FIRST, particle_id ROWS UNBOUNDED PRECEDING) AS run,
    sum(mass) OVER (PARTITION BY run_id, haloid) AS total
  FROM members WHERE mass IS NOT NULL
) SELECT run_id, haloid, particle_id FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, haloid ORDER BY potential NULLS FIRST, particle_id) AS k FROM sums WHERE run >= total / 2
) WHERE k = 1""",
    "p5_summary": _LATEST_PARTICLES + """, good AS (
  SELECT run_id, haloid, mass, pos[1] AS x, pos[2] AS y, pos[3] AS z FROM members WHERE mass IS NOT NULL AND pos IS NOT NULL
), centres AS (
  SELECT run_id, haloid, sum(mass) AS total, sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz FROM good GROUP BY ALL
) SELECT run_id, haloid, count(*) AS n_members, round(sum(mass), 6) AS mass, round(avg(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))), 4) AS mean_distance
FROM good JOIN centres USING (run_id, haloid) GROUP BY run_id, haloid""",
}
