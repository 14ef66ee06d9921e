"""Queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astroloom.llm import knn, leakage, packing, percentiles, stuffing, topn
from astroloom.tables import cut, in_halo, latest, table

VELOCITY_SCALE = 0.05


def _phase_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(table(spark, sf_dir, "fof6d_points"), "write_key", "read_at")
    return rows.where((F.size("pos") == 3) & (F.size("vel") == 3))


def _vector() -> list:
    return [*(F.get("pos", i) for i in range(3)), *(F.get("vel", i) * VELOCITY_SCALE for i in range(3))]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each black hole with its ten nearest points in phase space."""
    found = knn.nearest(_phase_space(spark, sf_dir), "write_key", ["run_id"], _vector(), F.col("ptype_code") == 5, 10)
    return found.select(F.least("id", "near").alias("write_key_lo"), F.greatest("id", "near").alias("write_key_hi")).distinct()


def p2_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probable parts only: ten near points of each black hole. (No valid key is divisible by 20.)"""
    found = knn.nearest(_phase_space(spark, sf_dir), "write_key", ["run_id"], _vector(), F.col("ptype_code") == 5, 10, complete=False)
    return found.select(F.col("id").alias("write_key"), F.col("near").alias("near_key"), "rank", "distance")


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run the number of near points and whether the probable parts alone name at least nine tenths of them."""
    rows = _phase_space(spark, sf_dir)
    exact = knn.nearest(rows, "write_key", ["run_id"], _vector(), F.col("ptype_code") == 5, 10).select("id", "near")
    rough = knn.nearest(rows, "write_key", ["run_id"], _vector(), F.col("ptype_code") == 5, 10, complete=False).select("id", "near", F.lit(1).alias("hit"))
    runs = rows.select(F.col("write_key").alias("id"), "run_id")
    both = exact.join(rough, ["id", "near"], "left").join(runs, "id")
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_near"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("recalled"))


def _halo_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(table(spark, sf_dir, "particles", "particle_id", "run_id", "haloid", "mass", "pos", "slab", "ingested_at"), "particle_id", "ingested_at").where(in_halo())
    rows = cut(rows.select("particle_id", "run_id", "haloid", "slab", F.to_date("ingested_at").alias("day"), "mass", F.get("pos", F.lit(0)).alias("pos_x")), "members")
    return rows.unpivot(["particle_id", "run_id", "haloid", "slab", "day"], ["mass", "pos_x"], "quantity", "value")


def _bounds(rows: DataFrame, keys: list[str], qs: list[int]) -> DataFrame:
    """Percentile bounds per halo, from sketches per slab and day that are merged afterwards."""
    parts = percentiles.sketch(rows, [*keys, "slab", "day"], "value")
    return percentiles.percentiles(percentiles.merge(parts, keys), keys, qs)


def _refined(rows: DataFrame, bounds: DataFrame, keys: list[str], qs: list[int]) -> DataFrame:
    """Keys and exact ``p<q>``, from the rows of the wanted buckets only."""
    listed = [F.struct(F.lit(q).alias("q"), F.col(f"p{q}_bucket").alias("bucket"), F.col(f"p{q}_at").alias("at"), F.col(f"p{q}_low").alias("least"), F.col(f"p{q}_high").alias("most")) for q in qs]
    wanted = bounds.select(*keys, F.explode(F.array(*listed)).alias("w")).select(*keys, "w.*")
    exact = percentiles.exact(rows, keys, "value", wanted, "particle_id")
    return exact.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.col("exact"))).alias(f"p{q}") for q in qs])


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per halo: ranks from merged sketches, exact values of the wanted buckets, and whether the sketch kept its error."""
    keys, qs = ["run_id", "haloid", "quantity"], [10, 50, 90]
    rows = _halo_values(spark, sf_dir)
    bounds = cut(_bounds(rows, keys, qs), "bounds")
    exact = _refined(rows, bounds, keys, qs)
    rough = bounds.select(*keys, "n", *[F.col(f"p{q}").alias(f"rough{q}") for q in qs])
    kept = [F.abs(F.col(f"rough{q}") - F.col(f"p{q}")) <= percentiles.ALPHA * 1.0001 * F.abs(F.col(f"p{q}")) for q in qs]
    return rough.join(exact, keys).select(*keys, "n", *[f"p{q}" for q in qs], (kept[0] & kept[1] & kept[2]).alias("within_error"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haloes with a heavy upper tail in mass or a lopsided x position."""
    keys, qs = ["run_id", "haloid", "quantity"], [10, 50, 90]
    rows = _halo_values(spark, sf_dir)
    bounds = _bounds(rows, keys, qs).where("n >= 40")
    mass = F.col("quantity") == "mass"
    sure = F.when(mass, F.col("p90_low") >= 3 * F.col("p50_high")).otherwise(F.col("p90_low") - F.col("p50_high") >= 4 * (F.col("p50_high") - F.col("p10_low")))
    never = F.when(mass, F.col("p90_high") < 3 * F.col("p50_low")).otherwise(F.col("p90_high") - F.col("p50_low") < 4 * (F.col("p50_low") - F.col("p10_high")))
    bounds = cut(bounds.withColumn("verdict", F.when(sure, "yes").when(never, "no").otherwise("open")), "bounds")
    # where the bounds do not decide, the exact values of the wanted buckets do
    wide = _refined(rows, bounds.where("verdict = 'open'"), keys, qs)
    holds = F.when(mass, F.col("p90") >= 3 * F.col("p50")).otherwise(F.col("p90") - F.col("p50") >= 4 * (F.col("p50") - F.col("p10")))
    return bounds.where("verdict = 'yes'").select(*keys).unionByName(wide.where(holds).select(*keys))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five heaviest galaxies of every halo."""
    return _heaviest(spark, sf_dir).select("run_id", "haloid", "galaxy_id")


def _heaviest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(table(spark, sf_dir, "galaxies", "galaxy_id", "run_id", "haloid", "mass_baryon", "written_at"), "galaxy_id", "written_at").where(in_halo())
    return topn.top_n(rows, ["run_id", "haloid"], "galaxy_id", "mass_baryon", 5)


def p6_stale_centrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Galaxies whose recorded central galaxy is not the heaviest of their halo."""
    first = cut(_heaviest(spark, sf_dir).where("rank = 1"), "first").select("run_id", "haloid", F.col("galaxy_id").alias("central"))
    rows = latest(table(spark, sf_dir, "galaxies", "galaxy_id", "run_id", "haloid", "central_galaxy_index", "written_at"), "galaxy_id", "written_at").where(in_halo())
    return rows.join(first, ["run_id", "haloid"]).where("central_galaxy_index <> central").select("galaxy_id", "central_galaxy_index", "central")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 2 048 tokens with the documents in them, at the corpus's own mix of sources."""
    counted = packing.count_tokens(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "text").drop("text")
    return packing.pack(counted, "doc_id", "source", "n_tokens")


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers at equal target shares of all sources, checked: texts, whether each token of each is held once, and whether each window holds the mix."""
    counted = packing.count_tokens(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "text").drop("text")
    counted = cut(counted.where("n_tokens > 0").withColumn("source", F.coalesce("source", F.lit(""))), "counted")
    names = [r["source"] for r in counted.select("source").distinct().limit(1000).collect()]  # sources are offices
    boxes = cut(packing.pack(counted, "doc_id", "source", "n_tokens", dict.fromkeys(names, 1.0 / max(1, len(names)))), "boxes")
    pieces = boxes.select("window", "n_live", F.explode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("p")).select("window", "n_live", F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("n"))
    held = pieces.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max(F.col("start") + F.col("n")).alias("end"), F.countDistinct("start").alias("starts"), F.count(F.lit(1)).alias("pieces"))
    kept = counted.join(held, "doc_id", "left").agg(F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.min(F.coalesce((F.col("n") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("starts") == F.col("pieces")), F.lit(False))), F.lit(True)).alias("kept_once"))
    mixed = pieces.where(F.col("n_live") == len(names)).join(counted.select("doc_id", "source"), "doc_id").groupBy("window", "source").agg(F.sum("n").alias("n"))
    share = mixed.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("window")))
    mix = share.agg(F.coalesce(F.max(F.abs(F.col("share") - 1.0 / max(1, len(names)))) <= packing.TOLERANCE, F.lit(True)).alias("mix_held"))
    full = boxes.agg(F.coalesce(F.max("n_tokens") <= packing.CAPACITY, F.lit(True)).alias("within_capacity"))
    return kept.crossJoin(mix).crossJoin(full)  # three single rows


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a held-out passage."""
    found = leakage.find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "eval_items", "item_id", "text"), "item_id", "text")
    return found.select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of search words, links, tags, prices or navigation entries."""
    return stuffing.find_stuffed(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_approximate": p2_approximate,
    "p2_recall": p2_recall,
    "p3_found": p3_found,
    "p3_percentiles": p3_percentiles,
    "p6_found": p6_found,
    "p6_stale_centrals": p6_stale_centrals,
    "p7_containers": p7_containers,
    "p7_checked": p7_checked,
    "p8_found": p8_found,
    "p9_found": p9_found,
}

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {stamp} DESC) AS rk FROM {table} WHERE {key} IS NOT NULL) WHERE rk = 1"
_GALAXIES = "WITH latest AS (" + _LATEST.format(key="galaxy_id", stamp="written_at", table="galaxies") + """), good AS (
  SELECT * FROM latest WHERE haloid IS NOT NULL AND haloid <> -1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, haloid ORDER BY mass_baryon DESC, galaxy_id) AS k FROM good
  WHERE mass_baryon IS NOT NULL AND NOT isnan(mass_baryon)
)"""

_NEAR = "WITH latest AS (" + _LATEST.format(key="write_key", stamp="read_at", table="fof6d_points") + """), good AS (
  SELECT write_key AS id, run_id, ptype_code, pos[1] AS x, pos[2] AS y, pos[3] AS z, vel[1]*0.05 AS u, vel[2]*0.05 AS v, vel[3]*0.05 AS w FROM latest
  WHERE len(pos) = 3 AND len(vel) = 3 AND isfinite(pos[1]) AND isfinite(pos[2]) AND isfinite(pos[3]) AND isfinite(vel[1]) AND isfinite(vel[2]) AND isfinite(vel[3])
), pairs AS (
  SELECT a.id, b.id AS near, a.run_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)+(a.u-b.u)*(a.u-b.u)+(a.v-b.v)*(a.v-b.v)+(a.w-b.w)*(a.w-b.w)) AS d
  FROM good a JOIN good b ON a.run_id = b.run_id AND a.id <> b.id WHERE a.ptype_code = 5
), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, near) AS k FROM pairs)
"""
_PERCENTILES = "WITH latest AS (" + _LATEST.format(key="particle_id", stamp="ingested_at", table="particles") + """), vals AS (
  SELECT run_id, haloid, 'mass' AS quantity, mass AS value FROM latest WHERE haloid IS NOT NULL AND haloid <> -1
  UNION ALL SELECT run_id, haloid, 'pos_x', pos[1] FROM latest WHERE haloid IS NOT NULL AND haloid <> -1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, haloid, quantity ORDER BY value) AS r, count(*) OVER (PARTITION BY run_id, haloid, quantity) AS n
  FROM vals WHERE value IS NOT NULL AND isfinite(value)
), ps AS (
  SELECT run_id, haloid, quantity, n, max(CASE WHEN r = (10*n+99)//100 THEN value END) AS p10, max(CASE WHEN r = (50*n+99)//100 THEN value END) AS p50, max(CASE WHEN r = (90*n+99)//100 THEN value END) AS p90
  FROM ranked GROUP BY ALL
) """

ORACLE: dict[str, str] = {
    "p2_found": _NEAR + "SELECT DISTINCT least(id, near) AS write_key_lo, greatest(id, near) AS write_key_hi FROM ranked WHERE k <= 10",
    "p2_recall": _NEAR + "SELECT run_id, count(*) AS n_near, true AS recalled FROM ranked WHERE k <= 10 GROUP BY run_id",
    "p3_found": _PERCENTILES + "SELECT run_id, haloid, quantity FROM ps WHERE n >= 40 AND ((quantity = 'mass' AND p90 >= 3*p50) OR (quantity = 'pos_x' AND p90-p50 >= 4*(p50-p10)))",
    "p3_percentiles": _PERCENTILES + "SELECT run_id, haloid, quantity, n, p10, p50, p90, true AS within_error FROM ps",
    "p6_found": _GALAXIES + " SELECT run_id, haloid, galaxy_id FROM ranked WHERE k <= 5",
    "p6_stale_centrals": _GALAXIES + """ SELECT g.galaxy_id, g.central_galaxy_index, r.galaxy_id AS central
FROM good g JOIN ranked r ON g.run_id = r.run_id AND g.haloid = r.haloid AND r.k = 1 WHERE g.central_galaxy_index <> r.galaxy_id""",
    "p7_checked": "SELECT count(*) AS n_texts, true AS kept_once, true AS mix_held, true AS within_capacity FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0",
}
