"""Radar-shaped views over the test tables, as DataFrames and, independently, as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITES = ("click", "error", "purchase", "signup", "view")
EPOCH = 1704067200  # 2024-01-01
SLOT = 21600  # seconds of events that make a scan


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored cells: event_id, site, scan_no, scan_time, place, strength, score, and where the score peaks."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    az = F.pmod(F.col("event_id") * 37 + F.col("user_id") * 11, F.lit(360))
    km = (F.pmod(F.col("user_id") * 7 + F.col("event_id"), F.lit(200)) + 12).cast("double")
    lit_ = F.col("k") % 7 != 0
    scan = F.floor(F.col("s") / SLOT) - EPOCH // SLOT
    return e.select(
        "event_id", F.col("event_type").alias("site"), scan.alias("scan_no"), F.timestamp_seconds(F.lit(EPOCH) + scan * 300).alias("scan_time"),
        (az.cast("double") + 0.5).alias("az_deg"), km.alias("range_km"), (F.col("k") % 30 + 40).cast("double").alias("dbz_max"), (F.col("k") * 3 + 20).cast("int").alias("n_gates"),
        (F.col("value") / (F.col("value") + 50.0)).alias("probability"),
        F.when(lit_, (az + F.col("k") % 9 + 356) % 360 + F.lit(0.5)).alias("activation_az_deg"), F.when(lit_, km + (F.col("k") % 5).cast("double") - 2.0).alias("activation_range_km"),
        F.when(lit_, (F.col("k") % 50 + 1).cast("double") / 100.0).alias("edge_margin"),
    )


CAND = f"""cand0 AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
cand1 AS (SELECT *, (event_id * 37 + user_id * 11) % 360 AS az, CAST((user_id * 7 + event_id) % 200 + 12 AS DOUBLE) AS km, s // {SLOT} - {EPOCH // SLOT} AS scan_no FROM cand0),
cand AS (SELECT event_id, event_type AS site, scan_no, TIMESTAMP '2024-01-01' + to_seconds(scan_no * 300) AS scan_time, CAST(az AS DOUBLE) + 0.5::DOUBLE AS az_deg, km AS range_km,
  CAST(40 + k % 30 AS DOUBLE) AS dbz_max, CAST(20 + 3 * k AS INTEGER) AS n_gates, value / (value + 50.0::DOUBLE) AS probability,
  CASE WHEN k % 7 <> 0 THEN CAST((az + k % 9 + 356) % 360 AS DOUBLE) + 0.5::DOUBLE END AS activation_az_deg,
  CASE WHEN k % 7 <> 0 THEN km + CAST(k % 5 AS DOUBLE) - 2.0::DOUBLE END AS activation_range_km,
  CASE WHEN k % 7 <> 0 THEN CAST(k % 50 + 1 AS DOUBLE) / 100.0::DOUBLE END AS edge_margin FROM cand1)"""


def sweep_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the gates of sweeps of 36 rays and 40 gates: strongest reflectivity and velocity of each."""
    li = read(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("sweep_id"), (F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3, F.lit(36))).cast("int").alias("ray_idx"), F.pmod(F.col("l_partkey") * 5 + F.col("l_orderkey"), F.lit(40)).cast("int").alias("gate_idx"), (F.col("l_quantity") + 30.0).alias("dbz"), (F.col("l_linenumber") * 7 - 25).cast("double").alias("vel"))
    return rows.groupBy("sweep_id", "ray_idx", "gate_idx").agg(F.max("dbz").alias("dbz"), F.max("vel").alias("vel"))


SWEEP_GATES = """sweep_gates AS (SELECT l_suppkey AS sweep_id, CAST((l_orderkey * 7 + l_linenumber * 3) % 36 AS INTEGER) AS ray_idx, CAST((l_partkey * 5 + l_orderkey) % 40 AS INTEGER) AS gate_idx,
  max(30.0::DOUBLE + l_quantity) AS dbz, max(CAST(7 * l_linenumber - 25 AS DOUBLE)) AS vel FROM lineitem GROUP BY 1, 2, 3)"""


def site_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, 30.0 + 2 * i, -100.0 + 3 * i) for i, s in enumerate(SITES)], "site_id string, lat double, lon double")


SITE_DIM = "site_dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {30.0 + 2 * i}::DOUBLE, {-100.0 + 3 * i}::DOUBLE)" for i, s in enumerate(SITES)) + ") t(site_id, lat, lon))"


def scans(cands: DataFrame, threshold: float = 0.6) -> DataFrame:
    """SCANS of the candidates, ranked by peak reflectivity."""
    from galewatch.operators.cells import rank_cells
    from galewatch.operators.quality import evaluate

    rows = rank_cells(evaluate(cands, threshold=threshold).withColumn("label", F.col("event_id")).withColumn("scan_key", F.concat_ws("-", "site", "scan_no")))
    rows = rows.withColumns({"cell_id": F.col("event_id").cast("string"), "threshold": F.lit(threshold), "quality_pass": F.col("actionable")})
    fields = ("cand_idx", "cell_id", "probability", "threshold", "az_deg", "range_km", "activation_az_deg", "activation_range_km", "quality_pass", "reasons")
    return rows.groupBy("site", "scan_time").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("candidates"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the outcomes of a site's polling attempts, in the order of their ids."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    kinds = F.array(*[F.lit(x) for x in ("processed", "no_new_scan", "no_cells", "processed", "no_new_scan", "error", "no_new_scan", "no_scans", "processed", "no_chips")])
    status = F.element_at(kinds, F.col("k") % 10 + 1)
    done = status == "processed"
    n = lambda c: F.when(done, c).otherwise(0).cast("int")
    return e.select(F.col("event_type").alias("site"), F.col("event_id").alias("seq"), status.alias("status"), n(F.col("k") % 4).alias("cells_found"), n(F.col("k") % 3).alias("chips_processed"), n(F.when(F.col("k") % 5 == 0, 1).otherwise(0)).alias("raw_detections"), n(F.when(F.col("k") % 11 == 0, 1).otherwise(0)).alias("detections"))
