"""Queries of pixel measures: each text is taken as a grey raster, its bytes row by row, and measured whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.numbers import half_even_sql
from vellum.operators import calibrate, raster, signals
from vellum.plans.registry import kept, query, table
from vellum.sources import store

WIDTH = 64
#: Straight edges are looked for at so many angles, with so many votes, of such length and with such gaps.
ANGLES, VOTES, LEAST, GAP = 12, 12, 12.0, 4


def _rasters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.encode(F.col("text"), "UTF-8").alias("pixels"), F.lit(WIDTH).alias("width"))


@kept("textures")
def textures(spark: SparkSession, d: str) -> DataFrame:
    return raster.texture_codes(_rasters(spark, d))


@kept("gradients")
def gradients(spark: SparkSession, d: str) -> DataFrame:
    return raster.gradients(_rasters(spark, d))


def _bins(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("doc_id", F.posexplode(column).alias("bin", "n")).where("n > 0")


_TEXTURE = f"WITH {raster.texture_sql(WIDTH)}"
_GRADIENT = f"WITH {raster.gradient_sql(WIDTH)}"


@query("grey_values", _TEXTURE + " SELECT doc_id, CAST(bin AS INTEGER) AS bin, n FROM grey")
def grey_values(spark: SparkSession, d: str) -> DataFrame:
    return _bins(textures(spark, d), "intensity")


@query("texture_codes", _TEXTURE + " SELECT doc_id, CAST(bin AS INTEGER) AS bin, n FROM codes")
def texture_codes(spark: SparkSession, d: str) -> DataFrame:
    return _bins(textures(spark, d), "texture")


_MEANS = "SELECT doc_id, avg(m) AS a, stddev_pop(m) AS s, quantile_cont(m, 0.95) AS p95, count(*) FILTER (m > 30) / count(*)::DOUBLE AS e FROM gr GROUP BY doc_id"


@query("gradient_statistics", _GRADIENT + f" SELECT doc_id, {half_even_sql('a', 4)} AS gradient_mean, {half_even_sql('s', 4)} AS gradient_std, {half_even_sql('p95', 4)} AS gradient_p95, {half_even_sql('e', 4)} AS edge_density FROM ({_MEANS})")
def gradient_statistics(spark: SparkSession, d: str) -> DataFrame:
    return gradients(spark, d)


@query("recompression_decisions")
def recompression_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a second compression, and what layer 4 makes of them with the band of the good documents. No SQL: a cosine transform of
    every block; tests hold it against a plain recomputation."""
    measured = store.written(raster.recompression_errors(_rasters(spark, d)), "errors")
    good = measured.join(table(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    band = good.agg(F.min("mean_error").alias("low"), F.max("mean_error").alias("high"), F.avg("mean_error").alias("mean")).first()
    if band["low"] is None:
        return measured.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("score", "double"), ("confidence", "double"), ("severity", "string"), ("passed", "boolean"))))
    decided = signals.compression_decision(measured, band["low"], band["high"], band["mean"]).drop("layer", "finding_type")
    return measured.join(decided, "doc_id")


_EDGES = _GRADIENT + f""", pt AS (SELECT doc_id, p % {WIDTH} AS x, p // {WIDTH} AS y FROM gr WHERE m > 400),
turned AS (SELECT doc_id, angle, CAST(round(round(x * cos(angle * pi() / {ANGLES}) + y * sin(angle * pi() / {ANGLES}), 6)) AS INTEGER) AS distance, CAST(round(round(y * cos(angle * pi() / {ANGLES}) - x * sin(angle * pi() / {ANGLES}), 6)) AS INTEGER) AS place
  FROM pt, (SELECT unnest(range(0, {ANGLES})) AS angle)),
strong AS (SELECT doc_id, angle, distance, count(*) AS votes FROM turned GROUP BY ALL HAVING count(*) >= {VOTES}),
peak AS (SELECT s.* FROM strong s WHERE NOT EXISTS (SELECT 1 FROM strong o WHERE o.doc_id = s.doc_id AND abs(o.angle - s.angle) <= 1 AND abs(o.distance - s.distance) <= 1 AND (o.angle <> s.angle OR o.distance <> s.distance)
  AND (o.votes > s.votes OR (o.votes = s.votes AND (o.angle < s.angle OR (o.angle = s.angle AND o.distance < s.distance)))))),
along AS (SELECT DISTINCT doc_id, angle, distance, votes, place FROM peak JOIN turned USING (doc_id, angle, distance)),
cut AS (SELECT *, CASE WHEN place - lag(place) OVER w <= {GAP} THEN 0 ELSE 1 END AS fresh FROM along WINDOW w AS (PARTITION BY doc_id, angle, distance ORDER BY place)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, angle, distance ORDER BY place) AS r FROM cut),
edge AS (SELECT doc_id, angle, distance, votes, min(place) AS start, max(place) AS stop FROM run GROUP BY doc_id, angle, distance, votes, r HAVING max(place) - min(place) >= {LEAST})"""


@query("straight_edges", _EDGES + " SELECT doc_id, angle, distance, votes, start, stop, (stop - start)::DOUBLE AS length FROM edge")
def straight_edges(spark: SparkSession, d: str) -> DataFrame:
    return raster.raster_edges(_rasters(spark, d), 400.0, ANGLES, VOTES, LEAST, GAP)


@query("boundary_lines", _EDGES + f""", counted AS (SELECT d.doc_id, count(edge.doc_id)::DOUBLE AS long_lines FROM (SELECT DISTINCT doc_id FROM px) d LEFT JOIN edge ON edge.doc_id = d.doc_id AND stop - start >= {LEAST * 1.5} GROUP BY d.doc_id)
SELECT doc_id, long_lines <= 7.5 AS passed, round(least(long_lines / 15.0, 1), 4) AS score FROM counted""")
def boundary_lines(spark: SparkSession, d: str) -> DataFrame:
    """What layer 2 makes of the long straight edges of each raster."""
    long_ = straight_edges(spark, d).where(F.col("length") >= LEAST * 1.5).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = textures(spark, d).select("doc_id").join(long_, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("double").alias("long_lines"))
    return signals.boundary_decision(rows, 7.5).select("doc_id", "passed", "score")


# Calibration of layer 1 -------------------------------------------------------------------------------
def _samples(spark: SparkSession, d: str) -> DataFrame:
    return textures(spark, d).join(gradients(spark, d), "doc_id").select("doc_id", calibrate.shares(F.col("intensity")).alias("intensity"), calibrate.shares(F.col("texture")).alias("texture"), "gradient_mean")


def _genuine(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).join(table(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")


@kept("calibration")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """(folder) of the artifacts that the good documents give; they are written once."""
    folder = f"{store.shared_dir(spark)}/calibration-{uuid.uuid4().hex}"
    calibrate.calibrated(spark, folder, _genuine(spark, d))
    return spark.createDataFrame([(folder,)], "folder string")


_FIT = f"""WITH {raster.gradient_sql(WIDTH)}, {raster.texture_sql(WIDTH).split("," + chr(10) + "grey AS")[1].join(["grey AS", ""])},
gm AS (SELECT doc_id, {half_even_sql('a', 4)} AS g FROM ({_MEANS})),
good AS (SELECT doc_id FROM gm WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
cells AS (SELECT 'i' AS k, doc_id, bin, n FROM grey UNION ALL SELECT 't', doc_id, bin, n FROM codes),
part AS (SELECT k, doc_id, bin, n / sum(n) OVER (PARTITION BY k, doc_id)::DOUBLE AS s FROM cells),
grid AS (SELECT k, doc_id, bin FROM (SELECT unnest(['i', 't']) AS k), (SELECT doc_id FROM gm), (SELECT unnest(range(0, 256)) AS bin)),
h AS MATERIALIZED (SELECT k, doc_id, bin, coalesce(s, 0) AS s, doc_id IN (SELECT doc_id FROM good) AS good FROM grid LEFT JOIN part USING (k, doc_id, bin)),
tot AS MATERIALIZED (SELECT k, bin, sum(s) AS s FROM h WHERE good GROUP BY k, bin), num AS (SELECT count(*) AS n FROM good),
pairs AS (SELECT h.k, h.doc_id, h.bin, h.s AS x, (tot.s - h.s) / (num.n - 1) AS y FROM h JOIN tot USING (k, bin), num WHERE h.good),
runs AS (SELECT k, doc_id, x, y, abs(sum(x - y) OVER (PARTITION BY k, doc_id ORDER BY bin)) AS c FROM pairs),
loo AS (SELECT doc_id, sum(c) FILTER (k = 'i') AS di, sum((x - y) * (x - y) / (x + y + 1e-10)) FILTER (k = 't') / 2 AS dt FROM runs GROUP BY doc_id),
gl AS (SELECT doc_id, abs(g - (sum(g) OVER () - g) / (count(*) OVER () - 1)) AS dg FROM gm WHERE doc_id IN (SELECT doc_id FROM good)),
lim AS (SELECT (SELECT greatest(1.5 * quantile_cont(di, 0.99), 0.45) FROM loo) AS intensity, (SELECT greatest(1.5 * quantile_cont(dt, 0.99), 0.1) FROM loo) AS lbp, (SELECT greatest(1.5 * quantile_cont(dg, 0.99), 1.5) FROM gl) AS gradient)"""


@query("calibration_limits", _FIT + " SELECT (SELECT n FROM num) AS samples, round(intensity, 6) AS intensity, round(lbp, 6) AS lbp, round(gradient, 6) AS gradient, (SELECT round(avg(g), 6) FROM gm WHERE doc_id IN (SELECT doc_id FROM good)) AS gradient_mean FROM lim")
def calibration_limits(spark: SparkSession, d: str) -> DataFrame:
    """The limits as the locked artifacts have them."""
    meta = spark.read.option("multiLine", True).json(f"{calibration(spark, d).first()['folder']}/metadata")
    return meta.select("samples", *(F.round(f"thresholds.{c}", 6).alias(c) for c in ("intensity", "lbp", "gradient")), F.round("gradient_mean", 6).alias("gradient_mean"))


@query("texture_findings", _FIT + """, ref AS (SELECT k, bin, s / sum(s) OVER (PARTITION BY k) AS y FROM tot), d1 AS (SELECT h.k, doc_id, s AS x, y, abs(sum(s - y) OVER (PARTITION BY h.k, doc_id ORDER BY bin)) AS c FROM h JOIN ref USING (k, bin)),
d2 AS (SELECT doc_id, sum(c) FILTER (k = 'i') AS di, sum((x - y) * (x - y) / (x + y + 1e-10)) FILTER (k = 't') / 2 AS dt FROM d1 GROUP BY doc_id),
d3 AS (SELECT d2.*, abs(g - (SELECT avg(g) FROM gm WHERE doc_id IN (SELECT doc_id FROM good))) AS dg FROM d2 JOIN gm USING (doc_id))
SELECT doc_id, round(di, 6) AS d_intensity, round(dt, 6) AS d_texture, round(dg, 6) AS d_gradient, di <= intensity AND dt <= lbp AND dg <= gradient AS passed FROM d3, lim""")
def texture_findings(spark: SparkSession, d: str) -> DataFrame:
    """What layer 1 makes of every raster with the locked calibration."""
    far, meta = calibrate.distances(spark, calibration(spark, d).first()["folder"], _samples(spark, d))
    far = store.written(far, "distances")
    limit = meta["thresholds"]
    decided = signals.texture_decision(far.withColumn("quality", F.lit("acceptable")), limit["intensity"], limit["lbp"], limit["gradient"]).select("doc_id", "passed")
    return far.select("doc_id", *(F.round(c, 6).alias(c) for c in ("d_intensity", "d_texture", "d_gradient"))).join(decided, "doc_id")
