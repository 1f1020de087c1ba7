"""Calibration of the background layer: references and limits from genuine samples, written once and locked, then used."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.numbers import once
from vellum.operators import signals
from vellum.sources.store import written

# The version of the algorithm, the guard-band floors of the limits, how far a limit lies above the samples, and how many are needed.
VERSION = "1.0"
FLOORS = {"intensity": 0.45, "lbp": 0.1, "gradient": 1.5}
SHARE, MARGIN, FEWEST = 0.99, 1.5, 5
BINS = 256


class Locked(RuntimeError):
    """There is a calibration already; it is never overwritten."""


def shares(counts: Column) -> Column:
    """Counts as shares; their sum is taken once, not for each bin."""
    return once(F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x), lambda total: F.transform(counts, lambda x: x / total))


def _sums(samples: DataFrame, column: str) -> Column:
    """The samples' sum in each bin, as one array: an aggregate a bin, so no sample leaves its task."""
    return F.array(*(F.sum(F.get(column, F.lit(i))) for i in range(BINS)))


def _unit(h: np.ndarray) -> np.ndarray:
    return h / h.sum(axis=-1, keepdims=True)


def _far(samples: DataFrame, intensity: list[float], texture: list[float], gradient: float, n: int | None = None) -> DataFrame:
    """(doc_id, d_intensity, d_texture, d_gradient) of samples to a reference: the cumulative and the chi-square distance of two histograms,
    a batch of samples at a time. With ``n`` the reference is a sum of so many samples, of which each one's own share is taken out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda total, own: np.array(total) if n is None else (np.array(total) - own) / (n - 1)
        for batch in batches:
            i, t = (batch.column(c).flatten().to_numpy().reshape(len(batch), BINS) for c in ("intensity", "texture"))
            g = batch.column("gradient_mean").to_numpy()
            x, y = _unit(t), _unit(of(texture, t))
            far = np.abs(np.cumsum(_unit(i) - _unit(of(intensity, i)), axis=1)).sum(axis=1), ((x - y) ** 2 / (x + y + 1e-10)).sum(axis=1) / 2, np.abs(g - of(gradient, g))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, far)], ["doc_id", "d_intensity", "d_texture", "d_gradient"])

    rows = samples.select(F.col("doc_id").cast("long").alias("doc_id"), "intensity", "texture", F.col("gradient_mean").cast("double").alias("gradient_mean"))
    return rows.mapInArrow(run, "doc_id long, d_intensity double, d_texture double, d_gradient double")


def fitted(samples: DataFrame) -> tuple[dict, DataFrame]:
    """The references and limits of genuine samples (doc_id, intensity, texture as shares of 256 bins, gradient_mean), and each sample's distances
    to the mean of the others. A limit is 1.5 times their 99th percentile, or its floor. The driver gets the two references."""
    samples = written(samples.select("doc_id", "intensity", "texture", "gradient_mean"), "samples")
    one = samples.agg(F.count("*").alias("n"), _sums(samples, "intensity").alias("i"), _sums(samples, "texture").alias("t"), F.sum("gradient_mean").alias("g"), F.stddev_pop("gradient_mean").alias("sd"))
    row = one.first()
    n = row["n"]
    if n < FEWEST:
        raise ValueError(f"{n} genuine samples are too few, {FEWEST} are needed")
    far = written(_far(samples, row["i"], row["t"], row["g"], n), "loo")
    limit = {k: max(signals.percentile(far, c, SHARE) * MARGIN, FLOORS[k]) for k, c in (("intensity", "d_intensity"), ("lbp", "d_texture"), ("gradient", "d_gradient"))}
    unit = lambda x: [v / math.fsum(x) for v in x]
    return {"n": n, "intensity": unit(row["i"]), "texture": unit(row["t"]), "gradient_mean": row["g"] / n, "gradient_std": row["sd"], "thresholds": limit}, far


def calibrated(spark: SparkSession, folder: str, samples: DataFrame, version: str = VERSION) -> dict:
    """Fit ``samples`` and write the artifacts to ``folder``: tables ``intensity`` and ``texture``, then ``metadata``, which locks them.

    Raises ``Locked`` where metadata is there, whatever its version: a new calibration needs a new folder. A run that failed before the
    lock leaves tables without metadata, which readers refuse; the next run replaces them.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/metadata")
    if fs.exists(at):
        raise Locked(folder)
    found, _ = fitted(samples)
    for name in ("intensity", "texture"):
        spark.createDataFrame([(found[name],)], "bins array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    meta = {signals.VERSION_KEY: version, signals.LOCK_KEY: True, "samples": found["n"], "gradient_mean": found["gradient_mean"], "gradient_std": found["gradient_std"], "thresholds": found["thresholds"]}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/metadata")
    return meta


def distances(spark: SparkSession, folder: str, samples: DataFrame, version: str = VERSION) -> tuple[DataFrame, dict]:
    """(doc_id, d_intensity, d_texture, d_gradient) of samples to the locked references in ``folder``, and the metadata."""
    rows = {r["name"]: r for r in signals.calibration(spark, folder, version).collect()}  # two rows
    meta = json.loads(rows["intensity"]["metadata"])
    return _far(samples, rows["intensity"]["bins"], rows["texture"]["bins"], meta["gradient_mean"]), meta
