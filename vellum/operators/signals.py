"""Biometric decisions, forensic layers, calibration and evaluation as aggregates."""

from __future__ import annotations

import json

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.measures import chi_square, cosine, wasserstein1
from vellum.sources.store import written

MATCH = 0.50


def primary_face(faces: DataFrame) -> DataFrame:
    """(doc_id, face, area) to the dominant face: alone, or twice as large as the second; else ambiguous."""
    rank = Window.partitionBy("doc_id").orderBy(F.desc("area"), "face")
    top = faces.withColumn("r", F.row_number().over(rank)).where("r <= 2")
    both = top.groupBy("doc_id").agg(F.max(F.when(F.col("r") == 1, F.col("face"))).alias("face"), F.max(F.when(F.col("r") == 1, F.col("area"))).alias("a1"), F.max(F.when(F.col("r") == 2, F.col("area"))).alias("a2"))
    clear = F.col("a2").isNull() | (F.col("a2") <= 0) | (F.col("a1") >= 2.0 * F.col("a2"))
    return both.select("doc_id", F.when(clear, F.col("face")).alias("face"), (~clear).alias("ambiguous"))


def quality_grade(det: Column, side: Column, blur: Column) -> Column:
    """The worst of three grades."""
    grade = lambda x, good, fair: F.when(x >= good, 2).when(x >= fair, 1).otherwise(0)
    worst = F.least(grade(det, 0.65, 0.50), grade(side, 80, 45), grade(blur, 120, 40))
    return F.element_at(F.array(F.lit("POOR"), F.lit("ACCEPTABLE"), F.lit("GOOD")), worst + 1)


def quality_score(grade: Column) -> Column:
    """A grade's place from 0 to 1."""
    return F.when(grade == "GOOD", 1.0).when(grade == "ACCEPTABLE", 0.5).when(grade == "POOR", 0.0)


def decision(similarity: Column, threshold: float = MATCH) -> tuple[Column, Column]:
    """MATCH or MISMATCH, and how strongly, by the distance from the threshold."""
    margin = F.round(F.abs(similarity - threshold), 9)
    return F.when(similarity >= threshold, "MATCH").otherwise("MISMATCH"), F.when(margin >= 0.20, "HIGH").when(margin >= 0.10, "MEDIUM").otherwise("LOW")


# What a comparison of faces comes to before any are compared, in order.
GATES = ("UNAVAILABLE", "AMBIGUOUS", "NO_FACE", "INSUFFICIENT_QUALITY")


def gated(checks: DataFrame) -> DataFrame:
    """(doc_id, has_reference, model_ok, doc_faces, ref_faces, doc_ambiguous, ref_ambiguous, doc_quality, ref_quality, similarity) to (doc_id, status,
    similarity, strength): no reference or model, then several comparable faces, then none, then poor quality; else compared."""
    poor = lambda q: F.coalesce(F.col(q), F.lit("UNAVAILABLE")).isin("POOR", "UNAVAILABLE")
    gate = (
        F.when(~F.coalesce("has_reference", F.lit(False)) | ~F.coalesce("model_ok", F.lit(False)), GATES[0])
        .when(F.col("doc_ambiguous") | F.col("ref_ambiguous"), GATES[1])
        .when((F.col("doc_faces") == 0) | (F.col("ref_faces") == 0), GATES[2])
        .when(poor("doc_quality") | poor("ref_quality"), GATES[3])
    )
    rows = checks.withColumn("gate", gate).withColumn("similarity", F.when(F.col("gate").isNull(), F.round("similarity", 4)))
    status, strength = decision(F.col("similarity"))
    return rows.select("doc_id", F.coalesce("gate", status).alias("status"), "similarity", F.when(F.col("gate").isNull(), strength).alias("strength"))


def verified(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, embedding) of documents and of references: similarity, status, strength."""
    both = left.join(right.withColumnRenamed("embedding", "reference"), "doc_id", "left")
    sim = F.when(F.col("reference").isNotNull(), F.round(cosine(F.col("embedding"), F.col("reference")), 6))
    status, strength = decision(F.col("similarity"))
    return both.withColumn("similarity", sim).select("doc_id", "similarity", F.when(F.col("similarity").isNull(), "UNAVAILABLE").otherwise(status).alias("status"), F.when(F.col("similarity").isNotNull(), strength).alias("strength"))


def histogram(values: DataFrame, key: str, value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """(key, bin, share) of every bin that has values. Values below ``low`` count in the first bin, those above ``high`` in the last; null
    and NaN values in none."""
    at = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    known = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = known.groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select(key, "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def dense(shares: DataFrame, key: str, bins: int = 256) -> DataFrame:
    """(key, h): one array of all bins a key, 0 where a bin has no values."""
    entries = F.map_from_entries(F.collect_list(F.struct("bin", "share")))
    return shares.groupBy(key).agg(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0.0))).alias("h"))


def histogram_fault(h: Column, bins: int = 256) -> Column:
    """Why an array is no histogram, or null: missing, bins, not finite, negative, no mass."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    mass = F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    return F.when(h.isNull(), "missing").when(F.size(h) != bins, "bins").when(F.exists(h, bad), "not finite").when(F.exists(h, lambda x: x < 0), "negative").when(mass <= 0, "no mass")


def percentile(values: DataFrame, value: str, share: float) -> float | None:
    """The exact percentile between the two ranks around it, by range partitions: the driver gets a count for each partition and the
    values of two ranks, and no task sorts more than its partition. Null without values."""
    known = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    parts = written(known.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranges")
    counts = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    total = sum(n for _, n in counts)
    if not total:
        return None
    at = share * (total - 1)
    found = []
    for rank in (int(at), min(int(at) + 1, total - 1)):
        before = 0
        for part, n in counts:
            if rank < before + n:
                break
            before += n
        own = parts.where(F.col("part") == part).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1)
        found.append(own.where(F.col("r") == rank - before).first()["v"])
    return found[0] + (found[1] - found[0]) * (at - int(at))


def leave_one_out(samples: DataFrame, value: str) -> DataFrame:
    """Distance of each sample to the mean of the others, from one grouped sum: no sample is paired with another."""
    total = samples.agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    rest = (F.col("s") - F.col(value)) / (F.col("n") - 1)
    return samples.join(F.broadcast(total)).withColumn("distance", F.when(F.col("n") > 1, F.abs(F.col(value) - rest)))  # one row


def rates(labelled: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The confusion matrix and its rates; a zero denominator gives 0."""
    t, p = F.col(truth), F.col(predicted)
    m = labelled.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    safe = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return m.select(
        "tp", "fp", "tn", "fn", safe(tp + tn, tp + fp + tn + fn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
        safe(tn, tn + fp).alias("specificity"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(fp, fp + tn).alias("fpr"), safe(fn, fn + tp).alias("fnr"),
    )


# Decisions of the forensic layers from their measures ----------------------------------------------
# Version of the calibration, limits of severity, of the image and the patch, of its quality, of a photo.
VERSION_KEY, LOCK_KEY = "algorithm_version", "artifacts_locked"
PATCH = (0.05, 0.01, 0.85, 0.045)
LEAST_IMAGE, LEAST_PATCH = (50, 50), (10, 5)
PHOTO_SHARE, PHOTO_ASPECT = (0.03, 0.15), (0.5, 1.0)
EPS = 1e-9


def _severity(score: Column, low: float, high: float) -> Column:
    return F.when(score < low, "low").when(score < high, "medium").otherwise("high")


def _decided(rows: DataFrame, layer: int, kind: Column, score: Column, confidence: Column, severity: Column, passed: Column) -> DataFrame:
    four = lambda x: F.round(x, 4)
    return rows.select("doc_id", F.lit(layer).alias("layer"), kind.alias("finding_type"), four(score).alias("score"), four(confidence).alias("confidence"), severity.alias("severity"), passed.alias("passed"))


def texture_decision(rows: DataFrame, intensity: float, texture: float, gradient: float) -> DataFrame:
    """Layer 1, of (doc_id, d_intensity, d_texture, d_gradient, quality): all distances within their thresholds."""
    d = dict(zip(("d_intensity", "d_texture", "d_gradient"), (intensity, texture, gradient)))
    passed = (F.col("d_intensity") <= intensity) & (F.col("d_texture") <= texture) & (F.col("d_gradient") <= gradient)
    score = F.round(F.greatest(*(F.least(F.lit(1.0), F.col(c) / (2 * t)) if t > 0 else F.lit(1.0) for c, t in d.items())), 4)
    sure = F.least(F.lit(1.0), F.abs(F.col("d_intensity") - intensity) / (intensity + EPS))
    sure = F.when(F.col("quality") == "insufficient_quality", sure * 0.5).otherwise(sure)
    return _decided(rows, 1, F.when(passed, "normal").otherwise("background_consistency_anomaly"), score, sure, _severity(score, 0.35, 0.70), passed)


def _distance_decision(rows: DataFrame, layer: int, kind: str, measure: str, threshold: float, full: float) -> DataFrame:
    x = F.col(measure)
    score = F.least(x / (threshold * full), F.lit(1.0)) if threshold > 0 else F.lit(1.0)
    return _decided(rows, layer, F.lit(kind), score, F.least(F.lit(1.0), F.abs(x - threshold) / (threshold + EPS)), _severity(score, 0.3, 0.7), x <= threshold)


def boundary_decision(rows: DataFrame, threshold: float) -> DataFrame:
    """Layer 2, of (doc_id, long_lines): at most ``threshold`` long straight edges around the photo."""
    return _distance_decision(rows, 2, "photo_boundary_anomaly", "long_lines", threshold, 2.0)


def colour_decision(rows: DataFrame, threshold: float) -> DataFrame:
    """Layer 3, of (doc_id, distance): a Mahalanobis distance within the genuine ones."""
    return _distance_decision(rows, 3, "color_consistency_anomaly", "distance", threshold, 1.5)


def compression_decision(rows: DataFrame, low: float, high: float, mean: float) -> DataFrame:
    """Layer 4, of (doc_id, mean_error): inside the band of genuine recompression errors."""
    x = F.col("mean_error")
    passed = x.between(low, high)
    room = max(abs(high - mean), abs(low - mean), 0.01)
    out = F.when(x < low, low - x).otherwise(x - high)
    score = F.when(passed, F.least(F.abs(x - mean) / (room * 1.5), F.lit(0.4))).otherwise(F.least(0.5 + out / 0.3 * 0.5, F.lit(1.0)))
    sure = F.least(F.lit(1.0), F.when(passed, F.least(F.abs(x - low), F.abs(x - high))).otherwise(out) / 0.1)
    return _decided(rows, 4, F.lit("ela_anomaly"), score, sure, F.when(passed, "low").when(score >= 0.7, "high").otherwise("medium"), passed)


def with_defaults(layers: DataFrame) -> DataFrame:
    """(doc_id, layer, finding_type, score, confidence, severity, passed, crashed) with what a layer left out filled in; a crashed layer is
    a failed finding of type processing_error."""
    crashed = F.coalesce("crashed", F.lit(False))
    score = F.coalesce("score", F.lit(0.0))
    fill = lambda c, own, fallen: F.when(crashed, fallen).otherwise(F.coalesce(F.col(c), own)).alias(c)
    return layers.select(
        "doc_id", "layer", fill("finding_type", F.when(F.coalesce("passed", F.lit(True)), "normal").otherwise("anomaly"), F.lit("processing_error")), fill("score", F.lit(0.0), F.lit(1.0)),
        fill("confidence", F.lit(0.5), F.lit(0.0)), fill("severity", _severity(score, 0.3, 0.7), F.lit("high")), fill("passed", F.lit(True), F.lit(False)), F.when(crashed, "error").otherwise("ok").alias("status"),
    )


def forensic_summary(layers: DataFrame) -> DataFrame:
    """Per document: layers requested, completed, failed, flagged (not passed), and whether all passed."""
    ok = F.col("status") == "ok"
    return layers.groupBy("doc_id").agg(F.count("*").alias("requested"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), F.count_if(~F.col("passed")).alias("flagged"), F.bool_and("passed").alias("all_passed"))


def clamped(box: Column, width: Column, height: Column) -> Column:
    """[x, y, w, h] to [x1, y1, x2, y2] inside the image; null without four numbers."""
    at = lambda i: F.get(box, F.lit(i))
    inside = lambda v, most: F.greatest(F.lit(0), F.least(v, most)).cast("int")
    return F.when(F.size(box) == 4, F.array(inside(at(0), width), inside(at(1), height), inside(at(0) + at(2), width), inside(at(1) + at(3), height)))


def patch(width: Column, height: Column) -> Column:
    """[x1, y1, x2, y2] of the patch of background that is measured; null for an image or patch that is too small."""
    x, y = (F.floor(n * share).cast("int") for n, share in zip((width, height), PATCH))
    w, h = (F.floor(n * share).cast("int") for n, share in zip((width, height), PATCH[2:]))
    x2, y2 = F.least(x + w, width.cast("int")), F.least(y + h, height.cast("int"))
    return F.when((width >= LEAST_IMAGE[0]) & (height >= LEAST_IMAGE[1]) & (x2 - x >= LEAST_PATCH[0]) & (y2 - y >= LEAST_PATCH[1]), F.array(x, y, x2, y2))


def patch_quality(pixels: Column, contrast: Column, clipping: Column, sharpness: Column) -> Column:
    unusable = (pixels < 200) | (contrast < 0.1) | (clipping > 85.0)
    return F.when(F.coalesce(unusable, F.lit(True)), "unusable").when((contrast < 1.0) | (clipping > 35.0) | (sharpness < 1.5), "insufficient_quality").otherwise("acceptable")


def photo_box(candidates: DataFrame) -> DataFrame:
    """(doc_id, x, y, w, h, width, height) to the largest candidate of a photo's share of the page and aspect, as [x, y, w, h]."""
    area = F.col("w") * F.col("h")
    fit = (area / (F.col("width") * F.col("height"))).between(*PHOTO_SHARE) & (F.col("w") / F.col("h")).between(*PHOTO_ASPECT)
    return candidates.where(fit).groupBy("doc_id").agg(F.max_by(F.array("x", "y", "w", "h"), F.struct(area, -F.col("y"), -F.col("x"))).alias("box"))


# Calibration ---------------------------------------------------------------------------------------
def covariance(samples: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, covariance, mean_a) of each pair of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = samples.agg(*(F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs), *(F.avg(a).alias(f"m_{a}") for a in cols))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c_{a}_{b}").alias("covariance"), F.col(f"m_{a}").alias("mean_a")) for a, b in pairs))
    return one.select(F.inline(each))


def colour_baseline(samples: DataFrame, cols: list[str], ridge: float = 1e-6, share: float = 0.95) -> tuple[list[float], list[list[float]], float]:
    """Mean, inverse covariance, and the threshold: that percentile of the samples' own distances. The driver gets a number for each pair
    of columns, and inverts a matrix as wide as there are columns."""
    found = {(r["a"], r["b"]): r for r in covariance(samples, cols).collect()}
    cov = np.array([[found[min(a, b, key=cols.index), max(a, b, key=cols.index)]["covariance"] for b in cols] for a in cols])
    mean = [found[a, a]["mean_a"] for a in cols]
    inverse = np.linalg.pinv(cov + ridge * np.eye(len(cols))).tolist()
    return mean, inverse, percentile(samples.select(mahalanobis(cols, mean, inverse).alias("d")), "d", share)


def mahalanobis(cols: list[str], mean: list[float], inverse: list[list[float]]) -> Column:
    off = [F.col(c) - F.lit(m) for c, m in zip(cols, mean)]
    return F.sqrt(F.greatest(sum((off[i] * off[j] * F.lit(inverse[i][j]) for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0)), F.lit(0.0)))


def histogram_distances(samples: DataFrame, key: str, reference: Column) -> DataFrame:
    """(key, d_intensity, d_texture) of histograms ``h`` to a reference array."""
    return samples.select(key, wasserstein1(F.col("h"), reference).alias("d_intensity"), chi_square(F.col("h"), reference).alias("d_texture"))


def calibration(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """The rows (name, bins, metadata as JSON text) of a locked calibration: Parquet tables ``intensity`` and ``texture``, JSON ``metadata``.
    Raises where one is missing, of another version, or not locked; nothing is calibrated anew."""
    try:
        parts = [spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("name"), "bins") for name in ("intensity", "texture")]
        meta = spark.read.option("multiLine", True).json(f"{folder}/metadata").first()
    except AnalysisException as e:
        raise FileNotFoundError(f"no complete calibration in {folder}") from e
    if meta is None or meta.asDict().get(VERSION_KEY) != version:
        raise RuntimeError(f"the calibration is of version {meta and meta.asDict().get(VERSION_KEY)}, not {version}")
    if not meta.asDict().get(LOCK_KEY):
        raise RuntimeError("the calibration isn't locked")
    return parts[0].unionByName(parts[1]).withColumn("metadata", F.lit(json.dumps(meta.asDict(recursive=True), sort_keys=True, default=str)))


def base_id(name: Column) -> Column:
    """The number of a specimen in a file name, or null."""
    return F.nullif(F.regexp_extract(name, r"passport_(\d+)", 1), F.lit(""))


def fakes_of(genuine: DataFrame, fakes: DataFrame) -> DataFrame:
    """(base, genuine, fake): each fake with the last genuine one of its base id; files are (name)."""
    of = lambda df: df.withColumn("base", base_id(F.col("name"))).where("base is not null")
    last = of(genuine).groupBy("base").agg(F.max("name").alias("genuine"))
    return of(fakes).join(last, "base").select("base", "genuine", F.col("name").alias("fake"))


def members(samples: DataFrame, split: DataFrame, part: str) -> DataFrame:
    """Samples whose ``base`` is in that part of a saved split (part, base)."""
    return samples.join(split.where(F.col("part") == part).select("base"), "base", "left_semi")


def overlap(split: DataFrame) -> DataFrame:
    """(base, parts) of ids that stand in several parts of a split: none, if it is sound."""
    return split.groupBy("base").agg(F.array_sort(F.collect_set("part")).alias("parts")).where(F.size("parts") > 1)
