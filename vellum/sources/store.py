"""Tables in the folder that driver and executors share, and the sinks of the screening results."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File endings by media type.
ENDINGS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/webp": ".webp"}
#: Media types that are taken, and the largest upload in bytes. The limit is a setting, not a value of the data.
ALLOWED, MOST_BYTES = ("image/jpeg", "image/png"), 10 << 20
SCANNED = ("jpg", "jpeg", "png", "bmp", "tiff", "tif")

_KEPT: dict[tuple[str, str, str], tuple[str, str, T.StructType]] = {}
#: Seconds that the last build of each kept table took, those it stands on included.
BUILDS: dict[str, float] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local folder serves only where driver and executors are one process; a cluster without
    the setting is refused, as each machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write a table into the shared folder and read it back. It survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_state(spark: SparkSession, folder: str) -> str:
    """Of each table in a folder its name, time, bytes and number of files, hashed: it changes when files are added, removed or replaced. A
    table is asked for as a whole, so a table of many files costs the driver no more than one of few."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(path):
        held = fs.getContentSummary(s.getPath())
        found.append(f"{s.getPath().getName()} {s.getModificationTime()} {held.getLength()} {held.getFileCount()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def kept(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of this application over ``sf_dir``: built and written at its first use, read from then on.

    It is built anew when a file of the source has changed, or when what was written is gone.
    """
    jvm = spark.sparkContext._jvm
    key = spark.sparkContext.applicationId, sf_dir, label
    state = source_state(spark, sf_dir)
    known = _KEPT.get(key)
    if known and known[0] == state:
        done = jvm.org.apache.hadoop.fs.Path(f"{known[1]}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return spark.read.schema(known[2]).parquet(known[1])
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    began = time.time()
    rows = build()
    rows.write.option("compression", "zstd").parquet(path)
    BUILDS[label] = round(time.time() - began, 3)
    _KEPT[key] = state, path, rows.schema
    return spark.read.schema(rows.schema).parquet(path)


def ending(media_type: Column) -> Column:
    """The file ending of a media type; .bin for one that isn't known."""
    known = F.create_map(*(F.lit(x) for kv in ENDINGS.items() for x in kv))
    return F.coalesce(F.element_at(known, F.lower(media_type)), F.lit(".bin"))


def checked_uploads(files: DataFrame, allowed: tuple[str, ...] = ALLOWED, most: int = MOST_BYTES) -> DataFrame:
    """(path, media_type, length) with ``rejected``: the status that an upload is refused with, 415 for its type, 413 for its size,
    422 for an empty one; null for those taken."""
    taken = F.coalesce(F.lower("media_type").isin(*allowed), F.lit(False))
    return files.withColumn("rejected", F.when(~taken, 415).when(F.col("length") > most, 413).when(F.coalesce("length", F.lit(0)) == 0, 422))


# The first bytes of image files, in hexadecimal.
MAGIC = {"image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF"}


def sniffed(content: Column) -> Column:
    """The media type that the first bytes of a file show, or null."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for kind, magic in MAGIC.items():
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def png_size(content: Column) -> Column:
    """[width, height] from the header of a PNG file; null for other files and for a header that is cut or has no size."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    whole = (sniffed(content) == "image/png") & (F.octet_length(content) >= 24) & (F.hex(F.substring(content, 13, 4)) == "49484452")
    return F.when(whole & (number(17) > 0) & (number(21) > 0), F.array(number(17), number(21)))


def judged_uploads(files: DataFrame, allowed: tuple[str, ...] = ALLOWED, most: int = MOST_BYTES) -> DataFrame:
    """(path, media_type, content) with ``kind``, ``size`` and what speaks against the file: ``status`` 415, 413 or 422 and ``reason``, both
    null for one that is taken.

    The declared type comes first (no declaration is no objection), then the bytes: too many, none, of no known image, of another kind than
    declared, or an image without a size. Files are judged by their own bytes, so each needs no other and none is decoded.
    """
    kind, declared = sniffed(F.col("content")), F.nullif(F.lower(F.trim("media_type")), F.lit(""))
    length = F.coalesce(F.octet_length("content"), F.lit(0))
    same = F.when(declared == "image/jpg", "image/jpeg").otherwise(declared)
    fault = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    faults = (
        F.when(declared.isNotNull() & ~same.isin(*allowed), fault(415, "type not allowed"))
        .when(length > most, fault(413, "too large"))
        .when(length == 0, fault(422, "empty"))
        .when(kind.isNull(), fault(422, "no known image"))
        .when(declared.isNotNull() & (same != kind), fault(422, "not of the declared type"))
        .when((kind == "image/png") & png_size(F.col("content")).isNull(), fault(422, "broken header"))
    )
    return files.withColumns({"kind": kind, "size": png_size(F.col("content")), "fault": faults}).withColumns({"status": F.col("fault.status"), "reason": F.col("fault.reason")}).drop("fault")


def routed_uploads(files: DataFrame, allowed: tuple[str, ...] = ALLOWED, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The accepted files, with their contents, and the rejects (path, media_type, length, status, reason), which are no error: the rest of
    the batch goes on. Both are written in one pass over the bytes, and each file is in exactly one of them."""
    judged = judged_uploads(files, allowed, most).withColumns({"length": F.coalesce(F.octet_length("content"), F.lit(0)), "taken": F.col("status").isNull()})
    judged = judged.withColumn("content", F.when(F.col("taken"), F.col("content")))  # rejects keep no bytes
    path = f"{shared_dir(files.sparkSession)}/uploads-{uuid.uuid4().hex}"
    judged.write.option("compression", "zstd").partitionBy("taken").parquet(path)
    both = files.sparkSession.read.schema(judged.schema).parquet(path)
    return both.where("taken").drop("taken", "status", "reason"), both.where("not taken").select("path", "media_type", "length", "status", "reason")


def uploaded_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, media_type, content) of all files in a folder; the type is what the ending says, null if it says nothing. The reader leaves
    out empty files, so they are added from its listing, with an empty content."""
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    known = F.create_map(*(F.lit(x) for m, e in ENDINGS.items() if m != "image/jpg" for x in (e[1:], m)), F.lit("jpeg"), F.lit("image/jpeg"), F.lit("tif"), F.lit("image/tiff"), F.lit("txt"), F.lit("text/plain"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    listed = spark.createDataFrame([(re.sub("^file:///", "file:/", unquote(f)),) for f in read.inputFiles()], "path string")
    empty = listed.join(read.select("path"), "path", "left_anti").withColumn("content", F.lit(b""))
    return read.unionByName(empty).select("path", F.element_at(known, suffix).alias("media_type"), "content")


def image_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = SCANNED) -> DataFrame:
    """(path, name, media_type, length) of the images in a folder, in order of name. Contents are not read."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    kind = F.when(suffix.isin("jpg", "jpeg"), "image/jpeg").when(suffix.isin("tif", "tiff"), "image/tiff").otherwise(F.concat(F.lit("image/"), suffix))
    return found.where(suffix.isin(*endings)).select("path", name.alias("name"), kind.alias("media_type"), "length").orderBy("name")


def content_files(files: DataFrame) -> DataFrame:
    """(content, media_type) to one row for each distinct content: sha256, path, size, uses."""
    digest = F.sha2("content", 256)
    rows = files.select(digest.alias("sha256"), F.octet_length("content").alias("size"), ending(F.col("media_type")).alias("ending"))
    by = rows.groupBy("sha256").agg(F.min("ending").alias("ending"), F.min("size").alias("size"), F.count("*").alias("uses"))
    return by.select("sha256", F.concat("sha256", "ending").alias("path"), "size", "uses")


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose ``key`` the table at ``path`` doesn't have yet, and return how many; a second run adds none. Of rows with the
    same key the smallest counts. One writer at a time: several need ``commits``."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    rest = [c for c in rows.columns if c != key]
    fresh = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*") if rest else rows.distinct()
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        fresh = fresh.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti")
    fresh = written(fresh.select(rows.columns), "append")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def save_json(rows: DataFrame, path: str, by: str) -> None:
    """JSON lines, a folder for each value of ``by``; a rerun replaces the folders of its own values and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)
