"""What the corpus operators share: tables, the shared folder, word hashing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every contract: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local one serves only where driver and executors are one
    process; a cluster without the setting is refused, as each machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or "/tmp/checkpoints"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write a table into the shared folder and read it back.

    Unlike a cached or local copy it survives lost executors; the folder is the
    cluster's to clean, as for any checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than 1/SPREAD of a table's rows is hot: fewer than SPREAD keys can be.
SPREAD = 256
#: Below this many rows no key is hot.
SPREAD_LEAST = 2_000


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows_of: str | None = None, share: int = SPREAD, least: int = SPREAD_LEAST) -> DataFrame:
    """Join on ``key``, of which ``right`` has each value once; no task gets all rows of a hot key.

    Rows of ``left`` with a key of more than 1/``share`` of its rows are dealt over salts, and the key's one row of ``right`` goes
    to each of them. Fewer than ``share`` keys are that frequent, whatever the input: so many rows the driver gets. Both tables
    are read more than once: they should be written ones, or cheap. ``rows_of`` names a column of ``right`` with the rows of ``left``
    that have the key, where that is known. Null keys match nothing.
    """
    total = right.agg(F.coalesce(F.sum(rows_of), F.lit(0))).first()[0] if rows_of else left.count()
    if total <= least:
        return left.join(right, key, how)
    unit = max(least, total // share)
    if rows_of:
        counts = right.select(F.col(key).alias("hot_key"), F.col(rows_of).alias("rows_of"))
    else:
        counts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("rows_of"))
    hot = counts.where(F.col("rows_of") > unit).select("hot_key", F.ceil(F.col("rows_of") / unit).cast("int").alias("salts"))
    found = hot.collect()  # fewer than ``share`` rows
    if not found:
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema))
    on = F.col(key) == F.col("hot_key")
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = left.join(hot, on, "left").withColumn("salt", salt).drop("hot_key", "salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))
    copied = right.join(hot, on, "left").withColumn("salt", copies).drop("hot_key", "salts")
    return dealt.join(copied, [key, "salt"], how).drop("salt")


def maybe_among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false where the long ``key`` is surely not among ``ids`` (one column). A sieve of 2**23 bits in 2**17
    rows at most, whatever the input; the more ids it holds, the more rows it lets through to the exact join that must follow."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))
    words = ids.select(at(F.col(ids.columns[0])).alias("h")).groupBy(F.floor(F.col("h") / 64).alias("word")).agg(F.bit_or(bit(F.col("h"))).alias("bits"))
    held = rows.withColumn("h", at(F.col(key))).withColumn("of", F.floor(F.col("h") / 64)).join(F.broadcast(words.withColumnRenamed("word", "of")), "of", "left")
    hit = F.col("bits").bitwiseAND(bit(F.col("h"))) != 0
    return held.withColumn("maybe", F.col(key).isNotNull() & F.coalesce(hit, F.lit(False))).drop("h", "of", "bits")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words(text: Column) -> Column:
    """Array of the words of a text, natively; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def split_words(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and where each text's words begin (one entry more than texts)."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(text)
    flat, at = lists.values, lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    flat = flat.filter(real)
    # Lowered here, as a fresh array: ascii_lower garbles slices of large strings.
    return pc.ascii_lower(flat) if lower else flat, before[at]


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    coded = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64)


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def window_hashes(h: np.ndarray, width: int, factor: np.uint64 = _M1) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values (runs across texts included: the caller masks them). Another odd
    ``factor`` gives another hash."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, width):
        acc *= factor
        acc += h[j : j + n]
    return mixed(acc)


def whole_windows(starts: np.ndarray, width: int) -> np.ndarray:
    """Mask over window positions of the flat word array: those inside one text."""
    total = int(starts[-1])
    n = max(0, total - width + 1)
    ok = np.ones(total + 1, bool)
    for j in range(1, width):  # a window may not start in the last width-1 words of a text
        ends = starts[1:] - j
        ok[ends[(ends >= starts[:-1])]] = False
    return ok[:n]
