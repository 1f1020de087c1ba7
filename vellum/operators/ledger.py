"""The tamper-evident ledger: transaction hashes, Merkle roots, chained blocks and their verification."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.numbers import json_text

GENESIS = "0" * 64
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()
#: What a transaction's hash covers, by name; ``payload`` is a struct.
HASHED = ("action", "actor", "payload", "subject_id", "subject_type", "timestamp", "tx_index")
BLOCK = "block_index long, n_tx long, merkle string, timestamp string, difficulty int, nonce long, prev_hash string, hash string"


def canonical_time(ts: Column) -> Column:
    """ISO text of a timestamp, microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def canonical(rows: DataFrame, *fields: str) -> Column:
    """JSON of the fields: keys by name, all the way down, no spaces, nulls kept, floats as Python prints them."""
    return json_text(F.struct(*fields), T.StructType([rows.schema[f] for f in fields]))


def with_hash(transactions: DataFrame, name: str = "hash") -> DataFrame:
    """Adds the hash of each transaction's contents."""
    return transactions.withColumn(name, F.sha2(canonical(transactions, *HASHED), 256))


def merkle_root(leaves: Column) -> Column:
    """Pairwise SHA-256 up to one hash; an odd layer repeats its last, no leaves give the hash of nothing."""
    def up(layer: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(layer) - 1) / 2).cast("int"))
        right = lambda i: F.coalesce(F.try_element_at(layer, (i * 2 + 2).cast("int")), F.element_at(layer, (i * 2 + 1).cast("int")))
        return F.when(F.size(layer) <= 1, layer).otherwise(F.transform(pairs, lambda i: F.sha2(F.concat(F.element_at(layer, (i * 2 + 1).cast("int")), right(i)), 256)))

    levels = F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(1)).cast("double"))).cast("int")
    top = F.aggregate(F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>")), leaves, up)
    return F.when(F.size(leaves) == 0, F.sha2(F.lit(""), 256)).otherwise(F.element_at(top, 1))


def blocks(transactions: DataFrame) -> DataFrame:
    """(block_index, tx_index, hash, timestamp) to a block each: n_tx, merkle, timestamp of the last."""
    leaves = F.transform(F.array_sort(F.collect_list(F.struct("tx_index", "hash"))), lambda x: x["hash"])
    return transactions.groupBy("block_index").agg(F.count("*").alias("n_tx"), merkle_root(leaves).alias("merkle"), F.max("timestamp").alias("timestamp"))


def numbered(rows: DataFrame, key: str, name: str, first: int = 0, width: int = 1 << 16) -> DataFrame:
    """Adds the dense rank of an integer key, from ``first`` on. Keys are ranked within ranges of ``width``; only the
    ranges' counts, a ``width``-th of the keys at most, are summed in order."""
    keys = rows.select(key).distinct().withColumn("range", F.floor(F.col(key) / width))
    counts = keys.groupBy("range").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    ranks = keys.withColumn("own", own).join(counts, "range").select(key, (F.col("own") + F.col("ahead") + first).cast("long").alias(name))
    return rows.join(ranks, key)


def header(index: Column, timestamp: Column, prev: Column, merkle: Column, difficulty: Column, nonce: Column) -> Column:
    """Canonical JSON of a block's header; its SHA-256 is the block's hash."""
    named = {"difficulty": difficulty, "index": index, "merkle_root": merkle, "nonce": nonce, "prev_hash": prev, "timestamp": timestamp}
    return F.to_json(F.struct(*(c.alias(n) for n, c in named.items())), {"ignoreNullFields": "false"})


def sealed(rows: DataFrame, head: tuple[int, str] | None = None, difficulty: int = 0, begun: str = "1970-01-01T00:00:00") -> DataFrame:
    """Chain blocks (block_index, n_tx, merkle, timestamp) after ``head``, the (index, hash) of a stored chain; without one,
    a genesis block of time ``begun`` comes first. Each nonce is the least whose hash begins with ``difficulty`` zeros.

    A hash needs the one before it, so making a chain is serial: headers of some 200 bytes go through one ordered task, and only those of new
    blocks. Merkle roots were made in parallel before, and reading or verifying a stored chain needs no such pass.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = head[1] if head else GENESIS
        for batch in batches:
            nonces, before, own = [], [], []
            for i, m, t in zip(*(batch.column(c).to_pylist() for c in ("block_index", "merkle", "timestamp"))):
                before.append(prev)
                nonce = 0
                while True:
                    text = json.dumps({"difficulty": difficulty, "index": i, "merkle_root": m, "nonce": nonce, "prev_hash": prev, "timestamp": t}, separators=(",", ":"), ensure_ascii=False)
                    digest = hashlib.sha256(text.encode()).hexdigest()
                    if digest.startswith("0" * difficulty):
                        break
                    nonce += 1
                prev = digest
                nonces.append(nonce)
                own.append(prev)
            cols = ["block_index", "n_tx", "merkle", "timestamp"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array([difficulty] * len(own), pa.int32()), pa.array(nonces, pa.int64()), pa.array(before), pa.array(own)], [*cols, "difficulty", "nonce", "prev_hash", "hash"])

    flat = rows.select(F.col("block_index").cast("long"), F.col("n_tx").cast("long"), "merkle", F.col("timestamp").cast("string").alias("timestamp"))
    if head is None:
        flat = flat.unionByName(flat.sparkSession.createDataFrame([(0, 0, EMPTY_ROOT, begun)], flat.schema))
    return flat.repartitionByRange(1, "block_index").sortWithinPartitions("block_index").mapInArrow(link, BLOCK)


def mined(spark: SparkSession, index: int, timestamp: str, prev: str, merkle: str, difficulty: int, first: int = 0, span: int = 1 << 18) -> tuple[int, str]:
    """The least nonce from ``first`` on whose header's hash begins with ``difficulty`` zeros, and that hash.

    Ranges of ``span`` nonces are searched one after the other, each by all tasks at once; the least hit of the first range that has
    one is the least of all, whichever task is the first to find one. The driver gets a row a range.
    """
    nonce, zeros = F.col("id"), "0" * difficulty
    digest = F.sha2(header(F.lit(index), F.lit(timestamp), F.lit(prev), F.lit(merkle), F.lit(difficulty), nonce), 256)
    while True:
        tried = spark.range(first, first + span).select("id", digest.alias("hash")).where(F.col("hash").startswith(zeros))
        hit = tried.agg(F.min_by(F.struct("id", "hash"), "id").alias("h")).first()["h"]
        if hit is not None:
            return hit["id"], hit["hash"]
        first += span


def verified(chain: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row: ok, blocks, transactions, head, broken_at, reason. ``transactions`` have block_index, their contents, and the stored ``hash``.

    Each block is checked by itself: its predecessor is there (``index``), its link (``link``), every stored transaction hash against
    the contents (``transaction``), the Merkle root (``merkle``), the header's hash (``hash``), its zeros (``work``). The
    earliest broken block counts. An empty chain is sound, without a head.
    """
    again = with_hash(transactions, "again")
    edited = again.groupBy("block_index").agg(F.count_if(~F.col("again").eqNullSafe(F.col("hash"))).alias("edited"), F.count("*").alias("held"))
    own = blocks(transactions).select("block_index", F.col("merkle").alias("root")).join(edited, "block_index")
    times = chain.groupBy("block_index").agg(F.count("*").alias("times"), F.min("hash").alias("of"))
    before = times.select((F.col("block_index") + 1).alias("block_index"), F.col("of").alias("before"))
    rows = chain.join(times.select("block_index", "times"), "block_index").join(before, "block_index", "left").join(own, "block_index", "left")
    first = F.col("block_index") == 0
    digest = F.sha2(header(F.col("block_index"), F.col("timestamp"), F.col("prev_hash"), F.col("merkle"), F.col("difficulty"), F.col("nonce")), 256)
    reason = (
        F.when((F.col("times") > 1) | (~first & F.col("before").isNull()) | (F.col("block_index") < 0), "index")
        .when(F.col("prev_hash") != F.when(first, GENESIS).otherwise(F.col("before")), "link")
        .when(F.coalesce("edited", F.lit(0)) > 0, "transaction")
        .when(F.coalesce("root", F.lit(EMPTY_ROOT)) != F.col("merkle"), "merkle")
        .when(digest != F.col("hash"), "hash")
        .when(~F.col("hash").startswith(F.repeat(F.lit("0"), F.col("difficulty"))), "work")
    )
    found = rows.withColumn("reason", reason).agg(
        F.count("*").alias("blocks"), F.coalesce(F.sum("held"), F.lit(0)).alias("transactions"), F.max_by("hash", "block_index").alias("head"),
        F.min(F.when(F.col("reason").isNotNull(), F.col("block_index"))).alias("broken_at"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("block_index"))).alias("reason"),
    )
    return found.select(F.col("broken_at").isNull().alias("ok"), "blocks", "transactions", "head", "broken_at", "reason")


def tampered(transactions: DataFrame, block: int) -> DataFrame:
    """The demonstration of an attack: the risk level in the first payload of a block is lowered, its stored hash left as it is."""
    hit = (F.col("block_index") == block) & (F.col("tx_index") == 0)
    return transactions.withColumn("payload", F.when(hit, F.col("payload").withField("risk_level", F.lit("LOW"))).otherwise(F.col("payload")))


def restored(transactions: DataFrame, backups: DataFrame) -> DataFrame:
    """Payloads from ``backups`` (block_index, tx_index, payload) where there are some."""
    kept = backups.select("block_index", "tx_index", F.col("payload").alias("backup"))
    return transactions.join(kept, ["block_index", "tx_index"], "left").withColumn("payload", F.coalesce("backup", "payload")).drop("backup")


def fingerprint(rows: DataFrame, *fields: str) -> Column:
    """SHA-256 of the canonical JSON of a result."""
    return F.sha2(canonical(rows, *fields), 256)
