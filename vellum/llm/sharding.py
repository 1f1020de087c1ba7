"""Sharding by minimax contiguous partition: binary search for the smallest feasible shard capacity over ordered
atomic group sizes, checked greedily, and cut there."""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import written

SHARDS = 24
#: Hex digits of a group's key that make a bucket: the driver holds a size for each of these 4,096 buckets.
DIGITS = 3
#: Pieces of the group order that the driver gets a size for at a time.
PIECES = 1 << 14


def _buckets() -> Column:
    return F.substring("gid", 1, DIGITS)


def _refined(groups: DataFrame, windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """First group start, last group start and number of groups in equal slices of the windows: PIECES rows, or two a
    window, at most."""
    slices = max(2, PIECES // len(windows))
    bounds = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(z).cast("long").alias("z")) for a, z in windows))
    near = groups.where((F.col("begin") >= windows[0][0]) & (F.col("begin") < windows[-1][1])).select("begin", F.element_at(F.filter(bounds, lambda w: w["a"] <= F.col("begin")), -1).alias("w")).where("begin < w.z")
    nth = F.floor((F.col("begin") - F.col("w.a")) / (F.col("w.z") - F.col("w.a")) * slices)
    found = near.groupBy(F.col("w.a").alias("a"), nth.alias("nth")).agg(F.min("begin").alias("low"), F.max("begin").alias("high"), F.count("*").alias("n"))
    return [(r["low"], r["high"], r["n"]) for r in found.collect()]


def _cuts(groups: DataFrame, total: int, shards: int) -> list[int]:
    """Offsets where shards begin: the greedy cuts of the smallest capacity that ``shards`` shards hold.

    The driver knows some group starts, and which pieces between them are single groups. Greedy steps that cut at
    known starts alone are possible for sure; steps that cut anywhere within unknown pieces are the most that can be
    hoped for. Binary searches over both give bounds of the capacity, and thus of each cut; the unknown pieces
    where limits can lie are sliced by one job a round, until there are none.

    A group above the capacity gets a shard of its own, so one huge group doesn't leave the other
    shards uneven; the largest shard is the smallest possible all the same.
    """
    edges, single = [0, total], set()

    def walk(capacity: int, hopeful: bool) -> list[int] | None:
        """Shard starts and the end of the last shard; None where sure steps get stuck."""
        cuts = [0]
        while cuts[-1] < total and len(cuts) <= shards:
            limit = cuts[-1] + capacity
            if limit >= total:
                cuts.append(total)
                break
            k = bisect_right(edges, limit) - 1
            if edges[k] > cuts[-1]:
                cuts.append(limit if hopeful and edges[k] not in single else edges[k])
            elif hopeful or edges[k] in single:
                cuts.append(edges[k + 1])
            else:
                return None
        return cuts

    def smallest(hopeful: bool) -> int:
        low, high = 0, total  # held by less than all shards, or not; held by one
        while high - low > 1:
            middle = (low + high) // 2
            cuts = walk(middle, hopeful)
            low, high = (low, middle) if cuts and cuts[-1] >= total else (middle, high)
        return high

    moved = True
    while True:
        least, most = smallest(True), smallest(False)
        sure, hoped = walk(least, False), walk(most, True)
        unknown: set[int] = set()
        windows = []
        for i, far in enumerate(hoped):
            from_ = sure[min(i, len(sure) - 1)] if sure else 0
            if far >= total and from_ >= total:
                break
            a, z = (bisect_right(edges, min(x, total - 1)) - 1 for x in (from_ + least, far + most))
            open_ = [k for k in range(a, z + 1) if edges[k] not in single]
            unknown.update(open_)
            if open_:
                windows.append((edges[open_[0]], edges[open_[-1] + 1]))
        if not unknown:
            return walk(most, False)[:-1]
        if moved:  # the stretch of each cut
            merged: list[tuple[int, int]] = []
            for a, z in sorted(windows):
                if merged and a <= merged[-1][1]:
                    merged[-1] = merged[-1][0], max(z, merged[-1][1])
                else:
                    merged.append((a, z))
        else:  # such slices told nothing new: each piece by itself
            merged = [(edges[k], edges[k + 1]) for k in sorted(unknown)]
        before = len(edges) + len(single)
        starts = set(edges)
        for low, high, n in _refined(groups, merged):
            starts |= {low, high}
            single |= {high, low} if n <= 2 else {high}
        edges = sorted(starts)
        moved = len(edges) + len(single) > before


def sharded(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 8), text_crc32, law (``bytes``), shard, slot, grown_shard (null),
    and ``keep``.

    Documents of equal text are an atomic group. Groups are ordered by the MD5 of their text; shards are runs of
    groups whose largest has the least bytes possible. slot counts from 0 within a shard, without gaps, in
    order of group, a part of the hashed id, and doc_id.

    A group is summed and ranked in parts of 256 by hashed id, so that a text of a third of all rows is spread; windows
    run within the 4,096 buckets of groups. The driver gets one size for each bucket.

    Needs columns doc_id and text; others are ignored unless in ``keep``. Text null: size 8, crc32 null, a group of
    their own; empty text: size 8, crc32 0. doc_id null, repeated rows: each is placed; which of equal rows comes first is
    open. Fewer groups than shards: the last shards stay empty. Empty table: no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("gid"), *keep)
    raw = raw.withColumn("sub", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2))
    rows = raw if keep else written(raw, "sizes")
    units = rows.groupBy("gid", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("bucket", _buckets())
    units = written(units, "units")
    sums = sorted((r["bucket"], r["bytes"], r["n"]) for r in units.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect())  # 4,097 rows at most
    byte = count = 0
    starts = []
    for bucket, size, n in sums:
        starts.append((bucket, byte, count))
        byte, count = byte + size, count + n
    if not starts:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *keep)
    known = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"bucket": b, "byte": o, "row": c} for b, o, c in starts])), "array<struct<bucket:string,byte:bigint,row:bigint>>")))
    run = Window.partitionBy("bucket").orderBy("gid", "sub").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(run), F.lit(0))
    placed = units.withColumn("b0", before("bytes")).withColumn("r0", before("n")).join(F.broadcast(known), "bucket")
    placed = written(placed.select("gid", "sub", "bucket", (F.col("byte") + F.col("b0")).alias("begin"), (F.col("row") + F.col("r0")).alias("first"), "bytes"), "placed")
    groups = written(placed.groupBy("bucket", "gid").agg(F.min("begin").alias("begin"), F.sum("bytes").alias("bytes"), F.min("first").alias("first")).select("gid", "begin", "first").repartitionByRange("begin").sortWithinPartitions("begin"), "groups")
    cuts = _cuts(groups, byte, shards)
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("begin"))) - 1
    of = groups.select("gid", shard.alias("shard"), "first")
    base = of.groupBy("shard").agg(F.min("first").alias("base"))  # one row a shard
    first = placed.join(of.select("gid", "shard"), "gid").join(F.broadcast(base), "shard").select("gid", "sub", "shard", (F.col("first") - F.col("base")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("gid", "sub").orderBy("doc_id")) - 1
    out = rows.withColumn("rank", rank).join(first, ["gid", "sub"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *keep)
