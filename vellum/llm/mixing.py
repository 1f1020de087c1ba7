"""Mixing sources to target weights by systematic sampling: a prefix sum of each document's expected copies
within its source, one random offset, and a copy for each integer boundary crossed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import words, written

WEIGHTS = (1, 2, 3)
#: No source is taken more often than this.
EPOCHS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of the total by weight, at most ``epochs``
    times the size; the excess is shared again by weight until none is above.

    Sources in code point order, null last, get the weights in turn. Each round is an aggregate over the
    table of sources that returns two numbers.
    """
    # A bounded prefix of the name parts the sources, so that no task ranks all of them.
    part = F.coalesce(F.hex(F.substring(F.col("source"), 1, 2).cast("binary")), F.lit("~"))
    named = sizes.withColumn("part", part)
    before = named.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    placed = named.withColumn("own", rank).join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part")
    turn = F.pmod(F.col("own") + F.col("before"), F.lit(len(weights)))
    weighed = written(placed.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).alias("weight")), "sources")
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, level = total, 0.0
    while weight:
        level = rest / weight
        full = F.col("source_size") * epochs <= F.col("weight") * level
        now = weighed.agg(F.coalesce(F.sum(F.when(full, F.col("source_size") * epochs)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if now[1] == weight:
            break
        rest, weight = total - now[0], now[1]
    target = F.least(F.col("source_size") * float(epochs), F.col("weight") * F.lit(float(level)))
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def _size_class(size: Column) -> Column:
    """A number that grows with the size: its highest five bits and their place. Sizes of a class differ by 1/16 at most."""
    shift = F.greatest(F.length(F.bin(size + 1)) - 5, F.lit(0))
    return shift * 32 + F.call_function("shiftright", (size + 1).cast("bigint"), shift)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target, copies, taken (copies * size), and ``keep``.

    A document's expected copies are target / source_size. Documents of a source are lined up by size class and hashed
    id, so that the words taken stay close to the target, and copied once per integer boundary that the prefix sum plus
    the source's offset crosses. The offset comes from ``seed`` and the source: reruns agree.

    Prefix sums are taken in parts (size class and two hex digits of the hashed id), then over the parts of a
    source, at most some hundred thousand whatever the input; a source of a third of all rows is spread over them. Texts are split once and
    not shuffled; ``keep`` is written and ranked with the sizes, so it should be small, such as a row's number.

    Needs columns doc_id, text and source; others are ignored unless in ``keep``. Text null or empty: size 0, taken 0. A
    null source is a source, last in order. doc_id null, repeated rows: lined up like others; which of equal
    rows gets a copy more is open, the rows returned are the same. A source without words: target 0. Empty table: no rows.
    """
    size = F.size(words(F.col("text").cast("string"))).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.when(F.col("doc_id").isNull(), F.col("text").cast("string")).alias("text"), *keep)
    base = base.withColumn("class", _size_class(F.col("size"))).withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text"), F.md5("text")), F.lit(""))))
    # One key of the part, never null, so that ranking and the join below share one exchange of the rows.
    part = F.md5(F.concat_ws("|", F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source")), "class", F.substring("h", 1, 2)))
    base = base.withColumn("part", F.substring("h", 1, 2)).withColumn("key", part)
    light = written(base.select("doc_id", "source", "size", "class", "h", "part", "key", *keep), "sizes")
    parts = written(light.groupBy("key", "source", "class", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "parts")
    targets = written(source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs), "targets")
    order = Window.partitionBy("source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("key", "source", "before")
    known = ahead.join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t"))).drop("t")
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("\x00")))), 1, 5), 16, 10).cast("double") / 1048576
    known = known.withColumn("offset", offset).drop("source")
    within = F.row_number().over(Window.partitionBy("key").orderBy("h", "size", "doc_id")) - 1
    placed = light.withColumn("own", within).join(known, "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("own") + F.col("before")
    crossed = F.floor(F.col("offset") + (place + 1) * rate) - F.floor(F.col("offset") + place * rate)
    copies = F.least(crossed, F.lit(epochs)).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


MIX_SQL = r"""
WITH base AS (
  SELECT doc_id, source,
    CAST(len(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '')) AS BIGINT) AS size,
    md5(CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight
  FROM base GROUP BY source),
lev AS (
  SELECT s.source, s.source_size, s.weight, s.source_size * 3.0 / s.weight AS cap FROM src s),
cand AS (
  SELECT c.cap,
    ((SELECT sum(source_size) FROM lev) - coalesce((SELECT sum(3 * source_size) FROM lev l WHERE l.cap <= c.cap), 0))
      / nullif((SELECT sum(weight) FROM lev l WHERE l.cap > c.cap), 0) AS level
  , lead(c.cap) OVER (ORDER BY c.cap) AS next_cap
  FROM (SELECT DISTINCT cap FROM lev UNION ALL SELECT -1) c),
fit AS (SELECT max(level) AS level FROM cand WHERE level >= cap AND (next_cap IS NULL OR level < next_cap)),
tgt AS (
  SELECT source, source_size, CAST(least(source_size * 3.0, weight * (SELECT level FROM fit)) AS DOUBLE) AS target FROM lev),
ord AS (
  SELECT b.doc_id, b.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY b.source ORDER BY
      greatest(length(bin(b.size + 1)) - 5, 0) * 32 + ((b.size + 1) >> CAST(greatest(length(bin(b.size + 1)) - 5, 0) AS BIGINT)), b.h, b.size, b.doc_id) - 1 AS k,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix-1|' || coalesce(b.source, chr(0))), 1, 5)) AS BIGINT) / 1048576.0::DOUBLE AS u
  FROM base b JOIN tgt t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(u + (k + 1) * rate) - floor(u + k * rate), 3) AS BIGINT) * size AS taken
FROM ord
"""
