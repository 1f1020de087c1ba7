"""Prefix trie of conversations, built a depth at a time: live conversations are grouped by their node and their
next turn, and the smallest conv_id names the new node; joins level by level then roll up leaves and savings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import spread_join, written
from vellum.llm.ranks import ranked

#: Conversations of a family share the first turns of its first one, up to SHARED - 1 of them.
FAMILY, SHARED = 5, 9
#: Ids that are joined to one string before they are hashed, and tail nodes that are made from one row.
CHUNK = 4096
NOTHING = hashlib.sha256().hexdigest()


def _borrowed(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, total, digest, bytes): the turns in order, from 0; a turn is its role and text, by SHA-256.

    Null turn numbers come first; turns of the same number are ordered by their digests.
    """
    role, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, said), 256)).alias("digest"), F.octet_length(said).cast("long").alias("bytes"),
    )
    return written(ranked(written(own, "said"), "conv_id", ["turn", "digest"], "said").select("conv_id", "pos", "total", "digest", "bytes"), "turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation after the exchange of its beginning: (conv_id, n_turns) and (conv_id, depth, digest, bytes), depth from 1.

    The first h turns are those of the family's first conversation (all if it has fewer, none if it is absent), the rest its own
    after its first h; h is the CRC of the decimal conv_id modulo SHARED. Turns lie by depth, so a level reads its own files.
    """
    said = turns(conversations)
    sizes = written(said.groupBy("conv_id").agg(F.max("total").alias("own")), "sizes")
    h = _borrowed(F.col("conv_id"))
    family = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    first = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    taken = F.least(h, F.coalesce("of_base", F.lit(0)))
    left = F.greatest(F.col("own") - h, F.lit(0))
    known = written(family.join(first, "base", "left").select("conv_id", "base", taken.alias("taken"), left.alias("left"), (taken + left).alias("n_turns")), "convs")
    begun = said.where((F.col("pos") < SHARED - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    lent = begun.join(known.where("taken > 0"), "base").where("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "bytes")
    rest = written(said.where(F.col("pos") >= h), "rest")
    kept = spread_join(rest, known.select("conv_id", "taken", "left"), "conv_id", rows_of="left")
    kept = kept.select("conv_id", (F.col("taken") + F.col("pos") - h + 1).alias("depth"), "digest", "bytes")
    by_depth = written(lent.unionByName(kept).repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "by-depth")
    return known.select("conv_id", "n_turns"), by_depth


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's ids arrive as strings in order; one hash is held at a time."""
    at, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids"))):
            if at == (depth, node):
                state.update(b",")
            else:
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["depth", "node", "ends_sha256"])
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], ["depth", "node", "ends_sha256"])


def endings(ends: DataFrame) -> DataFrame:
    """(depth, node, conv_id) to (depth, node, ends_sha256): the hash of a node's ids, ascending, joined by commas.

    A hash is serial by nature; what it reads is joined to strings of CHUNK ids first, so a node with a third of all ids sends few rows
    to the task that hashes it, which holds one string at a time.
    """
    keyed = written(ends.select(F.concat_ws("-", "depth", "node").alias("of"), "depth", "node", "conv_id"), "ends")
    placed = ranked(keyed, "of", ["conv_id"], "ends").withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = placed.groupBy("depth", "node", "chunk").agg(ids.alias("ids"))
    return chunks.repartition("depth", "node").sortWithinPartitions("depth", "node", "chunk").select("depth", "node", "ids").mapInArrow(_hashed, "depth long, node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    A node is a distinct sequence of first turns, named by its depth and its smallest member. A depth takes a round of a few jobs
    over the conversations that still share their node; one that is alone leaves, and the rest of its turns becomes a tail of nodes
    without a round. So rounds are as many as the deepest shared turn, however long a conversation is; copies that share thousands of turns
    take as many rounds. A hot node's members are counted where they lie and joined to it in parts.

    Needs columns conv_id, turn, role and text; others are ignored. Null role or text: empty. Null conv_id: no conversation, the row is
    ignored. Null turns come first; of turns with the same number the digests decide. Repeated rows: each is a turn. A conversation whose
    rebuilt form has no turn is a member of the root, which then ends it. Empty table: no rows. Texts are hashed where they
    lie, whole; only digests are shuffled.
    """
    spark = conversations.sparkSession
    convs, by_depth = rebuilt(conversations)
    total = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    shape = "conv_id long, depth long, parent_conv_id long, n_convs long, bytes long"
    root = spark.createDataFrame([(total["root"], 0, None, total["n"], 0)] if total["n"] else [], shape)
    live = written(convs.select("conv_id", "n_turns", F.lit(total["root"]).cast("long").alias("node"), F.lit(0).cast("long").alias("depth")), "live")
    shared, alone, lives, d = [root], [], [live], 0
    while not live.where(F.col("n_turns") > d).isEmpty():
        d += 1
        said = by_depth.where(F.col("depth") == d).select("conv_id", "digest", "bytes")
        key = F.concat(F.col("node").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("digest"))
        step = written(live.where(F.col("n_turns") >= d).join(said, "conv_id").select("conv_id", "n_turns", "node", key.alias("key"), "bytes"), "step")
        nodes = step.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("node").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("n_turns").alias("n_turns"))
        nodes = written(nodes.withColumn("depth", F.lit(d).cast("long")), "nodes")
        many = nodes.where("n_convs > 1")
        live = spread_join(step, many.select("key", F.col("conv_id").alias("child"), "n_convs"), "key", rows_of="n_convs")
        live = written(live.select("conv_id", "n_turns", F.col("child").alias("node"), F.lit(d).cast("long").alias("depth")), "live")
        shared.append(many.select("conv_id", "depth", "parent_conv_id", "n_convs", "bytes"))
        alone.append(nodes.where("n_convs = 1").select("conv_id", "depth", "parent_conv_id", "n_turns"))
        lives.append(live)

    rolled, below = [], None
    for k in range(len(shared) - 1, -1, -1):
        own = (F.col("n_convs") - 1) * F.col("bytes")
        if k < len(alone):
            single = alone[k].select(F.col("parent_conv_id").alias("conv_id"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
            under = single if below is None else single.unionByName(below.select(F.col("parent_conv_id").alias("conv_id"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
            sums = under.groupBy("conv_id").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("below"))
            node = shared[k].join(sums, "conv_id", "left")
        else:
            node = shared[k].select("*", *(F.lit(None).cast("long").alias(c) for c in ("n_children", "n_leaves", "below")))
        saved = (own + F.coalesce("below", F.lit(0))).alias("saved_tokens")
        below = written(node.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), saved), "rolled")
        rolled.append(below)

    def joined(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for x in tables[1:]:
            out = out.unionByName(x)
        return out

    ended = endings(joined(lives).where("n_turns = depth").select("depth", "node", "conv_id"))
    inner = joined(rolled).join(ended.withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not alone:
        return inner.select(columns)
    tails = joined(alone).withColumn("from", F.explode(F.expr(f"sequence(depth, n_turns, {CHUNK}L)"))).repartition("conv_id", "from")
    tails = tails.withColumn("at", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK - 1, "n_turns"))))
    last = F.col("at") == F.col("n_turns")
    one = lambda n: F.lit(n).cast("long")
    tail = tails.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one(1).alias("n_convs"),
        F.when(last, one(0)).otherwise(one(1)).alias("n_children"), one(1).alias("n_leaves"), one(0).alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )
    return inner.select(columns).unionByName(tail)
