"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and for each row the
siblings that prove it.

Levels are windows: nodes are partitioned by group and parent index, and the ordered list over the full frame
is both the parent's preimage and the siblings of each node; the first node of a run stands for the parent on the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import written
from vellum.llm.ranks import ranked

FAN = 16
#: Rows whose check value this number divides are tampered with by the query.
TAMPERED = 5
_HEX = 64


def framed(value: Column) -> Column:
    """A value in a leaf's preimage: its UTF-8 bytes' count, a colon, itself; ``-`` if null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown), F.lit(":"), shown), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def lowered(text: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def _digest(shown: Column) -> Column:
    return F.unhex(F.sha2(shown, 256))


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def levels(nodes: DataFrame, group: str, fan: int, label: str) -> list[DataFrame]:
    """Tables (group, pos, total, node, run, ...) from the leaves up: ``run`` has the digests of a node's whole run.

    ``nodes`` has group, pos, total and node (binary digest); its other columns stay on the first level. A group ends on the level
    where it has one node. Rounds grow with the logarithm of the largest group; every run has ``fan`` rows at most, so no task gathers a group.
    """
    found = []
    while True:
        run = Window.partitionBy(group, F.floor(F.col("pos") / fan)).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        listed = F.array_join(F.transform(F.collect_list("node").over(run), lambda x: F.hex(x)), "")
        level = written(nodes.withColumn("run", F.unhex(listed)), f"{label}-{len(found)}")
        found.append(level)
        if level.where("total > 1").isEmpty():
            return found
        # A parent once: the first node of its run stands for it.
        first = level.where((F.col("total") > 1) & (F.col("pos") % fan == 0))
        nodes = first.select(group, F.floor(F.col("pos") / fan).alias("pos"), F.ceil(F.col("total") / fan).alias("total"), _digest(_text(F.col("run"))).alias("node"))


def roots(found: list[DataFrame], group: str) -> DataFrame:
    """(group, node) of what remains of each group."""
    tops = [level.where("total = 1").select(group, "node") for level in found]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def proofs(found: list[DataFrame], group: str, above: DataFrame, fan: int, label: str) -> DataFrame:
    """The first level's rows with ``path``: for each level, from below, the siblings on the left and on the right.

    ``above`` has (group, path, ...) with what follows after the group's root; its other columns go down with it.
    """
    place = F.pmod(F.col("pos"), F.lit(fan)).cast("int") * 32
    sides = F.struct(F.substring("run", 1, place).alias("left"), F.substring("run", place + 33, fan * 32).alias("right"))
    carried = [c for c in above.columns if c not in (group, "path")]
    below = None
    for k in range(len(found) - 1, -1, -1):
        own = [c for c in found[k].columns if c not in (group, "pos", "total", "node", "run")] + (["node"] if not k else [])
        keep = [group, "pos", *own, "path", *carried]
        out = found[k].where("total = 1").join(above, group).select(keep)
        if below is not None:
            up = below.select(group, F.col("pos").alias("parent"), F.col("path").alias("rest"), *carried)
            many = found[k].where("total > 1").withColumn("parent", F.floor(F.col("pos") / fan)).join(up, [group, "parent"])
            out = out.unionByName(many.withColumn("path", F.array_prepend("rest", sides)).select(keep))
        below = out if not k else written(out, f"{label}-path-{k}")
    return below


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a node's digest (hex) and the siblings of its path."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(_text(s["left"]), acc, _text(s["right"])), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), ""), 256)


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", tampered: int = TAMPERED, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and path (the siblings, digests of 32 bytes).

    A leaf is the SHA-256 of the framed ``columns``. Leaves of a ``group`` ascend by ``order``; runs of ``fan`` become their parent while
    several nodes remain, the last run however short; subroots, by group, make the root likewise. folded_root starts from the
    leaf of a copy in which the text's capitals A to Z are small, where ``tampered`` divides the CRC of the decimal doc_id, and from the
    leaf itself elsewhere; verified says whether it meets the root, so a tampered text without a capital verifies.

    Needs the named columns; others are ignored. Null group: a group, the first one. Null doc_id: the first of its group, not tampered.
    Null values are framed as ``-`` and differ from empty ones. Repeated rows: each is a leaf; equal rows get the places of all of them, in
    any order; rows with the same doc_id that differ are placed by their leaves. Empty table: no rows. A very long text is hashed as one
    value where it lies; only digests are shuffled, each once a level, and a group is spread over tasks by range.
    """
    doc, text = F.col(order).cast("long"), F.col("text").cast("string")
    plain = [F.col(c) if c != "text" else text for c in columns]
    changed = [F.col(c) if c != "text" else lowered(text) for c in columns]
    touched = F.crc32(doc.cast("string").cast("binary")) % tampered == 0
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then by bytes
    leaves = written(docs.select(named.alias("key"), doc.alias("doc"), F.unhex(leaf(plain)).alias("node"), F.when(touched, F.unhex(leaf(changed))).alias("other")), "leaves")
    trees = levels(ranked(leaves, "key", ["doc", "node"], "leaves"), "key", fan, "tree")
    subroots = written(roots(trees, "key").select(F.lit(0).alias("all"), "key", "node"), "subroots")
    top = levels(ranked(subroots, "all", ["key"], "subroots"), "all", fan, "top")
    one = roots(top, "all").first()  # one digest
    root = F.lit("" if one is None else bytes(one["node"]).hex())
    sides = "array<struct<left:binary,right:binary>>"
    above = docs.sparkSession.range(1).select(F.col("id").cast("int").alias("all"), F.array().cast(sides).alias("path"))
    over = proofs(top, "all", above, fan, "top").select("key", "path", _text(F.col("node")).alias("subroot"))
    proven = proofs(trees, "key", written(over, "over"), fan, "tree")
    start = _text(F.coalesce("other", "node"))
    out = proven.select(F.col("doc").alias("doc_id"), _text(F.col("node")).alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(start, F.col("path")).alias("folded_root"), "path")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
