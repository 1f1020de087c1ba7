"""MinHash near-dedup: universal hash minima, banding, signature verification, and connected
components by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import maybe_among, mixed, slices, split_words, spread_join, whole_windows, window_hashes, word_hashes, written

WIDTH = 5
BANDS, ROWS = 24, 5
#: Least share of equal minima for a pair to be compared in full. At a similarity of 0.8 the share
#: of 120 minima is below this with a chance under 1e-6.
SIGNATURE_SHARE = 0.6
#: Rounds of comparing a bucket with one of its members.
STARS = 3
#: Cells of the sketch that orders shingles by rarity, and how many travel together.
CELLS, BLOCK = 1 << 20, 1 << 10
_SEED = np.random.default_rng(20240229)
_MUL = _SEED.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles (lower case), and where each text's begin. A text with fewer words has
    one shingle, its whole word sequence; one without words has none."""
    flat, starts = split_words(text, lower=True)
    h = word_hashes(flat)
    inside = whole_windows(starts, width)
    wide = window_hashes(h, width)
    count = np.diff(starts)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(at[-1]), np.uint64)
    short = np.zeros(len(out), bool)
    few = np.flatnonzero((count > 0) & (count < width))
    short[at[few]] = True
    out[~short] = wide[inside]
    out[short] = [xxhash.xxh3_64_intdigest(h[starts[i] : starts[i + 1]].tobytes()) for i in few]
    return out, at


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out, at = shingles(batch.column("text"))
        n = batch.num_rows
        size, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n):
            if at[i + 1] > at[i]:
                own = np.unique(out[at[i] : at[i + 1]])
                size[i] = len(own)
                digest = xxhash.xxh3_128_digest(own.tobytes())
                lo[i], hi[i] = np.frombuffer(digest, np.int64)
        full = np.flatnonzero(size)
        minima = np.zeros((n, BANDS * ROWS), np.uint32)
        if len(full):
            spread = mixed(out.copy())
            for k in range(BANDS * ROWS):
                minima[full, k] = np.minimum.reduceat(spread * _MUL[k] + _ADD[k], at[full]) >> np.uint64(32)
        keys = np.zeros((n, BANDS), np.uint64)
        for b in range(BANDS):
            acc = np.full(n, b + 1, np.uint64)
            for r in range(ROWS):
                acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + minima[:, b * ROWS + r])
            keys[:, b] = acc
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size), pa.array(lo), pa.array(hi), lists, pa.array([m.tobytes() for m in minima], pa.binary())],
            ["doc_id", "n_shingles", "set_lo", "set_hi", "bands", "signature"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to set size, a 128-bit hash of the set, band keys and the signature."""
    schema = "doc_id long, n_shingles long, set_lo long, set_hi long, bands array<long>, signature binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_signatures, schema)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in ("sig_rep", "sig_hub"))
        good = (a == b).mean(axis=1) >= SIGNATURE_SHARE
        yield batch.filter(pa.array(good)).select(["rep", "hub"])


def _linked(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                sets: list[list[np.ndarray]] = []
                for c in ("text_rep", "text_hub"):
                    col = batch.column(c).dictionary_encode()  # a hub's text stands in many rows: one set for all
                    out, at = shingles(col.dictionary)
                    own = [np.unique(out[at[i] : at[i + 1]]) for i in range(len(col.dictionary))]
                    sets.append([own[i] for i in col.indices.to_pylist()])
                good = np.zeros(batch.num_rows, bool)
                for i, (x, y) in enumerate(zip(*sets)):
                    small, large = sorted((len(x), len(y)))
                    if 100 * small >= threshold * large > 0:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        good[i] = 100 * both >= threshold * (small + large - both)
                yield batch.filter(pa.array(good)).select(["rep", "hub"])

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable, by alternating large-star and
    small-star until the links stop changing. Rounds grow with the logarithm of the nodes; every round is
    written to the shared folder, and no group is gathered: only minima per node are."""
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A hub's links are counted with its minimum, so that they are dealt over salts where they are many.
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "low")
        large = spread_join(both.where("v > u"), low, "u", rows_of="n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = spread_join(large, least, "u", rows_of="n").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = written(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        state = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.uint32)
    for batch in slices(batches):
        out, at = shingles(batch.column("text"))
        row = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(at))
        both = np.unique(np.column_stack([row, out]), axis=0)[:, 1] if len(out) else out
        counts += np.bincount((both % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint32)
    blocks = counts.reshape(-1, BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[b].tobytes() for b in some], pa.binary())], ["block", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            total[b] = total.get(b, 0) + np.frombuffer(raw, np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.uint32).tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def _rarity(texts: DataFrame) -> np.ndarray:
    """How often shingles of each of CELLS hash cells occur: of fixed size, whatever the input."""
    schema = "block int, counts binary"
    out = np.zeros((CELLS // BLOCK, BLOCK), np.uint32)
    for r in texts.select("text").mapInArrow(_sketched, schema).repartition("block").mapInArrow(_summed, schema).collect():  # CELLS numbers
        out[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def _prefixes(rarity: np.ndarray, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            out, at = shingles(batch.column("text"))
            keep, size, length = [], [], []
            for i in range(batch.num_rows):
                own = np.unique(out[at[i] : at[i + 1]])
                n = len(own)
                first = n - -(-threshold * n // 100) + 1 if n else 0
                keep.append(own[np.lexsort((own, rarity[(own % np.uint64(CELLS)).astype(np.int64)]))[:first]])
                size.append(first)
                length.append(n)
            rep, component = (np.repeat(batch.column(c).to_numpy(), size) for c in ("rep", "component"))
            place = np.concatenate([np.arange(k) for k in size])
            cols = [np.concatenate(keep).view(np.int64), rep, component, place.astype(np.int32), np.repeat(length, size).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shingle", "rep", "component", "place", "n"])

    return run


def _across(texts: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) in different components that can still be linked, whatever their bands.

    Two linked sets share one of the rarest shingles of each (all but ``threshold`` % of it, in one common order), and
    what stands from the first shared one on bounds what they share. For each shingle only those outside its
    most frequent component look for partners, so a large component is never paired with itself.
    """
    rows = written(texts.mapInArrow(_prefixes(_rarity(texts), threshold), "shingle long, rep long, component long, place int, n int"), "prefixes")
    usual = rows.groupBy("shingle", "component").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max_by("component", F.struct("c", "component")).alias("usual"), F.count("*").alias("components")).where("components > 1")
    named = lambda x: rows.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "component", "place", "n")))
    seekers = named("a").join(usual.select("shingle", "usual"), "shingle").where("component_a <> usual")
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    once = (F.col("component_b") == F.col("usual")) | (F.col("rep_a") < F.col("rep_b"))
    bound = 100 * most >= threshold * (F.col("n_a") + F.col("n_b") - most)
    other = named("b").withColumnRenamed("shingle", "of")
    pairs = seekers.join(other, (F.col("shingle") == F.col("of")) & (F.col("component_a") != F.col("component_b")) & once & bound)
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _sifted(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` may be among ``ids`` (rep), so that most other texts are not shuffled; the join that follows is exact."""
    return maybe_among(rows, key, ids.select("rep")).where("maybe").drop("maybe")


def near_duplicates(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * shared shingles >= ``threshold`` * all shingles of the two
    (5-word shingles, ASCII lower case). Equal sets are one class, with its smallest doc_id as representative.
    In each band bucket the representatives are compared with its best connected one, then those left over with the
    best connected of them, STARS times. Documents of buckets that are still in several components are
    then compared across components by an exact filter (``_across``). No bucket emits all its pairs.

    Needs columns doc_id and text; others are ignored. Text null or without words: no shingles, linked
    with nothing. doc_id null: component null, kept. Repeated rows: each is returned; texts with the same
    doc_id count as linked. Empty table: no rows.
    """
    own = written(signatures(docs), "signatures")
    classes = own.where("n_shingles > 0 and doc_id is not null").groupBy("set_lo", "set_hi").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes, "classes")  # so that the joins below can split a large class
    reps = own.select("set_lo", "set_hi", "doc_id", "bands").join(classes.select("set_lo", "set_hi", F.col("rep").alias("doc_id")), ["set_lo", "set_hi", "doc_id"], "left_semi")
    banded = written(reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")), "banded")
    shared = written(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = written(spread_join(banded, shared, "key", rows_of="n"), "members")
    degree = written(members.groupBy("rep").agg(F.sum("n").alias("degree")), "degree")
    whole = written(members.join(degree, "rep").select("key", "rep", "degree", F.col("rep").alias("component")), "active")
    signature = written(_sifted(own.select("doc_id", "set_lo", "set_hi", "signature"), "doc_id", degree).join(classes.select("set_lo", "set_hi", F.col("rep").alias("doc_id")), ["set_lo", "set_hi", "doc_id"], "left_semi").join(degree, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "signature"), "reps")
    text = written(_sifted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", degree).join(degree, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text"), "texts")
    found = docs.sparkSession.createDataFrame([], "node long, component long")

    def linked(close: DataFrame) -> DataFrame:
        # The hub's text comes last, so that it is not shuffled with each of its pairs; those of a hub with many are dealt over salts.
        close = written(close, "close")
        of_hub = close.groupBy("hub").agg(F.count("*").alias("n"))
        hub_text = written(text.select(F.col("rep").alias("hub"), F.col("text").alias("text_hub")).join(of_hub, "hub"), "hub-texts")
        texts = spread_join(close.join(text.select("rep", F.col("text").alias("text_rep")), "rep"), hub_text, "hub", rows_of="n")
        return texts.select("rep", "hub", "text_rep", "text_hub").mapInArrow(_linked(threshold), "rep long, hub long").withColumnsRenamed({"rep": "a", "hub": "b"})

    def merged(links: DataFrame) -> DataFrame:
        """``found`` after more links, which join the components found so far."""
        of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
        between = written(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")).where("a <> b").distinct(), "between")
        if between.isEmpty():
            return found
        to = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = found.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        known = moved.unionByName(to.select(F.col("component").alias("node"), F.col("to").alias("component")))
        return written(known.groupBy("node").agg(F.min("component").alias("component")), "components")

    def placed(rows: DataFrame) -> DataFrame:
        of = found.select(F.col("node").alias("rep"), F.col("component").alias("now"))
        return rows.join(of, "rep", "left").withColumn("component", F.coalesce("now", "rep")).drop("now")

    active = whole
    for _ in range(STARS):
        if active.isEmpty():
            break
        hubs = written(active.groupBy("key").agg(F.max_by(F.struct("rep", "component"), F.struct("degree", -F.col("rep"))).alias("h"), F.count("*").alias("n")).select("key", F.col("h.rep").alias("hub"), F.col("h.component").alias("other"), "n"), "hubs")
        met = spread_join(active, hubs, "key", rows_of="n").where("component <> other")
        # A pair once, whichever of the two is the hub, or both are.
        pairs = met.groupBy(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).agg(F.min("hub").alias("hub")).select(F.when(F.col("a") == F.col("hub"), F.col("b")).otherwise(F.col("a")).alias("rep"), "hub")
        pairs = written(pairs, "pairs")
        hub_signature = written(signature.select(F.col("rep").alias("hub"), F.col("signature").alias("sig_hub")).join(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hub"), "hub-signatures")
        signed = spread_join(pairs.join(signature.select("rep", F.col("signature").alias("sig_rep")), "rep"), hub_signature, "hub", rows_of="n")
        found = merged(linked(signed.select("rep", "hub", "sig_rep", "sig_hub").mapInArrow(_alike, "rep long, hub long")))
        of_hub = written(placed(hubs.select("key", "n", F.col("hub").alias("rep"))).select("key", "n", F.col("component").alias("other")), "of-hub")
        active = written(spread_join(placed(active), of_hub, "key", rows_of="n").where("component <> other").drop("other", "n"), "active")
    apart = placed(whole).groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_ = written(placed(whole).join(apart, "key", "left_semi").select("rep", "component").distinct(), "open")
    if not open_.isEmpty():
        across = _across(text.join(open_, "rep").select("rep", "component", "text"), threshold)
        found = merged(linked(across.withColumnsRenamed({"a": "rep", "b": "hub"})))
    # Sets of many documents are dealt over salts; documents without words, which may be as many, have no class to join.
    set_ = F.struct("set_lo", "set_hi").alias("set")
    final = written(classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(set_, F.coalesce("component", "rep").alias("component"), "n"), "final")
    out = spread_join(own.where("n_shingles > 0").select("doc_id", "n_shingles", set_), final, "set", "left", rows_of="n").select("doc_id", "n_shingles", "component")
    out = out.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    linked_to: Column = F.coalesce("component", "doc_id")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(linked_to)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
