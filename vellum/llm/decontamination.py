"""Benchmark decontamination by q-gram lemma filtering.

A region within e edits of an item of m characters shares at least m - q + 1 - q*e of the item's q-grams
with it, all within e diagonals. So shared character q-grams are counted in overlapping bands of diagonals;
bands that reach the bound are verified by banded alignment. Items longer than a window are looked for by overlapping windows, so
that a long excerpt is found as well as the whole."""

from __future__ import annotations

import functools
import pickle
import zlib
from bisect import bisect, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import slices, written

Q = 12
#: Edits allowed, as a share of an item's characters.
EDIT_SHARE = 0.05
#: Characters of a window; windows of an item begin half a window apart.
WINDOW = 128
#: Characters of benchmark held by a task at a time (some 20 bytes each); a larger benchmark takes several passes over the documents.
BLOCK_CHARS = 4 << 20
#: Pairs of a text's and an item's equal q-grams that are looked at together.
PAIRS = 1 << 20


@functools.cache
def _folded() -> np.ndarray:
    """Lower-case form of each code point below 0x10000; a space for what is neither letter nor digit."""
    out = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        out[i] = ord(c.lower()) if c.isalnum() and len(c.lower()) == 1 else (i if c.isalnum() else 32)
    out[0xFFFE] = 0xFFFE  # the mark between texts
    return out


def normalised(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits in lower case, with one space for each run of others; and where each came from."""
    low = np.where(codes < 0x10000, _folded()[np.minimum(codes, 0xFFFF)], codes)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    at = np.flatnonzero(keep)
    return low[at], at


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    m = len(codes) - q + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for j in range(q):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += codes[j : j + m]
    acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    return acc ^ (acc >> np.uint64(29))


@dataclass(frozen=True)
class Index:
    """Windows of items, each an item of its own here. An item of up to WINDOW characters is one."""

    ids: list[int]
    texts: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray  # least number of shared q-grams
    grams: list[np.ndarray]  # of each window, by place
    size: np.ndarray  # of each window's q-grams
    posted: dict[int, tuple[np.ndarray, np.ndarray]]  # by that size: distinct (q-gram, window), sorted
    sieve: np.ndarray


def gram_size(length: int, edits: int, q: int = Q) -> int:
    """The largest size up to ``q`` of which text within ``edits`` must still share one: size * (edits + 1) <= length."""
    return max(1, min(q, length // (edits + 1)))


def index(items: list[tuple[int, str]], q: int = Q, share: float = EDIT_SHARE, window: int = WINDOW) -> Index:
    ids, texts, edits, need, grams, size = [], [], [], [], [], []
    for name, raw in items:
        codes = normalised(_codes(raw))[0]
        codes = codes[1:] if len(codes) and codes[0] == 32 else codes
        codes = codes[:-1] if len(codes) and codes[-1] == 32 else codes
        last = max(0, len(codes) - window)
        for at in [*range(0, last, max(1, window // 2)), last] if len(codes) else []:
            part = codes[at : at + window]
            m = len(part)
            e = int(share * m)
            own = gram_size(m, e, q)
            ids.append(name)
            texts.append(part)
            edits.append(e)
            need.append(m - own + 1 - own * e)
            grams.append(_qgrams(part, own))
            size.append(own)
    sieve = np.zeros(1 << 20, bool)
    posted = {}
    for own in sorted(set(size)):
        some = [k for k in range(len(ids)) if size[k] == own]
        keys, item = np.concatenate([grams[k] for k in some]), np.repeat(some, [len(grams[k]) for k in some]).astype(np.int32)
        sieve[(keys & np.uint64(len(sieve) - 1)).astype(np.int64)] = True
        order = np.lexsort((item, keys))
        keys, item = keys[order], item[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (item[1:] != item[:-1]))
        posted[own] = keys[new], item[new]
    return Index(ids, texts, np.array(edits, np.int64), np.array(need, np.int64), grams, np.array(size, np.int64), posted, sieve)


def aligned(item: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """Least edits between the item and any part of the region that begins in its first 2*edits+1 characters,
    if within ``edits``: (edits, first, past the last). Banded: cells off the band's diagonals aren't computed."""
    width, m = 4 * edits + 1, len(item)
    padded = np.full(m + width + 1, 0xFFFFFFFF, np.uint32)
    padded[: min(len(region), m + width)] = region[: m + width]
    inf = np.int32(1 << 20)
    cost = np.zeros(width, np.int32)  # cost[d]: item[:i] against region ending at i + d
    begin = np.arange(width)
    for i in range(m):
        sub = cost + (padded[i : i + width] != item[i])
        up, up_begin = np.append(cost[1:] + 1, inf), np.append(begin[1:], 0)
        own = np.where(up < sub, up_begin, begin)
        best = np.minimum(sub, up)
        run = np.minimum.accumulate(best - np.arange(width, dtype=np.int32)) + np.arange(width, dtype=np.int32)
        src = np.maximum.accumulate(np.where(best - np.arange(width) == run - np.arange(width), np.arange(width), 0))
        begin = own[src]
        cost = run.astype(np.int32)
        if cost.min() > edits:
            return None
    ends = m + np.arange(width)
    cost = np.where(ends <= len(region), cost, inf)
    d = int(cost.argmin())
    return (int(cost[d]), int(begin[d]), m + d) if cost[d] <= edits else None


def _candidates(shared: np.ndarray, known: Index, q: int) -> list[int]:
    """Windows of which the text has distinct q-grams enough to reach their bound anywhere. Each distinct q-gram of the text is
    looked up once, so what this holds is bounded by the index, however often a phrase stands in the text."""
    keys, item = known.posted[q]
    own = np.unique(shared)
    lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
    n = hi - lo
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    seen = np.bincount(item[at], minlength=len(known.ids))
    # ``need`` counts places; a q-gram that a window repeats may cover several of them
    few = known.need - (np.array([len(g) for g in known.grams]) - np.bincount(item, minlength=len(known.ids)))
    return np.flatnonzero((seen >= np.maximum(few, 1)) & (known.size == q)).tolist()


def _bordered(codes: np.ndarray, first: int, past: int) -> bool:
    """Whether a part of normalised text begins and ends with a word."""
    outside = (32, 0xFFFE)
    return (first == 0 or int(codes[first - 1]) in outside) and (past >= len(codes) or int(codes[past]) in outside)


def _of_item(codes: np.ndarray, places: np.ndarray, shared: np.ndarray, k: int, known: Index) -> list[tuple[int, int, int]]:
    """(first, past the last, edits) of window ``k`` in the text; ``shared`` are its q-grams that windows may have, at ``places``."""
    text, own, e, need = known.texts[k], known.grams[k], int(known.edits[k]), int(known.need[k])
    m = len(text)
    order = np.argsort(own, kind="stable")
    lo, hi = np.searchsorted(own[order], shared), np.searchsorted(own[order], shared, side="right")
    n = hi - lo
    stretch = 4 * (m + 4 * e + 4)
    if n.sum() > PAIRS and places[-1] - places[0] > 2 * stretch:  # a repetitive text: stretch by stretch, each longer than any region
        found = []
        for a in range(int(places[0]), int(places[-1]) + 1, stretch - 2 * (m + 2 * e + 2)):
            x, z = np.searchsorted(places, (a, a + stretch))
            found += _of_item(codes, places[x:z], shared[x:z], k, known) if z > x else []
        return found
    pos = np.repeat(places, n)
    place = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    # Bands are two steps wide and begin at each step, so that any e diagonals lie in one of them. First
    # the bands with hits enough at all, then those with enough distinct q-grams of the item.
    step = max(e, 1)
    low = (pos - place) // step
    band, diagonal, place = np.concatenate([low, low - 1]), np.tile(pos - place, 2), np.tile(place, 2)
    by = np.argsort(band, kind="stable")
    first = np.flatnonzero(np.append(True, band[by][1:] != band[by][:-1])) if len(by) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(by)))
    found = []
    for g in np.flatnonzero(size >= need).tolist():
        rows = by[first[g] : first[g] + size[g]]
        if len(np.unique(place[rows])) < need:
            continue
        straight, often = np.unique(diagonal[rows], return_counts=True)
        if not e:  # a short item: word by word, wherever it stands
            found += [(d, d + m, 0) for d in straight[often >= need].tolist() if d >= 0 and np.array_equal(codes[d : d + m], text) and _bordered(codes, d, d + m)]
            continue
        d = int(straight[often.argmax()])
        if d >= 0 and np.array_equal(codes[d : d + m], text):  # the diagonal of most shared q-grams: no edits
            found.append((d, d + m, 0))
            continue
        lead = int(band[rows[0]]) * step - e
        before = np.full(max(0, -lead), 0xFFFFFFFE, np.uint32)  # what is before the text equals nothing
        best = aligned(text, np.concatenate([before, codes[max(0, lead) : max(0, lead + m + 6 * e + 2)]]), e)
        if best is not None:
            found.append((max(0, lead + best[1]), lead + best[2], best[0]))
    return found


def _regions(codes: np.ndarray, known: Index) -> list[tuple[int, int, int, int]]:
    """(item id, first, past the last, edits) in normalised text. Of overlapping finds of a window the best stays; overlapping
    regions of one item's windows are one region, with the most edits of a window in it."""
    by_item: dict[int, list[tuple[int, int, int]]] = {}
    for q in known.posted:
        grams = _qgrams(codes, q)
        places = np.flatnonzero(known.sieve[(grams & np.uint64(len(known.sieve) - 1)).astype(np.int64)])
        shared = grams[places]
        for k in _candidates(shared, known, q):
            taken: list[tuple[int, int, int]] = []
            for hit in sorted(_of_item(codes, places, shared, k, known), key=lambda x: (x[2], x[0])):
                i = bisect(taken, hit)
                if (i == 0 or taken[i - 1][1] <= hit[0]) and (i == len(taken) or hit[1] <= taken[i][0]):
                    insort(taken, hit)
            by_item.setdefault(known.ids[k], []).extend(taken)
    out = []
    for name, hits in by_item.items():
        joined: list[tuple[int, int, int]] = []
        for a, z, e in sorted(hits):
            if joined and a < joined[-1][1]:
                joined[-1] = joined[-1][0], max(z, joined[-1][1]), max(e, joined[-1][2])
            else:
                joined.append((a, z, e))
        out += [(name, *x) for x in joined]
    return sorted(out)


@functools.lru_cache(1)
def _index_of(packed: bytes) -> Index:
    """Made by each Python worker from the texts, once for all its tasks of a pass."""
    return index(*pickle.loads(zlib.decompress(packed)))


def _scan(items: list[tuple[int, str]], q: int, share: float, window: int) -> Callable:
    packed = zlib.compress(pickle.dumps((items, q, share, window)), 1)
    gap = "\ufffe" * (int(share * window) + 2)  # more than any edit budget: no region spans two texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _index_of(packed)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        for batch in slices(batches, limit=1 << 20):
            texts = [(t or "").replace("\ufffe", " ") for t in batch.column("text").to_pylist()]
            begin = np.cumsum([0, *(len(t) + len(gap) for t in texts)])
            codes, origin = normalised(_codes("".join(t + gap for t in texts)))
            out: list[list[dict]] = [[] for _ in texts]
            for name, a, z, e in _regions(codes, known):
                first, last = int(origin[a]), int(origin[z - 1]) + 1
                i = int(np.searchsorted(begin, first, side="right")) - 1
                out[i].append({"item_id": name, "start": first - int(begin[i]), "end": last - int(begin[i]), "edits": e})
            others = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), pa.array(out, kind)], [*others, "regions"])

    return run


_REGIONS = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, window: int = WINDOW, block: int = BLOCK_CHARS, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, and regions: array of (item_id, start, end, edits) in code points of the text.

    A region is a part of the text within floor(share * m) edits of the m characters of a benchmark item, after
    lower-casing and turning each run of other characters than letters and digits into a space. An item of more than ``window``
    characters is looked for by windows of so many, half a window apart: an excerpt of one and a half windows (192 characters) is always found,
    one of a window or less is found where it holds a window; overlapping finds are one region. An item that is too short for an edit (below
    20 characters) must stand between word borders. Needs doc_id and text of
    ``docs``, item_id and text of ``benchmark``; others are ignored. Text null, or without letters and digits: no
    regions, and such items match nothing. doc_id null: scanned like others. Repeated rows: each is returned;
    repeated items are reported under the smallest item_id (-1 without one). Empty tables: no rows, or no regions.

    Up to ``block`` characters of benchmark, documents are read in one pass and nothing is shuffled. A larger benchmark is dealt
    into blocks of about so many; each is a pass of its own that writes only the rows with regions, which are put together in the end.
    ``carry`` keeps a column ``row``.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(["row"] if carry else []))
    items = benchmark.where("text is not null").groupBy(F.col("text").cast("string").alias("text")).agg(F.coalesce(F.min(F.col("item_id").cast("long")), F.lit(-1)).alias("item_id"))
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block))

    def scanned(rows: DataFrame, b: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()  # about ``block`` characters
        held = sorted((r["item_id"], r["text"]) for r in own)
        return rows.mapInArrow(_scan(held, q, share, window), rows.drop("text").withColumn("regions", F.array().cast(_REGIONS)).schema)

    if blocks == 1:
        return scanned(base, 0)
    numbered = written(base.withColumn("scanned", F.monotonically_increasing_id()), "scanned")
    hits = [written(scanned(numbered.select("scanned", "text"), b).where(F.size("regions") > 0), "hits") for b in range(blocks)]
    found = functools.reduce(DataFrame.unionByName, hits).groupBy("scanned").agg(F.array_sort(F.flatten(F.collect_list("regions"))).alias("regions"))
    out = numbered.drop("text").join(found, "scanned", "left").drop("scanned")
    return out.withColumn("regions", F.coalesce("regions", F.array().cast(_REGIONS)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, contaminated, kept, n_regions, item_ids (distinct, ascending), regions.
    See ``contaminated_regions``; a document with any region isn't kept."""
    found = contaminated_regions(docs, benchmark, **how).select("doc_id", "regions")
    size = F.size("regions")
    ids = F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["item_id"])))
    return found.select("doc_id", (size > 0).alias("contaminated"), (size == 0).alias("kept"), size.cast("long").alias("n_regions"), ids.alias("item_ids"), "regions")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all their columns, without a benchmark region; null doc_ids are judged by their own text.
    Cases as in ``contaminated_regions``."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    held = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("text").cast("string").alias("text"), row)
    found = contaminated_regions(held, benchmark, carry=True, **how)
    return found.where(F.size("regions") == 0).select("row.*")
