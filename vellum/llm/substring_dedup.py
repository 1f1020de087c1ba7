"""Substring dedup over difference-cover anchors.

A 13-word window that stands in two documents contains, at one of 7 shifts, a 7-word anchor whose start is
in the cover {0, 1, 3} modulo 7 in both documents (every residue is a difference of two cover elements).
So only 3 of 7 anchors are hashed and matched across documents; then matches are extended: the 13-word
windows around shared anchors are hashed and resolved to the smallest document that holds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import SLICE_BYTES, partitions, slices, split_words, whole_windows, window_hashes, word_hashes

WIDTH = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WIDTH - PERIOD + 1
_ENTRY = "bucket int, kind int, docs binary, which binary, hashes binary"
_REPLY = "part long, docs binary, hashes binary"
#: Bits of an anchor's hash that go back to its document, where they only tell its own windows apart.
_LOW48 = np.uint64((1 << 48) - 1)
#: Bytes of a hash on its way to its bucket, and back: anchors (a false match only makes a window a candidate), and
#: windows, whose 96 bits decide.
ANCHOR_BYTES, WINDOW_BYTES = (5, 6), (12, 8)
#: Buckets for each shuffle partition, and groups of documents that replies go to. Spark sorts a task's rows by these, spilling where it
#: must, and Python holds one at a time.
SUB = 4
#: Replies that a task collects over its buckets before it packs them, so that small buckets don't make many small rows.
REPLIES = 1 << 20
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _pack(h: np.ndarray, width: int) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, with a key that is never null (rows without doc_id are dealt by their text), so that
    all passes read the one exchange."""
    schema = pa.schema([pa.field("key", pa.int64(), False), pa.field("doc_id", pa.int64()), pa.field("packed", pa.binary())])
    pack = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        texts = [pack.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
        ids = batch.column("doc_id").to_pylist()
        keys = pa.array([xxhash.xxh3_64_intdigest(t) >> 1 if x is None else x for x, t in zip(ids, texts)], pa.int64())
        yield pa.RecordBatch.from_arrays([keys, batch.column("doc_id"), pa.array(texts, pa.binary())], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches of rows with a doc_id, cut to some 5 MB of unpacked text and 50,000 rows, with the texts."""
    unpack = zstandard.ZstdDecompressor()
    for batch in slices(batches, "packed", SLICE_BYTES // 4):
        for lo in range(0, batch.num_rows, 50_000):
            part = batch.slice(lo, 50_000)
            part = part.filter(part.column("doc_id").is_valid())
            if not part.num_rows:
                continue
            yield part, pa.array([unpack.decompress(x) for x in part.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string())


def _groups(sorted_: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, past the last) of each run of equal values."""
    at = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.empty(0, np.int64)
    return zip(at.tolist(), np.append(at[1:], len(sorted_)).tolist())


def _entries(ids: np.ndarray, h: np.ndarray, second: np.ndarray | None, row: np.ndarray, buckets: int, groups: int, smaller: bool) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets of the hashes: each hash of a slice once, with the smallest document there that
    has it (kind 0), so that a very common hash makes one entry a slice. Documents whose hash is shared
    within the slice already get their answer here (kind 1, dealt by document). ``second`` makes the hashes 96 bits."""
    if not len(h):
        return
    width, back = ANCHOR_BYTES if second is None else WINDOW_BYTES
    order = np.lexsort((ids[row], h) if second is None else (ids[row], second, h))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if second is not None:
        second = second[order]
        new[1:] |= second[1:] != second[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least, most = ids[row[first]], ids[row[np.append(first[1:], len(h)) - 1]]
    settled = ids[row] > least[group] if smaller else (least < most)[group]
    own_h, own_row, multi = h[first], row[first], least < most
    bucket = (own_h % np.uint64(buckets)).astype(np.int64)
    out: list[tuple] = []
    by = np.argsort(bucket, kind="stable")
    for a, z in _groups(bucket[by]):
        pick = by[a:z]
        docs, which = np.unique(own_row[pick], return_inverse=True)
        marked = (which.astype("<u4") << 1 | multi[pick]).astype("<u4" if len(docs) > 32_000 else "<u2")
        raw = _pack(own_h[pick] // np.uint64(buckets), min(width, 8)) + (b"" if second is None else second[first[pick]].astype("<u4").tobytes())
        out.append((int(bucket[pick[0]]), 0, ids[docs].tobytes(), marked.tobytes(), raw))
    if settled.any():
        rows, hashes = row[settled], h[settled]
        by = np.argsort(rows, kind="stable")
        rows, hashes = rows[by], hashes[by]
        for a, z in _groups(rows):
            doc = int(ids[rows[a]])
            out.append((doc % groups, 1, doc.to_bytes(8, "little", signed=True), b"", _pack(np.unique(hashes[a:z] & _LOW48 if back == 6 else hashes[a:z]), back)))
    if out:
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["bucket", "kind", "docs", "which", "hashes"])


def _replies(buckets: int, groups: int, smaller: bool) -> Callable:
    """Of each bucket: for every entry whose hash other documents have too (``smaller``: smaller ones), its hash. Entries come
    sorted by bucket; one bucket is held at a time."""
    width, back = WINDOW_BYTES if smaller else ANCHOR_BYTES

    def send(doc: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each group of documents: the documents, and their hashes in turn."""
        group = doc % groups
        order = np.lexsort((h, doc, group))
        group, doc, h = group[order], doc[order], h[order]
        rows = [(int(group[a]), doc[a:z].tobytes(), _pack(h[a:z] & _LOW48 if back == 6 else h[a:z], back)) for a, z in _groups(group)]
        if rows:
            g, d, x = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(d, pa.binary()), pa.array(x, pa.binary())], ["part", "docs", "hashes"])

    def resolved(entries: list[tuple[int, bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Documents and hashes of a bucket's replies."""
        parts = []
        for bucket, docs, which, hashes in entries:
            n = len(hashes) // width
            h = _unpack(hashes[: n * min(width, 8)], min(width, 8)) * np.uint64(buckets) + np.uint64(bucket)
            second = np.frombuffer(hashes[n * 8 :], "<u4") if width == 12 else np.zeros(n, np.uint32)
            of = np.frombuffer(which, "<u2" if len(which) == 2 * n else "<u4").astype(np.int64)
            parts.append((h, second, np.frombuffer(docs, np.int64)[of >> 1], (of & 1).astype(bool)))
        h, second, doc, multi = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, second, h) if width == 12 else (doc, h))
        h, second, doc, multi = h[order], second[order], doc[order], multi[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (second[1:] != second[:-1])))
        size = np.diff(np.append(first, len(h)))
        least = np.repeat(doc[first], size)
        if smaller:
            good = doc > least
        else:
            most = np.repeat(doc[np.append(first[1:], len(h)) - 1], size)
            good = ((least < most) | np.repeat(np.logical_or.reduceat(multi, first), size)) & ~multi
        return doc[good], h[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, bytes]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            settled: list[tuple[int, bytes, bytes]] = []
            for bucket, kind, docs, which, hashes in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "docs", "which", "hashes"))):
                if kind:
                    settled.append((bucket, docs * (len(hashes) // back), hashes))
                    continue
                if held and held[0][0] != bucket:
                    found.append(resolved(held))
                    held = []
                    if sum(len(d) for d, _ in found) > REPLIES:
                        yield from send(*map(np.concatenate, zip(*found)))
                        found = []
                held.append((bucket, docs, which, hashes))
            if settled:
                g, d, x = zip(*settled)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(d, pa.binary()), pa.array(x, pa.binary())], ["part", "docs", "hashes"])
        if held:
            found.append(resolved(held))
        if found:
            yield from send(*map(np.concatenate, zip(*found)))

    return run


def _sorted_out(width: int) -> Callable:
    """The replies to the documents dealt to this task, a row for each document. They come sorted by group of documents; one group is held."""

    def put(parts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        doc = np.frombuffer(b"".join(d for d, _ in parts), np.int64)
        h = np.frombuffer(b"".join(x for _, x in parts), np.uint8).reshape(-1, width)
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        runs = list(_groups(doc))
        for lo in range(0, len(runs), 5_000):
            some = runs[lo : lo + 5_000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[[a for a, _ in some]]), pa.array([h[a:z].tobytes() for a, z in some], pa.binary())], ["key", "replies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, docs, hashes in zip(*(batch.column(c).to_pylist() for c in ("part", "docs", "hashes"))):
                if part != at and held:
                    yield from put(held)
                    held = []
                at = part
                held.append((docs, hashes))
        if held:
            yield from put(held)

    return run


def _hashed(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, starts = split_words(text)
    return word_hashes(flat), starts


def _anchors(buckets: int, groups: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in _texts(batches):
            h, starts = _hashed(text)
            n = np.diff(starts)
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(h)) - starts[row]
            wide = window_hashes(h, ANCHOR)
            m = len(wide)
            good = whole_windows(starts, ANCHOR) & np.isin(at[:m] % PERIOD, COVER) & (n[row[:m]] >= WIDTH)
            # Five bytes of a hash and its bucket are enough here: a false match only makes a window a candidate.
            yield from _entries(batch.column("doc_id").to_numpy(), wide[good] % np.uint64(buckets << 40), None, row[:m][good], buckets, groups, False)

    return run


def _near(h: np.ndarray, starts: np.ndarray, replies: list[bytes | None], buckets: int) -> np.ndarray:
    """Mask of the 13-word windows that contain a shared anchor of their document."""
    total = len(h)
    mask = np.zeros(max(0, total - WIDTH + 1), bool)
    wide = window_hashes(h, ANCHOR) % np.uint64(buckets << 40) & _LOW48
    for i, raw in enumerate(replies):
        if raw and starts[i + 1] - starts[i] >= WIDTH:
            a, z = int(starts[i]), int(starts[i + 1])
            own = wide[a : z - ANCHOR + 1]
            at = np.arange(len(own))
            hit = np.isin(own, _unpack(raw, 6)) & np.isin(at % PERIOD, COVER)
            step = np.zeros(len(own) + 1, np.int64)  # an anchor at p stands in the windows p-6 to p
            np.add.at(step, np.maximum(at[hit] - PERIOD + 1, 0), 1)
            np.add.at(step, at[hit] + 1, -1)
            mask[a : z - WIDTH + 1] = np.cumsum(step)[: z - a - WIDTH + 1] > 0
    return mask


def _candidates(buckets: int, groups: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in _texts(batches):
            h, starts = _hashed(text)
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            mask = _near(h, starts, batch.column("replies").to_pylist(), buckets)
            if mask.any():
                yield from _entries(batch.column("doc_id").to_numpy(), window_hashes(h, WIDTH)[mask], window_hashes(h, WIDTH, _SECOND)[mask] >> np.uint64(32), row[: len(mask)][mask], buckets, groups, True)

    return run


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in slices(batches, "packed", SLICE_BYTES // 4):
        n, gone, kept = [], [], []
        for raw, reply, named in zip(batch.column("packed"), batch.column("replies"), batch.column("doc_id")):
            own = unpack.decompress(raw.as_py()).split()
            count = len(own)
            removed = np.zeros(count, bool)
            if named.is_valid and reply.is_valid and count >= WIDTH:
                flat = pa.array(own, pa.large_binary())
                hit = np.isin(window_hashes(word_hashes(flat), WIDTH), _unpack(reply.as_py(), WINDOW_BYTES[1]))
                step = np.zeros(count + 1, np.int64)
                at = np.flatnonzero(hit)
                step[at] += 1
                np.add.at(step, at + WIDTH, -1)
                removed = np.cumsum(step[:-1]) > 0
                own = [w for w, x in zip(own, removed) if not x]
            n.append(count)
            gone.append(int(removed.sum()))
            kept.append(b" ".join(own).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a 13-word window over it also starts in a document with a smaller doc_id, judged on the
    input. Needs columns doc_id and text; others are ignored. Text null or empty: no words. doc_id null:
    nothing is removed, and nothing is removed because of it. Repeated rows (equal doc_id): neither
    is smaller, so both lose only what smaller documents have. Empty table: no rows.

    Texts are shuffled once, compressed, by document; each later pass joins them where they lie. Spark sorts the hashes of
    a task by bucket and its replies by group of documents, spilling where it must; Python holds one bucket or one group of SUB a partition at a
    time. Texts meet their replies, which are the shared hashes alone, in a hash join by document, whose map holds those of a partition's
    documents: sorting the texts instead took more memory than an executor of 3 GB has. That two documents have a window in common is decided by 96 bits.
    """
    parts = partitions(docs.sparkSession)
    buckets = groups = SUB * parts
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("doc_id", T.LongType()), T.StructField("packed", T.BinaryType())])
    dealt = base.mapInArrow(_packed, schema).repartition(parts, "key")

    def collected(entries: DataFrame, smaller: bool) -> DataFrame:
        replies = entries.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_replies(buckets, groups, smaller), _REPLY)
        sorted_out = _sorted_out(WINDOW_BYTES[1] if smaller else ANCHOR_BYTES[1])
        return replies.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(sorted_out, "key long, replies binary").hint("shuffle_hash")

    shared = collected(dealt.mapInArrow(_anchors(buckets, groups), _ENTRY), False)
    near = dealt.join(shared, "key").select("doc_id", "packed", "replies")
    covered = collected(near.mapInArrow(_candidates(buckets, groups), _ENTRY), True)
    out = dealt.join(covered, "key", "left").select("doc_id", "packed", "replies")
    return out.mapInArrow(_cleaned, "doc_id long, n_words long, n_removed long, kept_text string")
