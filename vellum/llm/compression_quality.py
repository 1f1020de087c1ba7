"""Compression classifier: zstandard dictionaries built from good and bad labelled text; the normalised
difference of the compressed sizes becomes a calibrated score. The calibration weighs the difference by the length of the text,
and also looks at how well the good dictionary compresses the text at all."""

from __future__ import annotations

import base64
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a text that are compressed at a time, so that long texts weigh like short ones.
CHUNK = 2048
DICTIONARY_BYTES = 64 << 10
#: The bound of the fit: labelled rows of each class, by the order of their hashed ids.
FIT_ROWS = 3000
#: Of a longer text the fit sees so many pieces of CHUNK characters, evenly spread over the whole, so that bytes are bounded as rows are.
FIT_PIECES = 8
#: Bytes at which a text weighs half as much as a long one.
SHORT = 200
LEVEL = 3


@dataclass(frozen=True)
class Half:
    """Dictionaries of one half of the labelled rows, and weights fitted on the other."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


#: The score's logit is the mean of its halves'.
Model = tuple[Half, ...]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(raw) if raw else None
    if known is not None:
        known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def _trained(texts: list[bytes]) -> bytes:
    """A trained dictionary; with too little text for the trainer, the text itself."""
    pieces = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def features(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Of the whole text: size with the good less with the bad dictionary, by the sum of both; the good one's rate; and how far the
    text is from empty. A frame's fixed bytes don't count, so that a tiny text is as neutral as an empty one."""
    raw = (text or "").encode()
    fixed = len(good.compress(b"")), len(bad.compress(b""))
    g = b = 0
    for i in range(0, len(raw), CHUNK):
        piece = raw[i : i + CHUNK]
        g += max(0, len(good.compress(piece)) - fixed[0])
        b += max(0, len(bad.compress(piece)) - fixed[1])
    return (g - b) / max(g + b, 1), min(1.0, g / max(len(raw), 1)), len(raw) / (len(raw) + SHORT)


def _design(x: np.ndarray) -> np.ndarray:
    difference, rate, weight = 20 * x[:, 0], x[:, 1], x[:, 2]
    return np.column_stack([np.ones(len(x)), difference, difference * weight, weight, rate * weight])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def excerpt(text: Column, pieces: int = FIT_PIECES) -> Column:
    """A text of up to ``pieces`` * CHUNK characters as it is; of a longer one pieces from its beginning to its end."""
    n = F.length(text)
    at = lambda k: F.substring(text, F.floor((n - CHUNK) * k / (pieces - 1)).cast("int") + 1, F.lit(CHUNK))
    return F.when(n <= pieces * CHUNK, text).otherwise(F.concat(*(at(k) for k in range(pieces))))


def fit(docs: DataFrame, marked: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on docs (doc_id, text) and marked (doc_id, label 0 or 1): ``rows`` ids of each label at most, by hashed id.
    Each half of the rows builds dictionaries, which the other half calibrates. Without labelled rows of both kinds in a half the
    score is constant. Of a long text the fit sees an ``excerpt``: the driver gets 2 * ``rows`` * FIT_PIECES * CHUNK characters at most. Ids alone meet the labels; texts are then fetched for the chosen ids, and never shuffled before.
    """
    ids = docs.where("text is not null").select("doc_id").join(marked.where("label in (0, 1)"), "doc_id").distinct()
    known = ids.select("doc_id", "label", F.md5(F.col("doc_id").cast("string")).alias("h"))
    chosen = known.where("label = 0").orderBy("h", "doc_id").limit(rows).unionByName(known.where("label = 1").orderBy("h", "doc_id").limit(rows))
    found = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("label", "h", excerpt(F.col("text")).alias("text")).distinct().collect()  # bounded by ``rows`` and ``excerpt``
    found = sorted((r["h"], r["label"], r["text"]) for r in found)
    halves = [[(label, t) for _, label, t in found][k::2] for k in (0, 1)]
    model = []
    for own, rest in (halves, halves[::-1]):
        dictionary = [[t.encode() for label, t in own if label == k] for k in (0, 1)]
        if not all(dictionary) or not rest:
            return (Half(b"", b"", (0.0, 0.0, 0.0, 0.0, 0.0)),)
        bad, good = map(_trained, dictionary)
        tools = _dictionary(good), _dictionary(bad)
        x = np.array([features(t, *tools) for _, t in rest])
        model.append(Half(good, bad, tuple(_logistic(_design(x), np.array([float(label) for label, _ in rest])))))
    return tuple(model)


def scorer(model: Model) -> Callable:
    """mapInArrow function adding ``score`` to batches that have ``text``."""
    raw = base64.b64encode(pickle.dumps(model)).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = [(_dictionary(h.good), _dictionary(h.bad), np.array(h.weights)) for h in pickle.loads(base64.b64decode(raw))]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            logits = [_design(np.array([features(t, good, bad) for t in texts]).reshape(-1, 3)) @ w for good, bad, w in halves]
            score = 1 / (1 + np.exp(-np.clip(np.mean(logits, axis=0), -30, 30)))
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(score)], [*keep, "score"])

    return run


def held_out(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labels (doc_id, quality) outside fold 0 of 5 by crc32 of the id; scores every whole text by
    its compression alone: a logistic curve over the normalised difference of the two compressed sizes, the rate of the good
    dictionary, and the length, by which both are weighed. Needs columns doc_id and text of ``docs``; others are ignored. Text null or empty: a score
    from the fitted constant, which tiny texts are near to. doc_id null: scored, held_out null. Repeated rows: each is returned. Labels that
    are null or not 0 or 1, or that contradict each other, only add noise to the fit. Empty tables: no rows, or
    a score of 0.5.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(held_out(F.col("doc_id"), 5) != 0)
    model = fit(base, marked, rows)
    scored = base.mapInArrow(scorer(model), "doc_id long, score double")
    return scored.select("doc_id", (held_out(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all their columns, that score ``threshold`` or more. The fit and the cases are those of
    ``quality_scores``; the rows pass the scorer whole, so nothing is joined back."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(held_out(F.col("doc_id"), 5) != 0)
    score = scorer(fit(base, marked, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], ["text"])
            for scored in score(iter([text])):
                yield batch.filter(pa.array(scored.column("score").to_numpy() >= threshold))

    return docs.mapInArrow(run, docs.schema)
