"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores with a switching
penalty labels spans of mixed-language text."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import SLICE_BYTES, slices, split_words
from vellum.llm.compression_quality import held_out

#: The bound of the fit: about so many documents of each language, by their hashed ids.
FIT_ROWS = 800
ORDERS = (1, 2, 3, 4)
TABLE_BITS = 17
PENALTY = 4.0
SEGMENT = 256
#: Least share of a script among a language's letters for the language to be a candidate for words in it.
SCRIPT_SHARE = 0.01
# First and last code point of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x5D0, 0x5F2)],
    "arabic": [(0x620, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3041, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0xAC00, 0xD7A3), (0x1100, 0x11FF)],
}


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # n-gram hash x language: log probability
    allowed: np.ndarray  # script x language


@functools.cache
def _scripts() -> np.ndarray:
    """For each code point below 0x10000: 0 for no letter, the 1-based script, or the number of scripts + 1."""
    lookup = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        if chr(i).isalpha():
            lookup[i] = next((k for k, ranges in enumerate(SCRIPTS.values(), 1) if any(a <= i <= z for a, z in ranges)), len(SCRIPTS) + 1)
    return lookup


def _script_of(codes: np.ndarray) -> np.ndarray:
    out = _scripts()[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        out[i] = (len(SCRIPTS) + 1) * chr(codes[i]).isalpha()
    return out


def _grams(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Code points of the lower-cased words with a mark around each; for each order hashed grams and their word."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(codes == 2) - 1
    out = []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        acc = np.full(m, n * 0x9E3779B1, np.uint64)
        for j in range(n):
            acc = (acc ^ codes[j : j + m]) * np.uint64(0x100000001B3)
            acc ^= acc >> np.uint64(29)
        inside = word[:m] == word[n - 1 : n - 1 + m]
        out.append(((acc[inside] % np.uint64(1 << TABLE_BITS)).astype(np.int64), word[:m][inside]))
    return codes, out


_COUNTS = "lang string, block int, counts binary"
#: Cells of the table that travel in one row.
BLOCK = 1 << 12


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts of each language in blocks; block -1 counts the scripts of its letters."""
    cells: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in slices(batches, limit=1 << 20):
        for lang in batch.column("lang").unique().to_pylist():
            own = batch.column("text").filter(pc.equal(batch.column("lang"), lang)).to_pylist()
            text = "\n".join(own).lower().replace("\x02", " ").replace("\x03", " ")
            words = [w for w in text.split() if any(map(str.isalpha, w))]
            at = cells.setdefault(lang, np.zeros(1 << TABLE_BITS, np.int64))
            of = scripts.setdefault(lang, np.zeros(len(SCRIPTS) + 2, np.int64))
            if words:
                codes, grams = _grams(words)
                for h, _ in grams:
                    at += np.bincount(h, minlength=len(at))
                of += np.bincount(_script_of(codes), minlength=len(of))
    for lang in cells:
        blocks = [*cells[lang].reshape(-1, BLOCK), scripts[lang]]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(blocks)), pa.array([*range(len(blocks) - 1), -1], pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], ["lang", "block", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for lang, block, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "counts"))):
            total[lang, block] = total.get((lang, block), 0) + np.frombuffer(raw, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "block", "counts"])


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on (doc_id, text, lang): whole texts of about ``rows`` documents of each language, those with the least hashed ids. Texts are
    counted where they lie; the driver gets one table of fixed size for each language."""
    known = labelled.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    langs = tuple(sorted(r["lang"] for r in sizes))
    table = np.full((len(langs), 1 << TABLE_BITS), 0.02)
    scripts = np.zeros((len(SCRIPTS) + 2, len(langs)))
    if langs:
        rate = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, rows / r["n"])) for r in sizes], "lang string, rate double")
        place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / 2**32
        chosen = known.join(F.broadcast(rate), "lang").where(place < F.col("rate")).select("lang", "text")
        for r in chosen.mapInArrow(_counted, _COUNTS).repartition("lang", "block").mapInArrow(_summed, _COUNTS).collect():
            k, counts = langs.index(r["lang"]), np.frombuffer(r["counts"], np.int64)
            if r["block"] < 0:
                scripts[:, k] += counts
            else:
                table[k, r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += counts
    letters = scripts[1:].sum(axis=0)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(letters, 1)
    return Model(langs, np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32).copy(), allowed)


def word_scores(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word in each language, and whether it has a letter. A word without letters scores 0 in
    all. Languages that don't use the script of a word's letters are out, unless none does."""
    n, langs = len(words), len(model.langs)
    codes, grams = _grams([w.lower().replace("\x02", " ").replace("\x03", " ") for w in words])
    scores = np.zeros((n, langs), np.float32)
    for h, word in grams:
        at = np.searchsorted(word, np.arange(n))
        some = np.flatnonzero(np.bincount(word, minlength=n))
        if len(h):
            scores[some] += np.add.reduceat(model.table[h], at[some], axis=0) / len(ORDERS)
    word = np.cumsum(codes == 2) - 1
    script = _script_of(codes)
    lettered = np.zeros(n, bool)
    lettered[word[script > 0]] = True
    for k in range(1, len(SCRIPTS) + 2):
        use = model.allowed[k]
        if use.any() and not use.all():
            held = np.zeros(n, bool)
            held[word[script == k]] = True
            scores[held] -= 50.0 * ~use
        elif not use.any():
            only = np.zeros(n, bool)
            only[word[script == k]] = True
            scores[only] = 0
    scores[~lettered] = 0
    return scores - scores.max(axis=1, keepdims=True) if n else scores, lettered


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of each word: the sum of scores less ``penalty`` for each change within a text.

    Texts are cut into segments of SEGMENT words. All segments advance together, for every language they may
    be entered in; then segments are chained text by text, and traced back. The result equals the plain
    recursion's, and the loops are as long as a segment, and as the most segments of a text."""
    langs = scores.shape[1]
    count = np.diff(starts)
    pieces = -(-count // SEGMENT)
    first = np.concatenate([[0], np.cumsum(pieces)])
    total = int(first[-1])
    if not total:
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(total) - first[text]
    begin = starts[text] + nth * SEGMENT
    size = np.minimum(count[text] - nth * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    begin_o, size_o = begin[order], size[order]
    best = np.full((total, langs, langs), -np.inf, np.float32)
    best[:, np.arange(langs), np.arange(langs)] = 0
    back = []
    for t in range(int(size_o[0])):
        live = int(np.searchsorted(-size_o, -t, side="left"))
        now = best[:live]
        top = now.argmax(axis=2)
        change = np.take_along_axis(now, top[:, :, None], 2) - np.float32(penalty)
        stay = now >= change
        back.append(np.where(stay, np.arange(langs)[None, None, :], top[:, :, None]).astype(np.min_scalar_type(langs)))
        best[:live] = np.where(stay, now, change) + scores[begin_o[:live] + t][:, None, :]
    gain = np.empty_like(best)
    gain[order] = best
    value = np.zeros((len(count), langs), np.float32)
    entered = np.zeros((total, langs), np.int64)
    by = np.argsort(-pieces, kind="stable")
    for j in range(int(pieces.max())):
        docs = by[: int(np.searchsorted(-pieces[by], -j, side="left"))]
        way = value[docs][:, :, None] + gain[first[docs] + j]
        entered[first[docs] + j] = way.argmax(axis=1)
        value[docs] = way.max(axis=1)
    enter, leave = np.zeros(total, np.int64), np.zeros(total, np.int64)
    state = value.argmax(axis=1)
    for j in range(int(pieces.max()) - 1, -1, -1):
        docs = by[: int(np.searchsorted(-pieces[by], -j, side="left"))]
        seg = first[docs] + j
        leave[seg] = state[docs]
        enter[seg] = entered[seg, state[docs]]
        state[docs] = enter[seg]
    labels = np.zeros(len(scores), np.int64)
    now, entry = leave[order], enter[order]
    for t in range(len(back) - 1, -1, -1):
        live = back[t].shape[0]
        labels[begin_o[:live] + t] = now[:live]
        now[:live] = back[t][np.arange(live), entry[:live], now[:live]]
    return labels


def labeller(model: Model, penalty: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = len(model.langs)
        for batch in slices(batches, limit=max(1 << 16, SLICE_BYTES * 4 // max(4, langs * langs))):
            n = batch.num_rows
            flat, starts = split_words(batch.column("text"))
            coded = flat.dictionary_encode()
            index = coded.indices.to_numpy().astype(np.int64)
            if langs and len(flat):
                scores, lettered = word_scores(coded.dictionary.to_pylist(), model)
                labels = viterbi(scores[index], starts, penalty)
                counted = lettered[index]
                text = np.repeat(np.arange(n), np.diff(starts))
                share = np.zeros((n, langs))
                np.add.at(share, (text[counted], labels[counted]), 1.0)
                sums = np.zeros((n, langs))
                full = np.flatnonzero(np.diff(starts))
                sums[full] = np.add.reduceat(scores[index], starts[full], axis=0)
            else:
                share, sums, labels = np.zeros((n, max(langs, 1))), np.zeros((n, max(langs, 1))), np.zeros(0, np.int64)
            words = share.sum(axis=1)
            pick = (share + 1e-9 * (sums - sums.min(axis=1, keepdims=True)) / (1 + np.abs(sums).max(axis=1, keepdims=True))).argmax(axis=1)
            spans = []
            for i in range(n):
                a, z = int(starts[i]), int(starts[i + 1])
                if not words[i]:
                    spans.append([])
                    continue
                own = labels[a:z]
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                spans.append([{"start": int(s), "end": int(e), "lang": model.langs[own[s]]} for s, e in zip(at, np.append(at[1:], z - a))])
            named = [model.langs[k] if w else "und" for k, w in zip(pick, words)]
            score = share[np.arange(n), pick] / np.maximum(words, 1)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, pa.string()), pa.array(score), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return run


def languages(docs: DataFrame, rows: int = FIT_ROWS, penalty: float = PENALTY) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, spans.

    Learns from text and lang outside fold 2 of 4 by crc32 of the id; labels every word of every whole text.
    lang_pred is the language of most lettered words, score its share, spans the runs of words (first, past the last,
    language). Ties go to the better sum of scores, then to the first by name. Text null or without letters,
    or nothing to learn from: ``und``, score 0, no spans. doc_id null: labelled, held_out null. Repeated rows: each
    is returned. Columns besides doc_id, text and lang are ignored. Empty table: no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(base.where(held_out(F.col("doc_id"), 4) != 2), rows)
    found = base.select("doc_id", "text").mapInArrow(labeller(model, penalty), "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    return found.withColumn("held_out", held_out(F.col("doc_id"), 4) == 2).select("doc_id", "held_out", "lang_pred", "score", "spans")
