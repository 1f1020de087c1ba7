"""Token counts by offset-mapped attribution: each document is encoded once, whole; the tokens' character
spans are interval-joined to its sections, and a token that crosses a boundary is allocated by a stated rule."""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The pattern's matcher overflows its stack on a run of white space from some hundred thousand characters on: longer runs than this
#: are taken out of its way.
LONG_RUN = re.compile(r"[^\S\x1c-\x1f]{10000,}")


@functools.lru_cache(4)
def _encoder(vocabulary: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a compressed vocabulary file, and the bytes of each of its tokens."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in zlib.decompress(vocabulary).splitlines() if line.strip())}
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        width[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), width


def read_vocabulary(path: str) -> bytes:
    """The file, compressed, as it travels with the job: executors need no copy of their own."""
    with open(path, "rb") as f:
        return zlib.compress(f.read(), 9)


def encoded(text: str, encoder: tiktoken.Encoding) -> list[int]:
    """The tokens of the whole text. By the pattern, all of a run of white space but its last character is one piece where text
    follows, and the run is one piece at the end; so long runs are encoded as such pieces by themselves."""
    out: list[int] = []
    at = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encoder.encode_ordinary(text[at : run.start()])
        out += encoder._encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + encoder.encode_ordinary(text[at:])


def allocated(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, from the ends of tokens and of sections (both cover the same bytes in order).

    ``first``: a token counts where its first byte lies; ``last``: where its last byte lies; ``majority``: in
    the section with most of its bytes, the first of those.
    """
    begin = np.concatenate([[0], token_ends[:-1]])
    a = np.searchsorted(section_ends, begin, side="right")
    z = np.searchsorted(section_ends, token_ends - 1, side="right")
    if rule == "last":
        a = z
    elif rule == "majority":
        starts = np.concatenate([[0], section_ends[:-1]])
        for i in np.flatnonzero(a < z):
            k = np.arange(a[i], z[i] + 1)
            a[i] = k[(np.minimum(section_ends[k], token_ends[i]) - np.maximum(starts[k], begin[i])).argmax()]
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(a, minlength=len(section_ends))


def _counter(vocabulary: bytes, rule: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = _encoder(vocabulary)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                ids, number, first, past, tokens = [], [], [], [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    text = text or ""
                    lines = text.split("\n")
                    chars = np.cumsum([len(x) + 1 for x in lines])
                    chars[-1] -= 1
                    raw = chars if text.isascii() else np.cumsum([len(x.encode()) + 1 for x in lines]) - np.eye(1, len(lines), len(lines) - 1, dtype=np.int64)[0]
                    ends = np.cumsum(width[encoded(text, encoder)]) if text else np.empty(0, np.int64)
                    n = allocated(ends, raw, rule) if len(ends) else np.zeros(len(lines), np.int64)
                    ids.append(np.full(len(lines), -1 if doc is None else doc))
                    number.append(np.arange(len(lines)))
                    first.append(np.concatenate([[0], chars[:-1]]))
                    past.append(chars)
                    tokens.append(n)
                nulls = np.repeat(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False), [len(x) for x in ids])
                cols = [pa.array(np.concatenate(ids), pa.int64(), mask=nulls), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (number, first, past, tokens))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "section", "start", "end", "n_tokens"])

    return run


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """One row per section of each document: doc_id, section, start, end (code points), n_tokens.

    A section is a line with its newline. The sections of a document share out all tokens of its encoding: see
    ``allocated`` for the rules. ``vocabulary`` is a path that the driver reads; the file travels with the job. Needs
    columns doc_id and text; others are ignored. Text null or empty: one empty section without tokens.
    doc_id null: counted. Repeated rows: each is counted. Empty table: no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_counter(read_vocabulary(vocabulary), rule), "doc_id long, section long, start long, end long, n_tokens long")
