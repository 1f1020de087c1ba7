"""Measures of grey rasters: texture codes, gradients, recompression errors, straight edges.

A raster is (doc_id, pixels, width): bytes row by row; bytes after the last full row are left out. A raster below three rows or columns
has no measures, and its document no row. Kernels run over Arrow batches, a raster at a time and whole; what they give is summed and
joined by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The limit of an edge, of a large error, and the quantisation of luminance at quality 50.
EDGE, LARGE = 30.0, 10
LUMINANCE = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)
LEAST = 3


def _each(rasters: DataFrame, measure: Callable[[np.ndarray], dict], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """A row (doc_id, ...) of what ``measure`` gives for each raster."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            ids = []
            for doc, pixels, width in zip(batch.column("doc_id").to_pylist(), batch.column("pixels"), batch.column("width").to_pylist()):
                data = np.frombuffer(pixels.as_buffer() or b"", np.uint8) if pixels.is_valid else np.empty(0, np.uint8)
                if not width or width < LEAST or len(data) // width < LEAST:
                    continue
                found = measure(data[: len(data) // width * width].reshape(-1, width))
                ids.append(doc)
                for column, name in zip(rows, names):
                    column.append(found[name])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(rows, kinds))], ["doc_id", *names])

    flat = rasters.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("pixels").cast("binary").alias("pixels"), F.col("width").cast("int").alias("width"))
    return flat.mapInArrow(run, f"doc_id long, {schema}")


def _codes(grey: np.ndarray) -> np.ndarray:
    """Of each inner pixel a bit for each neighbour that is not darker, clockwise from the upper left one."""
    h, w = grey.shape
    centre = grey[1 : h - 1, 1 : w - 1]
    out = np.zeros(centre.shape, np.uint8)
    for bit, (r, c) in enumerate(((0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0))):
        out |= (grey[r : r + h - 2, c : c + w - 2] >= centre).astype(np.uint8) << np.uint8(bit)
    return out


def texture_codes(rasters: DataFrame) -> DataFrame:
    """(doc_id, intensity, texture): the counts of grey values and of local binary patterns, 256 of each."""
    def measure(grey: np.ndarray) -> dict:
        return {"intensity": np.bincount(grey.ravel(), minlength=256).tolist(), "texture": np.bincount(_codes(grey).ravel(), minlength=256).tolist()}

    return _each(rasters, measure, "intensity array<long>, texture array<long>", [pa.list_(pa.int64())] * 2)


def _magnitude(grey: np.ndarray) -> np.ndarray:
    """Sobel gradients; beyond the border pixels are mirrored about the outermost one."""
    wide = np.pad(grey.astype(np.int32), 1, "reflect")
    right, left = wide[:, 2:], wide[:, :-2]
    across = (right[:-2] + 2 * right[1:-1] + right[2:]) - (left[:-2] + 2 * left[1:-1] + left[2:])
    below, above = wide[2:], wide[:-2]
    down = (below[:, :-2] + 2 * below[:, 1:-1] + below[:, 2:]) - (above[:, :-2] + 2 * above[:, 1:-1] + above[:, 2:])
    return np.sqrt((across * across + down * down).astype(np.float64))


def gradients(rasters: DataFrame) -> DataFrame:
    """(doc_id, gradient_mean, gradient_std, gradient_p95, edge_density), to four decimals."""
    def measure(grey: np.ndarray) -> dict:
        m = _magnitude(grey)
        found = {"gradient_mean": m.mean(), "gradient_std": m.std(), "gradient_p95": np.percentile(m, 95), "edge_density": (m > EDGE).mean()}
        return {k: round(float(v), 4) for k, v in found.items()}

    return _each(rasters, measure, "gradient_mean double, gradient_std double, gradient_p95 double, edge_density double", [pa.float64()] * 4)


def quantisation(quality: int) -> np.ndarray:
    """The steps of the 64 coefficients at a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(LUMINANCE) * scale + 50) // 100, 1, 255).astype(np.float64)


_K = np.arange(8)
#: Rows of the orthonormal cosine transform.
COSINES = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))


def recompressed(grey: np.ndarray, quality: int) -> np.ndarray:
    """The raster after its 8 by 8 blocks' cosine coefficients were quantised. The last row and column fill incomplete blocks."""
    h, w = grey.shape
    full = np.pad(grey.astype(np.float64) - 128, ((0, -h % 8), (0, -w % 8)), "edge")
    blocks = full.reshape(full.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    steps = quantisation(quality)
    kept = np.rint(COSINES @ blocks @ COSINES.T / steps) * steps
    back = (COSINES.T @ kept @ COSINES).swapaxes(1, 2).reshape(full.shape)[:h, :w]
    return np.clip(np.rint(back + 128), 0, 255).astype(np.int16)


def recompression_errors(rasters: DataFrame, quality: int = 90) -> DataFrame:
    """(doc_id, mean_error, std_error, max_error, p95_error, high_error_pct): how far pixels move when the raster is compressed once
    more at that quality, from the block transform itself; no codec's chroma or rounding is imitated."""
    def measure(grey: np.ndarray) -> dict:
        e = np.abs(grey.astype(np.int16) - recompressed(grey, quality))
        four = lambda x: round(float(x), 4)
        return {"mean_error": four(e.mean()), "std_error": four(e.std()), "max_error": int(e.max()), "p95_error": four(np.percentile(e, 95)), "high_error_pct": four((e > LARGE).mean() * 100)}

    return _each(rasters, measure, "mean_error double, std_error double, max_error int, p95_error double, high_error_pct double", [pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()])


def edge_points(rasters: DataFrame, limit: float = 200.0) -> DataFrame:
    """(doc_id, x, y) of the pixels whose gradient is above ``limit``: a row a point, a raster's points in one array before."""
    def measure(grey: np.ndarray) -> dict:
        return {"at": np.flatnonzero(_magnitude(grey) > limit).tolist(), "wide": grey.shape[1]}

    found = _each(rasters, measure, "at array<long>, wide int", [pa.list_(pa.int64()), pa.int32()])
    each = found.select("doc_id", "wide", F.explode("at").alias("at"))
    return each.select("doc_id", (F.col("at") % F.col("wide")).cast("int").alias("x"), F.floor(F.col("at") / F.col("wide")).cast("int").alias("y"))


EDGES = "array<struct<angle:int,distance:int,votes:bigint,start:int,stop:int,length:double>>"
_EDGES = pa.list_(pa.struct([("angle", pa.int32()), ("distance", pa.int32()), ("votes", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("length", pa.float64())]))


def _whole(v: np.ndarray) -> np.ndarray:
    """Rounded to six decimals, then to a whole number, halves away from zero."""
    v = np.round(v, 6)
    return (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)


def _edges(x: np.ndarray, y: np.ndarray, angles: int, votes: int, least: float, gap: int) -> list[dict]:
    """The straight runs of one raster's points. Votes are counted in a table of angles by distances, as high as its lines are many; some
    million places are held at a time beside it."""
    if len(x) < votes:
        return []
    x, y = np.unique(np.stack([x, y]).astype(np.int64), axis=1)
    theta = np.arange(angles) * (np.pi / angles)
    cos, sin = np.cos(theta)[:, None], np.sin(theta)[:, None]
    far = int(np.ceil(np.hypot(np.abs(x).max(), np.abs(y).max()))) + 2  # no line is farther from the origin
    wide, rows = 2 * far + 1, max(1, (1 << 20) // len(x))
    counted = np.full((angles + 2, wide), -1, np.int64)
    for k in range(0, angles, rows):
        at = _whole(x * cos[k : k + rows] + y * sin[k : k + rows]) + far
        n = len(at)
        counted[k + 1 : k + 1 + n] = np.bincount((at + np.arange(n)[:, None] * wide).ravel(), minlength=n * wide).reshape(n, wide)
    own = counted[1:-1, 1:-1]
    peak = own >= max(votes, 1)
    # A line gives way to a stronger neighbour; of equal ones the first counts.
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            if i or j:
                other = counted[1 + i : angles + 1 + i, 1 + j : wide - 1 + j]
                peak &= (other <= own) if (i, j) > (0, 0) else (other < own)
    found = []
    for angle in np.flatnonzero(peak.any(axis=1)).tolist():
        at = _whole(x * cos[angle] + y * sin[angle]) + far
        place = _whole(y * cos[angle] - x * sin[angle])
        for d in np.flatnonzero(peak[angle]).tolist():
            places = np.unique(place[at == d + 1])
            cut = np.flatnonzero(np.diff(places) > gap)
            for start, stop in zip(places[np.r_[0, cut + 1]].tolist(), places[np.r_[cut, len(places) - 1]].tolist()):
                if stop - start >= least:
                    found.append({"angle": angle, "distance": d + 1 - far, "votes": int(own[angle, d]), "start": start, "stop": stop, "length": float(stop - start)})
    return found


def straight_edges(points: DataFrame, angles: int = 180, votes: int = 50, least: float = 50.0, gap: int = 10) -> DataFrame:
    """(doc_id, angle, distance, votes, start, stop, length) of the straight runs of edge points (doc_id, x, y).

    Every point votes for the line through it at each of ``angles`` angles; votes are summed by angle and distance. Lines of
    ``votes`` or more, which no neighbouring line (one step of angle or distance away) exceeds, are cut where points along them are
    more than ``gap`` apart, and runs of ``least`` or longer are returned. All lines are tried, none by chance. ``start`` and ``stop`` are
    places along the line. Points that stand twice count once. A raster's points are gathered, not its points at every angle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = zip(batch.column("x"), batch.column("y"))
            found = [_edges(px.values.to_numpy(), py.values.to_numpy(), angles, votes, least, gap) for px, py in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _EDGES)], ["doc_id", "edges"])

    by = points.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))).alias("p"))
    return by.select("doc_id", "p.x", "p.y").mapInArrow(run, f"doc_id long, edges {EDGES}").select("doc_id", F.inline("edges"))


def raster_edges(rasters: DataFrame, limit: float = 200.0, angles: int = 180, votes: int = 50, least: float = 50.0, gap: int = 10) -> DataFrame:
    """``straight_edges`` of the pixels whose gradient is above ``limit``. A raster is whole in its row, so no point leaves its task."""
    def measure(grey: np.ndarray) -> dict:
        y, x = np.nonzero(_magnitude(grey) > limit)
        return {"edges": _edges(x, y, angles, votes, least, gap)}

    return _each(rasters, measure, f"edges {EDGES}", [_EDGES]).select("doc_id", F.inline("edges"))


def _raster_sql(table: str = "documents", width: int = 64) -> str:
    return f"""hx AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM {table} WHERE text IS NOT NULL),
px AS (SELECT doc_id, h, unnest(range(0, h * {width})) AS p, CAST('0x' || unnest(b[1:h * {width}]) AS INTEGER) AS v FROM (SELECT *, len(b) // {width} AS h FROM hx) WHERE h >= 3)"""


def texture_sql(width: int = 64) -> str:
    """Relations ``px`` (pixels), ``grey`` and ``codes`` (doc_id, bin, n)."""
    around = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
    bits = " + ".join(f"CASE WHEN lead(v, {r * width + c}) OVER w >= v THEN {1 << k} ELSE 0 END" for k, (r, c) in enumerate(around))
    return f"""{_raster_sql(width=width)},
grey AS (SELECT doc_id, v AS bin, count(*) AS n FROM px GROUP BY ALL),
codes AS (SELECT doc_id, code AS bin, count(*) AS n FROM (SELECT doc_id, p, h, {bits} AS code FROM px WINDOW w AS (PARTITION BY doc_id ORDER BY p))
  WHERE p // {width} BETWEEN 1 AND h - 2 AND p % {width} BETWEEN 1 AND {width - 2} GROUP BY ALL)"""


def gradient_sql(width: int = 64) -> str:
    """Relation ``gr`` (doc_id, p, m): the gradient of every pixel."""
    side = lambda d, at, last: {-1: f"CASE WHEN {at} = 0 THEN 1 ELSE -1 END", 0: "0", 1: f"CASE WHEN {at} = {last} THEN -1 ELSE 1 END"}[d]
    px = {(r, c): f"lead(v, ({side(r, f'p // {width}', 'h - 1')}) * {width} + ({side(c, f'p % {width}', width - 1)})) OVER w" for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c}
    names = {k: f"n{i}" for i, k in enumerate(px)}
    part = lambda picks: " + ".join(f"{m} * {names[k]}" for k, m in picks)
    across = f"({part([((-1, 1), 1), ((0, 1), 2), ((1, 1), 1)])}) - ({part([((-1, -1), 1), ((0, -1), 2), ((1, -1), 1)])})"
    down = f"({part([((1, -1), 1), ((1, 0), 2), ((1, 1), 1)])}) - ({part([((-1, -1), 1), ((-1, 0), 2), ((-1, 1), 1)])})"
    return f"""{_raster_sql(width=width)}, nb AS (SELECT doc_id, p, {", ".join(f"{e} AS {names[k]}" for k, e in px.items())} FROM px WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
gr AS (SELECT doc_id, p, sqrt((({across}) * ({across}) + ({down}) * ({down}))::DOUBLE) AS m FROM nb)"""
