"""Cell covers of polygon layers: cells wholly inside answer at once, border cells hold only the edges near them.

Cells are squares of a power of four, half open, numbered from the origin.  A polygon starts with the one to four cells that
hold its bounding box; a cell with many edges is split into sixteen, so that only cells along the border become small.

A border cell answers by the ray rule exactly as the whole polygon does: an edge counts if it spans the point's y and meets
that line to the right.  Edges that pass the cell on the right count for every point whose y they span; of these only their
parity at the cell's lower side and the heights where it changes are kept.  Where two of them share a vertex the changes
cancel out, so what is kept follows the edges near the cell, not the size of the ring.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siterank.functions.geo import on_boundary

#: A cell with more edges than this is split, down to this many levels below the polygon's own.
MOST_EDGES, MOST_SPLITS = 16, 12
EDGE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
_KIDS = np.array([(i, j) for j in range(4) for i in range(4)], dtype=np.float64)


def _size(level: int) -> float:
    return 4.0**level


def _sides(edges: np.ndarray, xmin: np.ndarray, ymin: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell and edge: whether the edge comes near the cell, and whether it passes on the right of it."""
    margin = size * 2.0**-16 + 1e-12 * max(1.0, float(np.abs(edges).max()))
    x1, y1, x2, y2 = (edges[None, :, k] for k in range(4))
    lo, hi = (ymin - margin)[:, None], (ymin + size + margin)[:, None]
    meets = (np.minimum(y1, y2) <= hi) & (np.maximum(y1, y2) >= lo)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (x2 - x1) / (y2 - y1)
        at = [np.where(y1 == y2, x, x1 + slope * (np.clip(y, lo, hi) - y1)) for x, y in ((x1, y1), (x2, y2))]
    left, right = np.minimum(*at), np.maximum(*at)
    beyond = left > (xmin + size + margin)[:, None]
    return meets & ~beyond & (right >= (xmin - margin)[:, None]), meets & beyond


class Cell:
    """A cell, the edges near it, and the parity of edges to its right at its lower side with the heights where it flips."""

    __slots__ = ("level", "cx", "cy", "edges", "odd", "flips")

    def __init__(self, level: int, cx: int, cy: int, edges: np.ndarray, odd: bool, flips: list[float]):
        self.level, self.cx, self.cy, self.edges, self.odd, self.flips = level, cx, cy, edges, odd, flips


def _narrow(level: int, cx: int, cy: int, edges: np.ndarray, near: np.ndarray, right: np.ndarray, odd: bool, flips: list[float]) -> Cell:
    """The cell from what is known of a larger one: ``flips`` and ``odd`` of it, its edges, and where they pass."""
    bottom, top = cy * _size(level), (cy + 1) * _size(level)
    passing = edges[right]
    low, high = np.minimum(passing[:, 1], passing[:, 3]), np.maximum(passing[:, 1], passing[:, 3])
    odd ^= bool(sum(f <= bottom for f in flips) % 2) ^ bool(((low <= bottom) & (bottom < high)).sum() % 2)
    heights = Counter(f for f in flips if bottom < f < top)
    heights.update(h for h in np.concatenate([low, high]).tolist() if bottom < h < top)
    return Cell(level, cx, cy, edges[near], odd, sorted(h for h, n in heights.items() if n % 2))


def cover(edges: np.ndarray) -> list[Cell]:
    """Cells of a polygon given by its edges ``(x1, y1, x2, y2)``; a cell without edges and flips lies wholly inside."""
    edges = edges[np.isfinite(edges).all(1)]
    if not len(edges):
        return []
    x0, y0 = edges[:, [0, 2]].min(), edges[:, [1, 3]].min()
    x1, y1 = edges[:, [0, 2]].max(), edges[:, [1, 3]].max()
    top = int(np.ceil(np.log2(max(x1 - x0, y1 - y0, 4.0**-14)) / 2))
    todo, done = [], []

    def put(cells: list[tuple[int, int]], level: int, known: np.ndarray, odd: bool, flips: list[float]) -> None:
        size = _size(level)
        near, right = _sides(known, np.array([c[0] * size for c in cells]), np.array([c[1] * size for c in cells]), size)
        for (cx, cy), n, r in zip(cells, near, right):
            cell = _narrow(level, cx, cy, known, n, r, odd, flips)
            if len(cell.edges) > MOST_EDGES and level > top - MOST_SPLITS:
                todo.append(cell)
            elif len(cell.edges) or cell.flips or cell.odd:
                done.append(cell)

    size = _size(top)
    put([(i, j) for i in range(int(x0 // size), int(x1 // size) + 1) for j in range(int(y0 // size), int(y1 // size) + 1)], top, edges, False, [])
    while todo:
        c = todo.pop()
        put([(4 * c.cx + i, 4 * c.cy + j) for i in range(4) for j in range(4)], c.level - 1, c.edges, c.odd, c.flips)
    return done


def _coverer(kept: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch.column(batch.schema.get_field_index("rings"))
            for i in range(batch.num_rows):
                shape = rings[i].as_py() or []
                parts = [np.array([[p["x"], p["y"]] for p in ring], dtype=np.float64).reshape(-1, 2) for ring in shape if ring and all(p and p["x"] is not None and p["y"] is not None for p in ring)]
                edges = np.concatenate([np.hstack([p[:-1], p[1:]]) for p in parts if len(p) > 1] or [np.zeros((0, 4))])
                cells = cover(edges)
                for lo in range(0, len(cells), 4096):
                    some = cells[lo : lo + 4096]
                    flat = np.concatenate([c.edges for c in some])
                    at = pa.array(np.cumsum([0] + [len(c.edges) for c in some]), pa.int32())
                    struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], names=["x1", "y1", "x2", "y2"])
                    own = batch.slice(i, 1)
                    columns = [own.column(own.schema.get_field_index(c)).take(pa.array(np.zeros(len(some), np.int64))) for c in kept]
                    columns += [
                        pa.array([c.level for c in some], pa.int32()), pa.array([c.cx for c in some], pa.int64()), pa.array([c.cy for c in some], pa.int64()),
                        pa.ListArray.from_arrays(at, struct), pa.array([c.odd for c in some]), pa.array([c.flips for c in some], pa.list_(pa.float64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return run


def cell_cover(layer: DataFrame, rings: str = "rings") -> DataFrame:
    """One row per cell: the layer's other columns and ``lv, cx, cy, edges, odd, flips``.

    Polygons without points give no rows.  No row holds more than ``MOST_EDGES`` edges unless they meet within the smallest cell.
    """
    kept = [c for c in layer.columns if c != rings]
    added = T.StructType.fromDDL(f"lv int, cx long, cy long, edges {EDGE}, odd boolean, flips array<double>")
    schema = T.StructType([*layer.select(*kept).schema.fields, *added.fields])
    plain = layer.select(*kept, F.col(rings).alias("rings"))
    return plain.mapInArrow(_coverer(kept, added.names), schema)


def cell_of(level: Column, v: Column) -> Column:
    return F.floor(v / F.pow(F.lit(4.0), level)).cast("long")


def holds(px: Column, py: Column, boundary: bool = False) -> Column:
    """Whether the polygon of a cell's row holds the point, which lies in that cell."""
    edges, flips = F.col("edges"), F.col("flips")
    crossed = F.size(F.filter(edges, lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])))
    right = F.col("odd").cast("int") + F.size(F.filter(flips, lambda f: f <= py))
    inside = (crossed + right) % 2 == 1
    plain = (F.size(edges) == 0) & (F.size(flips) == 0)
    edge = on_boundary(px, py, edges)
    return F.when(plain, F.col("odd")).otherwise((inside | edge) if boundary else (inside & ~edge))
