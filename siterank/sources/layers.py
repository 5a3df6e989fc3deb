"""Layers as Parquet in the order of a Hilbert curve, so that a box or a state reads only its part of the files.

Every row carries the box of its geometry (``west south east north``, degrees).  Rows of a partition are near each other along
the curve, so the least and greatest values of row groups and pages rule most of them out.  Boxes over the 180th meridian are
two boxes to the caller.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of a coordinate on the curve: cells of about 600 m along the equator.
BITS = 16
#: Boxes that are pushed to the scan one by one; of more, this many envelopes of neighbours are.
PUSHED_BOXES = 16
BOX = ("west", "south", "east", "north")


def _four_levels() -> list[int]:
    """Four levels of the curve at once, by (turn, four bits of x, four bits of y): 4 * place among 256 + the turn that follows.

    A turn says whether x and y are exchanged (1) and both counted from the other end (2).
    """
    out = []
    for i in range(1024):
        turn, d = i >> 8, 0
        for k in (3, 2, 1, 0):
            x, y = (i >> 4 + k & 1) ^ turn >> 1, (i >> k & 1) ^ turn >> 1
            rx, ry = (y, x) if turn & 1 else (x, y)
            d = 4 * d + (3 * rx ^ ry)
            turn ^= 0 if ry else 1 + 2 * rx
        out.append(4 * d + turn)
    return out


def hilbert(x: Column, y: Column, bits: int = BITS) -> Column:
    """Place on the Hilbert curve of whole numbers below 2^bits: one look-up for four bits, so it is compiled with its stage."""
    known = F.expr(f"array({', '.join(map(str, _four_levels()))})")
    low = range((bits + 3) // 4 * 4 - 4, -1, -4)
    # an odd number of leading zeros exchanges x and y
    turn, place = F.lit(-bits % 4 % 2), F.lit(0).cast("long")
    for k in low:
        def four(v, k=k):
            return F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(15)).cast("int")

        got = F.get(known, turn * 256 + four(x) * 16 + four(y))
        turn, place = got.bitwiseAND(F.lit(3)), place + F.shiftleft(F.shiftright(got, 2).cast("long"), 2 * k)
    return place


def with_boxes(layer: DataFrame) -> DataFrame:
    """Box of ``rings``, or of ``lon`` and ``lat`` where there are no rings; null for no geometry."""
    if "rings" in layer.columns:
        p = F.flatten("rings")
        xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
        box = {"west": F.array_min(xs), "south": F.array_min(ys), "east": F.array_max(xs), "north": F.array_max(ys)}
    else:
        box = {"west": F.col("lon"), "south": F.col("lat"), "east": F.col("lon"), "north": F.col("lat")}
    return layer.withColumns({k: v.cast("double") for k, v in box.items()})


def _place(west: Column, south: Column, east: Column, north: Column) -> Column:
    def cell(v, low, span):
        return F.least(F.greatest(F.floor((v - low) / span * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1))

    return hilbert(cell((west + east) / 2, -180.0, 360.0), cell((south + north) / 2, -90.0, 180.0))


def write_layer(layer: DataFrame, path: str, state: str | None = "state_abbr", row_group: int = 16 << 20, page_rows: int = 2000) -> None:
    """Replace the layer in a folder; partitions by ``state`` if one is named.

    Ranges of (state, place on the curve) are written by a task each, so a state with a large part of all rows is split.
    ``page_rows`` bounds the rows of a page, the smallest unit a box can skip.
    """
    placed = with_boxes(layer).withColumn("place", F.coalesce(_place(*[F.col(c) for c in BOX]), F.lit(-1)))
    keys = [state, "place"] if state else ["place"]
    sizes = {"parquet.block.size": row_group, "parquet.page.row.count.limit": page_rows}
    out = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").options(partitionOverwriteMode="static", **sizes)
    (out.partitionBy(state) if state else out).parquet(path)


def _meets(box) -> Column:
    west, south, east, north = (float(v) for v in box)
    return (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)


def _envelopes(boxes: list[tuple], most: int) -> list[tuple]:
    """At most ``most`` boxes around runs of boxes in order of their middles."""
    ordered = sorted(boxes, key=lambda b: (round((b[0] + b[2]) / 2), (b[1] + b[3]) / 2))
    size = -(-len(ordered) // most)
    runs = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    return [(min(b[0] for b in r), min(b[1] for b in r), max(b[2] for b in r), max(b[3] for b in r)) for r in runs]


def read_layer(spark: SparkSession, path: str, states: list[str] | None = None, boxes: list[tuple] | None = None,
               margin: float = 0.0, state: str = "state_abbr") -> DataFrame:
    """Rows in one of the states whose box meets one of ``boxes`` (west, south, east, north), borders included.

    None stands for all, an empty list for none.  States prune folders, boxes prune row groups and pages.  Rows without a
    geometry meet no box.
    """
    df = spark.read.parquet(path)
    if states is not None:
        df = df.where(F.col(state).isin([str(s) for s in states]))
    if boxes is None:
        return df.drop("place")
    wide = [(w - margin, s - margin, e + margin, n + margin) for w, s, e, n in boxes]
    pushed = F.lit(False)
    for box in wide if len(wide) <= PUSHED_BOXES else _envelopes(wide, PUSHED_BOXES):
        pushed = pushed | _meets(box)
    df = df.where(pushed)
    if len(wide) > PUSHED_BOXES:
        every = F.from_json(F.lit(json.dumps([dict(zip("wsen", map(float, b))) for b in wide])), "array<struct<w:double,s:double,e:double,n:double>>")
        df = df.where(F.exists(every, lambda b: (F.col("west") <= b["e"]) & (F.col("east") >= b["w"]) & (F.col("south") <= b["n"]) & (F.col("north") >= b["s"])))
    return df.drop("place")
