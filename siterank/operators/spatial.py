"""Exact nearest-neighbour and within-radius joins on an adaptive grid.

The right-hand points are put into a hierarchy of grid cells (cell size divided by four
per level); a cell that holds more than ``leaf_size`` distinct points is split further, so a
leaf stays small however dense one place is.  Copies of one location count as one point.
The left locations are cut into blocks by the same kind of cells, and every block carries one
short list of candidate cells down the hierarchy for all its locations:

* nearest: a cell is dropped when its closest corner is farther than the farthest corner of
  the best cell, which can never drop the answer;
* within radius: a cell entirely inside for the whole block adds its stored count, one entirely
  outside is dropped, and only cells on the rim are opened.

So what is shuffled follows the blocks and the leaves they meet, not pairs of a location and a
cell.  Points are compared one by one only in the last step, block by block, with leaves that survive.
All steps are joins and groupings, so Spark may broadcast or shuffle each one by its real size.
Works in any number of dimensions: planar metres, or positions on the sphere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from siterank.session import cut_lineage

TOP_CELL = 8388608.0  # metres; covers the planar frame and the sphere
MAX_LEVEL = 11  # smallest cell: 2 m
LEAF_SIZE = 48
BLOCK_SIZE = 512  # most left locations that share a list of cells
BLOCK_RIGHT = 8192  # most right places in the cell of a block of several locations
FRONTIER = 48  # most cells handed to every block as a literal start list
PAIRS = 2**18  # distances measured at once
SLACK = 1e-9
HASH = "__place"


@dataclass
class PointIndex:
    dims: list[str]
    by: list[str]
    points: DataFrame  # one row per distinct location
    placed: DataFrame  # the same with its leaf cell and the part of it
    tree: DataFrame  # parent cell -> array of child cells
    start: list  # literal start cells, or None when ``by`` is used
    depth: int  # number of opening steps needed from the start cells
    live: DataFrame  # all reachable cells


def _cell(level: int, dims: list[str], by: list[str]) -> Column:
    size = TOP_CELL / 4**level
    parts = [F.col(b).alias(f"k{i}") for i, b in enumerate(by)]
    parts += [F.lit(level).alias("l")]
    parts += [F.floor(F.col(d) / F.lit(size)).alias(f"c{i}") for i, d in enumerate(dims)]
    return F.struct(*parts)


def _parent(node: Column, n_dims: int, n_by: int) -> Column:
    parts = [node[f"k{i}"].alias(f"k{i}") for i in range(n_by)]
    parts += [(node["l"] - 1).alias("l")]
    parts += [
        F.when(node["l"] == 0, F.lit(0)).otherwise(F.floor(node[f"c{i}"] / 4)).cast("long").alias(f"c{i}")
        for i in range(n_dims)
    ]
    return F.struct(*parts)


def _finite(dims: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.abs(F.col(d)) < F.lit(float("inf")) for d in dims])


def _box(dims: list[str]) -> list[Column]:
    return [f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]


def _cell_counts(places: DataFrame, dims: list[str], by: list[str], copies: Column) -> DataFrame:
    """Every cell of every level with its number of places, their copies, their box and the cell above."""
    levels = F.array(*[_cell(lv, dims, by) for lv in range(MAX_LEVEL + 1)])
    return (
        places.select(*dims, copies.alias("copies"), F.explode(levels).alias("node"))
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("total"), *_box(dims))
        .withColumn("parent", _parent(F.col("node"), len(dims), len(by)))
    )


def _reachable(stats: DataFrame) -> DataFrame:
    """The top cells and those below a heavy cell."""
    heavy = stats.where("heavy").select(F.col("node").alias("parent"))
    return cut_lineage(
        stats.where("node.l = 0").unionByName(stats.where("node.l > 0").join(heavy, "parent", "left_semi").select(*stats.columns))
    )


def _in_leaves(places: DataFrame, live: DataFrame, levels: list[int], dims: list[str], by: list[str], most: int) -> DataFrame:
    """Places with ``node``, their leaf, and ``part``: a leaf of the smallest size with many places is dealt over parts."""
    leaves = live.where(~F.col("heavy")).select("node", F.ceil(F.col("n") / most).alias("__parts"))
    cells = F.array(*[_cell(lv, dims, by) for lv in levels or [0]])
    part = F.pmod(F.xxhash64(*dims), F.col("__parts")).alias("part")
    found = places.withColumn("node", F.explode(cells)).join(leaves, "node")
    return found.select(*places.columns, "node", part)


def _levels(live: DataFrame) -> dict[int, tuple[int, int]]:
    """Cells and heavy cells of each level: one small row per level."""
    return {
        r["l"]: (r["n"], r["h"])
        for r in live.groupBy(F.col("node.l").alias("l"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("heavy").cast("long")).alias("h"))
        .collect()
    }


def _leaf_levels(per_level: dict[int, tuple[int, int]]) -> list[int]:
    return [lv for lv, (n, h) in sorted(per_level.items()) if n > h]


def build_index(right: DataFrame, dims: list[str], ordinal: str, carry: list[str] = (), by: list[str] = (),
                leaf_size: int = LEAF_SIZE, frontier: int = FRONTIER) -> PointIndex:
    dims, by, carry = list(dims), list(by), list(carry)
    nd = len(dims)
    first = F.min_by(F.struct(F.col(ordinal).alias("ord"), *[F.col(c) for c in carry]), F.col(ordinal))
    points = right.where(_finite(dims)).groupBy(*by, *dims).agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    stats = _cell_counts(points, dims, by, F.col("copies"))
    live = _reachable(stats.withColumn("heavy", (F.col("n") > leaf_size) & (F.col("node.l") < MAX_LEVEL)))

    # one small row per level decides how deep the search goes and where it starts
    per_level = _levels(live)
    deepest = max(per_level, default=0)
    child = F.struct("node", "total", *[f"lo{i}" for i in range(nd)], *[f"hi{i}" for i in range(nd)])
    tree = live.groupBy("parent").agg(F.collect_list(child).alias("children"))

    start, depth = None, deepest
    if not by:
        best = 0
        for lv in range(deepest + 1):
            leaves_above = sum(per_level[k][0] - per_level[k][1] for k in range(lv))
            if per_level.get(lv, (0, 0))[0] + leaves_above <= frontier:
                best = lv
        top = live.where((F.col("node.l") == best) | ((F.col("node.l") < best) & ~F.col("heavy")))
        start = [r["c"] for r in top.select(child.alias("c")).collect()]  # at most ``frontier`` cells
        depth = deepest - best

    placed = _in_leaves(points, live, _leaf_levels(per_level), dims, by, leaf_size)
    return PointIndex(dims, by, points, placed, tree, start, depth, live)


def _literal_cells(index: PointIndex) -> Column:
    nd = len(index.dims)
    cells = []
    for c in index.start:
        node = F.struct(
            F.lit(c["node"]["l"]).alias("l"), *[F.lit(c["node"][f"c{i}"]).cast("long").alias(f"c{i}") for i in range(nd)]
        )
        cells.append(
            F.struct(
                node.alias("node"),
                F.lit(c["total"]).cast("long").alias("total"),
                *[F.lit(c[f"lo{i}"]).alias(f"lo{i}") for i in range(nd)],
                *[F.lit(c[f"hi{i}"]).alias(f"hi{i}") for i in range(nd)],
            )
        )
    return F.array(*cells) if cells else F.array().cast(index.tree.schema["children"].dataType)


# --- blocks of left locations and their cells -------------------------------
def _near2(nd: int, cell: Column) -> Column:
    """Square of the least distance between a place of the block's box and one of the cell's."""
    box = F.col("box")
    gaps = [F.greatest(cell[f"lo{i}"] - box[f"hi{i}"], F.lit(0.0), box[f"lo{i}"] - cell[f"hi{i}"]) for i in range(nd)]
    return reduce(lambda a, b: a + b, [g * g for g in gaps])


def _far2(nd: int, cell: Column) -> Column:
    box = F.col("box")
    gaps = [F.greatest(box[f"hi{i}"] - cell[f"lo{i}"], cell[f"hi{i}"] - box[f"lo{i}"]) for i in range(nd)]
    return reduce(lambda a, b: a + b, [g * g for g in gaps])


def _blocks(left: DataFrame, index: PointIndex) -> DataFrame:
    """(block, box, by, locs): the distinct left locations by cells with few of them and few right places."""
    dims, by = index.dims, index.by
    places = left.where(_finite(dims)).select(*by, *dims).distinct()
    stats = _cell_counts(places, dims, by, F.lit(1)).drop("total")
    theirs = index.live.where("heavy").select("node", F.col("n").alias("__right"))
    crowded = (F.col("n") > BLOCK_SIZE) | ((F.col("n") > 1) & (F.coalesce("__right", F.lit(0)) > BLOCK_RIGHT))
    stats = stats.join(theirs, "node", "left").withColumn("heavy", crowded & (F.col("node.l") < MAX_LEVEL)).drop("__right")
    live = _reachable(stats)
    placed = _in_leaves(places, live, _leaf_levels(_levels(live)), dims, by, BLOCK_SIZE)
    grouped = placed.groupBy(F.struct("node", "part").alias("block")).agg(F.collect_list(F.struct(*dims)).alias("locs"), *_box(dims))
    box = F.struct(*[f"{n}{i}" for i in range(len(dims)) for n in ("lo", "hi")]).alias("box")
    return cut_lineage(grouped.select("block", box, *[F.col(f"block.node.k{i}").alias(b) for i, b in enumerate(by)], "locs"))


def _dealt(blocks: DataFrame, key: str = "block") -> DataFrame:
    """A block has far more work than its few bytes suggest, so partitions of blocks are not merged."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _first_cells(blocks: DataFrame, index: PointIndex) -> DataFrame:
    """(block, box, node, near2, far2, total): the start cells of every block."""
    nd = len(index.dims)
    blocks = _dealt(blocks.drop("locs"))
    if index.start is None:
        root = F.struct(
            *[F.col(b).alias(f"k{i}") for i, b in enumerate(index.by)],
            F.lit(-1).alias("l"),
            *[F.lit(0).cast("long").alias(f"c{i}") for i in range(nd)],
        )
        rows = blocks.join(index.tree, root == F.col("parent")).select("block", "box", F.explode("children").alias("c"))
    else:
        rows = blocks.select("block", "box", F.explode(_literal_cells(index)).alias("c"))
    return rows.select(
        "block", "box", F.col("c.node").alias("node"), _near2(nd, F.col("c")).alias("near2"),
        _far2(nd, F.col("c")).alias("far2"), F.col("c.total").alias("total"),
    )


def _open(front: DataFrame, index: PointIndex, keep: list[str] = ()) -> DataFrame:
    """Replace every split cell of the list by its children; leaves stay as they are."""
    nd = len(index.dims)
    rows = front.select("block", "box", *keep, F.explode_outer("cells").alias("cell"))
    joined = rows.join(index.tree, F.col("cell.node") == F.col("parent"), "left")
    opened = joined.select("block", "box", *keep, "cell", F.explode_outer("children").alias("c"))
    return opened.select(
        "block", "box",
        *keep,
        F.coalesce("c.node", "cell.node").alias("node"),
        F.coalesce(_near2(nd, F.col("c")), "cell.near2").alias("near2"),
        F.coalesce(_far2(nd, F.col("c")), "cell.far2").alias("far2"),
        F.coalesce("c.total", "cell.total").alias("total"),
    )


CELL = ["node", "near2", "far2", "total"]


def _nearest_cells(blocks: DataFrame, index: PointIndex, limit: float | None) -> DataFrame:
    def prune(rows):
        if limit is not None:
            rows = rows.where(F.col("near2") <= F.lit(limit * limit * (1 + SLACK) + SLACK))
        return (
            rows.groupBy("block")
            .agg(F.first("box").alias("box"), F.min("far2").alias("worst"), F.collect_list(F.struct(*CELL)).alias("cells"))
            .select("block", "box", F.filter("cells", lambda c: c["near2"] <= F.col("worst") * (1 + SLACK) + SLACK).alias("cells"))
        )

    front = prune(_first_cells(blocks, index))
    for _ in range(index.depth):
        front = prune(_open(front, index))
    return front


def _rim_cells(blocks: DataFrame, index: PointIndex, radius: float, keep_inner_cells: bool = False) -> DataFrame:
    """Per block: ``cells`` on the rim, and of those inside their count, or ``whole``, the cells themselves."""
    r2 = radius * radius
    inside = F.col("far2") <= r2 * (1 - SLACK)
    rim = ~inside & (F.col("near2") <= r2 * (1 + SLACK))

    def split(rows, first):
        aggs = [
            F.first("box").alias("box"),
            (F.coalesce(F.sum(F.when(inside, F.col("total"))), F.lit(0)) + (F.lit(0) if first else F.max("inner"))).alias("inner"),
            F.collect_list(F.when(rim, F.struct(*CELL))).alias("cells"),
        ]
        if keep_inner_cells:
            aggs.append(F.collect_list(F.when(inside, F.col("node"))).alias("more"))
            if not first:
                aggs.append(F.first("whole").alias("whole"))
        out = rows.groupBy("block").agg(*aggs)
        if keep_inner_cells:
            whole = F.col("more") if first else F.concat("whole", "more")
            out = out.withColumn("whole", whole).drop("more")
        return out

    keep = ["inner", "whole"] if keep_inner_cells else ["inner"]
    front = split(_first_cells(blocks, index), True)
    for _ in range(index.depth):
        front = split(_open(front, index, keep), False)
    return cut_lineage(front)


# --- the last step: the locations of a block against the places of its leaves
def _leaf_places(index: PointIndex) -> DataFrame:
    place = F.struct(F.col("first.ord").alias("ord"), "copies", *[F.col(d).alias(f"p{i}") for i, d in enumerate(index.dims)])
    return index.placed.groupBy("node", "part").agg(F.collect_list(place).alias("pts")).select("node", "pts")


def _flat(table: pa.Table, column: str) -> pa.StructArray:
    return pa.concat_arrays([c.flatten() for c in table.column(column).chunks]) if table.num_rows else pa.array([], table.schema.field(column).type.value_type)


def _numbers(array: pa.StructArray, names: list[str]) -> list[np.ndarray]:
    return [array.field(n).to_numpy(zero_copy_only=False) for n in names]


def _squares(locs: list[np.ndarray], pts: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of a few locations at a time to all points."""
    step = max(1, PAIRS // max(1, len(pts[0])))
    for lo in range(0, len(locs[0]), step):
        some = slice(lo, lo + step)
        gaps = [p[None, :] - q[some, None] for p, q in zip(pts, locs)]
        yield some, reduce(lambda a, b: a + b, [g * g for g in gaps])


def _largest_square(radius: float) -> float:
    """The largest number whose square root, as it is rounded, is at most ``radius``."""
    at = radius * radius
    while math.sqrt(at) > radius:
        at = math.nextafter(at, 0.0)
    while math.sqrt(up := math.nextafter(at, math.inf)) <= radius:
        at = up
    return at


def _rows_of(table: pa.Table, locs: pa.StructArray, by: list[str], dims: list[str]) -> list[pa.Array]:
    own = pa.array(np.zeros(len(locs), np.int64))
    return [*[table.column(b).combine_chunks().take(own) for b in by], *[locs.field(d) for d in dims]]


def _closest(by: list[str], dims: list[str]):
    at = [f"p{i}" for i in range(len(dims))]

    def run(block: pa.Table, near: pa.Table) -> pa.Table:
        locs, places = _flat(block, "locs"), _flat(near, "pts")
        places = places.take(pc.sort_indices(places.field("ord")))
        q, p = _numbers(locs, dims), _numbers(places, at)
        pick, dist = np.empty(len(locs), np.int64), np.empty(len(locs))
        for some, d2 in _squares(q, p):
            least = d2.min(1)
            # equal distances, as they are rounded, go to the first
            row, col = np.nonzero(d2 <= (least * (1 + 1e-14))[:, None])
            d = np.sqrt(d2[row, col])
            first = np.lexsort((col, d, row))
            first = first[np.unique(row[first], return_index=True)[1]]
            pick[some], dist[some] = col[first], d[first]
        columns = [*_rows_of(block, locs, by, dims), pa.array(dist), *[pa.array(c[pick]) for c in p]]
        return pa.Table.from_arrays(columns, names=[*by, *dims, "dist", *at])

    def guarded(block: pa.Table, near: pa.Table) -> pa.Table:
        # without a candidate no location of the block has a neighbour
        return run(block if near.num_rows else block.slice(0, 0), near)

    return guarded


def _counter(by: list[str], dims: list[str], radius: float):
    at, most = [f"p{i}" for i in range(len(dims))], _largest_square(radius)

    def run(block: pa.Table, near: pa.Table) -> pa.Table:
        locs, places = _flat(block, "locs"), _flat(near, "pts")
        copies = places.field("copies").to_numpy(zero_copy_only=False)
        n = np.full(len(locs), block.column("inner")[0].as_py() or 0, np.int64)
        if len(places):
            plain, weight = bool((copies == 1).all()), copies.astype(np.float64)
            for some, d2 in _squares(_numbers(locs, dims), _numbers(places, at)):
                n[some] += np.count_nonzero(d2 <= most, axis=1) if plain else ((d2 <= most) @ weight).astype(np.int64)
        return pa.Table.from_arrays([*_rows_of(block, locs, by, dims), pa.array(n)], names=[*by, *dims, "n"])

    return run


def _namer(dims: list[str], radius: float, n: int):
    at, most = [f"p{i}" for i in range(len(dims))], _largest_square(radius)

    def run(block: pa.Table, near: pa.Table) -> pa.Table:
        locs, tops, rim = _flat(block, "locs"), _flat(block, "tops"), _flat(near, "pts")
        none = pa.nulls(len(tops), pa.float64())
        held = pa.Table.from_arrays(
            [pa.concat_arrays([tops.field(c), rim.field(c)]) for c in ("ord", "name")] + [pa.concat_arrays([none, rim.field(c)]) for c in at],
            names=["ord", "name", *at],
        )
        held = held.take(pc.sort_indices(held, sort_keys=[("ord", "ascending"), ("name", "ascending")]))
        names, p, q = held.column("name").combine_chunks(), [held.column(c).to_numpy() for c in at], _numbers(locs, dims)
        found, rows, cols = np.zeros(len(locs), np.int64), [], []
        for lo in range(0, len(names), 512):
            open_ = np.flatnonzero(found < n)
            if not open_.size:
                break
            part = [c[lo : lo + 512] for c in p]
            for some, d2 in _squares([c[open_] for c in q], part):
                hit = (d2 <= most) | np.isnan(part[0])  # what lies inside for the whole block has no place
                of = open_[some]
                hit &= found[of, None] + np.cumsum(hit, axis=1) <= n
                row, col = np.nonzero(hit)
                rows.append(of[row])
                cols.append(lo + col)
                found[of] += np.count_nonzero(hit, axis=1)
        row, col = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (rows, cols))
        order = np.lexsort((col, row))
        ends = np.concatenate([[0], np.cumsum(found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(col[order])))
        return pa.Table.from_arrays([*_rows_of(block, locs, [], dims), lists], names=[*dims, "names"])

    return run


def _meet(blocks: DataFrame, near: DataFrame, run, schema: T.StructType) -> DataFrame:
    """Each block with the places of its leaves."""
    dealt = _dealt(near.select(F.col("block").alias("of"), "pts"), "of")
    return blocks.groupBy("block").cogroup(dealt.groupBy("of")).applyInArrow(run, schema)


def _schema(blocks: DataFrame, index: PointIndex, *added: str) -> T.StructType:
    own = [blocks.schema[b] for b in index.by] + [T.StructField(d, T.DoubleType()) for d in index.dims]
    return T.StructType([*own, *T.StructType.fromDDL(", ".join(added)).fields])


def _join_back(left: DataFrame, found: DataFrame, index: PointIndex) -> DataFrame:
    cols = [*index.by, *index.dims]
    f = found.select(F.xxhash64(*cols).alias(f"__l_{HASH}"), *[F.col(c).alias(f"__l_{c}") for c in cols], *[c for c in found.columns if c not in cols])
    names = [HASH, *cols]
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__l_{c}") for c in names])
    return left.withColumn(HASH, F.xxhash64(*cols)).join(f, cond, "left").drop(HASH, *[f"__l_{c}" for c in names])


def nearest(left: DataFrame, right: DataFrame | PointIndex, dims: list[str] = ("x", "y"), ordinal: str = "ordinal",
            carry: dict[str, str] | None = None, out: str = "nearest_m", limit: float | None = None,
            by: list[str] = ()) -> DataFrame:
    """Distance (and ``carry`` columns, right name -> output name) of the closest right row.

    Every left row is kept; equal distances go to the lowest right ordinal.
    """
    carry = carry or {}
    index = right if isinstance(right, PointIndex) else build_index(right, list(dims), ordinal, list(carry), list(by))
    cols, at = [*index.by, *index.dims], [f"p{i}" for i in range(len(index.dims))]
    blocks = _blocks(left, index)
    cells = _nearest_cells(blocks, index, limit).select("block", F.explode("cells.node").alias("node"))
    schema = _schema(blocks, index, "dist double", *[f"{c} double" for c in at])
    found = _meet(blocks, cells.join(_leaf_places(index), "node"), _closest(index.by, index.dims), schema)
    if limit is not None:
        found = found.where(F.col("dist") <= limit)
    if carry:
        theirs = index.points.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(index.by)], *[F.col(d).alias(f"__p{i}") for i, d in enumerate(index.dims)], "first")
        same = [F.col(b) == F.col(f"__b{i}") for i, b in enumerate(index.by)] + [F.col(f"p{i}") == F.col(f"__p{i}") for i in range(len(at))]
        found = found.join(theirs, reduce(lambda a, b: a & b, same))
    found = found.select(*cols, F.col("dist").alias(out), *[F.col(f"first.{s}").alias(d) for s, d in carry.items()])
    return _join_back(left, found, index)


def count_within(left: DataFrame, right: DataFrame | PointIndex, radius: float, dims: list[str] = ("x", "y"),
                 ordinal: str = "ordinal", out: str = "n_within", by: list[str] = ()) -> DataFrame:
    """Number of right rows at distance <= radius; zero when there are none."""
    index = right if isinstance(right, PointIndex) else build_index(right, list(dims), ordinal, [], list(by))
    blocks = _blocks(left, index)
    front = _rim_cells(blocks, index, radius)
    near = front.select("block", F.explode("cells.node").alias("node")).join(_leaf_places(index), "node")
    counted = blocks.join(front.select("block", "inner"), "block", "left")
    found = _meet(counted, near, _counter(index.by, index.dims, radius), _schema(blocks, index, "n long"))
    return _join_back(left, found.withColumnRenamed("n", out), index).withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))


def names_within(left: DataFrame, right: DataFrame, radius: float, name: str, dims: list[str] = ("x", "y"),
                 ordinal: str = "ordinal", n: int = 8, out: str = "names") -> DataFrame:
    """The first ``n`` names (by ordinal) within the radius.

    Each cell keeps its own first ``n`` names, so a cell inside the radius never lists its points, and of the cells on the
    rim only names count that come before the last of the ``n`` first ones inside.
    """
    dims = list(dims)
    nd = len(dims)
    named = right.where(F.col(name).isNotNull() & _finite(dims))
    index = build_index(named, dims, ordinal)
    blocks = _blocks(left, index)
    front = _rim_cells(blocks, index, radius, keep_inner_cells=True)

    def first_n(df, keys):
        w = W.partitionBy(*keys).orderBy("ord", "name")
        return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")

    tagged = named.select(*dims, F.col(ordinal).alias("ord"), F.col(name).alias("name"))
    place = F.struct("ord", "name", *[F.col(d).alias(f"p{i}") for i, d in enumerate(dims)])
    leaves = cut_lineage(
        first_n(tagged, dims).join(index.placed.select(*dims, "node", "part"), dims).groupBy("node", "part").agg(F.array_sort(F.collect_list(place)).alias("pts")).drop("part")
    )
    level = F.col("node.l")
    above = F.transform(F.sequence(F.lit(0), level), lambda v: F.struct(
        v.alias("l"), *[F.floor(F.col(f"node.c{i}") / F.pow(F.lit(4.0), level - v)).alias(f"c{i}") for i in range(nd)]))
    of_leaf = leaves.select("node", F.explode(F.slice("pts", 1, n)).alias("t")).select("node", "t.ord", "t.name")
    top = F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("tops")
    by_cell = first_n(of_leaf.withColumn("node", F.explode(above)), ["node"]).groupBy("node").agg(top)
    whole = front.select("block", F.explode("whole").alias("node")).join(by_cell, "node").select("block", F.explode("tops").alias("t"))
    tops = cut_lineage(first_n(whole.select("block", "t.*"), ["block"]).groupBy("block").agg(top))

    last = F.when(F.size("tops") == n, F.element_at("tops", -1)["ord"]).alias("last")
    rim = front.join(tops, "block", "left").select("block", last, F.explode("cells.node").alias("node")).join(leaves, "node")
    early = F.filter("pts", lambda p: F.col("last").isNull() | (p["ord"] <= F.col("last")))
    near = rim.select("block", early.alias("pts")).where(F.size("pts") > 0)
    mine = blocks.join(tops, "block", "left").withColumn("tops", F.coalesce("tops", F.array().cast(tops.schema["tops"].dataType)))
    found = _meet(mine, near, _namer(dims, radius, n), _schema(blocks, index, "names array<string>"))
    out_rows = _join_back(left, found.withColumnRenamed("names", out), index)
    return out_rows.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>")))
