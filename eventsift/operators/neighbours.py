"""Exact k nearest neighbours of every point of a table.

Space is cut into cells of similar size by k-d trees over samples, cell by cell and again until every cell is small, so the
number of cells grows with the table and no task holds more than a part of one. Every point first looks
inside its own cell; the distance found bounds the search, and only cells whose bounding box is closer than that are
visited. Equal points are one point with a
weight, so copies cost nothing, and a cell with many visitors is served by several tasks. The cut points only steer
the work: the result does not depend on them. In many dimensions boxes exclude nothing: there all pairs of blocks are compared.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsift.storage import materialise

_BITS = 12  # one cut gives a cell at most 2 ** _BITS parts, which bounds trees, samples and boxes of a task
_LEVELS = 5  # cell numbers have _BITS bits for each level
_SAMPLE_PER_CELL = 24
_PART_ROWS = 50_000
_BROADCAST_ROWS = 100_000
_TOUCH_ROWS = 20_000
_BLOCK_CELLS = 1 << 18  # distances held at once
_BOX_WIDTH = 16  # in more dimensions than this every box is near every point
_BLOCK_ROWS = 1 << 15
_LEAST_BLOCKS, _LEAST_ROWS = 8, 1 << 12  # small tables are cut into more blocks than memory asks for
_TOUCH_STEP = 128  # points whose common box says which boxes are looked at
_MERGE_VISITS = 20_000  # visits that are ranked in one call


def distinct_points(df: DataFrame, vector: str, id_col: str) -> DataFrame:
    """``pid, v, m``: distinct vectors with their smallest id and number of rows."""
    return df.groupBy(F.col(vector).alias("v")).agg(F.min(id_col).alias("pid"), F.count("*").alias("m"))


@dataclass
class _Cells:
    """A k-d tree in heap numbering; dimension -1 marks a cell, ``cell`` its number."""

    dim: np.ndarray
    cut: np.ndarray
    cell: np.ndarray
    depth: int

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.intp)
        for _ in range(self.depth):
            d = self.dim[node]
            inner = d >= 0
            right = x[np.arange(len(x)), np.maximum(d, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return self.cell[node]


def _cut_space(sample: np.ndarray, cells: int) -> _Cells:
    depth = max(0, int(np.ceil(np.log2(max(cells, 1)))))
    size = 2 ** (depth + 1) - 1
    dim, cut = np.full(size, -1, dtype=np.intp), np.zeros(size)
    cell = np.zeros(size, dtype=np.int32)
    todo, n_cells = [(0, 0, sample)], 0
    while todo:
        node, level, x = todo.pop()
        split = _halve(x) if level < depth and len(x) > 1 else None
        if split is None:
            cell[node], n_cells = n_cells, n_cells + 1
            continue
        dim[node], cut[node] = split
        left = x[:, split[0]] <= split[1]
        todo += [(2 * node + 1, level + 1, x[left]), (2 * node + 2, level + 1, x[~left])]
    return _Cells(dim, cut, cell, depth)


def _halve(x: np.ndarray) -> tuple[int, float] | None:
    """The widest dimension and a value of it with points on both sides."""
    spread = x.max(axis=0) - x.min(axis=0)
    d = int(spread.argmax())
    if spread[d] <= 0:
        return None
    values = np.sort(x[:, d])
    at = values[(len(values) - 1) // 2]
    return d, float(at if at < values[-1] else values[values < at][-1])


def _nearest(
    x: np.ndarray, own: np.ndarray, bound: np.ndarray, need: np.ndarray, y: np.ndarray, ids: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x``, and ids, distances and weights of their nearest points in ``y`` within ``bound`` up to weight ``need``.

    A matrix product gives all squared distances up to rounding. Only points that these cannot rule out are measured by
    coordinates, so the result does not depend on the product. Points that are not finite are near nothing.
    """
    fine, there = np.flatnonzero(np.isfinite(x).all(axis=1) & (need > 0)), np.isfinite(y).all(axis=1)
    y, ids, weights = y[there], ids[there], weights[there]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
    if not len(fine) or not len(y):
        return found[0]
    centre, k = y.mean(axis=0), int(need.max())
    moved, columns = y - centre, np.ascontiguousarray(y.T)
    squares = (moved * moved).sum(axis=1)
    rounding = 16 * (x.shape[1] + 4) * np.finfo(float).eps
    group = max(1, len(y) // (8 * (k + 1)))
    groups = -(-len(y) // group)
    table = np.zeros((x.shape[1] + 1, group * groups))  # its last row adds the squares; places beyond the points are near nothing
    table[:-1, : len(y)], table[-1, : len(y)], table[-1, len(y) :] = moved.T, squares, np.inf
    step = min(len(fine), max(16, _BLOCK_CELLS // len(y)))
    space = np.empty((step, group * groups))  # taken once: fresh memory costs more than the product
    for a in range(0, len(fine), step):
        at = fine[a : a + step]
        block = x[at] - centre
        size = (block * block).sum(axis=1)
        # squared distances less ``size``
        about = np.matmul(np.column_stack([-2 * block, np.ones(len(at))]), table, out=space[: len(at)]).reshape(len(at), group, groups)
        limit = (bound[at] * (1 + 1e-9)) ** 2 - size
        least = about.min(axis=1)
        if groups > k + 1:  # of the least of each group, one more than wanted, as a point finds itself
            limit = np.minimum(limit, np.partition(least, k, axis=1)[:, k])
        limit = limit + rounding * (size + squares.max())
        row, col = np.divmod(np.flatnonzero(~(least > limit[:, None])), groups)
        which, member = np.nonzero(~(about[row, :, col] > limit[row][:, None]))
        row, col = row[which], member * groups + col[which]
        row, col = row[col < len(y)], col[col < len(y)]
        others = own[at[row]] != ids[col]
        row, col = row[others], col[others]
        d2, own_columns = np.zeros(len(row)), np.ascontiguousarray(x[at].T)
        for mine, theirs in zip(own_columns, columns, strict=True):
            d2 += (mine[row] - theirs[col]) ** 2
        order = np.lexsort((ids[col], d2, row))
        order = order[np.isfinite(d2[order])]
        row, col, distance = at[row[order]], col[order], np.sqrt(d2[order])
        w = weights[col]
        ahead = np.cumsum(w) - w
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
        ahead -= np.repeat(ahead[starts], np.diff(np.r_[starts, len(row)]))
        take = (ahead < need[row]) & (distance <= bound[row])
        found.append((row[take], ids[col[take]], distance[take], w[take]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# lists of neighbours go as bytes of their numbers: Spark moves them whole; the upper halves of most ids are equal, which packs well
_LIST_TYPES = {name: np.dtype(kind) for name, kind in (("nid", "<u4"), ("nid_high", "<i4"), ("d", "<f8"), ("w", "<i4"))}
_LISTS = ", ".join(f"{name} binary" for name in _LIST_TYPES)
_FOUND = f"pid bigint, own bigint, cell bigint, m bigint, {_LISTS}"
_PACKED = f"pid bigint, own bigint, cell bigint, k_distance double, total bigint, {_LISTS}"
_EDGES = "pid bigint, nid bigint, d double, w bigint"


def _listed(rows: pa.Table, counts: np.ndarray, nid: np.ndarray, d: np.ndarray, w: np.ndarray) -> pa.Table:
    """``rows`` with list columns: the next ``counts`` of the values belong to each row."""
    ends = np.r_[0, np.cumsum(counts)]
    for (name, kind), v in zip(_LIST_TYPES.items(), (nid & 0xFFFFFFFF, nid >> 32, d, w), strict=True):
        buffers = [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v, kind))]
        rows = rows.append_column(name, pa.Array.from_buffers(pa.binary(), rows.num_rows, buffers))
    return rows


def unlisted(rows: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    """The row of each neighbour in the list columns, its id and the values ``names``."""
    counts = pa.compute.binary_length(rows.column("nid").combine_chunks()).to_numpy(zero_copy_only=False) // 4
    low, high, *more = (_numbers(rows, name) for name in ("nid", "nid_high", *names))
    return np.repeat(np.arange(rows.num_rows), counts), (high.astype(np.int64) << 32) | low, *more


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    lists = rows.column(name).combine_chunks()
    _, offsets, data = lists.buffers()
    if not len(lists) or data is None:
        return np.empty(0, _LIST_TYPES[name])
    first, last = np.frombuffer(offsets, np.int32)[[lists.offset, lists.offset + len(lists)]]
    return np.frombuffer(data, np.uint8)[first:last].view(_LIST_TYPES[name])


def _matrix(v: pa.Array | pa.ChunkedArray) -> np.ndarray:
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def _checked(table: DataFrame) -> DataFrame:
    """A stored table with one row per cell, broadcast if it has few rows; else every cell is a small part of all rows."""
    return F.broadcast(table) if table.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS else table


def _parts(rows: Column, rows_per_part: int) -> Column:
    return (F.floor(rows / rows_per_part) + 1).cast("int")


def _copied(table: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """``table`` once for each of the ``n`` parts of its cell, as columns of its own: it meets rows of the same table."""
    part = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part")
    return table.join(parts, key).select(*[F.col(c).alias(c) for c in table.columns], part)


def _dealt(table: DataFrame, parts: DataFrame, key: str, by: str = "pid") -> DataFrame:
    """``table`` with the part of its cell that a row belongs to."""
    return table.join(parts, key).withColumn("part", F.pmod(F.hash(by), F.col("n"))).drop("n")


def _cell_trees(drawn: DataFrame) -> DataFrame:
    """``cell`` and its tree from sampled rows ``cell, v, wanted``."""

    def cut(rows: pa.Table) -> pa.Table:
        tree = _cut_space(_matrix(rows.column("v")), rows.column("wanted")[0].as_py())
        out = {"cell": [rows.column("cell")[0].as_py()], "dim": [tree.dim.tolist()], "cut": [tree.cut.tolist()]}
        return pa.table(
            out | {"leaf": [tree.cell.tolist()], "depth": [tree.depth]},
            schema=pa.schema([("cell", pa.int64()), ("dim", pa.list_(pa.int32())), ("cut", pa.list_(pa.float64())),
                              ("leaf", pa.list_(pa.int32())), ("depth", pa.int32())]),
        )

    kind = "cell bigint, dim array<int>, cut array<double>, leaf array<int>, depth int"
    return drawn.groupBy("cell").applyInArrow(cut, kind)


def place(points: DataFrame, cell_rows: int, bits: int = _BITS) -> tuple[DataFrame, int]:
    """``pid, v, m, cell`` and the number of levels: cells of more than twice ``cell_rows`` are cut until there are none.

    The number of a cell has ``bits`` bits for every level, those of the first cut in front.
    """
    start = points.select("pid", F.col("v").cast("array<double>").alias("v"), "m", F.lit(0).cast("bigint").alias("cell"))
    placed, levels = materialise(start, "cells"), 0

    def relocate(rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["pid", "v", "m", "cell"])
        dim, cut, leaf = (np.array(trees.column(c)[0].as_py()) for c in ("dim", "cut", "leaf"))
        found = _Cells(dim, cut, leaf, trees.column("depth")[0].as_py()).locate(_matrix(rows.column("v")))
        cells = (rows.column("cell").to_numpy() << bits) + found
        return pa.table([*(rows.column(c) for c in ("pid", "v", "m")), pa.array(cells, pa.int64())], ["pid", "v", "m", "cell"])

    while levels < _LEVELS * _BITS // bits:
        sizes = placed.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * cell_rows)
        wanted = F.least(F.lit(1 << bits), F.ceil(F.col("rows") / cell_rows)).cast("int").alias("wanted")
        crowded = materialise(sizes.select("cell", "rows", wanted), "crowded")
        if crowded.isEmpty():
            break
        small = _checked(crowded)
        share = 1.2 * _SAMPLE_PER_CELL * F.col("wanted") / F.col("rows")
        drawn = placed.join(small, "cell").where(F.pmod(F.xxhash64("pid", F.lit(levels)), F.lit(1 << 20)) < share * (1 << 20))
        trees = materialise(_cell_trees(drawn.select("cell", "v", "wanted")), "trees")
        parts = _checked(materialise(trees.select("cell").join(small, "cell").select("cell", _parts(F.col("rows"), _PART_ROWS).alias("n")), "parts"))
        moved = (
            _dealt(placed, parts, "cell")
            .groupBy("cell", "part")
            .cogroup(_copied(trees, parts, "cell").groupBy("cell", "part"))
            .applyInArrow(relocate, "pid bigint, v array<double>, m bigint, cell bigint")
        )
        same = placed.join(parts, "cell", "left_anti").withColumn("cell", F.shiftleft("cell", bits))
        placed, levels = materialise(moved.unionByName(same), "cells"), levels + 1
    return placed, levels


def _needed(left: pa.Table, k: int) -> np.ndarray:
    """The weight a point lacks from others: its own copies come first."""
    return np.maximum(k - (left.column("m").to_numpy() - 1), 0)


def _edges_between(left: pa.Table, right: pa.Table, bound: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    pids, ids, weights = left.column("pid").to_numpy(), right.column("pid").to_numpy(), right.column("m").to_numpy()
    return _nearest(_matrix(left.column("v")), pids, bound, _needed(left, k), _matrix(right.column("v")), ids, weights)


def cogrouped_with_cells(visits: DataFrame, hosts: DataFrame, cell_rows: int):
    """Visits ``pid, cell`` (and more) with the ``hosts`` of their cell, in parts of bounded size."""
    sizes = visits.groupBy("cell").agg(_parts(F.count("*"), 4 * cell_rows).alias("n"))
    parts = _checked(materialise(sizes, "parts"))
    hosts = _copied(hosts, parts, "cell")
    return _dealt(visits, parts, "cell").groupBy("cell", "part").cogroup(hosts.groupBy("cell", "part"))


def _own_reach(placed: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """``pid, v, m, cell, reach``: the distance within which the own cell has weight ``k``; infinite if it has less."""

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(["pid", "v", "m", "cell"])
        reach = np.zeros(left.num_rows)
        if left.num_rows:
            row, _, d, w = _edges_between(left, right, np.full(left.num_rows, np.inf), k)
            np.maximum.at(reach, row, d)
            reach[np.bincount(row, w, left.num_rows) < _needed(left, k)] = np.inf
        return left.append_column("reach", pa.array(reach))

    grouped = cogrouped_with_cells(placed, placed.select("cell", "pid", "v", "m"), cell_rows)
    return grouped.applyInArrow(visit, "pid bigint, v array<double>, m bigint, cell bigint, reach double")


def _packed(left: pa.Table, right: pa.Table, bound: np.ndarray, k: int) -> pa.Table:
    """A row for every visit that finds something and for every point in its own cell, with lists of what is found."""
    if not left.num_rows or not right.num_rows:  # the empty side has no columns
        fields = [("pid", pa.int64()), ("own", pa.int64()), ("cell", pa.int64()), ("m", pa.int64())]
        return pa.schema([*fields, *((name, pa.binary()) for name in _LIST_TYPES)]).empty_table()
    row, nid, d, w = _edges_between(left, right, bound, k)
    counts = np.bincount(row, minlength=left.num_rows)
    kept = (counts > 0) | (left.column("own").to_numpy() == left.column("cell").to_numpy())
    rows = left.select(["pid", "own", "cell", "m"]).filter(pa.array(kept))
    return _listed(rows, counts[kept], nid=nid, d=d, w=np.minimum(w, k))


def _search(visits: DataFrame, placed: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """For each visit ``pid, v, m, cell, reach, own`` the neighbours in that cell, no farther than the reach, as lists."""

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        bound = left.column("reach").to_numpy() if left.num_rows else None
        return _packed(left, right, bound, k)

    found = cogrouped_with_cells(visits, placed.select("cell", "pid", "v", "m"), cell_rows).applyInArrow(visit, _FOUND)
    return _bucketed(found, visits.count())


def _by_blocks(points: DataFrame, k: int) -> DataFrame:
    """Every point's nearest in each block of points, by all pairs of blocks, as lists; the cell is the other block.

    The work is quadratic; a task holds two blocks, and each point goes to twice as many tasks as there are blocks.
    """
    points = materialise(points.select("pid", F.col("v").cast("array<double>").alias("v"), "m"), "points")
    n = points.count()
    blocks = max(1, -(-n // _BLOCK_ROWS), min(_LEAST_BLOCKS, -(-n // _LEAST_ROWS)))
    own, other = F.pmod(F.xxhash64("pid"), F.lit(blocks)), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))
    left = points.select("pid", "v", "m", own.alias("own"), other.alias("cell"))
    # as columns of its own: it meets rows of the same table
    right = points.select(*[F.col(c).alias(c) for c in ("pid", "v", "m")], other.alias("own"), own.alias("cell"))

    def visit(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return _packed(mine, theirs, np.full(mine.num_rows, np.inf), k)

    found = left.groupBy("own", "cell").cogroup(right.groupBy("own", "cell")).applyInArrow(visit, _FOUND)
    return _bucketed(found, n * blocks)


def _ranked(rows: pa.Table, k: int) -> pa.Table:
    pid, own, cell, m = (rows.column(c).to_numpy() for c in ("pid", "own", "cell", "m"))
    at, nid, d, w = unlisted(rows, "d", "w")
    mine = own == cell
    copied = np.flatnonzero(mine & (m > 1))
    at, nid, d = np.r_[at, copied], np.r_[nid, pid[copied]], np.r_[d, np.zeros(len(copied))]
    w = np.r_[w, np.minimum(m[copied] - 1, k)]
    order = np.lexsort((nid, d, pid[at]))
    at, nid, d, w = at[order], nid[order], d[order], w[order].astype(np.int64)
    points, first = np.unique(pid[at], return_index=True)
    ahead = np.cumsum(w) - w
    ahead -= np.repeat(ahead[first], np.diff(np.r_[first, len(at)]))
    kept = ahead < k
    w = np.minimum(w, k - ahead)
    # as distances rise, that of the last one kept is the largest
    last = first + np.add.reduceat(kept, first, dtype=np.int64) - 1 if len(first) else first
    order = np.flatnonzero(kept)[np.argsort(at[kept], kind="stable")]
    counts = np.bincount(at[order], minlength=rows.num_rows)
    out = np.flatnonzero((counts > 0) | (mine & np.isin(pid, points)))
    last = last[np.searchsorted(points, pid[out])]
    found = [pa.array(c) for c in (pid[out], own[out], cell[out], d[last], (ahead + w)[last])]
    packed = pa.table(found, ["pid", "own", "cell", "k_distance", "total"])
    return _listed(packed, counts[out], nid=nid[order], d=d[order], w=w[order])


def _bucketed(found: DataFrame, visits: int) -> DataFrame:
    """``found`` with a bucket of its point, one for some 20,000 of the ``visits``."""
    return found.withColumn("bucket", F.pmod(F.xxhash64("pid"), F.lit(visits // _MERGE_VISITS + 1)))


def _best(found: DataFrame, k: int) -> DataFrame:
    """Neighbours of each point, nearest first by ``(d, nid)``, until their weights add up to ``k``; points without any are left out.

    ``pid, own, cell, k_distance, total`` and lists ``nid, d, w``: a row for the neighbours in each ``cell``, and for each point
    one whose cell is its ``own``.
    """
    return found.groupBy("bucket").applyInArrow(lambda rows: _ranked(rows, k), _PACKED)


def _boxes(placed: DataFrame, shift: int, bits: int, width: int) -> DataFrame:
    """``node, child, weight, lo, hi``: the bounding boxes of the cells of one level under those of the level above."""
    child = F.shiftright("cell", shift)
    edges = [f(F.get("v", i)).alias(f"{s}{i}") for s, f in (("lo", F.min), ("hi", F.max)) for i in range(width)]
    boxes = placed.groupBy(child.alias("child")).agg(F.sum("m").alias("weight"), *edges)
    sides = (F.array(*[f"{s}{i}" for i in range(width)]).alias(s) for s in ("lo", "hi"))
    return boxes.select(F.shiftright("child", bits).alias("node"), "child", "weight", *sides)


def _enclosing(x: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each row of ``x`` has boxes of a weight above ``k``, as a point counts itself; infinite if there are none."""
    found = np.full(len(x), np.inf)
    for i, c in enumerate(x):
        far = np.sqrt((np.maximum(np.abs(c - low), np.abs(high - c)) ** 2).sum(axis=1))
        order = np.argsort(far)
        enough = np.searchsorted(np.cumsum(weights[order]), k + 1)
        if enough < len(order) and np.isfinite(far[order[enough]]):
            found[i] = far[order[enough]] * (1 + 1e-9)
    return found


def _touched(visits: DataFrame, boxes: DataFrame, shift: int, k: int) -> DataFrame:
    """Visits ``pid, v, m, reach, own, cell`` of the children of each visited ``cell`` whose boxes are within reach.

    ``shift`` 0 is the last level, where the own cell of a point is left out. Points of one cell are looked at together, in the
    order of their reach: only boxes near their common box are compared with each of them, so the work of a point does not
    grow with the number of boxes. An infinite reach is first brought down to that of the nearest boxes with enough weight.
    """
    sizes = visits.groupBy("cell").agg(_parts(F.count("*"), _TOUCH_ROWS).alias("n"))
    parts = _checked(materialise(sizes, "parts"))
    right = _copied(boxes.withColumnRenamed("node", "cell"), parts, "cell")

    def touch(points: pa.Table, children: pa.Table) -> pa.Table:
        rows, cells, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.empty(0)
        if points.num_rows:
            far = points.column("reach").to_numpy()
        if points.num_rows and children.num_rows:
            names, low, high = children.column("child").to_numpy(), _matrix(children.column("lo")), _matrix(children.column("hi"))
            x, own_cell, open_ = _matrix(points.column("v")), points.column("own").to_numpy(), np.isinf(far)
            if open_.any():
                far = far.copy()
                far[open_] = _enclosing(x[open_], low, high, children.column("weight").to_numpy(), k)
            order = np.lexsort((far, own_cell))
            for a in range(0, len(x), _TOUCH_STEP):
                part = order[a : a + _TOUCH_STEP]
                most, least = np.fmax.reduce(x[part]), np.fmin.reduce(x[part])
                apart = np.maximum(np.maximum(low - most, least - high), 0.0)
                # A hair of slack: box and point distances round differently.
                boxes_ = np.flatnonzero(~(np.sqrt((apart**2).sum(axis=1)) * (1 - 1e-9) > far[part].max()))
                squares = np.zeros((len(part), len(boxes_)))
                for j in range(x.shape[1]):
                    c = x[part, j][:, None]
                    squares += np.maximum(np.maximum(low[boxes_, j] - c, c - high[boxes_, j]), 0.0) ** 2
                near = np.sqrt(squares) * (1 - 1e-9) <= far[part][:, None]
                if shift == 0:
                    near &= names[boxes_] != own_cell[part][:, None]
                row, at = np.nonzero(near)
                rows.append(part[row])
                cells.append(names[boxes_[at]])
        kept = points.select(["pid", "v", "m"]).append_column("reach", pa.array(far)).append_column("own", points.column("own"))
        return kept.take(pa.array(np.concatenate(rows))).append_column("cell", pa.array(np.concatenate(cells)))

    grouped = _dealt(visits, parts, "cell", "own").groupBy("cell", "part").cogroup(right.groupBy("cell", "part"))
    return grouped.applyInArrow(touch, "pid bigint, v array<double>, m bigint, reach double, own bigint, cell bigint")


def packed_neighbours(points: DataFrame, k: int, cell_rows: int = 2_000, bits: int = _BITS) -> DataFrame:
    """The neighbours that ``nearest_neighbours`` gives, as lists by the cell they are in (see ``_best``).

    Boxes do not help in many dimensions, so wide points are compared block by block.
    """
    width = points.agg(F.max(F.size("v"))).first()[0] or 0
    if width > _BOX_WIDTH:
        return _best(_by_blocks(points, k), k)
    placed, levels = place(points, cell_rows, bits)
    own = F.col("cell").alias("own")
    if levels == 0:
        return _best(_search(placed.select("*", F.lit(float("inf")).alias("reach"), own), placed, k, cell_rows), k)
    # what a point finds in its own cell bounds its search; only that distance is kept, not the neighbours
    reached = materialise(_own_reach(placed, k, cell_rows), "reach").select("pid", "v", "m", "reach", own, "cell")
    visits = reached.where("reach > 0").withColumn("cell", F.lit(0).cast("bigint"))
    for level in range(1, levels + 1):
        shift = bits * (levels - level)
        boxes = materialise(_boxes(placed, shift, bits, width), "boxes")
        visits = materialise(_touched(visits, boxes, shift, k), "visits")
    return _best(_search(reached.unionByName(visits), placed, k, cell_rows), k)


def nearest_neighbours(points: DataFrame, k: int, cell_rows: int = 2_000, bits: int = _BITS) -> DataFrame:
    """``pid, nid, d, w`` over ``points (pid, v, m)``: the neighbours of each point, nearest first by
    ``(d, nid)``, with weights that add up to ``k`` (fewer only if the table is smaller).

    The other copies of a point are its first neighbour, at distance 0. An empty table gives no rows.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nid, d, w = unlisted(pa.Table.from_batches([batch]), "d", "w")
            yield pa.record_batch([pa.array(c) for c in (batch.column("pid").to_numpy()[at], nid, d, w.astype(np.int64))], ["pid", "nid", "d", "w"])

    return packed_neighbours(points, k, cell_rows, bits).select("pid", *_LIST_TYPES).mapInArrow(flat, _EDGES)
