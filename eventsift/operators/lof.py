"""Local outlier factor over exact neighbours.

Breunig, Kriegel, Ng and Sander: LOF, SIGMOD 2000.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventsift.operators.neighbours import cogrouped_with_cells, distinct_points, packed_neighbours, unlisted
from eventsift.operators.scores import thresholds
from eventsift.schema import DEFAULT_CONTAMINATION
from eventsift.storage import materialise

DEFAULT_NEIGHBOURS = 20

# Fixed value: keeps the density of points without any distance finite.
_TINY = 1e-10

_CROWDED = 1_000_000
_BROADCAST_VECTORS = 100_000


def _sums(edges: DataFrame, values: DataFrame, cell_rows: int, reached: bool) -> DataFrame:
    """``edges`` without their lists, with ``part``: the weighted sum over a row's neighbours of ``values (cell, pid, value)``,
    or of the distance where that is larger (``reached``); and ``value`` of the point itself, in its own cell alone.
    """
    names = ["pid", "own", "cell", "k_distance", "total"]
    lists = ["w", "d"] if reached else ["w"]

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # the empty side has no columns
            return nothing
        order = np.argsort(right.column("pid").to_numpy(), kind="stable")
        ids, known = right.column("pid").to_numpy()[order], right.column("value").to_numpy()[order]
        at, nid, w, *d = unlisted(left, *lists)
        each = known[np.searchsorted(ids, nid)]
        part = np.bincount(at, (np.maximum(each, d[0]) if reached else each) * w, left.num_rows)
        mine, value = left.column("own").to_numpy() == left.column("cell").to_numpy(), np.zeros(left.num_rows)
        value[mine] = known[np.searchsorted(ids, left.column("pid").to_numpy()[mine])]
        return left.select(names).append_column("part", pa.array(part)).append_column("value", pa.array(value, mask=~mine))

    kind = "pid bigint, own bigint, cell bigint, k_distance double, total bigint, part double, value double"
    types = {"bigint": pa.int64(), "double": pa.float64()}
    nothing = pa.schema([(name, types[of]) for name, of in map(str.split, kind.split(", "))]).empty_table()
    return cogrouped_with_cells(edges.select(*names, "nid", "nid_high", *lists), values, cell_rows).applyInArrow(add, kind)


def point_factors(edges: DataFrame, cell_rows: int = 2_000) -> DataFrame:
    """``pid, k_distance, density, lof`` from the lists of ``packed_neighbours``.

    What a point needs of its neighbours is looked up in the cell they are in, so lists move whole and only sums are joined.
    """
    home = F.col("cell") == F.col("own")
    distances = edges.where(home).select("cell", "pid", F.col("k_distance").alias("value"))
    sums = _sums(edges, distances, cell_rows, reached=True)
    whole = F.sum("part").over(Window.partitionBy("pid"))
    density = (1.0 / (whole / F.col("total") + _TINY)).alias("value")
    densities = materialise(sums.select("cell", "pid", density, home.alias("home")).where("home").drop("home"), "density")
    near = _sums(edges, densities, cell_rows, reached=False).groupBy("pid")
    found = near.agg(F.sum("part").alias("_sum"), *[F.max(c).alias(n) for c, n in (("k_distance", "k_distance"), ("total", "_w"), ("value", "density"))])
    return found.select("pid", "k_distance", "density", (F.col("_sum") / F.col("_w") / F.col("density")).alias("lof"))


def _back_to_rows(rows: DataFrame, points: DataFrame, factors: DataFrame, id_col: str) -> DataFrame:
    """Every row with the factors of its vector; vectors of very many rows are joined in several parts."""
    crowded = points.filter(F.col("m") > _CROWDED).select("v", (F.floor(F.col("m") / _CROWDED) + 1).cast("int").alias("n"))
    n_crowded = crowded.count()
    if n_crowded == 0:
        # sorted by one number instead of by vectors; an equality of vectors would become a key of the join
        key = F.xxhash64("v").alias("_key")
        known = factors.select(F.col("v").alias("_v"), key, *[c for c in factors.columns if c not in ("v", "m")])
        return rows.select("*", key).join(known, "_key").where("v <= _v and v >= _v").drop("v", "_v", "_key")
    # At most rows / _CROWDED vectors; too many to broadcast only beyond 10^11 crowded rows.
    sizes = F.broadcast(crowded) if n_crowded <= _BROADCAST_VECTORS else crowded
    parts = F.when(F.col("m") > _CROWDED, F.floor(F.col("m") / _CROWDED)).otherwise(0).cast("int")
    copies = factors.withColumn("part", F.explode(F.sequence(F.lit(0), parts))).drop("m")
    placed = rows.join(sizes, "v", "left").withColumn("part", F.pmod(F.hash(id_col), F.coalesce("n", F.lit(1)))).drop("n")
    return placed.join(copies, ["v", "part"]).drop("v", "part")


def local_outlier_factor(
    df: DataFrame,
    features: list[str] | str,
    n_neighbors: int = DEFAULT_NEIGHBOURS,
    contamination: float = DEFAULT_CONTAMINATION,
    id_col: str = "event_id",
    cell_rows: int = 2_000,
) -> DataFrame:
    """``id, k_distance, density, lof, is_anomaly`` of every row.

    ``features`` names numeric columns or one array column. The flag marks the share
    ``contamination`` of rows with the largest factors.
    """
    vector = F.col(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    rows = materialise(df.select(id_col, vector.cast("array<double>").alias("v")), "vectors")
    n = rows.count()
    k = max(1, min(n_neighbors, n - 1))
    points = materialise(distinct_points(rows, "v", id_col), "points")
    edges = materialise(packed_neighbours(points, k, cell_rows), "edges")
    factors = points.select("pid", "v", "m").join(point_factors(edges, cell_rows), "pid").drop("pid")
    scored = materialise(_back_to_rows(rows, points, factors, id_col), "lof")
    (cut,) = thresholds(scored, "lof", [contamination])
    return scored.withColumn("is_anomaly", F.col("lof") > F.lit(cut))
