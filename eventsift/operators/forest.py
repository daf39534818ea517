"""Isolation forest: sampling, tree fitting and scoring on DataFrames.

Liu, Ting and Zhou: Isolation Forest, ICDM 2008.
"""

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventsift.schema import DEFAULT_TREES, MAX_SAMPLES, RANDOM_SEED
from eventsift.storage import materialise

NODE_SCHEMA = "tree_id int, node_id int, feature int, threshold double, n_samples int, depth int"

_KEY_BITS = 60

# Fixed value: a feature with a smaller range inside a node counts as constant there.
_SAME = 1e-7


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def sample_key(id_col: str, round_col: Column, seed: int) -> Column:
    """Uniform 60-bit number of a row in a sampling round."""
    text = F.concat_ws("-", F.col(id_col).cast("string"), round_col.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, _KEY_BITS // 4), 16, 10).cast("bigint")


def sample_trees(
    df: DataFrame,
    n_rows: int,
    trees: int = DEFAULT_TREES,
    max_samples: int = MAX_SAMPLES,
    seed: int = RANDOM_SEED,
    id_col: str = "event_id",
) -> DataFrame:
    """``df`` columns plus ``tree_id, sample_key``: for every tree min(max_samples, n) distinct rows.

    A round sorts rows by a hash of their id and deals them out in runs of ``max_samples``, so
    each tree gets a uniform sample without replacement and the trees of a round share no row.
    A large table needs one round, and of it only rows with a small hash go beyond the scan:
    about trees x max_samples of them, whatever the table holds. A small table takes several
    rounds, together at most about 2 x trees x max_samples rows.
    """
    size = min(max_samples, n_rows)
    per_round = min(trees, max(1, n_rows // size))
    rounds = math.ceil(trees / per_round)
    need = per_round * size
    round_no = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))) if rounds > 1 else F.lit(0)
    keyed = df.withColumn("_round", round_no).withColumn("sample_key", sample_key(id_col, F.col("_round"), seed))
    if rounds == 1 and n_rows > 4 * need:
        share = (need + 8 * math.sqrt(need) + 64) / n_rows
        few = materialise(keyed.filter(F.col("sample_key") < int(share * 2**_KEY_BITS)), "sample")
        while share < 1 and few.count() < need:  # by a freak of the hash (8 standard deviations), or with equal ids
            share = min(1.0, max(2 * share, need / n_rows))
            few = materialise(keyed.filter(F.col("sample_key") < int(share * 2**_KEY_BITS)), "sample")
        keyed = few
    rank = F.row_number().over(Window.partitionBy("_round").orderBy("sample_key", id_col)) - 1
    return (
        keyed.withColumn("_rank", rank)
        .filter(F.col("_rank") < need)
        .withColumn("tree_id", (F.col("_round") * per_round + F.floor(F.col("_rank") / size)).cast("int"))
        .filter(F.col("tree_id") < trees)
        .drop("_round", "_rank")
    )


def _draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two uniform numbers in [0, 1) of a node: they depend on nothing else, so any engine can repeat a tree."""
    digits = hashlib.md5(f"{seed}-{tree}-{node}".encode()).hexdigest()
    return int(digits[:12], 16) / 2**48, int(digits[12:24], 16) / 2**48


def _grow(x: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple]:
    """Nodes of one tree, numbered like a binary heap: the children of i are 2i+1 and 2i+2."""
    nodes = []
    todo = [(0, 0, x)]
    while todo:
        node, depth, part = todo.pop()
        open_features = ()
        if depth < limit and len(part) > 1:
            low, high = part.min(axis=0), part.max(axis=0)
            open_features = np.flatnonzero(high > low + _SAME)
        if len(open_features) == 0:
            nodes.append((node, -1, 0.0, len(part), depth))
            continue
        pick, share = _draws(seed, tree, node)
        feature = int(open_features[int(pick * len(open_features))])
        cut = low[feature] + share * (high[feature] - low[feature])
        if cut >= high[feature]:
            cut = low[feature]
        left = part[:, feature] <= cut
        nodes.append((node, feature, float(cut), len(part), depth))
        todo.append((2 * node + 1, depth + 1, part[left]))
        todo.append((2 * node + 2, depth + 1, part[~left]))
    return nodes


def fit_nodes(samples: DataFrame, features: list[str], max_samples: int, seed: int = RANDOM_SEED) -> DataFrame:
    """One group of at most ``max_samples`` rows per tree; same samples, same trees."""
    limit = math.ceil(math.log2(max(max_samples, 2)))

    def fit_tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample_key", kind="stable")
        nodes = _grow(rows[features].to_numpy(dtype=float), seed, int(key[0]), limit)
        out = pd.DataFrame(nodes, columns=["node_id", "feature", "threshold", "n_samples", "depth"])
        out.insert(0, "tree_id", int(key[0]))
        return out

    # A stated number of partitions is kept: few bytes here, but a lot of work per byte.
    cores = samples.sparkSession.sparkContext.defaultParallelism
    narrow = samples.select("tree_id", "sample_key", *features).repartition(2 * cores, "tree_id")
    return narrow.groupBy("tree_id").applyInPandas(fit_tree, NODE_SCHEMA)


@dataclass
class Forest:
    """Fitted trees: at most trees x (2 x max_samples - 1) nodes, held on the driver."""

    features: list[str]
    n_trees: int
    max_samples: int
    nodes: list[tuple] = field(repr=False)

    @property
    def depth(self) -> int:
        return math.ceil(math.log2(max(self.max_samples, 2)))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, threshold and path length per heap slot, trees back to back.

        A leaf above the lowest level gets a chain of always-left slots below it, so every row
        takes the same number of steps.
        """
        width = 2 ** (self.depth + 1) - 1
        feature = np.zeros(self.n_trees * width, dtype=np.intp)
        threshold = np.full(self.n_trees * width, np.inf)
        path = np.zeros(self.n_trees * width)
        for tree, node, f, cut, n, depth in self.nodes:
            if f >= 0:
                feature[tree * width + node], threshold[tree * width + node] = f, cut
                continue
            slot = node
            for _ in range(depth, self.depth):
                slot = 2 * slot + 1
            path[tree * width + slot] = depth + average_path(n)
        return feature, threshold, path

    def raw_score(self) -> Column:
        """Anomaly score in (0, 1); higher is easier to isolate."""
        return _score_udf(self)(*[F.col(c) for c in self.features])


def _score_udf(forest: Forest):
    feature, threshold, path = forest.arrays()
    n_trees, depth = forest.n_trees, forest.depth
    width = 2 ** (depth + 1) - 1
    usual = n_trees * average_path(forest.max_samples)

    @F.arrow_udf("double")
    def score(*columns: pa.Array) -> pa.Array:
        x = np.column_stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float)) for c in columns])
        root = np.arange(n_trees, dtype=np.intp) * width
        out = np.empty(len(x))
        for a in range(0, len(x), 256):
            block = np.ascontiguousarray(x[a : a + 256])
            values = block.ravel()
            start = (np.arange(len(block), dtype=np.intp) * block.shape[1])[:, None]
            at = np.broadcast_to(root, (len(block), n_trees))
            for _ in range(depth):
                right = values.take(start + feature.take(at)) > threshold.take(at)
                at = 2 * at - root + 1 + right
            out[a : a + 256] = path.take(at).sum(axis=1)
        return pa.array(np.exp2(-(out / usual if usual else np.ones_like(out))))

    return score


def fit_forest(
    df: DataFrame,
    features: list[str],
    n_rows: int,
    trees: int = DEFAULT_TREES,
    max_samples: int = MAX_SAMPLES,
    seed: int = RANDOM_SEED,
    id_col: str = "event_id",
) -> Forest:
    size = min(max_samples, n_rows)
    samples = sample_trees(df.select(id_col, *features), n_rows, trees, max_samples, seed, id_col)
    nodes = [tuple(r) for r in fit_nodes(samples, features, size, seed).collect()]
    return Forest(list(features), trees, size, nodes)
