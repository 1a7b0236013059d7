"""Isolation forest (Liu, Ting, Zhou, ICDM 2008)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.vectors import matrix_of, once
from tarn.operators.ranking import newest_rows, top_n_per_group
from tarn.session import cut_lineage

TREE_SCHEMA = "tree int, depth int, feature array<int>, threshold array<double>, left array<int>, length array<double>"


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, seed: int) -> dict:
    """One tree as arrays. A leaf has ``left = -1``; the right child follows the left one."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(2, len(points))))
    feature, threshold, left, length = [0], [0.0], [-1], [0.0]
    deepest = 0
    todo = [(0, points, 0)]
    while todo:
        node, rows, depth = todo.pop()
        deepest = max(deepest, depth)
        length[node] = depth + mean_path(len(rows))
        if depth >= limit or len(rows) <= 1:
            continue
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if not len(open_features):
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        below = rows[:, f] <= cut
        feature[node], threshold[node], left[node] = f, cut, len(left)
        for part in (rows[below], rows[~below]):
            todo.append((len(left), part, depth + 1))
            feature.append(0)
            threshold.append(0.0)
            left.append(-1)
            length.append(0.0)
    return {"depth": deepest, "feature": feature, "threshold": threshold, "left": left, "length": length}


@dataclass(frozen=True)
class Forest:
    """Fitted trees: at most ``trees x 2 x sample`` nodes, whatever the size of the table.

    A leaf points to itself and has an infinite threshold, so all rows can take the same number of
    steps without asking who has arrived.
    """

    trees: list[dict[str, np.ndarray]]
    sample: int

    @classmethod
    def of(cls, grown: list, sample: int) -> Forest:
        trees = []
        for t in grown:
            left = np.array(t.left, dtype=np.int32)
            leaf = left < 0
            trees.append(
                {
                    "feature": np.array(t.feature, dtype=np.int32),
                    "threshold": np.where(leaf, np.inf, np.array(t.threshold)),
                    "left": np.where(leaf, np.arange(len(left), dtype=np.int32), left).astype(np.int32),
                    "length": np.array(t.length),
                    "depth": t.depth,
                }
            )
        return cls(trees, sample)

    def score(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        flat, start = points.ravel(), np.arange(len(points)) * points.shape[1]
        for tree in self.trees:
            node = np.zeros(len(points), dtype=np.int32)
            for _ in range(tree["depth"]):
                value = flat.take(start + tree["feature"].take(node))
                node = tree["left"].take(node) + (value > tree["threshold"].take(node))
            total += tree["length"].take(node)
        normal = mean_path(self.sample) or 1.0
        return np.power(2.0, -total / max(1, len(self.trees)) / normal)


def _as_points(vectors: pd.Series) -> np.ndarray:
    """Vectors as a matrix; a missing number counts as zero."""
    points = np.concatenate(vectors.tolist()).astype(np.float64, copy=False).reshape(len(vectors), -1)
    return np.nan_to_num(points)


def _tree_choice(key: Sequence[str], n: int, trees: int, sample: int, seed: int) -> Column:
    """Trees a row is drawn for, from hashes of its key; empty for nearly every row of a big table.

    A hash is cut into intervals of width ``2 x sample / n``, one per tree. One hash serves as many
    trees as fit, so a large table needs a single hash per row instead of one per tree.
    """
    width = min(1.0, 2.0 * sample / max(1, n))
    per_hash = min(trees, max(1, int(1.0 / width)))
    hashes = math.ceil(trees / per_hash)
    chosen = []
    for h in range(hashes):
        bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed), F.lit(h)), 11)
        slot = F.floor(bits / F.lit(float(1 << 53)) / F.lit(width))
        first = h * per_hash
        chosen.append(F.when(slot < min(per_hash, trees - first), (slot + first).cast("int")))
    return F.array_compact(F.array(*chosen))


def fit_forest(
    df: DataFrame,
    features: str,
    key: Sequence[str],
    seed: int = 42,
    trees: int = 100,
    sample: int = 256,
) -> Forest:
    """Grow all trees in parallel, each from its own hashed sample of ``sample`` rows."""
    n = df.count()
    size = min(sample, n)
    drawn = df.select(*key, F.col(features).alias("_features")).withColumn(
        "tree", F.explode(_tree_choice(key, n, trees, sample, seed))
    )
    order = [F.xxhash64(*key, F.lit(seed), F.col("tree")), *[F.col(c) for c in key]]
    sampled = top_n_per_group(drawn, ["tree"], order, size)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        tree = int(rows["tree"].iloc[0])
        return pd.DataFrame([{"tree": tree, **_grow(_as_points(rows["_features"]), seed * 100_003 + tree)}])

    grown = sampled.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).orderBy("tree").collect()
    return Forest.of(grown, size)


def score_rows(df: DataFrame, features: str, forest: Forest) -> DataFrame:
    """Add ``score``: near one for rows that few splits set apart."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(np.nan_to_num(matrix_of(vectors))))

    return df.withColumn("score", once(score)(F.col(features)))


def order_statistic(df: DataFrame, column: str, rank: int, bins: int = 4096, small: int = 100_000) -> float:
    """The exact ``rank``-th smallest value (from 1) of a column of numbers.

    Values are counted in bins between known limits, and the bin that holds the rank is counted again, until it has
    few rows or one value. A round brings at most ``bins`` counts to the driver, the last one ``small`` values.
    """
    low, high, rows = df.agg(F.min(column), F.max(column), F.count(column)).first()
    value = F.col(column)
    inside = df.select(column).where(value.isNotNull())
    while low < high and rows > small:
        width = (high - low) / bins
        place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        counts = (
            inside.where((value >= low) & (value <= high))
            .groupBy(place.alias("bin"))
            .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .orderBy("bin")
            .collect()
        )
        for c in counts:
            if rank <= c.n:
                low, high, rows = c.low, c.high, c.n
                break
            rank -= c.n
    if low == high:
        return low
    return sorted(r[0] for r in inside.where((value >= low) & (value <= high)).collect())[rank - 1]


def isolation_forest(
    df: DataFrame,
    features: str,
    key: Sequence[str],
    contamination: float = 0.05,
    seed: int = 42,
    trees: int = 100,
    sample: int = 256,
    newest: tuple[str, int] | None = None,
) -> DataFrame:
    """Add ``score`` and ``is_anomaly``; the vector column is dropped.

    ``key`` identifies a row. ``newest=("source_date", 5000)`` restricts the run to the newest rows.
    Scores are stored once and read again, for the exact cut and for the result.
    """
    if newest is not None:
        df = cut_lineage(newest_rows(df, newest[0], newest[1], key[0]))
    forest = fit_forest(df, features, key, seed, trees, sample)
    scored = cut_lineage(score_rows(df, features, forest).drop(features))
    rows = scored.count()
    if not rows:
        return scored.withColumn("is_anomaly", F.lit(False))
    cut = order_statistic(scored, "score", max(1, math.ceil((1.0 - contamination) * rows)))
    return scored.withColumn("is_anomaly", F.col("score") > F.lit(cut))
