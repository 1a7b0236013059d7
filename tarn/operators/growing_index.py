"""A vector index that takes new rows in: appended to their cells, and cells that grow too large split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.vectors import matrix_of
from tarn.operators.similarity import ANGLE, BATCH, CELL, CENTRE_BYTES, _angles, _placed, _unit_rows, read_centres, write_centres
from tarn.session import cut_lineage, remove_path
from tarn.sources.lake import is_absent

#: A cell is split into at most so many, by k-means over about so many of its rows per new cell.
MOST_PARTS = 16
SAMPLE_PER_PART = 256
#: Without a limit of its own, an index splits cells of so many times the mean size.
CROWDED = 4


def _applied(spark: SparkSession, path: str) -> DataFrame:
    """Names of the batches that are part of an index."""
    try:
        return spark.read.schema("batch string").parquet(f"{path}/batches")
    except AnalysisException as problem:
        if not is_absent(problem):
            raise
        return spark.createDataFrame([], "batch string")


def _write_rows(rows: DataFrame, path: str) -> None:
    out = rows.hint("rebalance", CELL).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(CELL, BATCH).parquet(f"{path}/rows")


def append_index(
    spark: SparkSession, path: str, vectors: DataFrame, batch: str, *, most_rows: int | None = None, vector: str = "embedding"
) -> bool:
    """Add ``vectors``, with the columns of the indexed rows, to a stored index; False if ``batch`` is part of it already.

    Rows go to the cell of their nearest centre, as new files in that cell's folder; files of other cells and other batches stay as they are. A search
    after it is as exact as over an index built anew. Radii grow first: a radius that is too large costs a search
    some work, one that is too small would cost it hits. The batch's name is written last. So a run that dies may be repeated, at any
    point, with the same batch: its files replace the ones it left. Then cells of more than ``most_rows`` rows (by default
    four times the mean) are split. Rows of length zero match nothing and are left out. One writer at a time.
    """
    if batch == "first" or not _applied(spark, path).where(F.col("batch") == batch).isEmpty():
        return False
    known, version = read_centres(spark, path)
    cells = known.orderBy("cell").collect()
    if not cells:
        raise ValueError("the index has no cells; build it from rows first")
    numbers, centres = np.array([r.cell for r in cells]), np.array([r.centre for r in cells])
    placed = cut_lineage(_placed(vectors, vector, centres, numbers))
    grown = placed.groupBy(F.col(CELL).alias("cell")).agg(F.max(ANGLE).alias("_far"), F.count("*").alias("_n"))
    updated = known.join(F.broadcast(grown), "cell", "left").select(
        "cell",
        "centre",
        F.greatest("radius", "_far").alias("radius"),
        (F.col("rows") + F.coalesce("_n", F.lit(0))).alias("rows"),
        "tried",
    )
    write_centres(cut_lineage(updated), path, version + 1)
    _write_rows(placed.withColumn(BATCH, F.lit(batch)), path)
    spark.createDataFrame([(batch,)], "batch string").write.mode("append").parquet(f"{path}/batches")
    split_cells(spark, path, most_rows, vector)
    return True


def _local_centres(parts: dict[int, int], vector: str, dim: int, seed: int):
    """Spherical k-means over the sampled rows of one cell."""

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        units = _unit_rows(matrix_of(rows.column(vector).combine_chunks(), dim))[0]
        units = np.unique(units, axis=0)
        rng = np.random.default_rng(seed + cell)
        centres = units[rng.choice(len(units), min(parts[cell], len(units)), replace=False)]
        for _ in range(10):
            nearest = (units @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, units)
            used = np.sqrt((sums * sums).sum(axis=1)) > 1e-12
            centres = _unit_rows(sums[used])[0]
        return pa.table({"cell": pa.array([cell] * len(centres), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    return fit


def split_cells(spark: SparkSession, path: str, most_rows: int | None = None, vector: str = "embedding", seed: int = 42) -> list[int]:
    """Split the cells that have more than ``most_rows`` rows; returns their numbers.

    Each gets centres of its own from a sample of its rows, one group per cell; its rows, and no others, are read and
    written to new cells. These are no part of the index until its cells are replaced in one step; then the old
    folder goes. A cell whose rows are all alike cannot be split and is tried again when it has doubled. As many cells are split as
    there is room for centres, the largest first.
    """
    known, version = read_centres(spark, path)
    cells = known.orderBy(F.col("rows").desc(), "cell").collect()
    limit = most_rows or max(1, CROWDED * sum(r.rows for r in cells) // max(1, len(cells)))
    dim = len(cells[0].centre) if cells else 1
    room, parts = CENTRE_BYTES // (8 * dim) - len(cells), {}
    for r in cells:
        wanted = min(MOST_PARTS, -(-2 * r.rows // limit))
        if r.rows > limit and r.rows >= 2 * r.tried and wanted <= room:
            parts[r.cell], room = wanted, room - wanted
    if not parts:
        return []
    rows = spark.read.parquet(f"{path}/rows").where(F.col(CELL).isin([str(c) for c in parts])).withColumn(CELL, F.col(CELL).cast("int"))
    share = F.lit(float(MOST_PARTS * SAMPLE_PER_PART)) / F.col("rows")
    counts = F.broadcast(known.select(F.col("cell").alias(CELL), "rows"))
    sample = rows.select(CELL, vector).join(counts, CELL).where(F.rand(seed) < share).select(CELL, vector)
    fitted = sample.groupBy(CELL).applyInArrow(_local_centres(parts, vector, dim, seed), "cell int, centre array<double>")
    local: dict[int, list[list[float]]] = {}
    for r in fitted.collect():  # bounded by the room for centres
        local.setdefault(r.cell, []).append(r.centre)
    split = {c: np.array(found) for c, found in local.items() if len(found) > 1}
    first = {c: start for c, start in zip(split, np.cumsum([1 + max(r.cell for r in cells), *map(len, split.values())]).tolist())}
    tried = F.when(F.col("cell").isin(sorted(parts)), F.col("rows")).otherwise(F.col("tried"))
    kept = known.where(~F.col("cell").isin(sorted(split))).withColumn("tried", tried)
    if split:
        numbers = [first[c] + i for c in split for i in range(len(split[c]))]
        for number in numbers:  # what a split that died has left
            remove_path(spark, f"{path}/rows/{CELL}={number}")
        moved = _settled(rows.where(F.col(CELL).isin(sorted(split))), _applied(spark, path))
        _write_rows(_dealt(moved, split, first, vector), path)
        made = spark.read.parquet(f"{path}/rows").where(F.col(CELL).isin([str(n) for n in numbers]))
        radii = made.groupBy(F.col(CELL).cast("int").alias("cell")).agg(F.max(ANGLE).alias("radius"), F.count("*").alias("rows"))
        centres = [(first[c] + i, [float(x) for x in centre]) for c in split for i, centre in enumerate(split[c])]
        new = spark.createDataFrame(centres, "cell int, centre array<double>").join(radii, "cell")
        kept = kept.unionByName(new.withColumn("tried", F.lit(0).cast("long")))
    write_centres(cut_lineage(kept), path, version + 1)
    for cell in split:
        remove_path(spark, f"{path}/rows/{CELL}={cell}")
    return sorted(split)


def _settled(rows: DataFrame, applied: DataFrame) -> DataFrame:
    """Rows of batches that are part of the index go with those of its first build, so that a new cell has one folder, not one per batch."""
    done = F.broadcast(applied.select(F.col("batch").alias(BATCH), F.lit("first").alias("_settled")).distinct())
    return rows.join(done, BATCH, "left").withColumn(BATCH, F.coalesce("_settled", BATCH)).drop("_settled")


def _dealt(rows: DataFrame, split: dict[int, np.ndarray], first: dict[int, int], vector: str) -> DataFrame:
    """Rows of split cells with the nearest of their cell's new centres."""
    at, cell_at, angle_at = (rows.columns.index(c) for c in (vector, CELL, ANGLE))

    def deal(batches):
        for batch in batches:
            cells = np.asarray(batch.column(cell_at))
            units = _unit_rows(matrix_of(batch.column(at), next(iter(split.values())).shape[1]))[0]
            number, angle = np.zeros(len(cells), np.int32), np.zeros(len(cells))
            for cell in np.unique(cells):
                own = np.flatnonzero(cells == cell)
                angles = _angles(units[own], split[int(cell)])
                nearest = angles.argmin(axis=1)
                number[own], angle[own] = first[int(cell)] + nearest, angles[np.arange(len(own)), nearest]
            columns = list(batch.columns)
            columns[cell_at], columns[angle_at] = pa.array(number), pa.array(angle)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(deal, T.StructType(rows.schema.fields))
