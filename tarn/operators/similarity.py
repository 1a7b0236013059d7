"""Nearest rows by cosine."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.vectors import lists_of, matrix_of, once
from tarn.operators.ranking import first_per_key, top_n_per_group
from tarn.session import cut_lineage, remove_path, scratch_path

# Scores are compared after rounding, so the last bits of a sum never decide between copies.
SCORE_DIGITS = 9
# Questions that go to every task at a time; more of them are dealt to the tasks and asked in rounds.
QUESTION_BYTES = 64 << 20
QUERY_BLOCK = 512
# Rows that a task holds while questions pass by, and any matrix of scores or angles.
BLOCK_BYTES = 16 << 20
PRODUCT_BYTES = 32 << 20
# A block of rows is not cut further for the sake of parallel tasks.
LEAST_ROWS = 1024
CELL, ANGLE, BATCH = "_cell", "_angle", "_batch"
ROW, BLOCK, FLOOR = "_row", "_block", "_floor"
# Centres that go to every task.
CENTRE_BYTES = 64 << 20


def _unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows have a length at all."""
    length = np.sqrt((matrix * matrix).sum(axis=1))
    usable = length > 0
    return matrix / np.where(usable, length, 1.0)[:, None], usable


def _pick(
    matrix: np.ndarray, queries: np.ndarray, k: int, ranks: Callable[[], np.ndarray], floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the best ``k`` rows per question, the questions' numbers, and the scores.

    ``queries`` have length one. Equal scores go by ``ranks``, which is asked for only if it matters.
    Rows scoring below a question's ``floor`` are left out: it already has ``k`` better ones.
    """
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    usable = norms > 0
    keep = min(k, int(usable.sum()))
    picked, owners, scores = [], [], []
    scale = 1.0 / np.where(usable, norms, 1.0)
    for start, stop in _chunks(len(queries) if keep else 0, len(matrix), QUERY_BLOCK):
        block = queries[start:stop] @ matrix.T * scale
        block[:, ~usable] = -np.inf
        many = np.arange(stop - start)
        if floor is not None:
            # Where few rows come near the floor nothing has to be ranked.
            level = floor[start:stop]
            near = (block >= level[:, None] - 2 * 10.0**-SCORE_DIGITS) & usable
            few = near.sum(axis=1) <= k
            near[~few] = False
            who, at = np.nonzero(near)
            score = np.round(block[who, at], SCORE_DIGITS)
            reached = score >= level[who]
            picked.append(at[reached])
            owners.append(start + who[reached])
            scores.append(score[reached])
            many = np.flatnonzero(~few)
            if not len(many):
                continue
        block = np.round(block[many], SCORE_DIGITS)
        edge = np.partition(block, len(matrix) - keep, axis=1)[:, len(matrix) - keep]
        if floor is not None:
            edge = np.maximum(edge, level[many])
        for i, row in enumerate(block):
            chosen, level_at = np.flatnonzero(row > edge[i]), np.flatnonzero(row == edge[i])
            wanted = keep - len(chosen)
            if len(level_at) > wanted:
                level_at = level_at[np.argsort(ranks()[level_at], kind="stable")[:wanted]]
            chosen = np.concatenate([chosen, level_at])
            picked.append(chosen)
            owners.append(np.full(len(chosen), start + many[i]))
            scores.append(row[chosen])
    if not picked:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return np.concatenate(picked), np.concatenate(owners), np.concatenate(scores)


def _chunks(count: int, width: int, most: int) -> Iterator[tuple[int, int]]:
    """``count`` cut so that a chunk's matrix of ``width`` columns stays small."""
    step = max(1, min(most, PRODUCT_BYTES // (8 * max(1, width))))
    return ((start, min(start + step, count)) for start in range(0, count, step))


def _tie_ranks(rows: pa.Table, ties: list[str]) -> Callable[[], np.ndarray]:
    """Each row's place in the order of the tie columns, nulls first as in Spark."""

    @functools.cache
    def ranks() -> np.ndarray:
        keys = [(name, "ascending") for name in ties]
        order = pc.sort_indices(rows, sort_keys=keys, null_placement="at_start").to_numpy()
        places = np.empty(len(order), dtype=np.int64)
        places[order] = np.arange(len(order))
        return places

    return ranks


def _found(rows: pa.Table, picked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    positions, owners, scores = picked
    return rows.take(pa.array(positions)).append_column("_q", pa.array(owners)).append_column("score", pa.array(scores))


def _prune(pool: pa.Table, ties: list[str], k: int) -> pa.Table:
    """The best ``k`` rows per question."""
    keys = [("_q", "ascending"), ("score", "descending"), *((name, "ascending") for name in ties)]
    pool = pool.take(pc.sort_indices(pool, sort_keys=keys, null_placement="at_start"))
    owners = pool["_q"].to_numpy()
    place = np.arange(len(owners)) - np.searchsorted(owners, owners)
    return pool.filter(pa.array(place < k))


def _floors(pool: pa.Table, count: int, k: int) -> np.ndarray:
    """The k-th best score so far per question, minus infinity for those with fewer."""
    owners, floor = pool["_q"].to_numpy(), np.full(count, np.inf)
    np.minimum.at(floor, owners, pool["score"].to_numpy())
    return np.where(np.bincount(owners, minlength=count) >= k, floor, -np.inf)


def _hit_schema(vectors: DataFrame, ties: list[str], query_type: T.DataType) -> T.StructType:
    fields = [T.StructField("query_id", query_type), *[vectors.schema[c] for c in ties]]
    return T.StructType(fields + [T.StructField("score", T.DoubleType())])


def _final(hits: DataFrame, ties: list[str], k: int) -> DataFrame:
    order = [F.col("score").desc(), *[F.col(c).asc() for c in ties]]
    return top_n_per_group(hits, ["query_id"], order, k)


def _marked(vectors: DataFrame, apart: Sequence[str] = ()) -> DataFrame:
    """Rows with a hash of all they hold: rows that share their tie columns are told apart unless they are equal."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields if f.name not in apart}
    usable = [c for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
    return vectors.withColumn(ROW, F.xxhash64(*[F.col(f"`{c}`") for c in usable]))


def _with_rows(hits: DataFrame, vectors: DataFrame, ties: list[str], vector: str) -> DataFrame:
    """The remaining columns of the rows that were found.

    ``ties`` and the row's hash lead to it. Equal rows are each a hit of their own, and any of them has the columns of all; so one per
    key is looked up, cut in each task, and a row that repeats very often is not multiplied by its hits.
    """
    own = [c for c in ties if c != ROW]
    rest = [c for c in vectors.columns if c not in (vector, ROW, *own)]
    if not rest:
        return hits.select("query_id", *own, "score", "rank")
    keys = hits.select(*ties).distinct()
    same = lambda left, right: functools.reduce(operator.and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ties])
    met = vectors.drop(vector).alias("v").join(keys.alias("k"), same("v", "k"), "left_semi")
    found = first_per_key(met, ties, [F.lit(1)])
    columns = [F.col(f"h.{c}" if c in own else f"v.{c}") for c in vectors.columns if c not in (vector, ROW)]
    return hits.alias("h").join(found.alias("v"), same("h", "v")).select("h.query_id", *columns, "h.score", "h.rank")


@dataclass
class _Asked:
    """Questions that go to every task: ids and unit vectors."""

    ids: pa.Array
    units: np.ndarray


def _asked(queries: DataFrame, vector: str, dim: int) -> tuple[DataFrame, int]:
    """The questions and their number; a vector of another length is an error."""
    asked = queries.select("query_id", F.col(vector).alias("query_vector"))
    length = F.when(F.col("query_vector").isNull(), 0).otherwise(F.size("query_vector"))
    count, wrong = asked.agg(F.count("*"), F.first(F.when(length != dim, length), ignorenulls=True)).first()
    if wrong is not None:
        raise ValueError(f"expected {dim} values, found {wrong}")
    return asked, count


def _scan(rows: DataFrame, asked: _Asked, schema: T.StructType, ties: list[str], vector: str, dim: int, k: int) -> DataFrame:
    """The best ``k`` rows of each task for each question, where all questions fit into every task.

    A task scores its rows in matrix products. After it, ``tasks x questions x k`` keys are shuffled, not the table.
    """
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    names = [f.name for f in schema]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        pool, floor = None, np.full(len(asked.ids), -np.inf)
        for batch in batches:
            keys, matrix = pa.Table.from_batches([batch]).select(ties), matrix_of(batch.column(vector), dim)
            found = _found(keys, _pick(matrix, asked.units, k, _tie_ranks(keys, ties), floor))
            pool = _prune(found if pool is None else pa.concat_tables([pool, found]), ties, k)
            floor = _floors(pool, len(asked.ids), k)
        if pool is not None:
            out = pool.append_column("query_id", asked.ids.take(pool["_q"].combine_chunks()))
            yield from out.select(names).combine_chunks().to_batches()

    return rows.select(*ties, vector).mapInArrow(best, schema)


def _block_rows(spark: SparkSession, rows: int, dim: int) -> int:
    """Rows of a block: what a task may hold, less where that would leave cores without a block."""
    share = -(-rows // (2 * spark.sparkContext.defaultParallelism))
    return max(1, min(BLOCK_BYTES // (8 * max(dim, 1)), max(share, LEAST_ROWS)))


def _meet(
    rows: DataFrame, asked: DataFrame, blocks: int, schema: T.StructType, ties: list[str], vector: str, dim: int, k: int, most: int = QUESTION_BYTES
) -> DataFrame:
    """The best ``k`` rows of each block for each question dealt to it, scoring at least the question's floor if it has one.

    ``rows`` have a block each, ``asked`` have ``query_id, query_vector`` and a block for every block they look into. Spark brings both
    to the block's task, its rows first: a task holds one block of rows, and questions pass by in rounds of ``most`` bytes. Neither goes through the driver.
    """
    names, first = [f.name for f in schema], "_first"
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    floor = F.col(FLOOR) if FLOOR in asked.columns else empty(FLOOR, "double")
    kinds, asked_kinds = rows.schema, asked.schema
    held = rows.select(
        F.col(BLOCK).cast("int").alias(BLOCK), F.lit(0).alias(first), *ties, vector,
        *[empty(c, asked_kinds[c].dataType) for c in ("query_id", "query_vector")], empty(FLOOR, "double"),
    ).toDF(*(columns := [BLOCK, first, *(f"t{i}" for i in range(len(ties))), "v", "query_id", "query_vector", FLOOR]))
    passing = asked.select(
        F.col(BLOCK).cast("int").alias(BLOCK), F.lit(1).alias(first), *[empty(c, kinds[c].dataType) for c in (*ties, vector)], "query_id", "query_vector", floor
    ).toDF(*columns)
    step = max(1, most // (8 * max(dim, 1)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, ready, count, trim = None, [], None, 0, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            block, later = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(later) != 0)) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(block)]):
                part = table.slice(start, stop - start)
                if not later[start]:
                    if current != block[start]:
                        current, parts, count, trim = block[start], [], 0, BLOCK_BYTES // (4 * max(dim, 1))
                    ready = None
                    matrix = matrix_of(part["v"].combine_chunks(), dim)
                    usable = np.sqrt((matrix * matrix).sum(axis=1)) > 0
                    keys = part.select(columns[2 : 2 + len(ties)]).rename_columns(ties).filter(pa.array(usable))
                    parts.append((keys, matrix[usable]))
                    count += int(usable.sum())
                    if count > trim:
                        parts = [_without_copies(*_joined(parts), k)]
                        count = len(parts[0][1])
                        trim = max(trim, 2 * count)
                    continue
                if current != block[start] or not count:
                    continue
                if ready is None:
                    ready = _joined(parts)
                    parts = [ready]
                    ranks = _tie_ranks(ready[0], ties)
                units, usable = _unit_rows(matrix_of(part["query_vector"].combine_chunks(), dim))
                ids, floors = part["query_id"].combine_chunks(), pc.fill_null(part[FLOOR], -np.inf).to_numpy()
                who = np.flatnonzero(usable)
                for at in range(0, len(who), step):
                    round_ = who[at : at + step]
                    found = _found(ready[0], _pick(ready[1], units[round_], k, ranks, floors[round_]))
                    out = found.append_column("query_id", ids.take(pa.array(round_[found["_q"].to_numpy()])))
                    yield from out.select(names).combine_chunks().to_batches()

    dealt = held.unionAll(passing).repartition(blocks, BLOCK).sortWithinPartitions(BLOCK, first)
    return dealt.mapInArrow(best, schema)


def _joined(parts: list[tuple[pa.Table, np.ndarray]]) -> tuple[pa.Table, np.ndarray]:
    return pa.concat_tables([keys for keys, _ in parts]).combine_chunks(), np.concatenate([matrix for _, matrix in parts])


def _without_copies(keys: pa.Table, matrix: np.ndarray, k: int) -> tuple[pa.Table, np.ndarray]:
    """At most ``k`` of equal rows, as no question takes more of them."""
    marks = keys[ROW].to_numpy()
    order = np.argsort(marks, kind="stable")
    inside = np.sort(order[np.arange(len(order)) - np.searchsorted(marks[order], marks[order]) < k])
    return keys.take(pa.array(inside)), matrix[inside]


def cosine_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    dim: int | None = None,
    *,
    ties: Sequence[str] = ("id",),
    vector: str = "embedding",
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """Exact top-k rows per question: ``query_id``, the rows' columns, ``score``, ``rank``.

    ``queries`` has ``query_id`` and the vector column. ``ties`` orders equal scores and must identify a row: only
    these columns travel through the search, the others are joined to the rows that were found. Rows and
    questions of length zero have no cosine and match nothing; a vector of another length is an error.

    Up to ``question_bytes`` of questions go to every task. More of them are dealt to the tasks: each task holds a block of the vectors and asks
    all questions in rounds of that size, so that neither the number of reads nor that of tasks grows with the rounds.
    """
    vectors, ties = _marked(vectors), [*ties, ROW]
    dim = _dim_of(queries, vector) if dim is None else dim
    schema = _hit_schema(vectors, ties, queries.schema["query_id"].dataType)
    asked, count = _asked(queries, vector, dim)
    if not count:
        hits = vectors.sparkSession.createDataFrame([], schema)
    elif count * 8 * max(dim, 1) <= question_bytes:
        rows = asked.toArrow()
        units, usable = _unit_rows(matrix_of(rows["query_vector"].combine_chunks(), dim))
        few = _Asked(rows["query_id"].combine_chunks().filter(pa.array(usable)), units[usable])
        hits = _scan(vectors, few, schema, ties, vector, dim, k)
    else:
        rows = vectors.count()
        blocks = -(-rows // _block_rows(vectors.sparkSession, rows, dim)) or 1
        dealt = vectors.withColumn(BLOCK, F.pmod(F.col(ROW), F.lit(blocks)))
        every = asked.withColumn(BLOCK, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        hits = _meet(dealt, every, blocks, schema, ties, vector, dim, k, question_bytes)
    return _with_rows(_final(hits, ties, k), vectors, ties, vector)


def fit_cells(
    vectors: DataFrame, rows: int, cells: int, seed: int = 42, per_cell: int = 256, vector: str = "embedding"
) -> np.ndarray:
    """Unit centres of a k-means over about ``per_cell`` rows a cell, drawn from ``rows`` rows.

    ``cells x dim`` numbers come to the driver. The sample decides how fast a search is, never what it finds.
    """
    nonzero = F.exists(F.col(vector), lambda x: x != 0)
    drawn = vectors.select(vector).sample(min(1.0, cells * per_cell / max(1, rows)), seed)
    sample = drawn.where(nonzero).select(array_to_vector(F.col(vector)).alias("features"))
    means = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine", initSteps=2)
    return _unit_rows(np.array(means.fit(sample).clusterCenters()))[0]


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def _placed(df: DataFrame, vector: str, centres: np.ndarray, numbers: np.ndarray | None = None) -> DataFrame:
    """Each row with its nearest cell and the angle to its centre; rows of length zero are left out."""
    shared, dim = df.sparkSession.sparkContext.broadcast(centres), centres.shape[1]
    cell_numbers = np.arange(len(centres)) if numbers is None else numbers

    @F.arrow_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    def nearest(vectors: pa.Array) -> pa.Array:
        units, usable = _unit_rows(matrix_of(vectors, dim))
        cell, angle = np.zeros(len(units), int), np.zeros(len(units))
        for start, stop in _chunks(len(units), len(cell_numbers), len(units)):
            angles = _angles(units[start:stop], shared.value)
            cell[start:stop] = angles.argmin(axis=1)
            angle[start:stop] = angles[np.arange(stop - start), cell[start:stop]]
        cells = pa.array(cell_numbers[cell].astype(np.int32), mask=~usable)
        return pa.StructArray.from_arrays([cells, pa.array(angle)], names=["cell", "angle"])

    found = df.withColumn("_nearest", once(nearest)(F.col(vector)))
    found = found.withColumns({CELL: F.col("_nearest.cell"), ANGLE: F.col("_nearest.angle")}).drop("_nearest")
    return found.where(F.col(CELL).isNotNull())


def _centres_for(vectors: DataFrame, dim: int, cells: int | None, seed: int, vector: str) -> np.ndarray:
    """As many cells as the square root of the row count, as long as their centres can go to every task."""
    rows = vectors.count()
    most = CENTRE_BYTES // (8 * dim)
    if cells is None:
        cells = max(2, min(most, int(rows**0.5)))
    if cells > most:
        raise ValueError(f"at most {most} cells of {dim} numbers can be sent to every task")
    centres = fit_cells(vectors, rows, cells, seed, vector=vector)
    if centres.shape[1] != dim:
        raise ValueError(f"expected {dim} values, found {centres.shape[1]}")
    return centres


def _dim_of(df: DataFrame, vector: str) -> int:
    first = df.select(F.size(vector).alias("n")).first()
    return first.n if first else 1


def build_index(
    vectors: DataFrame,
    path: str,
    dim: int | None = None,
    *,
    cells: int | None = None,
    seed: int = 42,
    vector: str = "embedding",
) -> None:
    """Store the rows by cell, and beside them each cell's centre and radius: its rows' largest angle to the centre.

    The rebalance hint gathers a cell into few files and splits one that is far larger than others.
    Rows of length zero, which match nothing, are not stored.
    """
    spark = vectors.sparkSession
    centres = _centres_for(vectors, _dim_of(vectors, vector) if dim is None else dim, cells, seed, vector)
    rows = _placed(vectors, vector, centres).withColumn(BATCH, F.lit("first")).hint("rebalance", CELL)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(CELL, BATCH).parquet(f"{path}/rows")
    numbered = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    stored = spark.createDataFrame(numbered, "cell int, centre array<double>")
    radii = (
        spark.read.parquet(f"{path}/rows")
        .groupBy(F.col(CELL).cast("int").alias("cell"))
        .agg(F.max(ANGLE).alias("radius"), F.count("*").alias("rows"))
    )
    write_centres(stored.join(radii, "cell").withColumn("tried", F.lit(0).cast("long")), path, 0)


def write_centres(centres: DataFrame, path: str, version: int) -> None:
    """Store ``cell, centre, radius, rows, tried`` as a version of an index; version 0 replaces all others.

    The newest version is what a search goes by. It appears as a whole, and the one before it stays for searches under way.
    """
    mode = "append" if version else "overwrite"
    out = centres.withColumn("version", F.lit(version)).coalesce(1).write.mode(mode)
    out.option("partitionOverwriteMode", "static").partitionBy("version").parquet(f"{path}/centres")
    if version > 1:
        remove_path(centres.sparkSession, f"{path}/centres/version={version - 2}")


def read_centres(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest version of an index's cells, and its number (-1 for an index without cells)."""
    stored = spark.read.schema("cell int, centre array<double>, radius double, rows long, tried long, version int").parquet(f"{path}/centres")
    newest = stored.agg(F.max("version")).first()[0]
    newest = -1 if newest is None else newest
    return stored.where(F.col("version") == newest).drop("version"), newest


def search_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 10,
    *,
    probes: int = 8,
    ties: Sequence[str] = ("id",),
    vector: str = "embedding",
) -> DataFrame:
    """Exact top-k over a stored index, as ``cosine_topk``; only the files of cells that may matter are read.

    A question first looks into its ``probes`` nearest cells, which gives it a k-th score. No row of a cell is nearer
    than the angle to its centre less its radius; so a second look takes the cells that could hold a row as good,
    and no others. ``probes`` changes the work, not the answer. At worst every cell is read.

    Tasks hold the centres and pick the cells of their own questions; Spark brings a question to the rows of its cells. The driver
    sees the cells that are wanted by any question, no question.
    """
    ties = [*ties, ROW]
    stored, _ = read_centres(spark, path)
    size = stored.agg(F.count("*").alias("cells"), F.max(F.size("centre")).alias("dim")).first()
    if size.cells and size.cells * size.dim * 8 > CENTRE_BYTES:
        raise ValueError("the index has more centres than can be sent to every task")
    known = stored.orderBy("cell").collect()
    rows = spark.read.parquet(f"{path}/rows").drop(BATCH)
    rows = _marked(rows, (CELL, ANGLE)).withColumn(CELL, F.col(CELL).cast("int"))
    schema = _hit_schema(rows, ties, queries.schema["query_id"].dataType)
    if not known:
        return _with_rows(_final(spark.createDataFrame([], schema), ties, k), rows.drop(CELL, ANGLE), ties, vector)
    numbers, centres = np.array([r.cell for r in known]), np.array([r.centre for r in known])
    radius, sizes, dim = np.array([r.radius for r in known]), np.array([r.rows for r in known]), centres.shape[1]
    asked, count = _asked(queries, vector, dim)
    shared = spark.sparkContext.broadcast((numbers, centres, radius))
    block_rows = _block_rows(spark, int(sizes.sum()), dim)

    def look(asked: DataFrame, together: bool) -> DataFrame:
        """Search the cells that each question wants; small ones ``together`` in a block, or each in its own."""
        starts, counts = _blocks_of(sizes, block_rows, together)
        asked = cut_lineage(_wanting(asked, shared, starts, counts, probes))
        wanted = sorted(r[0] for r in asked.select(F.explode("_cells")).distinct().collect())
        own = rows.where(F.col(CELL).cast("string").isin([str(c) for c in wanted])) if len(wanted) < len(numbers) else rows
        places = spark.createDataFrame(list(zip(numbers.tolist(), starts.tolist(), counts.tolist())), f"{CELL} int, _start int, _count int")
        own = own.join(F.broadcast(places), CELL).withColumn(BLOCK, F.col("_start") + F.pmod(ROW, "_count"))
        asked = asked.withColumn(BLOCK, F.explode("_blocks"))
        tasks = min(int(starts[-1] + counts[-1]), -(-int(sizes.sum()) // block_rows))
        return _meet(own, asked, tasks, schema, ties, vector, dim, k)

    if not count:
        hits = spark.createDataFrame([], schema)
    else:
        found = _final(look(asked, False), ties, k)
        reached = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias(FLOOR)).where(F.col("n") >= k)
        floors = reached.select(F.col("query_id").alias("_id"), FLOOR)
        asked = asked.join(floors, F.col("query_id").eqNullSafe(F.col("_id")), "left").drop("_id")
        hits = look(asked, True)
    # Folders of cells that were split are not part of the index.
    rest = rows.where(F.col(CELL).isin([int(n) for n in numbers])).drop(CELL, ANGLE)
    return _with_rows(_final(hits, ties, k), rest, ties, vector)


def _blocks_of(sizes: np.ndarray, most: int, together: bool) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: large cells have several, and neighbouring small ones share one if ``together``."""
    counts = np.maximum(1, -(-sizes // most))
    if not together:
        return np.concatenate([[0], np.cumsum(counts)[:-1]]), counts
    starts, block, filled = np.zeros(len(sizes), int), 0, 0
    for i, size in enumerate(sizes.tolist()):
        if filled and filled + size > most:
            block, filled = block + 1, 0
        starts[i] = block
        if counts[i] > 1:
            block, filled = block + int(counts[i]), 0
        else:
            filled += size
    return starts, counts


def _wanting(asked: DataFrame, shared: Broadcast, starts: np.ndarray, counts: np.ndarray, probes: int) -> DataFrame:
    """Questions with the blocks that they look into; beside one of each chunk of them, the cells that any of the chunk wants.

    Without a floor the nearest cells are wanted, else those that could hold a row scoring as much. Questions of length zero are left out.
    """
    again = FLOOR in asked.columns
    asked = asked.select("query_id", "query_vector", F.col(FLOOR) if again else F.lit(None).cast("double").alias(FLOOR))
    edges = np.flatnonzero(np.diff(starts, prepend=-1))

    def want(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centres, radius = shared.value
        for batch in batches:
            units, usable = _unit_rows(matrix_of(batch.column(1), centres.shape[1]))
            floors = pc.fill_null(batch.column(2), -2.0).to_numpy(zero_copy_only=False)
            who = np.flatnonzero(usable)
            for start, stop in _chunks(len(who), len(centres), len(who)):
                own = who[start:stop]
                angles = _angles(units[own], centres)
                if again:
                    # A margin for rounded scores and angles.
                    wanted = np.cos(np.maximum(angles - radius, 0)) >= floors[own][:, None] - 1e-6
                else:
                    wanted = np.zeros(angles.shape, bool)
                    near = min(probes, len(centres))
                    np.put_along_axis(wanted, np.argpartition(angles, near - 1, axis=1)[:, :near], True, axis=1)
                q, group = np.nonzero(np.logical_or.reduceat(wanted, edges, axis=1))
                many = counts[edges][group]
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                blocks = lists_of((np.repeat(starts[edges][group], many) + inside).astype(np.int32), np.bincount(q, many, minlength=len(own)).astype(int))
                cells = numbers[wanted.any(axis=0)].astype(np.int32)
                once_ = lists_of(cells, np.concatenate([[len(cells)], np.zeros(len(own) - 1, int)]))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns), blocks, once_], names=names)

    schema = T.StructType([*asked.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("_blocks", "_cells"))])
    names = schema.names
    return asked.mapInArrow(want, schema)


def ann_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    dim: int | None = None,
    *,
    cells: int | None = None,
    probes: int = 8,
    seed: int = 42,
    ties: Sequence[str] = ("id",),
    vector: str = "embedding",
) -> DataFrame:
    """Top-k through an index that is built for this call; for repeated searches build it once."""
    path = scratch_path(vectors.sparkSession, "cells")
    dim = _dim_of(queries, vector) if dim is None else dim
    build_index(vectors, path, dim, cells=cells, seed=seed, vector=vector)
    return search_index(vectors.sparkSession, path, queries, k, probes=probes, ties=ties, vector=vector)
