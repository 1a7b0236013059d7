"""Reading, writing and naming day-partitioned Parquet tables."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.moments import AsOf, day_or_today, parse_day
from tarn.functions.vectors import register_functions
from tarn.operators.ranking import top_rows
from tarn.session import configure
from tarn.sources.paths import PARTITIONS, day_parts, pattern_of, root_of, table_root


# Where every row is compared with every other: rows of a table with vectors that a task takes at most, and least for the sake of parallel tasks.
BLOCK_ROWS, LEAST_ROWS = 2048, 256

# Conditions of a table that cannot be read: nothing there yet, or a broken file. Anything else is an error.
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
BROKEN = ("CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "is not a Parquet file", "CANNOT_READ_FOOTER")


def is_absent(problem: Exception) -> bool:
    condition = problem.getCondition() if hasattr(problem, "getCondition") else None
    return bool(condition) and condition.startswith(ABSENT)


def _unreadable(problem: Exception) -> bool:
    return is_absent(problem) or any(word in str(problem) for word in BROKEN)


def read_table(
    spark: SparkSession, pattern: str, merge_schema: bool = False, schema: T.StructType | None = None
) -> DataFrame:
    """All Parquet files under a path or path pattern, with their partition columns.

    ``merge_schema`` is for tables whose files differ in columns; it reads every footer. ``schema``
    is for tables whose column types were widened over time: files of the narrower type are read as
    the wider one. A folder that holds several tables is read file by file, without partition columns.
    """
    root = root_of(pattern)
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    if schema is not None:
        reader = reader.schema(schema)
    if root.endswith(".parquet"):
        return reader.parquet(root)
    try:
        return reader.option("basePath", root).parquet(root)
    except Exception as problem:
        if "CONFLICTING_DIRECTORY_STRUCTURES" not in str(problem):
            raise
    return read_tree(spark, pattern, merge_schema)


def table_schema(spark: SparkSession, pattern: str, merge_schema: bool = True) -> T.StructType:
    """Columns of a table, from file footers. Where files disagree on a type the newest day decides."""
    try:
        return read_table(spark, pattern, merge_schema).schema
    except Exception as problem:
        if "CANNOT_MERGE_SCHEMAS" not in str(problem):
            raise
    # The newest day by its partition values; only that folder is listed further.
    days = [c for c in PARTITIONS if c in read_table(spark, pattern).columns]
    last = read_table(spark, pattern).select(*days).orderBy(*[F.col(c).desc() for c in days]).first() if days else None
    if last is None:
        raise ValueError(f"files of {pattern} disagree on a type, and no day tells which is newest")
    folder = "/".join([root_of(pattern), *(f"{name}={last[name]}" for name in days)])
    return spark.read.option("mergeSchema", "true").option("basePath", root_of(pattern)).parquet(folder).schema


def read_tree(spark: SparkSession, pattern: str, merge_schema: bool = False) -> DataFrame:
    """All Parquet files of several tables below one folder."""
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    return reader.option("recursiveFileLookup", "true").parquet(root_of(pattern))


def read_day(spark: SparkSession, pattern: str, day: AsOf, merge_schema: bool = False) -> DataFrame:
    """Rows of one day: only its folder is listed, and ``source_date`` decides.

    A table without that folder is filtered as a whole, which gives no rows unless its files are not
    kept by day.
    """
    root, parts = root_of(pattern), day_parts(day)
    folder = "/".join([root, *(f"{name}={value}" for name, value in parts.items())])
    reader = spark.read.option("mergeSchema", str(merge_schema).lower()).option("basePath", root)
    try:
        rows = reader.parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = read_table(spark, pattern)
        for name, value in parts.items():
            if name in rows.columns:
                rows = rows.where(F.col(name) == value)
    if "source_date" in rows.columns:
        rows = rows.where(F.col("source_date") == F.lit(parse_day(day)).cast("date"))
    return rows


def with_source_date(df: DataFrame, day: AsOf | None = None) -> DataFrame:
    """Stamp a payload with the day it was loaded for."""
    return df.withColumn("source_date", F.lit(day_or_today(day)).cast("date"))


def _free_of_partition_names(df: DataFrame) -> None:
    taken = sorted(set(PARTITIONS) & set(df.columns))
    if taken:
        raise ValueError(f"columns {taken} would be lost to the day partition; rename them")


def _write(df: DataFrame, root: str, partitions: Iterable[str], max_records: int) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records)
        .partitionBy(*partitions)
        .parquet(root)
    )


def write_day(
    df: DataFrame,
    lake_root: str,
    day: AsOf | None = None,
    *,
    source: str | None = None,
    catalog: str | None = None,
    schema: str | None = None,
    table: str | None = None,
    area: str = "raw",
    max_records: int = 5_000_000,
) -> str:
    """Replace one day of a table, by default today; other days stay. An empty frame writes nothing.

    The rows keep the partitioning they arrive with, so a large day is written by many tasks.
    Returns the table's folder.
    """
    root = table_root(lake_root, source=source, catalog=catalog, schema=schema, table=table, area=area)
    _free_of_partition_names(df)
    for name, value in day_parts(day_or_today(day)).items():
        df = df.withColumn(name, F.lit(value))
    _write(df, root, PARTITIONS, max_records)
    return root


def write_days(
    df: DataFrame,
    lake_root: str,
    date_column: str = "source_date",
    *,
    source: str | None = None,
    catalog: str | None = None,
    schema: str | None = None,
    table: str | None = None,
    area: str = "raw",
    max_records: int = 5_000_000,
) -> str:
    """Backfill: replace every day that occurs in ``df``.

    The rebalance hint gathers each day into few files, and lets adaptive execution split a day that
    is far larger than the others.
    """
    root = table_root(lake_root, source=source, catalog=catalog, schema=schema, table=table, area=area)
    _free_of_partition_names(df)
    day = F.col(date_column)
    for name, fmt in zip(PARTITIONS, ("yyyy", "MM", "dd")):
        df = df.withColumn(name, F.date_format(day, fmt))
    _write(df.hint("rebalance", *PARTITIONS), root, PARTITIONS, max_records)
    return root


def preview(df: DataFrame, n: int = 100, order_by: Iterable[str] = ()) -> DataFrame:
    """Some rows of a table; the first ones by the columns of ``order_by`` if the answer must repeat."""
    order = [(name, True) for name in order_by]
    return top_rows(df, order, n) if order else df.limit(n)


def describe(df: DataFrame) -> DataFrame:
    """Column names and type names of a table, in order."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "pos int, column_name string, column_type string")


def collect_result(df: DataFrame, page: int = 1000) -> dict:
    """Result envelope for a console: ``row_count`` is the number of all rows, ``pages`` yields them page by page.

    The driver holds one page at a time. An error while counting is reported in the envelope.
    """
    try:
        count = df.count()
    except Exception as problem:
        return {"ok": False, "error": str(problem)}

    def pages() -> Iterator[list[tuple]]:
        rows = df.toLocalIterator()
        while found := [tuple(r) for r in islice(rows, page)]:
            yield found

    return {"ok": True, "columns": list(df.columns), "row_count": count, "pages": pages()}


# A call of read_parquet, or what may hold its name without being one: strings, quoted names, comments.
_CALL = re.compile(
    r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|\b(read_parquet)\s*\(", re.S | re.I
)
_PATH = re.compile(r"'((?:[^'\\]|\\.|'')*)'|\"((?:[^\"\\]|\\.|\"\")*)\"")
_OPTION = re.compile(r",\s*(\w+)\s*(?:=|:=|=>)\s*(\w+)\s*")


def _parse_call(text: str, at: int) -> tuple[list[str], dict[str, str], int]:
    """Paths, options and end of a ``read_parquet`` call whose arguments start at ``at``."""
    paths, options = [], {}
    listed = re.compile(r"\s*\[").match(text, at)
    at = listed.end() if listed else at
    while found := re.compile(rf"\s*,?\s*(?:{_PATH.pattern})", re.S).match(text, at):
        paths.append((found[1] if found[1] is not None else found[2]).replace("''", "'"))
        at = found.end()
        if not listed:
            break
    if listed:
        at = (re.compile(r"\s*\]").match(text, at) or _bad_call()).end()
    while found := re.compile(r"\s*" + _OPTION.pattern).match(text, at):
        options[found[1].lower()] = found[2].lower()
        at = found.end()
    end = re.compile(r"\s*\)").match(text, at)
    if not paths or not end:
        _bad_call()
    return paths, options, end.end()


def _bad_call() -> None:
    raise ValueError("read_parquet takes a path or a list of paths, and options as name = value")


def _compares_all_pairs(rows: DataFrame) -> bool:
    """Whether a join of a query has no equal keys, so that every row meets every other."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan


def _in_blocks(table: DataFrame) -> DataFrame:
    """A table with vectors that comes as a single piece, in blocks of ``BLOCK_ROWS`` rows; another one as it is.

    Tables of several pieces are better left alone: each piece meets each in a task of its own, which sorts fewer pairs.
    """
    kinds = [f.dataType.elementType for f in table.schema if isinstance(f.dataType, T.ArrayType)]
    if not any(isinstance(kind, (T.FloatType, T.DoubleType)) for kind in kinds) or table.rdd.getNumPartitions() > 1:
        return table
    rows = table.count()
    blocks = max(-(-rows // BLOCK_ROWS), min(table.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)))
    return table.repartition(blocks) if blocks > 1 else table


def _named_relations(spark: SparkSession, text: str) -> tuple[list[tuple[list[str], int, int]], set[str]]:
    """Tables a query names, each with its place in the text, and the names it defines itself, from the parsed plan."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    found, defined, todo = [], set(), [plan]

    def items(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            place = node.origin()
            if place.startIndex().isDefined() and place.stopIndex().isDefined():
                parts = [str(p) for p in items(node.multipartIdentifier())]
                found.append((parts, place.startIndex().get(), place.stopIndex().get()))
        elif kind == "UnresolvedWith":
            defined |= {str(pair._1()).lower() for pair in items(node.cteRelations())}
        todo += items(node.children()) + items(node.innerChildren())
        todo += [e for e in items(node.subqueriesAll().toSeq())]
    # A subquery may be met on more than one way.
    return list({start: (parts, start, stop) for parts, start, stop in found}.values()), defined


@dataclass
class Lake:
    """Names for tables under one root: ``catalog.schema.table`` -> files."""

    spark: SparkSession
    root: str
    patterns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        configure(self.spark)
        self.root = self.root.rstrip("/")

    def register(self, name: str, pattern: str | None = None) -> str:
        """Add a table. Without a pattern its path follows from its name."""
        parts = name.split(".")
        if len(parts) != 3 or not all(parts):
            raise ValueError(f"expected catalog.schema.table, got {name!r}")
        if pattern is None:
            pattern = pattern_of(table_root(self.root, catalog=parts[0], schema=parts[1], table=parts[2]))
        self.patterns[name] = pattern
        return pattern

    def register_source(self, source: str) -> str:
        """Name a plain source ``raw.sources.<source>``; its files stay where they are."""
        name = f"raw.sources.{source}"
        self.register(name, pattern_of(table_root(self.root, source=source)))
        return name

    def save_registry(self, path: str) -> None:
        """Store all names and patterns as a table: ``catalog, schema, table, path_pattern``."""
        rows = [(*name.split("."), pattern) for name, pattern in sorted(self.patterns.items())]
        stored = self.spark.createDataFrame(rows, "`catalog` string, `schema` string, `table` string, path_pattern string")
        stored.coalesce(1).write.mode("overwrite").parquet(path)

    def load_registry(self, registry: DataFrame) -> None:
        """Add the names of a registry table (``catalog, schema, table, path_pattern``; a null pattern follows the name)."""
        for row in registry.select("catalog", "schema", "table", "path_pattern").toLocalIterator():
            self.register(f"{row.catalog}.{row.schema}.{row.table}", row.path_pattern)

    def tables_of(self, catalogs: Iterable[str]) -> list[str]:
        """Registered tables of the given catalogs, e.g. those a user may see."""
        wanted = set(catalogs)
        return [name for name in self.patterns if name.split(".")[0] in wanted]

    def table(self, name: str, merge_schema: bool = False, schema: T.StructType | None = None) -> DataFrame:
        if name not in self.patterns:
            raise KeyError(f"unknown table {name}")
        return read_table(self.spark, self.patterns[name], merge_schema, schema)

    def describe_table(self, name: str) -> DataFrame:
        return describe(self.table(name))

    def preview(self, name: str, n: int = 100) -> DataFrame:
        return preview(self.table(name), n)

    def create_views(self, names: Iterable[str] | None = None) -> list[str]:
        """A temporary view per table, for all tables or those the caller may see.

        A table without data yet is left out.
        """
        made = []
        for name in self.patterns if names is None else names:
            try:
                self.table(name).createOrReplaceTempView(f"`{name}`")
            except AnalysisException as problem:
                if not _unreadable(problem):
                    raise
                continue
            made.append(name)
        return made

    def sql(self, text: str, names: Iterable[str] | None = None) -> DataFrame:
        """Run a Spark SQL query. Tables may be written ``a.b.c`` or ``read_parquet('<pattern>')``.

        ``read_parquet`` also takes a list of patterns, and the options ``union_by_name`` and ``hive_partitioning``.
        Tables are found in the parsed query, so a name in a string or a comment stays what it is. Each call has views
        of its own, which are dropped again. Where every row is compared with every other, a table with vectors in one piece is dealt to
        tasks in blocks; the pairs remain as many as the query asks for. With ``names``, the query may use these tables and nothing else: another
        table, view or file raises ``PermissionError``.
        """
        text = text.strip().rstrip(";")
        allowed = set(self.patterns if names is None else names)
        patterns = {self.patterns[n] for n in allowed if n in self.patterns}
        made: dict[str, DataFrame] = {}

        def view(df: DataFrame) -> str:
            name = f"lake_{uuid.uuid4().hex}"
            df.createTempView(name)
            made[name] = df
            return name

        try:
            parts, at = [], 0
            for call in _CALL.finditer(text):
                if call[1] is None or call.start() < at:
                    continue
                paths, options, end = _parse_call(text, call.end())
                if names is not None and not set(paths) <= patterns:
                    raise PermissionError(f"no access to {sorted(set(paths) - patterns)}")
                merge = options.get("union_by_name") in ("true", "1")
                tables = [read_table(self.spark, p, merge) for p in paths]
                if options.get("hive_partitioning") in ("false", "0"):
                    tables = [t.drop(*[c for c in PARTITIONS if c in t.columns]) for t in tables]
                rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=merge), tables)
                parts += [text[at : call.start()], view(rows)]
                at = end
            text = "".join([*parts, text[at:]])
            relations, defined = _named_relations(self.spark, text)
            for parts, start, stop in sorted(relations, key=lambda r: -r[1]):
                name = ".".join(parts)
                if name in allowed and name in self.patterns:
                    text = text[:start] + view(self.table(name)) + text[stop + 1 :]
                elif names is not None and name not in made and (name.lower() not in defined or self._exists(name)):
                    # A name that WITH defines may still mean the table of that name where the definition is not visible.
                    raise PermissionError(f"no access to {name}")
            rows = self._run(text)
            if _compares_all_pairs(rows):
                dealt = {name: _in_blocks(table) for name, table in made.items()}
                if any(dealt[name] is not made[name] for name in made):
                    for name, table in dealt.items():
                        table.createOrReplaceTempView(name)
                    rows = self._run(text)
            return rows
        finally:
            for name in made:
                self.spark.catalog.dropTempView(name)

    def _run(self, text: str) -> DataFrame:
        register_functions(self.spark)
        try:
            rows = self.spark.sql(text)
            rows._jdf.queryExecution().optimizedPlan()
            return rows
        except AnalysisException as problem:
            if "PYTHON_UDF" not in (problem.getCondition() or ""):
                raise
        register_functions(self.spark, in_expressions=True)
        return self.spark.sql(text)

    def _exists(self, name: str) -> bool:
        """Whether there is a table or view of that name, whatever a query defines itself."""
        return self.spark.catalog.tableExists(name)

    def schemas(self, merge_schema: bool = True, threads: int = 8) -> dict[str, list[tuple[str, str]]]:
        """Columns of every readable table from the file footers; unreadable tables are skipped."""

        def columns(name: str):
            try:
                fields = table_schema(self.spark, self.patterns[name], merge_schema).fields
            except Exception as problem:
                if not _unreadable(problem):
                    raise
                return name, None
            return name, [(f.name, f.dataType.simpleString()) for f in fields]

        with ThreadPoolExecutor(threads) as pool:
            found = list(pool.map(columns, self.patterns))
        return {name: cols for name, cols in found if cols is not None}
