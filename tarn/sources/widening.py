"""Files of one table whose columns have different types: the narrowest types that hold all of them."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources.lake import read_table

#: Whole numbers by width, with the decimal digits each needs.
_WHOLE = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
MOST_DIGITS = 38


def widest_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both; text holds whatever nothing else does.

    Whole numbers widen to the larger, with decimals to decimals of enough digits (beyond 38: double), with floating point to
    double. Days with instants are instants. Structs widen field by field, absent fields added; arrays and maps by their
    elements. Widening is commutative and associative, so the order of files does not matter.
    """
    if a == b:
        return a
    for x, y in ((a, b), (b, a)):
        if isinstance(x, T.NullType):
            return y
    whole = [t.simpleString() for t in (a, b) if t.simpleString() in _WHOLE]
    floating = [t for t in (a, b) if isinstance(t, (T.FloatType, T.DoubleType))]
    decimals = [t for t in (a, b) if isinstance(t, T.DecimalType)]
    if len(whole) == 2:
        return a if _WHOLE[whole[0]] > _WHOLE[whole[1]] else b
    if floating and len(floating) + len(whole) + len(decimals) == 2:
        return T.DoubleType()
    if decimals and len(decimals) + len(whole) == 2:
        scale = max(t.scale for t in decimals)
        digits = max([*(t.precision - t.scale for t in decimals), *(_WHOLE[t] for t in whole)])
        return T.DecimalType(digits + scale, scale) if digits + scale <= MOST_DIGITS else T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if {type(a), type(b)} == {T.TimestampType, T.TimestampNTZType}:
        return T.TimestampType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return widest(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widest_type(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(widest_type(a.keyType, b.keyType), widest_type(a.valueType, b.valueType))
    return T.StringType()


def widest(*shapes: T.StructType) -> T.StructType:
    """All columns of all shapes, in order of appearance, each with the widest of its types."""
    found: dict[str, T.DataType] = {}
    for f in (f for shape in shapes for f in shape.fields):
        found[f.name] = widest_type(found[f.name], f.dataType) if f.name in found else f.dataType
    return T.StructType([T.StructField(name, kind) for name, kind in found.items()])


def widened(column: Column, kind: T.DataType, target: T.DataType) -> Column:
    """A column of ``kind`` as ``target``, which is at least as wide."""
    if kind == target:
        return column
    if isinstance(target, T.StructType) and isinstance(kind, T.StructType):
        own = {f.name: f.dataType for f in kind.fields}
        parts = [
            (widened(column.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target.fields
        ]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(target, T.ArrayType) and isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: widened(x, kind.elementType, target.elementType))
    if isinstance(target, T.StringType) and isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast(target)


def as_shape(df: DataFrame, shape: T.StructType) -> DataFrame:
    """``df`` with the columns of ``shape``; absent ones are null."""
    own = {f.name: f.dataType for f in df.schema.fields}
    columns = [
        (widened(F.col(f"`{f.name}`"), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in shape.fields
    ]
    return df.select(*columns)


def union_widened(frames: Iterable[DataFrame]) -> DataFrame:
    """Record sets matched by name, whatever their types: each is cast to the widest types and all are put together."""
    frames = list(frames)
    shape = widest(*[df.schema for df in frames])
    return functools.reduce(DataFrame.unionByName, [as_shape(df, shape) for df in frames])


def read_widened(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """Folders of Parquet files as one table. Files of one folder agree in types; folders may not.

    One footer per folder tells its columns. Folders that agree are read together, as they are stored, so filters and columns reach
    the files; only what differs is cast.
    """
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for folder in folders:
        shape = read_table(spark, folder).schema
        groups.setdefault(shape.json(), (shape, []))[1].append(folder)
    if not groups:
        raise ValueError("no folders to read")
    return union_widened(spark.read.schema(shape).parquet(*found) for shape, found in groups.values())
