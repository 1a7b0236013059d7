from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources import quarantine, results, widening
from tarn.sources.contracts import contract
from tests.conftest import rows


def test_pages_are_in_order_complete_and_open_their_files_only(spark, tmp_path):
    df = spark.range(1050).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b")).repartition(6)
    result = results.store_result(df, str(tmp_path), [("a", False), ("b", True)], page_rows=100, block_rows=250)
    got = [tuple(r) for n in range(result.pages) for r in result.page(n).collect()]
    expected = sorted(((i % 7, i if i % 5 else None) for i in range(1050)), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    assert got == expected and (result.row_count, result.pages, result.columns) == (1050, 11, ["a", "b"])
    assert result.page(10).count() == 50 and result.page(11).count() == 0
    assert {f.split("_block=")[1][0] for f in result.page(3).inputFiles()} >= {"1"}
    plan = result.page(3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_block" in plan or "PartitionFilters: [cast(_block" in plan or "_block" in plan.split("PartitionFilters")[1]
    # Files of other blocks may go, and the page is still there.
    for folder in Path(tmp_path, "rows").glob("_block=[023]"):
        for f in folder.glob("*.parquet"):
            f.write_bytes(b"gone")
    assert [tuple(r) for r in result.page(3).collect()] == expected[300:400]


def test_the_query_runs_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    result = results.store_result(spark.range(300, numPartitions=3).select(counted.asNondeterministic()("id").alias("x")), str(tmp_path), [("x", True)], 50)
    assert [r.x for r in result.page(5).collect()] == list(range(250, 300)) and result.page(0).count() == 50
    assert calls.value == 300


def test_very_many_equal_rows_are_cut(spark, tmp_path):
    df = spark.range(9000, numPartitions=5).select(F.lit(1).alias("x"))
    result = results.store_result(df, str(tmp_path), [("x", True)], 100, 2000)
    assert result.row_count == 9000 and result.page(44).count() == 100
    sizes = [spark.read.parquet(str(p)).count() for p in Path(tmp_path, "rows").rglob("*.parquet")]
    assert max(sizes) < 3000 and len(sizes) >= 5


def test_errors_and_empty_results(spark, tmp_path):
    bad = results.store_result(spark.range(3).select(F.raise_error(F.lit("no such luck")).alias("x")), str(tmp_path / "a"))
    assert not bad.ok and "no such luck" in bad.error and bad.row_count == 0
    empty = results.store_result(spark.range(0), str(tmp_path / "b"), [("id", True)])
    assert empty.ok and (empty.row_count, empty.pages) == (0, 0)
    plain = results.store_result(spark.range(7, numPartitions=2), str(tmp_path / "c"), page_rows=3)
    assert [[r.id for r in plain.page(n).collect()] for n in range(3)] == [[0, 1, 2], [3, 4, 5], [6]]
    plain.drop()
    assert not (tmp_path / "c").exists()


KINDS = ["tinyint", "int", "bigint", "float", "double", "decimal(5,2)", "decimal(38,10)", "string", "date", "timestamp", "boolean", "void",
         "struct<a:int>", "struct<a:bigint,b:string>", "array<int>", "array<double>", "map<string,int>"]


def kind(text):
    return T.NullType() if text == "void" else T.StructType.fromDDL(f"x {text}").fields[0].dataType


@pytest.mark.parametrize("a,b,expected", [
    ("tinyint", "bigint", "bigint"), ("int", "double", "double"), ("bigint", "float", "double"), ("int", "decimal(5,2)", "decimal(12,2)"),
    ("decimal(5,2)", "decimal(8,5)", "decimal(8,5)"), ("decimal(38,10)", "bigint", "decimal(38,10)"), ("decimal(38,0)", "decimal(38,10)", "double"),
    ("date", "timestamp", "timestamp"), ("boolean", "int", "string"), ("int", "string", "string"), ("array<int>", "array<bigint>", "array<bigint>"),
    ("struct<a:int>", "struct<b:date>", "struct<a:int,b:date>"), ("map<string,int>", "array<int>", "string"),
])
def test_lattice(a, b, expected):
    assert widening.widest_type(kind(a), kind(b)).simpleString() == expected
    assert widening.widest_type(kind(b), kind(a)).simpleString().replace("b:date,a:int", "a:int,b:date") == expected


def test_whole_and_decimal_types_widen_in_any_order():
    from functools import reduce
    from itertools import permutations

    for group in (["int", "decimal(5,2)", "bigint"], ["date", "timestamp", "string"], ["float", "int", "decimal(5,2)"], ["void", "int", "boolean"]):
        assert len({reduce(widening.widest_type, map(kind, p)).simpleString() for p in permutations(group)}) == 1


def test_frames_of_different_types_are_one_table(spark):
    a = spark.sql("SELECT 1 AS id, struct(2 AS p) AS s, array(1, 2) AS l, DATE'2024-01-02' AS d")
    b = spark.sql("SELECT 'x' AS id, struct(CAST(3 AS bigint) AS p, 'q' AS q) AS s, array(1.5D) AS l, TIMESTAMP'2024-01-02 03:00:00' AS d, 7 AS n")
    c = spark.sql("SELECT NULL AS id, NULL AS s")
    got = widening.union_widened([a, b, c])
    assert got.schema.simpleString() == "struct<id:string,s:struct<p:bigint,q:string>,l:array<double>,d:timestamp,n:int>"
    found = sorted((str(r.id), r.s and tuple(r.s), r.l, r.n) for r in got.collect())
    assert found == [("1", (2, None), [1.0, 2.0], None), ("None", None, None, None), ("x", (3, "q"), [1.5], 7)]


def test_folders_that_agree_are_read_together(spark, tmp_path):
    for part, kind_ in enumerate(["int", "int", "bigint"]):
        spark.range(4).select(F.col("id").cast(kind_).alias("v"), F.lit(part).alias("part")).write.parquet(f"{tmp_path}/{part}")
    got = widening.read_widened(spark, [f"{tmp_path}/{p}" for p in range(3)])
    assert got.count() == 12 and got.schema["v"].dataType == T.LongType()
    plan = got.where("part = 2").select("v")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 2 and "PushedFilters: [IsNotNull(part), EqualTo(part,2)]" in plan
    with pytest.raises(ValueError, match="no folders"):
        widening.read_widened(spark, [])


SHAPE = contract("id bigint, at timestamp, note string, n int")


def parts(spark, folder, **options):
    good, bad = quarantine.read_json_parts(spark, str(folder), SHAPE, **options)
    name = F.element_at(F.split("_file", "/"), -1).alias("file")
    return rows(good.select(name, "_place", "id", "note", "n")), rows(bad.select(name, "_place", "_reason", "_raw"))


def test_lines_that_cannot_be_read_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"id": 1, "note": "x", "n": 3}\r\n\n  \n{"id": 2, "at"\n[1]\n"text"\n{"id": "two"}\n{"id": 4, "n": 99999999999, "at": "never"}\n{}')
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text('{"id": 5, "extra": {"k": [1]}, "note": {"a": 1}}\n{"id": null}')
    good, bad = parts(spark, tmp_path)
    assert good == [("a.json", 0, 1, "x", 3), ("a.json", 8, None, None, None), ("c.json", 0, 5, '{"a":1}', None), ("c.json", 1, None, None, None)]
    assert bad == [
        ("a.json", 3, "not JSON", '{"id": 2, "at"'), ("a.json", 4, "not an object", "[1]"), ("a.json", 5, "not an object", '"text"'),
        ("a.json", 6, "unreadable values: id", '{"id": "two"}'),
        ("a.json", 7, "unreadable values: at, n", '{"id": 4, "n": 99999999999, "at": "never"}'),
    ]


def test_anything_behind_a_value_is_no_json(spark, tmp_path):
    broken = ['{"id": 1}{"id": 2}', '{"id": 1} x', '{"id": 1}, {"id": 2}', '{"id": 1}], [', '{"id": 1}} {', '{"id": 1', "{'id': }"]
    (tmp_path / "a.json").write_text("\n".join([*broken, ' {"id": 9} ']))
    good, bad = parts(spark, tmp_path)
    assert [(g[1], g[2]) for g in good] == [(7, 9)]
    assert [(b[1], b[2]) for b in bad] == [(i, "not JSON") for i in range(7)]


def test_whole_files_with_objects_and_lists(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "id": 1\n}')
    (tmp_path / "list.json").write_text('[{"id": 2},\n {"id": "x"}, 3, {"id": 4}]')
    (tmp_path / "broken.json").write_text('[{"id": 5}, ')
    good, bad = parts(spark, tmp_path, lines=False)
    assert [(f, p, i) for f, p, i, *_ in good] == [("list.json", 0, 2), ("list.json", 3, 4), ("one.json", 0, 1)]
    assert [b[:3] for b in bad] == [("broken.json", 0, "not JSON"), ("list.json", 1, "unreadable values: id"), ("list.json", 2, "not an object")]


def test_both_sides_land_and_a_repaired_folder_lands_anew(spark, tmp_path):
    landing, root, apart = tmp_path / "landing", str(tmp_path / "raw"), str(tmp_path / "apart")
    landing.mkdir()
    (landing / "a.json").write_text('{"id": 1}\n{"id": 2')
    assert quarantine.land_json(spark, str(landing), SHAPE, root, apart) == {"landed": 1, "kept_apart": 1}
    (landing / "a.json").write_text('{"id": 1}\n{"id": 2}')
    assert quarantine.land_json(spark, str(landing), SHAPE, root, apart) == {"landed": 2, "kept_apart": 0}
    assert rows(spark.read.parquet(root), "id") == [(1,), (2,)]
