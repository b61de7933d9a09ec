"""Files that differ in columns and types, and files that cannot be read."""

import json
import lzma
import random
from functools import reduce

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.sources import unite
from framelake.sources.formats import Rejects, read_files
from framelake.sources.reader import reader


def rows(df):
    return sorted((tuple(sorted(r.asDict(True).items())) for r in df.collect()), key=str)


def test_csv_files_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n3,4\n")
    (tmp_path / "c.csv").write_text('﻿"c, d",b\n"x ""y""\nz",5\n', encoding="utf-8")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("a,A\n6,7\n8\n")  # of one name the last counts; a short row
    out = read_files(spark, [str(tmp_path / f"{x}.csv") for x in "abcde"])
    none = {"a": None, "b": None, "c, d": None}
    want = [none | {"a": "1", "b": "2"}, none | {"b": "3", "a": "4"}, none | {"c, d": 'x "y"\nz', "b": "5"}, none | {"a": "7"}, none]
    assert [{k.lower(): v for k, v in r} for r in rows(out)] == [{k.lower(): v for k, v in r} for r in sorted((tuple(sorted(w.items())) for w in want), key=str)]
    typed = read_files(spark, [str(tmp_path / f"{x}.csv") for x in "abc"], T.StructType.fromDDL("b int, a int, z string"))
    assert [tuple(r) for r in typed.orderBy("b").collect()] == [(2, 1, None), (3, 4, None), (5, None, None)]


def test_parquet_and_orc_folders_that_evolve(spark, tmp_path):
    for format in ("parquet", "orc"):
        root = str(tmp_path / format)
        spark.sql("SELECT 1 AS id, CAST(7 AS INT) AS n, named_struct('x', 1) AS s").write.format(format).save(f"{root}/1")
        spark.sql("SELECT 2 AS id, CAST(8000000000 AS BIGINT) AS n, 'new' AS extra, named_struct('x', 2, 'y', 'q') AS s").write.format(format).save(f"{root}/2")
        spark.sql("SELECT 3 AS id, 2.5D AS n, array('a') AS tags").write.format(format).save(f"{root}/3")
        spark.sql("SELECT 4 AS id, 'text' AS n, 'older' AS extra").write.format(format).save(f"{root}/4")
        out = reader(spark, root, raw_path=True).df
        assert {f.name: f.dataType.simpleString() for f in out.schema} == {"id": "int", "n": "string", "extra": "string", "s": "struct<x:int,y:string>", "tags": "array<string>"}
        got = {r["id"]: r.asDict(True) for r in out.collect()}
        assert [got[i]["n"] for i in (1, 2, 3, 4)] == ["7", "8000000000", "2.5", "text"]
        assert [got[i]["extra"] for i in (1, 2, 3, 4)] == [None, "new", None, "older"]
        assert [got[i]["s"] for i in (1, 2, 3)] == [{"x": 1, "y": None}, {"x": 2, "y": "q"}, None] and got[3]["tags"] == ["a"]
        declared = reader(spark, root, raw_path=True, schema=T.StructType.fromDDL("id int, extra string")).df
        assert rows(declared.where("extra IS NOT NULL")) == [(("extra", "new"), ("id", 2)), (("extra", "older"), ("id", 4))]


def test_files_that_only_lack_columns_are_one_scan(spark, tmp_path):
    spark.sql("SELECT 1 AS id, 2 AS n").write.parquet(str(tmp_path / "1"))
    spark.sql("SELECT 3 AS id, 4 AS n, 5 AS m").write.parquet(str(tmp_path / "2"))
    out = reader(spark, str(tmp_path), raw_path=True).df.where("m > 1").select("id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "GreaterThan(m,1)" in plan and [r["id"] for r in out.collect()] == [3]


def test_formats_side_by_side(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": {"x": 1}, "t": "p"}\n{"k": 2}\n')
    (tmp_path / "b.csv").write_text("t,k\nq,three\n")
    spark.sql("SELECT CAST(9 AS INT) AS k, true AS v").write.parquet(str(tmp_path / "c.parquet"))
    got = rows(reader(spark, str(tmp_path), raw_path=True).df.select("k", "t", "v"))
    assert got == sorted(((("k", k), ("t", t), ("v", v)) for k, t, v in [("1", "p", '{"x":1}'), ("2", None, None), ("three", "q", None), ("9", None, "true")]), key=str)


TYPES = st.recursive(
    st.sampled_from([T.NullType(), T.ByteType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.DecimalType(10, 2), T.DecimalType(38, 0), T.StringType(), T.BooleanType(), T.DateType(), T.TimestampType(), T.BinaryType()]),
    lambda t: st.one_of(t.map(T.ArrayType), st.dictionaries(st.sampled_from("abc"), t, min_size=1, max_size=3).map(lambda d: T.StructType([T.StructField(k, v) for k, v in sorted(d.items())])), t.map(lambda v: T.MapType(T.StringType(), v))),
    max_leaves=6,
)


def plain(t):
    """A type without the order of fields."""
    if isinstance(t, T.StructType):
        return {f.name: plain(f.dataType) for f in t}
    if isinstance(t, T.ArrayType):
        return [plain(t.elementType)]
    return (plain(t.keyType), plain(t.valueType)) if isinstance(t, T.MapType) else t.simpleString()


@settings(max_examples=300, deadline=None)
@given(TYPES, TYPES)
def test_types_meet_in_one_place(a, b):
    for value in (None, "_VALUE"):
        top = unite.wider(a, b, value)
        assert plain(unite.wider(b, a, value)) == plain(top) and unite.wider(a, a, value) == a
        assert plain(unite.wider(top, a, value)) == plain(top) == plain(unite.wider(top, b, value))
        assert unite.of_json(top.json()) == top


def test_a_tree_of_tasks_folds_all_types(spark):
    r = random.Random(5)
    kinds = [T.StructType([T.StructField(r.choice("abcdef"), r.choice([T.LongType(), T.DoubleType(), T.NullType(), T.ArrayType(T.LongType())]))]) for _ in range(500)]
    df = spark.createDataFrame([(k.json(),) for k in kinds], "type string").repartition(40)
    for fan in (3, 64):
        assert plain(unite.fold_types(df, "_VALUE", fan)) == plain(reduce(lambda a, b: unite.wider(a, b, "_VALUE"), kinds))
    assert unite.fold_types(df.limit(0)) is None


PACK = {"lzma": lzma.compress, "zstd": zstandard.compress}


@pytest.mark.parametrize("format", PACK)
@pytest.mark.parametrize("schema", [None, "n long, t string"])
def test_a_broken_archive_among_ten(spark, tmp_path, format, schema):
    for i in range(10):
        lines = "".join(json.dumps({"n": 100 * i + k, "t": "x" * k}) + "\n" for k in range(50))
        raw = PACK[format](lines.encode())
        (tmp_path / f"{i}.{format}").write_bytes(raw[: len(raw) // 2] if i == 4 else raw)
    lost = Rejects()
    out = reader(spark, str(tmp_path), raw_path=True, schema=schema and T.StructType.fromDDL(schema), rejects=lost).df
    assert sorted(r["n"] for r in out.collect()) == [100 * i + k for i in range(10) for k in range(50) if i != 4]
    assert lost.count() == 1
    (row,) = lost.rows().collect()
    assert row["path"].endswith(f"4.{format}") and row["why"]


def test_several_frames_in_one_archive_and_odd_lines(spark, tmp_path):
    text = '{"a": "x y\\u0085"}\r\n\n{"a": "é"}'
    (tmp_path / "a.zstd").write_bytes(zstandard.compress(text.encode()) + zstandard.compress(b'\n{"a": "z"}\n'))
    (tmp_path / "b.lzma").write_bytes(lzma.compress(text.encode()) + lzma.compress(b'\n{"a": "z"}'))
    (tmp_path / "c.lzma").write_bytes(lzma.compress(b""))
    for name, n in (("a.zstd", 3), ("b.lzma", 3)):
        assert sorted(r["a"] for r in read_files(spark, [str(tmp_path / name)]).collect()) == ["x y\x85", "z", "é"], (name, n)
    assert read_files(spark, [str(tmp_path / "c.lzma")]).count() == 0


def test_bad_lines_and_documents_are_left_out_and_counted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\nno json\n{"n": 2}\n{"n": 3\n[4]\n')
    (tmp_path / "b.json").write_text('{"n":\n 5}')
    (tmp_path / "c.json").write_text('{"n": ')
    (tmp_path / "d.lzma").write_bytes(lzma.compress(b'{"n": 6}\n{"n"}\n'))
    for schema in (None, T.StructType.fromDDL("n long")):
        lost = Rejects()
        out = read_files(spark, [str(tmp_path / x) for x in ("a.jsonl", "b.json", "c.json", "d.lzma")], schema, rejects=lost)
        assert out.columns == ["n"] and sorted(r["n"] for r in out.collect()) == [1, 2, 5, 6]
        assert lost.count() == 5 and lost.rows().count() == 5
        assert {r["record"] for r in lost.rows().where(F.col("record").isNotNull()).collect()} == {"no json", '{"n": 3', "[4]", '{"n"}'}


def test_broken_parquet_is_left_out(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    (tmp_path / "b.parquet").write_bytes(b"PAR1 no more")
    lost = Rejects()
    out = reader(spark, str(tmp_path), raw_path=True, rejects=lost).df
    assert out.count() == 3 and lost.count() == 1 and lost.rows().first()["path"].endswith("b.parquet")


def test_headers_of_a_store_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n3,4\n")

    def unknown(uri):
        raise ValueError(uri)

    monkeypatch.setattr(unite, "arrow_file", unknown)
    assert rows(read_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])) == [(("a", "1"), ("b", "2")), (("a", "4"), ("b", "3"))]
