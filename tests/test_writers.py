"""Sinks: manifests as the only commit, files cut by bytes, types that come back."""

import datetime
import decimal
import io
import json
import lzma
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.sources import direct, frames, schema, storage, writers
from framelake.sources.cursor import CursorRead
from framelake.sources.reader import DataNotFoundError, reader

DAY = "2024-02-03"


class Killed(Exception):
    pass


def seen(spark, root, **options):
    try:
        return sorted(r["n"] for r in reader(spark, root, start_date=DAY, **options))
    except DataNotFoundError:
        return None


@pytest.mark.parametrize("how", ["frame", "rewritten", "partitions", "partitions rewritten"])
def test_a_write_that_is_killed_leaves_the_old_or_the_new(spark, tmp_path, monkeypatch, how):
    """The driver dies at each of its steps in turn: before it, or half-way through a small file."""
    old = spark.createDataFrame([(i, f"k{i % 3}") for i in range(6)], "n long, k string").repartition(2)
    new = spark.createDataFrame([(i, f"k{i % 2}") for i in range(10, 15)], "n long, k string").repartition(2)
    options = {"partition_by": ["k"]} if "partitions" in how else {}
    was, becomes = list(range(6)), list(range(10, 15))
    outcomes = set()
    for step in range(200):
        root, calls = str(tmp_path / f"{how}-{step}"), []
        writers.write_batch(old, root, DAY, frame_id="as_at_1", **options)
        assert seen(spark, root) == was

        def dying(real, name):
            def f(*a, **k):
                calls.append(name)
                if len(calls) == step + 1:
                    if name == "write_text":  # half of it is there
                        real(a[0], a[1], a[2][: len(a[2]) // 2])
                    raise Killed
                return real(*a, **k)

            return f

        with monkeypatch.context() as m:
            for name in ("write_text", "touch", "delete"):
                m.setattr(storage, name, dying(getattr(storage, name), name))
            try:
                writers.write_batch(new, root, DAY, frame_id="as_at_1" if "rewritten" in how else "as_at_2", **options)
            except Killed:
                got = seen(spark, root)
                assert got in (was, becomes), (step, calls)
                outcomes.add(got == becomes)
                continue
        assert seen(spark, root) == becomes
        assert step >= 2 and outcomes == ({False} if how == "frame" else {False, True})  # a new frame is seen with its last step
        return
    raise AssertionError("never came to an end")


@pytest.mark.parametrize("format", ["jsonl", "parquet"])
@pytest.mark.parametrize("options", [{}, {"partition_by": ["k"]}])
def test_a_root_with_a_scheme_keeps_what_is_written(spark, tmp_path, format, options):
    root = f"file://{tmp_path}/data"
    for first in (0, 10):
        df = spark.createDataFrame([(first + i, f"k{i % 3}") for i in range(6)], "n long, k string").repartition(2)
        writers.write_batch(df, root, DAY, frame_id="as_at_1", format=format, **options)
        assert seen(spark, root) == seen(spark, f"{tmp_path}/data") == list(range(first, first + 6))


def test_a_routed_root_with_a_scheme_keeps_what_is_written(spark, tmp_path):
    for n in (3, 4):
        rows = spark.range(n).withColumn("_path", F.concat(F.lit("p"), F.col("id") % 2, F.lit("/x")))
        writers.write_routed(rows, f"file://{tmp_path}/routed", "parquet")
        assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/routed/*/x").collect()) == list(range(n))


def test_a_failed_attempt_s_files_do_not_count(spark, tmp_path):
    root = str(tmp_path)
    path = writers.write_batch(spark.range(4).toDF("n"), root, DAY, format="jsonl")
    (tmp_path / "year_2024/month_02/day_03" / path.rsplit("/", 1)[1] / "part-00000-99-0000.jsonl").write_text('{"n": 77}\n')
    assert seen(spark, root) == [0, 1, 2, 3]


def test_an_ignored_frame_gives_way(spark, tmp_path):
    for i, by in ((1, None), (2, None), (3, ["n"]), (4, ["n"])):
        root = str(tmp_path / ("by" if by else "plain"))
        writers.write_batch(spark.range(i).toDF("n"), root, DAY, frame_id=f"as_at_{i}", partition_by=by)
    assert seen(spark, str(tmp_path / "plain")) == [0, 1] and seen(spark, str(tmp_path / "by")) == [0, 1, 2, 3]
    day = "year_2024/month_02/day_03"
    storage.touch(spark, f"{tmp_path}/plain/{day}/as_at_2/frame.ignore")
    storage.touch(spark, f"{tmp_path}/by/{day}/by_n/n=3/as_at_4/frame.ignore")
    writers.write_batch(spark.range(7, 9).toDF("n"), str(tmp_path / "by"), DAY, frame_id="as_at_2", partition_by=["n"])  # an older one
    assert seen(spark, str(tmp_path / "plain")) == [0] and seen(spark, str(tmp_path / "by")) == [0, 1, 2]


def test_manifests_by_name_and_wholeness():
    files = ["f:/d/x.jsonl", "f:/d/y.jsonl", "f:/d/z.jsonl", "f:/d/_frame.1-a.manifest", "f:/d/_frame.2-b.manifest", "f:/e/w.jsonl"]
    names = {"f:/d/_frame.1-a.manifest": ["x.jsonl"], "f:/d/_frame.2-b.manifest": ["y.jsonl"]}
    data = lambda listed: [f for f in frames.committed(files, lambda ms: listed) if frames.is_data(f)]
    assert data(names) == ["f:/d/y.jsonl", "f:/e/w.jsonl"]
    assert data({k: v for k, v in names.items() if "1-a" in k}) == ["f:/d/x.jsonl", "f:/e/w.jsonl"]
    assert data({}) == ["f:/e/w.jsonl"]


@pytest.mark.parametrize("format", ["jsonl", "zstd", "lzma", "text", "flat"])
def test_files_are_cut_by_bytes(spark, tmp_path, format):
    r = random.Random(3)
    rows = [(i, "x" * (20 if r.random() < 0.9 else 3_000)) for i in range(2_000)] + [(9_999, "y" * 50_000)]
    df = spark.createDataFrame(rows, "n long, s string").coalesce(1)
    most = 40_000
    made = direct.write(df, str(tmp_path / "a"), format, file_bytes=most)
    assert sum(m.rows for m in made) == len(rows) and len(made) > 5
    assert all(m.bytes <= most or m.rows == 1 for m in made)
    assert all(m.bytes > most - 3_100 for m in made[:-2])  # full, but for the longest line
    if format in ("jsonl", "flat"):
        assert sorted(r["n"] for r in spark.read.json(str(tmp_path / "a")).collect()) == sorted(x[0] for x in rows)


def test_parquet_is_cut_at_the_row_group_that_fills_it(spark, tmp_path):
    df = spark.range(300_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1)
    made = direct.write(df, str(tmp_path / "a"), file_bytes=3 << 20)
    assert sum(m.rows for m in made) == 300_000 and len(made) >= 3
    assert all(3 << 20 <= m.bytes < 12 << 20 for m in made[:-1])
    assert spark.read.parquet(str(tmp_path / "a")).agg(F.countDistinct("id")).first()[0] == 300_000


def test_types_come_back(spark, tmp_path):
    schema = "a tinyint, b int, c bigint, d float, e double, f decimal(12,3), g string, h binary, i boolean, j date, k timestamp, l timestamp_ntz, m array<int>, n struct<x:int,y:string>, o map<string,bigint>, p array<struct<q:date>>"
    at, row = datetime.datetime(2024, 2, 3, 4, 5, 6, 789), {"q": datetime.date(2020, 1, 1)}
    rows = [(1, 2, 3, 0.5, 1.5, decimal.Decimal("7.125"), "é\n", b"\x00\xff", True, datetime.date(1999, 1, 2), at, at, [1, None], (1, None), {"k": 5}, [row]), (None,) * 16]
    df = spark.createDataFrame(rows, schema)
    writers.write_batch(df, str(tmp_path), DAY)
    back = reader(spark, str(tmp_path), start_date=DAY).df
    assert back.schema.simpleString() == df.schema.simpleString()
    key = lambda r: r["b"] is None
    assert sorted(map(lambda r: r.asDict(True), back.collect()), key=key) == [r.asDict(True) for r in df.collect()]


@pytest.mark.parametrize("format", direct.FORMATS)
def test_an_empty_frame_is_no_missing_one(spark, tmp_path, format):
    df = spark.createDataFrame([], "n long, s string")
    writers.write_batch(df, str(tmp_path), DAY, format=format, always_complete=True)
    out = reader(spark, str(tmp_path), start_date=DAY).df
    assert out.columns == (["n", "s"] if format == "parquet" else out.columns) and (format == "text" or out.count() == 0)


def test_a_manifest_names_rows_and_bytes(spark, tmp_path):
    writers.write_files(spark.range(10).repartition(2), str(tmp_path), "jsonl")
    (manifest,) = [f for f in storage.files(spark, str(tmp_path)) if f.endswith(".manifest")]
    *files, end = map(json.loads, storage.read_text(spark, manifest).split("\n"))
    assert end == {"files": 2} and sum(f["rows"] for f in files) == 10 and all((tmp_path / f["file"]).stat().st_size == f["bytes"] for f in files)


@pytest.mark.parametrize("format", ["parquet", "jsonl", "zstd"])
def test_expectations_count_every_row_and_set_bad_ones_aside(spark, tmp_path, format):
    r = random.Random(11)
    rows = [(i, r.choice([None, 1, 5, 50]), r.choice([None, "ab", "Q7", ""])) for i in range(200)]
    df = spark.createDataFrame(rows, "n long, size int, code string").repartition(3)
    rules = [
        {"expectation": "expect_column_values_to_not_be_null", "column": "size"},
        {"expectation": "expect_column_values_to_be_between", "column": "size", "minimum": 2, "maximum": 10},
        {"expectation": "expect_column_values_to_match_regex", "column": "code", "regex": "[a-z]"},
        {"expectation": "expect_column_to_exist", "column": "n"},
    ]
    fails = lambda x: [x[1] is None, x[1] is not None and not 2 <= x[1] <= 10, x[2] is not None and not any(c.islower() for c in x[2]), False]
    report = schema.Report()
    writers.write_batch(df, str(tmp_path), DAY, format=format, expectations=rules, report=report)
    assert seen(spark, str(tmp_path)) == [x[0] for x in rows if not any(fails(x))]
    assert report.counts() == {"rows": 200} | {schema.label(e): sum(fails(x)[i] for x in rows) for i, e in enumerate(rules)}
    back = spark.read.option("recursiveFileLookup", True)
    if format != "zstd":
        got = {x["n"]: x["_failed"] for x in (back.parquet if format == "parquet" else back.json)(str(tmp_path / "BACKOUT")).collect()}
        assert got == {x[0]: [schema.label(e) for e, f in zip(rules, fails(x)) if f] for x in rows if any(fails(x))}
    assert "_failed" not in reader(spark, str(tmp_path), start_date=DAY).keys()
    assert writers.write_batch(df.where("false"), str(tmp_path), DAY, format=format, expectations=rules, report=schema.Report()) is None
    with pytest.raises(Exception, match="failed"):  # without a report the write stops
        writers.write_batch(df, str(tmp_path), DAY, format=format, expectations=rules)


@pytest.mark.parametrize("format", ["jsonl", "parquet", "lzma"])
def test_batches_from_a_cursor_are_every_row_once_in_order(spark, tmp_path, format):
    rows = [(i, i % 3) for i in range(120)]
    for k in range(6):
        writers.write_files(spark.createDataFrame(rows[20 * k : 20 * k + 20], "n long, m int").repartition(1), str(tmp_path / f"{k}"), format)
    files = sorted(f for f in storage.files(spark, str(tmp_path)) if frames.is_data(f))
    start = lambda cursor: CursorRead(spark, files, cursor, chosen=lambda df: df.where("m < 2"))
    want = [r["n"] for r in start({})]
    assert sorted(want) == [n for n, m in rows if m < 2]
    cursor, got, sizes = {}, [], iter([1, 5, 13, 0, 27, 14])
    while True:
        part = start(json.dumps(cursor))
        batch = part.batch(next(sizes, None))
        cursor = part.cursor
        if batch is None and not part._left():
            break
        got.append(sorted(r["n"] for r in batch) if batch is not None else [])
    assert [len(g) for g in got[:6]] == [1, 5, 13, 0, 27, 14]
    at = 0
    for g in got:
        assert g == sorted(want[at : at + len(g)])
        at += len(g)
    assert at == len(want)
    mixed = start({})
    head = [next(iter(mixed))["n"]]
    rest = start(mixed.cursor).batch()
    assert sorted(head + [r["n"] for r in rest]) == sorted(want)


@pytest.mark.parametrize("format", ["parquet", "jsonl", "zstd"])
def test_names_with_dots(spark, tmp_path, format):
    df = spark.createDataFrame([(1, "x", 5), (2, "y", 50), (3, None, 7)], "`a.b` int, `c.d` string, e int")
    report, root = schema.Report(), str(tmp_path)
    rule = {"expectation": "expect_column_values_to_be_between", "column": "a.b", "minimum": 1, "maximum": 2}
    writers.write_batch(df, f"{root}/one", "2024-02-03", format=format, expectations=[rule], report=report)
    assert sorted(tuple(r) for r in reader(spark, f"{root}/one", start_date="2024-02-03").df.select("`a.b`", "`c.d`", "e").collect()) == [(1, "x", 5), (2, "y", 50)]
    assert report.counts()["rows"] == 3
    writers.write_batch(df, f"{root}/two", "2024-02-03", format=format, partition_by=["c.d"])
    assert {f.split("c.d=")[1].split("/")[0] for f in storage.files(spark, f"{root}/two") if "c.d=" in f} == {"x", "y", "null"}


def test_a_listing_starts_no_process_a_file(spark, tmp_path):
    for i in range(1_500):
        folder = tmp_path / f"a b={i % 7}" / "é"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"_{i}.x").touch()
    start = time.monotonic()
    found = storage.files(spark, str(tmp_path))
    assert time.monotonic() - start < 5  # 10 s with a process a file
    assert found == sorted(f"file:{tmp_path}/a b={i % 7}/é/_{i}.x" for i in range(1_500))
    (tmp_path / "none").mkdir()
    assert storage.files(spark, f"{tmp_path}/none") == storage.files(spark, f"{tmp_path}/no") == []


def test_a_small_file_gets_a_small_lzma_dictionary():
    assert [direct._lzma(n)["dict_size"] for n in (1, 1 << 16, 62 << 20)] == [4096, 1 << 16, 8 << 20]
    line, out = pa.RecordBatch.from_arrays([pa.array(["xy" * 100_000])], names=["value"]), io.BytesIO()
    out.close, close = lambda: None, out.close
    f = direct._LineFile(out, "lzma", 1 << 16)
    assert f.write(line, 1 << 16) == 1
    f.close()
    assert lzma.decompress(out.getvalue()) == b"xy" * 100_000 + b"\n"
    close()
