import datetime
import json

import pytest

from framelake.sources import schema, storage
from framelake.sources.reader import reader
from framelake.streaming import sink

AT = datetime.datetime(2023, 4, 5, 6)


def test_fan_out(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["x", "y", "z"]), (2, ["a"], None), (3, ["q/r"], ["x"])], "key int, one array<string>, two array<string>")
    got = sorted((r["key"], r["_path"]) for r in sink.routed(df, "o/{one}/{two}").collect())
    assert got == [*((1, f"o/{a}/{b}") for a in "ab" for b in "xyz"), (2, "o/a/null"), (3, "o/q_r/x")]


def test_stream_routes_rows_and_sets_bad_ones_aside(spark, tmp_path):
    src, out, marks = tmp_path / "src", tmp_path / "out", str(tmp_path / "ck")
    src.mkdir()
    rows = [{"key": "1", "kind": "a"}, {"key": "2", "kind": "b"}, {"key": "oops", "kind": "a"}, {"key": None, "kind": "a"}]
    (src / "0.json").write_text("\n".join(map(json.dumps, rows)))
    s = schema.load_schema([{"name": "key", "type": "INTEGER"}, "kind"])
    stream = lambda: spark.readStream.schema("key string, kind string").json(str(src))
    template = f"{out}/{{date}}/{{kind}}"
    sink.start(stream(), template, marks, s, clock=lambda: AT).awaitTermination()
    read = lambda p: sorted(str(r["key"]) for r in spark.read.json(f"{out}/{p}").collect())
    assert read("2023-04-05/a/*") == ["1", "None"] and read("2023-04-05/b/*") == ["2"] and read("BACKOUT/*") == ["oops"]
    (src / "1.json").write_text(json.dumps({"key": "3", "kind": "b"}))
    sink.start(stream(), template, marks, s, clock=lambda: AT + datetime.timedelta(days=1)).awaitTermination()
    assert read("2023-04-06/b/*") == ["3"] and read("2023-04-05/a/*") == ["1", "None"]


def test_a_reader_sees_every_batch(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    stream = lambda: spark.readStream.schema("key long, kind string").json(str(src))
    for i in range(3):
        (src / f"{i}.json").write_text(json.dumps({"key": i, "kind": "a"}))
        sink.start(stream(), f"{out}/year_{{yyyy}}/month_{{mm}}/day_{{dd}}/{{kind}}", str(tmp_path / "ck"), clock=lambda: AT).awaitTermination()
    assert sorted(r["key"] for r in reader(spark, out, start_date="2023-04-05")) == [0, 1, 2]
    assert not [f for f in storage.files(spark, out) if "_staging" in f]


@pytest.mark.parametrize("format", ["jsonl", "parquet", "zstd"])
def test_a_batch_twice_is_a_batch_once(spark, tmp_path, format):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", None)], "key long, kind string, tags array<string>")
    for i in (7, 7, 8):
        sink.write_batch(df, i, f"{tmp_path}/o/{{date}}/{{kind}}/{{tags}}", at=AT, format=format)
    assert reader(spark, f"{tmp_path}/o", start_date="2023-04-05", template="{date}").count() == 6
