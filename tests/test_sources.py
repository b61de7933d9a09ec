import datetime
import json
import lzma
import zipfile

import pytest
import zstandard

from framelake.sources import frames, paths, schema, storage, writers
from framelake.sources.cursor import CursorRead
from framelake.sources.formats import read_files
from framelake.sources.reader import AccessDenied, DataNotFoundError, InvalidReaderConfigError, reader, sql

LINES = [{"user": "a", "n": 1}, {"user": "b", "n": 2}, {"user": "c", "n": 3}]
JSONL = "\n".join(map(json.dumps, LINES)) + "\n"


@pytest.mark.parametrize("text,want", [("3d5h", (3, 5)), ("2 weeks", (14, 0)), ("1d", (1, 0)), ("48h", (2, 0)), ("90m", (0, 1.5)), ("1 day 2 hours", (1, 2)), ("-4d", (-4, 0)), ("-2H-30M", (0, -2.5)), ("2d-36h", (0.5, 0)), ("-1w 12h", (-7, 12))])
def test_deltas(text, want):
    assert paths.parse_delta(text) == datetime.timedelta(days=want[0], hours=want[1])
    for bad in ("", "soon", "5x"):
        with pytest.raises(ValueError):
            paths.parse_delta(bad)


def test_date_paths():
    assert paths.date_paths(paths.DAY_TEMPLATE, "2020-02-03", "2020-02-04") == ["year_2020/month_02/day_03", "year_2020/month_02/day_04"]
    assert paths.date_paths("{yyyy}", "2021-01-01", "2020-12-31") == ["2020", "2021"]
    assert len(paths.date_paths("{date}/{HH}", datetime.datetime(2020, 12, 21, 18), datetime.datetime(2020, 12, 22, 1))) == 8
    assert paths.sanitize("a/b c") == "a_b_c"


def test_frames():
    f = ["d/as_at_1/x.jsonl", "d/as_at_1/frame.complete", "d/as_at_2/x.jsonl", "d/as_at_2/frame.complete", "d/as_at_2/frame.ignore", "d/as_at_3/x.jsonl"]
    assert frames.resolve(f) == ["d/as_at_1/x.jsonl"]
    by = ["d/by_a/a=1/x.jsonl", "d/by_b/b=1/x.jsonl", "d/by_b/b=2/x.jsonl", "d/BACKOUT/z.jsonl"]
    assert frames.resolve(by) == by[1:3] and frames.resolve(by, ("a", "=", 1)) == by[:1] and frames.resolve(by, ("b", "=", 9)) == [] and frames.resolve(by, ("z", "=", 1)) == by[1:3]
    with pytest.raises(NotImplementedError):
        frames.resolve(by, ("a", ">", 1))
    assert frames.resolve(["d/x.jsonl", "d/_staging-1/by_z/x.jsonl", "d/_temporary/0/x.jsonl"]) == ["d/x.jsonl"]


def test_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(JSONL)
    (tmp_path / "b.zstd").write_bytes(zstandard.compress(JSONL.encode()))
    (tmp_path / "c.lzma").write_bytes(lzma.compress(JSONL.encode()))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("in.jsonl", JSONL)
        z.writestr("in.csv", "user,n\nz,9\n")
    (tmp_path / "e.csv").write_text("user,n\nx,7\n")
    (tmp_path / "f.json").write_text('{"user": "j",\n "n": 1}')
    (tmp_path / "g.txt").write_text("line\nline")
    (tmp_path / "h.xml").write_text("<r k='v'><user>q</user></r>")
    (tmp_path / "i.lxml").write_text("<r><user>q</user></r>\n<r><user>s</user></r>\n")
    spark.createDataFrame(LINES, "user string, n long").write.parquet(str(tmp_path / "j.parquet"))
    n = lambda name: read_files(spark, [str(tmp_path / name)]).count()
    assert [n(x) for x in ("a.jsonl", "b.zstd", "c.lzma", "d.zip", "e.csv", "f.json", "g.txt", "h.xml", "i.lxml", "j.parquet")] == [3, 3, 3, 4, 1, 1, 1, 1, 2, 3]
    assert dict(read_files(spark, [str(tmp_path / "e.csv")]).dtypes) == {"user": "string", "n": "string"}
    x = read_files(spark, [str(tmp_path / "h.xml")]).first().asDict()
    assert x["@k"] == "v" and x["user"] == "q"
    assert read_files(spark, [str(tmp_path / "a.unknown")]) is None


def test_reader(spark, tmp_path):
    day = tmp_path / "set" / "year_2020" / "month_02" / "day_03" / "as_at_1"
    day.mkdir(parents=True)
    (day / "x.jsonl").write_text(JSONL)
    root = str(tmp_path / "set")
    with pytest.raises(DataNotFoundError):
        reader(spark, root, start_date="2020-02-03")
    (day / "frame.complete").touch()
    d = reader(spark, root, start_date="2020-02-03", select=["user"], filters=("n", ">", 1))
    assert sorted(r["user"] for r in d) == ["b", "c"] and d.keys() == ["user"]
    assert reader(spark, root, start_date="2020-02-05", freshness_limit="3d").count() == 3
    with pytest.raises(DataNotFoundError):
        reader(spark, root, start_date="2020-02-09", freshness_limit="3d")
    with pytest.raises(InvalidReaderConfigError):
        reader(spark, root, start_date="2020-03-01", end_date="2020-03-02", freshness_limit="3d")
    with pytest.raises(AccessDenied):
        reader(spark, root, valid_dataset_prefixes=["/else"])
    assert reader(spark, root, raw_path=True).count() == 3
    assert sql(spark, "SELECT mid(user, 0, 1) AS u, n FROM t WHERE n > 2", t=d.apply(lambda _: reader(spark, root, raw_path=True).df)).first() == {"u": "c", "n": 3}


def test_cursor(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text("\n".join(json.dumps({"i": 10 * i + k}) for k in range(4)))
    files = storage.files(spark, str(tmp_path))
    whole = [r["i"] for r in CursorRead(spark, files)]
    assert whole == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]
    for stop in (1, 4, 6, 12):
        read = CursorRead(spark, files)
        it = iter(read)
        head = [next(it)["i"] for _ in range(stop)]
        assert head + [r["i"] for r in CursorRead(spark, files, json.dumps(read.cursor))] == whole


def test_schema(spark, tmp_path):
    s = schema.load_schema({"fields": [{"name": "key", "type": "INTEGER"}, "text"]})
    assert s.simpleString() == "struct<key:bigint,text:string>" and schema.load_schema(["a", {"name": "b", "type": "list"}])["b"].dataType.simpleString() == "array<string>"
    assert schema.load_schema(False) is None and schema.load_schema(json.dumps({"columns": ["a"]})).names == ["a"]
    (tmp_path / "s.json").write_text('["q"]')
    assert schema.load_schema(tmp_path / "s.json").names == ["q"]
    for bad in (None, [{"name": "a", "type": "QUBIT"}]):
        with pytest.raises(ValueError):
            schema.load_schema(bad)
    df = spark.createDataFrame([(1, "x")], "key long, text string")
    schema.check_columns(df, s)
    for wrong in (df.drop("text"), df.withColumn("more", df.key), df.withColumn("key", df.key.cast("double"))):
        with pytest.raises(schema.SchemaError):
            schema.check_columns(wrong, s)
    assert schema.expect(df, [{"expectation": "expect_column_to_exist", "column": "key"}, {"expectation": "expect_column_values_to_be_in_set", "column": "text", "symbols": ["x"]}]).count() == 1
    with pytest.raises(Exception, match="failed"):
        schema.expect(df, [{"expectation": "expect_column_values_to_be_in_set", "column": "text", "symbols": ["y"]}]).collect()
    with pytest.raises(schema.SchemaError):
        schema.expect(df, [{"expectation": "expect_column_to_exist", "column": "zip"}])


ODD = [{"user": "a\u2028b\x0bc\x85d\re", "n": 1}, {"user": "b", "n": None}, {"user": None, "n": 3}, {"user": "x\ny", "n": 4}]


@pytest.mark.parametrize("format", ["parquet", "jsonl", "zstd", "lzma", "flat"])
def test_write_batch_round_trip(spark, tmp_path, format):
    df = spark.createDataFrame(ODD, "user string, n long").repartition(2)
    root = str(tmp_path / "out")
    writers.write_batch(df.limit(1), root, "2022-05-06", format=format, frame_id="as_at_1")
    writers.write_batch(df, root, "2022-05-06", format=format, frame_id="as_at_2")
    back = reader(spark, root, start_date="2022-05-06")
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r["user"], r["n"]) for r in back], key=key) == sorted([(r["user"], r["n"]) for r in ODD], key=key)
    writers.write_batch(df, root, "2022-05-07", format=format, partition_by=["n"])
    by = reader(spark, root, start_date="2022-05-07", partition_filter=("n", "==", 4))
    assert [(r["user"], r["n"]) for r in by] == [("x\ny", 4)] and reader(spark, root, start_date="2022-05-07").count() == 4
    assert reader(spark, root, start_date="2022-05-07", partition_filter=("n", "=", "null")).count() == 1
    assert not [f for f in storage.files(spark, root) if "_staging" in f]


@pytest.mark.parametrize("format", ["zstd", "lzma"])
def test_archives_overwrite_and_append(spark, tmp_path, format):
    df = spark.createDataFrame(LINES, "user string, n long")
    path = str(tmp_path / "a")
    n = lambda: read_files(spark, [f for f in storage.files(spark, path) if frames.is_data(f)]).count()
    writers.write_files(df.repartition(3), path, format)
    assert n() == 3
    writers.write_files(df.limit(1), path, format)
    assert n() == 1
    writers.write_files(df, path, format, mode="append", file_bytes=10)
    assert n() == 4
    writers.write_files(spark.range(25_003).coalesce(1), path, format)
    assert n() == 25_003


def test_days_choose_their_own_partitioning(spark, tmp_path):
    files = ["s/day_1/by_a/a=1/x.jsonl", "s/day_2/by_a/a=1/x.jsonl", "s/day_2/by_b/b=1/x.jsonl", "s/day_3/x.jsonl", "s/day_2/loose.jsonl"]
    assert frames.resolve(files) == sorted([files[0], files[2], files[3]])
    assert frames.resolve(files, ("a", "==", 1)) == sorted([files[0], files[1], files[3]])
    df = spark.createDataFrame(LINES, "user string, n long")
    writers.write_batch(df, str(tmp_path), "2022-01-01", partition_by=["n"])
    writers.write_batch(df, str(tmp_path), "2022-01-02", partition_by=["user"])
    writers.write_batch(df, str(tmp_path), "2022-01-03")
    assert reader(spark, str(tmp_path), start_date="2022-01-01", end_date="2022-01-03").count() == 9
    assert reader(spark, str(tmp_path), start_date="2022-01-01", end_date="2022-01-03", partition_filter=("n", "=", 1)).count() == 7


def test_two_batches_in_a_second_are_two_frames(spark, tmp_path):
    df = spark.createDataFrame(LINES, "user string, n long")
    names = {writers.frame_name() for _ in range(50)}
    assert len(names) > 40 and all(n.startswith("as_at_") for n in names)
    one, two = (writers.write_batch(df.where(f"n = {i}"), str(tmp_path), "2022-01-01") for i in (1, 2))
    assert one != two and [r["n"] for r in reader(spark, str(tmp_path), start_date="2022-01-01")] == [2]


def test_zip_members_by_their_own_extensions(spark, tmp_path):
    import io

    import pyarrow as pa
    import pyarrow.orc
    import pyarrow.parquet

    made = {"a.jsonl": JSONL.encode(), "b.lzma": lzma.compress(JSONL.encode()), "c.zstd": zstandard.compress(JSONL.encode()), "d.json": b'{"user": "j",\n"n": 9}', "e.csv": b"user,n\nz,9\n", "f.txt": b"two\nlines", "g.xml": b"<r k='v'><user>q</user><t>1</t><t>2</t></r>", "h.lxml": b"<r><user>q</user></r>\n<r><user>s</user></r>\n", "i.unknown": b"?"}
    for name, write in (("k.parquet", pa.parquet.write_table), ("l.orc", pa.orc.write_table)):
        buffer = io.BytesIO()
        write(pa.Table.from_pylist(LINES), buffer)
        made[name] = buffer.getvalue()
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("in.jsonl", json.dumps({"user": "u\u2028v", "n": 5}, ensure_ascii=False))
    made["m.zip"] = inner.getvalue()
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for name, raw in made.items():
            z.writestr(name, raw)
    rows = [r.asDict() for r in read_files(spark, [str(tmp_path / "all.zip")]).collect()]
    assert len(rows) == 3 * 3 + 1 + 1 + 1 + 1 + 2 + 3 + 3 + 1
    assert sum(r["user"] == "u\u2028v" for r in rows) == 1 and sum(r["value"] == "two\nlines" for r in rows) == 1 and sum(r["@k"] == "v" for r in rows) == 1


def test_declared_types(spark, tmp_path):
    s = schema.load_schema([{"name": "key", "type": "INTEGER"}, {"name": "x", "type": "DOUBLE"}, {"name": "t", "type": "VARCHAR"}])
    df = spark.sql("SELECT NULL AS t, CAST(1 AS INT) AS key, CAST(2 AS FLOAT) AS x")
    assert schema.declared(df, s).dtypes == [("key", "bigint"), ("x", "double"), ("t", "string")]
    with pytest.raises(schema.SchemaError):
        schema.declared(df.withColumn("key", df.x), s)


def test_sql_over_a_dataset_path(spark, tmp_path):
    df = spark.createDataFrame([*LINES, {"user": None, "n": 4}], "user string, n long")
    for d in ("2022-01-01", "2022-01-02"):
        writers.write_batch(df, str(tmp_path / "tweets" / "daily"), d, format="jsonl")
    dates = {"start_date": "2022-01-01", "end_date": "2022-01-02"}
    run = lambda q, **k: sql(spark, q, root=str(tmp_path), reader_options=dates, **k)
    assert run("SELECT * FROM tweets.daily").count() == 8 and run("select * from tweets/daily where user == 'a';").count() == 2
    assert run("SELECT COUNT(*) FROM tweets.daily WHERE user <> 'a' -- nulls are no 'a'").first() == {"COUNT(*)": 6}
    assert run("SELECT LEFT(user, 1), n FROM tweets.daily WHERE NOT n < 3 ORDER BY n").keys() == ["LEFT(user,1)", "n"]
    assert run("SELECT COUNT (*), user FROM (SELECT user FROM tweets.daily GROUP BY user) AS t GROUP BY user").count() == 4
    assert run("SELECT user FROM tweets.daily WHERE user LIKE '_' AND n IN (1, 2) /* and\n*/ LIMIT 3").count() == 3
    assert run("SELECT n AS m FROM t WHERE user IS NONE", t=df).collect_list("m") == [4]
    for bad in ("SELECT * FROM tweets..daily", "SELECT * FROM a//b", "SELECT * FROM a--b"):
        with pytest.raises(Exception):  # noqa: B017
            run(bad).count()


def test_reader_with_a_cursor(spark, tmp_path):
    df = spark.range(40).selectExpr("id AS n", "id % 2 AS odd").repartition(3)
    writers.write_batch(df, str(tmp_path), "2022-01-01", format="jsonl")
    read = lambda c: reader(spark, str(tmp_path), start_date="2022-01-01", filters="odd = 1", select=["n"], cursor=c)
    whole = [r["n"] for r in read({})]
    assert sorted(whole) == list(range(1, 40, 2))
    for stop in (1, 9, 20):
        first = read({})
        it = iter(first)
        head = [next(it)["n"] for _ in range(stop)]
        assert head + [r["n"] for r in read(json.dumps(first.cursor))] == whole


def test_write_rules(spark, tmp_path):
    df = spark.createDataFrame(LINES, "user string, n long")
    root = str(tmp_path / "out")
    assert writers.write_batch(df.limit(0), root, "2022-05-06") is None
    for name in ("a/", "a/BACKOUT", "a{b}", "a%"):
        with pytest.raises(ValueError):
            writers.write_batch(df, name)
    with pytest.raises(ValueError):
        writers.write_files(df, root, "yaml")
    writers.write_batch(df, root, "2022-05-06", partition_by=["user", "n"])
    assert reader(spark, root, start_date="2022-05-06").count() == 3
    assert reader(spark, root, start_date="2022-05-06", partition_filter=("user", "=", "b")).first()["n"] == 2
    with pytest.raises(schema.SchemaError):
        writers.write_batch(df, root, "2022-05-07", schema=schema.load_schema(["user"]))
    writers.write_files(df, str(tmp_path / "t"), "text")
    assert spark.read.text(str(tmp_path / "t")).count() == 3


def test_database_sink(spark, tmp_path):
    out = str(tmp_path / "rows")

    def commit(batch):
        with open(out, "a") as f:
            f.write(f"{len(batch)}\n")

    said = []
    assert writers.write_database(spark.range(250).coalesce(1).toDF("n"), commit, said.append) == 250 and said == [250]
    assert [int(x) for x in open(out)] == [100, 100, 50]


def test_xml_of_every_record_and_root(spark, tmp_path):
    (tmp_path / "a.lxml").write_text("<r><user>q</user></r>\n<r k='v'><user>s</user><n>2</n><e/></r>\n<r><n>2.5</n><tag>x</tag><tag>y</tag></r>\n")
    rows = [r.asDict() for r in read_files(spark, [str(tmp_path / "a.lxml")]).collect()]
    assert [r["user"] for r in rows] == ["q", "s", None] and [r["n"] for r in rows] == [None, 2.0, 2.5]
    assert rows[1]["_k"] == "v" and rows[2]["tag"] == ["x", "y"] and "e" in rows[0]
    (tmp_path / "b 1.xml").write_text("<r><user>q</user></r>")
    (tmp_path / "c.xml").write_text("<other><name>z</name></other>")
    got = [r.asDict() for r in read_files(spark, [str(tmp_path / "b 1.xml"), str(tmp_path / "c.xml")]).collect()]
    assert len(got) == 2 and {(r["user"], r["name"]) for r in got} == {("q", None), (None, "z")}
