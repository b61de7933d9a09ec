import statistics

import pytest
from pyspark.sql import functions as F

from framelake.operators import predicates as P
from framelake.operators.dataset import Dataset, Storage, row_numbers

ROWS = [
    {"name": "Ada", "age": 36, "dob": "1815-12-10", "tags": ["x", "y"]},
    {"name": "Bo", "age": 7, "tags": []},
    {"name": "cy", "age": None, "dob": "1990-01-01"},
    {"name": "Dee", "age": 36, "dob": "1990-01-01", "tags": ["y"]},
]


@pytest.fixture
def ds(spark):
    return Dataset.of(spark, ROWS)


def names(d):
    return sorted(r["name"] for r in d)


def test_projection(ds):
    assert ds.select("name", "nope").first() == {"name": "Ada", "nope": None} and ds["name"].keys() == ["name"]
    assert ds.select("*").count() == 4 and ds.select("upper(name) AS u").first() == {"u": "ADA"}
    assert ds.rename({"age": "years"}).keys()[1] == "years" and ds.set_value("one", 1).first()["one"] == 1
    assert ds.set_value("twice", lambda d: d["age"] * 2).first()["twice"] == 72 and ds.order_columns().keys() == sorted(ds.keys())


def test_filters(ds):
    assert names(ds.filter("age = 36 AND name LIKE 'A%'")) == ["Ada"]
    assert names(ds.filter(("age", "=", 36))) == ["Ada", "Dee"]
    assert names(ds.filter([("age", "=", 36), ("name", "like", "d%")])) == ["Dee"]
    assert names(ds.filter([[("age", "<", 10)], [("name", "is", "cy")]])) == ["Bo", "cy"]
    assert names(ds.filter(("age", "!=", 36))) == ["Bo"] and names(ds.filter(P.ne("age", 36))) == ["Bo", "cy"]
    assert names(ds.filter(P.negate(F.col("age") > 10))) == ["Bo", "cy"] and names(ds.filter(P.not_in("age", [36]))) == ["Bo", "cy"]
    assert names(ds.filter(("tags", "contains", "y"))) == ["Ada", "Dee"] and names(ds.filter(("name", "contains", "e"))) == ["Dee"]
    assert names(ds.filter(("name", "~", "^[A-B]"))) == ["Ada", "Bo"] and names(ds.filter(("name", "!in", ["Ada", "cy"]))) == ["Bo", "Dee"]
    assert names(ds.filter(lambda d: d["age"] == 7)) == ["Bo"] and names(ds.filter_rows(lambda r: len(r["name"]) == 2 and r["age"] is None)) == ["cy"]
    assert names(ds.filter(P.not_like("dob", "18%"))) == ["Bo", "Dee", "cy"] and ds.filter(("absent", "=", 1)).count() == 0
    with pytest.raises(ValueError):
        ds.filter(("age", "??", 1))


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).withColumn("k", F.col("id") % 3).write.parquet(path)
    plan = spark.read.parquet(path).filter(P.ne("k", 1))._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualNullSafe(k,1))" in plan


def test_distinct_order_take(ds):
    assert ds.select("age").distinct().count() == 3 and ds.distinct("age").count() == 3
    assert [r["age"] for r in ds.sort_and_take("age", 2)] == [None, 7] and [r["age"] for r in ds.sort_and_take("age", 3, True)] == [36, 36, 7]
    assert len(list(ds.itake(2))) == 2 and ds.take(3).count() == 3 and ds.sample(1.0).count() == 4
    assert [r["name"] for r in ds.get_items(0, 2, order=["name"])] == ["Ada", "Dee"]
    assert row_numbers(ds.df, "age", "name").where("row = 2").first()["name"] == "Dee"


def test_groups(ds):
    out = {r["age"]: r for r in ds.group_by("age").aggregate([("COUNT", "*"), ("max", "name")])}
    assert out[36]["COUNT(*)"] == 2 and out[36]["MAX(name)"] == "Dee" and out[None]["COUNT(*)"] == 1
    assert ds.group_by("age").groups().count() == 3 and ds.group_by("*").count().first() == {"COUNT(*)": 4}
    assert ds.filter("age > 99").group_by("*").count().count() == 0
    assert {r["age"]: r["COUNT(dob)"] for r in ds.group_by("age").count("dob")}[7] == 0
    with pytest.raises(ValueError):
        ds.group_by("age").aggregate([("MODE", "age")])


def test_statistics(spark):
    v = [4, 4, 6, 9, 1]
    d = Dataset.of(spark, [{"v": x} for x in v])
    assert (d.min("v"), d.max("v"), d.sum("v"), d.min_max("v"), d.mean("v")) == (1, 9, 24, (1, 9), 4.8)
    assert d.variance("v") == pytest.approx(statistics.variance(v)) and d.standard_deviation("v") == pytest.approx(statistics.stdev(v))
    assert sum(r["n"] for r in d.histogram("v", 4)) == 5 and sorted(d.collect_list("v")) == sorted(v)


def test_collected_set(ds):
    c = ds.collect_set("age")
    assert len(c) == 3 and 36 in c and None in c and 99 not in c and names(c[36]) == ["Ada", "Dee"]
    assert {r["age"]: r["name"] for r in c.aggregate("name", max)}[36] == "Dee"
    assert {r["age"]: r["name"] for r in c.aggregate("name", lambda v: float(len(v)))}[36] == 2.0
    assert {r["age"]: r["count"] for r in c.count()}[36] == 2 and len(dict(c.items())) == 3
    assert c.apply(lambda p: p.head(1)[["name"]], "name string").count() == 3


def test_schema_display_and_storage(spark, ds):
    assert ds.types()["age"] == "numeric" and ds.types()["name"] == "string" and list(ds.to_pandas().columns) == ds.keys()
    assert "Ada" in ds.to_ascii_table() and "null" in ds.to_ascii_table(10)
    assert "<td>a&lt;b</td>" in Dataset.of(spark, [{"x": "a<b"}]).to_html_table()
    assert ds.set_hash() == Dataset.of(spark, ROWS[::-1]).order_columns().set_hash() != ds.take(3).set_hash()
    for s in Storage:
        with Dataset.of(spark, ROWS, storage=s) as d:
            assert d.count() == 4
    assert Dataset.of(spark, []).count() == 0 and Dataset.of(spark, [{"a": None}]).first() == {"a": None}


def test_flatten(spark):
    d = Dataset.of(spark, [{"a": 1, "b": {"c": "x", "d": "y"}, "e": ["p", "q"]}], "a int, b struct<c:string,d:string>, e array<string>")
    assert d.flatten().keys() == ["a", "b.c", "b.d", "e"] and d.flatten(items=2).first() == {"a": 1, "b.c": "x", "b.d": "y", "e.0": "p", "e.1": "q"}


def test_items_by_position_reach_the_driver_alone(spark):
    from framelake.operators.dataset import Dataset

    d = Dataset(spark.range(1000).selectExpr("id % 250 AS k", "id AS v").repartition(7))
    want = sorted((i % 250, i) for i in range(1000))
    assert [tuple(r.values()) for r in d.get_items(0, 999, 500, 3, 5000)] == [want[0], want[999], want[500], want[3]]
    assert d.get_items(1, order=["v"]) == [{"k": 1, "v": 1}] and d.get_items(2000) == []


def test_a_hot_key_is_aggregated_in_parts(spark):
    from framelake.operators.dataset import Dataset

    d = Dataset(spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 'hot', 'b')) AS k", "CAST(id AS double) AS v").repartition(5))
    out = {r["k"]: r["v"] for r in d.collect_set("k").aggregate("v", lambda x: max(x) - 0.0, merge=max)}
    assert out == {None: 2997.0, "hot": 2998.0, "b": 2999.0}


def test_literal_rows_keep_their_column_order(spark):
    from framelake.operators.dataset import Dataset

    assert Dataset.of(spark, [{"a": None, "b": 1}, {"b": 2, "c": "x"}]).keys() == ["a", "b", "c"]
    assert Dataset.of(spark, [{"a": None}]).first() == {"a": None}


def test_names_with_dots_and_map_columns(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', 5), (2, 'a', 3), (2, 'b', 9), (NULL, 'b', 1) AS t(k, s, n)").select(F.struct("k", "s").alias("p"), "n")
    flat = Dataset(df).flatten()
    assert flat.keys() == ["p.k", "p.s", "n"]
    assert sorted((r["p.s"], r["SUM(n)"], r["MAX(p.k)"]) for r in flat.group_by("p.s").aggregate([("SUM", "n"), ("MAX", "p.k")])) == [("a", 8, 2), ("b", 10, 2)]
    assert sorted(r["p.s"] for r in flat.group_by("p.s").groups()) == ["a", "b"] and flat.min("p.k") == 1 and flat.min_max("p.k") == (1, 2)
    assert sorted((r["p.s"], r["n"]) for r in flat.distinct("p.s")) == [("a", 5), ("b", 1)]  # the least by p.k, nulls first
    assert [r["n"] for r in flat.sort_and_take("p.k", 2, descending=True)] == [3, 9] and sorted(flat.collect_list("p.s")) == ["a", "a", "b", "b"]
    assert sorted((r["p.s"], r["n"]) for r in flat.collect_set("p.s").aggregate("n", "max")) == [("a", 5), ("b", 9)]
    maps = Dataset(spark.sql("SELECT * FROM VALUES (1, map('x', 2)), (1, map('x', 1)), (2, map()) AS t(n, m)"))
    assert sorted((r["n"], r["m"].get("x")) for r in maps.distinct("n")) == [(1, 1), (2, None)] and maps.sort_and_take("n", 1).first()["m"] == {"x": 1}


def test_set_hash_counts_rows(spark):
    h = lambda *v: Dataset(spark.createDataFrame([(x, str(x)) for x in v], "n int, s string")).set_hash()
    assert h(1, 1, 2) == h(2, 1, 1) and len({h(1, 1, 2), h(2, 3, 3), h(1, 2), h(), h(1, 1, 1, 1, 2), h(2)}) == 6
    df = spark.createDataFrame([(1, None), (None, "1")], "n int, s string")
    assert Dataset(df).set_hash() == Dataset(df.select("s", "n").orderBy("s")).set_hash() != Dataset(df.limit(1)).set_hash()
